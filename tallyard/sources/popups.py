"""Option popups of stored pages: blocks of products, their option rows, and the requested product of each block.

Both levels come from the table of elements. A block's product is resolved inside its page: by
the ids that images, links, data attributes and inputs of the block name, if exactly one of the
page's requests has one of them; else by its name, if exactly one request has that; else, where
a page shows one block for one request, that; else not at all. Elements are read many times over
and should be a stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyard.functions import rules
from tallyard.functions.text import first_text, squash, strip, to_number
from tallyard.sources.elements import around, attr, first_of, has_class, is_inside, mark, some
from tallyard.sources.shared import frozen

# fixed values: names of inputs that carry a product's id, letters and digits only; number fields of a row, by input
ID_INPUTS = ("qidx", "inqidx", "qidxpop", "inqidxpop", "productid", "inproductid")
NUMBERS = {
    "addPrice": "inOPaddPrice", "boxCountOpt": "boxCountOpt", "boxCountOpt2": "boxCountOpt2", "inoPer": "inoPer", "indcPer": "indcPer", "indcPer2": "indcPer2",
    "inoPrice": "inoPrice", "indcPrice": "indcPrice", "indcPrice2": "indcPrice2",
}


def product_label(c: Column) -> Column:
    """A name without its leading bracketed part."""
    return F.regexp_replace(squash(c), r"^\[[^\]]+\]\s*", "")


def _hidden() -> Column:
    style = F.lower(F.regexp_replace(attr("style"), r"\s", ""))
    return style.rlike(r"(?:^|;)(?:display:none|visibility:hidden|opacity:0(?:\.0*)?(?:;|$|!))") | F.map_contains_key("attrs", "hidden")


def blocks(els: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, productIndex) of the visible product blocks: neither they nor anything around them is hidden."""
    found = els.filter(has_class("many_add")).select(*keys, "pos", F.explode(F.array_append("up", F.col("pos"))).alias("around"))
    hidden = els.filter(_hidden()).select(*keys, F.col("pos").alias("around"), F.lit(True).alias("hides"))
    shown = found.join(hidden.hint("merge"), [*keys, "around"], "left").groupBy(*keys, "pos").agg(some(F.col("hides"), "hidden")).filter("not hidden")
    return shown.select(*keys, "pos", (F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1).alias("productIndex"))


def _ids() -> Column:
    """Product ids that an element names, in the order they are looked for."""
    image = F.regexp_extract(F.element_at(F.split(F.regexp_extract(attr("src"), r"^[^?#]*", 0), "/"), -1), r"^([0-9]+)(?:_|\.|$)", 1)
    link = F.regexp_extract(attr("href"), r"(?i)[?&]qIDX=([0-9]+)", 1)
    data = [squash(attr(name)) for name in ("data-product-id", "data-productid", "data-qidx")]
    plain = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    carries = plain(attr("name")).isin(*ID_INPUTS) | plain(attr("id")).isin(*ID_INPUTS)
    named = (F.col("tag") == "a") & F.map_contains_key("attrs", "href") | (F.col("tag") == "input") & (F.map_contains_key("attrs", "name") | F.map_contains_key("attrs", "id"))
    for name in ("data-product-id", "data-productid", "data-qidx"):
        named = named | F.map_contains_key("attrs", name)
    digits = lambda c: F.when(c.rlike("^[0-9]+$"), c)
    found = [F.when(F.col("inFigure"), image), *(F.when(named, x) for x in (link, *(digits(d) for d in data), F.when(carries, digits(squash(attr("value"))))))]
    return F.filter(F.array(*found), lambda x: x.isNotNull() & (x != ""))


def block_products(els: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with what they say of themselves and the request they belong to.

    ``requests`` has keys, productId, productName, one row for each product of a page. Blocks and the result are
    stored, one row a block: matches and readers use them several times, and would read all elements again for each.
    """
    shown = blocks(els, keys)
    in_figure = (F.col("tag") == "img") & (F.size(around(mark("figure"), mark(".product_info"))) > 0)
    within = els.withColumns({"inSubject": (F.col("tag") == "p") & is_inside(mark(".subject")), "inFigure": in_figure, "scope": F.explode(around(mark(".many_add")))})
    text = lambda test, name: first_of(test, F.col("text"), name)
    subjects = ((F.col("inSubject"), "s1"), ((F.col("tag") == "p") & has_class("subject"), "s2"), (has_class("m_pdt_list_name"), "s3"), (has_class("subject"), "s4"))
    named = within.groupBy(*keys, "scope").agg(
        *[text(t, n) for t, n in subjects], text(has_class("coc_brd_name"), "brand"), text(has_class("icon"), "icon"),
        F.min(F.when((F.col("tag") == "table") & (F.col("id") == "opSelectedList"), F.col("pos"))).alias("table"),
    )
    # images come first, then the other elements in page order
    ids = within.select(*keys, "scope", (~F.col("inFigure")).alias("late"), "pos", F.posexplode(_ids()).alias("k", "id"))
    ids = ids.groupBy(*keys, "scope", "id").agg(F.min(F.struct("late", "pos", "k")).alias("at"))
    listed = ids.groupBy(*keys, "scope").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("explicitProductIds"))
    subject_text = F.coalesce("s1", "s2", "s3", "s4", F.lit(""))
    block = shown.withColumnRenamed("pos", "scope").join(named.hint("merge"), [*keys, "scope"], "left").join(listed.hint("merge"), [*keys, "scope"], "left").select(
        *keys, F.col("scope").alias("block"), "productIndex", "table", subject_text.alias("subjectText"), product_label(subject_text).alias("comparableSubjectText"),
        F.regexp_replace(F.regexp_replace(squash(F.col("brand")), r"^\[", ""), r"\]$", "").alias("brandText"),
        to_number(F.regexp_extract(F.coalesce("icon", F.lit("")), r"([0-9]+)\s*개", 1)).alias("outerBoxQty"),
        F.coalesce("explicitProductIds", F.array().cast("array<string>")).alias("explicitProductIds"),
    )
    block = frozen(block, "blocks")
    wanted = requests.select(*keys, F.col("productId").cast("string").alias("pid"), squash(F.col("productName")).alias("pname"))
    matches = lambda joined, name: joined.groupBy(*keys, "block").agg(F.array_sort(F.collect_set("pid")).alias(name))
    by_id = matches(block.select(*keys, "block", F.explode("explicitProductIds").alias("pid")).join(wanted.hint("merge"), [*keys, "pid"]), "explicitMatchProductIds")
    label = wanted.filter("pname <> ''").select(*keys, "pid", product_label(F.col("pname")).alias("comparableSubjectText"))
    by_name = matches(block.filter("comparableSubjectText <> ''").join(label.hint("merge"), [*keys, "comparableSubjectText"]), "exactNameMatchProductIds")
    counts = wanted.groupBy(*keys).agg(F.count("*").alias("requestedProductCount"), F.min("pid").alias("alone"))
    visible = block.groupBy(*keys).agg(F.count("*").alias("visibleBlockCount"))
    none = F.array().cast("array<string>")
    joined = block.join(by_id.hint("merge"), [*keys, "block"], "left").join(by_name.hint("merge"), [*keys, "block"], "left").join(counts.hint("merge"), keys, "left").join(visible.hint("merge"), keys)
    joined = joined.withColumns({c: F.coalesce(c, none) for c in ("explicitMatchProductIds", "exactNameMatchProductIds")}).withColumn("requestedProductCount", F.coalesce("requestedProductCount", F.lit(0)))
    mode = (
        F.when(F.size("explicitMatchProductIds") == 1, "dom-id").when(F.size("exactNameMatchProductIds") == 1, "exact-name")
        .when((F.col("requestedProductCount") == 1) & (F.col("visibleBlockCount") == 1), "single-block").otherwise("unresolved")
    )
    product = F.when(mode == "dom-id", F.get("explicitMatchProductIds", F.lit(0))).when(mode == "exact-name", F.get("exactNameMatchProductIds", F.lit(0))).when(mode == "single-block", F.col("alone"))
    judged = joined.withColumn("productMatchMode", mode).withColumn("pid", product)
    found = judged.join(wanted.hint("merge"), [*keys, "pid"], "left").select(
        *keys, "block", "productIndex", "table", F.coalesce("pid", F.lit("")).alias("productId"), "productMatchMode", F.coalesce(F.nullif("pname", F.lit("")), "subjectText").alias("productName"),
        "subjectText", "comparableSubjectText", "brandText", "outerBoxQty", "explicitProductIds", "explicitMatchProductIds", "exactNameMatchProductIds", "requestedProductCount", "visibleBlockCount",
    )
    return frozen(found, "block-products")


def popup_rows(els: DataFrame, requests: DataFrame, options: DataFrame, keys: list[str], quantity: int = 1, threshold: int = 10, products: DataFrame | None = None) -> DataFrame:
    """One row per option row of the visible blocks.

    ``products`` is what ``block_products`` gave for the same elements and requests, if it was asked already. ``options`` has the options that requests name: keys, productId, optionId, quantity. Where a
    product has any, only those are selected; where it has none, all that can be. A row is complete
    with its checkbox, its quantity and a filled stock input, and can be selected if it is switched
    on and has stock too.
    """
    products = block_products(els, requests, keys) if products is None else products
    tables = products.filter("table is not null").select(*keys, "block", "table")
    in_table = lambda found: found.select(*keys, "pos", attr("value").alias("value"), F.explode(around(mark("table", "#opSelectedList"))).alias("table"))
    of_block = lambda found: in_table(found).join(tables.hint("merge"), [*keys, "table"]).drop("table")
    group = of_block(els.filter((F.col("tag") == "input") & (F.col("id") == "inIDXPOP"))).groupBy(*keys, "block").agg(F.min_by("value", "pos").alias("cartGroupId"))
    lines = of_block(els.filter((F.col("tag") == "tr") & (F.col("id") == "inOptionTR"))).drop("value")
    lines = lines.withColumn("optionIndex", F.row_number().over(Window.partitionBy(*keys, "block").orderBy("pos")) - 1)
    within = els.withColumn("scope", F.explode(around(mark("tr", "#inOptionTR"))))
    box = lambda test: (F.col("tag") == "input") & test
    value = lambda name: first_of(box(F.col("id") == name), attr("value"), name)
    by_id, by_name = box(F.col("id") == "optionCHKPOP"), box(attr("name") == "optionCHKPOP")
    off = F.map_contains_key("attrs", "disabled")
    read = within.groupBy(*keys, F.col("scope").alias("pos")).agg(
        first_of(by_id, attr("value"), "idValue"), first_of(by_name, attr("value"), "nameValue"), first_of(by_id, off, "idOff"), first_of(by_name, off, "nameOff"),
        first_of((F.col("tag") == "td") & has_class("option_txt"), F.col("text"), "text1"), first_of((F.col("tag") == "td") & (F.col("id") == "tdOption"), F.col("text"), "text2"),
        some(box(F.col("id") == "inOPcount"), "counted"), *[value(n) for n in ("inOPidx", "inOPMaxStock", "inPorderMinus", *NUMBERS.values())],
    )
    option = F.coalesce(F.nullif(squash(F.coalesce("idValue", "nameValue")), F.lit("")), squash(F.col("nameValue")), F.lit(""))
    has = option != ""
    stock, disabled = to_number(F.col("inOPMaxStock")), F.coalesce("idOff", "nameOff", F.lit(False))
    complete = F.coalesce("idValue", "nameValue").isNotNull() & F.col("counted") & F.coalesce(strip(F.col("inOPMaxStock")) != "", F.lit(False))
    rows = lines.join(read.hint("merge"), [*keys, "pos"]).join(products.hint("merge"), [*keys, "block"]).join(group.hint("merge"), [*keys, "block"], "left").select(
        *keys, "productIndex", "optionIndex", "productId", "productMatchMode", "productName", "subjectText", "comparableSubjectText", "brandText", "outerBoxQty", "explicitProductIds",
        "explicitMatchProductIds", "exactNameMatchProductIds", "requestedProductCount", "visibleBlockCount", F.coalesce("cartGroupId", F.lit("")).alias("cartGroupId"),
        F.when(has, option).otherwise("0").alias("optionId"), F.when(has, F.coalesce(first_text(F.col("text1"), F.col("text2")), F.lit(""))).otherwise("").alias("optionText"), has.alias("hasOption"),
        F.coalesce("inOPidx", F.lit("")).alias("submitOptionId"), stock.alias("maxStock"), disabled.alias("disabled"), complete.alias("complete"), (complete & ~disabled & (stock > 0)).alias("selectable"),
        rules.popup_status(stock, F.lit(False), disabled, threshold).alias("stockStatus"), *[to_number(F.col(c)).alias(n) for n, c in NUMBERS.items()], F.coalesce("inPorderMinus", F.lit("")).alias("porderMinus"),
    )
    asked = options.select(*keys, "productId", F.coalesce(F.col("optionId").cast("string"), F.lit("0")).alias("optionId"), F.greatest(F.lit(1).cast("bigint"), F.coalesce(F.col("quantity").cast("bigint"), F.lit(1))).alias("asked"))
    first = asked.groupBy(*keys, "productId", "optionId").agg(F.min("asked").alias("asked"))
    explicit = asked.select(*keys, "productId").distinct().withColumn("explicit", F.lit(True))
    judged = rows.join(explicit.hint("merge"), [*keys, "productId"], "left").join(first.hint("merge"), [*keys, "productId", "optionId"], "left")
    chosen = F.col("selectable") & (F.col("explicit").isNull() | F.col("asked").isNotNull())
    return judged.withColumn("selectedForCart", chosen).withColumn("requestedQty", F.when(chosen, F.coalesce("asked", F.lit(quantity))).otherwise(0).cast("bigint")).drop("explicit", "asked")


def popup_state(products: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, numbers of blocks, tables, option rows, complete and selectable ones, ``usable``) of what ``block_products`` and ``popup_rows`` found.

    A popup that isn't whole yet is usable if every block has its table and every row is complete.
    """
    shown = products.groupBy(*keys).agg(F.count("*").alias("visibleWrapperCount"), F.count("table").alias("optionTableCount"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("optionRowCount"), F.count_if("complete").alias("completeRowCount"), F.count_if("selectable").alias("selectableRowCount"))
    state = shown.join(counts.hint("merge"), keys, "left").fillna(0, ["optionRowCount", "completeRowCount", "selectableRowCount"])
    whole = (F.col("optionTableCount") == F.col("visibleWrapperCount")) & (F.col("optionRowCount") > 0) & (F.col("completeRowCount") == F.col("optionRowCount"))
    return state.withColumn("usable", whole)


def selection_state(requests: DataFrame, checks: DataFrame, buttons: DataFrame) -> DataFrame:
    """(batch, what is amiss with the boxes of the requested products, ``complete``).

    ``requests`` has batch, productId, quantity; ``checks`` the boxes shown: batch, productId, checked,
    disabled, hasCount, countDisabled, count; ``buttons`` batch and whether its button is ready.
    """
    box = checks.groupBy("batch", "productId").agg(
        F.count("*").alias("n"), F.bool_or("checked").alias("checked"), F.bool_or("disabled").alias("disabled"), F.bool_and("hasCount").alias("hasCount"), F.bool_or("countDisabled").alias("countDisabled"), F.min("count").alias("count"),
    )
    wanted = requests.groupBy("batch", "productId").agg(F.max("quantity").alias("quantity")).withColumn("asked", F.lit(True))
    both = wanted.join(box, ["batch", "productId"], "full")
    asked, shown = F.coalesce("asked", F.lit(False)), F.col("n").isNotNull()
    tests = {
        "missing": asked & ~shown, "duplicate": asked & (F.col("n") > 1), "disabled": asked & F.col("disabled"), "withoutCount": asked & shown & ~F.col("hasCount"), "countDisabled": asked & F.col("countDisabled"),
        "unchecked": asked & shown & ~F.col("checked"), "otherQuantity": asked & shown & F.col("hasCount") & (F.coalesce("count", F.lit(-1)) != F.col("quantity")), "unexpected": ~asked & F.col("checked"),
    }
    state = both.groupBy("batch").agg(F.count_if(asked).alias("requested"), *[F.count_if(t).alias(c) for c, t in tests.items()])
    fine = F.col("requested") > 0
    for c in tests:
        fine = fine & (F.col(c) == 0)
    return state.join(buttons.select("batch", "ready"), "batch", "left").withColumn("complete", fine & F.coalesce("ready", F.lit(False))).drop("ready")
