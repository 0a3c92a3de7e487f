"""Cart requests: extraction, validation, merging, joins with what a mall lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.functions.rows import once
from tallyard.functions.text import comparable_name, squash
from tallyard.operators.dedupe import keep_first
from tallyard.sources.shared import frozen

#: Sites by domain suffix; the flag tells whether a request must name an option.
SITES = {"mall-a.example": True, "mall-b.example": False}


def extract_requests(documents: DataFrame, column: str = "json") -> DataFrame:
    """One row per request of JSON documents that are a list or hold one in data, items or data.items."""
    v = F.try_parse_json(F.col(column))
    places = [F.try_variant_get(v, p, "array<variant>") for p in ("$", "$.data", "$.items", "$.data.items")]
    one = F.explode(F.coalesce(*places)).alias("v")
    get = lambda p, t="string": F.try_variant_get("v", f"$.{p}", t).alias(p)
    kept = [c for c in documents.columns if c != column]
    return documents.select(*kept, one).select(*kept, get("site"), get("productId"), get("optionId"), get("quantity", "double"))


def validated(requests: DataFrame, sites: dict[str, bool] = SITES) -> DataFrame:
    """Adds reason (null if the request is good), site as known, and whole quantity."""
    rest = [c for c in requests.columns if c not in ("site", "productId", "optionId", "quantity")]
    quantity = F.when(F.col("quantity") >= 0, F.floor("quantity")).otherwise(F.ceil("quantity")).cast("bigint")
    read = once(requests, rest, {"site": F.lower(squash(F.col("site"))), "productId": squash(F.col("productId")), "optionId": squash(F.col("optionId")), "quantity": quantity})
    site, known, needs_option = F.col("site"), F.lit(None).cast("string"), F.lit(False)
    for domain, must in sites.items():
        fits = (site == domain) | site.endswith(f".{domain}")
        known, needs_option = F.when(fits, F.lit(domain)).otherwise(known), F.when(fits, F.lit(must)).otherwise(needs_option)
    option, whole = F.col("optionId"), F.col("quantity")
    reason = (
        F.when(known.isNull(), "unknown site").when(~F.col("productId").rlike("^[0-9]+$"), "product id")
        .when(needs_option & ~option.rlike("^[0-9]+$"), "option id missing").when(~needs_option & (option != "") & (option != "0"), "option id not allowed")
        .when(whole.isNull() | (whole < 1), "quantity")
    )
    return read.select(*rest, F.coalesce(known, site).alias("site"), "productId", "optionId", "quantity", reason.alias("reason"))


def merged(requests: DataFrame) -> DataFrame:
    """Quantities of the same site, product and option added up."""
    return requests.groupBy("site", "productId", "optionId").agg(F.sum("quantity").alias("quantity"))


def by_product(requests: DataFrame) -> DataFrame:
    """Requests of a product together, quantities 1 at least; options in order of id."""
    item = F.struct(F.col("optionId"), F.greatest("quantity", F.lit(1)).alias("quantity"))
    return requests.groupBy("site", "productId").agg(F.array_sort(F.collect_list(item)).alias("items"))


def by_site(requests: DataFrame) -> DataFrame:
    return requests.groupBy("site").agg(F.count("*").alias("items"), F.sum("quantity").alias("quantity"))


def listed(requests: DataFrame, products: DataFrame, order: str = "ord") -> DataFrame:
    """Requests with the name their product is first listed under, and whether it isn't there."""
    found = keep_first(products.select("productId", "productName", order), ["productId"], [order, "productName"]).drop(order)
    return requests.join(found, "productId", "left").withColumn("missing", F.col("productName").isNull())


def recovered(requests: DataFrame, cart: DataFrame) -> DataFrame:
    """Requests that the cart holds already in full."""
    have = cart.groupBy("productId").agg(F.sum("requestedQty").alias("inCart"))
    joined = requests.join(have, "productId", "left")
    return joined.withColumn("done", F.coalesce((F.col("quantity") < 1) | (F.col("inCart") >= F.col("quantity")), F.lit(False)) & F.col("inCart").isNotNull())


def match_blocks(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """Product of each popup block (blockId, batch, ids, name) among the requests of its batch.

    By id if exactly one requested product has one of the block's ids, else by name if exactly
    one has that name, else the only request of a batch with one block, else none.
    """
    wanted = requests.select("batch", F.col("productId").alias("pid"), comparable_name(F.col("productName")).alias("pname")).distinct()
    block = blocks.select("batch", "blockId", "ids", comparable_name(F.col("name")).alias("bname"))
    only = lambda df, mode: df.groupBy("batch", "blockId").agg(F.count_distinct("pid").alias("n"), F.min("pid").alias(mode)).filter("n = 1").drop("n")
    by_id = only(block.withColumn("pid", F.explode("ids")).join(wanted.select("batch", "pid"), ["batch", "pid"]), "byId")
    # of all products of a name the least and the greatest id tell whether it is one; many blocks and many products of one name don't meet
    named = wanted.groupBy("batch", F.col("pname").alias("bname")).agg(F.min("pid").alias("least"), F.max("pid").alias("most"))
    met = block.filter("bname <> ''").select("batch", "blockId", "bname").join(named, ["batch", "bname"])
    by_name = met.groupBy("batch", "blockId").agg(F.min("least").alias("byName"), F.max("most").alias("most")).filter("byName = most").drop("most")
    single = block.groupBy("batch").agg(F.count("*").alias("blocks")).join(wanted.groupBy("batch").agg(F.count("*").alias("n"), F.min("pid").alias("alone")), "batch").filter("blocks = 1 and n = 1").select("batch", "alone")
    joined = block.select("batch", "blockId").join(by_id, ["batch", "blockId"], "left").join(by_name, ["batch", "blockId"], "left").join(single, "batch", "left")
    mode = F.when(F.col("byId").isNotNull(), "id").when(F.col("byName").isNotNull(), "name").when(F.col("alone").isNotNull(), "single").otherwise("unresolved")
    return joined.select("batch", "blockId", F.coalesce("byId", "byName", "alone").alias("productId"), mode.alias("matchMode"))


def match_diagnostics(rows: DataFrame, order: str = "ord") -> DataFrame:
    """batch, productIndex, optionRowCount and what the block's first row says of its match."""
    first = [F.min_by(c, order).alias(c) for c in ("productId", "productMatchMode")]
    return rows.groupBy("batch", "productIndex").agg(F.count("*").alias("optionRowCount"), *first).withColumn(
        "productMatchMode", F.coalesce(F.nullif("productMatchMode", F.lit("")), F.lit("unresolved"))
    )


def match_mode_counts(diagnostics: DataFrame) -> DataFrame:
    """Blocks and option rows by batch and mode of match."""
    return diagnostics.groupBy("batch", "productMatchMode").agg(F.count("*").alias("blocks"), F.sum("optionRowCount").alias("optionRows"))


#: Grams that patterns are indexed by: of patterns of so many characters or more, the first that fits.
GRAMS = (12, 6, 4, 3, 2, 1)


def contained(texts: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, pattern): which ``patterns`` (keys, pattern) stand in which ``texts`` (keys, at, text) of their keys.

    Each pattern is cut into grams that cover it, and listed under that of them which the fewest different texts
    have. It meets the texts that have that gram by equality of hashes, and what meets is then searched in the texts
    themselves. A pattern with a gram that no text has meets none. No text is compared with all patterns, and
    equal texts of the same keys are cut once.
    """
    size = F.element_at(F.filter(F.array(*[F.lit(g) for g in GRAMS]), lambda g: g <= F.length("pattern")), 1)
    grams = lambda text, places: F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.substring(F.col(text), i, F.col("size")))))
    own = frozen(texts.filter("at is not null").select(*keys, "text").distinct(), "texts")
    wanted = patterns.filter("pattern <> ''").select(*keys, "pattern").withColumn("size", size)
    sizes = wanted.select(*keys, "size").distinct()
    every, last = F.sequence(F.lit(1), F.greatest(F.length("text") - F.col("size") + 1, F.lit(1))), F.length("pattern") - F.col("size") + 1
    spread = own.join(sizes, keys).filter(F.length("text") >= F.col("size")).select(*keys, F.xxhash64("text").alias("t"), F.explode(grams("text", every)).alias("gram"))
    counts = spread.groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    asked = wanted.select(*keys, "pattern", F.explode(grams("pattern", F.array_append(F.sequence(F.lit(1), last, F.col("size")), last))).alias("gram"))
    listed = asked.join(counts, [*keys, "gram"], "left").groupBy(*keys, "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    listed = listed.filter("least.n > 0").select(*keys, "pattern", F.col("least.gram").alias("gram"))
    met = spread.join(listed, [*keys, "gram"]).select(*keys, "t", "pattern")
    return met.join(texts.select(*keys, "at", "text", F.xxhash64("text").alias("t")), [*keys, "t"]).filter(F.col("text").contains(F.col("pattern"))).select(*keys, "at", "pattern")


def sold_out_in_text(messages: DataFrame, requests: DataFrame, ord: str = "ord") -> DataFrame:
    """(batch, ord, productId, found) of the requested products that messages report as sold out.

    ``messages`` has batch, ord, html, text and ``unchecked``, the ids whose boxes are no longer
    checked. A message names a product whose id stands in its html ("id") or whose name, compared
    without brackets and spaces, in its text ("name"). Where it names none and exactly one
    requested id is unchecked that no earlier message of the batch has, it is that ("unchecked").
    Without ``ord`` or ``unchecked`` messages stand for themselves, and nothing is told from boxes.
    """
    at = F.col(ord) if ord in messages.columns else F.monotonically_increasing_id()
    unchecked = F.col("unchecked") if "unchecked" in messages.columns else F.array().cast("array<string>")
    # both are read several times over
    messages = frozen(messages.select("batch", at.alias("at"), "html", comparable_name(F.col("text")).alias("text"), unchecked.alias("unchecked")), "messages")
    wanted = frozen(requests.select("batch", F.col("productId").cast("string").alias("productId"), comparable_name(F.col("productName")).alias("name")).distinct(), "requests")
    ids = contained(messages.select("batch", "at", F.col("html").alias("text")), wanted.select("batch", F.col("productId").alias("pattern")), ["batch"])
    names = contained(messages.select("batch", "at", "text"), wanted.select("batch", F.col("name").alias("pattern")), ["batch"])
    by_id = ids.select("batch", "at", F.col("pattern").alias("productId"), F.lit("id").alias("found"))
    by_name = names.withColumnRenamed("pattern", "name").join(wanted, ["batch", "name"]).select("batch", "at", "productId", F.lit("name").alias("found"))
    named = frozen(by_id.unionByName(by_name).groupBy("batch", "at", "productId").agg(F.min("found").alias("found")), "named")
    gone = messages.select("batch", "at", F.explode("unchecked").alias("productId")).join(wanted.select("batch", "productId").distinct(), ["batch", "productId"], "left_semi")
    new = gone.groupBy("batch", "productId").agg(F.min("at").alias("at"))
    single = new.groupBy("batch", "at").agg(F.count("*").alias("n"), F.min("productId").alias("productId")).filter("n = 1")
    alone = single.join(named, ["batch", "at"], "left_anti").select("batch", "at", "productId", F.lit("unchecked").alias("found"))
    return named.unionByName(alone).withColumnRenamed("at", ord)


def sold_out_products(reports: DataFrame) -> DataFrame:
    """(batch, productId) of the products that any message reports."""
    return reports.select("batch", "productId").distinct()
