"""Backend products from list, inventory, detail and translation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from tallyard.functions import rules
from tallyard.functions.rows import bound, gathered, once
from tallyard.functions.schemas import OPTION, SPECS
from tallyard.functions.text import distinct_texts, first_positive, first_text, not_thumbnail, parse_price, squash, to_price
from tallyard.operators.dedupe import keep_first

# fixed values
PRICE_LABELS = "판매가|총 합계금액|브랜드"
PRICE_WORDS = ("총 상품금액", "상품금액", "판매가", "총 합계금액")
BRAND_WORDS = ("브랜드",)


def field(df: DataFrame, name: str, kind: str) -> Column:
    """A column that may be lacking, as ``kind``; null where it is."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def images(main: Column, detail: Column, existing: Column) -> Column:
    """struct(imageUrls, thumbnailUrl): main, detail and existing images without thumbnails, each once."""
    none = F.array().cast("array<string>")
    every = F.flatten(F.array(*[F.coalesce(c, none) for c in (main, detail, existing)]))
    return bound(F.filter(distinct_texts(every), not_thumbnail), lambda kept: F.struct(kept.alias("imageUrls"), F.coalesce(F.get(kept, F.lit(0)), F.lit("")).alias("thumbnailUrl")))


def spec_rows(rows: Column) -> Column:
    """Specs of rows (labelKo, labelJa, valueKo, valueJa, sortOrder): filled, no prices or brands, first of a label.

    Japanese texts that lack are the Korean ones, a lacking sort order is ten times the place.
    """
    tidy = F.transform(rows, lambda r: F.struct(*[squash(r[c]).alias(c) for c in ("labelKo", "labelJa", "valueKo", "valueJa")], r["sortOrder"].alias("sortOrder")))
    clean = F.filter(tidy, lambda r: (r["labelKo"] != "") & (r["valueKo"] != "") & ~r["labelKo"].rlike(PRICE_LABELS))
    first = bound(clean, lambda found: bound(found["labelKo"], lambda labels: F.filter(found, lambda r, i: F.array_position(labels, r["labelKo"]) == i + 1)))
    return F.transform(
        first, lambda r, i: F.struct(
            r["labelKo"].alias("labelKo"), first_text(r["labelJa"], r["labelKo"]).alias("labelJa"), r["valueKo"].alias("valueKo"),
            first_text(r["valueJa"], r["valueKo"]).alias("valueJa"), F.coalesce(r["sortOrder"], i * 10).cast("int").alias("sortOrder"),
        )
    ).cast(SPECS)


def labelled(*pairs: tuple[Column, Column]) -> Column:
    """Spec rows of (label, value) columns."""
    return F.array(*[
        F.struct(label.alias("labelKo"), F.lit("").alias("labelJa"), value.alias("valueKo"), F.lit("").alias("valueJa"), F.lit(None).cast("int").alias("sortOrder")) for label, value in pairs
    ]).cast(SPECS)


def spec_map(entries: Column) -> Column:
    """Specs of a label to value map."""
    return spec_rows(F.transform(F.map_entries(entries), lambda e: F.struct(e["key"].alias("labelKo"), F.lit("").alias("labelJa"), e["value"].alias("valueKo"), F.lit("").alias("valueJa"), F.lit(None).cast("int").alias("sortOrder"))))


def specs(rows: Column, raw: Column, named: Column | None = None) -> Column:
    """Spec rows if there are any, else those of the raw map, else of the named fields."""
    none = F.array().cast(SPECS)
    last = none if named is None else spec_rows(named)
    mapped = bound(F.coalesce(spec_map(raw), none), lambda m: F.when(F.size(m) > 0, m).otherwise(last))
    return bound(spec_rows(F.coalesce(rows, none)), lambda made: F.when(F.size(made) > 0, made).otherwise(mapped))


def named_specs(details: DataFrame) -> Column:
    """The named fields of a detail row as spec rows."""
    # fixed values
    fields = {
        "origin": "원산지", "manufacturer": "제조사", "material": "소재", "packageSize": "포장 사이즈", "weight": "무게", "certification": "인증", "targetAge": "사용 대상 연령", "warranty": "품질보증기준",
    }
    return labelled(*[(F.lit(label), field(details, name, "string")) for name, label in fields.items()])


def spec_facts(details: DataFrame) -> Column:
    """struct of the four facts that the first mall's products carry in place of specs; null if none is known."""
    # fixed values
    facts = {"material": "material", "packagingSize": "packageSize", "weight": "weight", "countryofOrigin": "origin"}
    known = {name: F.nullif(squash(field(details, c, "string")), F.lit("")) for name, c in facts.items()}
    return F.when(F.coalesce(*known.values()).isNotNull(), F.struct(*[c.alias(name) for name, c in known.items()]))


def original_price(*candidates: Column) -> Column:
    return first_positive(*candidates).cast("decimal(18,4)")


def options(inventory: DataFrame, translated: DataFrame | None = None, order: str = "ord", detail: bool = False) -> DataFrame:
    """productId, options: one option per id of a product, in order of first appearance.

    Rows without an id (or with the id 0) are options of their own, with an empty id. ``name`` is the
    Japanese one; the English one is for general collection, an added price for details.
    """
    raw = squash(F.col("optionId"))
    rows, own = inventory.filter("hasOption"), raw.isin("", "0")
    text = {"optionText": F.col("optionText"), "barcode": field(inventory, "barcode", "string"), "stockStatus": field(inventory, "stockStatus", "string")}
    amounts = {"addPrice": field(inventory, "addPrice", "bigint"), "maxStock": F.col("maxStock").cast("bigint"), "isSoldOut": field(inventory, "isSoldOut", "boolean")}
    row = F.struct(F.col(order).alias("at"), *[c.alias(n) for n, c in (text | amounts).items()])
    # rows without an order are taken only where all are
    ids = once(rows, ["productId"], {"_raw": raw, "_row": F.when(F.col(order).isNotNull(), row)}).filter("_raw not in ('', '0')")
    alone = rows.filter(own).select("productId", raw.alias("_raw"), row.alias("_row"))
    least, names = F.min("_row").alias("_row"), [F.lit("").alias(c) for c in ("_ja", "_en")]
    if translated is None:
        first, alone = ids.groupBy("productId", "_raw").agg(least), alone.select("*", *names)
        first = first.select("*", *names)
    else:
        # rows and names of an option meet in one grouping
        known = once(translated, ["productId"], {"_raw": squash(F.col("optionId")), "_ja": squash(F.col("ja")), "_en": squash(F.col("en"))})
        most = [F.max("_ja").alias("_ja"), F.max("_en").alias("_en")]
        both = ids.withColumn("_seen", F.lit(True)).unionByName(known.filter("_raw not in ('', '0') and productId is not null"), allowMissingColumns=True)
        first = both.groupBy("productId", "_raw").agg(least, *most, F.bool_or("_seen").alias("_seen")).filter("_seen").drop("_seen")
        zero = translated.filter(raw == "0").select("productId", raw.alias("_raw"), squash(F.col("ja")).alias("_ja"), squash(F.col("en")).alias("_en"))
        alone = alone.join(zero.groupBy("productId", "_raw").agg(*most), ["productId", "_raw"], "left")
    first = first.unionByName(alone)
    sold = (F.coalesce("_row.stockStatus", F.lit("")) == rules.OUT) | F.coalesce("_row.isSoldOut", F.lit(False))
    ja, en = F.coalesce("_ja", F.lit("")), F.coalesce("_en", F.lit(""))
    option = F.struct(
        F.when(F.col("_raw") == "0", "").otherwise(F.col("_raw")).alias("id"), F.nullif(squash(F.col("_row.barcode")), F.lit("")).alias("barcode"), ja.alias("name"), squash(F.col("_row.optionText")).alias("nameKo"),
        ja.alias("nameJa"), (F.lit("") if detail else en).alias("nameEn"),
        (F.coalesce("_row.addPrice", F.lit(0)) if detail else F.lit(None)).cast("bigint").alias("additionalPrice"),
        F.col("_row.maxStock").alias("stockQuantity"), rules.sale_status(F.lit(""), sold).alias("status"),
    )
    return first.groupBy("productId").agg(gathered(F.col("_row.at"), option).cast(f"array<{OPTION}>").alias("options"))


def option_stock(made: Column) -> Column:
    """Sum of the known stock of options; null if none is known."""
    known = F.filter(F.transform(made, lambda o: o["stockQuantity"]), lambda q: q.isNotNull())
    return bound(known, lambda k: F.when(F.size(k) > 0, F.aggregate(k, F.lit(0).cast("bigint"), lambda a, q: a + q)))


def stock(inventory: DataFrame, order: str = "ord") -> DataFrame:
    """productId, hasOption, observed, single (the first known stock), statuses, and what the first row says of the product."""
    price, placed = field(inventory, "onePrice", "decimal(18,4)"), F.col(order).isNotNull()
    # the least struct that begins with the order holds that once; min_by would hold it apart from the value, for each value
    first = lambda test, *values: F.min(F.when(placed & test, F.struct(F.col(order).alias("at"), *values)))
    told = [field(inventory, c, kind).alias(c) for c, kind in (("productName", "string"), ("isSoldOut", "boolean"), ("brandHint", "string"), ("categoryHint", "string"))]
    made = inventory.groupBy("productId").agg(
        F.bool_or(F.coalesce("hasOption", F.lit(False))).alias("hasOption"), F.bool_or(F.col("hasOption").isNotNull()).alias("observed"),
        first(F.col("maxStock").isNotNull(), F.col("maxStock").cast("bigint").alias("v"))["v"].alias("single"), F.collect_set("stockStatus").alias("statuses"),
        first(price > 0, price.alias("v"))["v"].alias("onePrice"), first(F.lit(True), *told).alias("_first"),
    )
    return made.select("productId", "hasOption", "observed", "single", "statuses", "onePrice", *[F.col(f"_first.{c}").alias(f"first_{c}") for c in ("productName", "isSoldOut", "brandHint", "categoryHint")])


def _listed(products: DataFrame) -> DataFrame:
    """What a list says of a product, in columns of their own names."""
    flags = [field(products, c, k) for c, k in (("isSoldOut", "boolean"), ("unavailableInCart", "boolean"), ("saleStatus", "string"), ("cartAddable", "boolean"), ("hasAddButton", "boolean"), ("hasCountInput", "boolean"))]
    text = {c: field(products, c, "string").alias(f"p_{c}") for c in ("productName", "brandHint", "categoryHint", "categoryCode", "thumbnailUrl", "imageUrl")}
    lists = {c: field(products, c, "array<string>").alias(f"p_{c}") for c in ("mainImageUrls", "imageUrls")}
    return products.select("productId", F.lit(True).alias("p_found"), rules.unavailable(*flags).alias("p_out"), field(products, "price", "decimal(18,4)").alias("p_price"), *text.values(), *lists.values())


def _detailed(details: DataFrame) -> DataFrame:
    """What a detail page says of a product, in columns of their own names."""
    none = F.array().cast(SPECS)
    rows, raw = field(details, "specRows", SPECS), field(details, "rawDetailSpec", "map<string,string>")
    mapped = F.transform(F.map_entries(raw), lambda e: F.struct(e["key"].alias("labelKo"), e["value"].alias("valueKo")))
    found = lambda words: F.coalesce(rules.detail_spec(F.coalesce(rows, none), list(words)), rules.detail_spec(mapped, list(words)))
    first_mall = F.coalesce(field(details, "sourceMall", "string") == "mall-a", F.lit(False))
    out = F.coalesce(field(details, "isSoldOut", "boolean"), F.lit(False)) | F.coalesce(field(details, "unavailableInCart", "boolean"), F.lit(False)) | (squash(field(details, "saleStatus", "string")) == "SOLD_OUT")
    text = [field(details, c, "string").alias(f"d_{c}") for c in ("productName", "barcode", "categoryDepth1", "categoryDepth2", "categoryDepth3", "brandHint", "thumbnailUrl")]
    lists = [field(details, c, "array<string>").alias(f"d_{c}") for c in ("mainImageUrls", "detailImageUrls", "introImageUrls", "imageUrls")]
    named = to_price(found(PRICE_WORDS))
    price = original_price(field(details, "originalPrice", "decimal(18,4)"), field(details, "salePrice", "decimal(18,4)"), F.col("_named"), field(details, "consumerPrice", "decimal(18,4)"))
    return once(details, details.columns, {"_named": named}).select(
        "productId", *text, *lists, out.alias("d_out"), price.alias("d_price"), found(BRAND_WORDS).alias("d_brandSpec"),
        F.when(first_mall, none).otherwise(specs(rows, raw, named_specs(details))).alias("d_specs"), F.when(first_mall, spec_facts(details)).alias("d_facts"),
    )


def _maps(kind: DataType) -> bool:
    """Whether values of a type have no order, as they hold maps."""
    return isinstance(kind, MapType) or any(_maps(x) for x in ([kind.elementType] if isinstance(kind, ArrayType) else [f.dataType for f in kind] if isinstance(kind, StructType) else []))


def backend_products(
    products: DataFrame, inventory: DataFrame, details: DataFrame | None = None, translations: DataFrame | None = None, mode: str = "general",
    threshold: int = 10, order: str = "ord", translated_options: DataFrame | None = None,
) -> DataFrame:
    """One row per product: of the details in detail mode, else of products and of inventory without product.

    Details give name, barcode, images and specs in either mode; category, brand and price in detail mode
    only. A product that no list has is described by its first inventory row. Details without ``order``
    are taken in the order of all their columns.
    """
    detail = mode == "detail"
    listed = keep_first(products.filter("productId <> ''"), ["productId"], [order])
    rows = inventory.filter("productId <> ''")
    sums = stock(rows, order)
    pages = None if details is None else keep_first(details.filter("productId <> ''"), ["productId"], [order] if order in details.columns else sorted(c for c in details.columns if not _maps(details.schema[c].dataType)))
    if detail and pages is None:
        raise ValueError("detail mode needs a table of details")
    base = listed.select("productId").union(sums.select("productId")).distinct()
    seen = _detailed(pages if pages is not None else listed.select("productId").limit(0))
    out = seen if detail else base.join(seen, "productId", "left")
    out = out.join(_listed(listed), "productId", "left").join(sums, "productId", "left").join(options(rows, translated_options, order, detail), "productId", "left")
    if translations is not None:
        t = keep_first(translations, ["productId"], ["productId"]).select("productId", F.col("nameKo").alias("_tko"), F.col("nameJa").alias("_tja"), F.col("nameEn").alias("_ten"))
        out = out.join(t, "productId", "left")
    else:
        out = out.withColumns({c: F.lit("") for c in ("_tko", "_tja", "_ten")})
    said = lambda c: F.when(F.col("p_found"), F.col(f"p_{c}")).otherwise(F.col(f"first_{c}"))
    unavailable = F.coalesce("p_out", "first_isSoldOut", F.lit(False)) | F.coalesce("d_out", F.lit(False))
    several = F.coalesce("hasOption", F.lit(False))
    none = F.array().cast(f"array<{OPTION}>")
    made = F.when(several, F.coalesce("options", none)).otherwise(none)
    # options of an unavailable product are sold out, whatever their stock
    closed = F.when(unavailable, F.transform(made, lambda o: o.withField("status", F.lit("SOLD_OUT")))).otherwise(made)
    quantity = F.when(several, option_stock(F.col("options"))).otherwise(F.col("single"))
    status = rules.backend_status(quantity, F.coalesce("statuses", F.array().cast("array<string>")), threshold, unavailable)
    main = F.concat(F.coalesce("d_mainImageUrls", F.array().cast("array<string>")), F.array("d_thumbnailUrl"), F.coalesce("p_mainImageUrls", F.array().cast("array<string>")), F.array("p_thumbnailUrl", "p_imageUrl"))
    more = F.concat(F.coalesce("d_detailImageUrls", F.array().cast("array<string>")), F.coalesce("d_introImageUrls", F.array().cast("array<string>")))
    shown = F.concat(F.coalesce("d_imageUrls", F.array().cast("array<string>")), F.coalesce("p_imageUrls", F.array().cast("array<string>")))
    picture = images(main, more, shown)
    brand = squash(F.coalesce(first_text(F.col("d_brandHint"), F.col("d_brandSpec"), said("brandHint")), F.lit("")))
    category = rules.last_category(F.col("d_categoryDepth3"), F.col("d_categoryDepth2"), F.col("d_categoryDepth1"), said("categoryHint"), F.col("p_categoryCode"))
    return out.select(
        F.col("productId").alias("id"), F.coalesce("observed", F.lit(False)).alias("inventoryObserved"), unavailable.alias("inventoryUnavailable"),
        F.nullif(squash(F.col("d_barcode")), F.lit("")).alias("barcode"), F.when(several, "OPTION").otherwise("SINGLE").alias("type"),
        squash(F.coalesce(first_text(F.col("_tko"), F.col("d_productName"), said("productName")), F.lit(""))).alias("nameKo"), squash(F.col("_tja")).alias("nameJa"), squash(F.col("_ten")).alias("nameEn"),
        (category if detail else F.lit("")).alias("categoryId"), (brand if detail else F.lit("")).alias("brandId"),
        (original_price(F.col("d_price"), F.col("onePrice"), F.col("p_price")) if detail else F.lit(None).cast("decimal(18,4)")).alias("originalPrice"),
        quantity.alias("stockQuantity"), F.lit(threshold).alias("lowStockThreshold"), status.alias("stockStatus"), rules.sale_status(status, unavailable).alias("saleStatus"),
        picture["imageUrls"].alias("imageUrls"), picture["thumbnailUrl"].alias("thumbnailUrl"), closed.alias("options"), F.coalesce("d_specs", F.array().cast(SPECS)).alias("specs"), F.col("d_facts").alias("specFacts"),
    )


def translation_input(inventory: DataFrame, products: DataFrame, detail: bool = False, order: str = "ord") -> DataFrame:
    """Inventory rows with their products' names, and products without inventory. The first row of a product names it."""
    place = [order] if order in products.columns else ["_name"]
    names = keep_first(products.select("productId", F.col("productName").alias("_name"), *[c for c in place if c == order]), ["productId"], place).select("productId", "_name")
    rows = inventory.join(names, "productId", "inner" if detail else "left").withColumn("productName", F.coalesce(F.nullif("_name", F.lit("")), "productName")).drop("_name")
    lacking = products.join(inventory.select("productId").distinct(), "productId", "left_anti")
    return rows.unionByName(lacking.select("productId", "productName"), allowMissingColumns=True)


def with_details(details: DataFrame, inventory: DataFrame, summary: DataFrame) -> DataFrame:
    """Details with their products' stock."""
    return details.join(stock(inventory).select("productId", "hasOption", "observed", "single"), "productId", "left").join(summary, "productId", "left")


def live_overlay(parsed: DataFrame, live: DataFrame) -> DataFrame:
    """Parsed details with what the live page showed (salePriceText, brandText, images): price if positive, brand if any, images always."""
    names = {"salePriceText": "_text", "brandText": "_brand", "mainImageUrls": "_main", "introImageUrls": "_intro"}
    joined = parsed.join(live.select("productId", F.lit(True).alias("_seen"), *[F.col(c).alias(n) for c, n in names.items()]), "productId", "left")
    price, brand = parse_price(F.col("_text")), squash(F.col("_brand"))
    shown = {c: F.when(F.col("_seen"), F.col(n)).otherwise(F.col(c)) for c, n in (("mainImageUrls", "_main"), ("introImageUrls", "_intro"))}
    priced = {c: F.when(price > 0, price).otherwise(F.col(c)) for c in ("salePrice", "originalPrice") if c in parsed.columns}
    return joined.withColumns({**priced, **shown, "brandHint": F.coalesce(F.nullif(brand, F.lit("")), "brandHint")}).drop("_seen", *names.values())
