"""Archive options and backend products of detail collection: prices, brands, images, specs and translated options, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.functions.schemas import SPECS
from tallyard.operators import archive, assemble
from tallyard.plans.catalogue import inventory_table, query, read
from tallyard.plans.inputs import inventory_sql, products


def _details(spark, sf_dir):
    """Detail rows of all parts: every third has spec rows, a third a map, a third named fields; those of small size have none of them and no price."""
    i, n, z = F.col("p_partkey"), F.col("p_partkey").cast("string"), F.col("p_size")
    row = lambda label, value, at: F.struct(F.lit(label).alias("labelKo"), F.lit("").alias("labelJa"), value.alias("valueKo"), F.lit("").alias("valueJa"), F.lit(at).cast("int").alias("sortOrder"))
    rows = F.array(row("소재", F.col("p_type"), None), row("판매가", F.concat(z.cast("string"), F.lit(",500원")), None), row("무게", F.lit("  "), None), row("소재", F.lit("again"), 3), row("원산지", F.concat(F.lit("by "), "p_brand"), None))
    return read(spark, sf_dir, "part").select(
        n.alias("productId"), F.concat(F.lit(" "), "p_name", F.lit("  page ")).alias("productName"), F.when(z % 2 == 0, F.lpad(n, 13, "8")).alias("barcode"),
        F.concat(F.lit("a > "), "p_type").alias("categoryDepth2"), F.when(z % 5 == 0, F.col("p_brand")).alias("brandHint"), F.when(z % 7 == 0, F.col("p_retailprice")).alias("salePrice"),
        F.when((z > 3) & (i % 3 == 0), rows).cast(SPECS).alias("specRows"), F.when((z > 3) & (i % 3 == 1), F.create_map(F.lit("브랜드"), F.concat(F.lit("by "), "p_brand"), F.lit("인증"), F.lit("ok"))).alias("rawDetailSpec"),
        F.when((z > 3) & (z % 2 == 1), F.col("p_type")).alias("material"), F.when(z > 3, F.lit("9g")).alias("weight"), F.when(z % 11 == 0, "mall-a").otherwise("mall-b").alias("sourceMall"),
        F.array(F.concat(F.lit("m"), n), F.concat(F.lit("/THUMB/"), n)).alias("mainImageUrls"), F.array(F.concat(F.lit("i"), n), F.concat(F.lit(" m"), n)).alias("introImageUrls"),
    )


def _translated(spark, sf_dir):
    """Names of options in two languages, by product, as often as they are sold; those of odd numbers are not translated yet."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("productId"), F.col("l_suppkey").cast("string").alias("optionId"))
    done = F.col("optionId").cast("bigint") % 2 == 0
    return rows.withColumns({"ja": F.when(done, F.concat(F.lit("ja "), "optionId")), "en": F.when(done, F.concat(F.lit("en "), "optionId"))})


_OPTIONS_SQL = """opt AS (SELECT productId, optionId AS raw, CASE WHEN optionId = '0' THEN '' ELSE optionId END AS id, arg_min(optionText, ord) AS t, arg_min(maxStock, ord) AS q, min(ord) AS o
    FROM inv WHERE hasOption GROUP BY productId, optionId, CASE WHEN optionId = '0' THEN ord END),
  opts AS (SELECT productId, sum(q)::BIGINT AS total, string_agg(id || ':' || CASE WHEN CAST(raw AS BIGINT) % 2 = 0 THEN 'ja ' || raw ELSE '' END || ':' || t || ':' || q || ':' || CASE WHEN q <= 0 THEN 'SOLD_OUT' ELSE 'ON_SALE' END, ',' ORDER BY o) AS options FROM opt GROUP BY productId)"""


@query("detail_products", f"""WITH inv AS ({inventory_sql(shift=15)}), {_OPTIONS_SQL},
  price AS (SELECT productId, arg_min(onePrice, ord) AS one FROM inv WHERE onePrice > 0 GROUP BY productId),
  kind AS (SELECT productId, bool_or(hasOption) AS several, arg_min(maxStock, ord) AS single FROM inv GROUP BY productId)
  SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN several THEN 'OPTION' ELSE 'SINGLE' END AS type, CASE WHEN p_size % 2 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 13, '8') END AS barcode, trim(p_name) || ' page' AS nameKo, p_type AS categoryId,
    CASE WHEN p_size % 5 = 0 THEN p_brand WHEN p_size > 3 AND p_partkey % 3 = 1 THEN 'by ' || p_brand ELSE '' END AS brandId,
    CAST(CASE WHEN p_size % 7 = 0 THEN p_retailprice WHEN p_size > 3 AND p_partkey % 3 = 0 THEN p_size * 1000 + 500 WHEN one IS NOT NULL THEN one ELSE round(p_retailprice * 10) END AS DECIMAL(18,4)) AS originalPrice,
    CASE WHEN several THEN total ELSE single END AS stockQuantity, 'm' || p_partkey || ',i' || p_partkey AS images, 'm' || p_partkey AS thumbnailUrl,
    CASE WHEN several THEN CASE WHEN p_size <= 5 THEN regexp_replace(options, ':ON_SALE', ':SOLD_OUT', 'g') ELSE options END ELSE '' END AS options,
    CASE WHEN p_size % 11 = 0 OR p_size <= 3 THEN '' WHEN p_partkey % 3 = 0 THEN '소재=' || p_type || '@0,원산지=' || 'by ' || p_brand || '@10' WHEN p_partkey % 3 = 1 THEN '인증=ok@0'
      WHEN p_size % 2 = 1 THEN '소재=' || p_type || '@0,무게=9g@10' ELSE '무게=9g@0' END AS specs,
    CASE WHEN p_size % 11 = 0 THEN concat_ws('/', CASE WHEN p_size % 2 = 1 THEN p_type END, '9g') END AS facts
  FROM part LEFT JOIN kind ON kind.productId = CAST(p_partkey AS VARCHAR) LEFT JOIN opts USING (productId) LEFT JOIN price USING (productId)""")
def detail_products(spark, sf_dir):
    rows = inventory_table(spark, sf_dir, shift=15).withColumn("productName", F.lit(""))
    made = assemble.backend_products(products(spark, sf_dir), rows, _details(spark, sf_dir), mode="detail", translated_options=_translated(spark, sf_dir))
    option = lambda o: F.concat_ws(":", o["id"], o["nameJa"], o["nameKo"], o["stockQuantity"].cast("string"), o["status"])
    spec = lambda s: F.concat(s["labelKo"], F.lit("="), s["valueJa"], F.lit("@"), s["sortOrder"].cast("string"))
    return made.select(
        "id", "type", "barcode", "nameKo", "categoryId", "brandId", "originalPrice", "stockQuantity", F.array_join("imageUrls", ",").alias("images"), "thumbnailUrl",
        F.array_join(F.transform("options", option), ",").alias("options"), F.array_join(F.transform("specs", spec), ",").alias("specs"),
        F.when(F.col("specFacts").isNotNull(), F.concat_ws("/", "specFacts.material", "specFacts.packagingSize", "specFacts.weight", "specFacts.countryofOrigin")).alias("facts"),
    )


def _with_options(part, options):
    """Products with options of (id, Korean name, stock)."""
    made = [F.named_struct(F.lit("id"), F.lit(i), F.lit("nameKo"), name, F.lit("stockQuantity"), stock.cast("bigint"), F.lit("status"), F.lit("ON_SALE")) for i, name, stock in options]
    full = lambda o: F.struct(
        o["id"].alias("id"), F.lit(None).cast("string").alias("barcode"), F.lit("").alias("name"), o["nameKo"].alias("nameKo"), F.lit("").alias("nameJa"), F.lit("").alias("nameEn"),
        F.lit(None).cast("bigint").alias("additionalPrice"), o["stockQuantity"].alias("stockQuantity"), o["status"].alias("status"),
    )
    return part.select(F.col("p_partkey").cast("string").alias("id"), "p_size", F.col("p_name").alias("nameKo"), F.lit("OPTION").alias("type"), F.transform(F.array(*made), full).alias("options"))


@query("archive_options", """SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size > 12 AND p_size % 7 = 0 THEN 'SINGLE' ELSE 'OPTION' END AS type,
    CASE WHEN p_size <= 12 THEN '2:old:5,10:' || p_name || ':' || p_size WHEN p_size % 7 = 0 THEN '' WHEN p_size > 40 THEN '2:' || CASE WHEN p_size % 2 = 0 THEN 'new' ELSE '' END || ':' || p_size || ',3:more:1'
      ELSE '2:' || CASE WHEN p_size % 2 = 0 THEN 'new' ELSE 'old' END || ':' || p_size || ',3:more:1,10:' || p_name || ':' || p_size END AS options,
    CASE WHEN p_size <= 12 OR p_size % 7 = 0 THEN 0 WHEN p_size > 40 THEN 2 ELSE 1 END AS newOptions, CASE WHEN p_size <= 12 OR p_size > 40 OR p_size % 7 = 0 THEN 0 ELSE 1 END AS updatedOptions FROM part""")
def archive_options(spark, sf_dir):
    part, z = read(spark, sf_dir, "part"), F.col("p_size")
    stored = _with_options(part.filter("p_size <= 40"), [("10", F.col("p_name"), z), ("2", F.lit("old"), F.lit(5))])
    seen = _with_options(part.filter("p_size > 12"), [("2", F.when(z % 2 == 0, "new").otherwise(""), z), ("3", F.lit("more"), F.lit(1))])
    single = F.col("p_size") % 7 == 0
    seen = seen.withColumns({"options": F.when(~single, F.col("options")), "type": F.when(single, "SINGLE").otherwise("OPTION"), "inventoryObserved": F.lit(True)})
    option = lambda o: F.concat_ws(":", o["id"], o["nameKo"], o["stockQuantity"].cast("string"))
    merged = archive.merge(stored, seen, "general")
    return merged.select("id", "type", F.array_join(F.transform("options", option), ",").alias("options"), "newOptions", "updatedOptions")
