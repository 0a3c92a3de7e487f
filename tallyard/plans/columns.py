"""Registered queries of column functions and small operators that no catalogue query uses, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.functions import rules, text
from tallyard.operators import cart, coverage, fx, health, translation
from tallyard.plans.catalogue import query, read


@query("clamped_integers", """SELECT event_id, CASE WHEN try_cast(s AS DOUBLE) IS NULL THEN 7 ELSE greatest(trunc(try_cast(s AS DOUBLE))::BIGINT, 0) END AS whole, least(greatest(event_id, 5), 80) AS clamped
  FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'abc' WHEN 1 THEN event_id || '.7' WHEN 2 THEN '-3' END AS s FROM events)""")
def clamped_integers(spark, sf_dir):
    i = F.col("event_id")
    s = F.when(i % 4 == 0, "abc").when(i % 4 == 1, F.concat(i.cast("string"), F.lit(".7"))).when(i % 4 == 2, "-3")
    return read(spark, sf_dir, "events").select("event_id", text.to_integer(s, 7).alias("whole"), text.clamp(i, 5, 80).alias("clamped"))


@query("absolute_urls", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'https://cdn.example.com/a' || page_id || '.png' WHEN 3 THEN 'https://shop.example/img/THUMB/' || page_id
    WHEN 4 THEN 'https://shop.example/x' || page_id || '.jpg?a=../b' ELSE 'http://h.example/' || page_id END AS url, page_id % 6 <> 3 AS full FROM pages""")
def absolute_urls(spark, sf_dir):
    i, n = F.col("page_id"), F.col("page_id").cast("string")
    raw = (
        F.when(i % 6 == 0, " ").when(i % 6 == 1, "DATA:image/png;base64,x").when(i % 6 == 2, F.concat(F.lit("//cdn.example.com/a"), n, F.lit(".png")))
        .when(i % 6 == 3, F.concat(F.lit("/img/THUMB/"), n)).when(i % 6 == 4, F.concat(F.lit("a/b/c/d/e/f/../../../../../../../x"), n, F.lit(".jpg?a=../b")))
        .otherwise(F.concat(F.lit("http://h.example/"), n))
    )
    url = text.absolute_url(raw, "https", "shop.example", "/goods/")
    return read(spark, sf_dir, "pages").select("page_id", url.alias("url"), text.not_thumbnail(url).alias("full"))


@query("distinct_texts", "SELECT p_partkey, CASE WHEN p_type = p_brand THEN p_type ELSE p_type || '|' || p_brand END AS texts FROM (SELECT p_partkey, trim(p_type) AS p_type, trim(p_brand) AS p_brand FROM part)")
def distinct_texts(spark, sf_dir):
    items = F.array("p_type", F.concat(F.lit("  "), "p_type", F.lit(" ")), F.lit(" "), F.col("p_brand"), F.col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.distinct_texts(items), "|").alias("texts"))


@query("numbers_in_texts", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS boxQty, CASE WHEN p_size % 2 = 0 THEN '8801234' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS barcode,
  (100 + p_partkey) || ',' || (5000 + p_size) AS ids, p_name AS name FROM part""")
def numbers_in_texts(spark, sf_dir):
    part, n, z = read(spark, sf_dir, "part"), F.col("p_partkey").cast("string"), F.col("p_size")
    box = F.concat(F.lit("box of "), z.cast("string"), F.when(z % 3 == 0, " pieces").otherwise(" eA"))
    code = F.concat(F.lit("상품번호 [ "), n, F.lit(" ] 8801234"), F.lpad(n, 6, "0"), F.when(z % 2 == 0, " x").otherwise("9"))
    message = F.concat(F.lit("상품 "), (F.col("p_partkey") + 100).cast("string"), F.lit(", 상품 12, 상품"), (z + 5000).cast("string"))
    return part.select(
        "p_partkey", text.outer_box_quantity(box).alias("boxQty"), text.barcode_after_number(code).alias("barcode"),
        F.array_join(text.ids_in_message(message), ",").alias("ids"), text.product_name(F.concat(F.lit(" "), "p_name", F.lit("  바로가기 "))).alias("name"),
    )


@query("same_list_urls", "SELECT page_id, page_id % 3 = page_id % 2 AND page_id % 5 <> 0 AS same FROM pages")
def same_list_urls(spark, sf_dir):
    i = F.col("page_id")
    a = F.concat(F.lit("https://www.example.com/list?cate=5&page="), (i % 3).cast("string"))
    b = F.concat(F.lit("http://example.com/"), F.when(i % 5 == 0, "other").otherwise("list"), F.lit("?x=1&page="), (i % 2).cast("string"), F.lit("&cate=5"))
    return read(spark, sf_dir, "pages").select("page_id", text.same_list_url(a, b).alias("same"))


@query("progress_texts", """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 5 ELSE least(greatest(floor(p_size * 100 / (p_size % 7 * 10.0)), 5), 98) END::INTEGER AS percent,
  CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_size || '~' || (p_size + p_size % 4) END AS pages,
  floor(least(1000.0 * pow(2.0, p_size % 7), 20000.0) * (0.85 + 0.3 * (p_partkey % 11 / 10.0)) + 0.5)::BIGINT AS delay FROM part""")
def progress_texts(spark, sf_dir):
    z = F.col("p_size")
    delay = text.retry_delay(z % 7 + 1, 1000, 20_000, F.col("p_partkey") % 11 / 10)
    return read(spark, sf_dir, "part").select(
        "p_partkey", text.progress_percent(z, z % 7 * 10).alias("percent"), text.page_range_text(z, z + z % 4).alias("pages"), delay.cast("long").alias("delay")
    )


@query("next_daily_runs", """SELECT event_id, CASE WHEN d > ts THEN d ELSE d + INTERVAL 1 DAY END AS next FROM (SELECT event_id, ts, date_trunc('day', ts) + INTERVAL 390 MINUTE AS d FROM events)""")
def next_daily_runs(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", text.next_daily_run(F.col("ts"), 6, 30).alias("next"))


@query("spec_values", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'Korea' END AS origin, CASE WHEN p_size % 3 = 0 THEN p_type END AS picked FROM part""")
def spec_values(spark, sf_dir):
    z, row = F.col("p_size"), lambda label, value: F.struct(F.lit(label).alias("labelKo"), value.alias("valueKo"))
    rows = F.array(row("제조국", F.lit("Korea")), row("원산지(1)", F.when(z % 2 == 0, F.col("p_brand")).otherwise(" ")), row("상품 원산지", F.lit("of a later row")))
    entry = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    entries = F.array(entry(F.lit("size"), F.col("p_name")), entry(F.when(z % 3 == 0, "kind of it").otherwise("none"), F.col("p_type")))
    return read(spark, sf_dir, "part").select("p_partkey", rules.detail_spec(rows, ["원산지", "제조국"]).alias("origin"), text.pick_by_words(entries, ["type", "kind"]).alias("picked"))


@query("popup_states", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'DISABLED' WHEN p_size - 9 <= 0 THEN 'OUT_OF_STOCK' WHEN p_size - 9 <= 10 THEN 'LOW_STOCK' WHEN p_size % 2 = 0 THEN 'LIMITED' ELSE 'IN_STOCK' END AS status,
  CAST(p_partkey AS VARCHAR) || '::' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '0' END AS key FROM part""")
def popup_states(spark, sf_dir):
    z = F.col("p_size")
    status = rules.popup_status(z - 9, z % 2 == 0, z % 5 == 0, 10)
    key = text.coverage_key(F.col("p_partkey").cast("string"), F.concat(F.lit(" "), "p_type"), z % 2 == 0)
    return read(spark, sf_dir, "part").select("p_partkey", status.alias("status"), key.alias("key"))


@query("listed_requests", """SELECT o_orderkey, p_name AS productName, p_name IS NULL AS missing FROM orders LEFT JOIN part ON p_partkey = o_custkey""")
def listed_requests(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("productId"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("productId"), F.col("p_name").alias("productName"), F.lit(1).alias("ord"))
    again = part.withColumn("productName", F.lit("zz later")).withColumn("ord", F.lit(2))
    return cart.listed(orders, part.unionByName(again), "ord").select("o_orderkey", "productName", "missing")


@query("recovered_requests", """SELECT p_partkey, n IS NOT NULL AND (p_size % 4 < 1 OR n >= p_size % 4) AS done FROM part LEFT JOIN (SELECT l_partkey, sum(l_linenumber) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey""")
def recovered_requests(spark, sf_dir):
    requests = read(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("productId"), (F.col("p_size") % 4).alias("quantity"))
    held = read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("productId"), F.col("l_linenumber").alias("requestedQty"))
    return cart.recovered(requests, held).select("p_partkey", "done")


@query("excludable_batches", """SELECT p_partkey, p_size % 4 > 0 AND p_size % 4 <= 2 AND p_size % 3 = 0 AS excludable FROM part""")
def excludable_batches(spark, sf_dir):
    z = F.col("p_size")
    ids = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), z % 4)
    disabled = F.array(*[F.lit(x) for x in ("a", "b", "d")])
    blocks = read(spark, sf_dir, "part").select("p_partkey", ids.alias("unresolved"), disabled.alias("disabled"), (z % 3).alias("otherProblems"))
    return coverage.excludable(blocks).select("p_partkey", "excludable")


@query("dated_prices", """SELECT o_orderkey, CASE WHEN o_totalprice >= 0 THEN floor(o_totalprice * r + 0.5)::BIGINT END AS yenPrice FROM orders
  LEFT JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, (day(o_orderdate) % 8) / 8.0::DOUBLE AS r FROM orders WHERE day(o_orderdate) > 3) ON d = CAST(o_orderdate AS DATE)""")
def dated_prices(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("date"))
    rates = orders.select("date").distinct().filter(F.dayofmonth("date") > 3).withColumn("rate", F.dayofmonth("date") % 8 / 8)
    return fx.convert_dated(orders, rates).select("o_orderkey", "yenPrice")


@query("wave_counts", "SELECT p_size AS wave, count(*) AS products, sum(p_partkey % 3)::BIGINT AS options FROM part GROUP BY 1")
def wave_counts(spark, sf_dir):
    options = F.slice(F.array(F.lit("x"), F.lit("y")), F.lit(1), (F.col("p_partkey") % 3).cast("int"))
    return translation.wave_counts(read(spark, sf_dir, "part").select(F.col("p_size").alias("wave"), options.alias("options")))


@query("first_conflicts", """SELECT l_orderkey, l_linenumber FROM (SELECT *, first_value(l_returnflag) OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber * 10000000 + l_partkey) AS first FROM lineitem) WHERE l_returnflag <> first""")
def first_conflicts(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_orderkey").alias("productId"), F.col("l_linestatus").alias("optionId"), F.col("l_returnflag").alias("optionText"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("ord")
    )
    return translation.first_conflict(rows).select("l_orderkey", "l_linenumber")


@query("run_summaries", """SELECT 4 AS pages, 2 AS keptPages, 'duplicate-page' AS stopReason, (SELECT count(DISTINCT p_brand) FROM part) AS products,
  (SELECT count(DISTINCT p_brand) FROM part WHERE p_size % 7 = 0 OR p_size = 1) AS soldOut, false AS countMatched""")
def run_summaries(spark, sf_dir):
    pages = spark.createDataFrame([("kept",), ("kept",), ("duplicate-page",), ("after-stop",)], "status string")
    z = F.col("p_size")
    products = read(spark, sf_dir, "part").select(F.col("p_brand").alias("productId"), (z % 7 == 0).alias("isSoldOut"), F.when(z == 1, True).alias("unavailableInCart"))
    return health.run_summary(pages, products, -1, True)


@query("elapsed_runs", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id * 1000 WHEN 1 THEN user_id ELSE 5 END AS ms FROM events""")
def elapsed_runs(spark, sf_dir):
    i = F.col("event_id")
    runs = read(spark, sf_dir, "events").select(
        "event_id", F.when(i % 3 == 0, "running").otherwise("completed").alias("status"), F.col("ts").cast("timestamp").alias("startedAt"),
        F.when(i % 3 != 2, F.col("user_id")).alias("progressMs"), F.lit(5).cast("long").alias("summaryMs"),
    )
    now = F.timestamp_millis(F.unix_millis("startedAt") + F.col("event_id") * 1000)
    return runs.select("event_id", health.elapsed(now).alias("ms"))


# --- the built-in lists -----------------------------------------------------

_WORDS = [w for _, words in rules.CATEGORIES for w in words]


def _listed_sql() -> str:
    brand = " ".join(f"WHEN contains(nm, '{b}') THEN '{b}'" for b in rules.BRANDS)
    category = " ".join(f"WHEN {' OR '.join(f'contains(lower(nm), {w.lower()!r})' for w in words)} THEN '{c}'" for c, words in rules.CATEGORIES)
    names = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return f"""WITH n AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name WHEN p_size % 5 = 1 THEN '[ ' || p_brand || '] ' || {names(rules.BRANDS)}[p_partkey % {len(rules.BRANDS)} + 1]
      ELSE {names(rules.BRANDS)}[p_partkey % {len(rules.BRANDS)} + 1] || ' ' || {names(rules.BRANDS)}[p_partkey // 3 % {len(rules.BRANDS)} + 1] END || CASE WHEN p_size % 4 > 0 THEN ' ' || {names(_WORDS)}[p_partkey % {len(_WORDS)} + 1] || {names(_WORDS)}[p_partkey // 7 % {len(_WORDS)} + 1] ELSE '' END AS nm, p_size, p_brand FROM part)
      SELECT p_partkey, CASE WHEN p_size % 5 = 1 THEN p_brand ELSE CASE {brand} ELSE '' END END AS brand, CASE {category} ELSE '{rules.NO_CATEGORY}' END AS category FROM n"""


@query("listed_brands", _listed_sql())
def listed_brands(spark, sf_dir):
    n, k = F.col("p_size"), F.col("p_partkey")
    pick = lambda words, i: F.get(F.array(*[F.lit(w) for w in words]), (i % len(words)).cast("int"))
    head = F.when(n % 5 == 0, F.col("p_name")).when(n % 5 == 1, F.concat(F.lit("[ "), "p_brand", F.lit("] "), pick(rules.BRANDS, k))).otherwise(F.concat_ws(" ", pick(rules.BRANDS, k), pick(rules.BRANDS, F.floor(k / 3))))
    name = F.concat(head, F.when(n % 4 > 0, F.concat(F.lit(" "), pick(_WORDS, k), pick(_WORDS, F.floor(k / 7)))).otherwise(""))
    return read(spark, sf_dir, "part").select("p_partkey", rules.infer_brand(name).alias("brand"), rules.infer_category(name).alias("category"))
