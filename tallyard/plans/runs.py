"""Registered queries of run settings, run texts, details checks and histories, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.functions import text
from tallyard.operators import assemble, cart, exclusions, fx, health, settings, shipping
from tallyard.plans.catalogue import inventory_table, query, read
from tallyard.plans.inputs import inventory_sql
from tallyard.sources import elements


def _requests(spark, sf_dir):
    """One request per part: some name a mall, a list url, numbers that are none, too many pages."""
    z, s = F.col("p_size"), F.col("p_size").cast("string")
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.when(z % 4 == 0, " Mall-B ").when(z % 4 == 1, "MALL-A").when(z % 4 == 2, "mall-z").alias("mall"),
        F.when(z % 5 == 0, "https://shop.example/list?cateIDX=7&cateCd=8").when(z % 5 == 1, F.concat(F.lit(" "), s)).when(z % 5 == 2, "https://shop.example/list?x=1").alias("category"),
        s.alias("pageStart"), F.when(z % 3 == 0, (z + 2).cast("string")).when(z % 3 == 1, "4").alias("pageEnd"), F.when(z % 2 == 0, "100").otherwise(" ").alias("pageSize"),
        F.when(z % 2 == 1, "yes").alias("clearCartAfter"), F.lit("30").alias("maxSafePages"), F.lit("-5").alias("cartQty"), F.lit("x").alias("lowStockThreshold"),
        F.lit("secret").alias("accountPw"), F.when(z % 2 == 0, "http://proxy.example").alias("proxy"),
    )


@query("run_settings", """SELECT p_partkey, m AS mall, CASE WHEN m = 'mall-z' THEN NULL WHEN p_size % 5 = 0 THEN CASE WHEN m = 'mall-b' THEN '8' ELSE '7' END WHEN p_size % 5 = 1 THEN CAST(p_size AS VARCHAR) ELSE CASE WHEN m = 'mall-b' THEN '017' ELSE '-1' END END AS category,
    'detail' AS collectionMode, p_size::BIGINT AS pageStart, e AS pageEnd, CASE WHEN m = 'mall-b' THEN 40 WHEN p_size % 2 = 0 THEN 100 ELSE 60 END::BIGINT AS pageSize, 1::BIGINT AS cartQty, 10::BIGINT AS lowStockThreshold,
    p_size % 2 = 1 AS clearCartAfter, true AS clearCartBefore, CASE WHEN m = 'mall-b' THEN 5 ELSE 3 END::BIGINT AS detailConcurrency, p_size % 2 = 0 AS proxyEnabled,
    CASE WHEN m = 'mall-z' THEN 'unknown mall' WHEN e > 0 AND e < p_size THEN 'last page before the first' WHEN e > 30 THEN 'too many pages' END AS error
  FROM (SELECT *, CASE p_size % 4 WHEN 0 THEN 'mall-b' WHEN 2 THEN 'mall-z' ELSE 'mall-a' END AS m, CASE p_size % 3 WHEN 0 THEN p_size + 2 WHEN 1 THEN 4 ELSE 0 END::BIGINT AS e FROM part)""")
def run_settings(spark, sf_dir):
    resolved = settings.resolve(_requests(spark, sf_dir), {"pageSize": "60", "collectionMode": "Detail ", "optionCartQty": " "})
    # what may be shown, beside the keys of the request
    shown = settings.shown(resolved).columns
    assert not {"accountPw", "proxy"} & set(shown)
    wanted = ["mall", "category", "collectionMode", "pageStart", "pageEnd", "pageSize", "cartQty", "lowStockThreshold", "clearCartAfter", "clearCartBefore", "detailConcurrency"]
    return resolved.select("p_partkey", *wanted, F.col("proxy").isNotNull().alias("proxyEnabled"), F.col("settingsError").alias("error"))


@query("shown_settings", """SELECT CASE p_size % 4 WHEN 0 THEN 'mall-b' WHEN 2 THEN 'mall-z' ELSE 'mall-a' END AS mall, p_size::BIGINT AS pageStart, 999::BIGINT AS optionCartQty, p_size % 2 = 0 AS proxyEnabled FROM part""")
def shown_settings(spark, sf_dir):
    return settings.shown(settings.resolve(_requests(spark, sf_dir), {"optionCartQty": "999"})).select("mall", "pageStart", "optionCartQty", "proxyEnabled")


@query("reason_messages", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '요청 수량이 재고를 초과' WHEN 1 THEN '옵션 구매 불가' ELSE '장바구니 담기 처리에서 예외 발생' END AS message FROM events""")
def reason_messages(spark, sf_dir):
    i = F.col("event_id")
    code = F.when(i % 4 == 0, "QUANTITY_EXCEEDS_STOCK").when(i % 4 == 1, "OPTION_NOT_PURCHASABLE").when(i % 4 == 2, "ELSE")
    return read(spark, sf_dir, "events").select("event_id", exclusions.reason_message(code).alias("message"))


@query("reason_summary", """WITH r AS (SELECT event_type AS code, user_id, event_id FROM events), c AS (SELECT code, count(*) AS n, min(event_id) AS pos FROM r GROUP BY code),
  s AS (SELECT code, string_agg(CAST(user_id AS VARCHAR), ', ' ORDER BY k) AS ids FROM (SELECT code, user_id, row_number() OVER (PARTITION BY code ORDER BY min(event_id), user_id) AS k FROM r GROUP BY code, user_id) WHERE k <= 3 GROUP BY code)
  SELECT string_agg(upper(code) || ' ' || n || '건 (' || ids || ')', '; ' ORDER BY n DESC, pos) AS text FROM c JOIN s USING (code)""")
def reason_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("reasonCode"), F.upper("event_type").alias("reason"), F.col("user_id").alias("productId"), F.col("event_id").alias("ord"))
    return exclusions.reason_text(exclusions.reason_stats(rows))


@query("match_modes", """SELECT batch, mode AS productMatchMode, count(*) AS blocks, sum(n)::BIGINT AS optionRows FROM (
    SELECT l_orderkey % 7 AS batch, l_partkey, count(*) AS n, arg_min(CASE WHEN l_suppkey % 3 = 0 THEN 'id' WHEN l_suppkey % 3 = 1 THEN 'name' ELSE 'unresolved' END, l_orderkey * 1000000000 + l_linenumber * 100000000 + l_suppkey) AS mode FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def match_modes(spark, sf_dir):
    mode = F.when(F.col("l_suppkey") % 3 == 0, "id").when(F.col("l_suppkey") % 3 == 1, "name").otherwise("")
    rows = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 7).alias("batch"), F.col("l_partkey").alias("productIndex"), F.col("l_partkey").cast("string").alias("productId"), mode.alias("productMatchMode"),
        (F.col("l_orderkey") * 1_000_000_000 + F.col("l_linenumber") * 100_000_000 + F.col("l_suppkey")).alias("ord"),
    )
    return cart.match_mode_counts(cart.match_diagnostics(rows))


@query("history_entries", """SELECT row_number() OVER (ORDER BY date)::INTEGER - 1 AS ord, date, rate, rate * 2 AS revRate FROM (
    SELECT strftime(ts, '%y%m%d') AS date, arg_max(floor(value), row(CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, event_id)) AS rate FROM events GROUP BY ALL)""")
def history_entries(spark, sf_dir):
    whole = F.floor("value").cast("double")
    e = read(spark, sf_dir, "events").select(F.date_format("ts", "yyMMdd").alias("date"), whole.alias("rate"), (whole * 2).alias("revRate"), F.col("event_id").alias("ord"))
    history = fx.update_history(e.filter("ord % 10 <> 0"), e.filter("ord % 10 = 0"))
    stored = fx.history_document(history).unionByName(spark.createDataFrame([(" ",)], "json string"))
    return fx.stored_history(stored.withColumn("json", F.concat(F.lit("﻿"), "json")))


@query("run_metrics", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN format('{:,}', p_partkey * 1234) ELSE format('{:,}', p_size) END AS detected, '-' AS collected, CASE WHEN p_size % 3 = 0 THEN '1,000.5' WHEN p_size % 3 = 1 THEN '7' ELSE '-' END AS inventory,
    CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 5 = 0 THEN '12' ELSE '0' END END AS excluded FROM part""")
def run_metrics(spark, sf_dir):
    z, none = F.col("p_size"), F.lit(None).cast("double")
    names = ["collectedProductCount", "targetProductCount", "soldOutProductCount"]
    summary = F.struct(
        F.when(z % 2 == 0, F.col("p_partkey") * 1234).alias("detectedTotalProductCount"), none.alias("inventoryRowCount"), F.when(z % 3 < 2, 7.0).alias("productSummaryCount"),
        F.when(z % 5 == 0, 12).alias("excludedProductCount"), *[none.alias(n) for n in names],
    )
    progress = F.struct(
        z.cast("bigint").alias("detectedTotalProductCount"), F.when(z % 3 == 0, 1000.5).alias("inventoryRowCount"), none.alias("productSummaryCount"),
        F.lit(None).cast("int").alias("excludedProductCount"), *[none.alias(n) for n in names],
    )
    runs = read(spark, sf_dir, "part").select("p_partkey", F.when(z % 2 == 0, "mall-a").otherwise("mall-b").alias("mall"), summary.alias("summary"), progress.alias("progress"))
    return health.metrics(runs).select("p_partkey", "detected", "collected", "inventory", "excluded")


@query("display_numbers", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '-' WHEN 1 THEN format('{:,}', event_id * 1000003) ELSE format('{:,}', -event_id) || '.25' END AS shown FROM events""")
def display_numbers(spark, sf_dir):
    i = F.col("event_id")
    value = F.when(i % 3 == 1, i * 1_000_003).when(i % 3 == 2, -i - 0.25)
    return read(spark, sf_dir, "events").select("event_id", text.display_number(value).alias("shown"))


@query("live_details", """SELECT CAST(p_partkey AS VARCHAR) AS productId, CASE WHEN p_size % 3 = 0 THEN p_size * 1000 + 500 ELSE 77 END::BIGINT AS salePrice, CASE WHEN p_size % 3 = 0 THEN p_size * 1000 + 500 ELSE 99 END::BIGINT AS originalPrice,
    CASE WHEN p_size % 2 = 0 AND p_size > 4 THEN p_brand ELSE 'parsed' END AS brand, CASE WHEN p_size > 4 THEN 'live' ELSE 'parsed' END AS main, CASE WHEN p_size > 4 THEN '' ELSE 'parsed' END AS intro FROM part WHERE p_size > 4 OR p_size % 3 <> 0
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 77, 99, 'parsed', 'parsed', 'parsed' FROM part WHERE p_size <= 4 AND p_size % 3 = 0""")
def live_details(spark, sf_dir):
    part, z = read(spark, sf_dir, "part"), F.col("p_size")
    own = F.array(F.lit("parsed"))
    parsed = part.select(
        F.col("p_partkey").cast("string").alias("productId"), F.lit(77).cast("bigint").alias("salePrice"), F.lit(99).cast("bigint").alias("originalPrice"), F.lit("parsed").alias("brandHint"),
        own.alias("mainImageUrls"), own.alias("introImageUrls"),
    )
    live = part.filter("p_size > 4").select(
        F.col("p_partkey").cast("string").alias("productId"), F.when(z % 3 == 0, F.concat(z.cast("string"), F.lit(",500원"))).when(z % 3 == 1, "sold out").alias("salePriceText"),
        F.when(z % 2 == 0, F.concat(F.lit("  "), "p_brand", F.lit(" "))).otherwise(" ").alias("brandText"), F.array(F.lit("live")).alias("mainImageUrls"), F.array().cast("array<string>").alias("introImageUrls"),
    )
    shown = assemble.live_overlay(parsed, live)
    return shown.select("productId", "salePrice", "originalPrice", F.col("brandHint").alias("brand"), F.array_join("mainImageUrls", ",").alias("main"), F.array_join("introImageUrls", ",").alias("intro"))


@query("details_with_stock", f"""WITH inv AS ({inventory_sql()}), kind AS (SELECT productId, bool_or(hasOption) AS hasOption, arg_min(maxStock, ord) AS single FROM inv GROUP BY productId)
  SELECT CAST(p_partkey AS VARCHAR) AS productId, p_name AS productName, hasOption, single, CASE WHEN p_size > 25 THEN p_size END::BIGINT AS optionCount FROM part LEFT JOIN kind ON productId = CAST(p_partkey AS VARCHAR)""")
def details_with_stock(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("productId", F.col("p_partkey").cast("string"))
    summary = part.filter("p_size > 25").select("productId", F.col("p_size").cast("bigint").alias("optionCount"))
    made = assemble.with_details(part.select("productId", F.col("p_name").alias("productName")), inventory_table(spark, sf_dir), summary)
    return made.select("productId", "productName", "hasOption", "single", "optionCount")


@query("detail_problems", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'no product id' WHEN p_size % 5 = 1 THEN 'no product name' END AS one, CASE WHEN p_size % 5 = 0 THEN 'no product id' WHEN p_size % 5 = 1 THEN 'no product name' WHEN p_size % 5 < 4 THEN 'no main image' END AS two FROM part""")
def detail_problems(spark, sf_dir):
    z = F.col("p_size")
    images = F.when(z % 5 == 2, F.array().cast("array<string>")).when(z % 5 == 4, F.array(F.lit("i")))
    rows = read(spark, sf_dir, "part").select(
        "p_partkey", F.when(z % 5 > 0, "id").alias("productId"), F.when(z % 5 == 1, "").otherwise("name").alias("productName"), images.alias("mainImageUrls")
    )
    return elements.detail_errors(elements.detail_errors(rows).withColumnRenamed("detailError", "one"), True).select("p_partkey", "one", F.col("detailError").alias("two"))


@query("year_ranges", """SELECT event_id, strftime(d, '%y%m%d') AS date, d AS endDay, CASE WHEN month(d) = 2 AND day(d) = 29 THEN make_date(year(d) - 1, 3, 1) ELSE CAST(d - INTERVAL 1 YEAR AS DATE) END AS startDay
  FROM (SELECT event_id, CAST(ts + INTERVAL 9 HOUR + INTERVAL (event_id) DAY AS DATE) AS d FROM events)""")
def year_ranges(spark, sf_dir):
    moved = read(spark, sf_dir, "events").select("event_id", F.expr("ts + make_dt_interval(CAST(event_id AS INT))").alias("ts"))
    return shipping.date_ranges(moved).select("event_id", text.kst_date(F.col("ts")).alias("date"), "endDay", "startDay")
