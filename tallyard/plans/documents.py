"""JSON documents and rate pages made from the tables, one to a file, and read back, with DuckDB SQL of what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.functions import text
from tallyard.operators import archive, exclusions, fx, health, inventory, responses, translation
from tallyard.plans import catalogue
from tallyard.plans.catalogue import query, read
from tallyard.sources import json_arrays, sinks
from tallyard.sources.shared import dealt, folder
from tallyard.streaming import progress


def _written(documents: DataFrame) -> str:
    """A folder that holds each text of ``documents`` (one column) as a file of its own."""
    path = folder(documents.sparkSession, "documents")
    documents.write.option("maxRecordsPerFile", 1).text(path)
    return path


def _parts(spark, sf_dir) -> DataFrame:
    """(doc, item) of parts, a hundred to a document; braces, quotes and backslashes stand in their texts."""
    name = F.concat("p_name", F.lit(' }],"{\\ '), "p_brand")
    return read(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 100).alias("doc"), F.col("p_partkey").cast("string").alias("key"),
        F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_partkey")).alias("id"), name.alias("nameKo"), F.col("p_size").alias("stockQuantity"), F.array(F.struct(F.lit("1").alias("id"), F.col("p_type").alias("nameKo"))).alias("options")).alias("item"),
    )


def _lists(spark, sf_dir) -> str:
    """Documents of parts as lists, as wrapped lists and as wrapped objects by key."""
    docs = _parts(spark, sf_dir).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("key").cast("bigint").alias("n"), "key", "item"))).alias("x"))
    items = F.transform("x", lambda x: x["item"])
    wrapped = F.to_json(F.struct(F.lit(1).alias("version"), F.lit("}]").alias("updatedAt"), items.alias("inventoryItems"), F.array(F.lit(1)).alias("rest")))
    keyed = F.to_json(F.struct(F.map_from_entries(F.transform("x", lambda x: F.struct(x["key"], x["item"]))).alias("products"), F.lit(2).alias("version")))
    return _written(docs.select(F.when(F.col("doc") % 3 == 0, F.to_json(items)).when(F.col("doc") % 3 == 1, wrapped).otherwise(keyed)))


@query("inventory_documents", r"""SELECT CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey // 100 % 3 = 2 THEN CAST(p_partkey AS VARCHAR) END AS id, p_name || ' }],"{\ ' || p_brand AS nameKo, p_size::BIGINT AS stockQuantity FROM part""")
def inventory_documents(spark, sf_dir):
    found = json_arrays.fields(json_arrays.records(spark, _lists(spark, sf_dir)), {"id": "string", "nameKo": "string", "stockQuantity": "bigint"})
    return json_arrays.identified(found).select("id", "nameKo", "stockQuantity")


@query("document_records", """SELECT p_partkey // 100 % 3 = 2 AS keyed, count(*) AS records, count(DISTINCT CASE WHEN p_partkey // 100 % 3 = 2 THEN p_partkey END) AS keys FROM part GROUP BY ALL""")
def document_records(spark, sf_dir):
    found = json_arrays.records(spark, _lists(spark, sf_dir))
    return found.groupBy(F.col("key").isNotNull().alias("keyed")).agg(F.count("*").alias("records"), F.count_distinct("key").alias("keys"))


# --- tables that are updated ------------------------------------------------


@query("archive_buckets", f"SELECT id, nameKo, nameJa, nameEn, originalPrice, stockQuantity, stockStatus FROM ({catalogue._GENERAL_SQL})")
def archive_buckets(spark, sf_dir):
    path = folder(spark, "archive")
    stored = catalogue._stored(spark, sf_dir)
    # the first update takes stored products as they are: a detail run fills what a general one leaves
    archive.update_buckets(stored.withColumn("inventoryObserved", F.lit(True)), path, "general", count=16)
    archive.update_buckets(stored, path, "detail")
    archive.update_buckets(catalogue._incoming(spark, sf_dir), path, "general")
    return archive.read_buckets(spark, path).select("id", "nameKo", "nameJa", "nameEn", "originalPrice", "stockQuantity", "stockStatus")


@query("progress_stream", catalogue.ORACLE_SQL["progress_state"])
def progress_stream(spark, sf_dir):
    path = folder(spark, "progress")
    progress.upsert_stream(spark, sf_dir, f"{path}/table", f"{path}/state", "events*.parquet").awaitTermination()
    return progress.upserted(spark, f"{path}/table").select("user_id", *progress.FIELDS, "updatedAt", "patches")


# --- translation ------------------------------------------------------------


def _nested(spark, sf_dir):
    """Archived products with nested options, and products of lines with their own options, some without a name."""
    part = read(spark, sf_dir, "part")
    n = F.col("p_size")
    option = lambda i, ko, ja: F.struct(i.cast("string").alias("id"), ko.alias("nameKo"), ja.alias("nameJa"), F.lit("").alias("nameEn"))
    options = F.transform(F.sequence(F.lit(1), n % 7 + 1), lambda i: option(F.when(i == 6, F.lit(2)).otherwise(i), F.when(i == 5, F.lit(" ")).otherwise(F.concat(F.lit("o "), i.cast("string"))), F.when(i % 2 == 0, F.lit("ja")).otherwise("")))
    stored = part.filter("p_size % 5 <> 0").select(
        F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit(" "), "p_name").alias("nameKo"), F.when(n % 3 == 0, "").otherwise("ja").alias("nameJa"), F.lit("en").alias("nameEn"), options.alias("options"),
    )
    own = F.filter(F.transform(F.array(F.lit(9), F.lit(2), F.lit(3)), lambda i: F.struct(i.cast("string").alias("id"), F.when((i == 3) & (n % 2 == 0), F.lit("other")).otherwise(F.concat(F.lit("o "), i.cast("string"))).alias("ko"))), lambda o: (o["id"] != "9") | (n % 4 == 0))
    products = part.select(F.col("p_partkey").cast("string").alias("productId"), F.when(n % 11 == 0, "").otherwise(F.col("p_name")).alias("nameKo"), own.alias("options"))
    return products, translation.archive_items(stored)


_NESTED_SQL = """p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_size AS n, p_name, p_size % 5 <> 0 AS known, CASE WHEN p_size % 11 <> 0 THEN p_name WHEN p_size % 5 <> 0 THEN p_name ELSE '' END AS nameKo FROM part),
  a AS (SELECT id, CASE WHEN i = 6 THEN 2 ELSE i END AS oid, i, CASE WHEN i = 5 THEN '' ELSE 'o ' || i END AS ko, CASE WHEN i % 2 = 0 THEN 'ja' ELSE '' END AS ja FROM p, unnest(range(1, n % 7 + 2)) AS t(i) WHERE known),
  own AS (SELECT id, o AS oid, place, CASE WHEN o = 3 AND n % 2 = 0 THEN 'other' ELSE 'o ' || o END AS ko FROM p, (VALUES (9, 1), (2, 2), (3, 3)) AS t(o, place) WHERE o <> 9 OR n % 4 = 0),
  extra AS (SELECT id, oid, 10 + min(i) AS place, arg_min(ko, i) AS ko FROM a WHERE ko <> '' AND (id, oid) NOT IN (SELECT (id, oid) FROM own) GROUP BY id, oid),
  o AS (SELECT * FROM own UNION ALL SELECT * FROM extra),
  l AS (SELECT id, oid, arg_max(ko, i) AS ko, arg_max(ja, i) AS ja FROM a GROUP BY id, oid)"""


@query("translation_supplement", f"WITH {_NESTED_SQL} SELECT p.id AS productId, nameKo, string_agg(oid || '=' || ko, ',' ORDER BY place) AS options FROM p JOIN o USING (id) GROUP BY ALL")
def translation_supplement(spark, sf_dir):
    found = translation.with_archive_options(*_nested(spark, sf_dir), "detail")
    return found.select("productId", "nameKo", F.array_join(F.transform("options", lambda o: F.concat_ws("=", o["id"], o["ko"])), ",").alias("options"))


@query("translation_tasks_detail", f"""WITH {_NESTED_SQL}, t AS (SELECT o.id, string_agg(o.oid || '=' || o.ko, ',' ORDER BY place) AS options FROM o LEFT JOIN l ON l.id = o.id AND l.oid = o.oid WHERE l.ko IS NULL OR l.ko <> o.ko OR l.ja = '' GROUP BY o.id)
  SELECT id AS key, CASE WHEN j OR e THEN nameKo ELSE '' END AS nameKo, j AS translateNameJa, e AS translateNameEn, coalesce(options, '') AS options
  FROM (SELECT id, nameKo, NOT known OR n % 3 = 0 AS j, NOT known AS e, options FROM p LEFT JOIN t USING (id)) WHERE j OR e OR options IS NOT NULL""")
def translation_tasks_detail(spark, sf_dir):
    products, items = _nested(spark, sf_dir)
    found = translation.nested_tasks(translation.with_archive_options(products, items, "detail"), items, "detail")
    return found.select("key", "nameKo", "translateNameJa", "translateNameEn", F.array_join(F.transform("options", lambda o: F.concat_ws("=", o["id"], o["ko"])), ",").alias("options"))


def _responses(spark, sf_dir):
    """Tasks of parts in batches of a hundred, and responses; in every third batch some of them are wrong."""
    n, k = F.col("p_size"), F.col("p_partkey")
    ids = F.sequence(F.lit(1), n % 3 + 2)
    part = read(spark, sf_dir, "part").withColumn("batch", F.floor(k / 100))
    sent = part.select("batch", k.cast("string").alias("key"), F.lit(True).alias("translateNameJa"), (n % 2 == 0).alias("translateNameEn"), F.transform(ids, lambda i: F.struct(i.cast("string").alias("id"), (i != 1).alias("translateJa"), F.lit(False).alias("translateEn"))).alias("options"))
    kind = F.when(F.col("batch") % 3 == 1, n % 12).otherwise(99)
    text = lambda i: F.struct(i.cast("string").alias("id"), F.when((i == 1) | ((kind == 7) & (i == 2)), F.lit(" ")).otherwise("ja").alias("ja"), F.lit("").alias("en"))
    options = F.transform(ids, text)
    wrong = F.when(kind == 3, F.concat(options, F.slice(options, 1, 1))).when(kind == 4, F.slice(options, 2, 9)).when(kind == 5, F.concat(F.slice(options, 2, 9), F.transform(F.array(F.lit(77)), text))).otherwise(options)
    key = F.when(kind == 2, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string"))
    received = part.withColumn("times", F.when(kind == 0, 0).when(kind == 1, 2).otherwise(1)).withColumn("time", F.explode(F.sequence(F.lit(0), F.col("times")))).filter("time > 0")
    return sent, received.select("batch", key.alias("key"), F.when(kind == 6, F.lit(" ")).otherwise("ja").alias("nameJa"), F.when((kind == 8) | (n % 2 == 1), "").otherwise("en").alias("nameEn"), wrong.alias("options"))


_RESPONSES_SQL = """s AS (SELECT p_partkey // 100 AS batch, CAST(p_partkey AS VARCHAR) AS key, p_size AS n, CASE WHEN p_partkey // 100 % 3 = 1 THEN p_size % 12 ELSE 99 END AS kind FROM part),
  c AS (SELECT batch, count(*) AS asked, sum(CASE kind WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) AS got FROM s GROUP BY batch),
  f AS (SELECT batch, NULL AS key, NULL AS optionId, 'other number of items' AS reason FROM c WHERE asked <> got
    UNION ALL SELECT batch, key, NULL, CASE kind WHEN 1 THEN 'duplicate key' ELSE 'missing key' END FROM s WHERE kind IN (0, 1, 2) UNION ALL SELECT batch, 'x' || key, NULL, 'unknown key' FROM s WHERE kind = 2
    UNION ALL SELECT batch, key, NULL, 'empty ja' FROM s WHERE kind = 6 UNION ALL SELECT batch, key, NULL, 'empty en' FROM s WHERE kind = 8 AND n % 2 = 0
    UNION ALL SELECT batch, key, '1', CASE kind WHEN 3 THEN 'duplicate option id' ELSE 'missing option id' END FROM s WHERE kind IN (3, 4, 5)
    UNION ALL SELECT batch, key, '77', 'unknown option id' FROM s WHERE kind = 5 UNION ALL SELECT batch, key, '2', 'empty option ja' FROM s WHERE kind = 7)"""


@query("translation_responses", f"WITH {_RESPONSES_SQL} SELECT batch, key, optionId, reason FROM f")
def translation_responses(spark, sf_dir):
    return responses.problems(*_responses(spark, sf_dir))


@query("translation_accepted", f"WITH {_RESPONSES_SQL} SELECT batch, count(*) AS items FROM s WHERE batch NOT IN (SELECT batch FROM f) GROUP BY batch")
def translation_accepted(spark, sf_dir):
    sent, received = _responses(spark, sf_dir)
    return responses.accepted(received, responses.problems(sent, received)).groupBy("batch").agg(F.count("*").alias("items"))


@query("translation_retries", f"""WITH {_RESPONSES_SQL} SELECT key, (row_number() OVER (ORDER BY CAST(key AS BIGINT)) - 1) // 100 AS batch, (row_number() OVER (ORDER BY CAST(key AS BIGINT)) - 1) // 1000 AS wave, 2 AS attempt, 1 AS wait
  FROM s WHERE batch IN (SELECT batch FROM f)""")
def translation_retries(spark, sf_dir):
    sent, received = _responses(spark, sf_dir)
    found = responses.problems(sent, received)
    return responses.again(sent.withColumn("number", F.col("key").cast("bigint")), found, ["number"], 2).select("key", "batch", "wave", "attempt", "wait")


# --- rates, errors, order, exports ------------------------------------------


def _rate_pages(spark, sf_dir):
    """Script pages of parts: braces, quotes and backslashes stand in strings; some have no object, an open one, or no rate."""
    n = F.col("p_size")
    entry = F.concat(F.lit('{"CURR_CODE":"JPY","UNIT_PRICE":"'), F.when(n % 5 == 1, "1").otherwise("100"), F.lit('","CASH_BUY":"1,'), F.lpad(n.cast("string"), 3, "0"), F.when(n % 5 == 2, "x").otherwise(".25"), F.lit('","EXCHANGE_DATE":" 2026.01.'), F.lpad(n.cast("string"), 2, "0"), F.lit(' "}'))
    rates = F.concat(F.lit('[{"CURR_CODE":"USD","UNIT_PRICE":1}'), F.when(n % 7 != 0, F.concat(F.lit(","), entry)).otherwise(""), F.lit("]"))
    text = F.concat(F.lit('{"note":"}{ \\" }} \\\\","deep":{"a":[{"b":"}"}]},"REC_FXD":'), rates, F.when(n % 11 == 0, "").otherwise("}"))
    page = F.concat(F.lit('<script>var x_data = {"REC_FXD":1}; var other = "{";</script><script> _data  =  '), F.when(n % 13 == 0, "null;</script>").otherwise(F.concat(text, F.lit("; _data = {};</script>"))))
    return dealt(read(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.when(n % 17 == 0, "<p>_date = {}</p>").otherwise(page).alias("html"))


@query("script_rates", """SELECT p_partkey, CASE WHEN reading IS NULL AND p_size % 5 NOT IN (1, 2) THEN CAST(floor(10000000.0 / (1000 + p_size + 0.25) + 0.5) / 100000.0 AS DECIMAL(12,5)) END AS rate,
    CASE WHEN reading IS NULL THEN '2026.01.' || lpad(CAST(p_size AS VARCHAR), 2, '0') END AS day, coalesce(reading, CASE p_size % 5 WHEN 1 THEN 'unit' WHEN 2 THEN 'rate' END) AS error
  FROM (SELECT *, CASE WHEN p_size % 17 = 0 THEN 'no assignment' WHEN p_size % 13 = 0 THEN 'no object' WHEN p_size % 11 = 0 THEN 'incomplete' WHEN p_size % 7 = 0 THEN 'no rate' END AS reading FROM part)""")
def script_rates(spark, sf_dir):
    return fx.derived_rates(_rate_pages(spark, sf_dir)).select("p_partkey", "rate", "day", "error")


_MESSAGES = (("socket hang up ECONNRESET", "retryable"), ("HTTP 403 Forbidden", "blocking"), ("AbortError: stopped by user", "aborted"), ("no such element", "other"))


@query("error_classes", f"SELECT event_type, list_value({', '.join(repr(c) for _, c in _MESSAGES)})[event_id % {len(_MESSAGES)} + 1] AS class, count(*) AS n FROM events GROUP BY ALL")
def error_classes(spark, sf_dir):
    """Classes of messages; events have one of each class in turn."""
    events = read(spark, sf_dir, "events").select("event_type", F.get(F.array(*[F.lit(m) for m, _ in _MESSAGES]), F.col("event_id") % len(_MESSAGES)).alias("message"))
    return events.groupBy("event_type", exclusions.error_class(F.col("message")).alias("class")).agg(F.count("*").alias("n"))


_NAMES = ("가나", "각", "ABC", "abc", "漢", "10", "2", "é", "z", "-", "[가] 나", "")


@query("locale_order", f"""SELECT productId, row_number() OVER (ORDER BY coalesce(c, '') COLLATE ko, coalesce(b, '') COLLATE ko, coalesce(n, '') COLLATE ko, try_cast(productId AS BIGINT) NULLS LAST, productId) AS rank
  FROM (SELECT CASE WHEN p_size % 9 = 0 THEN 'x' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS productId, CASE WHEN p_size % 12 <> 11 THEN list_value({", ".join(f"'{n}'" for n in _NAMES)})[p_size % 12 + 1] END AS c, [{", ".join(f"'{n}'" for n in _NAMES[::-1])}][p_partkey % 7 + 1] AS b, p_name || p_brand AS n FROM part)""")
def locale_order(spark, sf_dir):
    n, k = F.col("p_size"), F.col("p_partkey")
    pick = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), i)
    rows = read(spark, sf_dir, "part").select(
        F.when(n % 9 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string")).alias("productId"), F.when(n % 12 != 11, pick(_NAMES, n % 12)).alias("categoryHint"),
        pick(_NAMES[::-1], (k % 7).cast("int")).alias("brandHint"), F.concat("p_name", "p_brand").alias("productName"), F.lit(None).cast("string").alias("optionText"),
    )
    return inventory.ranked(rows).select("productId", "rank")


@query("pretty_documents", r"""SELECT '{' || chr(10) || '  "id": ' || p_partkey || ',' || chr(10) || '  "name": "' || p_name || ' \"q\" \\",' || chr(10) || '  "price": ' || CASE WHEN p_size % 3 = 0 THEN 'null' ELSE CAST(p_size AS VARCHAR) END || ',' || chr(10) || '  "tags": '
    || CASE WHEN p_size % 2 = 0 THEN '[]' ELSE '[' || chr(10) || '    {' || chr(10) || '      "k": "' || p_brand || '",' || chr(10) || '      "on": true' || chr(10) || '    },' || chr(10) || '    null' || chr(10) || '  ]' END || chr(10) || '}' AS json FROM part""")
def pretty_documents(spark, sf_dir):
    n = F.col("p_size")
    tag = F.struct(F.col("p_brand").alias("k"), F.lit(True).alias("on"))
    return sinks.pretty_json(read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(' "q" \\')).alias("name"), F.when(n % 3 != 0, n).alias("price"), F.when(n % 2 == 0, F.array().cast("array<struct<k:string,on:boolean>>")).otherwise(F.array(tag, F.lit(None))).alias("tags"),
    ))


# --- ranges, objects, run folders -------------------------------------------


@query("page_ranges", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'auto' WHEN p_size % 5 <> 0 AND p_size > 20 THEN 'manual-capped' ELSE 'manual' END AS mode, e AS resolvedEnd,
    CASE WHEN e IS NULL OR p_partkey % 9 + 1 > e THEN 'first page ' || p_partkey % 9 + 1 || ' is beyond the last, ' || coalesce(CAST(e AS VARCHAR), 'unknown') END AS error
  FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 5 <> 0 THEN 20 END WHEN p_size % 5 <> 0 AND p_size > 20 THEN 20 ELSE p_size END AS e FROM part)""".replace("'first page ' || p_partkey % 9 + 1 ||", "'first page ' || (p_partkey % 9 + 1) ||"))
def page_ranges(spark, sf_dir):
    n = F.col("p_size")
    runs = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 9 + 1).alias("pageStart"), F.when(n % 3 == 0, 0).otherwise(n).cast("int").alias("pageEnd"), F.when(n % 5 != 0, 20).alias("detectedLastPage"))
    return health.page_ranges(runs).select("p_partkey", "mode", "resolvedEnd", "error")


@query("parsed_objects", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 4 IN (0, 2) THEN NULL WHEN event_id % 4 = 1 THEN props || '}' ELSE 'not {json' END AS text, event_id % 4 IN (0, 2) AS isJson FROM events""")
def parsed_objects(spark, sf_dir):
    i = F.col("event_id") % 4
    said = F.when(i == 0, F.col("props")).when(i == 1, F.concat("props", F.lit("}"))).when(i == 2, F.concat(F.lit("["), "props", F.lit("]"))).otherwise("not {json")
    events = read(spark, sf_dir, "events").select("event_id", said.alias("said"))
    return events.select("event_id", F.try_element_at(text.parsed_object(F.col("said")), F.lit("k")).alias("k"), text.response_value(F.col("said"))["text"].alias("text"), text.response_value(F.col("said"))["json"].isNotNull().alias("isJson"))


@query("run_folders", "SELECT 'products' AS name, p_partkey AS id, p_name AS text FROM part UNION ALL SELECT 'warnings', s_suppkey, s_name FROM supplier")
def run_folders(spark, sf_dir):
    path = folder(spark, "runs")
    tables = {"products": read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), "warnings": read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"))}
    sinks.write_run(tables, path, "mall-a", "r1")
    found = [spark.read.schema("id long, text string").json(f"{path}/mall-a/r1/{n}").select(F.lit(n).alias("name"), "id", "text") for n in tables]
    return found[0].unionByName(found[1])
