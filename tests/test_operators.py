"""Small cases of the operators that the test tables don't reach."""

import pytest
from pyspark.sql import functions as F

from tallyard.functions import text
from tallyard.functions.schemas import OPTION
from tallyard.operators import archive, assemble, cart, coverage, dedupe, exclusions, fx, health, inventory, settings, shipping, translation


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_summary_of_one_product(spark):
    data = [(1, "P1", "red", True, 999, 5, True, 100, "LOW_STOCK"), (2, "P1", "blue", True, 999, 0, False, 120, "OUT_OF_STOCK"), (3, "P1", "red", True, 999, 20, False, 90, "IN_STOCK")]
    df = spark.createDataFrame(data, "ord int, productId string, optionText string, hasOption boolean, requestedQty bigint, maxStock bigint, stockLimited boolean, effectivePrice bigint, stockStatus string")
    r = inventory.summarise(df.withColumn("hasBoxDiscount", F.lit(False))).first()
    assert (r.rowCount, r.optionCount, r.totalStock, r.minStock, r.maxStock, r.requestedQtyTotal, r.priceMin, r.priceMax) == (3, 3, 25, 0, 20, 2997, 90, 120)
    assert (r.limitedRowCount, r.lowStockRowCount, r.outOfStockRowCount, r.stockStatus, r.optionNames) == (1, 1, 1, "LOW_STOCK", "red / blue")


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("k1", 1, 1), ("k2", 2, 2), ("k1", 3, 3)], "k string, v int, ord int")
    assert rows(dedupe.keep_first(df, ["k"], ["ord"]), "k", "v") == [("k1", 1), ("k2", 2)]
    assert rows(dedupe.last_value_first_position(df, ["k"], "ord"), "ord", "k", "v") == [(1, "k1", 3), (2, "k2", 2)]


def test_coverage(spark):
    schema = "productId string, optionId string, optionText string, hasOption boolean, selectedForCart boolean"
    popup = spark.createDataFrame([("P1", "1", "red", True, True), ("P1", "2", "blue", True, True)], schema)
    actual = spark.createDataFrame([("P1", "1", "red", True), ("P1", "1", "red", True)], "productId string, optionId string, optionText string, hasOption boolean")
    none = spark.createDataFrame([], "productId string")
    r = coverage.coverage(popup.select("productId"), popup, actual, none).first()
    assert (r.complete, r.optionCoverageComplete, r.missingRowKeys, r.extraRowKeys, r.partialProductCount) == (True, False, 1, 1, 1)


OPT = f"array<{OPTION}>"


def product(spark, id_, options=(), **fields):
    opts = [tuple(o.get(k) for k in ("id", "barcode", "name", "nameKo", "nameJa", "nameEn", "additionalPrice", "stockQuantity", "status")) for o in options]
    base = spark.createDataFrame([(id_, opts)], f"id string, options {OPT}")
    return base.withColumns({k: v if not isinstance(v, (str, int, bool)) else F.lit(v) for k, v in fields.items()})


def test_archive_options(spark):
    stored = product(spark, "1", [{"id": "10", "nameKo": "a", "name": "a", "stockQuantity": 3}, {"id": "9", "nameKo": "b", "name": "b", "stockQuantity": 4}], nameKo="n", type="OPTION", stockQuantity=7)
    incoming = product(spark, "1", [{"id": "a", "nameKo": "c", "stockQuantity": 1}, {"id": "10", "nameKo": "", "stockQuantity": None}], nameKo="n", type="OPTION", inventoryObserved=True)
    r = archive.merge(stored, incoming, "general").first()
    assert [(o.id, o.nameKo, o.stockQuantity) for o in r.options] == [("9", "b", 4), ("10", "a", None), ("a", "c", 1)]
    assert (r.state, r.newOptions, r.updatedOptions, r.stockQuantity) == ("updated", 1, 1, None)
    single = product(spark, "1", [], nameKo="n", type="SINGLE", inventoryObserved=True)
    r = archive.merge(stored, single, "general").first()
    assert (len(r.options), r.type) == (0, "SINGLE")
    idle = product(spark, "1", [], nameKo="n", type="SINGLE", stockQuantity=0)
    r = archive.merge(stored, idle, "general").first()
    assert (len(r.options), r.stockQuantity, r.state) == (2, 7, "updated" if r.changedFields else "unchanged")


def test_archive_detail_and_translation(spark):
    urls = lambda *u: F.array(*[F.lit(x) for x in u]).cast("array<string>")
    stored = product(spark, "1", nameKo="n", nameJa="j", imageUrls=urls("u"))
    r = archive.merge(stored, product(spark, "1", nameKo="", imageUrls=urls()), "detail").first()
    assert (r.nameKo, r.imageUrls) == ("n", ["u"])
    r = archive.merge(stored, product(spark, "1", nameKo="m", imageUrls=urls("x/thumb/y", "z")), "detail").first()
    assert (r.nameKo, r.imageUrls) == ("m", ["z"])
    assert archive.merge(stored, product(spark, "1", nameKo="m", nameJa=""), "translation").first().nameJa == ""
    assert archive.merge(stored, product(spark, "1", nameKo="n", nameJa=""), "translation").first().nameJa == "j"
    with pytest.raises(ValueError):
        archive.merge(stored, stored, "detail", 0.1, "1")


def test_archive_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    assert archive.read_snapshot(spark, path).count() == 0
    archive.write_snapshot(archive.normalise(product(spark, "1", nameKo="a"), archived=True), path, 1)
    archive.write_snapshot(archive.normalise(product(spark, "2", nameKo="b"), archived=True), path, 2)
    assert rows(archive.read_snapshot(spark, path), "id", "nameKo") == [("2", "b")]


def test_fx(spark):
    page = '<script>var _data = {"x":"}\\"{", "rates":[{"currency":"USD","unit":1,"cashBuy":1},{"currency":"JPY","unit":100,"cashBuy":860.10}]};</script>'
    r = fx.derive(fx.page_rates(spark.createDataFrame([(1, page), (2, "none"), (3, None)], "id int, html string"))).filter("error is null").first()
    assert (str(r.rate), str(r.revRate), r.id) == ("0.11627", "860.10", 1)
    d = spark.createDataFrame([(12900,), (None,), (0,), (-1,)], "price bigint")
    assert [x.y for x in d.select(fx.to_yen(F.col("price"), F.lit(0.11627)).alias("y")).collect()] == [1500, None, 0, None]


@pytest.mark.parametrize("site,product_,option,quantity,want", [("mall-b.example", "1", "5", 1.0, "option id not allowed"), ("a.mall-a.example", "1", "", 1.0, "option id missing"), ("mall-b.example", "1", "", 1.9, None), ("mall-b.example", "1", "0", 0.0, "quantity"), ("other", "1", "", 1.0, "unknown site")])
def test_cart_validation(spark, site, product_, option, quantity, want):
    r = cart.validated(spark.createDataFrame([(site, product_, option, quantity)], "site string, productId string, optionId string, quantity double")).first()
    assert r.reason == want
    if quantity == 1.9:
        assert r.quantity == 1


def test_shipping(spark):
    doc = '{"rows":[{"id":1,"mft_itemName":"A","kids":[{"id":2,"mft_itemName":"B"}]},{"id":1,"mft_itemName":"A"}]}'
    df = spark.createDataFrame([(1, doc), (2, "<html>"), (3, None)], "doc int, json string")
    assert rows(shipping.records(df), "doc", "id", "name") == [(1, "1", "A"), (1, "2", "B")]


def test_shipping_of_deep_and_many_nodes(spark):
    """Nodes below level 60, and more nodes than a recursive query may give."""
    deep = '{"a":' * 70 + '{"id":1,"mft_itemName":"A"}' + "}" * 70
    assert rows(shipping.records(spark.createDataFrame([(1, deep)], "doc int, json string")), "doc", "id", "name") == [(1, "1", "A")]
    kids = F.array_repeat(F.lit('{"id":1,"mft_itemName":"A"}'), 100)
    many = spark.range(4000).select(F.col("id").alias("doc"), F.concat(F.lit("["), F.array_join(kids, ","), F.lit("]")).alias("json"))
    assert shipping.records(many).count() == 4000


def test_cycle_risk(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 10.0), ("a", 3, 23.0), ("b", 1, 10.0), ("b", 2, 10.0), ("b", 3, 22.0), ("c", 1, 1.0), ("c", 2, 90.0)], "run string, cycleNo int, msPerProduct double")
    r = health.cycle_risks(df.withColumn("maxDomNodes", F.lit(1)).withColumn("maxHeapMb", F.lit(1)), ["run"]).filter("size(reasons) > 0")
    assert rows(r, "run", "cycleNo", "label") == [("a", 3, "slowdown")]


def test_page_scan(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "c")], "page int, productId string")
    assert rows(health.page_scan(df), "page", "status") == [(1, "kept"), (2, "duplicate-page"), (3, "after-stop")]
    assert health.page_range("auto", 2, 0, 7) == (2, 7)
    with pytest.raises(ValueError):
        health.page_range("manual", 3, 2, None)


def test_match_and_sold_out(spark):
    requests = spark.createDataFrame([(1, "11", "[x] Ab c"), (1, "12", "d"), (2, "13", "e")], "batch int, productId string, productName string")
    blocks = spark.createDataFrame([(1, 1, ["12"], ""), (1, 2, [], "abC"), (2, 1, [], "zz"), (1, 3, ["11", "12"], "none")], "batch int, blockId int, ids array<string>, name string")
    assert rows(cart.match_blocks(blocks, requests), "batch", "blockId", "matchMode") == [(1, 1, "id"), (1, 2, "name"), (1, 3, "unresolved"), (2, 1, "single")]
    messages = spark.createDataFrame([(1, "<i>11</i>", "no"), (1, "", "sold: D!")], "batch int, html string, text string")
    assert rows(cart.sold_out_in_text(messages, requests), "batch", "productId") == [(1, "11"), (1, "12")]


def test_translation_problems(spark):
    o = "array<struct<optionId:string>>"
    sent = spark.createDataFrame([("1", True, True, [("a",)]), ("2", True, False, []), ("3", True, False, [])], f"key string, translateNameJa boolean, translateNameEn boolean, options {o}")
    got = spark.createDataFrame([("1", "j", "", [("a",)]), ("2", "j", "", [("x",)]), ("2", "j", "", []), ("9", "", "", [])], f"key string, nameJa string, nameEn string, options {o}")
    assert rows(translation.problems(sent, got), "key", "reason") == [("1", "empty en"), ("2", "duplicate key"), ("2", "other options"), ("3", "missing key"), ("9", "unknown key")]


def test_assembly_of_details(spark):
    df = spark.range(1).select(
        F.array(F.lit("a"), F.lit("b/thumb/c")).alias("m"), F.array(F.lit("a"), F.lit("d")).alias("d"), F.lit(None).cast("array<string>").alias("e"),
        F.create_map(F.lit("재질"), F.lit("면"), F.lit("판매가"), F.lit("1")).alias("raw"),
    )
    r = df.select(assemble.images(F.col("m"), F.col("d"), F.col("e")).alias("i"), assemble.specs(F.lit(None), F.col("raw")).alias("s")).first()
    assert (r.i.imageUrls, r.i.thumbnailUrl) == (["a", "d"], "a")
    assert [(x.labelKo, x.valueKo, x.sortOrder) for x in r.s] == [("재질", "면", 0)]


def test_options_and_their_names(spark):
    kinds = "ord int, productId string, optionId string, hasOption boolean, optionText string, maxStock int, stockStatus string"
    sold = [
        (3, "1", "b", True, "later", 1, "IN_STOCK"), (2, "1", " b ", True, " first\u3000 b", 2, "OUT_OF_STOCK"), (1, "1", "0", True, "zero", 3, None), (1, "1", "0", True, "zero", 3, None), (4, "1", None, True, "none", None, None),
        (0, "1", "c", False, "no option", 9, None), (None, "2", "d", True, "unplaced", 4, None), (5, "2", "d", True, "placed", 5, None), (None, "3", "e", True, "only", 6, None),
    ]
    names = [("1", "b", "ja b", None), ("1", "b", "ja b", "en b"), ("1", "0", "ja 0", None), ("1", "c", "ja c", None), ("1", "", "x", None), (None, "b", "y", None), ("9", "b", "z", None)]
    inventory, translated = spark.createDataFrame(sold, kinds), spark.createDataFrame(names, "productId string, optionId string, ja string, en string")
    shown = lambda df: {r.productId: [(o.id, o.nameKo, o.nameJa, o.nameEn, o.stockQuantity, o.status) for o in r.options] for r in df.collect()}
    zero = ("", "zero", "ja 0", "", 3, "ON_SALE")
    found = shown(assemble.options(inventory, translated))
    assert found == {
        "1": [zero, zero, ("b", "first b", "ja b", "en b", 2, "SOLD_OUT"), ("", "none", "", "", None, "ON_SALE")], "2": [("d", "placed", "", "", 5, "ON_SALE")], "3": [("e", "", "", "", None, "ON_SALE")],
    }
    plain = shown(assemble.options(inventory))
    assert plain == {k: [(o[0], o[1], "", "", *o[4:]) for o in v] for k, v in found.items()}


def test_detail_texts_are_made_once(spark, sf):
    import __spark_entry__ as entry

    plan = entry.queries()["detail_products"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 150 and "array_sort" not in plan


def test_white_space_runs(spark):
    texts = ["", " ", "a", " a b ", "a  b", "a\tb", "a \u00a0b", "a \u00e9", "\u3000\u2003x \n y\u3000", "한 글  말", " \U0001f600 \U0001f600  ", "a\u200bb", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.trim(F.regexp_replace(F.coalesce("t", F.lit("")), text.SPACE, " "))
    assert all(a == b for a, b in df.select(text.squash(F.col("t")), plain).collect())


def test_exclusions(spark):
    df = spark.createDataFrame([("captcha here",), ("net::ERR",), ("user cancel",), ("x",)], "m string")
    assert [r.c for r in df.select(exclusions.error_class(F.col("m")).alias("c")).collect()] == ["blocking", "retryable", "aborted", "other"]


def test_rate_history_must_be_a_list(spark):
    docs = lambda *x: spark.createDataFrame([(d,) for d in x], "json string")
    text = '[{"date":"260102","rate":0.11,"revRate":9.1},{"date":"260101","rate":1}]'
    assert rows(fx.stored_history(docs(text, "")), "ord", "date", "rate") == [(0, "260102", 0.11), (1, "260101", 1.0)]
    with pytest.raises(Exception, match="must be a list"):
        fx.stored_history(docs('{"date":"260102"}')).collect()
    assert fx.parse_rates_text('<script>var _data = {"rates":[{"currency":"JPY"}]};</script>') == [{"currency": "JPY"}]


def test_settings(spark):
    asked = spark.createDataFrame([("nowhere", "9", None), (None, "1001", "https://shop.example/x?cateIDX=4")], "mall string, pageEnd string, category string")
    found = settings.resolve(asked, {"collectionMode": "odd"})
    assert rows(found, "mall", "category", "settingsError") == [("mall-a", "4", "unknown collection mode"), ("nowhere", None, "unknown mall")]
    assert rows(settings.resolve(asked), "pageEnd", "settingsError") == [(9, "unknown mall"), (1001, "too many pages")]
    assert "accountPw" not in settings.shown(found.withColumn("accountPw", F.lit("x"))).columns


def plain_names(rows):
    """The rule of ``suffixed`` in plain Python: first rows keep their names, others take free numbers."""
    taken = {(g, n) for g, n, _ in rows}
    seen, out = {}, {}
    for g, n, at in sorted(rows, key=lambda r: r[2]):
        if (g, n) not in seen:
            seen[g, n] = 1
            out[at] = n
            continue
        k = seen[g, n] + 1
        while (g, f"{n}_{k}") in taken:
            k += 1
        seen[g, n] = k
        out[at] = f"{n}_{k}"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_names_without_clash(spark, seed):
    import random

    draw = random.Random(seed)
    names = ["x", "x_2", "x_2_2", "x_3", "x_5", "y", "", "_2", "x_02", "x_1", "a_b_2", "a_b"]
    data = [(draw.choice(["g", "h", None]), draw.choice(names), i) for i in range(300)]
    df = spark.createDataFrame(data, "rank string, base string, number int").repartition(4)
    got = {r.number: r.name for r in dedupe.suffixed(df, ["rank"], "base", ["number"], "name").collect()}
    assert got == plain_names(data)
    assert len({(g, got[i]) for g, _, i in data}) == 300


def test_names_of_clashing_columns(spark):
    df = spark.createDataFrame([("g", "x", 1, "a", 5), ("g", "x", 2, "b", 6), ("g", "x_2", 3, "c", 7)], "g string, n string, at int, _rank string, part int")
    assert rows(dedupe.suffixed(df, ["g"], "n", ["at"], "out"), "at", "out", "_rank", "part") == [(1, "x", "a", 5), (2, "x_3", "b", 6), (3, "x_2", "c", 7)]
    assert rows(dedupe.numbered(df, ["at"]), "ord", "_rank", "part") == [(1, "a", 5), (2, "b", 6), (3, "c", 7)]
    assert rows(dedupe.first_n(df, ["g"], ["at"], 2), "at", "_rank") == [(1, "a"), (2, "b")]


def test_running_totals_of_one_key(spark):
    """A key with all rows, over many ranges."""
    df = spark.range(2000).selectExpr("CAST(NULL AS STRING) AS k", "id").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(dedupe.running_total(df, ["k"], ["id"], F.col("id"), "sum"), "id", "sum")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [(i, i * (i + 1) // 2) for i in range(2000)]


def test_rows_by_unique_names(spark):
    df = spark.createDataFrame([("p", "red", "1", 1), ("p", "red", "2", 2), ("p", "", "7", 3), ("p", " ", "8", 4), ("p", None, None, 5)], "p string, t string, id string, at int")
    got = dedupe.by_name(df, ["p"], [F.col("t"), F.col("id")], ["at"], F.col("at")).first().entries
    assert got == {"red": 1, "red_2": 2, "7": 3, "option_4": 4, "default": 5}
