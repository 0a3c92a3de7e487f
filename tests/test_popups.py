"""Popups, sold-out messages, responses of waves, nested archives, script rates, indented JSON: small cases."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyard.operators import cart, coverage, fx, inventory, responses, translation
from tallyard.sources import elements, popups, sinks


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def option(number, stock='<input id="inOPMaxStock" value="5">', more="", box="checkbox"):
    return f'<tr id="inOptionTR"><td><input id="optionCHKPOP" name="optionCHKPOP" value="{number}" {more}></td><td id="tdOption">o {number}</td><td><input id="inOPcount">{stock}</td></tr>' if box else f'<tr id="inOptionTR"><td class="option_txt">no box</td><td>{stock}</td></tr>'


def block(inner, name="[B] Red  Pen", style=""):
    return f'<div class="x many_add" {style}><p class="subject">{name}</p>{inner}</div>'


def table(*lines, group="g"):
    return f'<table id="opSelectedList"><tr><td><input id="inIDXPOP" value="{group}"></td></tr>{"".join(lines)}</table>'


PAGES = {
    # a link decides though the name is another's; the second block has two ids, so its name decides
    "ids": (block('<a href="/v?x=1&amp;qidx=11">a</a>' + table(option("1"))) + block('<i data-qidx="11"></i><i data-productid="12"></i>' + table(option("2")), "[Z] Blue Cup"), [("11", "Blue Cup"), ("12", "Blue Cup!"), ("13", "[q] Blue Cup")]),
    # one request, one visible block; others are hidden by themselves or by what is around them
    "single": (block(table(option("1"), option("2", ""), option("3", more="disabled"), option("4", '<input id="inOPMaxStock" value="0">'), option("5", box=None)), "?") + block(table(option("9")), style='style="Display : none;"') + "<div hidden>" + block(table(option("8"))) + "</div>", [("21", "Chair")]),
    # two requests of one name resolve nothing; a block without a table counts but has no rows
    "none": (block(table(option("1")), "Pen") + block("", "Pen"), [("31", "Pen"), ("32", "Pen")]),
    "empty": ("<p>no popup</p>", [("41", "x")]),
}


@pytest.fixture(scope="module")
def popup_tables(spark):
    els = elements.elements(spark.createDataFrame([(k, html) for k, (html, _) in PAGES.items()], "page string, html string"))
    requests = spark.createDataFrame([(k, *r) for k, (_, rs) in PAGES.items() for r in rs], "page string, productId string, productName string")
    return els, requests


def test_blocks_find_their_products(spark, popup_tables):
    got = rows(popups.block_products(*popup_tables, ["page"]), "page", "productIndex", "productId", "productMatchMode", "explicitProductIds", "visibleBlockCount")
    assert got == [
        ("ids", 0, "11", "dom-id", ["11"], 2), ("ids", 1, "", "unresolved", ["11", "12"], 2), ("none", 0, "", "unresolved", [], 2), ("none", 1, "", "unresolved", [], 2), ("single", 0, "21", "single-block", [], 1),
    ]


def test_option_rows(spark, popup_tables):
    els, requests = popup_tables
    options = spark.createDataFrame([("ids", "11", "1", 4), ("ids", "11", "1", 2)], "page string, productId string, optionId string, quantity int")
    found = popups.popup_rows(els, requests, options, ["page"], quantity=3)
    got = rows(found.filter("page <> 'none'"), "page", "productIndex", "optionIndex", "optionId", "optionText", "complete", "selectable", "stockStatus", "selectedForCart", "requestedQty")
    assert got == [
        ("ids", 0, 0, "1", "o 1", True, True, "LOW_STOCK", True, 2), ("ids", 1, 0, "2", "o 2", True, True, "LOW_STOCK", True, 3),
        ("single", 0, 0, "1", "o 1", True, True, "LOW_STOCK", True, 3), ("single", 0, 1, "2", "o 2", False, False, "OUT_OF_STOCK", False, 0), ("single", 0, 2, "3", "o 3", True, False, "DISABLED", False, 0),
        ("single", 0, 3, "4", "o 4", True, False, "OUT_OF_STOCK", False, 0), ("single", 0, 4, "0", "", False, False, "LOW_STOCK", False, 0),
    ]


def test_contained_patterns_against_all_pairs(spark):
    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("abc") for _ in range(n))
    texts = [(i % 3, i, word(draw.randrange(40))) for i in range(60)] + [(0, 100, None), (0, 101, "")]
    patterns = [(i % 3, word(draw.choice([0, 1, 2, 3, 4, 5, 6, 7, 12, 13]))) for i in range(80)] + [(0, None)]
    found = cart.contained(spark.createDataFrame(texts, "k int, at int, text string"), spark.createDataFrame(patterns, "k int, pattern string"), ["k"])
    want = {(k, i, p) for k, i, t in texts for j, p in patterns if k == j and p and p in (t or "")}
    assert rows(found, "k", "at", "pattern") == sorted(want, key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_messages_and_unchecked_boxes(spark):
    messages = spark.createDataFrame([
        (1, 1, "<b>10</b>", "x", ["10", "20"]), (1, 2, "", "[a] RED pen sold out", ["10", "20", "30"]), (1, 3, "", "gone", ["30", "40"]), (1, 4, "", "gone", ["50", "60"]), (1, 5, "", "gone", ["99", "70"]), (2, 1, "10", "", None),
    ], "batch int, ord int, html string, text string, unchecked array<string>")
    requests = spark.createDataFrame([(1, p, n) for p, n in (("10", "Cup"), ("20", "[x] Red Pen"), ("30", None), ("40", ""), ("50", "q1"), ("60", "q2"), ("70", "q3"))] + [(2, "11", "z")], "batch int, productId string, productName string")
    assert rows(cart.sold_out_in_text(messages, requests), "batch", "ord", "productId", "found") == [(1, 1, "10", "id"), (1, 2, "20", "name"), (1, 3, "40", "unchecked"), (1, 5, "70", "unchecked")]


TASK = "batch long, key string, translateNameJa boolean, translateNameEn boolean, options array<struct<id:string,translateJa:boolean,translateEn:boolean>>"
ANSWER = "batch long, key string, nameJa string, nameEn string, options array<struct<id:string,ja:string,en:string>>"


def test_responses_of_waves(spark):
    sent = spark.createDataFrame([(0, "a", True, True, [("1", True, False), ("2", True, True)]), (0, "b", False, False, []), (1, "c", True, False, [("1", True, False)]), (2, "d", True, True, [])], TASK)
    received = spark.createDataFrame([(0, "a", "j", " ", [("1", "x", ""), ("1", "x", ""), ("3", "x", "")]), (0, "z", "", "", []), (1, "c", "j", None, [("1", "x", "")])], ANSWER)
    found = responses.problems(sent, received)
    assert rows(found, "batch", "key", "optionId", "reason") == sorted([
        (0, "a", None, "empty en"), (0, "a", "1", "duplicate option id"), (0, "a", "2", "missing option id"), (0, "a", "3", "unknown option id"), (0, "b", None, "missing key"), (0, "z", None, "unknown key"),
        (2, None, None, "other number of items"), (2, "d", None, "missing key"),
    ], key=repr)
    assert rows(responses.accepted(received, found), "key") == [("c",)]
    assert rows(responses.again(sent, found, ["key"], 3), "key", "batch", "wave", "attempt", "wait") == [("a", 0, 0, 3, 2), ("b", 0, 0, 3, 2), ("d", 0, 0, 3, 2)]
    assert responses.again(sent, found, ["key"], 4).count() == 0


def test_archive_options_after_the_products_own(spark):
    option = "array<struct<id:string,ko:string>>"
    products = spark.createDataFrame([("1", " ", [("9", "n"), ("2", "b")]), ("2", "own", []), ("3", "x", [])], f"productId string, nameKo string, options {option}")
    stored = spark.createDataFrame([("1", "A ", None, "e", [(" 1 ", "a", "j", None), ("2", "c", None, None), ("4", " ", None, None), ("1", "again", None, None), ("", "x", None, None)]), ("2", "own", "j", "e", None)],
                                   "id string, nameKo string, nameJa string, nameEn string, options array<struct<id:string,nameKo:string,nameJa:string,nameEn:string>>")
    items = translation.archive_items(stored)
    full = translation.with_archive_options(products, items, "detail")
    assert rows(full, "productId", "nameKo", "options") == [("1", "A", [("9", "n"), ("2", "b"), ("1", "a")]), ("2", "own", []), ("3", "x", [])]
    assert rows(translation.with_archive_options(products, items, "general"), "productId", "nameKo") == [("1", " "), ("2", "own"), ("3", "x")]
    # the last of an id is what the archive says of it; detail mode asks for no English options
    got = rows(translation.nested_tasks(full, items, "detail"), "key", "nameKo", "translateNameJa", "translateNameEn", "options")
    assert got == [("1", "A", True, False, [("9", "n", True, False), ("2", "b", True, False), ("1", "a", True, False)]), ("3", "x", True, True, [])]


@pytest.mark.parametrize("text,want", [
    ('_data = {"a":"}{\\\\"}; x', '{"a":"}{\\\\"}'), ("var _data={}; _data={1}", "{}"), ("my_data = {1}; _data\n=\n {2{3}}}", "{2{3}}"), ("_data = x {\"k\": \"\\\"{\"}", '{"k": "\\"{"}'),
    ("_data = 5", "no object"), ("_data = {{}", "incomplete"), ('_data = {"}', "incomplete"), ("nothing", "no assignment"), (None, "no assignment"),
])
def test_objects_of_scripts(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(fx.assigned(F.col("t")).alias("a"))
    r = df.first().a
    assert (r.json or r.error) == want and (r.json is None) != (r.error is None)


def test_long_scripts_are_read_once(spark):
    text = '_data = {"a": "' + "\\\\}" * 200_000 + '", "b": [' + '{"c": "{"},' * 30_000 + "0]}; rest" + "}" * 1000
    df = spark.createDataFrame([(text,)], "t string").select(fx.assigned(F.col("t"))["json"].alias("j"))
    began = time.time()
    got = df.first().j
    assert got == text[8 : text.index("; rest")] and time.time() - began < 20


def test_indented_json_is_what_json_gives(spark):
    schema = "a string, b struct<c:double,d:array<array<int>>,e:boolean>, f array<struct<g:string>>, h array<string>"
    data = [("é\"\\\n", (1.5, [[1, None], [], None], True), [], ["x", None]), (None, None, [("y",), None], None)]
    got = [json.loads(r.json) for r in sinks.pretty_json(spark.createDataFrame(data, schema)).collect()]
    text = sinks.pretty_json(spark.createDataFrame(data, schema)).first().json
    assert got == [{"a": "é\"\\\n", "b": {"c": 1.5, "d": [[1, None], [], None], "e": True}, "f": [], "h": ["x", None]}, {"a": None, "b": None, "f": [{"g": "y"}, None], "h": None}]
    assert text == json.dumps(got[0], indent=2, ensure_ascii=False)


def test_korean_order(spark):
    """Signs, digits, Hangul with Hanja among it, Latin: the order of ICU's Korean collation, ids by number, nulls as empty."""
    want = ["", None, "-", "[가]", "1", "10", "2", "ㄱ", "가", "가 나", "가-나", "가나", "각", "갂", "나", "漢", "힣", "abc", "ABC", "Abd", "é", "z"]
    data = [(n, "", "", "", str(i)) for i, n in enumerate(want)] + [("z", "", "", "", "x1"), ("z", "", "", "", "100")]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "categoryHint string, brandHint string, productName string, optionText string, productId string").repartition(5)
    got = inventory.ranked(df).orderBy("rank").collect()
    assert [r.categoryHint for r in got] == [*want, "z", "z"] and [r.productId for r in got][-2:] == ["100", "x1"] and [r.rank for r in got] == list(range(1, 25))


def test_coverage_of_no_rows(spark):
    schema = "productId string, optionId string, optionText string, hasOption boolean, selectedForCart boolean"
    none = spark.createDataFrame([], schema)
    r = coverage.coverage(none.select("productId"), none, none, none).first()
    assert (r.expectedProductCount, r.actualRowCount, r.expectedRowCount, r.rowCoverageAvailable, r.complete, r.optionCoverageComplete) == (0, 0, None, False, True, True)


def test_blocks_of_one_name_meet_once(spark):
    n = 60_000
    began = time.monotonic()
    blocks = spark.range(n).selectExpr("1 as batch", "id as blockId", "cast(array() as array<string>) as ids", "if(id = 0, 'Cup', 'Pen') as name")
    requests = spark.range(n).selectExpr("1 as batch", "cast(id as string) as productId", "if(id = 7, '[x] cup', 'pen') as productName")
    found = cart.match_blocks(blocks, requests)
    assert {(r.productId, r.matchMode) for r in found.filter("blockId < 9").collect()} == {("7", "name"), (None, "unresolved")}
    assert found.count() == n and time.monotonic() - began < 60  # all pairs of one name were 3.6 billion rows


def test_popup_elements_are_read_once_for_blocks(spark, popup_tables):
    """What matches and rows take of the blocks is stored: their plans don't read all elements again for each use."""
    els, requests = popup_tables
    options = spark.createDataFrame([], "page string, productId string, optionId string, quantity int")
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    products = popups.block_products(els, requests, ["page"])
    assert reads(products) == 0 and reads(popups.popup_rows(els, requests, options, ["page"], products=products)) <= 3


def test_messages_and_names_are_made_once(spark, sf):
    """Parts don't go to the driver, and texts of messages and names are stored before they are met."""
    from tallyard.plans.popups import _messages

    messages, requests = _messages(spark, sf)
    assert all("BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString() for df in (messages, requests))
    assert "regexp_replace" not in cart.sold_out_in_text(messages.limit(20), requests.limit(20))._jdf.queryExecution().optimizedPlan().toString()


def test_rate_scripts_are_cut_once(spark, sf):
    """The text of a script is searched once, not for each value read from it, and by all tasks where one block holds all pages."""
    from tallyard.plans.documents import _rate_pages

    pages = _rate_pages(spark, sf)
    assert pages.rdd.getNumPartitions() == 4
    assert fx.derived_rates(pages)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_grouped_rows_make_only_the_texts_they_use(spark):
    data = spark.createDataFrame([(1, " p", "a  b", "7", "t "), (2, "p", "a b", "7", "t")], "ord int, productId string, nameKo string, optionId string, optionText string").withColumn("hasOption", F.lit(True))
    products, options, _ = translation.group_rows(data)
    made = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(")
    assert (made(products), made(options)) == (2, 3)
    assert rows(products, "productId", "nameKo", "ord") == [("p", "a b", 1)] and rows(options, "productId", "optionId", "ko", "ord") == [("p", "7", "t", 1)]
