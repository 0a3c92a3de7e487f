"""Documents of many blocks against a plain parse of the whole."""

import json
import random

import pytest

from tallyard.sources import json_arrays

DRAW = random.Random(4)


def value(depth=0):
    kind = DRAW.randrange(9 if depth < 3 else 6)
    if kind < 3:
        return "".join(DRAW.choice('ab{}[]",\\:\n é한😀') for _ in range(DRAW.randrange(12)))
    if kind < 6:
        return DRAW.choice([None, True, 3, -1.5e3, ""])
    if kind < 7:
        return [value(depth + 1) for _ in range(DRAW.randrange(4))]
    return {DRAW.choice(['k', 'a"b', "}{", "x\\", "ü"]) + str(i): value(depth + 1) for i in range(DRAW.randrange(4))}


def things(n):
    return [{"id": i, "name": value(), "more": value()} for i in range(n)]


SHAPES = {
    "list": lambda x: x,
    "wrapped list": lambda x: {"version": 1, "updatedAt": "a}b", "inventoryItems": x, "other": [{"id": -1}], "z": {"products": [{"id": -2}]}},
    "wrapped object": lambda x: {"products": {f'k"{t["id"]}': t for t in x}, "after": {"id": -1}},
    "object": lambda x: {"version": 2, **{f"k{t['id']}": t for t in x}, "updatedAt": "now"},
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("block", ["700", "64k", "128m"])
def test_records_are_those_of_a_plain_parse(spark, tmp_path, shape, indent, block):
    want = things(150)
    text = json.dumps(SHAPES[shape](want), indent=indent, ensure_ascii=indent is None)
    (tmp_path / "a.json").write_text(("﻿" if indent else "") + text + ("\n" if indent else ""), encoding="utf-8")
    (tmp_path / "b.json").write_text("[]" if shape == "list" else "{}", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = json_arrays.records(spark, str(tmp_path)).orderBy("file", "at").collect()
        parts = json_arrays.fragments(spark, str(tmp_path)).select("file", "block").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [json.loads(r.json) for r in got] == want
    assert [r.key for r in got] == {"list": [None] * 150, "wrapped list": [None] * 150, "wrapped object": [f'k"{i}' for i in range(150)], "object": [f"k{i}" for i in range(150)]}[shape]
    assert (parts > 10) == (block == "700")


def test_records_of_other_kinds(spark, tmp_path):
    """Plain values and lists are records without fields; blanks between commas are none; a record may be longer than many blocks."""
    (tmp_path / "a.json").write_text('[1, "x,y", [2, 3], {"id": "a"} , null,' + json.dumps({"id": "long", "text": "}" * 5000}) + "]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        found = json_arrays.records(spark, str(tmp_path))
        assert [json.loads(r.json) for r in found.orderBy("at").collect()] == [1, "x,y", [2, 3], {"id": "a"}, None, {"id": "long", "text": "}" * 5000}]
        rows = json_arrays.fields(found, {"id": "string", "text": "string"}).orderBy("at").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.id, r.text and len(r.text)) for r in rows] == [("a", None), ("long", 5000)]


def test_a_document_that_ends_early_fails(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2')
    with pytest.raises(Exception, match="don't end"):
        json_arrays.records(spark, str(tmp_path)).collect()
