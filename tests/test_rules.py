"""Golden cases of scalar rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyard.functions import rules, text


def value(spark, column, **inputs):
    types = {str: "string", bool: "boolean", int: "bigint", float: "double", dt.datetime: "timestamp", dt.date: "date", type(None): "string"}
    frame = spark.createDataFrame([tuple(inputs.values()) or (0,)], ", ".join(f"{k} {types[type(v)]}" for k, v in inputs.items()) or "i int")
    return frame.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("given,want", [("1,234원", 1234), ("1,234.56", 123456), ("-5", -5), ("12-3", 0), ("", 0), (None, 0), ("12,000 ~ 15,000", 1200015000)])
def test_to_number(spark, given, want):
    assert value(spark, text.to_number(F.col("x")), x=given) == want


@pytest.mark.parametrize("given,want", [(None, None), ("", None), ("  ", 0), ("12", 12), ("1e3", 1000), ("abc", None)])
def test_to_nullable_number(spark, given, want):
    assert value(spark, text.to_nullable_number(F.col("x")), x=given) == want


@pytest.mark.parametrize("given,want", [("12,900원", 12900), ("10~20", 10), ("무료", None), ("1500.5", 1500.5), ("-3.5%", -3.5)])
def test_to_price(spark, given, want):
    found = value(spark, text.to_price(F.col("x")), x=given)
    assert (None if found is None else float(found)) == want


@pytest.mark.parametrize("given,want", [("판매가 12,900원 (10%)", 12900), ("무료", 0), (None, 0)])
def test_parse_price(spark, given, want):
    assert value(spark, text.parse_price(F.col("x")), x=given) == want


def test_names(spark):
    assert value(spark, text.product_name(F.col("x")), x="  볼펜  바로가기 ") == "볼펜"
    assert value(spark, text.comparable_name(F.col("x")), x="[A] B　c D") == "bcd"
    assert value(spark, text.squash(F.col("x")), x="﻿a   b\u0085") == "a b\u0085"


@pytest.mark.parametrize("given,want", [("[산리오] 볼펜", "산리오"), ("코리락쿠마 인형", "리락쿠마"), ("brunch brother 컵", ""), ("크라운볼펜 산리오", "크라운볼펜")])
def test_brand(spark, given, want):
    assert value(spark, rules.infer_brand(F.col("x")), x=given) == want


@pytest.mark.parametrize("given,want", [("헬로키티 볼펜", "문구/필기구"), ("도시락 케이스", "수납/정리"), ("유리볼", "주방/도시락/식기"), ("poster book A4", "도서/학습"), ("기타", "미분류")])
def test_category(spark, given, want):
    assert value(spark, rules.infer_category(F.col("x")), x=given) == want


@pytest.mark.parametrize("given,want", [("연필 12개 1세트", (12, "세트", "12개 1세트")), ("볼펜 10개", (10, "개", "10개")), ("10개 묶음", (10, "개", "10개 ")), ("2개p", (2, "p", "2개p")), ("3p", (1, "", ""))])
def test_package(spark, given, want):
    assert tuple(value(spark, rules.package_info(F.col("x")), x=given)) == want


@pytest.mark.parametrize("stock,limited,want", [(0, True, "OUT_OF_STOCK"), (10, True, "LOW_STOCK"), (11, True, "LIMITED"), (11, False, "IN_STOCK"), (-1, False, "OUT_OF_STOCK")])
def test_row_status(spark, stock, limited, want):
    assert value(spark, rules.row_status(F.col("s"), F.col("l"), 10), s=stock, l=limited) == want


@pytest.mark.parametrize("quantity,statuses,out,want", [(0, "", False, "OUT_OF_STOCK"), (10, "", False, "LOW_STOCK"), (11, "", False, "IN_STOCK"), (None, "LIMITED", False, "IN_STOCK"), (None, "", False, ""), (50, "", True, "OUT_OF_STOCK")])
def test_backend_status(spark, quantity, statuses, out, want):
    q = F.lit(quantity).cast("bigint")
    assert value(spark, rules.backend_status(q, F.split("s", ","), 10, F.lit(out)), s=statuses) == want


def test_prices_and_categories(spark):
    for one, box, price, less in ((100, 0, 100, False), (100, 80, 80, True), (100, 120, 120, False)):
        assert value(spark, rules.effective_price(F.col("o"), F.col("b")), o=one, b=box) == price
        assert value(spark, rules.has_box_discount(F.col("o"), F.col("b")), o=one, b=box) is less
    assert value(spark, rules.last_category(F.col("a"), F.col("h")), a="A > B › C", h="x") == "C"
    assert value(spark, rules.last_category(F.col("a"), F.col("h")), a="", h="문구/필기구") == "문구/필기구"


@pytest.mark.parametrize("ms,want", [(999, "999ms"), (1500, "1.50s"), (61500, "1m 1.5s")])
def test_format_ms(spark, ms, want):
    assert value(spark, text.format_ms(F.col("x")), x=ms) == want


def test_dates(spark):
    assert value(spark, text.kst_minute(F.col("x")), x=dt.datetime(2026, 8, 20, 15, 30)) == "2608210030"
    assert value(spark, text.year_start(F.col("x")), x=dt.date(2024, 2, 29)) == dt.date(2023, 3, 1)
    assert value(spark, text.ms_to_next_hour(F.col("x")), x=dt.datetime(2026, 8, 20, 15, 59, 59)) == 1000


@pytest.mark.parametrize("url,want", [("/a/b.html?x=1", "https://h.example/a/b.html?x=1"), ("data:xx", ""), ("", ""), ("//c.example/y", "https://c.example/y"), ("http://z.example/q", "http://z.example/q"), ("p.html", "https://h.example/p.html")])
def test_absolute_url(spark, url, want):
    assert value(spark, text.absolute_url(F.col("x"), "https", "h.example"), x=url) == want
