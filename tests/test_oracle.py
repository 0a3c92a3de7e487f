"""Every query with SQL gives DuckDB's rows; every query without it runs."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tallyard.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_matches_sql(name, spark, sf, duck):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ours == sorted(repr(tuple(plain(row[i]) for i in at)) for row in found.fetchall())


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLE_SQL])
def test_runs(name, spark, sf):
    entry.queries()[name](spark, sf).count()


def test_entry(spark):
    assert entry.entry(spark).count() == 200


def test_plans_push_down_and_prune(spark, sf):
    plan = catalogue.QUERIES["requested_products"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)" in plan
    assert "ReadSchema: struct<p_partkey:bigint>" in plan
