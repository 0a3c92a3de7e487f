"""Pairs of id and name at any depth of JSON documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.functions.text import kst_day, year_start
from tallyard.sources.shared import frozen


def records(documents: DataFrame, key: str = "doc", column: str = "json") -> DataFrame:
    """Distinct (key, id, name) of all nodes that have both ``id`` and ``mft_itemName``.

    Arrays and objects are walked level by level until a level is empty, with no limit of rows or of
    depth here; each level is stored. Documents that are no JSON give nothing.
    """
    v = F.try_parse_json(F.col(column))
    level = frozen(documents.select(F.col(key).alias("doc"), v.alias("v")).filter("v is not null"), "shipping")
    found = []
    while not level.isEmpty():
        found.append(level.selectExpr("doc", "try_variant_get(v, '$.id', 'string') AS id", "try_variant_get(v, '$.mft_itemName', 'string') AS name"))
        inner = level.filter("schema_of_variant(v) LIKE 'OBJECT<%' OR schema_of_variant(v) LIKE 'ARRAY<%'")
        level = frozen(inner.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer())).select("doc", "value").withColumnRenamed("value", "v"), "shipping")
    rows = reduce(DataFrame.unionByName, found) if found else documents.select(F.col(key).alias("doc"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name")).limit(0)
    return rows.filter("id is not null and name is not null").dropDuplicates(["doc", "id", "name"]).withColumnRenamed("doc", key)


def date_ranges(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The year that ends on the local day of each time."""
    end = F.to_date(kst_day(F.col(ts)))
    return df.withColumn("endDay", end).withColumn("startDay", year_start(end))
