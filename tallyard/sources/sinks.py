"""Exports: CSV lines, JSON documents, run folders."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType, StructType

BOM = "﻿"


def ordered(df: DataFrame, header: list[str]) -> DataFrame:
    """The columns of a header, in order; missing ones are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in header])


def csv_field(c: Column, kind: DataType) -> Column:
    """Quoted text of a value; strings that a spreadsheet would run get a leading quote."""
    if isinstance(kind, BooleanType):
        text = F.when(c, "true").when(~c, "false")
    else:
        text = c.cast("string")
    if isinstance(kind, StringType):
        text = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(text, F.lit("")), '"', '""'), F.lit('"'))


def csv_lines(df: DataFrame, header: list[str]) -> DataFrame:
    """One column ``line``, the text of each row without the header."""
    rows = ordered(df, header)
    return rows.select(F.concat_ws(",", *[csv_field(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema]).alias("line"))


def write_csv(df: DataFrame, path: str, header: list[str], single: bool = False) -> None:
    """Text files of lines; ``single``: one file with mark and header, for small results."""
    lines = csv_lines(df, header)
    if single:
        head = df.sparkSession.createDataFrame([(0, BOM + ",".join(header))], "part int, line string")
        both = head.unionByName(lines.select(F.lit(1).alias("part"), "line"))
        lines = both.coalesce(1).sortWithinPartitions("part").select("line")
    lines.write.mode("errorifexists").text(path)


def without_field(df: DataFrame, name: str) -> DataFrame:
    """``df`` without columns or struct fields of this name at any depth."""
    def strip(c: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            kept = [strip(c[f.name], f.dataType).alias(f.name) for f in kind if f.name != name]
            return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
            return F.transform(c, lambda x: strip(x, kind.elementType))
        return c

    return df.select(*[strip(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema if f.name != name])


def json_lines(df: DataFrame) -> DataFrame:
    """One column ``line``: each row as JSON, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def pretty(c: Column, kind: DataType, depth: int = 0) -> Column:
    """A value as JSON text, two spaces for each level, a field or an element to a line; nulls are kept."""
    inner, outer = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    if isinstance(kind, StructType):
        fields = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), pretty(c[f.name], f.dataType, depth + 1)) for f in kind]
        text = F.concat(F.lit("{" + inner), F.concat_ws("," + inner, *fields), F.lit(outer + "}")) if fields else F.lit("{}")
    elif isinstance(kind, ArrayType):
        items = F.array_join(F.transform(c, lambda x: pretty(x, kind.elementType, depth + 1)), "," + inner)
        text = F.when(F.size(c) == 0, "[]").otherwise(F.concat(F.lit("[" + inner), items, F.lit(outer + "]")))
    else:
        own = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        text = F.substring(own, F.lit(6), F.length(own) - 6)
    return F.when(c.isNull(), "null").otherwise(text)


def pretty_json(df: DataFrame) -> DataFrame:
    """One column ``json``: each row as an indented object."""
    return df.select(pretty(F.struct("*"), df.schema).alias("json"))


def write_run(tables: dict[str, DataFrame], folder: str, mall: str, run_id: str) -> None:
    """A run's tables below ``folder``/mall/run/table."""
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{folder}/{mall}/{run_id}/{name}")
