"""JSON inputs: inventory files, archives, translation files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.functions.schemas import PRODUCT


def items(documents: DataFrame, fields: dict[str, str], column: str = "json") -> DataFrame:
    """One row per item of documents that are a list, or hold one in inventoryItems or products."""
    v = F.try_parse_json(F.regexp_replace(F.col(column), "^﻿", ""))
    lists = [F.try_variant_get(v, p, "array<variant>") for p in ("$", "$.inventoryItems", "$.products")]
    kept = [c for c in documents.columns if c != column]
    rows = documents.select(*kept, F.posexplode(F.coalesce(*lists)).alias("ord", "v"))
    return rows.select(*kept, "ord", *[F.try_variant_get("v", f"$.{n}", t).alias(n) for n, t in fields.items()])


def archive(documents: DataFrame, column: str = "json") -> DataFrame:
    """Products of archive documents: a list, ``{products: {...}}`` or a bare map by id."""
    v = F.try_parse_json(F.regexp_replace(F.col(column), "^﻿", ""))
    as_list = F.try_variant_get(v, "$", "array<variant>")
    as_map = F.coalesce(F.try_variant_get(v, "$.products", "map<string,variant>"), F.try_variant_get(v, "$", "map<string,variant>"))
    each = F.explode(F.coalesce(as_list, F.map_values(as_map))).alias("v")
    simple = {n: t for n, (t, _) in PRODUCT.items() if t in ("string", "bigint", "int", "double", "boolean")}
    return documents.select(each).select(*[F.try_variant_get("v", f"$.{n}", t).alias(n) for n, t in simple.items()]).filter("id is not null")
