"""Rows with values that are worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, kept: list[str], columns: dict[str, Column]) -> DataFrame:
    """The columns ``kept`` and ``columns`` (name: value) of ``df``.

    Conditions that name a column many times are otherwise rewritten to hold its expression as often,
    above and below each filter. What a generator gives isn't, so costly texts are made once for each row.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, however often that names it: the value is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def gathered(order: Column, value: Column) -> Column:
    """Aggregate: the values in the order of ``order``.

    ``array_sort`` makes a new comparison of structs for each pair it compares, ``sort_array`` one that is compiled.
    """
    return F.sort_array(F.collect_list(F.struct(order.alias("at"), value.alias("value"))))["value"]
