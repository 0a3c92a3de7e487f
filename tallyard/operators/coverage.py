"""Reconciliation of expected against observed products and option rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyard.functions.text import squash


def row_key(product: Column, option_id: Column, option_text: Column, has_option: Column) -> Column:
    """``p::SINGLE``, ``p::OPTION:text``, ``p::OPTION:ID:id`` or ``p::OPTION:UNKNOWN``."""
    identity = F.when(squash(option_text) != "", squash(option_text)).when(squash(option_id) != "", F.concat(F.lit("ID:"), squash(option_id))).otherwise("UNKNOWN")
    return F.concat(squash(product), F.lit("::"), F.when(F.coalesce(has_option, F.lit(False)), F.concat(F.lit("OPTION:"), identity)).otherwise("SINGLE"))


def expected_products(products: DataFrame, unavailable: DataFrame) -> DataFrame:
    named = products.select(squash(F.col("productId")).alias("productId")).filter("productId <> ''").distinct()
    return named.join(unavailable.select(squash(F.col("productId")).alias("productId")), "productId", "left_anti")


def row_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """key, expected, actual, missing, extra of keys whose numbers of rows differ.

    Both sides are counted before they meet, so the full join sees one row per key.
    """
    e = expected.groupBy("key").agg(F.count("*").alias("expected"))
    a = actual.groupBy("key").agg(F.count("*").alias("actual"))
    both = e.join(a, "key", "full").select("key", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return both.filter("expected <> actual").select(
        "key", "expected", "actual", F.greatest(F.col("expected") - F.col("actual"), F.lit(0)).alias("missing"), F.greatest(F.col("actual") - F.col("expected"), F.lit(0)).alias("extra")
    )


def product_coverage(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """productId, observed: every expected product once."""
    seen = actual.select("productId").distinct().withColumn("observed", F.lit(True))
    return expected.join(seen, "productId", "left").withColumn("observed", F.coalesce("observed", F.lit(False)))


def coverage(products: DataFrame, popup: DataFrame, inventory: DataFrame, unavailable: DataFrame) -> DataFrame:
    """One row: numbers of products and rows, what is missing, and whether products and rows are complete.

    Rows count only if the popup selected any; a row mismatch is reported, not a failure.
    """
    expected = expected_products(products, unavailable)
    key = row_key(F.col("productId"), F.col("optionId"), F.col("optionText"), F.col("hasOption")).alias("key")
    side = lambda df, e, a: df.select("productId", key, F.lit(e).alias("e"), F.lit(a).alias("a"))
    both = side(popup.filter("selectedForCart"), 1, 0).unionByName(side(inventory, 0, 1))
    # once by key, once by product; both counts are ready before the expected products meet them
    by_key = both.groupBy("productId", "key").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    by_product = by_key.groupBy("productId").agg(
        F.sum("e").alias("e"), F.sum("a").alias("a"), F.count_if(F.col("e") > F.col("a")).alias("m"), F.count_if(F.col("e") < F.col("a")).alias("x"),
    )
    joined = expected.join(by_product, "productId", "left").select("productId", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("e", "a", "m", "x")])
    seen = F.col("a") > 0
    one = joined.agg(
        F.count("*").alias("expectedProductCount"), F.count_if(seen).alias("actualProductCount"), F.count_if(~seen).alias("missingProductCount"), F.coalesce(F.sum("a"), F.lit(0)).alias("actualRowCount"),
        F.count_if(seen & (F.col("m") + F.col("x") > 0)).alias("p"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("e", "m", "x")],
    )
    counted = F.col("e") > 0
    return one.select(
        "expectedProductCount", "actualProductCount", "missingProductCount", F.when(counted, F.col("e")).alias("expectedRowCount"), "actualRowCount",
        counted.alias("rowCoverageAvailable"), F.when(counted, F.col("m")).otherwise(0).alias("missingRowKeys"), F.when(counted, F.col("x")).otherwise(0).alias("extraRowKeys"),
        F.when(counted, F.col("p")).otherwise(0).alias("partialProductCount"), (F.col("missingProductCount") == 0).alias("complete"),
        (~counted | ((F.col("m") == 0) & (F.col("x") == 0))).alias("optionCoverageComplete"),
    )


def quality_gate(rows: DataFrame, excluded: Column, limit: float = 0.001) -> DataFrame:
    """total, excluded, share of excluded rows, and whether the run must stop."""
    out = rows.agg(F.count("*").alias("total"), F.count_if(excluded).alias("excluded"))
    return out.withColumn("abort", (F.col("total") > 0) & (F.col("excluded") >= limit * F.col("total")))


def excludable(blocks: DataFrame, most: int = 5) -> DataFrame:
    """Batches whose unresolved rows are all disabled, few, and the only trouble."""
    return blocks.withColumn(
        "excludable",
        (F.size("unresolved") > 0) & (F.size("disabled") <= most) & (F.size(F.array_except("unresolved", "disabled")) == 0) & (F.col("otherProblems") == 0),
    )
