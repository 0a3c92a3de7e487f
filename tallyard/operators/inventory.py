"""Inventory rows and product summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyard.functions import rules
from tallyard.functions.text import first_text, squash
from tallyard.operators.dedupe import keep_first, running_total


def with_status(rows: DataFrame, threshold: int) -> DataFrame:
    """Adds stockStatus, effectivePrice, hasBoxDiscount and isSoldOut to rows of stock and prices."""
    status = rules.row_status(F.col("maxStock"), F.col("stockLimited"), threshold)
    return (
        rows.withColumn("stockStatus", status)
        .withColumn("effectivePrice", rules.effective_price(F.col("onePrice"), F.col("boxPrice")))
        .withColumn("hasBoxDiscount", rules.has_box_discount(F.col("onePrice"), F.col("boxPrice")))
        .withColumn("isSoldOut", status == rules.OUT)
    )


def summarise(rows: DataFrame, order: str = "ord", described_by: tuple[str, ...] = ()) -> DataFrame:
    """One row per product. ``described_by``: columns taken from its first row.

    A single pass with partial aggregation; option names are reduced to the first place of
    each distinct name before they are gathered, so a product's array holds its names only.
    """
    count_if = lambda c: F.count_if(c).cast("bigint")
    named = rows.filter(F.col("productId") != "")
    totals = named.groupBy("productId").agg(
        *[F.min_by(c, order).alias(c) for c in described_by],
        F.count("*").alias("rowCount"), count_if(F.col("hasOption")).alias("optionCount"), F.bool_or("hasOption").alias("hasOptions"),
        F.bool_or("hasBoxDiscount").alias("hasBoxDiscount"), F.sum(F.coalesce("maxStock", F.lit(0))).cast("bigint").alias("totalStock"),
        F.min("maxStock").alias("minStock"), F.max("maxStock").alias("maxStock"),
        F.sum(F.coalesce("requestedQty", F.lit(0))).cast("bigint").alias("requestedQtyTotal"),
        F.min("effectivePrice").alias("priceMin"), F.max("effectivePrice").alias("priceMax"),
        count_if(F.col("stockLimited")).alias("limitedRowCount"), count_if(F.col("stockStatus") == rules.LOW).alias("lowStockRowCount"),
        count_if(F.col("stockStatus") == rules.OUT).alias("outOfStockRowCount"),
    )
    names = named.filter(F.col("optionText") != "").groupBy("productId", "optionText").agg(F.min(order).alias("at"))
    names = names.groupBy("productId").agg(F.array_sort(F.collect_list(F.struct("at", "optionText"))).alias("n"))
    names = names.select("productId", F.array_join(F.transform("n", lambda x: x["optionText"]), " / ").alias("optionNames"))
    status = rules.product_status(F.col("rowCount"), F.col("outOfStockRowCount"), F.col("lowStockRowCount"), F.col("limitedRowCount"))
    return (
        totals.join(names, "productId", "left").withColumn("optionNames", F.coalesce("optionNames", F.lit("")))
        .withColumn("stockStatus", status).withColumn("isSoldOut", status == rules.OUT)
    )


def availability_rows(products: DataFrame) -> DataFrame:
    """Inventory rows of a mall that shows availability but no quantities."""
    sold_out = F.coalesce("isSoldOut", F.lit(False))
    return products.select(
        "productId", "productName",
        F.coalesce(first_text(F.col("brandHint"), rules.infer_brand(F.col("productName"))), F.lit("")).alias("brandHint"),
        F.coalesce(first_text(F.col("categoryHint"), rules.infer_category(F.col("productName"))), F.lit("")).alias("categoryHint"),
        F.lit("").alias("optionText"), F.lit(False).alias("hasOption"), F.lit(None).cast("bigint").alias("requestedQty"),
        F.lit(None).cast("bigint").alias("maxStock"), F.when(sold_out, rules.OUT).otherwise(rules.IN).alias("stockStatus"),
        F.lit(False).alias("stockLimited"), F.col("price").alias("effectivePrice"), sold_out.alias("isSoldOut"),
    )


def availability_summary(products: DataFrame) -> DataFrame:
    rows = availability_rows(products)
    out = F.col("isSoldOut").cast("bigint")
    return rows.select(
        "productId", "productName", "brandHint", "categoryHint", "stockStatus", F.lit(1).cast("bigint").alias("rowCount"),
        F.lit(0).cast("bigint").alias("optionCount"), out.alias("outOfStockRowCount"), F.col("effectivePrice").alias("priceMin"),
        F.col("effectivePrice").alias("priceMax"), "isSoldOut",
    )


def overlay_popup(cart: DataFrame, popup: DataFrame, order: str = "ord") -> DataFrame:
    """Cart rows with the option ids of the popup: first popup row per (product, option text)."""
    key = lambda text, has: F.when(F.coalesce(has, F.lit(False)) & (squash(text) != ""), squash(text)).otherwise("0")
    first = keep_first(popup.withColumn("_key", key(F.col("optionText"), F.col("hasOption"))), ["productId", "_key"], [order])
    first = first.select(
        "productId", "_key", F.col("optionId").alias("_optionId"), F.col("submitOptionId").alias("_submitOptionId"),
        F.col("hasOption").alias("_hasOption"), F.col("productName").alias("_productName"),
    )
    joined = cart.withColumn("_key", F.when(squash(F.col("optionText")) != "", squash(F.col("optionText"))).otherwise("0")).join(first, ["productId", "_key"], "left")
    return (
        joined.withColumn("optionId", F.coalesce("_optionId", "optionId")).withColumn("submitOptionId", F.coalesce("_submitOptionId", "submitOptionId"))
        .withColumn("hasOption", F.coalesce("_hasOption", "hasOption")).withColumn("productName", F.coalesce(F.nullif("_productName", F.lit("")), "productName"))
        .drop("_key", "_optionId", "_submitOptionId", "_hasOption", "_productName")
    )


def requested_problems(requests: DataFrame, popup: DataFrame) -> DataFrame:
    """Requests that the popup can't meet, with the first reason that holds."""
    joined = requests.join(popup, ["productId", "optionId"], "left")
    reason = (
        F.when(F.col("selectable").isNull(), "OPTION_NOT_FOUND").when(~F.col("selectable"), "OPTION_NOT_SELECTABLE")
        .when(F.col("requestedQty") > F.col("maxStock"), "QUANTITY_ABOVE_STOCK").when(~F.col("selectedForCart"), "OPTION_NOT_SELECTED")
    )
    return joined.select("productId", "optionId", "requestedQty", reason.alias("reason")).filter("reason is not null")


def unselectable_products(popup: DataFrame) -> DataFrame:
    """Products with popup rows none of which can be selected."""
    return popup.groupBy("productId").agg(F.bool_or("selectable").alias("any"), F.count("*").alias("rowCount")).filter("not any").drop("any")


def mark_unavailable(products: DataFrame, ids: DataFrame) -> DataFrame:
    """Products with the flags of those among ``ids`` set."""
    marks = ids.select("productId").distinct().withColumn("_marked", F.lit(True))
    joined = products.join(marks, "productId", "left")
    hit = F.coalesce("_marked", F.lit(False))
    return joined.withColumn("unavailableInCart", hit | F.coalesce("unavailableInCart", F.lit(False))).withColumn(
        "saleStatus", F.when(hit, "SOLD_OUT").otherwise(F.col("saleStatus"))
    ).drop("_marked")


def in_order(df: DataFrame, rank: str = "rank", names: tuple[str, ...] = ("categoryHint", "brandHint", "productName", "optionText"), locale: str = "ko") -> list[Column]:
    """Sort columns: names by locale, then ids by number and text."""
    return [F.collate(F.coalesce(F.col(c), F.lit("")), locale) for c in names] + [F.col("productId").try_cast("bigint").asc_nulls_last(), F.col("productId")]


def ranked(df: DataFrame, name: str = "rank", locale: str = "ko") -> DataFrame:
    """``df`` with each row's place in the order of ``in_order``: rows go to ranges of collation keys, and are numbered there."""
    return running_total(df, [], in_order(df, locale=locale), F.lit(1).cast("long"), name)
