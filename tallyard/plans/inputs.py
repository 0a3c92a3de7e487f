"""The test tables as catalogue tables, for Spark and, as views of the same shape, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.operators.inventory import with_status

#: Rows are ordered by all that tells them apart; rows equal in it are equal.
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inventory(spark: SparkSession, sf_dir: str, product: str = "l_partkey", shift: int = 0, threshold: int = 10) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(
        F.struct(*LINE_ORDER).alias("ord"), F.col(product).cast("string").alias("productId"), F.concat(F.lit("opt-"), F.col("l_suppkey").cast("string")).alias("optionText"),
        F.col("l_suppkey").cast("string").alias("optionId"), (F.col("l_linestatus") == "O").alias("hasOption"), F.col("l_linenumber").cast("bigint").alias("requestedQty"),
        (F.col("l_quantity") - shift).cast("bigint").alias("maxStock"), (F.col("l_returnflag") == "R").alias("stockLimited"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("onePrice"),
        F.when(F.col("l_discount") > 0.05, F.round(F.col("l_extendedprice") * 90).cast("bigint")).otherwise(F.lit(0)).cast("bigint").alias("boxPrice"),
    )
    return with_status(rows, threshold)


def inventory_sql(product: str = "l_partkey", shift: int = 0, threshold: int = 10) -> str:
    return f"""
      SELECT *, CASE WHEN boxPrice > 0 THEN boxPrice ELSE onePrice END AS effectivePrice, boxPrice > 0 AND boxPrice < onePrice AS hasBoxDiscount,
        stockStatus = 'OUT_OF_STOCK' AS isSoldOut
      FROM (SELECT *, CASE WHEN maxStock <= 0 THEN 'OUT_OF_STOCK' WHEN maxStock <= {threshold} THEN 'LOW_STOCK' WHEN stockLimited THEN 'LIMITED' ELSE 'IN_STOCK' END AS stockStatus
      FROM (SELECT row({", ".join(LINE_ORDER)}) AS ord, CAST({product} AS VARCHAR) AS productId, 'opt-' || CAST(l_suppkey AS VARCHAR) AS optionText,
        CAST(l_suppkey AS VARCHAR) AS optionId, l_linestatus = 'O' AS hasOption, CAST(l_linenumber AS BIGINT) AS requestedQty,
        CAST(l_quantity - {shift} AS BIGINT) AS maxStock, l_returnflag = 'R' AS stockLimited, CAST(round(l_extendedprice * 100) AS BIGINT) AS onePrice,
        CASE WHEN l_discount > 0.05 THEN CAST(round(l_extendedprice * 90) AS BIGINT) ELSE 0 END AS boxPrice FROM lineitem))"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("productId"), F.concat(F.lit("["), F.col("p_brand"), F.lit("] "), F.col("p_name")).alias("productName"),
        F.lit("").alias("brandHint"), F.col("p_type").alias("categoryHint"), (F.col("p_size") <= 5).alias("isSoldOut"),
        F.round(F.col("p_retailprice") * 10).cast("bigint").alias("price"), ((F.col("p_partkey") / 40).cast("int") + 1).alias("page"), F.col("p_partkey").alias("ord"),
    )


PRODUCTS_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS productId, '[' || p_brand || '] ' || p_name AS productName, '' AS brandHint, p_type AS categoryHint,
  p_size <= 5 AS isSoldOut, CAST(round(p_retailprice * 10) AS BIGINT) AS price, CAST(p_partkey // 40 AS INTEGER) + 1 AS page, p_partkey AS ord, p_brand, p_name FROM part"""


def cart_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.when(F.col("l_returnflag") == "R", "shop.mall-a.example").when(F.col("l_returnflag") == "A", "mall-b.example").otherwise("elsewhere.example")
    return read(spark, sf_dir, "lineitem").select(
        site.alias("site"), F.when(F.col("l_partkey") % 11 == 0, "x").otherwise(F.col("l_partkey").cast("string")).alias("productId"),
        F.when(F.col("l_suppkey") % 2 == 0, "").otherwise(F.col("l_suppkey").cast("string")).alias("optionId"), (F.col("l_quantity") - 3.5).alias("quantity"),
    )


CART_SQL = """SELECT site, productId, optionId, CAST(trunc(quantity) AS BIGINT) AS quantity,
  CASE WHEN site IS NULL OR site = 'elsewhere.example' THEN 'unknown site' WHEN NOT regexp_full_match(productId, '[0-9]+') THEN 'product id'
    WHEN site = 'mall-a.example' AND NOT regexp_full_match(optionId, '[0-9]+') THEN 'option id missing'
    WHEN site = 'mall-b.example' AND optionId <> '' AND optionId <> '0' THEN 'option id not allowed' WHEN trunc(quantity) < 1 THEN 'quantity' END AS reason
  FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'mall-a.example' WHEN l_returnflag = 'A' THEN 'mall-b.example' ELSE 'elsewhere.example' END AS site,
    CASE WHEN l_partkey % 11 = 0 THEN 'x' ELSE CAST(l_partkey AS VARCHAR) END AS productId, CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS optionId,
    l_quantity - 3.5 AS quantity FROM lineitem)"""
