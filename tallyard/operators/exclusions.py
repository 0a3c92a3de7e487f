"""Products left out of a run: reasons and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
BLOCKING = "(?i)captcha|access denied|forbidden|too many requests|\\b(403|429)\\b"
RETRYABLE = "(?i)timeout|timed out|net::|socket|econnreset|closed|temporar"
ABORTED = "(?i)abort|cancel"
MESSAGES = {
    "POPUP_COVERAGE_INCOMPLETE": "옵션 팝업 표시된 상품과 요청 상품 일치 실패",
    "BULK_SELECTION_NOT_STABLE": "상품 체크 상태 안정화 실패",
    "UNRESOLVED_UNAVAILABLE_PRODUCTS": "품절 팝업 식별 실패",
    "REQUESTED_OPTION_NOT_FOUND": "요청한 옵션을 찾지 못함",
    "OPTION_SELECTION_FAILED": "옵션 선택 실패",
    "NO_SELECTABLE_OPTIONS": "상품의 선택 가능한 옵션 없음",
    "OPTION_NOT_PURCHASABLE": "옵션 구매 불가",
    "QUANTITY_EXCEEDS_STOCK": "요청 수량이 재고를 초과",
}
OTHER_MESSAGE = "장바구니 담기 처리에서 예외 발생"


def reason_stats(rows: DataFrame, order: str = "ord", samples: int = 3) -> DataFrame:
    """reasonCode, count, the first ids in order, rank by count; ties as they came.

    Sample ids come from ranks within a reason, not from a gathered list of the reason's rows.
    """
    counts = rows.groupBy("reasonCode").agg(F.count("*").alias("count"), F.min(order).alias("at"), F.min_by("reason", order).alias("reason"))
    least = rows.groupBy("reasonCode", "productId").agg(F.min(order).alias("at"))
    rank = F.row_number().over(Window.partitionBy("reasonCode").orderBy("at", "productId"))
    first = least.withColumn("r", rank).filter(F.col("r") <= samples).groupBy("reasonCode").agg(F.array_sort(F.collect_list(F.struct("r", "productId"))).alias("s"))
    first = first.select("reasonCode", F.transform("s", lambda x: x["productId"]).alias("sampleIds"))
    by_count = Window.orderBy(F.col("count").desc(), "at")  # one row per reason
    return counts.join(first, "reasonCode").withColumn("rank", F.row_number().over(by_count)).drop("at")


def reason_text(stats: DataFrame) -> DataFrame:
    """All reasons in one line, by rank, with their counts and sample ids. ``stats`` has one row per reason."""
    ids = F.when(F.size("sampleIds") > 0, F.concat(F.lit(" ("), F.array_join("sampleIds", ", "), F.lit(")"))).otherwise("")
    part = F.concat(F.col("reason"), F.lit(" "), F.col("count").cast("string"), F.lit("건"), ids)
    listed = F.array_sort(F.collect_list(F.struct("rank", part.alias("t"))))
    return stats.agg(F.array_join(F.transform(listed, lambda x: x["t"]), "; ").alias("text"))


def reason_message(code: Column) -> Column:
    """What a reason code means."""
    known = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.coalesce(code, F.lit(""))), F.lit(OTHER_MESSAGE))


def warnings(rows: DataFrame) -> DataFrame:
    """page, reason, number of distinct products and a message."""
    n = F.count_distinct("productId")
    return rows.groupBy("page", "reason").agg(n.alias("count")).withColumn("message", F.format_string("%s (%d)", "reason", "count"))


def error_class(message: Column) -> Column:
    return F.when(message.rlike(ABORTED), "aborted").when(message.rlike(BLOCKING), "blocking").when(message.rlike(RETRYABLE), "retryable").otherwise("other")


def merged_batches(batches: DataFrame) -> DataFrame:
    """Numbers added, ids united, over the batches of a run."""
    ids = batches.select("run", F.explode("ids").alias("id")).distinct().groupBy("run").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return batches.groupBy("run").agg(F.sum("requested").alias("requested"), F.sum("added").alias("added")).join(ids, "run", "left")


def without(batch: DataFrame, excluded: DataFrame) -> DataFrame:
    return batch.join(excluded.select("productId").distinct(), "productId", "left_anti")
