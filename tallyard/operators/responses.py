"""Responses to batches of translation tasks: what is wrong, what is accepted, what is sent again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.functions.text import squash
from tallyard.operators.dedupe import numbered

#: Tasks of a batch, batches of a wave, attempts of a task, and seconds before the second attempt (doubled with each).
BATCH, WAVE, ATTEMPTS, WAIT = 100, 10, 3, 1


def problems(sent: DataFrame, received: DataFrame) -> DataFrame:
    """(batch, key, optionId, reason) of everything that is wrong with the responses to whole waves.

    ``sent`` has batch, key, translateNameJa, translateNameEn and options (id, translateJa,
    translateEn); ``received`` batch, key, nameJa, nameEn and options (id, ja, en). Keys and option
    ids are compared as multisets, by counts of either side. Names and options of a key that came
    twice, or was not asked for, are not looked at.
    """
    none = F.lit(None).cast("string")
    row = lambda df, reason, option=none: df.select("batch", "key", option.alias("optionId"), reason.alias("reason")).filter("reason is not null")
    got = received.groupBy("batch", "key").agg(F.count("*").alias("n"), F.first("nameJa").alias("nameJa"), F.first("nameEn").alias("nameEn"), F.first("options").alias("got"))
    asked = sent.select("batch", "key", "translateNameJa", "translateNameEn", F.col("options").alias("asked"))
    both = asked.withColumn("sent", F.lit(True)).join(got, ["batch", "key"], "full")
    keys = row(both, F.when(F.col("sent").isNull(), "unknown key").when(F.col("n").isNull(), "missing key").when(F.col("n") > 1, "duplicate key"))
    sizes = sent.groupBy("batch").agg(F.count("*").alias("asked")).join(received.groupBy("batch").agg(F.count("*").alias("got")), "batch", "left")
    counts = row(sizes.withColumn("key", none), F.when(F.coalesce("got", F.lit(0)) != F.col("asked"), "other number of items"))
    once = both.filter("sent and n = 1")
    empty = lambda flag, text: F.col(flag) & (squash(F.col(text)) == "")
    names = [row(once, F.when(empty("translateNameJa", "nameJa"), "empty ja")), row(once, F.when(empty("translateNameEn", "nameEn"), "empty en"))]
    flat = lambda column, fields: once.select("batch", "key", F.explode(column).alias("o")).select("batch", "key", F.col("o.id").alias("id"), *[F.col(f"o.{f}").alias(f) for f in fields])
    wanted = flat("asked", ("translateJa", "translateEn")).groupBy("batch", "key", "id").agg(F.bool_or("translateJa").alias("translateJa"), F.bool_or("translateEn").alias("translateEn"))
    came = flat("got", ("ja", "en")).groupBy("batch", "key", "id").agg(F.count("*").alias("n"), F.min(squash(F.col("ja"))).alias("ja"), F.min(squash(F.col("en"))).alias("en"))
    options = wanted.withColumn("sent", F.lit(True)).join(came, ["batch", "key", "id"], "full")
    reason = F.when(F.col("sent").isNull(), "unknown option id").when(F.col("n").isNull(), "missing option id").when(F.col("n") > 1, "duplicate option id")
    reason = reason.when(empty("translateJa", "ja"), "empty option ja").when(empty("translateEn", "en"), "empty option en")
    parts = [keys, counts, *names, row(options, reason, F.col("id"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def accepted(received: DataFrame, found: DataFrame) -> DataFrame:
    """Items of the batches that nothing is wrong with; a batch is taken as a whole or not at all."""
    return received.join(found.select("batch").distinct(), "batch", "left_anti")


def batched(tasks: DataFrame, order: list[str], attempt: int = 1) -> DataFrame:
    """``tasks`` with batch and wave, numbered from 0 without gaps, the attempt and the seconds to wait before it."""
    place = numbered(tasks, order, "place").withColumn("batch", F.floor((F.col("place") - 1) / BATCH)).withColumn("wave", F.floor(F.col("batch") / WAVE)).drop("place")
    return place.withColumn("attempt", F.lit(attempt)).withColumn("wait", F.lit(0 if attempt < 2 else WAIT * 2 ** (attempt - 2)))


def again(sent: DataFrame, found: DataFrame, order: list[str], attempt: int) -> DataFrame:
    """The tasks of failed batches in new batches, for ``attempt``; none beyond the last attempt."""
    failed = sent.drop("batch", "wave", "attempt", "wait").limit(0) if attempt > ATTEMPTS else (
        sent.join(found.select("batch").distinct(), "batch", "left_semi").drop("batch", "wave", "attempt", "wait")
    )
    return batched(failed, order, attempt)
