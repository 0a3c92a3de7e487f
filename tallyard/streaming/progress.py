"""Run progress: patches folded into the latest state, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyard.sources import buckets


def fold(events: DataFrame, run: str, order: list[str], fields: list[str]) -> DataFrame:
    """The last stated value of each field of each run; fields that a patch leaves out stay.

    The same plan runs on a stream: one state row per run.
    """
    at = F.struct(*order)
    return events.groupBy(run).agg(
        *[F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields], F.max(order[0]).alias("updatedAt"), F.count("*").alias("patches")
    )


def patches(events: DataFrame) -> DataFrame:
    """Event rows as patches: type, value and the number in props, each where stated."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return events.select("event_id", "ts", "user_id", "event_type", F.when(F.col("value") > 0, F.col("value")).alias("value"), k.alias("k"))


FIELDS = ["event_type", "value", "k"]


def stream_state(spark: SparkSession, sf_dir: str, checkpoint: str, name: str):
    """Folds the events files as a stream into the memory table ``name``; returns the query."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    folded = fold(patches(source), "user_id", ["ts", "event_id"], FIELDS)
    writer = folded.writeStream.outputMode("complete").format("memory").queryName(name)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scheduled(source: DataFrame, action, checkpoint: str, every: str | None = None):
    """Runs ``action(batch, id)`` on what is new: once, or by a period such as ``1 hour``."""
    writer = source.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


# --- keyed state ------------------------------------------------------------

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "user_id long, event_type string, value double, k long, updatedAt timestamp, patches long"


class RunState(StatefulProcessor):
    """The last stated value of each field of a run, with the place in the order where it was stated.

    Patches may come late: a value yields only to one stated later, whatever batch that is in.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        at = ", ".join(f"{f}_ts timestamp, {f}_id long" for f in FIELDS)
        self.state = handle.getValueState("run", f"event_type string, value double, k long, updatedAt timestamp, patches long, {at}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        old = self.state.get() if self.state.exists() else (None, None, None, None, 0, *[None] * (2 * len(FIELDS)))
        values, updated, patches = list(old[:3]), old[3], old[4]
        places = [tuple(old[5 + 2 * i : 7 + 2 * i]) for i in range(len(FIELDS))]
        for row in rows:
            at = (row["ts"], row["event_id"])
            patches += 1
            updated = at[0] if updated is None else max(updated, at[0])
            for i, field in enumerate(FIELDS):
                if row[field] is not None and (places[i][0] is None or at > places[i]):
                    values[i], places[i] = row[field], at
        self.state.update((*values, updated, patches, *(x for p in places for x in p)))
        yield Row(user_id=key[0], **dict(zip(FIELDS, values, strict=True)), updatedAt=updated, patches=patches)

    def close(self) -> None:
        pass


def keyed(stream: DataFrame) -> DataFrame:
    """A row of state for each run that a batch patches."""
    return stream.groupBy("user_id").transformWithState(RunState(), STATE, "Update", "None")


def upsert_stream(spark: SparkSession, folder: str, table: str, checkpoint: str, glob: str = "*.parquet", files: int | None = None, schema: str | None = None):
    """Folds the event files of ``folder`` into the bucketed table at ``table``: what is new, once; returns the query.

    Each batch is a version of the table, by its number, so a batch that runs again after a
    failure changes nothing that it has done. State is kept by run in the checkpoint.
    """
    reader = spark.readStream.schema(schema or spark.read.option("pathGlobFilter", glob).parquet(folder).schema).option("pathGlobFilter", glob)
    source = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)

    def apply(batch: DataFrame, number: int) -> None:
        buckets.update(table, batch, "user_id", buckets.replaced("user_id"), STATE, number + 1)

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return keyed(patches(source)).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def upserted(spark: SparkSession, table: str) -> DataFrame:
    """The states that ``upsert_stream`` has written."""
    return buckets.read(spark, table, STATE)
