"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go when a local session names no shared folder.
DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints/tallyard"

#: Rows that a side may have to be broadcast; beyond it the join is a shuffle.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    os.makedirs(DEFAULT_CHECKPOINT_DIR, exist_ok=True)
    return f"file://{DEFAULT_CHECKPOINT_DIR}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Cuts the lineage: a lost executor costs a re-read of a Parquet file, not a
    recomputation, and a non-deterministic input is frozen.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that one slice holds about ``max_bytes``, one row at least.

    Memory then follows the longest row rather than the batch size of the session.
    """
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * max_bytes / max(1, batch.nbytes)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def quoted(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores after it until none of ``columns`` is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def extended(df: DataFrame, kept: list[str], source: Column, added: dict[str, str], run: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """The columns ``kept`` of ``df``, whatever their names, and ``added`` ones (name: type), which ``run`` gives for batches of ``source``."""
    own = df.select(*(F.col(quoted(c)) for c in kept), source)
    types = [f"{quoted(c)} {own.schema[i].dataType.simpleString()}" for i, c in enumerate(kept)] + [f"{quoted(c)} {t}" for c, t in added.items()]
    names = [*kept, *added]

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, *run(batch.column(len(kept)))], names)

    return own.toDF(*(f"c{i}" for i in range(len(kept) + 1))).mapInArrow(batches_of, ", ".join(types))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks ``df`` for broadcast if it has at most ``limit`` rows (counted), else leaves it."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def lookup_join(
    left: DataFrame, right: DataFrame | Callable[[Column], DataFrame], key: str, spread_by: list[str], how: str = "inner",
    share: float = 0.002, floor: int = 500, salts: int = 32,
) -> DataFrame:
    """Joins ``left`` to ``right``, which has one row per ``key``, whatever the skew of ``left``.

    Keys holding at least ``share`` of the rows of ``left`` (1/share keys at most, so
    the list is bounded) are joined on (key, salt), with their rows of ``right`` repeated
    once for each salt; all other keys take a plain join. ``left`` should be materialised:
    it is read three times. ``right`` may be a function that gives its rows of a condition on
    the key, if it is cheaper to make them than to filter them.
    """
    pick = right if callable(right) else right.filter
    total = left.count()
    counted = left.groupBy(key).count().filter(F.col("count") >= max(floor, total * share))
    heavy = [r[0] for r in counted.filter(F.col(key).isNotNull()).select(key).collect()]
    if not heavy:
        return left.join(pick(F.lit(True)), key, how)
    hot = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    salt = unused("salt", left.columns)
    salted = left.filter(hot).withColumn(salt, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = pick(hot).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        left.filter(~hot).join(pick(~hot), key, how)
        .unionByName(salted.join(copies, [key, salt], how).drop(salt))
    )
