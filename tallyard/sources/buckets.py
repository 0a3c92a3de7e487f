"""Tables kept in buckets of a key. An update rewrites the buckets that it changes and swaps a manifest last.

    <path>/data/<version>-<id>/in_bucket=<n>/...   rows of a bucket
    <path>/manifests/<version>/...                 of each bucket, the folder that has it

The newest complete manifest is the table. A run that fails before its manifest is complete
leaves the table as it was; a version that is there already is not applied again, so a step may
be repeated. One writer at a time; readers keep the version they began with until ``clean``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.sources.shared import frozen

#: Buckets of a new table: the driver sees a row of each, a task holds none as a whole.
BUCKETS = 256
COLUMN = "in_bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _listed(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, ascending."""
    return [int(v) for v in _listed(spark, f"{path}/manifests") if "_SUCCESS" in _listed(spark, f"{path}/manifests/{v}")]


def manifest(spark: SparkSession, path: str, version: int) -> tuple[int, dict[int, str]]:
    """(number of buckets, folder of each bucket that has rows)."""
    rows = spark.read.schema("buckets int, bucket int, folder string").json(f"{path}/manifests/{version:012d}").collect()  # a row for each bucket
    return rows[0]["buckets"], {r["bucket"]: r["folder"] for r in rows if r["folder"]}


def _write_manifest(spark: SparkSession, path: str, version: int, buckets: int, folders: dict[int, str]) -> None:
    rows = [(buckets, -1, None), *((buckets, b, f) for b, f in sorted(folders.items()))]
    spark.createDataFrame(rows, "buckets int, bucket int, folder string").coalesce(1).write.mode("overwrite").json(f"{path}/manifests/{version:012d}")


def read(spark: SparkSession, path: str, schema: str, only: list[int] | None = None) -> DataFrame:
    """The table, or some of its buckets; no rows where there is no version yet."""
    known = versions(spark, path)
    folders = manifest(spark, path, known[-1])[1] if known else {}
    wanted = [f"{path}/{f}" for b, f in sorted(folders.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def update(
    path: str, changes: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], schema: str, version: int | None = None, buckets: int = BUCKETS, changed: Column | None = None,
) -> DataFrame | None:
    """Merges ``changes`` into the table and returns what ``merge`` made of the buckets they touch.

    ``merge(stored, changes)`` gets the rows of those buckets and gives all they shall hold. With
    ``changed``, a condition on its rows, buckets without such a row are left as they are. A
    ``version`` that is not above the newest was applied before: nothing is done (None).
    """
    spark = changes.sparkSession
    known = versions(spark, path)
    last = known[-1] if known else 0
    version = last + 1 if version is None else version
    if version <= last:
        return None
    folders: dict[int, str] = {}
    if known:
        buckets, folders = manifest(spark, path, last)
    changes = frozen(changes, "changes")
    touched = sorted(r[0] for r in changes.select(bucket_of(key, buckets)).distinct().collect())  # at most ``buckets``
    merged = frozen(merge(read(spark, path, schema, touched), changes), "merged")
    if changed is not None:
        touched = sorted(r[0] for r in merged.filter(changed).select(bucket_of(key, buckets)).distinct().collect())
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    own = merged.select(*names, bucket_of(key, buckets).alias(COLUMN)).filter(F.col(COLUMN).isin(touched))
    folder = f"data/{version:012d}-{uuid.uuid4().hex}"
    if touched:
        own.repartition(len(touched), COLUMN).write.partitionBy(COLUMN).parquet(f"{path}/{folder}")
    written = {int(x.split("=")[1]) for x in _listed(spark, f"{path}/{folder}") if x.startswith(f"{COLUMN}=")}
    kept = {b: f for b, f in folders.items() if b not in touched}
    _write_manifest(spark, path, version, buckets, kept | {b: f"{folder}/{COLUMN}={b}" for b in written})
    return merged


def replaced(key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that puts new rows in the place of those with the same key."""
    return lambda stored, new: stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*stored.columns))


def clean(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes what none of the newest ``keep`` versions names, and returns it."""
    known = versions(spark, path)
    used = {f.split("/")[1] for v in known[-keep:] for f in manifest(spark, path, v)[1].values()}
    old = [f"data/{x}" for x in _listed(spark, f"{path}/data") if x not in used] + [f"manifests/{v:012d}" for v in known[:-keep]]
    jvm = spark.sparkContext._jvm
    for x in old:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{x}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return old
