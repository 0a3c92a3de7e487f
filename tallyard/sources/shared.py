"""Tables written once and read again, in the folder that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where they go when a local session names no shared folder.
LOCAL_DIR = "/tmp/checkpoints/tallyard"


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir`` of the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        os.makedirs(LOCAL_DIR, exist_ok=True)
        base = f"file://{LOCAL_DIR}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def frozen(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table: several readers see the same rows, and a lost executor costs a re-read."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` over as many tasks as shuffles have, also where it is small: for rows that cost much work each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
