"""Bucketed tables: what is rewritten, what a failure leaves, and streams that go on after one."""

import pytest
from pyspark.sql import functions as F

from tallyard.functions.schemas import PRODUCT
from tallyard.operators import archive
from tallyard.sources import buckets
from tallyard.streaming import progress

SCHEMA = "id string, n long"


def table(spark, path):
    return sorted(tuple(r) for r in buckets.read(spark, path, SCHEMA).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_an_update_writes_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path)
    assert table(spark, path) == []
    rows = [(str(i), i) for i in range(200)]
    buckets.update(path, frame(spark, rows), "id", buckets.replaced("id"), SCHEMA, buckets=16)
    first = buckets.manifest(spark, path, 1)[1]
    assert len(first) == 16 and table(spark, path) == sorted(rows)
    buckets.update(path, frame(spark, [("7", 70), ("new", 1)]), "id", buckets.replaced("id"), SCHEMA, buckets=99)
    count, second = buckets.manifest(spark, path, 2)
    assert count == 16 and 1 <= sum(first[b] != second[b] for b in first) <= 2
    assert table(spark, path) == sorted([(i, 70 if i == "7" else n) for i, n in rows] + [("new", 1)])


def test_a_failed_update_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    buckets.update(path, frame(spark, [("a", 1), ("b", 2)]), "id", buckets.replaced("id"), SCHEMA, 1, 4)
    with monkeypatch.context() as m:
        m.setattr(buckets, "_write_manifest", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            buckets.update(path, frame(spark, [("a", 10)]), "id", buckets.replaced("id"), SCHEMA, 2)
    assert table(spark, path) == [("a", 1), ("b", 2)] and buckets.versions(spark, path) == [1]
    (tmp_path / "manifests" / f"{2:012d}").mkdir()  # a manifest that was begun is no version
    assert table(spark, path) == [("a", 1), ("b", 2)]
    for _ in range(2):  # the second finds its version done
        buckets.update(path, frame(spark, [("a", 10)]), "id", lambda s, c: buckets.replaced("id")(s, c).withColumn("n", F.col("n") + 1), SCHEMA, 2)
    assert dict(table(spark, path))["a"] == 11 and buckets.versions(spark, path) == [1, 2]


def test_rows_that_go_and_folders_that_nothing_names(spark, tmp_path):
    path = str(tmp_path)
    buckets.update(path, frame(spark, [("a", 1), ("b", 2), ("c", 3)]), "id", buckets.replaced("id"), SCHEMA, buckets=1)
    for i in range(3):
        buckets.update(path, frame(spark, [("a", i)]), "id", lambda s, c: s.filter("id = 'c'"), SCHEMA)
    assert table(spark, path) == [("c", 3)]
    removed = buckets.clean(spark, path)
    assert len(removed) == 4 and table(spark, path) == [("c", 3)] and len(buckets.versions(spark, path)) == 2
    buckets.update(path, frame(spark, [("c", 0)]), "id", lambda s, c: s.limit(0), SCHEMA)
    assert table(spark, path) == []


def test_archive_in_buckets(spark, tmp_path):
    """The merge of the whole archive, while products that don't change keep their files."""
    path = str(tmp_path)
    stored = spark.createDataFrame([(str(i), f"n{i}", i) for i in range(300)], "id string, nameKo string, stockQuantity long")
    archive.update_buckets(stored.withColumn("inventoryObserved", F.lit(True)), path, "general", count=32)
    first = buckets.manifest(spark, path, 1)[1]
    incoming = spark.createDataFrame([("5", "n5", 5), (" 8 ", "new", 9), ("999", "x", 1), ("", "none", 1)], "id string, nameKo string, stockQuantity long").withColumn("inventoryObserved", F.lit(True))
    before = archive.read_buckets(spark, path)
    want = archive.merge(before, incoming, "general").select(*PRODUCT)
    want = sorted(map(repr, want.collect()))
    merged = archive.update_buckets(incoming, path, "general")
    states = {r.id: r.state for r in merged.collect()}
    assert (states["5"], states["8"], states["999"]) == ("unchanged", "updated", "new") and set(states.values()) <= {"kept", "unchanged", "updated", "new"}
    second = buckets.manifest(spark, path, 2)[1]
    assert sum(first.get(b) != f for b, f in second.items()) <= 2  # the unchanged product's bucket is not written
    assert sorted(map(repr, archive.read_buckets(spark, path).select(*PRODUCT).collect())) == want


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_a_stream_that_fails_and_goes_on_equals_the_batch(spark, sf, tmp_path, monkeypatch):
    """Files in any order, a failure after the rows are written, a restart in mid-stream, and new files later."""
    events = spark.read.parquet(f"{sf}/events.parquet").filter("event_id < 400")
    source, table_, state = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "state")
    for i in (2, 0):
        events.filter(f"event_id % 4 = {i}").coalesce(1).write.mode("append").parquet(source)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    run = lambda: progress.upsert_stream(spark, source, table_, state, files=1, schema=schema).awaitTermination()
    real, calls = buckets._write_manifest, []

    def failing(*args):
        calls.append(args[2])
        if len(calls) == 2:
            raise OSError("lost")
        real(*args)

    with monkeypatch.context() as m:
        m.setattr(buckets, "_write_manifest", failing)
        with pytest.raises(Exception, match="lost"):
            run()
    assert buckets.versions(spark, table_) == [1]
    run()  # the batch runs again
    for i in (3, 1):
        events.filter(f"event_id % 4 = {i}").coalesce(1).write.mode("append").parquet(source)
    run()
    want = progress.fold(progress.patches(events), "user_id", ["ts", "event_id"], progress.FIELDS)
    got = progress.upserted(spark, table_)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    assert buckets.versions(spark, table_) == [1, 2, 3, 4]
