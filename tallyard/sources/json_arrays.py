"""Huge JSON documents, one to a file, cut into their records by many tasks.

Files are read as text that ends at closing braces, so that Spark cuts them anywhere and each
task reads its own bytes. Whether such a block begins inside a string, and how deep, can't be
seen from within it. So a first pass counts quotes, and brackets for both ways that the block
may begin; sums over the blocks, one row each, give every block its state; a second pass cuts
records at the commas between them. What reaches over the ends of blocks is put together by
record. No task holds more than a record.

Three shapes are read: a list; an object that holds a list or an object of records under one of
``WRAPPERS`` (ahead of it stand plain values only, what follows is left out); and an object of
records by key. A document that ends before its records do fails the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyard.sources.shared import frozen

# fixed values
WRAPPERS = ("inventoryItems", "products")
#: Keys of an object of records that are none.
PLAIN = ("version", "updatedAt")

STRING = r'"(?:[^"\\]|\\.)*+"'
#: Strings (the group is empty if they don't end), brackets and commas; from inside a string, what is left of it. Escapes
#: count everywhere, so that a block read from the wrong side of a quote still counts the same quotes.
MARK = re.compile(r'"(?:[^"\\]|\\.)*+("?)|\\.|[\[\]{},]', re.S)
REST = re.compile(r'(?:[^"\\]|\\.)*+("?)', re.S)
WRAPPED = re.compile(rf'\s*\{{(?:\s*{STRING}\s*:\s*(?:{STRING}|[^\s,{{}}\[\]"]+)\s*,)*\s*"(?:{"|".join(WRAPPERS)})"\s*:\s*[\[{{]', re.S)
#: Characters of a document's start that tell its shape.
HEAD = 1 << 16

SUMMARY = "file string, block long, quotes int, out_depth long, out_least long, in_depth long, in_least long, level int, closes boolean"
PIECES = "file string, block long, seq long, text string, begins boolean, ends boolean"


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """file, block (its first byte) and text up to a closing brace, in the order of the file within a block."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.concat("value", F.lit("}")).alias("text"))


class _Scan:
    """Depth in a block that begins inside a string or not, counted from its start."""

    def __init__(self, inside: bool):
        self.inside, self.depth, self.least, self.most = inside, 0, 0, 0
        self.fell = [False, False]  # below 1 or 2, after it had been there

    def feed(self, text: str) -> None:
        at = 0
        if self.inside:
            m = REST.match(text)
            if not m[1]:
                return
            at, self.inside = m.end(), False
        for m in MARK.finditer(text, at):
            c = m[0][0]
            if c == '"':
                self.inside = not m[1]
            elif c == "\\":
                continue
            elif c in "[{":
                self.depth += 1
                self.most = max(self.most, self.depth)
            elif c != ",":
                self.depth -= 1
                self.least = min(self.least, self.depth)
                for level in (1, 2):
                    self.fell[level - 1] |= self.depth < level <= self.most


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = [x.split()[0] for x in SUMMARY.split(", ")], [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.bool_()]
    found: dict[tuple[str, int], tuple[_Scan, _Scan, list[str]]] = {}
    for batch in batches:
        for file, block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            outside, inside, head = found.setdefault((file, block), (_Scan(False), _Scan(True), []))
            outside.feed(text)
            inside.feed(text)
            if block == 0 and sum(map(len, head)) < HEAD:
                head.append(text)
    rows = []
    for (file, block), (outside, inside, head) in found.items():
        level = 2 if WRAPPED.match("".join(head).removeprefix("﻿")) else 1
        rows.append((file, block, int(outside.inside), outside.depth, outside.least, inside.depth, inside.least, level if block == 0 else None, outside.fell[level - 1] if block == 0 else None))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def states(blocks: DataFrame) -> DataFrame:
    """file, block, inside, depth, level and ``over`` (the records have ended before) of each block, by sums over its file's blocks."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    own = blocks.withColumn("inside", total("quotes") % 2 == 1).withColumn("level", F.max("level").over(Window.partitionBy("file")))
    own = own.withColumn("depth", total(F.when(F.col("inside"), F.col("in_depth")).otherwise(F.col("out_depth"))))
    least = F.col("depth") + F.when(F.col("inside"), F.col("in_least")).otherwise(F.col("out_least"))
    ended = F.coalesce("closes", least < F.col("level"))
    return own.select("file", "block", "inside", "depth", "level", F.coalesce(F.max(ended).over(before), F.lit(False)).alias("over"))


class _Cutter:
    """Pieces of records of one block, whose state at its start is known."""

    def __init__(self, file: str, block: int, inside: bool, depth: int, level: int, over: bool):
        self.file, self.block, self.inside, self.depth, self.level = file, block, inside, depth, level
        self.within, self.over = depth >= level and not over, over
        self.begun, self.part, self.rows, self.seq = False, list[str](), list[tuple](), 0

    def _emit(self, ends: bool) -> None:
        self.rows.append((self.file, self.block, self.seq, "".join(self.part), self.begun, ends))
        self.seq += 1
        self.part, self.begun = [], True

    def feed(self, text: str) -> None:
        if self.over:
            return
        at = start = 0
        if self.inside:
            m = REST.match(text)
            if m[1]:
                at, self.inside = m.end(), False
        for m in MARK.finditer(text, at) if not self.inside else ():
            c = m[0][0]
            if c == '"':
                self.inside = not m[1]
            elif c == "\\":
                continue
            elif c in "[{":
                self.depth += 1
                if self.depth == self.level and not self.within:
                    self.within, self.begun, start = True, True, m.end()
            elif c == ",":
                if self.within and self.depth == self.level:
                    self.part.append(text[start : m.start()])
                    self._emit(True)
                    start = m.end()
            else:
                self.depth -= 1
                if self.within and self.depth < self.level:
                    self.part.append(text[start : m.start()])
                    self._emit(True)
                    self.within, self.over = False, True
                    return
        if self.within:
            self.part.append(text[start:])

    def finish(self) -> None:
        if self.within:
            self._emit(False)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = [x.split()[0] for x in PIECES.split(", ")], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    cutter: _Cutter | None = None

    def taken() -> Iterator[pa.RecordBatch]:
        if cutter is not None and cutter.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cutter.rows, strict=True), types, strict=True)], names)
            cutter.rows = []

    for batch in batches:
        for file, block, text, *state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if cutter is None or (cutter.file, cutter.block) != (file, block):
                if cutter is not None:
                    cutter.finish()
                    yield from taken()
                cutter = _Cutter(file, block, *state)
            cutter.feed(text)
        yield from taken()
    if cutter is not None:
        cutter.finish()
        yield from taken()


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, at (block and number in it, which order a file's records), key (null in a list) and json of each record."""
    parts = fragments(spark, path)
    known = frozen(states(frozen(parts.mapInArrow(_summaries, SUMMARY), "json-blocks")), "json-states")
    pieces = frozen(parts.join(F.broadcast(known), ["file", "block"]).select("file", "block", "text", "inside", "depth", "level", "over").mapInArrow(_cut, PIECES), "json-pieces")
    whole = pieces.filter("begins and ends").select("file", F.struct("block", "seq").alias("at"), "text")
    torn = pieces.filter("not (begins and ends)")
    # two pieces for each block at most; they are numbered without their texts
    order = Window.partitionBy("file").orderBy("block", "seq")
    record = torn.select("file", "block", "seq", F.sum(F.col("begins").cast("int")).over(order).alias("record"))
    joined = torn.join(record, ["file", "block", "seq"]).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "seq", "text", "ends"))).alias("parts")
    )
    ended = F.element_at("parts", -1)["ends"]
    text = F.when(ended, F.array_join(F.transform("parts", lambda p: p["text"]), "")).otherwise(F.raise_error(F.concat(F.lit("the records don't end: "), "file")))
    first = F.col("parts")[0]
    rows = whole.unionByName(joined.select("file", F.struct(first["block"].alias("block"), first["seq"].alias("seq")).alias("at"), text.alias("text")))
    entry = rf"(?s)^\s*({STRING})\s*:(.*)$"
    keyed = F.col("text").rlike(entry)
    key = F.when(keyed, F.try_variant_get(F.try_parse_json(F.regexp_extract("text", entry, 1)), "$", "string"))
    json = F.trim(F.when(keyed, F.regexp_extract("text", entry, 2)).otherwise(F.col("text")))
    found = rows.filter(~F.col("text").rlike(r"^\s*$")).select("file", "at", key.alias("key"), json.alias("json"))
    return found.filter(F.col("key").isNull() | ~F.col("key").isin(*PLAIN))


def fields(found: DataFrame, names: dict[str, str]) -> DataFrame:
    """file, at, key and the named fields of records that are objects; one of another type than named is null."""
    v = F.try_parse_json("json")
    return found.select("file", "at", "key", v.alias("v")).filter("schema_of_variant(v) LIKE 'OBJECT<%'").select(
        "file", "at", "key", *[F.try_variant_get("v", f"$.{n}", t).alias(n) for n, t in names.items()]
    )


def identified(rows: DataFrame, column: str = "id") -> DataFrame:
    """``rows`` with the key of an object of records where a record has no id of its own."""
    own: Column = F.col(column).cast("string")
    return rows.withColumn(column, F.when(F.trim(own) != "", own).otherwise(F.col("key")))
