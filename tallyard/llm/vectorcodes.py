"""Compression of vectors to one small code for each of their parts, by partial-distance search.

Components become integers (4096 times the component, rounded down), so that every distance,
sum and mean is exact and does not depend on the order of rows. A vector is cut into ``PARTS``
equal parts; each part position has a codebook of ``ENTRIES`` entries, which starts as the
parts of the vectors of the smallest ids and is refined in ``ROUNDS`` rounds: every part goes
to its nearest entry, every entry becomes the mean of its parts, rounded down.

The nearest entry is searched by partial distances. One entry's distance is computed whole,
that which is nearest in the dimension of largest variance over the codebook; it is the best
complete distance of the vector. Dimensions are then added for all entries in descending
variance, and masks over whole batches drop each entry whose sum so far strictly exceeds that
distance, so ties stay in and go to the lower index. Most entries see few dimensions.

Each round is one pass over the rows: tasks return sums and counts of their parts, Spark adds
them up, and the driver gets the codebooks alone (parts x entries x dimensions numbers).

Defined results: rows whose vector is null or has a null, infinite or undefined component are
dropped. Vectors must have the same number of components, a multiple of ``PARTS``, of less
than 2**15 either way; others raise an error, as no codebook fits them. Equal ids start in the
order of their vectors, null ids come last, and rows with equal ids are coded each. With fewer
rows than entries, codebooks are shorter. Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.llm.common import lookup_join, materialise, slices

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components may be as large as this either way, so that sums over all dimensions stay exact.
LARGEST = 1 << 15

KEPT = "vec_id long, label string, vector binary"
SUMS = "part int, entry int, place int, total long, n long"
CODED = "vec_id long, label string, code string, error long"


def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label and the integer components (32 bits, little end first) of rows with finite vectors."""
    for batch in slices(batches):
        vectors = batch.column(2)
        if pa.types.is_fixed_size_list(vectors.type):
            vectors = vectors.cast(pa.list_(vectors.type.value_type))
        values = vectors.flatten()  # those of null vectors are left out
        sizes = np.array(vectors.value_lengths().fill_null(0))
        numbers = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(numbers))))
        ends = np.cumsum(sizes)
        good = np.asarray(vectors.is_valid()) & (bad[ends] == bad[ends - sizes])
        out = [np.floor(numbers[e - n : e] * SCALE) for e, n in zip(ends[good].tolist(), sizes[good].tolist(), strict=True)]
        if any(len(x) and abs(x).max() > LARGEST * SCALE for x in out):
            raise ValueError(f"a component is beyond {LARGEST}")
        mask = pa.array(good)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array([x.astype("<i4").tobytes() for x in out], pa.binary())], ["vec_id", "label", "vector"]
        )


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry of ``book`` nearest to each row of ``parts``, the lower index at ties."""
    n, dims = parts.shape
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    parts, book = parts[:, order].astype(np.int64), book[:, order].astype(np.int64)
    sums = (parts[:, :1] - book[:, 0]) ** 2
    seed = sums.argmin(axis=1)
    best = ((parts - book[seed]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= best[:, None])
    sums = sums[row, entry]
    for i in range(1, dims):
        sums = sums + (parts[row, i] - book[entry, i]) ** 2
        alive = sums <= best[row]  # the seed of each row stays
        row, entry, sums = row[alive], entry[alive], sums[alive]
    first = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(sums, first) if n else np.empty(0, np.int64)
    hits = np.flatnonzero(sums == least[row])
    return entry[hits[np.searchsorted(row[hits], np.arange(n))]], least


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    raw = column.to_pylist()
    if any(len(x) != 4 * dims for x in raw):
        raise ValueError(f"vectors must have {dims} components")
    return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), dims)


def _sums(books: np.ndarray):
    """Sums and counts of the parts of each entry, over all rows of the task."""
    count, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(books.shape, np.int64), np.zeros((count, entries), np.int64)
        for batch in slices(batches):
            vectors = _matrix(batch.column(0), count * width).reshape(-1, count, width)
            for part in range(count):
                entry, _ = nearest(vectors[:, part], books[part])
                np.add.at(total[part], entry, vectors[:, part])
                n[part] += np.bincount(entry, minlength=entries)
        part, entry = np.nonzero(n)
        rows = len(part)
        columns = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), rows), total[part, entry].reshape(-1), np.repeat(n[part, entry], width)]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "entry", "place", "total", "n"])

    return run


def _codes(books: np.ndarray):
    count, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            vectors = _matrix(batch.column(2), count * width).reshape(-1, count, width)
            found = [nearest(vectors[:, part], books[part]) for part in range(count)]
            raw = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            code = [raw[i : i + 2 * count] for i in range(0, len(raw), 2 * count)]
            error = sum(distance for _, distance in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def keep(vectors: DataFrame) -> DataFrame:
    """vec_id, label (as text) and integer components of the rows with finite vectors; frozen, as each round reads them."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector"))
    return materialise(own.mapInArrow(quantise, KEPT), "vectors")


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, dimensions of a part) after ``rounds`` rounds; None without rows."""
    first = kept.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        return None
    dims = len(first[0]["vector"]) // 4
    if not dims or dims % parts:
        raise ValueError(f"{dims} components don't make {parts} equal parts")
    start = _matrix(pa.array([bytes(r["vector"]) for r in first]), dims)
    books = np.ascontiguousarray(start.reshape(len(first), parts, dims // parts).transpose(1, 0, 2)).astype(np.int64)
    for _ in range(rounds):
        own = kept.select("vector").mapInArrow(_sums(books), SUMS)
        summed = own.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = books.copy()  # entries without parts stay
        for r in summed.collect():  # as many numbers as the codebooks have
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def compress(kept: DataFrame, books: np.ndarray | None) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error of each row of ``kept``."""
    if books is None:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    return kept.mapInArrow(_codes(books), CODED)


def digest(books: np.ndarray | None) -> str:
    """Hex digest of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, (books if books is not None else np.empty(0, np.int64)).reshape(-1).tolist())).encode()).hexdigest()


def coded(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (over rows with the same label) and codebooks_sha256 of each kept row."""
    kept = keep(vectors)
    books = train(kept)
    rows = materialise(compress(kept, books).withColumn("label_key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("null"))), "codes")
    of_label = materialise(rows.groupBy("label_key").agg(F.sum("error").alias("label_error")), "label-errors")
    joined = lookup_join(rows, of_label, "label_key", ["vec_id", "code"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
