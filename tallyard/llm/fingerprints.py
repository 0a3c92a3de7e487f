"""Fingerprints from prefix polynomial hashes.

With a base B and a prime M = 2**31 - 1 a text of code points c_j has the prefix array

    P[i] = sum over j < i of (c_j + 1) * B**j  mod M

so the hash of any span is (P[r] - P[l]) * B**-l mod M: spans are compared in constant
time, and the longest common extension of two positions is found by binary search. Two
bases are used where equality is decided.

A text's fingerprint is its length, the two hashes of the whole, and a sketch: of the
hashes of all spans of ``SPAN`` code points, mixed to 64 bits, the smallest in each of
``SLOTS`` classes (one permutation, densified). The share of equal slots estimates the
Jaccard likeness of the sets of spans. Texts below ``BOTH`` code points have a second sketch,
of spans of ``SHORT``: likeness is told from those where one text is below ``FEW``, as such
texts have few long spans, or one, and any edit would change them all.

Defined results: null text is empty; texts shorter than a span have one span, the
whole; two empty texts are alike (1.0), an empty and a filled one are not (0.0); repeated
rows stand next to each other in the order; the document after the last is the first,
which for a single row is itself; null doc_ids come last in descending order; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyard.llm.common import slices, text_of

M = np.uint64((1 << 31) - 1)
BASES = (1_000_003, 700_001_027)
SPAN, SHORT = 24, 3
FEW, BOTH = 96, 384
SLOTS = 32
#: Bytes of text in a range, about; ranges at most (then they hold more): the driver sees two numbers and one row of each.
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 15


def _reduce(x: np.ndarray) -> np.ndarray:
    """x mod 2**31 - 1 for x < 2**63, without division."""
    x = (x & M) + (x >> np.uint64(31))
    x = (x & M) + (x >> np.uint64(31))
    return np.where(x >= M, x - M, x)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod M for i < n, kept and doubled as texts ask for it."""
    have = _TABLES.get(base)
    if have is None or len(have[0]) < n:
        size, out = 1 << max(12, int(n - 1).bit_length()), []
        for b in (base, pow(base, -1, int(M))):
            t = np.ones(1, np.uint64)
            while len(t) < size:
                t = np.concatenate((t, _reduce(t * np.uint64(pow(b, len(t), int(M))))))
            out.append(t)
        _TABLES[base] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


class Prefixes:
    """Modular prefix arrays of one text."""

    def __init__(self, text: str, bases: tuple[int, ...] = BASES):
        self.text, self.n, self.bases = text, len(text), bases
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.sums = []
        for base in bases:
            # terms stay below 2**31 and 2**32 of them fit a 64-bit sum
            terms = _reduce(codes * powers(base, max(self.n, 1))[0][: self.n])
            self.sums.append(_reduce(np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))))

    def span(self, left: int, right: int) -> tuple[int, ...]:
        """Hashes of text[left:right]; equal spans, equal hashes, wherever they stand."""
        m = int(M)
        return tuple(
            (int(s[right]) - int(s[left])) % m * int(powers(b, left + 1)[1][left]) % m for b, s in zip(self.bases, self.sums, strict=True)
        )

    def windows(self, width: int) -> np.ndarray:
        """Hash (first base) of every span of ``width`` code points; of the whole if that is shorter."""
        s, base = self.sums[0], self.bases[0]
        width = min(width, self.n)
        if not width:
            return np.empty(0, np.uint64)
        count = self.n - width + 1
        return _reduce(_reduce(s[width:] + M - s[:count]) * powers(base, count)[1])


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common span that starts at a[i] and b[j]."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if a.span(i, i + mid) == b.span(j, j + mid):
            low = mid
        else:
            high = mid - 1
    return low


def sketch(prefixes: Prefixes, width: int = SPAN) -> np.ndarray:
    """Smallest mixed span hash of each of SLOTS classes; empty classes borrow from the next."""
    x = prefixes.windows(width)
    if not len(x):
        return np.zeros(SLOTS, np.uint32)
    x = (x ^ (x >> np.uint64(15))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    slot = (x & np.uint64(SLOTS - 1)).astype(np.int64)
    value = x >> np.uint64(32)
    best = np.full(SLOTS, 1 << 32, np.uint64)
    # the smallest of a class is nearly always among the smallest of all: those are sorted, the rest only if a class got none
    few = np.flatnonzero(value < np.uint64(min(1 << 32, (16 * SLOTS << 32) // len(x))))
    few = few[np.argsort(value[few], kind="stable")]
    classes, first = np.unique(slot[few], return_index=True)
    best[classes] = value[few[first]]
    if len(classes) < SLOTS and len(few) < len(x):
        np.minimum.at(best, slot, value)
        classes = np.flatnonzero(best < 1 << 32)
    if len(classes) < SLOTS:
        filled = np.flatnonzero(best < 1 << 32)
        for k in np.flatnonzero(best == 1 << 32):
            donor = filled[np.searchsorted(filled, k) % len(filled)]
            best[k] = (best[donor] + np.uint64(((donor - k) % SLOTS) * 0x9E3779B1)) & np.uint64(0xFFFFFFFF)
    return best.astype(np.uint32)


def fingerprint(prefixes: Prefixes) -> str:
    whole = prefixes.span(0, prefixes.n)
    sketches = [sketch(prefixes, width).astype(">u4").tobytes().hex() for width in ((SPAN, SHORT) if prefixes.n < BOTH else (SPAN,))]
    return "-".join([f"{prefixes.n:x}", f"{whole[0]:08x}{whole[1]:08x}", *sketches])


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone."""
    if a == b:
        return 1.0
    (na, _, *sa), (nb, _, *sb) = a.split("-"), b.split("-")
    if na == "0" or nb == "0":
        return 0.0
    which = int(len(sa) == len(sb) == 2 and min(int(na, 16), int(nb, 16)) < FEW)
    x, y = (np.frombuffer(bytes.fromhex(s[which]), ">u4") for s in (sa, sb))
    return float((x == y).mean())


def edit(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


COLUMNS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "common_prefix long"
)


def _row(doc, text: str, own: Prefixes, mark: str, after: str, next_mark: str) -> tuple:
    edited = edit(text, after)
    changed = Prefixes(edited)
    edited_mark = mark if edited == text else fingerprint(changed)
    return (
        doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, edited_mark,
        likeness(mark, edited_mark), likeness(mark, next_mark), common_extension(own, 0, changed, 0),
    )


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole ranges in descending order, each closed by the head of the next range."""
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    held = None
    for batch in slices(batches):
        rows = []
        for range_id, doc, text, closing in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = Prefixes(text)
            mark = fingerprint(own)
            if held is not None and held[0] == range_id:
                rows.append(_row(*held[1:], text, mark))
            held = None if closing else (range_id, doc, text, own, mark)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def compare_neighbours(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each document and its edited text, and likeness to it and the next document.

    Documents are dealt out by ranges of doc_id, one to a task, whose bounds are quantiles of
    all ids; their number follows the bytes of the texts. An id with many rows gets several
    ranges, by text hash. A range's rows are read in order by one task, and the first row of
    the next range is sent along to close it. No task sees more than a range and no text moves
    twice.
    """
    spark = docs.sparkSession
    # a null id is below all others
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), text_of().alias("text"))
    if not ranges:
        size = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        ranges = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES), MOST_RANGES)
    cuts = source.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 4 * ranges))).first()[0] or []
    # several equal cuts are one id with many rows: its ranges are even parts of the hashes
    ties = Counter(cuts)
    bounds = [(k, (1 << 63) - 1 - (i << 64) // n) for k, n in ties.items() for i in range(n)]
    bounds.sort(reverse=True)
    hashed = source.withColumn("hash", F.xxhash64("text"))
    ranged = hashed.withColumn("range", _search(F.col("key"), F.col("hash"), bounds))
    order = [F.col("key").desc(), F.col("hash").desc(), F.col("text").desc()]
    place = F.struct("key", "hash")
    top = ranged.groupBy("range").agg(F.max(place).alias("top")).collect()  # one row per range
    top = sorted(((r["range"], r["top"]["key"], r["top"]["hash"]) for r in top), key=lambda x: x[0])
    if not top:
        return spark.createDataFrame([], COLUMNS)
    before = [(top[i - 1][0], top[i][1], top[i][2]) for i in range(len(top))]  # the head of range i closes the one before; the first closes the last
    heads = spark.createDataFrame(before, "closes int, key long, hash long")
    firsts = ranged.select("key", "hash", "doc_id", "text").join(F.broadcast(heads), ["key", "hash"])
    # among rows of one place, the first in the order
    firsts = firsts.groupBy("closes").agg(F.max(F.struct("text", "doc_id")).alias("f"))
    closing = firsts.select(
        F.col("closes").alias("range"), F.lit(-(1 << 63)).alias("key"), F.lit(0).cast("long").alias("hash"),
        F.col("f.doc_id").alias("doc_id"), F.col("f.text").alias("text"), F.lit(True).alias("closing"),
    )
    rows = ranged.select("range", "key", "hash", "doc_id", "text", F.lit(False).alias("closing")).unionByName(closing)
    dealt = rows.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "closing", *order)
    return dealt.select("range", "doc_id", "text", "closing").mapInArrow(_chain, COLUMNS)


def _search(key: Column, mark: Column, bounds: list[tuple[int, int]]) -> Column:
    """Number of ``bounds`` (descending) above (``key``, ``mark``), by binary search of whole batches."""
    if not bounds:
        return F.lit(0)
    keys, marks = (np.array(x, np.int64) for x in zip(*bounds, strict=True))

    @F.pandas_udf("int")
    def above(key: pd.Series, mark: pd.Series) -> pd.Series:
        key, mark = key.to_numpy(), mark.to_numpy()
        found, step = np.zeros(len(key), np.int64), 1 << (len(keys).bit_length() - 1)
        while step:
            at = found + step
            i = np.minimum(at, len(keys)) - 1
            more = (at <= len(keys)) & ((keys[i] > key) | ((keys[i] == key) & (marks[i] > mark)))
            found, step = np.where(more, at, found), step >> 1
        return pd.Series(found.astype(np.int32))

    return above(key, mark)
