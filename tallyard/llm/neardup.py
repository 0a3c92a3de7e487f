"""Near-duplicate documents by circulant MinHash.

Shingles are hashed to 64 bits; their value modulo ``UNIVERSE``, multiplied by an odd
number, is the first permutation. The second is one fixed random table; coordinate
``k`` of a signature is the smallest table entry of the permuted values shifted
circularly by ``k``:

    h_k(S) = min over x in S of table[(sigma(x) + k) mod UNIVERSE]

so two permutations give all coordinates. Bands of coordinates make buckets; two bits of
each coordinate make a sketch. A candidate pair shares a bucket and has sketches that
differ in a bounded number of coordinates; bands and bound follow from the threshold, so
that a pair at it fails either test about once in a hundred thousand, a closer one less.
Links are confirmed on the full sets of shingle hashes.

Documents with the same set are one class from the start (copies are never paired).
In a turn, the classes of a bucket are compared with a few pivots of the bucket and links
join components. A pivot that has met all of its bucket leaves it, and a bucket is done
with once what is left of it lies in one component, so every pair of a bucket is compared
or already joined; the first pivot is the class that meets the most others. From the second turn on, shingles that no other open class has are
counted: what a class has besides them bounds its likeness to any other, exactly, so that
most classes that are on their own are compared with few. Pivots are of different components where they can be: members of a
large component that is already joined are not compared with each other.

Defined results: null, empty and blank texts have the empty set and are alone; a text
of fewer words than a shingle has one shingle, all of its words; rows with the same
doc_id but different sets are different nodes; a null doc_id never is the smallest of
a component unless it has no other; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.llm.bytehash import MIX, finish, joined, words
from tallyard.llm.common import lookup_join, materialise, quoted, slices, text_of, unused

SHINGLE = 5
UNIVERSE = 1 << 20
#: Coordinates of a signature; the sketch has two bits for each.
COORDINATES = 512
#: Bands, at most, and the share of pairs at the threshold that may share none.
MOST_BANDS, MISSED = 40, 1.1e-5
#: Deviations above the expectation that sketches of a pair at the threshold may differ by.
DEVIATIONS = 4.25
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Pivots of a bucket grow by this factor each turn, up to so many.
GROWTH, MOST_PICKS = 16, 4096
#: Names that may be broadcast: two digests of 16 bytes each.
FEW_NAMES = 100_000

_TURN = np.random.default_rng(7).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes of the k-word shingles, sorted within each text; offset of each text and of the end)."""
    data, offsets = joined(texts)
    starts, hashes = words(data)
    first = np.searchsorted(starts, offsets)  # first word of each text
    count = np.diff(first)
    # a shingle begins at each word that has k - 1 more in its text, or at the first of a short text
    width = np.minimum(count, k)
    shingles = np.maximum(count - k + 1, (count > 0).astype(count.dtype))
    doc = np.repeat(np.arange(len(texts)), shingles)
    at = np.repeat(first[:-1], shingles) + np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    out = width[doc].astype(np.uint64)
    padded = np.concatenate((hashes, np.zeros(k, np.uint64)))
    for i in range(k):
        inside = i < width[doc]
        out += np.where(inside, padded[at + i] * _TURN[i], np.uint64(0))
    out = finish(out)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[fresh], doc[fresh]
    return out, np.searchsorted(doc, np.arange(len(texts) + 1))


def _table() -> np.ndarray:
    """The second permutation, with its head repeated for the circular shift."""
    table = np.random.default_rng(11).permutation(UNIVERSE).astype(np.int32)
    return np.concatenate((table, table[:COORDINATES]))


def signatures(shingles: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES); rows of texts without shingles are meaningless."""
    at = ((shingles * np.uint64(0x2545F491)) & np.uint64(UNIVERSE - 1)).astype(np.int64)
    best = np.full((len(offsets) - 1, COORDINATES), UNIVERSE, np.int32)
    view = np.lib.stride_tricks.sliding_window_view(table, COORDINATES)
    for doc, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for i in range(a, b, 512):
            np.minimum(best[doc], view[at[i : min(b, i + 512)]].min(axis=0), out=best[doc])
    return best


@cache
def settings(percent: int) -> tuple[int, int, int]:
    """(bands, coordinates of a band, coordinates in which sketches may differ) for links of ``percent``.

    The longest bands of which few enough suffice: 36 of 8 and 88 at 85 %, 38 of 6 and 112 at 80 %.
    """
    if not 5 <= percent <= 100:
        raise ValueError(f"no settings for {percent} %")
    same = percent / 100
    needed = lambda rows: 1 if same == 1 else math.ceil(math.log(MISSED) / math.log1p(-(same**rows)))
    rows = max((r for r in range(2, 33) if needed(r) <= MOST_BANDS and needed(r) * r <= COORDINATES), default=1)
    other = (1 - same) * 3 / 4  # two bits of different coordinates are the same once in four
    return needed(rows), rows, math.ceil(COORDINATES * other + DEVIATIONS * math.sqrt(COORDINATES * other * (1 - other)))


def bands(coordinates: np.ndarray, count: int, size: int) -> np.ndarray:
    rows = coordinates[:, : count * size].reshape(-1, count, size).astype(np.uint64)
    out = np.tile(np.arange(1, count + 1, dtype=np.uint64), (len(rows), 1))
    for i in range(size):
        out = finish(out * MIX + rows[:, :, i])
    return out.view(np.int64)


def sketches(coordinates: np.ndarray) -> np.ndarray:
    """(texts, 2 * COORDINATES / 64): the lowest bit of all coordinates, then the next bit."""
    planes = [np.packbits((coordinates >> b & 1).astype(np.uint8), axis=1).view(">i8") for b in (0, 1)]
    return np.concatenate(planes, axis=1).astype(np.int64)


def _lists(rows: np.ndarray, filled: np.ndarray) -> pa.Array:
    """Rows as lists, empty where ``filled`` is false."""
    offsets = np.concatenate(([0], np.cumsum(filled * rows.shape[1]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows[filled].reshape(-1)))


SIGNED = "doc_id long, mark string, n_shingles long, node binary, bands array<long>, sketch array<long>"


def _sign(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    table = _table()
    count, rows, _ = settings(percent)
    for batch in slices(batches):
        sets, offsets = shingle_sets(batch.column(2).cast(pa.binary()).to_pylist())
        size = np.diff(offsets)
        best = signatures(sets, offsets, table)
        raw = sets.tobytes()
        keys = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(size.astype(np.int64)), pa.array(keys, pa.binary()), _lists(bands(best, count, rows), size > 0), _lists(sketches(best), size > 0)],
            ["doc_id", "mark", "n_shingles", "node", "bands", "sketch"],
        )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of intersection and union of the full sets of each pair's texts."""
    for batch in slices(batches):
        pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        texts: dict[bytes, bytes] = {}
        for i, t in ((0, 2), (1, 3)):
            texts.update(zip((p[i] for p in pairs), batch.column(t).cast(pa.binary()).to_pylist(), strict=True))
        sets, offsets = shingle_sets(list(texts.values()))
        own = {k: sets[a:b] for k, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)}
        common = np.array([len(np.intersect1d(own[a], own[b], assume_unique=True)) for a, b in pairs], np.int64)
        union = np.array([len(own[a]) + len(own[b]) for a, b in pairs], np.int64) - common
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common), pa.array(union)], ["a", "b", "common", "union"])


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The links among distinct pairs (a, b) of nodes, with all columns of the pairs; b may be the same for very many."""
    of = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    with_b = lookup_join(pairs.select("a", "b"), of("b"), "b", ["a"])
    both = with_b.join(of("a"), "a").select("a", "b", "text_a", "text_b")
    checked = both.mapInArrow(_compare, "a binary, b binary, common long, union long")
    checked = checked.filter(100 * F.col("common") >= percent * F.col("union")).select("a", "b")
    return materialise(checked, "links")


def _renamed(df: DataFrame, column: str, names: DataFrame, spread_by: list[str]) -> DataFrame:
    """``df`` (materialised) with the values of ``column`` replaced by their ``root`` in ``names`` (node, root), if they have one."""
    names = names.select(F.col("node").alias(column), F.col("root").alias("_root"))
    if names.limit(FEW_NAMES + 1).count() <= FEW_NAMES:
        named = df.join(F.broadcast(names), column, "left")
    else:
        named = lookup_join(df, names, column, spread_by, "left")
    return named.withColumn(column, F.coalesce("_root", column)).select(*df.columns)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of the component of each node of ``edges`` (a, b).

    Roots hook onto smaller roots that an edge shows, then pointers are shortened,
    until no edge joins two roots. Rounds grow with the logarithm of the diameter.
    Up to ``FEW_NAMES`` edges (counted) are a few megabytes and need no shuffles.
    """
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    crossing = materialise(ordered(edges), "cc")
    few = crossing.count() <= FEW_NAMES
    frozen = lambda df: materialise(df, "cc").coalesce(1) if few else materialise(df, "cc")
    crossing = crossing.coalesce(1) if few else crossing
    parent = frozen(crossing.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    for _ in range(most_rounds):
        if crossing.isEmpty():
            return parent
        hook = frozen(crossing.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:  # a root's target may have been hooked itself
            longer = frozen(_renamed(hook.withColumn("was", F.col("root")), "root", hook, ["node"]))
            hook = longer.select("node", "root")
            if longer.filter("root <> was").isEmpty():
                break
        parent = frozen(_renamed(parent, "root", hook, ["node"]))
        half = frozen(_renamed(crossing, "a", hook, ["b"]))
        crossing = frozen(ordered(_renamed(half, "b", hook, ["a"])))
    raise RuntimeError("components did not settle")


def sign(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, mark, n_shingles, node (digest of the set, null if empty), bands and sketch of each row; frozen."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text_of()).alias("mark"), text_of().alias("text"))
    return materialise(source.mapInArrow(lambda x: _sign(x, percent), SIGNED), "signed")


def _near(a: str, b: str, percent: int):
    """Whether two classes (columns sketch, n and own of either side) can be linked.

    ``own`` shingles of a class are in no other set it may still be compared with, so the
    rest of its set bounds the intersection.
    """
    planes = COORDINATES // 64
    other = lambda i: F.col(f"sketch{a}")[i].bitwiseXOR(F.col(f"sketch{b}")[i])
    differ = sum((F.bit_count(other(i).bitwiseOR(other(planes + i))) for i in range(planes)), F.lit(0))
    common = F.least(F.col(f"n{a}") - F.col(f"own{a}"), F.col(f"n{b}") - F.col(f"own{b}"))
    return (100 * common >= percent * (F.col(f"n{a}") + F.col(f"n{b}") - common)) & (differ <= settings(percent)[2])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets, offsets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist())
        who = np.repeat(np.asarray(batch.column(0)), np.diff(offsets))
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(sets.view(np.int64))], ["who", "shingle"])


def _with_own(live: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``live`` with ``own`` counted anew: shingles of a class that no other open one has. Classes of too many are left out."""
    spread = texts.join(live.select("node").distinct(), "node", "left_semi")
    spread = spread.select(F.xxhash64("node").alias("who"), "text").mapInArrow(_spread, "who long, shingle long")
    single = spread.groupBy("shingle").agg(F.count("*").alias("k"), F.min("who").alias("who")).filter("k = 1")
    own = single.groupBy("who").agg(F.count("*").alias("counted"))
    counted = live.withColumn("who", F.xxhash64("node")).join(own, "who", "left").withColumn("own", F.coalesce("counted", F.lit(0).cast("long")))
    return materialise(counted.filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")).select(*live.columns), "own")


def link(docs: DataFrame, signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root) of all nodes that have a link, as found among the candidates of each bucket."""
    # a class is named by its set; bands, sketch and size are the same for all of its rows
    reps = signed.filter("node is not null").groupBy("node").agg(F.min_by(F.struct("mark", "n_shingles", "bands", "sketch"), "mark").alias("r"))
    reps = materialise(reps.select("node", "r.mark", F.col("r.n_shingles").alias("n"), "r.bands", "r.sketch"), "reps")
    rows = reps.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("bucket"))
    # most buckets hold one class; narrow rows find the others, and only theirs take sketches along
    crowded = rows.groupBy("bucket").agg(F.count("*").alias("k")).filter("k > 1")
    crowded = materialise(rows.join(crowded, "bucket"), "crowded")
    # a class whose buckets are full is near the middle of a group
    wide = materialise(reps.drop("bands").join(crowded.groupBy("node").agg(F.sum("k").alias("company")), "node"), "wide")
    # copies of a text are dropped by each task before they meet
    plain = docs.select(F.md5(text_of()).alias("mark"), text_of().alias("text")).dropDuplicates(["mark"])
    texts = materialise(wide.select("node", "mark").join(plain, "mark").select("node", "text"), "texts")
    live = crowded.drop("k").join(wide.select("node", "n", "company", "sketch"), "node").withColumn("root", F.col("node")).withColumn("own", F.lit(0).cast("long"))
    live = materialise(live, "live")
    links, turn = [], 0
    while not live.isEmpty():
        if turn:
            live = _with_own(live, texts, percent)
        picks = min(GROWTH**turn, MOST_PICKS)
        side = lambda x: [F.col(c).alias(f"{c}{x}") for c in ("node", "root", "n", "own", "sketch")]
        # pivots of different roots, from the middle of their groups, and the same in as many buckets as can be
        place = F.pmod(F.xxhash64("root", F.lit(turn)), F.lit(picks))
        pivots = live.groupBy("bucket", place.alias("place")).agg(F.min(F.struct((-F.col("company")).alias("first"), F.xxhash64("node").alias("h"), *side("_b"))).alias("p"))
        pivots = materialise(pivots.select("bucket", *[f"p.{c}_b" for c in ("node", "root", "n", "own", "sketch")]), "pivots")
        met = lookup_join(live.select("bucket", *side("_a")), pivots, "bucket", ["node_a"])
        met = met.filter((F.col("root_a") != F.col("root_b")) & _near("_a", "_b", percent))
        pairs = met.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.first("root_a").alias("root_a"), F.first("root_b").alias("root_b"))
        pairs = materialise(pairs, "pairs")
        new = _verified(pairs, texts, percent)
        # a pivot has met all rows of its bucket
        live = live.join(pivots.select("bucket", F.col("node_b").alias("node")), ["bucket", "node"], "left_anti")
        if not new.isEmpty():
            links.append(new)
            roots = components(new.join(pairs, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
            live = _renamed(materialise(live, "open"), "root", roots, ["node", "bucket"])
        shared = live.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("bucket")
        live = materialise(live.join(shared, "bucket", "left_semi"), "open")
        turn += 1
    none = signed.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    return components(reduce(DataFrame.unionByName, links) if links else none)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs``."""
    signed = sign(docs, percent)
    roots = link(docs, signed, percent)
    # by class, so that copies are counted once before anything is joined
    by_class = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = by_class.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialise(rooted, "rooted")
    lowest = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    of_class = materialise(lookup_join(rooted, lowest, "root", ["node"]).select("node", "component_id"), "of-class")
    slim = signed.select("doc_id", "n_shingles", "node", F.xxhash64("doc_id", "mark").alias("row"))
    alone = slim.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rest = lookup_join(slim.filter("node is not null"), of_class, "node", ["row"]).select("doc_id", "n_shingles", "component_id")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return rest.unionByName(alone).withColumn("kept", kept)


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component: that of the smallest doc_id, null last; the same text comes once, blank rows all stay."""
    columns = docs.columns
    signed = sign(docs, percent)
    roots = link(docs, signed, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark")).alias("first")
    by_class = signed.filter("node is not null").groupBy("node").agg(first)
    rooted = by_class.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    survivors = rooted.groupBy("root").agg(F.min("first").alias("first"))
    # names that the input doesn't have
    own_id, own_mark, first_id, first_mark = (unused(x, columns) for x in ("own_id", "own_mark", "first_id", "first_mark"))
    survivors = materialise(survivors.select(F.col("first.doc_id").alias(first_id), F.col("first.mark").alias(first_mark)), "survivors")
    blank = ~text_of().rlike(r"[^\x20\x09-\x0D]")  # a row without words is a component
    rows = docs.filter(~blank).withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_mark, F.md5(text_of()))
    kept = rows.join(survivors, F.col(own_id).eqNullSafe(F.col(first_id)) & (F.col(own_mark) == F.col(first_mark)), "left_semi")
    # a survivor's id and text may stand in several rows
    own = [F.col(quoted(c)) for c in columns]
    return kept.dropDuplicates([own_id, own_mark]).select(*own).unionByName(docs.filter(blank).select(*own))
