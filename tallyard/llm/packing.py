"""Harmonic packing of tokenised documents into fixed-length sequences.

Lengths are partitioned into reciprocal-capacity classes: class ``k`` takes documents of
more than capacity / (k + 1) and at most capacity / k tokens (the last class, ``CLASSES``,
all shorter ones), and each bin of class ``k`` is filled with exactly ``k`` of them. A
document longer than a sequence fills whole sequences first; its rest is packed like a
document. Documents in bins stay whole.

Each worker fills its bins from its own partition and shares nothing while it does so.
What full bins leave free is filled by every so many documents, cut where a gap ends:
whenever the worker's gaps hold more than ``SLACK`` tokens, the next documents go there.
At the end of a partition, documents of bins that did not fill up go into the gaps, then
into sequences one after another; the last part of a sequence, one for each worker, is cut
by the binary digits of its length. Those pieces meet in sequences of their own, in slots
of 4096 / 2**j tokens. So a gap below ``LEAST`` tokens stays padded, and one sequence of
the corpus may be short; one count per worker, and per length of the last pieces, turns
local numbers into global ones.

Defined results: null or empty text is a document with the end id alone; repeated rows
are packed once each; other columns of the input are ignored, and an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyard.llm.bytehash import HashIndex, joined, token_hashes
from tallyard.llm.common import materialise, maybe_broadcast, slices, text_of

CAPACITY = 4096
END_ID = 2
#: Classes of lengths; tokens of a gap worth filling; tokens of gaps that a worker leaves open before it fills them.
CLASSES, LEAST, SLACK = 32, 16, 4096

#: A mark between pre-tokens that are encoded together.
MARK = "\x01"

#: Texts of these characters alone, and without apostrophes, are cut at changes between letters, digits
#: and other signs; lower case and composition don't move those borders.
PLAIN = "[\t-\r -&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*"

_KIND = np.zeros(256, np.uint8)  # 0: white space
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class PieceTokenizer:
    """Ids of whole texts by way of their pre-tokens, which recur and are encoded once.

    The tokenizer encodes each pre-token by itself: a run of letters, one digit, or a run of other signs.
    Plain texts are cut and looked up by whole batches; all others go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.plain = re.compile(PLAIN).fullmatch
        self.special = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        mark = self.encoder.encode(MARK, add_special_tokens=False).ids
        if len(mark) != 1:
            raise ValueError("the tokenizer has no single id for the mark")
        self.mark = mark[0]
        self.index = HashIndex()
        self._reset()

    def _reset(self) -> None:
        self.index.clear()
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.first, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _alone(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, pieces: list[str], keys: np.ndarray) -> None:
        numbers = self.index.add(keys)
        while len(self.first) < self.index.size:
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        for at in range(0, len(pieces), 2048):
            own = pieces[at : at + 2048]
            found = self.encoder.encode_batch_fast([f" {MARK} ".join(own)], add_special_tokens=False)[0].ids
            ids = np.array(found, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(own) - 1:
                raise ValueError("the tokenizer merged pieces")
            size = np.diff(np.concatenate(([-1], marks, [len(ids)]))) - 1
            ids = np.delete(ids, marks)
            while len(self.ids) < self.used + len(ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.ids[self.used : self.used + len(ids)] = ids
            mine = numbers[at : at + len(own)]
            self.count[mine] = size
            self.first[mine] = self.used + np.cumsum(size) - size
            self.used += len(ids)

    def _encode_plain(self, texts: list[bytes]) -> list[np.ndarray]:
        data, offsets = joined(texts)
        kind = _KIND[data]
        begins = kind > 0
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        starts = np.flatnonzero(begins)
        if not len(starts):
            return [np.empty(0, np.uint32)] * len(texts)
        keys = token_hashes(data, starts, kind == 0)
        numbers = self.index.find(keys)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            if self.index.size + len(new) > self.index.limit:
                self._reset()
                missing = np.arange(len(keys))
                new, first = np.unique(keys, return_index=True)
            at = missing[first]
            ends = np.append(starts, len(data))[at + 1]
            raw = data.tobytes()
            self._learn([raw[a:b].decode().rstrip() for a, b in zip(starts[at].tolist(), ends.tolist(), strict=True)], new)
            numbers[missing] = self.index.find(keys[missing])
        count = self.count[numbers]
        total = np.cumsum(count)
        out = self.ids[np.repeat(self.first[numbers] - (total - count), count) + np.arange(total[-1])]
        edges = np.concatenate(([0], total))[np.searchsorted(starts, offsets)]
        return [out[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain = [bool(self.plain(t)) and not any(x in t for x in self.special) for t in texts]
        found = iter(self._encode_plain([t.encode() for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else ())
        return [next(found) if p else self._alone(t) for t, p in zip(texts, plain, strict=True)]


#: One for each tokenizer file and Python worker, kept between tasks.
_WORKERS: dict[str, PieceTokenizer] = {}


def worker(path: str) -> PieceTokenizer:
    if path not in _WORKERS:
        _WORKERS[path] = PieceTokenizer(path)
    return _WORKERS[path]


def cut(length: int) -> list[int]:
    """The binary digits of a length, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Bins:
    """The sequences that one worker fills: rows (doc_id, start, length, ids_crc32, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.sequences, self.room = capacity, 0, 0
        self.open: dict[int, list] = {}  # of each class, the documents of its open bin
        self.gaps: deque[list[int]] = deque()  # [sequence, offset, room]
        self.tails: dict[int, int] = {}  # last pieces of each length so far
        self.rows: list[tuple] = []

    def _new(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def _put(self, piece: tuple, taken: int, length: int, sequence: int, offset: int) -> None:
        doc, ids, start, tokens = piece
        self.rows.append((doc, start + taken, length, zlib.crc32(ids[4 * taken : 4 * (taken + length)]), tokens, sequence, offset))

    def add(self, doc, ids: bytes) -> None:
        tokens, start, c = len(ids) // 4, 0, self.capacity
        while tokens - start >= c:
            self._put((doc, ids[4 * start : 4 * (start + c)], start, tokens), 0, c, self._new(), 0)
            start += c
        if start == tokens:
            return
        piece, length = (doc, ids[4 * start :], start, tokens), tokens - start
        if self.room > SLACK and self.room >= length:
            self._fill(piece, length)
            return
        k = min(c // length, CLASSES)
        members = self.open.setdefault(k, [])
        members.append((piece, length))
        if len(members) == k:
            sequence, at = self._new(), 0
            for own, n in members:
                self._put(own, 0, n, sequence, at)
                at += n
            self._gap(sequence, at)
            del self.open[k]

    def _gap(self, sequence: int, at: int) -> None:
        if self.capacity - at >= LEAST:
            self.gaps.append([sequence, at, self.capacity - at])
            self.room += self.capacity - at

    def _fill(self, piece: tuple, length: int) -> int:
        """Puts a document into gaps, in parts where it must; tokens placed."""
        taken = 0
        while taken < length and self.gaps:
            gap = self.gaps[0]
            n = min(gap[2], length - taken)
            if 0 < length - taken - n < LEAST and n > 2 * LEAST:
                n -= LEAST  # no crumbs
            self._put(piece, taken, n, gap[0], gap[1])
            taken, gap[1], gap[2], self.room = taken + n, gap[1] + n, gap[2] - n, self.room - n
            if gap[2] < LEAST or taken < length:
                self.room -= gap[2]
                self.gaps.popleft()
        return taken

    def finish(self) -> None:
        held = [x for members in self.open.values() for x in members]
        left = [(piece, self._fill(piece, length), length) for piece, length in held]
        whole = sum(length - taken for _, taken, length in left) // self.capacity
        self.gaps.extend([self._new(), 0, self.capacity] for _ in range(whole))
        full = whole * self.capacity
        for piece, taken, length in left:
            while taken < length and full:
                gap = self.gaps[0]
                n = min(gap[2], length - taken)
                self._put(piece, taken, n, gap[0], gap[1])
                taken, gap[1], gap[2], full = taken + n, gap[1] + n, gap[2] - n, full - n
                if not gap[2]:
                    self.gaps.popleft()
            for n in cut(length - taken):
                rank = self.tails.get(n, 0)
                self.tails[n] = rank + 1
                self._put(piece, taken, n, -1, rank)
                taken += n


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, `at` long, part int"


def _pieces(tokenizer: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, bins = worker(tokenizer), TaskContext.get().partitionId(), Bins(capacity)
        end = END_ID.to_bytes(4, "little")

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] + [pa.array([part] * len(rows), pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "at", "part"])

        for batch in slices(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist()), strict=True):
                bins.add(doc, ids.astype("<u4").tobytes() + end)
            if bins.rows:
                yield batch_of(bins.rows)
                bins.rows = []
        bins.finish()
        if bins.rows:
            yield batch_of(bins.rows)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if capacity < 2 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # frozen: partition numbers and ranks must not change when a task runs again
    pieces = materialise(source.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity), PIECES), "pieces")
    # one row for each worker and, of the last pieces, length
    slot = F.when(F.col("sequence") < 0, F.col("length")).otherwise(F.lit(0).cast("long")).alias("slot")
    counts = pieces.groupBy("part", slot).agg(F.max(F.when(F.col("sequence") < 0, F.col("at")).otherwise(F.col("sequence"))).alias("most"))
    counts = materialise(counts.select("part", "slot", (F.col("most") + 1).alias("n")), "pack-counts")
    before = Window.partitionBy("slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select("part", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    totals = {r["slot"]: r["n"] for r in counts.groupBy("slot").agg(F.sum("n").alias("n")).collect()}  # 14 at most
    base, at = F.lit(0).cast("long"), totals.get(0, 0) * capacity
    for length in sorted((x for x in totals if x), reverse=True):
        base = F.when(F.col("slot") == length, F.lit(at).cast("long")).otherwise(base)
        at += totals[length] * length
    place = F.when(F.col("slot") == 0, (F.col("before") + F.col("sequence")) * capacity + F.col("at")).otherwise(base + (F.col("before") + F.col("at")) * F.col("slot"))
    return (
        pieces.select("*", slot).join(maybe_broadcast(placed), ["part", "slot"]).withColumn("place", place)
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            F.expr(f"place div {capacity}").alias("sequence_id"),
            F.pmod("place", F.lit(capacity)).cast("long").alias("offset"),
        )
    )
