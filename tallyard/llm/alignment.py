"""Alignment of the tokens of two tokenizers over the same bytes.

For each byte of a text, a label says whether a token of A, of B, of both or of none ends
there. A regular expression scans the labels and cuts them after each "both": the labels of
such a span count the tokens of either side in a group. Between two labels lies one pair of
tokens whose byte ranges overlap, so labels also list all links. Words recur, and groups don't
reach over their starts: labels are scanned for each new word, many joined at a time.

Counts of linked id pairs over the corpus are needed for each document. Tasks number the pairs
of a chunk of documents (``CHUNK`` links, one document at least) and write the numbers; of a
pair there is one row for each chunk, never for each link. Those rows are summed by pair, get
their B id's largest sum, go back to their chunk, and meet its documents there. So no task
holds more than a chunk, whatever a pair's share of all links.

A is a byte-level BPE, given a space and the text; B a SentencePiece model, given the text.
Special tokens' strings are plain text.

Defined results: null and empty texts, and those whose tokens' bytes are not a space and the
text for A or B (as where a text has U+2581 itself), have no tokens: all numbers are 0 and
``groups_sha256`` is empty. Repeated rows are documents each and all count. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.llm.common import lookup_join, materialise, slices, text_of
from tallyard.llm.piecemodel import SPACE, default_model, piece_model
from tallyard.llm.wordcache import Records, WordCache, borders

#: Links of a chunk of documents, about.
CHUNK = 1 << 21

#: Labels of bytes: no token ends there, one of A, of B, one of either.
LABELS = np.frombuffer(b".AB=", np.uint8)
SPAN = re.compile(rb"[^=]*=")

# fixed values: white space as A's rule for words has it, besides the space
OTHERS = r"\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581"
#: Words: neither tokenizer has a token that reaches from another character to a space (or U+2581,
#: B's space), so both end tokens there and groups never reach over the start of a word.
WORD = re.compile(f"[ {OTHERS}]*[^ {OTHERS}]+(?:[{OTHERS}][ {OTHERS}]*[^ {OTHERS}]*)*|[ {OTHERS}]+")
BLANK = re.compile(f"[ {OTHERS}]")


def default_byte_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it is printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The bytes of each token, laid end to end."""

    def __init__(self, shown: list[bytes]):
        self.length = np.array([len(x) for x in shown], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(shown), np.uint8)

    def __len__(self) -> int:
        return len(self.length)

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.length[ids]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.first[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


class Pair:
    """Both tokenizers, and what they make of words: links, numbers of tokens and groups, and the groups' ids."""

    def __init__(self, byte_tokenizer: str, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(byte_tokenizer)
        self.encoder.encode_special_tokens = True
        self.model = piece_model(model)
        byte_of = byte_characters()
        shown = [b""] * self.encoder.get_vocab_size()
        for token, i in self.encoder.get_vocab(with_added_tokens=False).items():
            shown[i] = bytes(byte_of[c] for c in token)
        self.a, self.b = Vocabulary(shown), Vocabulary(self.model.shown)
        if len(self.a) * len(self.b) > 1 << 32:
            raise ValueError("pairs of ids must fit 32 bits")
        #: Each id with the sign that follows it: in a group, before B's, before the next group, at the end of a word.
        signs = ((",", self.a), ("|", self.a), (",", self.b), (";", self.b), (" ", self.b))
        self.texts = [f"{i}{sign}" for sign, own in signs for i in range(len(own))]
        self.words = WordCache(self._learn, lambda word: self.model.plain and word[0] == " " and not BLANK.match(word[-1]) and SPACE not in word, 4)

    def split(self, text: str) -> list[str]:
        """The words of a space and the text; all of it as one, if B's normalising knows no words."""
        return WORD.findall(f" {text}") if self.model.plain else [f" {text}"]

    def encode_a(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def encode_b(self, text: str) -> np.ndarray:
        """Ids of ``text``, which begins with the space that B would add."""
        normal = text.replace(" ", SPACE) if self.model.plain else self.model.normalize(text[1:].encode())[0].decode()
        return self.model.merger.encode(normal, return_type="numpy").astype(np.int64)

    def _learn(self, words: list[str]) -> Records:
        """Of each word: links as codes of id pairs; tokens of A and of B, groups, and 1 if both are over its bytes; the groups' ids."""
        text = "".join(words)
        data = text.encode()
        a, b = self.encode_a(text), self.encode_b(text)
        if self.a.joined(a) != data or self.b.joined(b) != data:
            if len(words) > 1:
                raise ValueError("tokens of words are not their bytes")
            return Records(np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros((1, 4), np.int64), [""])
        many_a, many_b, place_a, place_b, ends = align(a, b, self.a.length, self.b.length)
        last = borders(words, data)
        of_word = np.searchsorted(ends, last, "right")  # groups up to the end of each word
        if (ends[of_word - 1] != last).any():
            raise ValueError("a group reaches over the start of a word")
        before = np.concatenate(([0], of_word))
        sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[before]) for x in (many_a, many_b, many_a + many_b - 1)]
        numbers = np.stack([sums[0], sums[1], np.diff(before), np.ones(len(words), np.int64)], axis=1)
        codes = a[place_a] * len(self.b) + b[place_b]
        return Records(codes.astype(np.uint32), sums[2], numbers, groups_text(self, a, b, many_a, many_b, of_word - 1))


_WORKERS: dict[tuple[str, str], Pair] = {}


def _pair(byte_tokenizer: str, model: str) -> Pair:
    key = (byte_tokenizer, model)
    if key not in _WORKERS:
        _WORKERS[key] = Pair(*key)
    return _WORKERS[key]


def align(a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(tokens of A in each group, tokens of B, of each link the place of its A and its B token, the end of each group).

    ``a`` and ``b`` are ids over the same bytes; ``length_a`` and ``length_b`` give their bytes. A group
    of m and n tokens has m + n - 1 links: one for each byte of it that has a label.
    """
    ends_a, ends_b = np.cumsum(length_a[a]) - 1, np.cumsum(length_b[b]) - 1
    kind = np.zeros(int(ends_a[-1]) + 1, np.uint8)
    kind[ends_a] = 1
    kind[ends_b] |= 2
    spans = SPAN.findall(LABELS[kind].tobytes())
    ends = np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)))
    begins = np.concatenate(([0], ends[:-1]))
    of_a, of_b = kind & 1, kind >> 1
    many_a, many_b = np.add.reduceat(of_a, begins, dtype=np.int64), np.add.reduceat(of_b, begins, dtype=np.int64)
    at = np.flatnonzero(kind)
    place_a, place_b = (np.cumsum(x, dtype=np.int64)[at] - x[at] for x in (of_a, of_b))
    return many_a, many_b, place_a, place_b, ends


def _order(many: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each token of one side, where each group's begin at ``begin``; which are their group's last)."""
    total = np.cumsum(many)
    return np.repeat(begin - (total - many), many) + np.arange(total[-1]), total - 1


def groups_text(pair: Pair, a: np.ndarray, b: np.ndarray, many_a: np.ndarray, many_b: np.ndarray, last: np.ndarray) -> list[str]:
    """The ids of groups as ``a1,a2|b1;a3|b2,b3``, a text up to each of the groups ``last``."""
    start = np.cumsum(many_a + many_b) - many_a - many_b
    na, nb = len(pair.a), len(pair.b)
    out = np.empty(len(a) + len(b), np.int64)
    for ids, many, begin, offset, step in ((a, many_a, start, 0, na), (b, many_b, start + many_a, 2 * na, nb)):
        place, ends = _order(many, begin)
        codes = ids + offset
        codes[ends] += step
        if ids is b:
            codes[ends[last]] += step
        out[place] = codes
    return "".join(map(pair.texts.__getitem__, out.tolist())).split(" ")[:-1]


DOCUMENT = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()}
WRITTEN = {**DOCUMENT, "chunk": pa.int64(), "links": pa.binary(), "pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
WRITTEN_DDL = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunk long, links binary, pairs array<long>, counts array<long>"
)
DOCUMENT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


class Chunk:
    """Documents of one task whose links share a numbering."""

    def __init__(self, name: int):
        self.name, self.rows, self.links, self.size = name, [], [], 0

    def add(self, row: tuple, links: np.ndarray) -> None:
        self.rows.append(row)
        self.links.append(links)
        self.size += len(links) + 16

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Rows of the documents, and one that has the pairs with their counts and no document."""
        pairs, numbers, counts = np.unique(np.concatenate(self.links), return_inverse=True, return_counts=True)
        numbers, at = numbers.astype("<u4"), 0
        rows = [*zip(*self.rows, strict=True)]
        links = []
        for own in self.links:
            links.append(numbers[at : at + len(own)].tobytes())
            at += len(own)
        n = len(links)
        columns = [pa.array([*c, None], t) for c, t in zip(rows, DOCUMENT.values(), strict=True)]
        columns += [pa.array([self.name] * (n + 1), pa.int64()), pa.array([*links, None], pa.binary())]
        columns += [pa.array([None] * n + [x.astype(np.int64)], pa.list_(pa.int64())) for x in (pairs, counts)]
        yield pa.RecordBatch.from_arrays(columns, list(WRITTEN))


def _aligned(byte_tokenizer: str, model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, name = _pair(byte_tokenizer, model), TaskContext.get().partitionId() << 32
        chunk = Chunk(name)
        for batch in slices(batches):
            parts = [pair.split(t) if t else [] for t in batch.column(1).to_pylist()]
            found = pair.words.records(list(chain.from_iterable(parts)))
            at = np.cumsum([0, *map(len, parts)])
            numbers = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(found.numbers, axis=0)))[at]
            edges = np.concatenate(([0], np.cumsum(found.counts)))[at].tolist()
            for doc, n, (begin, end), (n_a, n_b, n_groups, whole), first, after in zip(
                batch.column(0).to_pylist(), map(len, parts), pairwise(at.tolist()), np.diff(numbers, axis=0).tolist(), edges[:-1], edges[1:], strict=True
            ):
                if n and whole == n:
                    digest = hashlib.sha256(";".join(found.texts[begin:end]).encode()).hexdigest()
                    chunk.add((doc, n_a, n_b, n_groups, after - first, digest), found.values[first:after])
                else:
                    chunk.add((doc, 0, 0, 0, 0, ""), found.values[:0])
                if chunk.size >= CHUNK:
                    yield from chunk.batches()
                    name += 1
                    chunk = Chunk(name)
        if chunk.rows:
            yield from chunk.batches()

    return run


def _scored(documents: pa.Table, priced: pa.Table) -> pa.Table:
    """Documents of a chunk with the sums of what its pairs count; ``priced`` has number, count and whether it is its B id's highest."""
    count, best = np.zeros((2, priced.num_rows), np.int64)
    number = np.asarray(priced["number"])
    count[number], best[number] = np.asarray(priced["count"]), np.asarray(priced["best"])
    links = [np.frombuffer(x, "<u4") for x in documents["links"].to_pylist()]
    sums = [(int(best[x].sum()), int(count[x].sum())) for x in links]
    columns = [documents[c] for c in DOCUMENT]
    return pa.table([*columns, pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64())], [*DOCUMENT, "n_best", "count_sum"])


def groups(docs: DataFrame, byte_tokenizer: str | None = None, model: str | None = None) -> DataFrame:
    """Rows of documents with their links by number in their chunk, and one row of pairs for each chunk; frozen."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return materialise(own.mapInArrow(_aligned(byte_tokenizer or default_byte_tokenizer(), model or default_model()), WRITTEN_DDL), "aligned")


def pair_counts(written: DataFrame, pieces: int) -> DataFrame:
    """pair, count of links over the corpus, and whether no other pair of its B id has more; frozen."""
    listed = written.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = materialise(listed.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    highest = counts.groupBy(F.expr(f"pair % {pieces}").alias("b")).agg(F.max("count").alias("most"))
    of_b = counts.withColumn("b", F.expr(f"pair % {pieces}")).join(highest, "b")
    return of_b.select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def aligned(docs: DataFrame, byte_tokenizer: str | None = None, model: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    written = groups(docs, byte_tokenizer, model)
    prices = materialise(pair_counts(written, len(piece_model(model or default_model()).length)), "pair-prices")
    numbered = written.filter("pairs is not null").select("chunk", F.posexplode("pairs").alias("number", "pair"))
    priced = lookup_join(materialise(numbered, "numbered"), prices, "pair", ["chunk"]).select("chunk", "number", "count", "best")
    documents = written.filter("pairs is null").select(*DOCUMENT, "chunk", "links")
    scored = documents.groupBy("chunk").cogroup(priced.groupBy("chunk")).applyInArrow(_scored, DOCUMENT_DDL)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
