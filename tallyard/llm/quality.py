"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of its UTF-8 bytes, all of them, of about ``PASSAGE``
bytes each. A passage is encoded by shares of byte classes, word statistics and
repetition, then by a learned hidden layer h. Gated attention, learned from the
documents' labels alone, weighs the passages,

    a_i = softmax(w . (tanh(V h_i) * sigmoid(U h_i))),    score = sigmoid(c . sum(a_i h_i) + d)

so a document is judged by the passages that tell. The model is fitted on a bounded
sample of labelled documents (``SAMPLE``, ``PASSAGES``) and scores every document.

Defined results: null and empty texts are one passage without content and get a score
like any other; several labels of one doc_id count as their mean; without labelled
rows every score is 0.5 and ``keep_good`` keeps all; repeated rows score the same; columns other than doc_id and
text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyard.llm.common import materialise, slices, text_of
from tallyard.llm.bytehash import words

PASSAGE = 1024
#: Labelled documents that the model is fitted on, and passages of them, at most.
SAMPLE, PASSAGES = 8_000, 100_000
THRESHOLD = 0.7
HIDDEN, GATE = 16, 8

_CLASSES = 14
_CLASS = np.zeros(256, np.int64)
for _k, _bytes in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"#$%&*@^~_=+", b"\"'()-;:/\\`", b"<>{}[]"), 1
):
    _CLASS[list(_bytes)] = _k
_CLASS[0x80:] = 13
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
WIDTH = _CLASSES + 8


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, number of passages of each document) of concatenated texts."""
    lengths = np.diff(offsets)
    per_doc = np.maximum(1, -(-lengths // PASSAGE))
    doc = np.repeat(np.arange(len(lengths)), per_doc)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    start = offsets[:-1][doc] + nth * lengths[doc] // per_doc[doc]
    stop = offsets[:-1][doc] + (nth + 1) * lengths[doc] // per_doc[doc]
    size = stop - start
    owner = np.repeat(np.arange(len(doc)), size)  # passage of each byte
    out = np.zeros((len(doc), WIDTH))
    counts = np.bincount(owner * _CLASSES + _CLASS[data], minlength=len(doc) * _CLASSES).reshape(-1, _CLASSES)
    n = np.maximum(size, 1)[:, None]
    out[:, :_CLASSES] = counts / n
    if len(data):
        # words end at white space and at the end of a document
        space = _SPACE[data]
        fresh = np.zeros(len(data), bool)
        fresh[offsets[:-1][lengths > 0]] = True
        begins = ~space & (fresh | np.concatenate(([True], space[:-1])))
        at = np.flatnonzero(begins)
        if len(at):
            # texts that touch are parted by a space
            cut = fresh & ~space & np.concatenate(([False], ~space[:-1]))
            hashes = _hashes(data, np.flatnonzero(cut))
            own = owner[at]
            words = np.bincount(own, minlength=len(doc))
            m = np.maximum(words, 1)
            same = np.zeros(len(at), bool)
            same[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
            order = np.lexsort((hashes, own))
            first = np.ones(len(at), bool)
            first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (own[order][1:] != own[order][:-1])
            # pairs of neighbours, for repeated lines and phrases
            pair = hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + hashes[:-1]
            po = own[1:]
            order2 = np.lexsort((pair, po))
            first2 = np.ones(len(pair), bool)
            first2[1:] = (pair[order2][1:] != pair[order2][:-1]) | (po[order2][1:] != po[order2][:-1])
            upper = (_CLASS[data[at]] == 2).astype(float)
            k = _CLASSES
            out[:, k] = np.bincount(own, same, len(doc)) / m
            out[:, k + 1] = np.bincount(own[order], first, len(doc)) / m
            out[:, k + 2] = np.bincount(po[order2], first2, len(doc)) / np.maximum(np.bincount(po, minlength=len(doc)), 1)
            out[:, k + 3] = np.bincount(own, upper, len(doc)) / m
            out[:, k + 4] = words / n[:, 0]
            out[:, k + 5] = (words > 0) * np.log1p(words) / 5
    out[:, _CLASSES + 6] = np.log1p(lengths[doc]) / 10
    out[:, _CLASSES + 7] = np.log1p(size) / 7
    return out, per_doc


def _hashes(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Word hashes of concatenated texts that also break at ``cuts``."""
    return words(np.insert(data, cuts, 0x20) if len(cuts) else data)[1]


class Model:
    """Hidden layer, gated attention and output; fitted by Adam on bags of passages."""

    def __init__(self, seed: int = 3):
        g = np.random.default_rng(seed)
        self.p = {
            "W": g.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "V": g.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "U": g.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": g.normal(0, GATE**-0.5, GATE), "c": g.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, per_doc: np.ndarray) -> dict:
        p, at = self.p, np.cumsum(per_doc) - per_doc
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), per_doc))
        a = e / np.repeat(np.add.reduceat(e, at), per_doc)
        z = np.add.reduceat(a[:, None] * h, at)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "score": score, "at": at}

    def fit(self, x: np.ndarray, per_doc: np.ndarray, y: np.ndarray, epochs: int = 250, rate: float = 0.02, decay: float = 1e-4) -> Model:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, epochs + 1):
            f, p = self.forward(x, per_doc), self.p
            dy = (f["score"] - y) / len(y)
            rep = lambda v: np.repeat(v, per_doc, axis=0)
            dz = dy[:, None] * p["c"]
            da = (rep(dz) * f["h"]).sum(1)
            de = f["a"] * (da - rep(np.add.reduceat(f["a"] * da, f["at"])))
            ts = f["t"] * f["s"]
            dt = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
            ds = de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
            dh = f["a"][:, None] * rep(dz) + dt @ p["V"].T + ds @ p["U"].T
            dx = dh * (1 - f["h"] ** 2)
            grad = {"W": f["x"].T @ dx, "b": dx.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": ts.T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}
            for k, g in grad.items():
                g = g + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x, per_doc = passages(*_buffers(batch.column(0)))
        ends = np.cumsum(per_doc)
        rows = [x[b - n : b].astype("<f4").tobytes() for b, n in zip(ends, per_doc, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1), batch.column(2)], ["passages", "label", "h"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 3, most: int = PASSAGES) -> Model | None:
    """The model of the labelled rows outside the held-out fold, or None without any.

    It learns from ``sample`` documents and ``most`` passages of them at most; a document of more is not learnt from.
    """
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("label"))
    chosen = marked.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    # repeated doc_ids can't lengthen the sample; texts are encoded where they are
    encoded = found.select("text", "label", F.xxhash64("doc_id", "text").alias("h")).mapInArrow(_encoded, "passages binary, label double, h long")
    encoded = materialise(encoded.withColumn("n", F.expr(f"octet_length(passages) div {4 * WIDTH}")).filter(F.col("n") <= most), "bags")
    # whole documents, until their passages are as many as the driver may hold; a row for each of the sample
    so_far = F.sum("n").over(Window.orderBy("h", "label", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    narrow = encoded.select("h", "label", "n").orderBy("h", "label", "n").limit(sample).withColumn("total", so_far)
    last = narrow.filter(F.col("total") <= most).agg(F.max(F.struct("h", "label", "n")).alias("last")).first()["last"]
    if last is None:
        return None
    border = F.struct(*(F.lit(last[c]).alias(c) for c in ("h", "label", "n")))
    rows = encoded.filter(F.struct("h", "label", "n") <= border).orderBy("h", "label", "n", "passages").limit(sample).collect()
    bags = [np.frombuffer(r["passages"], "<f4").reshape(-1, WIDTH) for r in rows]
    return Model(seed).fit(np.concatenate(bags).astype(float), np.array([len(b) for b in bags]), np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: Model | None, keep: list[str], name: str = "score") -> DataFrame:
    """The columns of ``keep`` and the score, under ``name``, of each document."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if model is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                scores = model.forward(*passages(*_buffers(batch.column(len(keep)))))["score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(scores)], [*keep, name])

    plain = docs.select(*keep, text_of().alias("_text"))
    return plain.mapInArrow(run, f"{schema}, `{name}` double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    scored = score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), fit(docs, labels), ["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model accepts; all of them if there are no labelled rows to learn from."""
    columns = docs.columns
    if (model := fit(docs, labels)) is None:
        return docs
    # numbered names can't clash with those of the input
    named = docs.select(text_of().alias("text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)])
    scored = score(named, model, [f"_k{i}" for i in range(len(columns))]).filter(F.col("score") >= THRESHOLD)
    return scored.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(columns)])
