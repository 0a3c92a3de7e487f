"""SentencePiece encoding and decoding of documents, with the source bytes of every piece.

Texts are normalised by the longest entries of the model's compiled character map, which also
gives the source byte of every byte made (``piecemodel``); pieces are projected to byte spans
of the source text over it. The library does the merging and the decoding. Where a character
has no piece, its bytes are pieces: all but the last have an empty span at its start, the last
has the whole character, as in the library.

Defined results: null or empty text has the end id alone and decodes to the empty text;
repeated rows are encoded each; columns of the input stay, but for those named as an added
one (``ids``, ``begins``, ``ends``, ``decoded``), which are replaced; an empty table gives an
empty result. Long texts are merged in parts cut before words, which changes no piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.llm.common import extended, text_of
from tallyard.llm.piecemodel import default_model, piece_model

ADDED = {"ids": "array<int>", "begins": "array<long>", "ends": "array<long>"}


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), kind))


def encode(docs: DataFrame, text: str = "text", model: str | None = None, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (the end id last) and, of each piece, ``begins`` and ``ends``: its bytes of the source.

    With ``decoded``, also with the column that ``decode`` adds, made in the same pass.
    """
    path = model or default_model()
    added = ADDED | ({"decoded": "string"} if decoded else {})

    def run(texts: pa.Array) -> list[pa.Array]:
        pieces = piece_model(path)
        found = pieces.encode(texts.cast(pa.binary()).to_pylist())
        columns = [_lists([x[i] for x in found], pa.int64() if i else pa.int32()) for i in range(3)]
        return [*columns, pa.array([pieces.decode(x[0].tolist()) for x in found], pa.string())] if decoded else columns

    return extended(docs, [c for c in docs.columns if c not in added], text_of(text), added, run)


def decode(encoded: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``: the text that the library makes of its ids."""
    path = model or default_model()

    def run(column: pa.Array) -> list[pa.Array]:
        pieces = piece_model(path)
        return [pa.array([pieces.decode(x or []) for x in column.to_pylist()], pa.string())]

    return extended(encoded, [c for c in encoded.columns if c != "decoded"], F.col(ids), {"decoded": "string"}, run)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_sha256 (of the ends of pieces, joined by spaces; each begins where the one before ends)."""
    joined = lambda column: F.sha2(F.array_join(F.col(column).cast("array<string>"), " "), 256)
    return decoded.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), joined("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), joined("ends").alias("spans_sha256"),
    )
