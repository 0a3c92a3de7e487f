"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and, but for
the last, returns the columns of documents. Between stages the rows are written as Parquet
and read again.

In every stage null texts count as empty, null doc_ids, sources and languages are values like
others, and an empty table gives an empty result. Columns beyond those of documents stay up to
the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyard.llm import mixing, neardup, packing, pii, quality
from tallyard.llm.common import materialise, table

#: Documents are near copies from this Jaccard similarity of their shingles on.
PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on the labelled rows of ``docs``, accepts.

    Repeated rows are judged each; equal texts get equal scores, and a score at the border stays.
    Without any labelled row nothing is learnt and all rows stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id, null last.

    Of rows with the same id and text one stays; of those with the same id and other texts, the
    one with the smallest digest. Rows without a word are copies of nothing and all stay.
    """
    return neardup.drop_near_duplicates(docs, PERCENT)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked.

    Overlapping spans are one mask, named by the first. Null texts stay null; repeated rows are masked each.
    """
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, none more than three times.

    A null source is a source, the last in order. Equal rows are drawn each for itself, ties of ranks
    by row; documents without a word bring nothing to a target, taken or not.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences.

    A null or empty text is one token, the end. Copies of a document are packed each.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", without_near_duplicates),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: No SQL: every stage but the last rests on a trained model or seeded hashes, the last on a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    name, stage = STAGES[-1]
    return materialise(stage(spark, docs, sf_dir), f"stage-{name}")
