"""Queries of the training-data operators over whole tables.

The vector codes have SQL (``oracle``). Each other rests on something DuckDB can't express (trained
models, seeded hashes, tokenizers, image bytes, HTML trees, iterated links); ``tests/llm`` holds
them against brute force, exact round trips and held-out accuracy instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyard.llm import alignment, extraction, fingerprints, interleaved, licenses, mixing, neardup, oracle, packing, pieces, pii, quality, urlrules, vectorcodes
from tallyard.llm.common import materialise, table


def op1_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    payloads = interleaved.payloads(docs)
    sequences = materialise(interleaved.media_of(interleaved.parse_sequences(interleaved.text_documents(docs))), "sequences")
    return interleaved.features(interleaved.resolve(sequences, lambda wanted: interleaved.store(payloads, wanted), ["row"]))


def op2_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op6_prefix_hash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


def op7_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.sample(table(spark, sf_dir, "documents"), ["doc_id"], importance=mixing.by_length())
    return drawn.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken", "copies")


def op9_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"))


def op12_partial_distance_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.coded(table(spark, sf_dir, "embeddings"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_interleaved_media, op2_weak_supervision_pii, op3_mil_quality, op4_harmonic_packing, op5_tree_scoring,
        op6_prefix_hash_fingerprints, op7_license_notices, op8_pareto_mixing, op9_association_rules, op10_circulant_minhash,
        op11_token_groups, op12_partial_distance_codes, op13_sentence_pieces,
    )
}

ORACLE_SQL: dict[str, str] = {"op12_partial_distance_codes": oracle.VECTOR_CODES}
