import pytest

TEXTS = [None, "", " \n\t ", "a", "one two three four five six seven", "one two three four five six seven", "ÀÉ ß 日本語 \U0001f600 x@y.zz +1 (555) 123-4567", "w " * 40_000, "z" * 100_000]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, short, repeated, non-Latin and very long texts; extra columns with clashing names; a null id and a repeated row."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 2 else "s", None, i) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "a null id stands here and there", "en", "s", 1, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int"
    return spark.createDataFrame(rows, schema).withColumnsRenamed({}).selectExpr("*", "score AS size", "lang AS copies", "doc_id AS node", "source AS root", "lang AS `range`", "score AS part")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
