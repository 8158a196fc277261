"""Rows that every text operator has to handle."""

import pytest

#: Nulls, empty and very long texts, blanks only, repeated rows, equal texts, odd characters.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. Again and again.", "en"),
    (2, "The quick brown fox jumps over the lazy dog. Again and again.", "en"),
    (2, "The quick brown fox jumps over the lazy dog. Again and again.", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, "   \n\t ", "de"),
    (6, "Der schnelle braune Fuchs springt über den faulen Hund, sagte er.", "de"),
    (7, "x", None),
    (8, "日本語のテキスト 😀 \u0000 á \x1c ﬁ", "ja"),
    (9, "word " * 60_000, "en"),
    (None, "a row without an id", "en"),
    (-5, "1234 5678 !!! ???", "en"),
    (2**62, "The quick brown fox jumps over the lazy cat. Again and again.", "en"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Clashing further columns: names that the operators use inside."""
    rows = [(i, t, lang, "s", len(t or ""), 1, "k", b"d", 0) for i, t, lang in TEXTS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, digest binary, shard int"
    return spark.createDataFrame(rows, schema).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
