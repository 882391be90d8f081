"""Small tables with everything that real ones hold: nulls, empty and long texts, ties, repeats, clashing columns."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _text string, _hash long, key string, fp long, kept string, count int, place string, host string, template string"
LONG = " ".join(f"word{k}" for k in range(60_000))


def doc_rows():
    texts = [
        (1, "Alpha beta gamma delta epsilon zeta.\nThe quick brown fox jumps over it.", "en", "a"),
        (2, "ALPHA beta gamma delta epsilon zeta.\nThe quick brown fox jumps over it.", "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n\x0b\x0c\r ", "de", "b"),
        (6, LONG, "en", "b"),
        (7, "Ä ö é   x\nthe quick brown fox jumps over it. \nThe quick brown fox jumps over it.", "de", None),
        (8, "Ä ö é   x\n the QUICK brown fox jumps over it.", None, "b"),
        (8, "Ä ö é   x\n the QUICK brown fox jumps over it.", None, "b"),
        (None, "nobody owns this text", "en", "a"),
        (None, "the quick brown fox jumps over it.", "en", "a"),
        (11, "a b a b a b a b a b a b a b a b", "es", "c"),
        (12, "<|endoftext|> is a string here, \U0001f600 and so on", "en", "c"),
        (13, "one", "fr", "c"),
    ]
    return [(i, t, lang, s, len(t or ""), "x", 1, "k", 2, "no", 3, "p", "h", "t") for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small_docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def small_pages(spark, data):
    return spark.read.parquet(f"{data}/pages.parquet")
