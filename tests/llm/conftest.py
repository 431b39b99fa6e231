import pytest

LONG = "lorem ipsum dolor sit amet " * 8000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with the operators' own names."""
    rows = [
        (1, "One two three four five six", "en", "a"), (1, "One two three four five six", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n\x0b ", "en", "b"),
        (5, LONG, "de", "b"), (None, "no id here", "en", "a"), (6, "one TWO three four five six", "en", None), (7, "Ünïcödé 漢字 😀 text\nline\nline\nline", "fr", "c"), (8, "x", "en", "c"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or ""), "keep") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, mine string")
    from pyspark.sql import functions as F

    for name in ("fp", "score", "kept", "ids", "media", "host", "n_words", "secrets", "times", "c1", "pattern", "limit", "again", "segs"):
        df = df.withColumn(name, F.lit("own"))
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
