import pytest

from millrace.llm.common import prepare

LONG = " ".join(f"word{k % 997} und{k % 31}" for k in range(30_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, rank string, score string, node string, key string, start string"


@pytest.fixture(autouse=True)
def workers(spark):
    prepare(spark)


def _row(doc_id, text, lang="en", source="s1"):
    # Columns behind n_chars carry names that operators use for their own.
    return (doc_id, text, lang, source, len(text or ""), "a", "b", "c", "d", "e", "f")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, characters beyond the BMP."""
    near = " ".join(f"n{k}" for k in range(100))
    return [
        _row(1, "The quick brown fox jumps over the lazy dog, mail a.b@example.com now."),
        _row(2, ""),
        _row(3, None),
        _row(None, "no id here"),
        _row(5, LONG, None, None),
        _row(5, LONG, None, None),
        _row(6, "  \n\n \t ", "fr", ""),
        _row(7, "é 日本 😀 x 😀 +1 (487) 555-7209 😀 10.0.0.1", "de", "s2"),
        _row(8, near, None, "s2"),
        _row(9, near.replace("n50 ", "m50 "), "en", None),
        _row(10, near, "en", "s2"),
        _row(11, near.upper(), "en", "s2"),
        _row(12, "!!! ???", "en", "s3"),
        (None, None, None, None, None, None, None, None, None, None, None),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
