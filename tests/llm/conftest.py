import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity: null, empty and blank texts, no letters, very long, repeated rows, a null id, and clashing extra columns."""
    long = "lorem ipsum dolor sit amet " * 8000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en"), (2, None, "en"), (3, "", None), (4, " \t\n ", "de"), (5, "12 34 !!", "fr"), (6, long, "en"), (7, "x" * 50_000, "de"),
        (8, "same words here again", "en"), (8, "same words here again", "en"), (None, "no id at all here", "en"), (9, "é ß 漢字 \U0001f600 'twas we'll", None), (10, "The quick brown fox jumps over the lazy dog", "en"),
    ]
    rows = [(*r, 1, b"x", 2.0, "k", 3) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, data binary, score double, set string, bucket int")
    return df.selectExpr("*", "bucket as block", "1 as `a.b`", "'y' as `x y`", "2 as _no_text", "3 as row", "4 as whole", "5 as at", "6 as `tick``ed`")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
