import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, fp string, copies string, rank string, __b string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in each column, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    extra = ("x", "y", "z", "c", "r", "b")
    base = "the quick brown fox jumps over the lazy dog and runs far away from here "
    rows = [
        (1, base * 6, "en", "a", 1, *extra), (1, base * 6, "en", "a", 1, *extra), (2, base * 6, "en", "b", 2, *extra), (3, base * 6 + "again", "en", "a", 3, *extra),
        (4, "", "en", "a", 0, *extra), (5, None, "en", "a", None, *extra), (None, "some text without an id", None, None, None, *extra), (None, None, None, None, None, *([None] * 6)),
        (6, " \t\n ", "fr", None, 4, *extra), (7, "word", None, "b", 4, *extra), (8, " ".join(f"w{i % 977}x{i}" for i in range(60_000)), "en", "b", 9, *extra),
        (9, "x" * 300_000, "en", "b", 9, *extra), (-3, "mail me at réné.o@mail.example.com or 4111 1111 1111 1111\n" * 3, "fr", "a", 9, *extra), (10, "Ünï cödé \U0001f600 ﬁn", "de", "c", 9, *extra),
    ]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
