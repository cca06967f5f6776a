import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, text_hash string, n int, key int"


def words(rng, n, letters="abcdefghij"):
    return [("".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))) for _ in range(n)]


def edge_rows():
    """Nulls in every column, empty, blank, very long and repeated texts, ties, and columns that operators use as names."""
    rng = random.Random(5)
    long = " ".join(words(rng, 60_000))
    rows = [
        (1, "One two three.", "en", "s", 14, 0.5, "x", 1, 1),
        (1, "One two three.", "en", "s", 14, 0.5, "x", 1, 1),
        (2, None, None, None, None, None, None, None, None),
        (3, "", "en", "s", 0, 0.0, "", 0, 0),
        (4, " \n\t \n", "en", "s", 5, 0.0, "", 0, 0),
        (None, "A text without an id é ü 日本", "xx", "s", 28, 0.0, "", 0, 0),
        (None, None, None, None, None, None, None, None, None),
        (5, long, "en", "s", len(long), 0.0, "", 0, 0),
        (6, "One two three.", "de", "s", 14, 0.5, "x", 1, 1),
    ]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
