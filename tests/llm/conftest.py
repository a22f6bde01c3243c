import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, uid long, node long, size long, tag string, suspect boolean, shard int, label string"


def _row(doc_id, text, source="s0"):
    return (doc_id, text, None, source, None, None, None, None, None, None, "x", None, None, None)


def words(n, seed, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in all columns, empty and blank texts, repeated rows and ids, ties, one very long text."""
    same = words(80, 1)
    return [
        _row(1, None), _row(2, ""), _row(3, " \t\n"), _row(4, same), _row(4, same), _row(9, same, "s1"), _row(None, same, None), _row(None, None, None),
        _row(5, "short"), _row(6, words(40_000, 2)), _row(7, words(90, 3) + "\n" + same, "s2"), _row(8, "é漢字🔥 " * 5),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (4, 1, 1), (6, None, None), (None, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
