"""Odd documents that every operator must handle."""

import pytest

LONG = "alpha beta gamma delta epsilon zeta " * 20000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (1, "One small text about the river and the old bridge that crossed it long ago.", "a", 1, None, "x"),
        (1, "One small text about the river and the old bridge that crossed it long ago.", "a", 1, None, "x"),
        (2, "One small text about the river and the old bridge that crossed it long ago.", None, 2, 5, None),
        (3, None, "b", None, None, None),
        (None, "Nobody knows which number this text has.", "c", 4, 7, "y"),
        (4, "", None, None, None, None),
        (5, "", None, None, None, None),
        (6, LONG, "d", 6, 6, "z"),
        (7, " ... !!! ", "d", 6, 6, "z"),
        (None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, _digest string, key bigint, _c1 bigint, hi string").toDF("doc_id", "text", "_digest", "key", "_c1", "TEXT")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
