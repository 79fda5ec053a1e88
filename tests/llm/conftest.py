import pytest

SCHEMA = "doc_id long, text string, _id string, score double, n_words long, matches string, features string, t int, size long"


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, with extra columns whose names clash with those that operators use or add."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1.5, 7, "m", "f", 3, 9) for i, t in rows], SCHEMA)

    return make


@pytest.fixture
def odd_rows():
    """Null and empty texts, null ids, white space only, repeated rows, a very long text, ties."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "One two three four five six"), (5, "one  two\nthree four five six"),
            (6, "One two three four five six"), (6, "One two three four five six"), (None, "One two three four five six"), (None, None),
            (7, long), (8, long + " x"), (9, "a"), (10, "ümläut 日本 🙂 \u00a0 end"), (11, "a"), (12, "x" * 50_000)]
