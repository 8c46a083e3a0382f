import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, start int"


@pytest.fixture
def docs(spark):
    """A documents table with columns whose names also occur inside the operators."""

    def make(rows):
        full = [(i, t, "en", s, len(t) if t is not None else None, True, 0.5, 1) for i, t, s in ((*r, "a")[:3] for r in rows)]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three four five six"), (5, "one  two\nthree four five six"), (5, "one  two\nthree four five six"), (None, "alone here"), (6, "x" * 50_000), (7, "wort " * 30_000)]


@pytest.fixture
def odd(docs):
    """Nulls, empty and very long texts, repeated rows, a row without id."""
    return docs(ODD)


@pytest.fixture
def none(docs):
    return docs([])
