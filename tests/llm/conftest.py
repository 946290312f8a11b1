import pytest

LONG = "word " * 30_000
CLASHING = "frag int, node long, score double, rank int, spans string, _text string, bucket int, size int"


@pytest.fixture
def docs_of(spark):
    """Documents from texts, or from (doc_id, text) pairs, with further columns of awkward names."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        data = [(*r, None, "s", None, 1, 2, 0.5, 3, "x", "y", 4, 5) for r in rows]
        return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")

    return make


@pytest.fixture
def odd_docs(docs_of):
    """Null ids and texts, empty and blank texts, a long one, a repeated row, equal texts."""
    return docs_of([(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "x y z"), (2, None), (3, ""), (4, " \n "), (9, LONG), (7, "A B C D E F G"), (1, "é\x00 😀")])
