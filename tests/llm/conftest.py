import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gram string, spans int, fp double, root string, slot int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, lang, source, len(t) if t else None, "x", 1, 0.5, "r", 7) for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    line = "one two three four five six seven eight nine ten "
    return docs_of([
        (1, None, None, None), (2, "", "en", ""), (3, "   \n\t ", "en", "a"), (4, line * 12, "en", "a"), (5, line * 12, "en", "a"),
        (5, line * 12, "en", "a"), (None, line * 12, "en", "b"), (6, "é" * 400, "fr", "b"), (7, "ab" * 150_000, "en", "b"),
        (8, "word " * 60_000, "de", None), (9, "7 8 9 !!", None, "a"), (10, "x", "en", "c"),
    ])
