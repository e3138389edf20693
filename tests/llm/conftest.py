import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]) with clashing extra columns."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1.0) for r in rows]
        return spark.createDataFrame(
            full,
            "doc_id long, text string, lang string, source string, n_chars long, size double",
        )

    return make


#: Empty, null, one word, a tie, a repeated row, a very long text.
ODD = [
    (1, ""),
    (2, None),
    (3, "word"),
    (4, "same text here twice over"),
    (5, "same text here twice over"),
    (6, "repeated row"),
    (6, "repeated row"),
    (None, "no id at all"),
    (7, "x" * 100_000),
    (8, "a long text of words " * 5_000),
    (9, " \t\n\x0b\x0c\r "),
]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of(ODD[:1]).where("false")
