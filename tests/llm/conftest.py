import pytest

COLS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or from (doc_id, text) pairs."""

    def f(rows, schema=COLS):
        full = [(i, r, "en", "s", None) if r is None or isinstance(r, str) else (*r, "en", "s", None)[:5] if len(r) < 5 else r for i, r in enumerate(rows)]
        return spark.createDataFrame(full, schema)

    return f


TEXTS = ["", None, " ", "a", "one two three", "one two three", "Ünïcode ñ ß 漢字   x  y\n\nz", "tab\tand  two spaces <|endoftext|> inside", "\0 \0x y", "word " * 3000, "x" * 5000, " lead and trail ", "it's 12 o'clock, don't!  \n"]


@pytest.fixture(scope="session")
def odd_texts():
    return list(TEXTS)
