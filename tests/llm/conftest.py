import pytest

LONG = "word and more of it " * 4000


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns named like those that operators add."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog, again and again.", "en", "a", 61), (1, "The quick brown fox jumps over the lazy dog, again and again.", "en", "a", 61),
        (2, None, "en", "a", None), (3, "", None, None, 0), (None, "a text whose id is null, with token = abcdef12", "de", "b", 45), (4, "   \n\t ", "fr", "c", 6),
        (5, "!!! ### 123", "en", "a", 11), (6, LONG, "en", "a", len(LONG)), (7, "Ünïcode – 日本語 🙂 text", "de", None, 24), (8, "THE QUICK brown fox jumps over the lazy dog again and again", "en", "a", 60),
    ]
    more = ", ".join(f"{c} string" for c in ("score", "held_out", "key_id", "node", "marks", "row", "host", "n", "predicted"))
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {more}").cache()


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
