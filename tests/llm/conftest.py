import pytest

#: Null, empty and blank texts, ties, a very long text, equal rows, odd white space, non-ASCII and junk.
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(6000))
BASE = " ".join(f"token{i}" for i in range(60))
TEXTS = [
    (0, None, "b"), (1, "", "b"), (2, " \n\t ", None), (3, "one two", "a"), (4, "One\x0bTWO", "a"), (5, LONG, "a"), (6, BASE, "a"), (7, BASE.upper(), "c"), (8, BASE + " extra", "c"),
    (9, BASE.replace("token5 ", "tok "), "c"), (10, "é\xa0ß naïve\u2003x " + BASE, None), (11, "spam spam spam spam spam spam spam spam spam spam spam spam", "b"), (12, "line\nline\n\nline\n" + BASE, "b"),
    (13, "<|endoftext|> a  b   c <|im_end|> ###$$$", "b"), (6, BASE, "a"), (None, BASE, "a"), (15, LONG + " " + BASE, "a"), (16, "x" * 5000, "c"), (17, "same words here", None), (18, "same words here", None),
]


@pytest.fixture(scope="session")
def docs(spark):
    """doc_id, text, source, and columns whose names operators use themselves."""
    rows = [(i, t, "xx", s, len(t or ""), "n", 1, "k") for i, t, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n string, size int, key string").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
