import os

import pytest

TOKENIZERS = "/opt/tokenizers"


@pytest.fixture(scope="session")
def odd_rows():
    """doc_id, text, source: NULLs in every column, empty and very long texts, ties, repeated rows."""
    long_text = " ".join(f"w{k % 5000} of" for k in range(40_000))
    base = " ".join(f"word{k}" for k in range(40))
    return [
        (1, base, "a"), (2, base, "a"), (2, base, "a"), (3, base.replace("word7 ", "other "), "b"), (4, None, "a"), (5, "", "b"), (6, " \n\t ", None),
        (7, long_text, "a"), (8, long_text + " end", "b"), (None, base, None), (None, "no id here at all but some words", "a"), (9, "Ä ß é ÉCOLE\x85x y", "c"),
        (10, "one", "c"), (11, "one", "c"), (12, "a\x1cb  c <|endoftext|> d͸", "c"), (13, "x" * 5000, None),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows as documents, with columns whose names clash with the operators' own."""
    rows = [(i, t, "en", s, None if t is None else len(t), "k", 0.5, 1) for i, t, s in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double, size int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sf():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("driver tables not present")
    return path
