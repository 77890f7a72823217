import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, owner int, h int, k int, shard int, node int, body int, id int, y int, _i int, _fl_key int, size int"
EXTRA = (None,) * 12


def word(r):
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(word(r) for _ in range(n))


def row(i, text, lang="en", source="s0"):
    return (i, text, lang, source, None if text is None else len(text), *EXTRA)


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents, with columns named like helpers of the operators."""
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def edge(make):
    """Nulls, empty and very long texts, ties, repeated rows."""
    long = prose(1, 20_000)
    return make([
        row(1, "one two three four five"), row(1, "one two three four five"), row(2, "one two three four five"),
        row(3, ""), row(4, ""), row(5, None), row(5, None), row(None, None), row(None, "no id here at all"), row(None, "no id here at all"),
        row(6, long), row(7, long + " end"), row(8, "  \n\t "), row(9, "lonely words stay here", None, None), row(10, "éè \U0001f600 中文", "zz", None),
        row(2**62 + 1, "a very large name"), row(11, "x" * 9000), row(11, "same name, other text"),
    ])


@pytest.fixture(scope="session")
def empty(make):
    return make([])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(type(x)), x if not isinstance(x, list) else tuple(x)) for x in t))
