import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomlake.llm import text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab_1 é中.!\n ", max_size=30), max_size=6))
def test_tokens_are_those_of_a_regex(texts):
    h, at = text.tokens(texts)
    want = [re.findall(r"\w+|[^\w\s]", t.lower()) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(h.tolist())) == len(set(flat))
    assert all(len({x for x, w in zip(h.tolist(), flat) if w == v}) == 1 for v in set(flat))


def test_a_token_does_not_depend_on_its_neighbours():
    a, _ = text.tokens(["alpha beta", "gamma"])
    b, _ = text.tokens(["beta gamma", "alpha" * 1 + " " * 50])
    assert set(a.tolist()) == set(b.tolist())


def test_shingles_of_each_text():
    h, at = text.tokens(["a b c d", "a b", "", "b c d"], signs=False)
    s, doc = text.shingles(h, at, 3)
    assert doc.tolist() == [0, 0, 1, 3]
    assert s[1] == s[3] and s[2] not in (s[0], s[1])


def test_chunks_cover_everything_in_order():
    texts = ["x" * n for n in (5, 100, 1, 1, 1, 300, 2)]
    got = list(text.chunks(texts, 10))
    assert [i for a, b in got for i in range(a, b)] == list(range(7))
