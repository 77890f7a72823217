import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomlake.llm import tokencount as tc

from .conftest import rows


@pytest.fixture(scope="module")
def vocabulary():
    ranks = tc.load_ranks()
    return ranks, tc.Merger(ranks), tiktoken.Encoding("own", pat_str=tc.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_pieces_have_the_same_tokens(vocabulary):
    _, merger, enc = vocabulary
    r = random.Random(3)
    pieces = [bytes(r.choice(b"aabcdeehilnorst.=1\xc3\xa9") for _ in range(r.randint(1, 70))) for _ in range(1500)]
    pieces += [b"a" * n for n in range(1, 40)] + [b"abab" * 50, b"the" * 300, bytes(range(256))]
    for p, got in zip(pieces, merger.merge(pieces)):
        assert enc._encode_single_piece(p) == got.tolist()
    assert merger.count(pieces).tolist() == [len(t) for t in merger.merge(pieces)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(vocabulary, texts):
    ranks, merger, enc = vocabulary
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert tc.TokenCounter(ranks, merger).counts(texts) == [len(enc.encode_ordinary(t)) for t in texts]


def test_a_vocabulary_whose_merge_makes_a_lower_pair():
    # "bcd" has a lower rank than "bc": after the first merge of b and c, it is merged before the next "bc".
    ranks = {bytes([i]): i for i in range(256)} | {b"cd": 300, b"bcd": 301, b"bc": 302, b"dbc": 303}
    enc = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    merger = tc.Merger(ranks)
    r = random.Random(5)
    pieces = [bytes(r.choice(b"bcd") for _ in range(r.randint(2, 30))) for _ in range(300)]
    for p, got in zip(pieces, merger.merge(pieces)):
        assert enc._encode_single_piece(p) == got.tolist()


def test_forgetting_changes_no_count(vocabulary):
    ranks, merger, enc = vocabulary
    counter = tc.TokenCounter(ranks, merger, remembered=3)
    texts = ["some words here", "other words there", "some words here"]
    assert [counter.counts([t])[0] for t in texts] == [len(enc.encode_ordinary(t)) for t in texts]


def test_edge_cases(edge, empty, vocabulary):
    enc = vocabulary[2]
    want = sorted(((r.doc_id, None if r.text is None else len(enc.encode_ordinary(r.text))) for r in edge.collect()), key=str)
    assert sorted(rows(tc.count_tokens(edge)), key=str) == want
    assert tc.count_tokens(empty).count() == 0
