import random
from itertools import combinations

import numpy as np
import pytest

from fathomlake.llm import neardup as nd

from .conftest import prose, row, rows, word


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(word(r) if r.random() < share else w for w in text.split())


def similarity(a, b):
    sets = []
    for t in (a, b):
        _, e, w = nd.weighted_sets([t])
        sets.append(dict(zip(e.tolist(), w.tolist())))
    keys = set(sets[0]) | set(sets[1])
    return sum(min(s.get(k, 0) for s in sets) for k in keys) / max(1, sum(max(s.get(k, 0) for s in sets) for k in keys))


def test_agreement_estimates_weighted_jaccard():
    base = prose(1, 200) + " tick tock" * 60
    for share in (0.02, 0.1, 0.3):
        other = edited(base, share, 5)
        sig, has = nd.signatures(*nd.weighted_sets([base, other]), 2, t=2048)
        assert has.all() and abs((sig[0] == sig[1]).mean() - similarity(base, other)) < 0.05


def test_fractional_weights():
    doc, e = np.array([0, 0, 1, 1]), np.array([1, 2, 1, 2], dtype=np.uint64)
    sig, _ = nd.signatures(doc, e, np.array([0.5, 1.25, 1.0, 0.75]), 2, t=4096)
    assert abs((sig[0] == sig[1]).mean() - (0.5 + 0.75) / (1.0 + 1.25)) < 0.04


def test_signature_does_not_depend_on_the_batch():
    texts = [prose(i, n) for i, n in enumerate((1, 2, 3, 30, 3000))]
    together, _ = nd.signatures(*nd.weighted_sets(texts), len(texts))
    for t, s in zip(texts, together):
        assert (nd.signatures(*nd.weighted_sets([t]), 1)[0][0] == s).all()


def groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in parent}


@pytest.fixture(scope="module")
def corpus():
    texts = {i: prose(i, 30 + 7 * (i % 40)) for i in range(120)}
    for i in range(40):
        texts[200 + i] = edited(texts[i], 0.04, i)
    for i in range(60):
        texts[300 + i] = edited(texts[5], 0.03, 900 + i)  # a large group
    shared = prose(77, 60)
    for i in range(20):  # a passage that clean documents share
        texts[400 + i] = prose(5000 + i, 150) + " " + shared + " " + prose(6000 + i, 150)
    texts[500] = texts[1]
    return texts


def test_recall_and_clean_documents(make, corpus):
    got = dict(map(tuple, nd.near_copies(make([row(i, t) for i, t in corpus.items()])).collect()))
    pairs = [(a, b) for a, b in combinations(sorted(corpus), 2) if similarity(corpus[a], corpus[b]) >= 0.6]
    assert len(pairs) > 500
    root = lambda x: got.get(x, x)
    assert np.mean([root(a) == root(b) for a, b in pairs]) >= 0.97
    linked = groups([(a, b) for a, b in combinations(sorted(corpus), 2) if similarity(corpus[a], corpus[b]) >= 0.35])
    assert all(linked[a] == linked[b] for a, b in got.items())
    assert not set(range(400, 420)) & set(got)
    assert all(b < a and b not in got for a, b in got.items())


def test_whole_rows_stay(make, corpus):
    docs = make([row(i, t) for i, t in corpus.items()])
    gone = {r.doc_id for r in nd.near_copies(docs).collect()}
    out = nd.drop_near_copies(docs)
    assert out.schema == docs.schema and {r.doc_id for r in out.collect()} == set(corpus) - gone


def test_link_connects_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sigs = rng.integers(0, 3, (rng.integers(2, 25), 8)).astype(np.uint16)
        want = groups([(i, j) for i, j in combinations(range(len(sigs)), 2) if (sigs[i] == sigs[j]).mean() >= 0.6])
        assert groups(nd.link(sigs, 0.6)) == want


@pytest.mark.parametrize("block", [2000, 3])
def test_buckets_link_what_all_pairs_link(spark, monkeypatch, block):
    """Buckets of like and unlike members, in blocks or whole: the groups are those of all pairs that share a band."""
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = np.random.default_rng(9)
    kinds = rng.integers(0, 1 << 16, (6, nd.DARTS))
    kinds[3:, :40] = kinds[0, :40]  # unlike, in common buckets
    sigs = kinds[rng.integers(0, 6, 60)]
    sigs = np.where(rng.random(sigs.shape) < rng.choice([0.05, 0.25, 0.5], (60, 1)), rng.integers(0, 1 << 16, sigs.shape), sigs).astype("<u2")
    sketches = spark.createDataFrame([(i, i, i, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "doc_id long, body long, node long, sig binary")
    bands = sigs.reshape(60, nd.BANDS, nd.ROWS)
    want = groups([(i, j) for i, j in combinations(range(60), 2) if (bands[i] == bands[j]).all(axis=1).any() and (sigs[i] == sigs[j]).mean() >= nd.LEAST])
    got = [tuple(r) for r in nd._edges(sketches, nd.LEAST).collect()]
    assert groups(got) == want and len(set(want.values())) > 3
    assert all((sigs[i] == sigs[j]).mean() >= nd.LEAST for i, j in got)


def test_recall_at_the_threshold(make):
    """Lone pairs of similarity 0.5 to 0.6 are found."""
    texts, near = {}, []
    for i in range(300):
        a = prose(20_000 + i, 150)
        b = edited(a, 0.125, i)
        if 0.5 <= similarity(a, b) < 0.6:
            near.append(i)
            texts[i], texts[1000 + i] = a, b
    assert len(near) > 60
    got = dict(map(tuple, nd.near_copies(make([row(i, t) for i, t in texts.items()])).collect()))
    assert np.mean([got.get(1000 + i) == i for i in near]) >= 0.93


def test_components_equal_union_find(spark):
    r = random.Random(2)
    pairs = [(r.randint(-300, 300), r.randint(-300, 300)) for _ in range(350)] + [(i, i + 1) for i in range(1000, 1100)]
    pairs = [(a, b) for a, b in pairs if a != b]
    got = nd.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert dict(map(tuple, got)) == groups(pairs)
    assert nd.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_cases(edge, empty):
    got = rows(nd.near_copies(edge))
    assert got == [(2, 1), (7, 6)]
    left = nd.drop_near_copies(edge)  # of id 1 and of no id, a row repeated whole stays once
    assert left.schema == edge.schema and left.count() == edge.count() - 4 and left.filter("text is null").count() == 3
    assert nd.near_copies(empty).count() == 0 and nd.drop_near_copies(empty).count() == 0
