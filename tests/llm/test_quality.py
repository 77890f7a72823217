import random

import numpy as np
import pytest

from fathomlake.llm import quality

from .conftest import prose, row, rows


def junk(seed, n):
    r = random.Random(seed)
    return " ".join(w + r.choice(["%%%", "###", "|"]) for w in prose(seed, n).split())


@pytest.fixture(scope="module")
def labelled(make, spark):
    docs = make([row(i, (prose if i % 3 else junk)(i, 40 + i % 50)) for i in range(400)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(got) == 400
    right = [got[i].keep == (i % 3 > 0) for i in range(300, 400)]
    assert np.mean(right) >= 0.98
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.keep}


def test_word_vectors_equal_brute_force(make):
    texts = ["a b c a d", "b", "", None, "c c ! a"]
    got = quality.word_vectors(make([row(i, t) for i, t in enumerate(texts)]))
    place, sign = quality._index_vectors()
    want = np.zeros((quality.SLOTS, quality.DIM))
    for t in texts:
        w = quality._slots([t])[0].tolist() if t else []
        for i, x in enumerate(w):
            for j, y in enumerate(w):
                if 0 < abs(i - j) <= quality.REACH:
                    np.add.at(want[x], place[y], sign[y])
    n = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, np.where(n > 0, want / np.maximum(n, 1e-12), 0), atol=1e-6)


def test_pooling_equals_brute_force():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(quality.SLOTS, quality.DIM)).astype(np.float32)
    texts = ["", "one", "one two two three", " "]
    got = quality.pool(texts, v)
    for t, x in zip(texts, got):
        w = quality._slots([t])[0]
        near = (v[w[:-1]] * v[w[1:]]).mean(0) if len(w) > 1 else np.zeros(quality.DIM)
        want = np.concatenate([v[w].mean(0), v[w].std(0), near, [np.log1p(len(w))]]) if len(w) else np.zeros(quality.POOLED)
        assert np.allclose(x, want, atol=2e-3)


def test_network_learns_what_is_not_linear_and_is_calibrated():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(3000) < 0.1)).astype(float)
    net = quality.fit_network(x[:2000], y[:2000])
    p = net.probabilities(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.82
    assert abs(np.where(p > 0.5, p, 1 - p).mean() - ((p > 0.5) == y[2000:]).mean()) < 0.06


def test_edge_cases(edge, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1), (11, 0, None), (6, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = rows(quality.score(edge, labels))
    assert len(got) == edge.count()
    assert all(p == 0.0 and not keep for i, p, keep in got if i in (3, 4, 5, 8))
    kept = quality.keep_good(edge, labels)
    assert kept.columns == edge.columns and kept.schema == edge.schema and kept.count() == sum(k for *_, k in got)
    assert quality.score(empty, labels).count() == 0 and quality.keep_good(empty, labels).count() == 0
    none = rows(quality.score(edge, labels.limit(0)))
    assert {p for i, p, _ in none if i in (1, 2, 6)} == {0.5}
