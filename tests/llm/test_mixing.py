from collections import Counter

import numpy as np
import pytest

from fathomlake.llm import mixing

from .conftest import row, rows

SIZES = {"hot": 700, "a": 90, "b": 90, "c": 33, None: 20}


@pytest.fixture(scope="module")
def docs(make):
    out, i = [], 0
    for s, n in SIZES.items():
        for _ in range(n):
            out.append(row(i, f"text {i}", "en", s))
            i += 1
    return make(out)


def test_quotas_by_brute_force():
    for weights in (None, {"hot": 1, "a": 1, "b": 2}, {"hot": 1, "a": 100}, {}, {None: 1.0}):
        for share in (0.1, 0.5, 1.0):
            q = mixing.quotas(SIZES, weights, share, block=4)
            w = {s: n**mixing.POWER for s, n in SIZES.items()} if weights is None else {s: weights.get(s, 0) for s in SIZES}
            limit = {s: -(-n // 4) if w[s] else 0 for s, n in SIZES.items()}
            want = min(round(share * sum(SIZES.values()) / 4), sum(limit.values()))
            assert sum(q.values()) == want and all(0 <= q[s] <= limit[s] for s in q)
            lo, hi = 0.0, 1e9  # the level at which sources fill to weight * level or all they have
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if sum(min(limit[s], w[s] * mid) for s in q) < want else (lo, mid)
            assert all(abs(q[s] - min(limit[s], w[s] * hi)) <= 1.0 + 1e-6 for s in q)


def test_tree_deals_every_block_once():
    have = np.array([40, 7, 0, 13])
    got = list(mixing.leaves((0, 9, np.zeros(4, int), have), 60, 9, seed=3))
    assert [g[0] for g in got] == list(range(9))
    assert [int(g[2].sum()) for g in got] == [(i + 1) * 60 // 9 - i * 60 // 9 for i in range(9)]
    assert (sum(g[2] for g in got) == have).all()
    run = np.zeros(4, int)
    for _, begin, h in got:
        assert (begin == run).all()
        run = run + h


def test_deal_is_hypergeometric():
    counts = [list(mixing.leaves((0, 4, np.zeros(2, int), np.array([8, 24])), 32, 4, seed=s))[1][2][0] for s in range(3000)]
    # 8 draws of 32 with 8 marked: mean 2, variance 8 * 1/4 * 3/4 * 24/31
    assert abs(np.mean(counts) - 2) < 0.1 and abs(np.var(counts) - 8 * 0.25 * 0.75 * 24 / 31) < 0.1


@pytest.mark.parametrize("rows_in_bucket", [100_000, 60])
def test_plan(docs, monkeypatch, rows_in_bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows_in_bucket)
    got = mixing.plan(docs, block=4, shard_docs=40).toPandas()
    assert got.doc_id.is_unique
    q = mixing.quotas(SIZES, block=4)
    n = Counter(s if isinstance(s, str) else None for s in got.source)
    assert all(4 * q[s] - 3 <= n[s] <= 4 * q[s] for s in SIZES)
    per_block = got.groupby([got.source.fillna("-"), "block"])
    assert per_block.size().max() == 4 and per_block.shard.nunique().max() == 1
    for _, s in got.groupby("shard"):
        assert sorted(s.position) == list(range(len(s)))
    assert got.groupby("shard").size().between(28, 40).all()
    assert rows(mixing.plan(docs, block=4, shard_docs=40)) == rows(mixing.plan(docs.repartition(7), block=4, shard_docs=40))


def test_whole_rows(docs):
    plan = rows(mixing.plan(docs, block=4).select("doc_id"))
    out = mixing.mix(docs, block=4)
    assert out.schema == docs.schema and rows(out.select("doc_id")) == plan


@pytest.mark.parametrize("sizes", [{"hot": 90_000, **dict.fromkeys("abcde", 2000)}, {"hot": 200_000, **{f"s{i}": 4000 for i in range(20)}}, {f"s{i}": 500 for i in range(20)}])
@pytest.mark.parametrize("given", [False, True])
def test_targets_meet_the_weights(sizes, given):
    w = {s: 1.0 + i % 3 for i, s in enumerate(sizes)} if given else {s: n**0.7 for s, n in sizes.items()}
    got = mixing.targets(sizes, w if given else None)
    total = sum(got.values())
    assert all(abs(got[s] - total * w[s] / sum(w.values())) <= 1 + len(sizes) / 10 for s in sizes)
    assert all(got[s] <= n for s, n in sizes.items()) and any(got[s] == n for s, n in sizes.items())


def test_drawn_shares_are_the_weights(make):
    skewed = {"hot": 1500, "a": 50, "b": 50, "c": 37}
    docs = make([row(i, "t", "en", s) for i, s in enumerate(s for s, n in skewed.items() for _ in range(n))])
    for weights in (None, {"hot": 3, "a": 1, "b": 1}, {"hot": 1, "c": 1}):
        w = {s: n**0.7 for s, n in skewed.items()} if weights is None else weights
        n = Counter(r.source for r in mixing.plan(docs, weights=weights).collect())
        total = sum(n.values())
        assert all(abs(n[s] - total * w.get(s, 0) / sum(w.values())) <= 1.5 for s in skewed)
        assert any(n[s] == skewed[s] for s in w)


def test_sources_that_meet_the_weights_are_drawn_whole(make):
    docs = make([row(i, "t", "en", f"s{i % 5}") for i in range(5 * 50)])
    assert rows(mixing.plan(docs).select("doc_id")) == [(i,) for i in range(250)]


def test_edge_cases(edge, empty, make):
    every = mixing.plan(edge, share=1.0, block=1)
    assert rows(every.select("doc_id", "source")) == rows(edge.select("doc_id", "source"))
    assert rows(mixing.mix(edge, share=1.0, block=1)) == rows(edge)
    some = mixing.mix(edge, share=0.5, block=1)
    assert some.count() == mixing.plan(edge, share=0.5, block=1).count() == 9
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.plan(edge, weights={}).count() == 0
    assert {r.source for r in mixing.plan(edge, weights={None: 1.0}, share=0.1, block=1).collect()} == {None}


def test_many_rows_of_one_id(make, monkeypatch):
    """Rows without ids, and repeated ones, are drawn one by one, in blocks, and none twice."""
    from fathomlake.llm import shared

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    docs = make([row(None, f"t{i}", "en", "hot") for i in range(400)] + [row(7, "same", "en", "a")] * 120)
    plan = mixing.plan(docs, weights={"hot": 1, "a": 1}, block=4, shard_docs=40).toPandas()
    assert Counter(plan.source) == {"hot": 120, "a": 120} and plan.groupby("shard").size().max() <= 40
    out = mixing.mix(docs, weights={"hot": 1, "a": 1}, block=4, shard_docs=40).toPandas()
    assert Counter(out.source) == {"hot": 120, "a": 120} and out[out.source == "hot"].text.is_unique
    got = rows(shared.numbered(docs, ["doc_id", "source"], "copy", block=50))
    assert [g[2] for g in got if g[0] is None] == list(range(400)) and [g[2] for g in got if g[0] == 7] == list(range(120))
