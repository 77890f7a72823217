from itertools import combinations_with_replacement

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomlake.llm import packing

from .conftest import prose, row


def test_combinations_are_all():
    for n in (1, 2, 5, 12):
        want = {c for c in combinations_with_replacement(range(n + 1), 3) if sum(c) == n}
        assert {tuple(c) for c in packing.combinations(n).tolist()} == want


def test_nnls_meets_the_conditions_of_optimality():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a = rng.random((8, 12))
        b = rng.normal(size=8)
        x = packing.nnls(a, a.T @ a, b)
        w = a.T @ (b - a @ x)
        assert (x >= 0).all() and (w <= 1e-5).all() and np.abs(w[x > 0]).max(initial=0) < 1e-5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_windows_hold_their_lengths(lengths):
    n = np.array(lengths, dtype=np.int64)
    at = packing.pack_lengths(n, window=100, steps=20)
    if len(n):
        assert np.bincount(at, weights=n).max() <= 100
        assert set(at.tolist()) == set(range(at.max() + 1))


def test_fill_is_near_the_bound():
    n = np.clip(np.random.default_rng(1).lognormal(7, 1, 20_000).astype(int), 1, 8192)
    at = packing.pack_lengths(n)
    assert n.sum() / 8192 / (at.max() + 1) > 0.97


def test_every_byte_is_in_one_place(make, edge):
    docs = make([row(100 + i, prose(i, 1 + (i * 37) % 300)) for i in range(400)] + [row(1000, "é" * 5000), row(1000, "é" * 5000)]).union(edge)
    got = packing.pack(docs, window=1024, steps=64, shard_rows=150).toPandas()
    sizes = sorted(len((r.text or "").encode()) for r in docs.select("text").collect())
    whole = got.groupby([got.doc_id.fillna(-1), "piece"]).size()
    assert got.length.sum() == sum(sizes) and len(whole) <= len(got)
    packed = got[got.pack_id.notna()].sort_values(["pack_id", "offset"])
    for _, p in packed.groupby("pack_id"):
        assert p.offset.tolist() == [0, *p.length.cumsum().tolist()[:-1]] and p.length.sum() <= 1024
    for i in range(400):
        p = got[got.doc_id == 100 + i].sort_values("piece")
        assert p.start.tolist() == [0, *p.length.cumsum().tolist()[:-1]] and p.length.sum() == len(prose(i, 1 + (i * 37) % 300).encode())
    nothing = got[got.pack_id.isna()]
    assert (nothing.length == 0).all() and len(nothing) == sum(n == 0 for n in sizes)


def test_empty_table(empty):
    assert packing.pack(empty).count() == 0


def test_rows_without_ids_are_spread_over_tasks(make, monkeypatch):
    docs = make([row(None, "x" * 20)] * 3000)
    got = packing.pack(docs, shard_rows=500).toPandas()
    per_task = got.groupby(got.pack_id // (1 << 32)).size()
    assert len(got) == 3000 and len(per_task) == 6 and per_task.max() < 700


def test_against_the_least_number_of_windows():
    """On small inputs: never more than one window above the optimum, found by trying all."""
    rng = np.random.default_rng(2)

    def least(sizes, window):
        best = [len(sizes)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] >= sizes[i]:
                    bins[k] -= sizes[i]
                    go(i + 1, bins)
                    bins[k] += sizes[i]
            go(i + 1, [*bins, window - sizes[i]])

        go(0, [])
        return best[0]

    for _ in range(25):
        n = np.sort(rng.integers(1, 20, 9))[::-1]
        at = packing.pack_lengths(n.astype(np.int64), window=20, steps=20)
        assert least(n.tolist(), 20) <= at.max() + 1 <= least(n.tolist(), 20) + 1
