import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomlake.llm import sharding

from .conftest import prose, row, rows


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=120))
def test_bins_equal_brute_force(sizes):
    sizes = sorted(sizes, reverse=True)
    got = sharding.best_fit_decreasing(np.array(sizes, dtype=np.int64), 50)
    room, want = [], []
    for s in sizes:
        fits = [(r, b) for b, r in enumerate(room) if r >= s and r is not None and r >= 0]
        if s > 50:
            room.append(-1)
            want.append(len(room) - 1)
        elif fits:
            b = min(fits)[1]
            room[b] -= s
            want.append(b)
        else:
            room.append(50 - s)
            want.append(len(room) - 1)
    assert got.tolist() == want


def test_tree_stays_balanced():
    room = sharding.Room()
    for i in range(4096):
        room.add((i, i))
    assert room.root[3] <= 1.45 * np.log2(4097)
    taken = [room.take_tightest(2000) for _ in range(10)]
    assert [t[0] for t in taken] == list(range(2000, 2010)) and room.take_tightest(5000) is None


@pytest.mark.parametrize("shards_a_task", [16, 2])
def test_groups_stay_together_within_capacity(make, monkeypatch, shards_a_task):
    monkeypatch.setattr(sharding, "SHARDS_A_TASK", shards_a_task)
    docs = make([row(i, prose(i % 150, 5 + i % 150)) for i in range(400)] + [row(900, "y" * 9000)])
    got = sharding.shard(docs, capacity=4000).toPandas()
    assert len(got) == 401
    assert got.groupby("group_id").shard.nunique().max() == 1
    texts = dict(map(tuple, docs.select("doc_id", "text").collect()))
    assert got.groupby(got.doc_id.map(texts)).group_id.nunique().max() == 1
    used = got.groupby("shard").n_bytes.sum()
    big = got[got.n_bytes > 4000].shard.iloc[0]
    assert got[got.shard == big].doc_id.tolist() == [900]
    rest = used.drop(big)
    assert rest.max() <= 4000 and len(rest) <= 1.1 * np.ceil(rest.sum() / 4000) + 1


def test_edge_cases(edge, empty):
    got = sharding.shard(edge)
    assert rows(got.select("doc_id")) == rows(edge.select("doc_id"))
    got = got.toPandas()
    assert got.shard.nunique() == 1 and got.n_bytes.sum() == sum(len((r.text or "").encode()) for r in edge.collect())
    assert sharding.shard(empty).count() == 0


def test_empty_documents_fill_shards_and_tasks(make, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS_A_TASK", 100)
    got = sharding.shard(make([row(i, None) for i in range(1000)]), capacity=300).toPandas()
    assert len(got) == 1000 and got.groupby("shard").size().max() <= 300 and got.shard.nunique() <= 5
