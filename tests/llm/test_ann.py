import numpy as np
import pytest

from fathomlake.llm import ann


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, v.tolist(), 0, 1, 2) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, cell int, id int, v int")


def brute(x, asked, k):
    """(query, id, rank) by comparing all, the lesser id first among equals."""
    x = x.astype(float)
    out = []
    for q in asked:
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        out += [(q, int(i), r + 1) for r, i in enumerate(np.lexsort((np.arange(len(x)), d))[:k])]
    return out


def recall(got, x, k):
    d = ann._squared(x, x)
    np.fill_diagonal(d, np.inf)
    bound = np.sort(d, axis=1)[:, k - 1]
    hits = [d[r.vec_id, r.neighbor_id] <= bound[r.vec_id] + 1e-5 for r in got]
    return sum(hits) / len(got)


def points(kind, n=1500):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 24))
    if kind == "clusters":
        x = x * 0.1 + rng.normal(size=(12, 24))[rng.integers(0, 12, n)]
    return x.astype(np.float32)


@pytest.mark.parametrize("kind", ["clusters", "noise"])
@pytest.mark.parametrize("nested", [{}, {"fitted": 300, "piece": 60}])
def test_recall_against_brute_force(spark, kind, nested):
    x = points(kind)
    got = ann.neighbours(table(spark, x), k=5, every=1, leaf=32, sample=150, **nested).collect()
    assert len(got) == 7500 and len({(r.vec_id, r.neighbor_id) for r in got}) == 7500
    assert all(r.vec_id != r.neighbor_id for r in got)
    assert recall(got, x, 5) >= ann.TARGET - 0.02
    one = next(r for r in got if r["rank"] == 1)
    assert abs(one.distance - np.linalg.norm(x[one.vec_id] - x[one.neighbor_id])) < 1e-5


def test_queries_are_ids_divisible_by_twenty_and_clusters_need_few_leaves(spark):
    x = points("clusters", 3000)
    got = ann.neighbours(table(spark, x), k=5, leaf=64).collect()
    assert {r.vec_id for r in got} == set(range(0, 3000, 20)) and recall(got, x, 5) >= ann.TARGET - 0.02
    rows, dim = ann.prepared(table(spark, x))
    tree = ann.fit(rows, 3000, dim, 64)
    at = tree.leaf_of(x)
    seen = tree.best_first(x[::20], 6)
    near = np.array([i for _, i, _ in brute(x, range(0, 3000, 20), 5)]).reshape(-1, 5)
    assert len(tree.leaves) > 60 and np.mean([at[i] in s for s, row in zip(seen, near) for i in row]) > 0.8


def test_all_vectors_are_in_the_tree_of_a_sample(spark):
    x = points("noise", 2000)
    got = ann.neighbours(table(spark, x), k=3, every=1, target=1.0, leaf=40, fitted=400, piece=25, sample=2000).collect()
    assert sorted((r.vec_id, r.neighbor_id, r["rank"]) for r in got) == sorted(brute(x, range(2000), 3))


def test_visiting_all_leaves_is_exact():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    ids = np.arange(700)
    piece = ann.Piece.of(ids[::-1], x[::-1], 50)
    who, near, dist = piece.search(x[:50], ids[:50], 4, 1000)
    assert list(zip(who.tolist(), near.tolist())) == [(q, i) for q, i, _ in brute(x, range(50), 4)]
    assert (np.diff(dist.reshape(50, 4)) >= 0).all() and len(piece.tree.leaves) > 10


def test_best_first_opens_the_nearest_first():
    tree = ann.Tree(np.array([[0.0], [-5], [5], [-6], [-4], [4], [9]]), [list(k) for k in ((1, 2), (3, 4), (5, 6), (), (), (), ())])
    x = np.array([[-5.9], [4.4], [0.4]])
    assert tree.best_first(x, 9) == [[3, 4, 5, 6], [5, 6, 4, 3], [5, 4, 3, 6]] and tree.best_first(x, 1) == [[3], [5], [5]]
    assert tree.best_first(x, 2, {3: 0, 4: 2, 5: 1, 6: 7}) == [[4, 5], [5, 6], [5, 4]]
    assert tree.best_first(x, 1, {3: 1, 4: 2, 5: 1, 6: 7}, 4) == [[3, 4, 5], [5, 6], [5, 4, 3]]


@pytest.mark.parametrize("options", [{}, {"leaf": 20, "piece": 10}])
def test_equal_vectors_and_ties(spark, options):
    x = np.ones((300, 4), np.float32)
    got = ann.neighbours(table(spark, x), k=3, every=1, **options).collect()
    assert sorted((r.vec_id, r.neighbor_id, r["rank"]) for r in got) == sorted(brute(x, range(300), 3)) and all(r.distance == 0 for r in got)
    x = np.repeat(np.eye(40, dtype=np.float32), [1, 30, *[2] * 38], axis=0)  # hot and rare vectors
    got = ann.neighbours(table(spark, x), k=4, every=1, target=1.0, **options).collect()
    assert sorted((r.vec_id, r.neighbor_id, r["rank"]) for r in got) == sorted(brute(x, range(len(x)), 4))


def test_a_leaf_with_many_queries_is_shared_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(ann, "ASKED_A_TASK", 7)
    x = points("clusters", 400)
    got = ann.neighbours(table(spark, x), k=3, every=1, target=1.0, leaf=50, sample=400).collect()
    assert sorted((r.vec_id, r.neighbor_id, r["rank"]) for r in got) == sorted(brute(x, range(400), 3))


def test_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, label int"
    data = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 1.0]), (3, None), (4, []), (5, [float("nan"), 0.0]),
            (6, [float("inf"), 1.0]), (7, [1.0, None]), (8, [1.0]), (9, [3.0, 0.0]), (9, [4.0, 0.0])]
    got = ann.neighbours(spark.createDataFrame([(*d, None) for d in data], schema), k=10, every=1).orderBy("vec_id", "rank").collect()
    assert [(r.vec_id, r.neighbor_id, r.distance) for r in got] == [(1, 2, 1.0), (1, 9, 3.0), (2, 1, 1.0), (2, 9, 2.0), (9, 2, 2.0), (9, 1, 3.0)]
    assert ann.neighbours(spark.createDataFrame([], schema)).count() == 0
    assert ann.neighbours(spark.createDataFrame([(1, [1.0], 0)], schema)).count() == 0
    large = spark.createDataFrame([(2**62 + 20 - 4, [1.0], 0), (2**62 + 1, [2.0], 0), (None, [3.0], 0)], schema).coalesce(1)
    assert {r.neighbor_id for r in ann.neighbours(large, every=1).collect()} == {2**62 + 1, 2**62 + 16}
