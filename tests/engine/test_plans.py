"""Operators in many ranges or slices give what one range gives, whatever the columns are called, and empty tables have defined results."""

import random

import pytest
from pyspark.sql import functions as F

from fathomlake.operators import cleaning, enrichment, evaluation, ordering, sampling


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def series(spark):
    r = random.Random(4)
    left = [(i, r.choice([1, 1, 1, 2, None]), r.randint(0, 500)) for i in range(300)]
    right = [(r.choice([1, 1, 1, 2, 3]), r.randint(0, 500), r.randint(0, 9), i) for i in range(120)]
    a = spark.createDataFrame(left, "id int, k int, s int").select("id", "k", F.timestamp_seconds("s").alias("at"), F.lit(1).alias("_t"), F.lit(2).alias("_range"))
    b = spark.createDataFrame(right, "k int, s int, v int, w int").select("k", F.timestamp_seconds("s").alias("seen"), "v", "w")
    return left, right, a, b


def nearest(left, right, direction, most):
    out = []
    for i, k, s in left:
        near = {"backward": lambda x: x <= s, "forward": lambda x: x >= s, "nearest": lambda x: True}[direction]  # noqa: B023
        fits = [(abs(s - x), x, v, w) for kk, x, v, w in right if kk == k and near(x) and (most is None or abs(s - x) <= most)]
        out.append((i, *(min(fits)[2:] if fits else (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("size", [1_000_000, 40])
def test_as_of_by_brute_force(series, direction, size):
    left, right, a, b = series
    got = enrichment.as_of_join(a, b, ["k"], "at", "seen", "id", direction=direction, rows=size)
    assert got.columns == [*a.columns, "seen", "v", "w"]
    assert rows(got.select("id", "v", "w")) == nearest(left, right, direction, None)


def test_as_of_limit(series):
    left, right, a, b = series
    wide = a.withColumn("at", F.timestamp_seconds(F.unix_seconds("at") * 86400)), b.withColumn("seen", F.timestamp_seconds(F.unix_seconds("seen") * 86400))
    assert rows(enrichment.as_of_join(*wide, ["k"], "at", "seen", "id", limit_days=3, direction="nearest").select("id", "v", "w")) == nearest(left, right, "nearest", 3)


@pytest.mark.parametrize("longest", [30, 100_000])
def test_range_join_by_brute_force(spark, longest):
    r = random.Random(5)
    keys = [(i, r.choice([None, r.randint(0, 3000)])) for i in range(200)]
    spans = [(j, b, b + r.choice([0, 3, longest])) for j in range(60) for b in [r.randint(0, 3000)]] + [(99, None, 4), (98, 7, 3)]
    df, ranges = spark.createDataFrame(keys, "id int, key int").withColumn("_b", F.lit(1)), spark.createDataFrame(spans, "j int, b int, e int")
    hits = [(i, j) for i, k in keys for j, b, e in spans if None not in (k, b, e) and b <= k <= e]
    misses = [(i, None) for i, k in keys if i not in {h[0] for h in hits}]
    assert rows(enrichment.range_join(df, ranges, "key", "b", "e", width=10).select("id", "j")) == sorted(hits + misses, key=str)
    assert rows(enrichment.range_join(df, ranges, "key", "b", "e", width=10, how="inner").select("id", "j")) == sorted(hits, key=str)
    with pytest.raises(ValueError):
        enrichment.range_join(df, ranges, "key", "b", "e", width=10, how="right")


@pytest.mark.parametrize("size", [7, 100, 10_000])
def test_ranges_give_what_a_single_one_gives(spark, size, monkeypatch):
    r = random.Random(6)
    values = [(i, r.choice([None, r.randint(-50, 50)]), r.randint(0, 3)) for i in range(1000)]
    df = spark.createDataFrame(values, "id int, x int, _range int")
    order = lambda v: (v[1] is not None, v[1] or 0, v[0])
    got = {t[0]: t[-1] for t in rows(ordering.numbered(df, [F.col("x"), F.col("id")], "n", rows=size))}
    assert got == {v[0]: n for n, v in enumerate(sorted(values, key=order))}
    parts = ordering.ranged(df.filter("x is not null"), F.col("x"), "part", size).groupBy("part").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("part").collect()
    assert all(p.b < q.a for p, q in zip(parts, parts[1:])) and (size > 1000 or len(parts) >= 5)


def test_record_ids_by_segment(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 3 == 0, f"k{i * 7 % 50}") for i in range(90)], "row_id int, late boolean, key string").withColumn("segment", F.col("late").cast("int"))
    ids = {r.row_id: r.system_record_id for r in cleaning.record_ids(df, ["key"], segment="segment").collect()}
    assert sorted(ids.values()) == list(range(90)) and max(v for k, v in ids.items() if k % 3) < min(v for k, v in ids.items() if k % 3 == 0)
    assert ids == {r.row_id: r.system_record_id for r in cleaning.record_ids(df.repartition(5), ["key"], segment="segment").collect()}


def test_caps_in_slices(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b", i) for i in range(800)], "id int, y string, _part int")
    whole = sampling.capped(df, "y", {"a": 50}, "id")
    monkeypatch.setattr(sampling, "SLICE_ROWS", 30)
    sliced = sampling.capped(df, "y", {"a": 50}, "id")
    assert rows(whole) == rows(sliced) and sliced.columns == df.columns
    assert {r.y: r["count"] for r in sliced.groupBy("y").count().collect()} == {"a": 50, "b": 200}


def test_helper_names_do_not_touch_columns(spark):
    df = spark.createDataFrame([(1, 5, 6, 7), (2, 5, 6, 7), (3, 4, 4, 4)], "id int, _place int, _times int, _labelled int")
    assert rows(cleaning.first_of_equal(df, ["_place"], [F.col("id")])) == [(1, 5, 6, 7), (3, 4, 4, 4)]
    assert rows(cleaning.without_repeated(df, ["_times"])) == [(3, 4, 4, 4)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id int, y int, p double")
    for task in ("BINARY", "MULTICLASS"):
        assert sampling.balance(empty, "y", task, "id").count() == 0
    assert sampling.under_sample(empty, "y", "id").count() == 0
    assert evaluation.score(empty, "mae", "y", "p") is None and evaluation.score(empty, "gini", "y", "p") is None
    assert ordering.numbered(empty, [F.col("id")], "n").count() == 0 and cleaning.record_ids(empty, ["y"], segment="y", row_id="id").count() == 0
    assert enrichment.range_join(empty, empty.select(F.col("y").alias("b"), F.col("y").alias("e")), "id", "b", "e", width=3).count() == 0


def test_stability_and_quantiles_of_many_values(spark, monkeypatch):
    """What the driver computes of few counts, and the executors of many, is the same."""
    from fathomlake.operators import stability

    r = random.Random(8)
    rows = [(i, r.choice([None, r.random() * (1 + i / 900)]), r.choice(["a", "b", "b", "c", None]) if i < 700 else r.choice("bcd"), r.choice([None, 1])) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, x double, c string, s int").withColumn("day", F.timestamp_seconds(F.col("i") * 86400))
    few = stability.feature_psi(df, ["x", "c"], "day", ["c"], presence=["s"])
    shares = [0.0, 0.13, 0.5, 1.0]
    quantiles = ordering.quantiles(df, F.col("x"), shares)
    monkeypatch.setattr(ordering, "FEW", 3)
    monkeypatch.setattr(stability, "FEW", 3)
    many = stability.feature_psi(df, ["x", "c"], "day", ["c"], presence=["s"])
    assert set(few) == {"x", "c", "s is present"} and few == pytest.approx(many) and all(v > 0 for v in few.values())
    assert quantiles == pytest.approx(ordering.quantiles(df, F.col("x"), shares)) and ordering.quantiles(df.filter("false"), F.col("x"), shares) == []
