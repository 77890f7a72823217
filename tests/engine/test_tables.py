import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomlake.functions import keys
from fathomlake.operators import cleaning, enrichment, evaluation, ordering, sampling, stability, targets, timelines
from fathomlake.sources.files import read_csv, read_parquet, write_parquet
from fathomlake.sources.registry import Enricher, Registry, Source, select_features
from fathomlake.streaming import stream_features, windowed


def table(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def one(spark, column, values, kind="string"):
    df = table(spark, f"i int, x {kind}", list(enumerate(values)))
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


# Keys


def test_normal_forms(spark):
    assert one(spark, keys.country, ["  rU 1", " Uk", "G B ", "Zimbabwe", None]) == ["RU", "GB", "GB", "ZW", None]
    assert one(spark, keys.postal_code, ["  0ab-0123 ", "0123  3948  ", "103305.0", "0", None]) == ["AB0123", "1233948", "103305", "0", None]
    assert one(spark, keys.postal_code, [103305.0, 111222.0], "double") == ["103305", "111222"]
    assert one(spark, keys.phone, ["+1 (814) 300-81-98", "79991234567.0", "123", "1234567890123456", "x", None]) == [18143008198, 79991234567, None, None, None, None]
    assert one(spark, keys.email_domain, ["test@google.com", "fake", "a@b@c", None]) == ["google.com", None, None, None]
    assert one(spark, keys.email_one_domain, ["test@google.com", "fake", "@x.de"]) == ["t@google.com", None, None]
    h = one(spark, keys.email_hash, ["Test@google.com", "test@google.com", "fake", None])
    assert h[0] == h[1] and len(h[0]) == 64 and h[2:] == [None, None]


def test_phone_prefix(spark):
    df = table(spark, "p long, c string", [(8143008198, "US"), (18143008198, "US"), (8143008198, "XX"), (None, "US")])
    assert [r[0] for r in df.select(keys.phone_with_prefix(F.col("p"), F.col("c"))).collect()] == [18143008198, 18143008198, 8143008198, None]


def test_ip(spark):
    got = one(spark, lambda c: keys.ip(c), ["192.168.1.1", "1050:0000:0000:0000:0005:0600:300c:326b", "", None, "3232235777", "::ffff:10.1.2.3", "x"])
    assert [g["prefix"] for g in got] == ["192.168", "1050:0000", None, None, "192.168", "10.1", None]
    assert bytes(got[0]["binary"]) == bytes([192, 168, 1, 1]) and len(got[1]["binary"]) == 16


@pytest.mark.parametrize("values, kind, want", [
    ("2020-01-01 2020-01-02".split(), "string", 1577836800000), (["01.01.2020", "31.12.2020"], "string", 1577836800000), (["2020-01-01 10:11:12", None], "string", 1577836800000),
    ([1577840000, 1577840001], "long", 1577836800000), ([1577840000000, 1577840000001], "long", 1577836800000), ([datetime.date(2020, 1, 1), None], "date", 1577836800000), (["1999-12-30", "2020-01-01"], "string", None),
])
def test_dates(spark, values, kind, want):
    df = table(spark, f"i int, d {kind}", list(enumerate(values)))
    assert df.orderBy("i").select(keys.date_key(keys.parse_dates(df, "d"))).first()[0] == want


def test_cyclical(spark):
    df = table(spark, "d timestamp", [(datetime.datetime(2024, 2, 15, 6, 30, 15),)])
    r = df.select(*[c.alias(n) for n, c in keys.cyclical(F.col("d")).items()]).first()
    assert abs(r.hour_24_sin - 1) < 1e-9 and abs(r.second_60_sin - 1) < 1e-9 and abs(r.day_in_quarter_cos - math.cos(2 * math.pi * 45 / 91)) < 1e-9


def test_detection_and_validation(spark):
    df = table(spark, "when_date string, e string, zip string, my_phone string, country string, x int", [("2024-01-01", "a@b.de", "12345", "1", "DE", 1)] * 5)
    assert keys.detect(df) == {"when_date": "date", "zip": "postal_code", "country": "country", "e": "email", "my_phone": "phone"}
    keys.validate_keys({"a": "phone", "b": "phone", "c": "country", "d": "postal_code"})
    for bad in ({"a": "date", "b": "date"}, {"a": "email", "b": "hem"}, {"a": "postal_code"}, {"a": "date", "b": "datetime"}):
        with pytest.raises(ValueError):
            keys.validate_keys(bad)
    assert keys.needs_current_date({"a": "email"}) and not keys.needs_current_date({"a": "email", "d": "date"})
    assert keys.key_combinations(["a", "b"]) == [("a", "b"), ("a",), ("b",)] and len(keys.key_combinations("abcd")) == 15


# Cleaning


def test_normalize(spark):
    df = table(spark, "b boolean, f float, c string, s string, p string", [(True, 1.5, "1,25", "x" * 30_000, "+49 151 23456789"), (False, None, "3", None, "1")])
    got = cleaning.normalize(df, {"p": "phone"}).collect()
    assert got[0].b == "True" and got[1].b == "False" and got[0].c == 1.25 and len(got[0].s) == cleaning.LONGEST and got[0].p == 4915123456789 and got[1].p is None


def test_uninformative_columns(spark):
    rows = [(i, "c", None if i else "x", i % 2, float(i < 1), str(i)) for i in range(200)]
    df = table(spark, "id long, one string, two string, bit int, rare double, text string", rows)
    assert cleaning.high_cardinality_columns(df) == ["id", "text"] and cleaning.constant_columns(df) == ["one"]
    spread = table(spark, "v double", [(0.5,)] * 300 + [(1.5,), (2.5,)])
    assert cleaning.constant_columns(spread) == ["v"]


def test_names():
    m = cleaning.normal_names(["Total Sum", "1st", "ok"])
    assert all(n[0].isalpha() and n == n.lower() for n in m.values()) and len(set(m.values())) == 3


def test_one_hot(spark):
    df = table(spark, "id int, grp_0 int, grp_1 int, grp_2 int, v int", [(0, 1, 0, 0, 5), (1, 0, 1, 0, 6), (2, 0, 0, 1, 7), (3, 0, 1, 0, 8), (4, 1, 0, 0, 9), (5, 0, 0, 0, 1), (6, 1, 1, 0, 1)])
    groups = cleaning.one_hot_groups(df.drop("id"))
    assert groups == {"grp_": [f"grp_{i}" for i in range(3)]}
    assert [r.grp_ for r in cleaning.decode_one_hot(df, groups).orderBy("id").collect()] == [*"01210", None, "0,1"]


def test_full_duplicates(spark):
    rows = [(0, "a", 1, 0), (1, "a", 1, 0), (2, "b", 1, 0), (3, "b", 0, 0), (4, "a", 1, 1), (5, "c", 1, 1), (6, None, 1, 0), (7, None, 1, 0), (8, "c", None, 2), (9, "z", None, 2)]
    df = table(spark, "row_id int, k string, target int, eval_set_index int", rows)
    got = sorted(r.row_id for r in cleaning.drop_full_duplicates(df, "row_id", segment="eval_set_index").collect())
    assert got == [0, 5, 6, 9]
    assert sorted(r.row_id for r in cleaning.drop_full_duplicates(df.drop("eval_set_index"), "row_id").collect()) == [0, 6, 9]


def test_contradictions(spark):
    rows = [("123", "2020-01-01", 0, 0), ("123", "2020-01-20", 1, 0), ("1", "2020-01-01", 1, 0), ("2", "2020-01-01", 1, 0), ("3", "2020-01-01", 0, 0), ("3", "2020-09-01", 1, 0), ("4", "2020-01-01", 0, 0), ("5", "2020-01-01", 0, 0), ("123", "2020-01-01", 1, 1)]
    df = table(spark, "phone string, date string, target int, seg int", rows).withColumn("date", F.col("date").cast("timestamp"))
    got = cleaning.drop_contradictions(df, ["phone"], "date", "target", "seg")
    assert sorted((r.phone, r.seg) for r in got.collect()) == [("1", 0), ("123", 1), ("2", 0), ("3", 0), ("3", 0), ("4", 0), ("5", 0)]


def test_record_ids_do_not_depend_on_order_or_partitions(spark):
    rows = [(i, f"2024-01-{1 + i % 9:02d}", f"p{i % 4}", i % 2) for i in range(60)]
    df = table(spark, "row_id int, date string, phone string, seg int", rows)
    ids = lambda d: {r.row_id: r.system_record_id for r in cleaning.record_ids(d, ["phone"], "date", "seg").collect()}
    a = ids(df)
    assert sorted(a.values()) == list(range(60)) and a == ids(df.orderBy(F.desc("row_id")).repartition(5))
    assert max(a[i] for i in range(60) if i % 2 == 0) < min(a[i] for i in range(60) if i % 2)
    assert cleaning.digest(df) == cleaning.digest(df.repartition(4)) != cleaning.digest(df.limit(59))


def test_numbering_by_buckets(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    for rows in (90, 10_000):
        got = ordering.numbered(df, [F.col("v")], "n", rows).orderBy("v").collect()
        assert [r.n for r in got] == list(range(1000))
        sums = ordering.sums_before(df.withColumn("w", F.col("v") * 2), "v", ["w"], rows).orderBy("v").collect()
        assert [r.w_before for r in sums] == [sum(2 * x.v for x in got[:i]) for i in range(1000)]
    x = np.random.default_rng(4).integers(0, 50, 300) / 7
    data = table(spark, "x double", [(float(v),) for v in x] + [(None,)])
    for rows in (7, 1000):
        assert np.allclose(ordering.quantiles(data, F.col("x"), [0, 0.13, 0.5, 0.77, 1], rows), np.quantile(x, [0, 0.13, 0.5, 0.77, 1]))
    assert ordering.quantiles(data.limit(0), F.col("x"), [0.5]) == []
    ties = table(spark, "x double", [(x,) for x in (5.0, 1.0, 5.0, None, 2.0)])
    assert dict(map(tuple, ordering.average_ranks(ties, "x", "r").collect())) == {1.0: 1.0, 2.0: 2.0, 5.0: 3.5}


# Joins


def test_joins(spark):
    left = table(spark, "k int, d string, row_id int", [(1, "2024-01-05", 0), (1, "2024-02-20", 1), (2, "2024-01-05", 2), (None, "2024-01-05", 3)])
    src = table(spark, "k int, at string, v int", [(1, "2024-01-01", 10), (1, "2024-01-10", 11), (1, "2024-02-01", 12), (2, "2024-01-06", 20)])
    as_of = lambda **o: [r.v for r in enrichment.as_of_join(left, src, ["k"], "d", "at", "row_id", **o).orderBy("row_id").collect()]
    assert as_of() == [10, 12, None, None] and as_of(limit_days=5) == [10, None, None, None]
    assert as_of(direction="forward") == [11, None, 20, None] and as_of(direction="nearest") == [10, 12, 20, None]
    assert [r.v for r in enrichment.as_of_by_window(left, src, ["k"], "d", "at", "row_id").orderBy("row_id").collect()] == [10, 12, None, None]
    with pytest.raises(ValueError):
        enrichment.enrich(left, src.withColumnRenamed("v", "d"), ["k"])
    assert enrichment.leaked(left.select("k"), table(spark, "k int", [(None,)])) and not enrichment.leaked(left.select("k"), table(spark, "k int", [(7,)]))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_range_join_by_buckets_equals_comparing_all(spark, how):
    rng = np.random.default_rng(0)
    begin = rng.integers(-500, 5000, 80)
    ranges = table(spark, "b long, e long, r int", [(int(b), int(b + rng.integers(0, 30) ** (1 + i % 3)), i) for i, b in enumerate(begin)] + [(None, 4, 900), (9, 3, 901)])
    df = table(spark, "x long, i int", [(int(x), i) for i, x in enumerate(rng.integers(-600, 9000, 300))] + [(None, 999)])
    a, b = (sorted(((r.i, r.r) for r in enrichment.range_join(df, ranges, "x", "b", "e", width=w, how=how).collect()), key=str) for w in (10, None))
    assert a == b and len(a) > 100


# Targets, samples, folds


def test_task_types(spark):
    def task(values, kind="double", **o):
        return targets.task_type(table(spark, f"y {kind}", [(v,) for v in values]), "y", **o)

    assert task([0.0, 1.0, None, float("inf")]) == "BINARY" and task(["a", "b", "c", ""], "string") == "MULTICLASS"
    assert task([0, 1, 2, 2, 1], "int") == "MULTICLASS" and task([1, 2, 3], "int", has_date=True) == "MULTICLASS"
    assert task([0.1, 0.5, 2.0]) == "REGRESSION" and task([3, 9, 27] * 2, "int", has_date=True) == "REGRESSION" and task([3, 9, 27] * 20, "int") == "MULTICLASS"
    for bad in ([], [None], [1.0, 1.0]):
        with pytest.raises(ValueError):
            task(bad)


def test_balance(spark):
    rows = [(i, "a") for i in range(1)] + [(10 + i, "b") for i in range(2)] + [(100 + i, "c") for i in range(20_000)]
    df = table(spark, "row_id int, y string", rows)
    got = sampling.balance(df, "y", "MULTICLASS", "row_id", multi_rows=5000)
    assert dict(sampling.class_counts(got, "y")) == {"c": 9996, "b": 2}
    small = df.filter("row_id < 105")
    assert dict(sampling.class_counts(sampling.balance(small, "y", "MULTICLASS", "row_id", multi_rows=5), "y")) == {"c": 4, "b": 2, "a": 1}
    binary = table(spark, "row_id int, y int", [(i, int(i == 0)) for i in range(10)])
    assert dict(sampling.class_counts(sampling.balance(binary, "y", "BINARY", "row_id", binary_rows=2), "y")) == {0: 5, 1: 1}
    again = [r.row_id for r in sampling.sample(df, 50, "row_id").collect()]
    assert again == [r.row_id for r in sampling.sample(df.repartition(7), 50, "row_id").collect()] and len(set(again)) == 50


def test_strategies():
    counts = [("c", 9), ("b", 5), ("a", 2)]
    assert sampling.strategy_caps(counts) == {"c": 2, "b": 2} and sampling.strategy_caps(counts, "majority") == {"c": 2}
    assert sampling.strategy_caps(counts, "not majority") == {"b": 2, "a": 2} and sampling.strategy_caps(counts, ["b"]) == {"b": 2}
    assert sampling.strategy_caps(counts[:2], 1.0) == {"c": 5}
    for bad in ({"z": 1}, {"a": 3}, "never", 0.5):
        with pytest.raises(ValueError):
            sampling.strategy_caps(counts, bad)


def test_series(spark):
    rows = [(i, f"2024-01-0{d}") for i in range(3) for d in range(1, 4)]
    df = table(spark, "id int, d string", rows)
    assert sampling.time_unit(df, ["id"], "d") == 86400 and sampling.time_unit(df.limit(0), ["id"], "d") is None
    assert sampling.sample_series(df, ["id"], "d", 6).count() == 6 and sampling.sample_series(df, ["id"], "d", 6).select("id").distinct().count() == 2
    few = sampling.sample_series(df, ["id"], "d", 4, least_ids=1.0)
    assert few.count() == 3 and {r.d for r in few.collect()} == {"2024-01-03"}
    assert sampling.recent(df, ["id"], "d", "1 day").count() == 3


def test_folds(spark):
    blocks = sampling.blocked_folds(15555, 5, 0.25)
    assert (blocks[0][0], blocks[0][1]) == (range(0, 2333), range(2333, 3111)) and blocks[4] == (range(12444, 14777), range(14777, 15555))
    assert [(len(a), len(b)) for a, b in sampling.expanding_folds(12, 3)] == [(3, 3), (6, 3), (9, 3)]
    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 40).alias("g"))
    folds = sampling.k_folds(df, "row_id", groups=["g"])
    assert folds.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0 and folds.select("fold").distinct().count() == 5
    with pytest.raises(ValueError):
        sampling.blocked_folds(3, 5)


# Stability and evaluation


def test_psi_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 1200
    pdf = pd.DataFrame({"date": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(n) // 4, "D"), "x": rng.normal(np.linspace(0, 2, n), 1), "c": rng.choice(list("abcdef"), n, p=[0.3, 0.3, 0.2, 0.1, 0.05, 0.05])})
    pdf.loc[::13, "x"] = np.nan
    df = spark.createDataFrame(pdf.replace({np.nan: None}).astype({"x": object}), "date timestamp, x double, c string")
    got = stability.feature_psi(df, ["x", "c"], "date", ["c"])
    part = pd.qcut(pdf.date, 10, duplicates="drop").cat.codes
    ref = pdf[part == 0]
    edges = np.nanquantile(ref.x, np.linspace(0, 1, 11))
    edges[0], edges[-1] = -np.inf, np.inf

    def shares(s):
        counts = np.append(np.histogram(s.x.dropna(), edges)[0], s.x.isna().sum()) / len(s)
        return stability.filled(counts.tolist())

    want = max(sum((a - b) * math.log(a / b) for a, b in zip(shares(ref), shares(pdf[part == i]))) for i in range(1, 10))
    assert abs(got["x"] - want) < 1e-6 and got["c"] > 0
    assert stability.unstable(df, ["x", "c"], "date", ["c"])[:1] == ["x"]
    assert stability.sparsity_psi(df, ["x", "c"], "date").keys() == {"x"}
    assert stability.statistic("q50")([1, 5, 3]) == 3 and stability.statistic("q75")([1, 2, 3, 4]) == 4


def test_ks(spark):
    a, b = (spark.createDataFrame([(float(x),) for x in v], "x double") for v in ([1, 2, 3, 4], [3, 4, 5, 6]))
    assert stability.ks_statistic(a, b, "x") == 0.5 and stability.ks_statistic(a, a, "x") == 0
    assert stability.ks_p_value(0.5, 100, 100) < 1e-6 and stability.ks_p_value(0.01, 100, 100) > 0.99


def test_scores(spark):
    df = table(spark, "y double, p double", [(1.0, 0.9), (0.0, 0.1), (1.0, 0.4), (0.0, 0.4), (0.0, 0.3)])
    assert abs(evaluation.roc_auc(df, "y", "p") - 5.5 / 6) < 1e-12 and abs(evaluation.score(df, "gini", "y", "p") - (11 / 6 - 1)) < 1e-12
    assert abs(evaluation.score(df, "mae", "y", "p") - (0.1 + 0.1 + 0.6 + 0.4 + 0.3) / 5) < 1e-12
    assert evaluation.score(df, lambda d: d.count(), "y", "p") == 5
    assert evaluation.uplift(0.5, 0.6, "gini")["uplift_percent"] == pytest.approx(20) and evaluation.uplift(0.5, 0.4, "rmse")["uplift"] == pytest.approx(0.1)
    with pytest.raises(ValueError):
        evaluation.score(df, "nothing", "y", "p")
    got = evaluation.correlations(df, ["p"], "y").first()
    assert 0 < got.spearman <= 1 and 0 < got.pearson <= 1


def test_cross_validation_finds_the_feature_that_matters(spark):
    rng = np.random.default_rng(3)
    x, noise = rng.normal(size=300), rng.normal(size=300)
    df = table(spark, "row_id int, x double, noise double, y int", [(i, float(a), None if i % 9 == 0 else float(b), int(a > 0)) for i, (a, b) in enumerate(zip(x, noise))])
    out = evaluation.cross_validate(sampling.k_folds(df, "row_id", 2), ["x", "noise"], "y", "BINARY", "fold")
    assert out["mean"] > 0.9 and list(out["importance"])[0] == "x"


# Sources and streams


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n1;x\n2;y\n")
    assert read_csv(spark, str(tmp_path / "a.csv")).collect() == [(1, "x"), (2, "y")]
    write_parquet(spark.range(5), str(tmp_path / "p"), "gzip")
    assert read_parquet(spark, str(tmp_path / "p")).count() == 5
    assert dict(read_parquet(spark, "/root/testdata/sf0.001/events.parquet").dtypes)["ts"] == "timestamp"


def test_enricher(spark):
    people = spark.range(300).select(F.col("id").cast("int").alias("row_id"), F.concat(F.lit("u"), F.col("id") % 150, F.lit("@x.de")).alias("email"), (F.col("id") % 2).cast("int").alias("target"), F.lit("same").alias("flat"), (F.col("id") % 7).cast("int").alias("kind"))
    source = spark.range(1500).select(F.concat(F.lit("u"), F.col("id") * 2, F.lit("@x.de")).alias("mail"), (F.col("id") * 1.0).alias("score"))
    registry = Registry()
    with pytest.raises(ValueError):
        registry.register(Source("small", source.limit(10), {"mail": "email"}))
    registry.register(Source("s", source, {"mail": "email"}, formulas={"score_abs": "abs(score)"}))
    e = Enricher(registry).fit(people, "target")
    assert e.keys == {"email": "email"} and e.dropped == ["flat"]
    rates = {r.key: r.hit_rate for r in e.hit_rates["s"].collect()}
    assert rates["all"] == 0.5 == rates["email"]
    out = e.transform(people.drop("target")).orderBy("row_id").collect()
    assert len(out) == 300 and "flat" not in out[0] and out[2].score == 1.0 == out[2].score_abs and out[1].score is None
    assert select_features({"b": 0.2, "a": 0.2, "c": 0.0, "d": 0.5}, {"a": 0.1, "b": 0.1}) == ["a", "b"]


def test_streams(spark, tmp_path):
    src = table(spark, "t timestamp, k string, v double", [(datetime.datetime(2024, 1, 1, 0, m), "a", float(m)) for m in range(20)])
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert len(run(stream_features(stream, {"sq": "square(v)"}), "rows", "append")) == 20
    got = run(windowed(stream, "t", "v", ["k"], "5 minutes"), "windows", "complete")
    assert sorted(r.v_mean for r in got) == [2.0, 7.0, 12.0, 17.0]
    with pytest.raises(ValueError):
        stream_features(stream, {"f": "freq(k)"})


# Timelines


def test_time_structure(spark):
    days = lambda n, step, per=1: table(spark, "d timestamp, k int, v double", [(datetime.datetime(2020, 1, 1) + datetime.timedelta(days=i * step), j, float(i + j)) for i in range(n) for j in range(per)])
    assert timelines.is_time_series(days(20, 1), "d") and timelines.is_time_series(days(20, 2, 3), "d")
    assert not timelines.is_time_series(days(20, 1).filter("day(d) <> 7"), "d") and not timelines.is_time_series(days(9, 1).union(days(1, 1)), "d")
    months = table(spark, "d timestamp", [(datetime.datetime(2020, m, 1),) for m in range(1, 10)])
    assert timelines.is_time_series(months, "d")
    dense = days(280, 1, 2)
    assert timelines.is_blocked_time_series(dense, "d") and not timelines.is_blocked_time_series(days(100, 1, 2), "d") and not timelines.is_blocked_time_series(days(280, 1), "d")
    assert timelines.cross_validation(dense, {"d": "date"}, "REGRESSION", "v") == "blocked_time_series"
    assert timelines.cross_validation(dense, {"d": "date"}, "BINARY", "v") == "group_k_fold" and timelines.cross_validation(dense, {"k": "custom_key"}, "REGRESSION", "v") == "k_fold"
    assert timelines.dates_are_even(dense, "d") and not timelines.dates_are_even(days(10, 1).union(days(4, 1, 3)), "d")
    assert timelines.group_columns(dense, {"d": "date", "k": "custom_key"}) == ["k"] and timelines.group_columns(dense, {"k": "phone", "v": "ip"}) == ["k"]
    assert timelines.tree_loss("regression_l1", "REGRESSION") == "absolute"
    with pytest.raises(ValueError):
        timelines.tree_loss("binary", "REGRESSION")


@pytest.mark.parametrize("few", [5, 50_000])
def test_median_error_without_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(ordering, "FEW", few)
    monkeypatch.setattr(F, "percentile", None)
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).cast("double").alias("p"), F.lit(500).alias("t"))
    want = sorted(abs(i * 7919 % 1009 - 500) for i in range(1000))
    assert evaluation.score(df, "median_absolute_error", "t", "p") == (want[499] + want[500]) / 2
    assert evaluation.score(df.withColumn("t", F.lit(None).cast("int")), "median_absolute_error", "t", "p") is None
    broken = df.withColumn("p", F.when(F.col("p") < 700, F.lit(float("nan"))).otherwise(F.col("p")))
    assert math.isnan(evaluation.score(broken, "median_absolute_error", "t", "p"))


def test_long_texts_are_made_in_many_tasks(spark):
    from fathomlake import catalogue, catalogue_tables  # noqa: F401

    out = catalogue.QUERIES["normal_forms"](spark, "/root/testdata/sf0.001")
    assert spark.read.parquet("/root/testdata/sf0.001/customer.parquet").rdd.getNumPartitions() == 1
    assert out._jdf.queryExecution().toRdd().getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_drift_and_column_order(spark):
    rng = np.random.default_rng(2)
    make = lambda shift: spark.createDataFrame([(float(a), float(b + shift), float(a + 0.1 * b)) for a, b in rng.normal(size=(200, 2))], "a double, b double, y double")
    train = make(0.0)
    got = evaluation.drift(train, {"same": make(0.0), "moved": make(3.0)}, ["a", "b"])
    assert got[0]["drift_auc"] < 0.6 and got[1]["drift_auc"] > 0.95 and got[1]["features"][0] == "b"
    assert evaluation.column_order(train, ["k"], ["b", "a"], "y") == ["k", "a", "b"]


@pytest.mark.parametrize("few", [5, 50_000])
def test_correlations_equal_pandas_without_ranks_of_rows(spark, monkeypatch, few):
    monkeypatch.setattr(evaluation, "FEW", few)
    if few > 5:
        monkeypatch.setattr(evaluation, "average_ranks", None)
    rows = [(float(i % 4), None if i % 3 == 0 else float(i * 7 % 23), 5.0, float(i * i % 13) if i % 5 else float("nan")) for i in range(90)]
    df = table(spark, "a double, b double, c double, y double", rows)
    pdf = pd.DataFrame(rows, columns=list("abcy")).astype(float)
    got = {r["column"]: r for r in evaluation.correlations(df, ["a", "b", "c"], "y").collect()}
    for c in "ab":
        both = pdf[[c, "y"]].dropna()
        assert abs(got[c].pearson - both[c].corr(both.y)) < 1e-9 and abs(got[c].spearman - both[c].rank().corr(both.y.rank())) < 1e-9
    assert (got["c"].pearson, got["c"].spearman) == (None, None)
    assert evaluation.column_order(df, [], ["c", "b", "a"], "y")[-1] == "c"
