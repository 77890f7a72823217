import datetime

import pytest
from pyspark.sql import functions as F

from fathomlake.operators import cleaning, enrichment, evaluation, sampling
from fathomlake.operators.stability import Stability
from fathomlake.sources.registry import Enricher, Registry, Source, with_literals


def registry(*sources):
    r = Registry()
    for s in sources:
        r.register(s, 1)
    return r


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "A@X.com", None, 10.0, 0), (2, "nobody", "b@x.com", 20.0, 1), (3, None, None, 30.0, 0), (4, "c@x.com", "A@x.COM", 40.0, 1), (4, "c@x.com", "A@x.COM", 40.0, 1)]
    return spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows, 1)], "row_id int, email string, other string, x double, y int")


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame([("a@x.com", 1.0), ("b@x.com", 2.0), ("c@x.com", 3.0), ("c@x.com", 4.0)], "mail string, f double")


def test_addresses_are_compared_in_their_normal_form(people, source):
    out = Enricher(registry(Source("s", source, {"mail": "email"})), {"email": "email"}, detect_keys=False).transform(people)
    assert {r.row_id: r.f for r in out.collect()} == {1: 1.0, 2: None, 3: None, 4: 3.0, 5: 3.0}
    assert [r.email for r in out.orderBy("row_id").collect()] == ["A@X.com", "nobody", None, "c@x.com", "c@x.com"]


def test_an_address_matches_its_hash(spark, people, source):
    hashed = source.select(F.sha2("mail", 256).alias("h"), "f")
    out = Enricher(registry(Source("s", hashed, {"h": "hem"})), {"email": "email"}, detect_keys=False).transform(people)
    assert {r.row_id: r.f for r in out.collect()}[1] == 1.0


def test_of_several_columns_the_first_match_counts(people, source):
    out = Enricher(registry(Source("s", source, {"mail": "email"})), {"email": "email", "other": "email"}, detect_keys=False).transform(people)
    assert {r.row_id: r.f for r in out.collect()} == {1: 1.0, 2: 2.0, 3: None, 4: 3.0, 5: 3.0} and out.count() == 5


def test_today_stands_for_a_date(spark, people):
    snaps = spark.createDataFrame([("a@x.com", datetime.datetime(2024, 1, 1), 1.0), ("a@x.com", datetime.datetime(2025, 1, 1), 2.0)], "mail string, at timestamp, f double")
    e = lambda today: Enricher(registry(Source("s", snaps, {"mail": "email"}, snapshot="at")), {"email": "email"}, detect_keys=False, today=today)
    got = [{r.row_id: r.f for r in e(datetime.date(y, 6, 1)).transform(people).collect()}[1] for y in (2023, 2024, 2025)]
    assert got == [None, 1.0, 2.0]


def test_country_of_all_rows(spark):
    codes = spark.createDataFrame([("US", "10001", 1.0), ("GB", "10001", 2.0)], "c string, z string, f double")
    df = spark.createDataFrame([(1, "010001"), (2, "5")], "row_id int, zip string")
    for country, want in (("uk", 2.0), ("US", 1.0)):
        e = Enricher(registry(Source("s", codes, {"c": "country", "z": "postal_code"})), {"zip": "postal_code"}, detect_keys=False, country=country)
        assert {r.row_id: r.f for r in e.transform(df).collect()} == {1: want, 2: None}


def test_overlapping_ranges_do_not_multiply_rows(spark):
    ranges = spark.createDataFrame([(0, 10, 1.0), (5, 15, 2.0)], "a int, b int, f double")
    df = spark.createDataFrame([(1, 7), (2, 12), (3, 99)], "row_id int, k int")
    for width in (None, 4):
        out = Enricher(registry(Source("s", ranges, {}, ranges={"custom_key": ("a", "b")}, range_width=width)), {"k": "custom_key"}, detect_keys=False).transform(df)
        assert {r.row_id: r.f for r in out.collect()} == {1: 1.0, 2: 2.0, 3: None} and out.count() == 3


def test_first_of_many_overlapping_ranges_without_pairs(spark):
    ranges = spark.createDataFrame([(i % 50, i % 50 + 100 + i % 7, float(i)) for i in range(1000)] + [(None, 5, -1.0), (9, 3, -2.0)], "a int, b int, f double")
    df = spark.createDataFrame([(i, i % 170 if i % 9 else None) for i in range(600)], "row_id int, k int")
    out = Enricher(registry(Source("s", ranges, {}, ranges={"custom_key": ("a", "b")}, range_width=10)), {"k": "custom_key"}, detect_keys=False).transform(df)
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted((r.a, r.b, r.f) for r in ranges.filter("a <= b").collect())
    first = lambda k: None if k is None else next((f for a, b, f in rows if a <= k <= b), None)
    assert {r.row_id: r.f for r in out.collect()} == {r.row_id: first(r.k) for r in df.collect()} and out.count() == 600


@pytest.mark.parametrize("kind", ["int", "double", "timestamp", "string"])
def test_first_range_in_parts(spark, kind):
    cast = lambda c: F.lpad(c.cast("string"), 5, "0") if kind == "string" else F.timestamp_seconds(c) if kind == "timestamp" else c.cast(kind)
    wide = spark.range(300).select((F.col("id") * 37 % 900).alias("a"), (F.col("id") * 37 % 900 + F.col("id") * F.col("id") % 61).alias("b"), "id")
    keys = spark.range(1000).select(F.col("id").alias("row"), (F.col("id") * 13 % 1100).alias("k"))
    want = {r.row: r.first.id if r.first else None for r in keys.join(wide, F.expr("k between a and b"), "left").groupBy("row").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("a", "b", "id"))).alias("first")).collect()}
    assert None in want.values() and len(set(want.values())) > 50
    for rows in (20, 10**6):
        got = enrichment.first_range(keys.withColumn("k", cast(F.col("k"))), wide.withColumns({"a": cast(F.col("a")), "b": cast(F.col("b"))}), "k", "a", "b", rows)
        assert {r.row: r.id for r in got.collect()} == want


def test_progress_warnings_and_out_of_time_sets(people, source):
    told, ids = [], []
    e = Enricher(registry(Source("s", source, {"mail": "email"})), {"email": "email"}, detect_keys=False, on_progress=lambda s, p: told.append((s, p)), search_id="abc")
    later = people.withColumn("row_id", F.col("row_id") + 100).withColumn("y", F.lit(None).cast("int"))
    e.fit(people, "y", evaluations=[later], on_search_id=ids.append)
    assert [s for s, _ in told] == ["start", "keys", "sources", "done"] and told[-1][1] == 100 and ids == ["abc"]
    assert len(e.warnings) == 1 and "no target" in e.warnings[0]
    rates = {r.key: (r.rows, r.matched) for r in e.hit_rates["s"].collect()}
    assert rates["all"][1] == 2 and rates["email"][0] == 3


def test_unstable_features_are_left_out(spark):
    n = 3000
    rows = [(i, f"k{i}", datetime.date(2023, 1, 1) + datetime.timedelta(days=i // 5), i % 2) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id int, k string, d date, y int")
    src = spark.createDataFrame([(f"k{i}", float(i * 37 % 101), float(i)) for i in range(n)], "key string, steady double, rising double")
    e = Enricher(registry(Source("s", src, {"key": "custom_key"})), {"k": "custom_key", "d": "date"}, detect_keys=False).fit(df, "y", params=Stability())
    assert e.unstable == ["rising"] and e.transform(df).columns[-1] == "steady"


def test_metrics_with_and_without_sources(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    rows = [(i, f"k{i}", "a" if i % 3 else None, float(i % 7), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id int, k string, kind string, x double, y int")
    src = spark.createDataFrame([(f"k{i}", "yes" if i % 2 else "no") for i in range(200)], "key string, hint string")
    e = Enricher(registry(Source("s", src, {"key": "custom_key"})), {"k": "custom_key"}, detect_keys=False)
    got = {r.segment: r for r in e.calculate_metrics(df, "y", {"eval": df.limit(50), "blind": df.limit(5).withColumn("y", F.lit(None).cast("int"))}, folds=2, estimator=DecisionTreeClassifier()).collect()}
    assert got["train"].enriched == 1.0 == got["eval"].enriched and got["train"].baseline < 0.9 and got["train"].uplift == pytest.approx(1.0 - got["train"].baseline)
    assert got["train"].rows == 200 and got["train"].mean_target == 0.5 and got["blind"].rows == 0 and got["blind"].enriched is None


def test_folds_with_one_class_are_dealt_anew(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    df = spark.createDataFrame([(i, "p" if i < 30 else "q", float(i < 30), int(i < 30)) for i in range(60)], "row_id int, t string, x double, fold int")
    got = evaluation.cross_validate(df, ["x"], "t", "BINARY", "fold", "gini", DecisionTreeClassifier())
    assert got["scores"] == [1.0, 1.0]
    f = sampling.stratified_folds(df, "t", F.col("row_id"), 4, "fold").groupBy("t", "fold").count().collect()
    assert sorted(r["count"] for r in f) == [7, 7, 7, 7, 8, 8, 8, 8]


def test_dummies_literals_and_tables_side_by_side(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, k string")
    assert sorted(map(tuple, cleaning.dummies(df, "k").collect())) == [(1, 1, 0), (2, 0, 0), (3, 0, 1)]
    with pytest.raises(ValueError):
        cleaning.dummies(df, "k", most=1)
    assert with_literals(df, {"c": "US"}).columns == ["id", "k", "c"]
    with pytest.raises(ValueError):
        with_literals(df, {"k": 1})
    other = spark.createDataFrame([(1, 5), (4, 6)], "id int, v int")
    assert sorted(map(tuple, enrichment.beside([df, other], "id").collect()), key=str) == [(1, "a", 5), (2, None, None), (3, "b", None), (4, None, 6)]
    with pytest.raises(ValueError):
        enrichment.beside([df, df], "id")


def test_forced_and_truncated_samples(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0), datetime.datetime(2020, 1, 1) + datetime.timedelta(days=i)) for i in range(2000)], "id int, y int, at timestamp")
    assert dict(sampling.class_counts(sampling.forced_sample(df, "y", "BINARY", "id", 300), "y")) == {0: 150, 1: 150}
    assert dict(sampling.class_counts(sampling.forced_sample(df, "y", "BINARY", "id", 1000), "y")) == {0: 800, 1: 200}
    assert sampling.forced_sample(df, "y", "REGRESSION", "id", 300).count() == 300 and sampling.forced_sample(df, "y", "BINARY", "id").count() == 2000
    assert sampling.truncated_series(df, [], "at", 1000).count() == 913 and sampling.truncated_series(df, [], "at", 800).count() == 738
    assert sampling.truncated_series(df, [], "at", 100).count() == 100


def test_more_scores(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)], "t double, p double")
    got = {m: evaluation.score(df, m, "t", "p") for m in ("precision", "recall", "f1", "balanced_accuracy", "neg_mean_absolute_error", "MAE")}
    assert got["precision"] == got["recall"] == got["f1"] == pytest.approx(2 / 3) and got["balanced_accuracy"] == pytest.approx(1 / 3)
    assert got["neg_mean_absolute_error"] == got["MAE"] == 0.5
