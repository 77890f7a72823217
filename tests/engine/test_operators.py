import math

import pytest

from fathomlake.plans.compiler import features
from fathomlake.plans.formula import parse


def compute(spark, formula, schema, data, **params):
    """The results of one formula, in the order of the rows."""
    node = parse(formula)
    if params:
        for k, v in params.items():
            node.op._assign(k, v)
        node.op.check()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "row_id int, " + schema)
    got = features(df.repartition(3), {"r": node}, row_id="row_id").orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(len(data)))
    return [r.r for r in got]


def n(text):
    """Numbers in a row, a dash for null."""
    return [None if x == "-" else float(x) for x in text.split()]


def days(text):
    """Dates written as digits."""
    return [f"{d[:4]}-{d[4:6]}-{d[6:]}" for d in text.split()]


def close(got, want, tol=1e-6):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None) and (w is None or abs(g - w) <= tol), (got, want)


ONE = [(v,) for v in (-4.0, 0.0, 2.25, None, float("nan"), float("inf"))]


@pytest.mark.parametrize("op, f", [
    ("abs", abs), ("square", lambda x: x * x), ("floor", math.floor), ("residual", lambda x: x - math.floor(x)),
    ("sqrt", lambda x: math.sqrt(abs(x))), ("log", lambda x: math.log(abs(x)) if x else None), ("sigmoid", lambda x: 1 / (1 + math.exp(-x))),
])
def test_math(spark, op, f):
    want = [f(x) for (x,) in ONE[:3]] + [None, None, 1.0 if op == "sigmoid" else None]
    close(compute(spark, f"{op}(x)", "x double", ONE), want)


def test_log_is_cut_at_ten_decimals(spark):
    got = compute(spark, "log(x)", "x double", [(0.3,)])[0]
    assert got == math.trunc(math.log(0.3) * 1e10) / 1e10


def test_bins(spark):
    x = [(v,) for v in n("10 20 30 40 50 -")]
    assert compute(spark, "bin(x)", "x double", x, bin_bounds=[0, 25, 45]) == [1, 1, 2, 2, 3, -1]
    assert compute(spark, "bin(x)", "x double", x[:2]) == [-1, -1]
    assert compute(spark, "bin(x)", "x double", [(-5.0,), (0.0,), (7.0,)], bin_bounds="[0, 5]") == [-1, 1, 2]


def test_freq_and_norm(spark):
    close(compute(spark, "freq(x)", "x string", [("a",), ("b",), ("a",), (None,), ("a",)]), [0.75, 0.25, 0.75, None, 0.75])
    close(compute(spark, "norm(x)", "x double", [(3.0,), (None,), (4.0,)]), [0.6, None, 0.8])
    close(compute(spark, "norm(x)", "x double", [(3.0,)], norm=2.0), [1.5])
    close(compute(spark, "norm(x)", "x double", [(0.0,)]), [None])


def test_arithmetic(spark):
    data = [(6.0, 3.0), (1.0, 0.0), (None, 2.0), (2.0, None)]
    for formula, want in {
        "(a+b)": [9, 1, None, None], "(a-b)": [3, 1, None, None], "(a*b)": [18, 0, None, None], "(a/b)": [2, None, None, None],
        "min(a,b)": [3, 0, None, None], "max(a,b)": [6, 1, None, None], "abs((a/b))": [2, None, None, None], "add(a,b)": [9, 1, None, None],
    }.items():
        close(compute(spark, formula, "a double, b double", data), want)


def test_combinations(spark):
    data = [("x", 1), ("x", 1), ("y", 1), (None, 1), ("y", None)]
    assert compute(spark, "Combine(a,b)", "a string, b int", data) == ["x_1", "x_1", "y_1", None, None]
    close(compute(spark, "CombineThenFreq(a,b)", "a string, b int", data), [2 / 3, 2 / 3, 1 / 3, None, None])


def test_vectors(spark):
    data = [(1.0, 4.0, 7.0), (2.0, 5.0, 8.0), (3.0, None, 9.0), (None, 7.0, 10.0)]
    close(compute(spark, "mean(a,b,c)", "a double, b double, c double", data), [4, 5, 4, 17 / 3])
    close(compute(spark, "sum(a,b,c)", "a double, b double, c double", data), [12, 15, 12, 17])
    assert compute(spark, "vectorize(a,b)", "a double, b double, c double", data)[2] == [3.0, None]


def test_cosine(spark):
    data = [([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([None, 1.0], [1.0, 1.0]), ([3.0, 4.0], [4.0, 3.0])]
    schema = "a array<double>, b array<double>"
    close(compute(spark, "dist(a,b)", schema, data), [1, 0, None, None, None, 0.04])
    close(compute(spark, "sim(a,b)", schema, data), [0, 1, None, None, None, 0.96])
    scaled = [([7 * x for x in a] if a and None not in a else a, b) for a, b in data]
    close(compute(spark, "dist(b,a)", schema, scaled), [1, 0, None, None, None, 0.04])


def test_text_similarity(spark):
    data = [("book", "look"), ("blow", None), (None, "Jeremy"), ("below", "bewoll"), (None, None), ("abc", "abc"), ("four", "seven"), ("", "a")]
    close(compute(spark, "sim_jw1(a,b)", "a string, b string", data), n(".833 - - .902 - 1 0 -"), 6e-4)
    close(compute(spark, "sim_jw2(a,b)", "a string, b string", data), n(".883 - - .739 - 1 0 -"), 6e-4)
    close(compute(spark, "sim_lv(a,b)", "a string, b string", data), n(".75 - - .5 - 1 0 -"))


GROUPED = [("a", 1.0, -1.0), ("a", 2.0, -3.0), ("b", 3.0, -1.0), ("b", 0.0, 0.0), ("c", -4.0, -2.0)]


def test_group_goldens(spark):
    schema = "f1 string, f2 double, f3 double"
    close(compute(spark, "GroupByThenMin(f2,f1)", schema, GROUPED), [1, 1, 0, 0, -4])
    close(compute(spark, "GroupByThenMin(f3,f1)", schema, GROUPED), [-3, -3, -1, -1, -2])
    close(compute(spark, "GroupByThenMin(min(f2,f3),f1)", schema, GROUPED), [-3, -3, -1, -1, -4])


def test_group_statistics(spark):
    data = [("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", None), ("g", 5.0), (None, 9.0), ("h", None)]
    schema = "k string, v double"
    for formula, want in {
        "GroupByThenMax(v,k)": [5.0] * 5 + [None, None], "GroupByThenMean(v,k)": [2.5] * 5 + [None, None], "GroupByThenSum(v,k)": [10.0] * 5 + [None, 0.0],
        "GroupByThenCount(v,k)": [4] * 5 + [None, 0], "GroupByThenMedian(v,k)": [2.0] * 5 + [None, None], "GroupByThenStd(v,k)": [3**0.5] * 5 + [None, None],
        "GroupByThenVar(v,k)": [3.0] * 5 + [None, None], "GroupByThenFirst(v,k)": [1.0] * 5 + [None, None], "GroupByThenLast(v,k)": [5.0] * 5 + [None, None],
        "GroupByThenRank(v,k)": [0.25, 0.625, 0.625, None, 1.0, None, None], "GroupByThenNUnique(v,k)": [3] * 5 + [None, 0],
        "GroupByThenFreq(v,k)": [0.25, 0.5, 0.5, None, 0.25, None, None],
    }.items():
        got = compute(spark, formula, schema, data)
        if formula.startswith("GroupByThenFreq"):
            got[3] = None if got[3] in (None, 0.0) else got[3]
        close(got, want)


def test_equal_subtrees_and_keys_share_work(spark):
    df = spark.createDataFrame(GROUPED, "f1 string, f2 double, f3 double")
    out = features(df, ["GroupByThenMin(f2,f1)", "GroupByThenMax(f2,f1)", "GroupByThenMean(f3,f1)", "(GroupByThenMin(f2,f1)+f3)"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and len(out.columns) == 7


def test_date_diff(spark):
    data = [("2022-10-10", 755481600.0), ("2022-10-10", 1696896000.0), ("bad", 0.0), (None, 0.0), ("2022-10-10", None)]
    schema = "a string, b double"
    close(compute(spark, "date_diff(a,b)", schema, data, right_unit="s"), [10531, -365, None, None, None])
    close(compute(spark, "date_diff(a,b)", schema, data, right_unit="s", replace_negative=True), [10531, None, None, None, None])
    close(compute(spark, "date_diff(a,b)", schema, data, right_unit="s", diff_unit="Y"), [28, -1, None, None, None])


def test_next_anniversary(spark):
    data = [("2022-10-10", "1993-12-10"), ("2022-10-10", "1993-04-10"), ("2023-03-01", "2020-02-29"), (None, "2020-02-29"), ("2022-10-10", None), ("2022-10-10", "2000-10-10")]
    close(compute(spark, "date_diff_type2(a,b)", "a string, b string", data), [61, 182, 365, None, None, 0])


NOW = "2022-10-10"
LISTS = [(NOW, days(d)) for d in ("19931210 19931211", "19931210 19931210", "20231010", "10231010", "")] + [(NOW, None), (None, [])]


@pytest.mark.parametrize("agg, want", [
    ("min", [10530, 10531, -365, None, None]), ("max", [10531, 10531, -365, None, None]), ("mean", [10530.5, 10531, -365, None, None]),
    ("nunique", [2, 1, 1, 1, 0]), ("count", [2, 2, 1, 1, 0]), ("median", [10530.5, 10531, -365, None, None]), ("std", [0.5, 0, 0, None, None]), ("sum", [21061, 21062, -365, None, None]),
])
def test_date_lists(spark, agg, want):
    more = [None, 0 if agg in ("count", "nunique") else None]
    close(compute(spark, f"date_diff_{agg}(a,b)", "a string, b array<string>", LISTS), want + more)


@pytest.mark.parametrize("agg", ["std", "median", "nunique", "D_0_400_count_norm"])
def test_differences_of_a_list_are_computed_once(spark, agg):
    df = spark.createDataFrame([("2024-05-06", ["2024-05-01", "2024-05-03"])], "a string, b array<string>")
    plan = features(df, {"r": f"date_diff_{agg}(a,b)"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(b#") == 1


def test_bounded_date_lists(spark):
    lists = ("20131210 20131211 19991211", "20131210 20031211 19991211 19931211 19831211 19731211 19591211", "20031210 20031210", "20231010 19931210", "20231010 19931210", "")
    data = [("1022-10-10" if i == 4 else NOW, days(d)) for i, d in enumerate(lists)]
    for formula, want in {
        "date_diff_Y_0_18_count": n("2 1 0 0 - 0"), "date_diff_Y_18_23_count": n("1 2 2 0 - 0"), "date_diff_Y_23_30_count": n("0 1 0 1 - 0"),
        "date_diff_Y_60_plusinf_count": n("0 1 0 0 - 0"), "date_diff_Y_0_18_count_norm": [2 / 3, 1 / 7, 0, 0, None, 0], "date_diff_Y_18_23_count_norm": [1 / 3, 2 / 7, 1, 0, None, 0],
    }.items():
        close(compute(spark, f"{formula}(a,b)", "a string, b array<string>", data), want)


def test_moving_bins(spark):
    bounds = [0.0, *[2.6 + 0.6 * i for i in range(49)], 32.0, *[32.0 + 0.04 * i for i in range(1, 50)]]
    assert len(bounds) == 100
    data = [("2024-03-03", 2.0), ("2024-02-03", 2.0), ("2024-02-04", 34.0), ("2024-02-05", 32.0), ("2023-03-03", 60.0), ("2023-03-02", None)]
    got = compute(spark, "date_per(a,b)", "a string, b double", data, zero_month=2, zero_year=2024, zero_bounds=bounds)
    assert got == [None, 1, 100, 51, 100, None]


@pytest.mark.parametrize("formula", ["emb(a)", "cluster(a)", "outlier_dist(a)", "onnx_s(a)", "catboost_s(a)", "date_per_method2(a,a)"])
def test_what_is_only_declared_says_so(spark, formula):
    with pytest.raises(NotImplementedError):
        compute(spark, formula, "a string", [("x",)])
