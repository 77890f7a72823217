import numpy as np
import pandas as pd
import pytest

from .test_operators import close, compute, n

D = "d string, v double"
ROLL = [("2024-05-06", 1.0), ("2024-05-09", 2.0), ("---", 3.0), ("2024-05-07", 4.0), ("2024-05-08", 5.0), ("2024-05-08", 5.0), ("2024-05-08", 6.0)]


@pytest.mark.parametrize("agg, want", [
    ("mean", "1 3.5 - 2.5 4.5 4.5 4.5"), ("median", "1 3.5 - 2.5 4.5 4.5 4.5"), ("min", "1 2 - 1 4 4 4"), ("max", "1 5 - 4 5 5 5"),
    ("norm_mean", "1 .571429 - 1.6 1.111111 1.111111 1.111111"), ("iqr", "0 1.5 - 1.5 .5 .5 .5"), ("count", "1 2 - 2 2 2 2"), ("std", "- 2.1213203 - 2.1213203 .7071068 .7071068 .7071068"),
])
def test_roll(spark, agg, want):
    close(compute(spark, f"roll_2D_{agg}(d,v)", D, ROLL), n(want))


def test_roll_with_offset(spark):
    data = [(f"2024-05-0{i}", float(v)) for i, v in ((5, 1), (6, 2), (7, 3), (8, 4), (8, 5))]
    close(compute(spark, "roll_2d_mean_offset_1D(d,v)", D, data), [None, 1, 1.5, 2.5, 2.5])


HOURS = [("2024-05-06 12:00", 1.0), ("2024-05-06 14:00", 2.0), ("2024-05-07 12:00", 3.0), ("2024-05-07 13:30", 4.0), ("2024-05-08 11:30", 5.0)]


def frame(data):
    return pd.Series([v for _, v in data], index=pd.to_datetime([d for d, _ in data]), dtype=float).sort_index()


@pytest.mark.parametrize("agg", ["mean", "sum", "skew", "kurt", "sem", "var", "median"])
@pytest.mark.parametrize("window", [2, 5, 30])
def test_roll_equals_pandas(spark, agg, window):
    rng = np.random.default_rng(window)
    days = sorted(rng.choice(60, 25, replace=False))
    data = [(f"{pd.Timestamp('2024-01-01') + pd.Timedelta(int(x), 'D'):%Y-%m-%d}", None if i % 7 == 3 else float(rng.normal())) for i, x in enumerate(days)]
    want = frame(data).rolling(f"{window}D", min_periods=1).agg(agg)
    close(compute(spark, f"roll_{window}D_{agg}(d,v)", D, data), [None if np.isnan(x) else x for x in want])


@pytest.mark.parametrize("agg", ["skew", "kurt"])
def test_roll_of_values_far_from_zero(spark, agg):
    near = [3.0, 1.0, 4.0, 1.5, 9.0, 2.5, 6.0, 5.0]
    got = [compute(spark, f"roll_5D_{agg}(d,v)", D, [(f"2024-05-0{i}", v + far) for i, v in enumerate(near, 1)]) for far in (0.0, 1e6)]
    close(got[1], got[0])
    assert got[0][-1] is not None
    close(compute(spark, f"roll_5D_{agg}(d,v)", D, [(f"2024-05-0{i}", 7.0) for i in range(1, 9)]), [None] * 8)


def test_lag(spark):
    data = [(f"2024-05-0{i}", float(i - 5)) for i in range(6, 10)]
    close(compute(spark, "lag_1D(d,v)", D, data), [None, 1, 2, 3])
    close(compute(spark, "lag_2D(d,v)", D, data), [None, None, 1, 2])
    gap = [("2024-05-05", 1.0), ("2024-05-06", 2.0), ("2024-05-07", 3.0), ("2024-05-09", 5.0)]
    close(compute(spark, "lag_1D(d,v)", D, gap), [None, 1, 2, None])
    close(compute(spark, "delta_1D(d,v)", D, gap), [None, 1, 1, None])


@pytest.mark.parametrize("unit", ["H", "D"])
def test_lag_equals_its_definition_in_pandas(spark, unit):
    def oldest(x, size=1):
        return np.nan if x.index.min() > x.index.max() - pd.Timedelta(size, unit.lower() if unit == "H" else unit) else x.iloc[0]

    want = frame(HOURS).rolling(f"2{unit.lower() if unit == 'H' else unit}", min_periods=1).apply(oldest, raw=False)
    close(compute(spark, f"lag_1{unit}(d,v)", D, HOURS), [None if np.isnan(x) else x for x in want])


def test_delta2(spark):
    data = [(f"2024-05-0{i}", float(v)) for i, v in zip(range(5, 10), (1, 2, 4, 7, 11))]
    close(compute(spark, "delta2_1D(d,v)", D, data), [None, None, 1, 1, 1])


def test_trend(spark):
    close(compute(spark, "trend_coef(d,v)", D, [(f"2024-05-0{i}", float(i)) for i in (3, 4, 5, 6)]), [1] * 4)
    data = [("2024-05-06", "A", 1.0), ("2024-05-06", "B", 10.0), ("2024-05-07", "A", None), ("2024-05-07", "B", 20.0), ("2024-05-09", "A", 3.0)]
    close(compute(spark, "trend_coef(d,g,v)", "d string, g string, v double", data), [0.6, 10, 0.6, 10, 0.6])
    close(compute(spark, "trend_coef(d,v)", D, [("2024-05-06", 5.0)]), [0])
    close(compute(spark, "trend_coef(d,v)", D, [("2024-05-06", 5.0), ("2024-05-07", None)]), [0, 0])


def test_trend_with_times_equals_resampling(spark):
    data = [("2024-05-06 07:00", 4.0), ("2024-05-06 21:00", 1.0), ("2024-05-08 03:00", 9.0), ("2024-05-08 05:00", 2.0), ("2024-05-11 23:00", 7.0)]
    y = frame(data).resample("1D").ffill().bfill()
    want = np.polyfit(np.arange(len(y)), y, 1)[0]
    close(compute(spark, "trend_coef(d,v)", D, data), [want] * 5)


VOL = [(f"2024-05-0{i}", v) for i, v in zip(range(1, 6), (100.0, 110.0, 99.0, 121.0, 115.0))]
MISSING = [("2024-05-01", 100.0), ("2024-05-02", None), ("2024-05-03", 99.0), ("2024-05-04", 121.0), ("2024-05-06", 115.0)]


def finite(s):
    return s.where(np.isfinite(s))


def returns(data):
    s = frame(data).ffill()
    return (s / s.shift(freq="1D").reindex(s.index) - 1).fillna(0)


def test_rolling_volatility(spark):
    close(compute(spark, "roll_vol_3D(d,v)", D, VOL), [None, 0.0707107, 0.1, 0.1626681, 0.1733247])
    close(compute(spark, "roll_vol_3D(d,v)", D, [*MISSING[:4], ("2024-05-05", 115.0)][:4]), [None, 0.0, 0.0057735, 0.1312821])
    want = returns(MISSING).rolling("3D", min_periods=1).std()
    close(compute(spark, "roll_vol_3D(d,v)", D, MISSING), [None if np.isnan(x) else x for x in want])


def test_volatility_of_volatility_and_ratio(spark):
    r = returns(VOL)
    once = r.abs().rolling("3D", min_periods=1).std()
    twice = returns(list(zip([d for d, _ in VOL], once))).pipe(finite).rolling("3D", min_periods=1).std()
    close(compute(spark, "roll_vol2_3D(d,v)", D, VOL), [None if np.isnan(x) else x for x in twice])
    ratio = (r.rolling("2D", min_periods=1).std() / r.rolling("4D", min_periods=1).std()).pipe(finite).fillna(1)
    close(compute(spark, "vol_ratio_2D_to_4D(d,v)", D, VOL), list(ratio))


def test_ewma(spark):
    close(compute(spark, "ewma_vol_3(d,v)", D, VOL), [None, 0.0707107, 0.1164965, 0.1759980, 0.1540383])
    data = [(d, g, v * f) for d, v in VOL for g, f in (("a", 1), ("b", -3))]
    got = compute(spark, "ewma_vol_3(d,g,v)", "d string, g string, v double", data)
    want = returns(VOL).ewm(span=3).std()
    close(got[::2], [None if np.isnan(x) else x for x in want])


def test_groups_null_dates_and_null_groups(spark):
    data = [("2024-05-06", "A", 1.0), ("2024-05-06", "B", 7.0), ("2024-05-07", "A", 3.0), (None, "A", 9.0), ("2024-05-07", None, 9.0), ("2024-05-07", "B", None), ("2024-05-07", "A", 100.0)]
    close(compute(spark, "roll_2D_mean(d,g,v)", "d string, g string, v double", data), [1, 7, 2, None, None, 7, 2])


CROSS = [(f"2024-05-0{d}", c, v) for c, vs in (("A", (10.0, 20.0, 30.0, 40.0)), ("B", (5.0, 15.0, 25.0, 35.0))) for d, v in zip(range(6, 10), vs)]


def cross(spark, formula, data, **params):
    sides = dict.fromkeys(["left_descriptor", "right_descriptor"])
    sides["left_descriptor"], sides["right_descriptor"] = ["A"], ["B"]
    return compute(spark, formula, "d string, g string, v double", data, descriptor_indices=[1], **sides, **params)


def test_cross(spark):
    close(cross(spark, "cross_add(d,g,v)", CROSS), [15, 35, 55, 75] * 2)
    close(cross(spark, "cross_div(d,g,v)", CROSS), [2, 20 / 15, 30 / 25, 40 / 35] * 2)
    close(cross(spark, "cross_add_offset_1D(d,g,v)", CROSS), [None, 15, 35, 55] * 2)
    lacking = [*CROSS[:5], *CROSS[6:], ("2024-05-06", "C", 1.0)]
    close(cross(spark, "cross_sub(d,g,v)", lacking), [5, None, 5, 5, 5, 5, 5, None])


def test_no_row_id_is_an_error(spark):
    from fathomlake.plans.compiler import features

    with pytest.raises(ValueError):
        features(spark.createDataFrame([("2024-05-06", 1.0)], D), ["roll_2D_mean(d,v)"])
