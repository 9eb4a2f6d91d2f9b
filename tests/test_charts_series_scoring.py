"""Charts, time series and scoring against numpy / pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import charts as C
from quarry.operators import scoring as SC
from quarry.operators import timeseries as TS


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(size=397), [0.0, 1.0, 1.0]]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = [r["count"] for r in C.histogram(df, "x").orderBy("bin").collect()]
    counts, _ = np.histogram(x, bins=min(30, max(10, len(x) // 20)))
    assert got == counts.tolist()


def test_grouped_and_pie(spark):
    pdf = pd.DataFrame({"k": ["a", "b", "a", None, "c", "b", "a"], "v": [1.0, 2.0, 3.0, 9.0, 1.0, 2.0, 1.0]})
    df = spark.createDataFrame(pdf)
    g = [(r["label"], r["value"]) for r in C.grouped(df, "k", "v", "sum", "desc", 2).collect()]
    exp = pdf.dropna().groupby("k")["v"].sum().sort_values(ascending=False).head(2)
    assert g == list(exp.items())
    pie = [(r["label"], r["value"]) for r in C.value_counts_top(df, "k", 2).collect()]
    assert pie == [("a", 3), ("b", 2)]


@pytest.mark.parametrize("w", [3, 4, 6])
def test_rolling_mean_matches_pandas_center(spark, w):
    vals = [1.0, 5.0, 2.0, 8.0, 3.0, 9.0, 4.0, 7.0, 6.0, 0.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "t long, v double")
    got = [r["rolling_mean"] for r in TS.rolling_mean(df, ["t"], "v", window=w).orderBy("t").collect()]
    exp = pd.Series(vals).rolling(w, center=True, min_periods=1).mean().tolist()
    np.testing.assert_allclose(got, exp)


def test_lag_correlation_matches_numpy(spark):
    rng = np.random.default_rng(2)
    n = 60
    x = rng.normal(size=n)
    y = np.r_[0.0, 0.0, x[:-2]] + rng.normal(scale=0.1, size=n)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "t long, x double, y double")
    out = {r["lag"]: r for r in TS.lag_correlation(df, ["t"], "y", ["x"], max_lag=4).collect()}
    for k in range(-4, 5):
        a, b = (x[:n - k], y[k:]) if k >= 0 else (x[-k:], y[:n + k])
        assert np.isclose(out[k]["corr"], np.corrcoef(a, b)[0, 1])
    assert out[2]["is_peak"]


def test_series_max_earliest_date(spark):
    df = spark.createDataFrame([("2024-01-03", 5.0), ("2024-01-01", 5.0), ("2024-01-02", 1.0)], "d string, v double")
    r = TS.series_max(df, "d", "v").first()
    assert (r["max_value"], r["max_date"]) == (5.0, "2024-01-01")


def test_align_features_and_decode(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "id int, a double, extra string")
    out = SC.align_features(df, ["a", "b", "id"])
    assert out.columns == ["a", "b", "id"] and out.first()["b"] == 0
    with pytest.raises(ValueError):
        SC.align_features(df, ["p", "q", "r", "a"])
    pred = spark.createDataFrame([(0.0,), (2.0,)], "p double")
    assert [r["p"] for r in SC.decode_labels(pred, "p", ["n", "m", "z"]).collect()] == ["n", "z"]
    frac = spark.createDataFrame([(0.5,)], "p double")
    assert SC.decode_labels(frac, "p", ["n", "m"]).first()["p"] == 0.5
    assert F is not None
