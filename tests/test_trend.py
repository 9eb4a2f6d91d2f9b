"""Trend and seasons: known series are continued, change points found, any horizon served."""

import datetime as dt
import math

import pytest

from quarry.operators import timeseries as TS

START = dt.date(2020, 1, 1)


def _series(spark, f, n=800, more=()):
    rows = [(START + dt.timedelta(d), float(f(d))) for d in range(n)] + list(more)
    return spark.createDataFrame(rows, "day date, y double").repartition(3)


def _predicted(model, spark, days):
    df = spark.createDataFrame([(START + dt.timedelta(d),) for d in days], "day date")
    return {(r.day - START).days: r.predicted for r in model.predict(df).collect()}


def test_a_bent_line_with_a_weekly_wave_is_continued(spark):
    def f(d):
        return 50 + 0.3 * d - 0.9 * max(0, d - 320) + 5 * math.sin(2 * math.pi * d / 7)

    model = TS.fit_trend(_series(spark, f), "day", "y", change_points=19, seasons={"week": (7.0, 2)}, penalty=0.0005)
    got = _predicted(model, spark, [0, 100, 400, 799, 830, 900, 1000])
    scale = max(f(d) for d in range(800)) - min(f(d) for d in range(800))
    assert all(abs(v - f(d)) < 0.06 * scale for d, v in got.items())
    # few of the candidate bends are kept, and the strongest is where the series turns
    bends = dict(zip(model.change_points, model.slopes[1:]))
    assert sum(abs(s) > 0.05 for s in bends.values()) < len(bends) / 2
    assert abs(max(bends, key=lambda c: abs(bends[c])) - 320) <= 40


def test_one_model_serves_every_horizon(spark):
    model = TS.fit_trend(_series(spark, lambda d: 3 + 2 * d), "day", "y", change_points=0, seasons={}, penalty=0.0)
    assert _predicted(model, spark, [10, 5000]) == pytest.approx({10: 23.0, 5000: 10003.0})
    ahead = TS.forecast_trend(_series(spark, lambda d: 3 + 2 * d, 30), "day", "y", 3, change_points=0, penalty=0.0)
    assert [(r.day, round(r.predicted, 6)) for r in ahead.orderBy("day").collect()] == [
        (START + dt.timedelta(d), 3.0 + 2 * d) for d in (30, 31, 32)]


def test_odd_tables(spark):
    odd = _series(spark, lambda d: d, 20, [(None, 5.0), (START, None), (START, 0.0)])
    assert TS.forecast_trend(odd, "day", "y", 2, change_points=2, penalty=0.0).count() == 2
    constant = TS.forecast_trend(_series(spark, lambda d: 7, 40), "day", "y", 2)
    assert [r.predicted for r in constant.collect()] == pytest.approx([7.0, 7.0])
    assert TS.forecast_trend(_series(spark, lambda d: 4, 1), "day", "y", 2).count() == 2
    with pytest.raises(ValueError):
        TS.fit_trend(odd.limit(0), "day", "y")
