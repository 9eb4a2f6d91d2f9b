"""Time-series analytics (W4-W6, W10, M4, M19 naive baseline, trend and seasons).

Series order comes from an explicit ``order_by``; all windows go through the
bucketed ``ordered`` primitives, so one long series (or one dominant entity)
is processed by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import to_number
from quarry.operators.ordered import DEFAULT_BUCKET_ROWS, halo, rolling_mean_prefix, row_index
from quarry.operators.transforms import forward_fill
from quarry.session import keep_table

HALO_LIMIT = 4096


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def rolling_window_size(n: int) -> int:
    return max(3, n // 50)


def rolling_mean(df: DataFrame, order_by: Sequence, value: str, window: int | None = None,
                 entity: Sequence[str] = (), name: str = "rolling_mean",
                 bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """W4 centred rolling mean, partial edges allowed (pandas ``center=True,
    min_periods=1``): rows [i - w//2, i + (w-1)//2].  ``window`` defaults to
    max(3, n // 50) of the whole table.  Narrow frames use the halo window;
    wide ones prefix sums joined on position."""
    w = window or rolling_window_size(df.count())
    before, after = w // 2, (w - 1) // 2
    x = df.withColumn("__v", to_number(_q(value)))
    if before + after <= HALO_LIMIT:
        out = halo(x, list(entity), order_by, before, after,
                   lambda win: {name: F.avg("__v").over(win.rowsBetween(-before, after))},
                   bucket_rows=bucket_rows)
    else:
        out = rolling_mean_prefix(x, list(entity), order_by, "__v", before, after, name, bucket_rows=bucket_rows)
    return out.drop("__v")


def series_max(df: DataFrame, date: str, value: str, entity: Sequence[str] = ()) -> DataFrame:
    """W6 maximum of the series and its (earliest) date, per entity."""
    v = to_number(_q(value))
    g = df.where(v.isNotNull())
    key = F.struct((-v).alias("nv"), _q(date).alias("d"))
    aggs = [F.max(v).alias("max_value"), F.min_by(_q(date), key).alias("max_date")]
    return g.groupBy(*entity).agg(*aggs) if entity else g.agg(*aggs)


def lag_correlation(df: DataFrame, order_by: Sequence, target: str, features: Sequence[str] | None = None,
                    max_lag: int | None = None, top: int = 5, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """W5 corr(x_t, y_{t+k}) for k in -L..L (L = min(20, n // 5)) for the top
    features by |corr| at lag 0; values forward-filled, then 0.  Output
    (feature, lag, corr, is_peak) where the peak is the first lag with the
    largest |corr|.  Shifted values come from a halo window of L rows."""
    feats = list(features or [f.name for f in df.schema.fields
                              if f.name != target and f.dataType.typeName() in
                              ("integer", "long", "double", "float", "short", "decimal")])
    n = df.count()
    L = max_lag if max_lag is not None else min(20, n // 5)
    # one position for both the fill and the shifted copies
    ix = row_index(df.select(*order_by, *[_q(c) for c in feats + [target]]), order_by, name="_t")
    # kept once: the base correlations and the shifted copies both read it
    filled = keep_table(forward_fill(ix, feats + [target], ["_t"], bucket_rows=bucket_rows, idx="_t"), "lag-filled")
    base = filled.agg(*[F.corr(_q(f), _q(target)).alias(f) for f in feats]).first()
    ranked = sorted(feats, key=lambda f: (-(abs(base[f]) if base[f] is not None else 0.0), feats.index(f)))[:top]
    lags = list(range(-L, L + 1))
    shifted = halo(filled, [], ["_t"], L, L,
                   lambda w: {f"__y{k + L}": F.lead(_q(target), k).over(w) for k in lags},
                   bucket_rows=bucket_rows, idx="_t")
    items = [F.struct(F.lit(f).alias("feature"), F.lit(k).alias("lag"),
                      F.corr(_q(f), F.col(f"__y{k + L}")).alias("corr")) for f in ranked for k in lags]
    long = shifted.agg(F.array(*items).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    # one row per feature x lag: a bounded window
    w = Window.partitionBy("feature").orderBy(F.desc(F.abs(F.coalesce("corr", F.lit(0.0)))), "lag")
    return long.withColumn("is_peak", F.row_number().over(w) == 1)


def lag_features(df: DataFrame, entity: Sequence[str], order_by: Sequence, value: str,
                 lags: Sequence[int] = (1, 7), windows: Sequence[int] = (7,),
                 bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """W10 lag_k and rolling mean/std/min/max over the previous w rows (the
    current row excluded) per entity."""
    reach = max(list(lags) + list(windows) + [1])

    def cols(win: Window) -> dict[str, Column]:
        out = {f"{value}_lag{k}": F.lag(_q(value), k).over(win) for k in lags}
        for w in windows:
            fr = win.rowsBetween(-w, -1)
            out.update({f"{value}_roll{w}_mean": F.avg(_q(value)).over(fr),
                        f"{value}_roll{w}_std": F.stddev_samp(_q(value)).over(fr),
                        f"{value}_roll{w}_min": F.min(_q(value)).over(fr),
                        f"{value}_roll{w}_max": F.max(_q(value)).over(fr)})
        return out
    return halo(df, list(entity), order_by, reach, 0, cols, bucket_rows=bucket_rows)


def seasonal_naive(df: DataFrame, entity: Sequence[str], order_by: Sequence, value: str, period: int,
                   bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """M19 baseline forecast: the value one season (``period`` rows) earlier."""
    return halo(df, list(entity), order_by, period, 0,
                lambda w: {"predicted": F.lag(_q(value), period).over(w)}, bucket_rows=bucket_rows)


def fourier_terms(df: DataFrame, t: str, period: float, k: int = 2) -> DataFrame:
    """M4 sin/cos(2 pi j t / P) for j = 1..k."""
    cols = {}
    for j in range(1, k + 1):
        ang = F.lit(2.0 * 3.141592653589793 * j / period) * _q(t).cast("double")
        cols[f"sin{j}"] = F.sin(ang)
        cols[f"cos{j}"] = F.cos(ang)
    return df.withColumns(cols)


def time_index(df: DataFrame, order_by: Sequence, name: str = "t") -> DataFrame:
    return row_index(df, order_by, name=name)


# ---------------------------------------------------------------- M19 trend and seasons

# Period in days and number of harmonics of the seasonal terms.
SEASONS = {"week": (7.0, 3), "year": (365.25, 6)}


@dataclass
class TrendModel:
    """A fitted trend with seasons: ``model`` scores any table that has the date column."""
    model: PipelineModel
    date: str
    change_points: list[float]
    slopes: list[float]

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``date``, the columns of ``keep`` and ``predicted``, for past and future dates alike."""
        return self.model.transform(df).select(F.col(f"`{self.date}`"), *keep, F.col("prediction").alias("predicted"))


def fit_trend(df: DataFrame, date: str, target: str, change_points: int = 25, share: float = 0.8,
              seasons: dict[str, tuple[float, int]] | None = None, penalty: float = 0.002) -> TrendModel:
    """M19 a piecewise linear trend and Fourier seasons as one linear model.

    Hinge columns max(0, t - c) stand at ``change_points`` places spread over the first
    ``share`` of the span; a lasso (``penalty`` times the target's deviation) keeps the few
    that the series needs.  Seasons longer than half the span are left out.  The columns
    come from the date alone, so one model answers every horizon, and the fit is one
    distributed regression however many series rows there are.  Null dates and targets are
    left out; an empty table is an error."""
    t0 = F.to_date(F.col(f"`{date}`"))
    rows = df.where(t0.isNotNull() & F.col(f"`{target}`").isNotNull())
    span = rows.agg(F.min(t0).alias("first"), F.max(t0).alias("last"), F.stddev_pop(F.col(f"`{target}`").cast("double")).alias("sd")).first()
    if span["first"] is None:
        raise ValueError("no rows with a date and a target")
    days = (span["last"] - span["first"]).days
    t = f"CAST(datediff(to_date(`{date}`), DATE'{span['first']}') AS DOUBLE)"
    points = sorted({round(share * days * (k + 1) / (change_points + 1), 3) for k in range(change_points)}) if days else []
    columns = {"__t": t} | {f"__hinge{k}": f"greatest({t} - {c}D, 0D)" for k, c in enumerate(points)}
    for name, (period, harmonics) in (SEASONS if seasons is None else seasons).items():
        if 2 * period <= days:
            for k in range(1, harmonics + 1):
                for f in ("sin", "cos"):
                    columns[f"__{name}_{f}{k}"] = f"{f}({2 * math.pi * k / period!r}D * {t})"
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM __THIS__"),
              VectorAssembler(inputCols=list(columns), outputCol="features")]
    prepared = PipelineModel(stages=stages)
    data = keep_table(prepared.transform(rows).select("features", F.col(f"`{target}`").cast("double").alias("label")), "trend")
    fit = LinearRegression(regParam=penalty * (span["sd"] or 0.0), elasticNetParam=1.0, maxIter=500, tol=1e-9).fit(data)
    return TrendModel(PipelineModel(stages=[*stages, fit]), date, points, list(fit.coefficients)[:1 + len(points)])


def forecast_trend(df: DataFrame, date: str, target: str, horizon: int, **options) -> DataFrame:
    """M19 (date, predicted) for the ``horizon`` days after the last one of the table."""
    model = fit_trend(df, date, target, **options)
    last = df.where(F.col(f"`{target}`").isNotNull()).agg(F.max(F.to_date(F.col(f"`{date}`"))).alias("d"))
    future = last.select(F.explode(F.sequence(F.date_add("d", 1), F.date_add("d", horizon))).alias(date))
    return model.predict(future)
