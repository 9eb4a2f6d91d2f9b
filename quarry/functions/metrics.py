"""Evaluation metrics as aggregate Column builders.

Every builder is an ordinary aggregate expression, so a metric table for many
groups is one ``groupBy(...).agg(...)`` with partial (map-side) aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mse(actual="actual", predicted="predicted") -> Column:
    return F.avg(F.pow(_c(predicted) - _c(actual), 2))


def rmse(actual="actual", predicted="predicted") -> Column:
    return F.sqrt(mse(actual, predicted))


def mae(actual="actual", predicted="predicted") -> Column:
    return F.avg(F.abs(_c(predicted) - _c(actual)))


def mape(actual="actual", predicted="predicted") -> Column:
    """Mean |err/actual| over rows with a non-zero actual (as a fraction)."""
    a = _c(actual).cast("double")
    return F.avg(F.abs((_c(predicted) - a) / F.nullif(a, F.lit(0.0))))


def smape(actual="actual", predicted="predicted") -> Column:
    a, p = _c(actual).cast("double"), _c(predicted).cast("double")
    den = F.nullif(F.abs(a) + F.abs(p), F.lit(0.0))
    return F.avg(F.lit(2.0) * F.abs(p - a) / den)


def wape(actual="actual", predicted="predicted") -> Column:
    return F.sum(F.abs(_c(predicted) - _c(actual))) / F.nullif(F.sum(F.abs(_c(actual))).cast("double"), F.lit(0.0))


def r2(actual="actual", predicted="predicted") -> Column:
    """1 - SSE/SST in one pass; SST from the numerically stable central-moment
    aggregate (var_pop * n), not from raw power sums."""
    a, p = _c(actual).cast("double"), _c(predicted).cast("double")
    sse = F.sum(F.pow(p - a, 2))
    sst = F.var_pop(a) * F.count(a)
    return F.lit(1.0) - sse / F.nullif(sst, F.lit(0.0))


nse = r2  # Nash-Sutcliffe efficiency has the same formula


def logloss(actual="actual", prob="prob", eps: float = 1e-15) -> Column:
    """Binary log loss with probabilities clipped to [eps, 1-eps]."""
    p = F.least(F.greatest(_c(prob).cast("double"), F.lit(eps)), F.lit(1.0 - eps))
    y = _c(actual).cast("double")
    return F.avg(-(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p)))


def accuracy(actual="actual", predicted="predicted") -> Column:
    return F.avg((_c(actual) == _c(predicted)).cast("double"))


def regression_aggs(actual="actual", predicted="predicted") -> list[Column]:
    return [rmse(actual, predicted).alias("rmse"), mse(actual, predicted).alias("mse"),
            mae(actual, predicted).alias("mae"), mape(actual, predicted).alias("mape"),
            smape(actual, predicted).alias("smape"), wape(actual, predicted).alias("wape"),
            r2(actual, predicted).alias("r2"), F.count(F.lit(1)).alias("n")]
