"""Feature construction (M2, M3): target encoding and interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def target_encoding(train: DataFrame, column: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """M2 smoothed mean of the target per category, fitted on training rows:
    (sum + m * prior) / (n + m).  One grouped aggregate (map-side combined)."""
    prior = train.agg(F.avg(_q(target)).alias("p")).first()["p"]
    g = train.groupBy(_q(column).alias(column)).agg(F.sum(_q(target)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return g.select(column, ((F.col("_s") + F.lit(smoothing * prior)) / (F.col("_n") + F.lit(smoothing)))
                    .alias("encoded"))


def apply_target_encoding(df: DataFrame, column: str, table: DataFrame, prior: float | None = None,
                          out: str | None = None) -> DataFrame:
    """Join the fitted encoding; unseen categories get ``prior``."""
    j = df.join(table.withColumnRenamed(column, "__k"), _q(column).eqNullSafe(F.col("__k")), "left").drop("__k")
    e = F.coalesce("encoded", F.lit(prior)) if prior is not None else F.col("encoded")
    return j.withColumn(out or f"{column}_te", e).drop("encoded")


def interactions(df: DataFrame, products: Sequence[tuple[str, str]] = (),
                 ratios: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """M3 ``a_x_b`` products and ``a_per_b`` ratios (null when b is 0)."""
    cols = {f"{a}_x_{b}": _q(a).cast("double") * _q(b).cast("double") for a, b in products}
    cols.update({f"{a}_per_{b}": _q(a).cast("double") / F.nullif(_q(b).cast("double"), F.lit(0.0))
                 for a, b in ratios})
    return df.withColumns(cols)
