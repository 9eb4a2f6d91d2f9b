"""Model explanation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StandardScaler
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.joins import grid_rows
from quarry.operators.ordered import row_index
from quarry.operators.stats import exact_quantiles


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def feature_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """Names of the assembled feature slots (from the vector metadata)."""
    out = model.transform(df.limit(1))
    meta = out.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    slots = sorted((a["idx"], a["name"]) for group in meta.values() for a in group)
    return [n for _, n in slots]


def importances(model: PipelineModel, df: DataFrame, k: int = 20) -> DataFrame:
    """X1 built-in importances (trees) or |coefficients| (linear), top k."""
    est = model.stages[-1]
    if hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray().tolist()
    elif hasattr(est, "coefficients"):
        vals = [abs(v) for v in est.coefficients.toArray().tolist()]
    else:
        raise ValueError("model has no importances")
    names = feature_names(model, df)
    rows = sorted(zip(names, vals), key=lambda t: -t[1])[:k]  # one entry per feature slot
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], key: str,
                           metric: Callable[[DataFrame], float], seed: int = 42) -> DataFrame:
    """X3 metric change when one feature is shuffled: the feature's values are
    re-paired with other rows by joining on a hashed position (a
    permutation), the model re-scores, and the metric is recomputed."""
    base = metric(model.transform(df))
    spark = df.sparkSession
    ix = row_index(df, [key], name="_p")
    rows = []
    for f in features:
        perm = row_index(df.select(f, key).withColumn("_h", F.xxhash64(F.lit(seed), _q(key))), ["_h", key],
                         name="_p").select("_p", _q(f).alias("_pv"))
        shuffled = ix.join(perm, "_p").withColumn(f, F.col("_pv")).drop("_pv", "_p")
        rows.append((f, float(metric(model.transform(shuffled)) - base)))
    return spark.createDataFrame(rows, "feature string, delta double")


def linear_shapley(model: PipelineModel, df: DataFrame) -> DataFrame:
    """X4 mean |coef_j (x_j - mean_j)| per feature slot, exact for a linear
    model on independent features.  Means, and the sums of absolute distances from
    them, are vector aggregates, so the plan does not grow with the slots."""
    coef = model.stages[-1].coefficients.toArray()
    names = feature_names(model, df)
    vectors = model.transform(df).select("features")
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="_centred").fit(vectors)
    s = centred.transform(vectors).agg(Summarizer.metrics("normL1", "count").summary(F.col("_centred")).alias("s")).first()["s"]
    if len(names) != len(coef):     # slots without names (hashed words) go by their number
        names = [f"slot_{i}" for i in range(len(coef))]
    mean_abs = abs(coef) * s["normL1"].toArray() / s["count"]
    rows = sorted(zip(names, mean_abs.tolist()), key=lambda t: -t[1])
    return df.sparkSession.createDataFrame(rows, "feature string, mean_abs_shap double")


def linear_contributions(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """X4 for given coefficients over plain columns: mean |coef (x - mean(x))| per column,
    nulls left out, largest first.  Two aggregates over the table."""
    cols = list(coefficients)
    means = df.agg(*[F.avg(_q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    items = [F.struct(F.lit(c).alias("feature"), F.avg(F.abs(F.lit(float(coefficients[c])) * (
        _q(c).cast("double") - F.lit(means[f"m{i}"])))).alias("mean_abs_shap")) for i, c in enumerate(cols)]
    return (df.agg(F.array(*items).alias("a")).select(F.explode("a").alias("a")).select("a.*")
            .orderBy(F.desc("mean_abs_shap"), "feature"))


def top_inputs(model: PipelineModel, df: DataFrame, k: int = 3) -> list[str]:
    """The ``k`` numeric input columns whose feature slots are the most important."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    rows = importances(model, df, k=1 << 30).collect()      # one row per feature slot
    ranked = [r["feature"].split("__")[0] for r in sorted(rows, key=lambda r: (-r["importance"], r["feature"]))]
    return [c for c in dict.fromkeys(ranked) if c in numeric][:k]


def partial_dependence(model: PipelineModel, df: DataFrame, features: Sequence[str] | None = None, points: int = 20,
                       prediction: str = "prediction") -> DataFrame:
    """X5 (``features``: the three most important numeric columns unless given) mean prediction over a grid of ``points`` values between the 5th and
    95th percentile of each feature (exact quantiles, distributed); each row
    is expanded over the short grid (J8) and re-scored."""
    features = top_inputs(model, df) if features is None else list(features)
    qs = exact_quantiles(df, features, [0.05, 0.95])
    out = None
    for f in features:
        lo, hi = qs[f]
        if lo is None:
            continue
        grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)] if points > 1 else [lo]
        g = grid_rows(df, f, grid)
        pd_ = model.transform(g).groupBy("grid_value").agg(F.avg(prediction).alias("mean_prediction"))
        pd_ = pd_.select(F.lit(f).alias("feature"), "grid_value", "mean_prediction")
        out = pd_ if out is None else out.unionByName(pd_)
    return out


def factorize(df: DataFrame, column: str, order_by: Sequence, name: str | None = None) -> DataFrame:
    """X6 codes by first appearance: the first position of each value (row
    index in ``order_by``) ranks the values; nulls stay null."""
    ix = row_index(df, order_by, name="_fp")
    first = ix.where(_q(column).isNotNull()).groupBy(_q(column).alias("_v")).agg(F.min("_fp").alias("_first"))
    codes = row_index(first, ["_first"], name="_code", tie_break=False).select("_v", "_code")
    out = df.join(codes, _q(column).eqNullSafe(F.col("_v")), "left").drop("_v")
    return out.withColumn(name or column, F.col("_code")).drop("_code") if (name or column) else out
