"""Evaluation metrics over prediction tables.

Metrics are aggregates (optionally per group): regression metrics in one pass,
classification metrics from the confusion counts (classes x classes rows),
AUC from the distinct-score table with a skew-safe running sum.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import metrics as M
from quarry.functions.scalars import error_cols
from quarry.operators.ordered import DEFAULT_BUCKET_ROWS, join_null_safe, running


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       by: Sequence[str] = ()) -> DataFrame:
    """E1-E3 rmse, mse, mae, mape, smape, wape, r2 (= nse), n."""
    aggs = M.regression_aggs(actual, predicted)
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def confusion(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
              by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(actual).cast("string").alias("actual"),
                      F.col(predicted).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                           by: Sequence[str] = (), average: str = "binary", positive: str = "1") -> DataFrame:
    """E4 accuracy, precision, recall, f1.  ``average``: binary (``positive``
    class), macro or weighted (by support).  Undefined ratios count as 0."""
    cm = confusion(df, actual, predicted, by)
    hit = F.col("actual") == F.col("predicted")
    a = cm.groupBy(*by, F.col("actual").alias("cls")).agg(F.sum("n").alias("support"),
                                                           F.sum(F.when(hit, F.col("n"))).alias("tp"))
    p = cm.groupBy(*by, F.col("predicted").alias("cls")).agg(F.sum("n").alias("pred_n"))
    per = join_null_safe(a, p, [*by, "cls"], "full_outer")
    per = per.select(*by, "cls", F.coalesce("support", F.lit(0)).alias("support"),
                     F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("pred_n", F.lit(0)).alias("pred_n"))
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.withColumns({"precision": prec, "recall": rec})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    per = per.withColumn("f1", f1)
    # one aggregate over the per-class table: accuracy = sum(tp) / sum(support)
    acc = (F.sum("tp") / F.sum("support")).alias("accuracy")
    if average == "binary":
        pick = lambda m: F.max(F.when(F.col("cls") == positive, F.col(m)))
        ms = [pick(m).alias(m) for m in ("precision", "recall", "f1")]
    elif average == "macro":
        ms = [F.avg(m).alias(m) for m in ("precision", "recall", "f1")]
    else:
        w = F.col("support")
        ms = [(F.sum(F.col(m) * w) / F.sum(w)).alias(m) for m in ("precision", "recall", "f1")]
    out = per.groupBy(*by).agg(acc, *ms) if by else per.agg(acc, *ms)
    return out.select(*by, "accuracy", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in ("precision", "recall", "f1")])


def auc(df: DataFrame, score: str = "score", label: str = "actual", by: Sequence[str] = (),
        bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """E5 ROC AUC in rank-sum form with ties at half weight:
    sum over scores of pos_s * (neg_below_s + neg_s / 2) / (P * N).
    ``neg_below`` is a running sum over the distinct scores (range-partitioned,
    so one group with many distinct scores is still split over tasks)."""
    y = F.col(label).cast("int")
    s = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count(F.when(y == 1, 1)).alias("pos"), F.count(F.when(y == 0, 1)).alias("neg"))
    r = running(s, list(by), ["score"], [("neg_below", "sum", "neg", False)], bucket_rows=bucket_rows)
    contrib = F.col("pos") * (F.coalesce("neg_below", F.lit(0)) + F.col("neg") * 0.5)
    g = r.groupBy(*by).agg(F.sum(contrib).alias("_c"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return g.select(*by, F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_c") / (F.col("P") * F.col("N")))
                    .alias("auc"), F.col("P").alias("positives"), F.col("N").alias("negatives"))


def logloss(df: DataFrame, label: str = "actual", prob: str = "score", by: Sequence[str] = (),
            eps: float = 1e-15) -> DataFrame:
    """E6 binary log loss with clipped probabilities."""
    agg = M.logloss(label, prob, eps).alias("logloss")
    return df.groupBy(*by).agg(agg) if by else df.agg(agg)


def silhouette(predictions: DataFrame, features: str = "features", prediction: str = "prediction") -> float:
    """E7 squared-Euclidean silhouette of a clustering (Spark ML evaluator)."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    return ClusteringEvaluator(featuresCol=features, predictionCol=prediction).evaluate(predictions)


def residual_table(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """E9 actual vs predicted with error and percent error."""
    return df.withColumns(error_cols(actual, predicted))


def residual_histogram(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       bins: int = 50) -> DataFrame:
    """E9 50-bin histogram of residuals (predicted - actual)."""
    from quarry.operators.charts import histogram
    res = df.select((F.col(predicted) - F.col(actual)).alias("residual"))
    return histogram(res, "residual", bins)


def bits_per_byte(scored: DataFrame, token_bytes: DataFrame, token: str = "token_id", nats: str = "nats") -> DataFrame:
    """E11 sum(nats of tokens with bytes > 0) / (ln 2 x sum(bytes)); special
    tokens (0 bytes) are left out of both sums.  ``token_bytes`` has one row
    per vocabulary entry; the planner picks the join by its size."""
    tb = token_bytes.select(F.col(token), F.col("n_bytes"))
    j = scored.join(tb, token)
    return j.agg((F.sum(F.when(F.col("n_bytes") > 0, F.col(nats))) /
                  (F.lit(math.log(2.0)) * F.sum("n_bytes"))).alias("bpb"),
                 F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("tokens"))
