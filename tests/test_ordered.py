"""Row index, running aggregates and bounded windows: equal to pandas, the
same for 1 and 8 partitions, and balanced when one key holds a third of rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import ordered as O


def _data(spark, n=300, hot=100):
    rng = np.random.default_rng(1)
    keys = np.r_[np.zeros(hot, dtype=int), rng.integers(1, 20, n - hot)]
    pdf = pd.DataFrame({"k": keys, "t": rng.permutation(n), "v": rng.normal(size=n).round(3)})
    pdf.loc[pdf.index % 7 == 0, "v"] = np.nan
    df = spark.createDataFrame(pdf.astype({"k": "int64", "t": "int64"}))
    # Spark keeps NaN apart from null; normalise at ingest as the library does
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))), pdf


@pytest.mark.parametrize("parts", [1, 8])
def test_row_index_matches_pandas(spark, parts):
    df, pdf = _data(spark)
    got = O.row_index(df, ["t"], ["k"], name="i", num_partitions=parts).toPandas().sort_values("t")
    exp = pdf.sort_values(["k", "t"]).assign(i=lambda d: d.groupby("k").cumcount()).sort_values("t")
    assert got["i"].tolist() == exp["i"].tolist()


def test_global_row_index_dense(spark):
    df, _ = _data(spark)
    got = O.row_index(df, ["t"], name="i").orderBy("t").toPandas()
    assert got["i"].tolist() == list(range(len(got)))


def test_hot_key_is_split_across_partitions(spark):
    df, _ = _data(spark, n=3000, hot=1000)
    ranged = df.repartitionByRange(8, "k", "t")
    per_part = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.when(F.col("k") == 0, 1)).alias("hot"))
    assert per_part.where("hot > 0").count() >= 2


@pytest.mark.parametrize("bucket", [3, 1 << 20])
def test_running_aggregates(spark, bucket):
    df, pdf = _data(spark)
    out = O.running(df, ["k"], ["t"], [("mn", "min", "v"), ("sm", "sum", "v"), ("ls", "last", "v"),
                                       ("px", "max", "v", False)], bucket_rows=bucket).toPandas().sort_values("t")
    e = pdf.sort_values(["k", "t"]).copy()
    g = e.groupby("k")["v"]
    # SQL window semantics: nulls are skipped, not propagated
    e["mn"] = g.transform(lambda s: s.expanding().min())
    e["sm"] = g.transform(lambda s: s.expanding().sum())
    e["ls"] = g.ffill()
    e["px"] = g.transform(lambda s: s.expanding().max().shift(1))
    e = e.sort_values("t")
    for c in ("mn", "sm", "ls", "px"):
        np.testing.assert_allclose(out[c].astype(float).values, e[c].astype(float).values, equal_nan=True)


def test_halo_centered_window(spark):
    df, pdf = _data(spark)
    out = O.halo(df, ["k"], ["t"], 2, 1, lambda w: {"rm": F.avg("v").over(w.rowsBetween(-2, 1))},
                 bucket_rows=4).toPandas().sort_values("t")
    # direct definition for the check
    ref = []
    for _, g in pdf.sort_values(["k", "t"]).groupby("k"):
        vals = g["v"].values
        for i in range(len(vals)):
            w = vals[max(0, i - 2): i + 2]
            ref.append((g["t"].values[i], np.nanmean(w) if np.isfinite(w).any() else np.nan))
    ref = pd.DataFrame(ref, columns=["t", "rm"]).sort_values("t")
    np.testing.assert_allclose(out["rm"].values, ref["rm"].values, equal_nan=True)


def test_prefix_rolling_equals_halo(spark):
    df, _ = _data(spark)
    a = O.halo(df.fillna(0.0), ["k"], ["t"], 3, 2, lambda w: {"r": F.avg("v").over(w.rowsBetween(-3, 2))},
               bucket_rows=5).select("t", "r")
    b = O.rolling_mean_prefix(df.fillna(0.0), ["k"], ["t"], "v", 3, 2, "r", bucket_rows=5).select("t", "r")
    j = a.join(b.withColumnRenamed("r", "r2"), "t").toPandas()
    np.testing.assert_allclose(j["r"], j["r2"], atol=1e-9)


def test_null_keys_stay_together(spark):
    pdf = pd.DataFrame({"k": [None, None, 1.0, 1.0, None], "t": [5, 1, 2, 3, 4]})
    df = spark.createDataFrame(pdf)
    out = O.row_index(df, ["t"], ["k"], name="i").orderBy("t").toPandas()
    assert out["i"].tolist() == [0, 0, 1, 1, 2]


def test_prefix_rolling_single_series(spark):
    df, _ = _data(spark)
    d = df.fillna(0.0).select("t", "v")
    a = O.halo(d, [], ["t"], 4, 3, lambda w: {"r": F.avg("v").over(w.rowsBetween(-4, 3))}, bucket_rows=7)
    b = O.rolling_mean_prefix(d, [], ["t"], "v", 4, 3, "r2", bucket_rows=7)
    j = a.join(b.select("t", "r2"), "t").toPandas()
    np.testing.assert_allclose(j["r"], j["r2"], atol=1e-9)
    assert len(j) == 300
