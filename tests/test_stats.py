"""Exact quantiles by every path equal pandas; top-k per group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import stats as S

PS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.r_[np.zeros(600, dtype=int), rng.integers(1, 4, 400)],
                        "a": np.r_[np.zeros(400), rng.normal(size=600)].round(3),
                        "b": rng.exponential(size=1000).round(1)})
    return spark.createDataFrame(pdf), pdf


def _check(rows, pdf, by=None):
    for r in rows:
        s = pdf[pdf["g"] == r["g"]][r["column"]] if by else pdf[r["column"]]
        assert np.isclose(r["value"], s.quantile(r["p"])), (r, s.quantile(r["p"]))


def test_fast_path(spark, data):
    df, pdf = data
    _check(S.quantiles_df(df, ["a", "b"], PS).collect(), pdf)


def test_distributed_band_path(spark, data, monkeypatch):
    df, pdf = data
    monkeypatch.setattr(S, "MAX_SMALL_ROWS", 0)
    _check(S.quantiles_df(df, ["a", "b"], PS, accuracy=50).collect(), pdf)


def test_sort_path_and_groups(spark, data):
    df, pdf = data
    _check(S.quantiles_by_sort(df, ["a", "b"], PS).collect(), pdf)
    _check(S.quantiles_df(df, ["a"], PS, by=["g"]).collect(), pdf, by=["g"])


def test_top_k_per_group(spark, data):
    df, pdf = data
    got = S.top_k_per_group(df, ["g"], [F.desc("b"), F.asc("a")], 3, rank_name="r").collect()
    for g, part in pdf.groupby("g"):
        exp = part.sort_values(["b", "a"], ascending=[False, True]).head(3)["b"].tolist()
        assert [r["b"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["r"])] == exp


def test_quantiles_of_many_columns_in_any_order_of_shares(spark):
    # more columns than one generated method takes, shares not ascending
    df = spark.range(200).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(70)])
    got = {(r["column"], r["p"]): r["value"] for r in S.quantiles_df(df, df.columns, [0.75, 0.25]).collect()}
    assert got == {(f"c{i}", p): 199 * p * (i + 1) for i in range(70) for p in (0.75, 0.25)}
