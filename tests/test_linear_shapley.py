"""Linear Shapley values (X4) against numpy, and on thousands of feature slots."""

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Tokenizer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from quarry.operators.explain import linear_shapley


def test_equals_numpy(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(200, 3)) * [1, 5, 0.1]
    y = x @ [2.0, -1.0, 3.0] + rnd.normal(size=200) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"),
                             LinearRegression(labelCol="y")]).fit(df)
    coef = model.stages[-1].coefficients.toArray()
    want = np.abs(coef * (x - x.mean(axis=0))).mean(axis=0)
    got = linear_shapley(model, df).collect()
    assert sorted(r["mean_abs_shap"] for r in got) == [r["mean_abs_shap"] for r in got][::-1]
    assert np.allclose(sorted(want), [r["mean_abs_shap"] for r in got][::-1])


def test_many_slots(spark):
    df = spark.range(300).select(F.concat(F.lit("w"), F.col("id") % 7, F.lit(" z"), F.col("id")).alias("t"),
                                 (F.col("id") % 7).cast("double").alias("y"))
    model = Pipeline(stages=[Tokenizer(inputCol="t", outputCol="w"), HashingTF(inputCol="w", outputCol="features", numFeatures=16384),
                             LinearRegression(labelCol="y", solver="l-bfgs", regParam=0.1, maxIter=3)]).fit(df)
    got = linear_shapley(model, df)
    assert got.count() == 16384 and got.where("mean_abs_shap > 0").count() >= 7
