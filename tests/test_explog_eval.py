"""Experiment-log windows and evaluation metrics on tiny hand-checked inputs."""

import pandas as pd

from quarry.operators import evaluation as E
from quarry.operators import explog as L
from quarry.operators import splits as V

LOG = [  # run, num, model, metric, status
    (1, 1, "gbt", 10.0, "keep"), (1, 2, "gbt", 12.0, "discard"), (1, 3, "rf", 0.0, "crash"),
    (1, 4, "rf", 9.0, "keep"), (1, 5, "lin", 9.5, "discard"), (1, 6, "lin", 0.0, "crash"),
    (1, 7, "lin", 0.0, "crash"), (1, 8, "lin", 0.0, "crash"), (1, 9, "gbt", 8.0, "keep"),
    (2, 1, "rf", 5.0, "discard"), (2, 2, "rf", 6.0, "discard"),
]


def _log(spark):
    return spark.createDataFrame(LOG, "run_id int, num long, model string, metric_val double, status string") \
        .withColumn("error", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("Timeout 900s"))


def test_running_best_and_decisions(spark):
    rb = {(r["run_id"], r["num"]): r["running_best"] for r in L.running_best(_log(spark)).collect()}
    assert rb[(1, 2)] == 10.0 and rb[(1, 9)] == 8.0
    d = {(r["run_id"], r["num"]): r["decision"] for r in L.decisions(_log(spark)).collect()}
    assert [d[(1, i)] for i in range(1, 10)] == ["keep", "discard", "crash", "keep", "discard", "crash", "crash",
                                                 "crash", "keep"]
    assert d[(2, 1)] == "keep" and d[(2, 2)] == "discard"


def test_stagnation_and_crash_streaks(spark):
    s = {(r["run_id"], r["num"]): r["no_improve"] for r in L.stagnation(_log(spark)).collect()}
    assert [s[(1, i)] for i in range(1, 10)] == [0, 1, 1, 0, 1, 1, 1, 1, 0]
    st = L.crash_streaks(_log(spark)).collect()
    assert [(r["start_num"], r["end_num"], r["length"]) for r in st] == [(6, 8, 3)]


def test_best_experiment_fallback(spark):
    b = {r["run_id"]: (r["num"], r["source"]) for r in L.best_experiment(_log(spark)).collect()}
    assert b == {1: (9, "keep"), 2: (1, "fallback")}


def test_auc_with_ties_matches_pairwise_count(spark):
    data = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.1), (0, 0.7)]
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    exp = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(data, "actual int, score double")
    assert abs(E.auc(df).first()["auc"] - exp) < 1e-12


def test_regression_metrics(spark):
    pdf = pd.DataFrame({"actual": [1.0, 2.0, 0.0, 4.0], "predicted": [1.5, 1.0, 0.5, 4.0]})
    r = E.regression_metrics(spark.createDataFrame(pdf)).first()
    err = pdf.predicted - pdf.actual
    assert abs(r["rmse"] - (err ** 2).mean() ** 0.5) < 1e-12
    assert abs(r["r2"] - (1 - (err ** 2).sum() / ((pdf.actual - pdf.actual.mean()) ** 2).sum())) < 1e-12
    nz = pdf.actual != 0
    assert abs(r["mape"] - (err[nz] / pdf.actual[nz]).abs().mean()) < 1e-12


def test_macro_f1(spark):
    a = ["x", "x", "y", "y", "z"]
    p = ["x", "y", "y", "y", "x"]
    df = spark.createDataFrame(list(zip(a, p)), "actual string, predicted string")
    r = E.classification_metrics(df, average="macro").first()
    # per class: x P=1/2 R=1/2 F=1/2; y P=2/3 R=1 F=0.8; z P=0 R=0 F=0
    assert abs(r["f1"] - (0.5 + 0.8 + 0.0) / 3) < 1e-12 and abs(r["accuracy"] - 0.6) < 1e-12


def test_splits_partition_the_input(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    h = V.hash_split(df, ["k"])
    assert h.where("split = 'train'").count() + h.where("split = 'test'").count() == 1000
    t = V.time_split(df, ["k"], 0.8)
    assert t.where("split = 'train'").count() == 800
    f = V.stratified_kfold(df.withColumn("y", df.k % 3), "y", ["k"], 5)
    counts = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(counts) - min(counts) <= 3


def test_oversample_integer_factors(spark):
    df = spark.createDataFrame([(i, 0 if i < 9 else 1) for i in range(12)], "id int, y int")
    out = V.oversample(df, "y")
    c = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert c == {0: 9, 1: 9}
