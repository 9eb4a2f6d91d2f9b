"""Scalar helpers (F1-F12) on hand-made values."""

from pyspark.sql import functions as F

from quarry.functions import scalars as S


def one(spark, col, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col).collect()]


def test_failure_reasons(spark):
    texts = ["FileNotFoundError: x", "cannot open train.csv", "NameError: name 'DATA_PATH' is not defined",
             "Invalid parameter alpha", "No module named lightgbm", "Timeout 900s", "JSON decode error", None,
             "ValueError"]
    got = one(spark, S.failure_reason(F.col("t")), [(t,) for t in texts], "t string")
    assert got == ["data_path", "data_path", "data_path_inject", "invalid_hyperparameter", "missing_package",
                   "timeout", "bad_output_format", "runtime_error", "runtime_error"]


def test_model_family_and_name(spark):
    texts = ["import lightgbm as lgb", "XGBRegressor()", "torch.nn.Linear", "Ridge(alpha=1)", "", "print(1)"]
    fam = one(spark, S.model_family(F.col("t")), [(t,) for t in texts], "t string")
    assert fam == ["lightgbm", "xgboost", "deep_learning", "linear", "unknown", "other"]
    names = one(spark, S.model_name(F.col("t")), [(t,) for t in texts], "t string")
    assert names == ["Custom Model", "XGBoost", "PyTorch", "Ridge", "Custom Model", "Custom Model"]


def test_sentinels_and_grade(spark):
    vals = [0.0, 999.0, 12.5, 700.0, float("nan"), None]
    assert one(spark, S.is_sentinel(F.col("v"), True), [(v,) for v in vals], "v double") == \
        [True, True, False, True, True, True]
    assert one(spark, S.grade(F.col("s")), [(s,) for s in (95, 80, 79, 60, 10)], "s int") == \
        ["A+", "A", "B", "C", "D"]


def test_pick_metric(spark):
    df = spark.createDataFrame([({"test_rmse": 2.0, "id": 5.0, "r2": 0.9},), ({"r2": 0.8, "epoch": 3.0},),
                                ({"val_loss": 1.5},)], "m map<string,double>")
    name, val = S.pick_metric(F.col("m"), "rmse")
    got = [(r[0], r[1]) for r in df.select(name, val).collect()]
    assert got == [("rmse", 2.0), ("r2", 0.8), ("val_loss", 1.5)]


def test_to_number_and_errors(spark):
    got = one(spark, S.to_number(F.col("s")), [(s,) for s in ("12", "-3.5e2", "1f", "abc", None)], "s string")
    assert got == [12.0, -350.0, None, None, None]
    df = spark.createDataFrame([(10.0, 12.0), (0.0, 1.0)], "actual double, predicted double")
    r = df.select(*[c.alias(k) for k, c in S.error_cols().items()]).collect()
    assert (r[0]["error"], r[0]["pct_error"]) == (2.0, 20.0) and r[1]["pct_error"] is None


def test_symmetric_overfit_of_zero_metrics(spark):
    rows = [(0.0, 0.0), (1.0, 2.0), (0.0, 4.0), (None, 0.0), (None, None), (None, 3.0)]
    got = one(spark, S.overfit_ratio_sym("a", "b") > 0.2, rows, "a double, b double")
    # as the SQL has it: 0 / 0 is not a number, which is above any number
    assert got == [True, True, True, None, None, None]
