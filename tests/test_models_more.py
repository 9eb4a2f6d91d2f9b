"""Routes recover known models, scoring runs end to end, and results do not depend on
prefixes, arrival order or partitioning."""

import math
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import anomaly as A
from quarry.operators import explain as XP
from quarry.operators import joins as J
from quarry.operators import models as M
from quarry.operators import profile as P
from quarry.operators import scoring as C


def _binary(spark, n=600):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(n)]
    return spark.createDataFrame([(i, a, b, "yes" if a + 0.5 * b > 0 else "no") for i, a, b in rows],
                                 "id long, a double, b double, y string")


def test_mlp_with_late_categories(spark):
    rows = [(i, float(i % 7), "early" if i < 1500 else f"late{i % 4}", "p" if i % 7 > 3 else "n") for i in range(1600)]
    d = spark.createDataFrame(rows, "id long, x double, c string, y string").coalesce(1)
    route = M.Route(M.BINARY, "y", M.FeatureSpec(numeric=["x"], categorical=["c"]), "mlp", {"maxIter": 30})
    model = M.build_model(route, d)
    pred = M.predict(model, d, route, keep=["y"]).collect()
    assert len(pred) == 1600 and sum(r["y"] == r["predicted"] for r in pred) > 1200


@pytest.mark.parametrize("family", ["svm", "logistic", "naive_bayes", "decision_tree", "random_forest"])
def test_classifiers_have_an_auc(spark, family):
    d = _binary(spark)
    _, route, log = M.sweep(d, d.where("id % 3 = 0"), M.BINARY, "y", M.FeatureSpec(numeric=["a", "b"]), "auc",
                            candidates=[(family, {})])
    row = log.first()
    assert row["status"] == "keep" and row["metric_value"] > 0.85 and route.family == family


def test_auc_uses_the_fitted_positive_class(spark):
    d = _binary(spark)
    route = M.Route(M.BINARY, "y", M.FeatureSpec(numeric=["a", "b"]), "logistic")
    model = M.build_model(route, d)
    assert M.class_labels(model) == ["no", "yes"]
    only = M.predict(model, d.where("y = 'no'"), route, keep=["y"])
    assert M.evaluate(only, M.BINARY, "y", "accuracy", M.class_labels(model)) > 0.8


def test_folds_do_not_depend_on_partitions(spark):
    d = _binary(spark).withColumn("t", F.col("a") * 3 + F.col("b"))
    route = M.Route(M.REGRESSION, "t", M.FeatureSpec(numeric=["a", "b"]), "ridge")
    got = [M.cross_validate(d.repartition(n), route, "rmse", grid={"regParam": [0.01, 1.0]}, key=["id"])[1] for n in (1, 5)]
    assert got[0] == pytest.approx(got[1], rel=1e-6) and got[0][0] < got[0][1]


def test_log_target_and_stacking_beat_the_mean(spark):
    d = _binary(spark).withColumn("t", F.exp(F.col("a")) + 1)
    spec = M.FeatureSpec(numeric=["a", "b"])
    log = M.Route(M.REGRESSION, "t", spec, "linear", log_target=True)
    pred = M.predict(M.build_model(log, d), d, log, keep=["t"])
    assert M.evaluate(pred, M.REGRESSION, "t", "r2") > 0.7
    stacked = M.stacking(d.where("id % 4 > 0"), d.where("id % 4 = 0"), M.Route(M.REGRESSION, "t", spec, "linear"),
                         ["linear", "decision_tree"], "id")
    assert M.evaluate(stacked, M.REGRESSION, "t", "r2") > 0.7


def test_clusters_and_components_of_known_groups(spark):
    rng = np.random.default_rng(0)
    centres = np.array([[0, 0, 0, 0], [9, 0, 0, 0], [0, 9, 0, 0]])
    rows = [(i, [float(v) for v in centres[i % 3] + rng.normal(0, 0.3, 4)]) for i in range(150)]
    d = M.vectors(spark.createDataFrame(rows, "id long, e array<double>"), "e")
    k, model, _ = M.kmeans_sweep(d, ks=(2, 3, 5))
    assert k == 3
    for fitted in (model, M.hierarchical(d, 3), M.mixture(d, 3)):
        groups = {}
        for r in fitted.transform(d).select("id", "prediction").collect():
            groups.setdefault(r["id"] % 3, set()).add(r["prediction"])
        assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == 3
    assert sum(M.pca(d, 2).explainedVariance.toArray()) > 0.95


def test_survival_route_orders_by_risk(spark):
    rng = random.Random(4)
    rows = [(i, x := rng.random(), math.exp(1 + 2 * x) * rng.uniform(0.8, 1.2), 1.0) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, x double, t double, censor double")
    route = M.Route(M.REGRESSION, "t", M.FeatureSpec(numeric=["x"]), "survival")
    pred = M.predict(M.build_model(route, d), d, route, keep=["x"]).orderBy("x").collect()
    assert pred[-1]["predicted"] > 3 * pred[0]["predicted"] > 0


def test_forecast_of_an_unlabelled_table(spark):
    days = pd.date_range("2024-01-01", periods=120)
    value = [100 + 2 * i + 10 * (d.dayofweek == 5) for i, d in enumerate(days)]
    df = spark.createDataFrame(pd.DataFrame({"day": days.date, "v": [float(x) for x in value]}))
    nxt = pd.date_range("2024-04-30", periods=7)
    out = M.forecast_ahead(df, spark.createDataFrame(pd.DataFrame({"day": nxt.date})), "day", "v", lags=(1, 7), family="linear")
    got = [r["predicted"] for r in out.orderBy("step").collect()]
    want = [100 + 2 * (120 + i) + 10 * (d.dayofweek == 5) for i, d in enumerate(nxt)]
    assert len(got) == 7 and max(abs(a - b) for a, b in zip(got, want)) < 8


def test_score_from_saved_metadata(spark):
    d = _binary(spark).withColumn("t", F.col("a") * 3 + F.col("b")).withColumn("leak", F.col("t"))
    route = M.Route(M.REGRESSION, "t", M.FeatureSpec(numeric=["a", "b"]), "linear")
    model = M.build_model(route, d)
    meta = {"columns": ["a", "b"], "id_columns": ["id"], "leakage": ["leak"]}
    new = d.drop("t").withColumn("extra", F.lit(5))
    out = C.score(model, route, new, meta)
    assert out.columns == ["id", "t"]
    truth = {r["id"]: r["t"] for r in d.collect()}
    assert all(abs(r["t"] - truth[r["id"]]) < 1e-6 for r in out.collect())
    with pytest.raises(ValueError):
        C.score(model, route, d.select("id"), meta)
    codes = C.freeze_encoding(spark.createDataFrame([("x",), ("b",), (None,)], "c string"), "c")
    assert codes == {"categories": ["b", "x"], "one_hot": True}
    coded = C.encode_like_training(spark.createDataFrame([("x",), ("new",), (None,)], "c string"), "c", ["b", "x"], as_codes=True)
    assert sorted(str(r["c"]) for r in coded.collect()) == ["1", "None", "None"]


def test_isolation_forest_ignores_arrival_order(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 3)]) for i in range(600)] + [(600, [9.0, 9.0, 9.0])]
    d = spark.createDataFrame(rows, "id long, x array<double>")
    one = {r["id"]: r["anomaly_score"] for r in A.isolation_forest(d.coalesce(1), "x", trees=20, key=["id"]).collect()}
    two = {r["id"]: r["anomaly_score"] for r in A.isolation_forest(d.repartition(6), "x", trees=20, key=["id"]).collect()}
    assert one == pytest.approx(two) and max(one, key=one.get) == 600
    x = np.array([r[1] for r in rows])
    far = A.centroid_distance(d, "x", k=2).collect()
    for c in (0, 1):
        own = [r for r in far if r["cluster"] == c]
        centre = x[[r["id"] for r in own]].mean(0)
        assert max(abs(r["centroid_distance"] - np.linalg.norm(x[r["id"]] - centre)) for r in own) < 0.3
    maha = {r["id"]: r["mahalanobis"] for r in A.mahalanobis(d, "x").collect()}
    diff = x - x.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", diff, np.linalg.pinv(np.cov(x.T)), diff))
    assert [maha[i] for i in range(601)] == pytest.approx(want.tolist())


def test_pairwise_correlations_of_many_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 60)) + 1e6
    x[:, 1] = 2 * x[:, 0] + rng.normal(0, 0.1, 200)
    x[:, 2] = 7.0
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(60)])
    pdf[rng.random(pdf.shape) < 0.1] = None
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)],
                               ", ".join(f"c{i} double" for i in range(60)))
    got = P.pairwise_corr(df, [F.col(f"c{i}") for i in range(60)])
    want = pdf.astype(float).corr().to_numpy()
    assert np.allclose(got, want, atol=1e-6, equal_nan=True)
    top = P.top_correlations(df, [f"c{i}" for i in range(60)], k=1, exclude_id_like=False).first()
    assert (top["col1"], top["col2"]) == ("c0", "c1")


def test_decimals_are_counted_exactly(spark):
    vals = [Decimal("123456789012345678901234567890.11"), Decimal("123456789012345678901234567890.12")]
    df = spark.createDataFrame([(v,) for v in vals], "d decimal(38,2)")
    assert P.value_counts(df, ["d"]).count() == 2


def test_auto_join_plan_grows_linearly(spark):
    scans = []
    for n in (3, 5, 7):
        tables = {f"t{i}.csv": spark.range(20).select((F.col("id") + i).alias("key_id"), F.lit(i).alias(f"v{i}")) for i in range(n)}
        out, _ = J.auto_join(tables, key="key_id")
        assert out.count() == 20 + n - 1
        scans.append(out._jdf.queryExecution().optimizedPlan().collectLeaves().size())
    assert max(scans) <= 4


def test_partial_dependence_of_the_top_inputs(spark):
    d = _binary(spark).withColumns({"c": F.rand(1), "t": F.col("a") * 9 + F.col("b") * 3})
    route = M.Route(M.REGRESSION, "t", M.FeatureSpec(numeric=["a", "b", "c"]), "linear")
    model = M.build_model(route, d)
    assert XP.top_inputs(model, d, 2) == ["a", "b"]
    assert {r["feature"] for r in XP.partial_dependence(model, d, points=5).collect()} == {"a", "b", "c"}


def test_failure_reasons_and_families_by_hand(spark):
    errors = {"FileNotFoundError: [Errno 2] x": "data_path", "no such file or directory": "data_path",
              "could not open train.csv": "data_path", "NameError: name 'DATA_PATH' is not defined": "data_path_inject",
              "No module named 'lightgbm'": "missing_package", "Timeout after 900s": "timeout",
              "JSON decode failed": "bad_output_format", "Invalid parameter alpha": "invalid_hyperparameter",
              "ValueError: shapes differ": "runtime_error"}
    df = spark.createDataFrame(list(errors.items()), "e string, want string")
    assert df.where(S.failure_reason(F.col("e")) != F.col("want")).count() == 0
    code = {"m = lgb.LGBMRegressor()": "lightgbm", "XGBClassifier()": "xgboost", "CatBoostRegressor()": "catboost",
            "RandomForestRegressor()": "random_forest", "Ridge(alpha=1)": "linear", "SVC(C=1)": "svm",
            "from prophet import Prophet": "prophet", "an LSTM net": "deep_learning", "print(1)": "other", "": "unknown"}
    df = spark.createDataFrame(list(code.items()), "c string, want string")
    assert df.where(S.model_family(F.col("c")) != F.col("want")).count() == 0


def test_target_candidates_by_hand(spark):
    rows = [(i, f"name{i}", "a" if i % 2 else "b", i % 3, float(i) * 1.5, int(i > 20)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, customer_name string, segment string, plan_code int, amount double, churn int")
    got = [r["name"] for r in P.target_candidates(P.profile_columns(df, quantiles=False), 60).orderBy("rank").collect()]
    assert got[0] == "churn" and "id" not in got and "customer_name" not in got and "segment" in got


def test_synthetic_rows_come_from_near_neighbours(spark):
    from quarry.operators.splits import synthetic_minority
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (8, 0), (0, 8))])
    df = spark.createDataFrame([(float(a), float(b), "m") for a, b in x] + [(1.0, 1.0, "o"), (None, 2.0, "m")],
                               "a double, b double, y string")
    out = synthetic_minority(df, "y", ["a", "b"], "m", k=3).toPandas()
    assert len(out) == 120 * 3 and set(out["y"]) == {"m"}
    made = out[["a", "b"]].to_numpy()
    centre = np.array([[0, 0], [8, 0], [0, 8]])
    # no row between two groups, and made rows lie about as close to a real one as real neighbours do
    assert np.linalg.norm(made[:, None] - centre[None], axis=2).min(1).max() < 2
    near = np.sort(np.linalg.norm(x[:, None] - x[None], axis=2), axis=1)[:, 1:4].mean()
    assert np.linalg.norm(made[:, None] - x[None], axis=2).min(1).mean() < near
    again = synthetic_minority(df.repartition(3), "y", ["a", "b"], "m", k=3).toPandas()
    assert np.allclose(np.sort(again["a"]), np.sort(out["a"]))


def test_candidates_by_size():
    from quarry.operators import models as M
    for task in (M.REGRESSION, M.BINARY, M.MULTICLASS):
        small, medium, large = (M.default_candidates(task, n) for n in (499, 500, 2000))
        assert all(f not in ("gbt", "random_forest", "decision_tree") for f, _ in small)
        assert medium[0][0] == "gbt" and medium[0][1]["minInstancesPerNode"] == 20 and medium != large
        assert large == M.default_candidates(task) and large[0] == ("gbt", {})
        for family, params in small + medium + large:
            M.estimator(task, family, n_features=3, n_classes=2, **params)


def test_folds_and_base_routes_read_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(i):
        seen.add(1)
        return float(i % 17)

    d = spark.range(240).select(F.col("id").alias("k"), counted("id").alias("x"), (F.col("id") % 5).alias("z"))
    d = d.withColumn("y", F.col("x") * 2.0 + F.col("z"))
    route = M.Route(M.REGRESSION, "y", M.FeatureSpec(numeric=["x", "z"]), "ridge")
    _, metrics = M.cross_validate(d, route, "rmse", folds=2, grid={"regParam": [0.01, 1.0]}, key=["k"])
    assert len(metrics) == 2 and 240 <= seen.value <= 480
    before = seen.value
    out = M.stacking(d.where("k % 4 > 0"), d.where("k % 4 = 0"), route, ["ridge", "linear"], "k", folds=2)
    assert out.count() == 60 and seen.value - before <= 960
