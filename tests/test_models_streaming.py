"""Model routes beat the mean baseline; permutation of a constant feature
changes nothing; the streaming leaderboard ends where the batch one does."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import explain as XP
from quarry.operators import models as M
from quarry.operators.evaluation import regression_metrics
from quarry.plans import fixtures as X
from quarry.streaming import leaderboard as ST

SF = "/root/testdata/sf0.001"


def _data(spark):
    rng = spark.range(400).select(F.col("id"), (F.col("id") % 17).cast("double").alias("a"),
                                  (F.col("id") % 5).cast("string").alias("c"), F.lit(1.0).alias("const"))
    return rng.withColumn("y", F.col("a") * 3 + F.when(F.col("c") == "2", 10.0).otherwise(0.0))


def test_linear_route_beats_mean(spark):
    d = _data(spark)
    route = M.Route(M.REGRESSION, "y", M.FeatureSpec(numeric=["a", "const"], categorical=["c"]), "linear")
    model = M.build_model(route, d)
    pred = M.predict(model, d, route, keep=["y"]).withColumnRenamed("y", "actual")
    r = regression_metrics(pred).first()
    assert r["r2"] > 0.99


def test_sweep_logs_and_stops(spark):
    d = _data(spark)
    spec = M.FeatureSpec(numeric=["a"], categorical=["c"])
    model, route, log = M.sweep(d, d, M.REGRESSION, "y", spec, "rmse",
                                candidates=[("linear", {}), ("decision_tree", {}), ("ridge", {})], good_enough=1e-6)
    rows = log.collect()
    assert rows[0]["status"] == "keep" and route.family == "linear" and len(rows) == 1


@pytest.mark.parametrize("good_enough,limit", [(None, 5), (1e-6, 5), (None, 1)])
def test_parallel_sweep_logs_as_in_order(spark, good_enough, limit):
    d = _data(spark)
    cands = [("decision_tree", {"maxDepth": 1}), ("no_such_family", {}), ("linear", {}), ("ridge", {}),
             ("gbt", {"maxIter": 40}), ("random_forest", {"numTrees": 40})]
    logs = []
    for parallel in (1, 3):
        model, route, log = M.sweep(d, d, M.REGRESSION, "y", M.FeatureSpec(numeric=["a"], categorical=["c"]), "rmse",
                                    candidates=cands, good_enough=good_enough, stagnation_limit=limit, parallel=parallel)
        assert model is not None
        logs.append((route.family, [(r["num"], r["model"], r["status"], r["error"], r["metric_value"] and
                                     round(r["metric_value"], 6)) for r in log.orderBy("num").collect()]))
    assert logs[0] == logs[1]
    assert [r[2] for r in logs[0][1]][:3] == ["keep", "crash", "keep"]
    if good_enough:
        assert len(logs[0][1]) == 3
    # nothing is left running, and the caller's own jobs are not cancelled with the candidates
    assert not spark.sparkContext.statusTracker().getActiveJobsIds() and d.count() > 0


def test_constant_feature_has_no_permutation_importance(spark):
    d = _data(spark)
    route = M.Route(M.REGRESSION, "y", M.FeatureSpec(numeric=["a", "const"]), "linear")
    model = M.build_model(route, d)

    def rmse(p):
        return regression_metrics(p.select(F.col("y").alias("actual"), F.col("prediction").alias("predicted"))).first()["rmse"]
    imp = {r["feature"]: r["delta"] for r in XP.permutation_importance(model, d, ["const", "a"], "id", rmse).collect()}
    assert abs(imp["const"]) < 1e-9 and imp["a"] > 0


def test_stream_leaderboard_equals_batch(spark):
    log = X.explog(spark, SF).select("run_id", "num", "model", "metric_val", "status")
    src = ST.scratch(spark, "t-st1")
    log.repartition(4).write.parquet(src)
    q = ST.start_leaderboard(spark, src, log.schema, "t_lb_" + os.path.basename(src).replace("-", "_"))
    q.awaitTermination()
    got = {(r["run_id"], r["model"]): (r["best_value"], r["n"]) for r in spark.table(q.name).collect()}
    batch = ST.leaderboard_aggregate(log).collect()
    assert got == {(r["run_id"], r["model"]): (r["best_value"], r["n"]) for r in batch}


def test_sweep_makes_its_tables_once(spark):
    made = spark.sparkContext.accumulator(0)

    def read(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    d = _data(spark).coalesce(1).mapInPandas(read, "id long, a double, c string, const double, y double")
    _, _, log = M.sweep(d, d, M.REGRESSION, "y", M.FeatureSpec(numeric=["a"], categorical=["c"]), "rmse",
                        candidates=[("ridge", {}), ("linear", {}), ("decision_tree", {}), ("lasso", {})], parallel=2)
    assert log.where("status = 'crash'").count() == 0 and log.count() == 4
    # once for the features, once for the test rows, whatever the number of stages and candidates
    assert made.value == 2 * 400
    assert not spark.sparkContext._jsc.getPersistentRDDs().size()
