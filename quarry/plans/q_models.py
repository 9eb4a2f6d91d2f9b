"""Queries: model routes (M1-M21), scoring (C2-C10), explanation (X1-X6),
anomaly scores (M17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import explain as XP
from quarry.operators import models as M
from quarry.operators import scoring as C
from quarry.operators.splits import mod_split
from quarry.plans.registry import finish, register, sql_round
from quarry.session import read_table


def _orders_features(spark, sf):
    o = read_table(spark, sf, "orders")
    c = read_table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    return mod_split(o.join(c, o.o_custkey == c.c_custkey), "o_orderkey")


def _doc_labels(spark, sf):
    lab = read_table(spark, sf, "labels")
    doc = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mod_split(lab.join(doc, "doc_id"), "doc_id")


REG_SPEC = M.FeatureSpec(numeric=["c_acctbal", "c_nationkey"], categorical=["o_orderpriority", "c_mktsegment"],
                         datetime=["o_orderdate"])


def _fit_predict(spark, sf, family, task=M.REGRESSION, target="o_totalprice", spec=REG_SPEC, **params):
    d = _orders_features(spark, sf)
    route = M.Route(task, target, spec, family, params)
    model = M.build_model(route, d.where(F.col("split") == "train"))
    return M.predict(model, d.where(F.col("split") == "test"), route, keep=["o_orderkey", target])


@register("m1_m6_linear_regression")
def m1_m6_linear_regression(spark, sf):
    return _fit_predict(spark, sf, "ridge")


@register("m5_log_target_regression")
def m5_log_target_regression(spark, sf):
    d = _orders_features(spark, sf)
    route = M.Route(M.REGRESSION, "o_totalprice", REG_SPEC, "ridge", log_target=True)
    model = M.build_model(route, d.where(F.col("split") == "train"))
    return M.predict(model, d.where(F.col("split") == "test"), route, keep=["o_orderkey", "o_totalprice"])


@register("m8_gbt_regression")
def m8_gbt_regression(spark, sf):
    return _fit_predict(spark, sf, "gbt")


@register("m9_random_forest_multiclass")
def m9_random_forest_multiclass(spark, sf):
    spec = M.FeatureSpec(numeric=["o_totalprice", "c_acctbal"], categorical=["o_orderpriority"],
                         datetime=["o_orderdate"])
    return _fit_predict(spark, sf, "random_forest", M.MULTICLASS, "o_orderstatus", spec)


@register("m9_decision_tree_regression")
def m9_decision_tree_regression(spark, sf):
    return _fit_predict(spark, sf, "decision_tree")


DOC_SPEC = M.FeatureSpec(numeric=["n_chars", "quality"], categorical=["lang", "source"])


def _doc_predict(spark, sf, family, spec=DOC_SPEC, **params):
    d = _doc_labels(spark, sf)
    route = M.Route(M.BINARY, "toxic", spec, family, params)
    model = M.build_model(route, d.where(F.col("split") == "train"))
    return M.predict(model, d.where(F.col("split") == "test"), route, keep=["doc_id", "toxic"])


@register("m7_logistic_binary")
def m7_logistic_binary(spark, sf):
    return _doc_predict(spark, sf, "logistic")


@register("m7_linear_svm")
def m7_linear_svm(spark, sf):
    return _doc_predict(spark, sf, "svm")


@register("m10_naive_bayes")
def m10_naive_bayes(spark, sf):
    return _doc_predict(spark, sf, "naive_bayes")


@register("m10_mlp")
def m10_mlp(spark, sf):
    return _doc_predict(spark, sf, "mlp")


@register("m13_text_classification")
def m13_text_classification(spark, sf):
    return _doc_predict(spark, sf, "logistic", M.FeatureSpec(text="text"), regParam=0.01)


@register("m14_embedding_classifier")
def m14_embedding_classifier(spark, sf):
    e = mod_split(read_table(spark, sf, "embeddings"), "vec_id")
    route = M.Route(M.MULTICLASS, "label", M.FeatureSpec(vector="embedding"), "logistic", {"regParam": 0.01})
    model = M.build_model(route, e.where(F.col("split") == "train"))
    return M.predict(model, e.where(F.col("split") == "test"), route, keep=["vec_id", "label"])


@register("m15_e7_kmeans_silhouette")
def m15_e7_kmeans_silhouette(spark, sf):
    e = M.vectors(read_table(spark, sf, "embeddings"), "embedding")
    k, _model, scores = M.kmeans_sweep(e, ks=(2, 4, 6, 8, 10))
    return spark.createDataFrame([(kk, float(s), kk == k) for kk, s in scores], "k int, silhouette double, chosen boolean")


@register("m15_mixture_and_bisecting")
def m15_mixture_and_bisecting(spark, sf):
    e = M.vectors(read_table(spark, sf, "embeddings"), "embedding")
    g = M.mixture(e, 4, reduce_to=8).transform(e).select("vec_id", F.col("prediction").alias("gmm"))
    b = M.hierarchical(e, 4).transform(e).select("vec_id", F.col("prediction").alias("bisecting"))
    return g.join(b, "vec_id")


@register("m16_pca")
def m16_pca(spark, sf):
    from pyspark.ml.functions import vector_to_array
    e = M.vectors(read_table(spark, sf, "embeddings"), "embedding")
    return M.pca(e, 3).transform(e).select("vec_id", vector_to_array("pca").alias("pc"))


@register("m17_anomaly_scores")
def m17_anomaly_scores(spark, sf):
    from quarry.operators import anomaly as A
    e = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    s = A.centroid_distance(e, "x", k=4)
    s = A.mahalanobis(s, "x")
    s = A.isolation_forest(s, "x", trees=100, key=["vec_id"])
    return s.select("vec_id", "cluster", "centroid_distance", "mahalanobis", "anomaly_score")


@register("m18_survival_regression")
def m18_survival_regression(spark, sf):
    li = mod_split(read_table(spark, sf, "lineitem"), "l_orderkey")
    li = li.withColumn("censor", (F.col("l_linestatus") == "F").cast("double"))
    spec = M.FeatureSpec(numeric=["l_discount", "l_tax"])
    route = M.Route(M.REGRESSION, "l_quantity", spec, "survival", {"censorCol": "censor"})
    model = M.build_model(route, li.where(F.col("split") == "train"))
    return M.predict(model, li.where(F.col("split") == "test"), route, keep=["l_orderkey", "l_linenumber"])


@register("m12_cross_validation")
def m12_cross_validation(spark, sf):
    d = _orders_features(spark, sf).where(F.col("split") == "train")
    route = M.Route(M.REGRESSION, "o_totalprice", REG_SPEC, "ridge")
    _model, metrics = M.cross_validate(d, route, "rmse", folds=3, grid={"regParam": [0.01, 1.0]})
    return spark.createDataFrame([(p, float(m)) for p, m in zip([0.01, 1.0], metrics)],
                                 "regParam double, rmse double")


@register("m11_stacking")
def m11_stacking(spark, sf):
    d = _orders_features(spark, sf)
    route = M.Route(M.REGRESSION, "o_totalprice", REG_SPEC, "linear")
    return M.stacking(d.where(F.col("split") == "train"), d.where(F.col("split") == "test"), route,
                      ["ridge", "decision_tree"], "o_orderkey")


@register("m21_experiment_sweep")
def m21_experiment_sweep(spark, sf):
    d = _orders_features(spark, sf)
    _model, _route, log = M.sweep(d.where(F.col("split") == "train"), d.where(F.col("split") == "test"),
                                  M.REGRESSION, "o_totalprice", REG_SPEC, "rmse", parallel=4)
    return log


@register("m2_target_encoding", """
WITH t AS (SELECT c.c_nationkey, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderkey % 5 <> 4),
p AS (SELECT avg(o_totalprice) AS prior FROM t),
g AS (SELECT c_nationkey, sum(o_totalprice) AS s, count(*) AS n FROM t GROUP BY 1)
SELECT g.c_nationkey, round((g.s + 10 * p.prior) / (g.n + 10), 6) AS encoded FROM g, p""")
def m2_target_encoding(spark, sf):
    from quarry.operators.features import target_encoding
    d = _orders_features(spark, sf).where(F.col("split") == "train")
    return finish(target_encoding(d, "c_nationkey", "o_totalprice", smoothing=10))


@register("m3_interactions", """
SELECT o_orderkey, round(c_acctbal * o_totalprice, 2) AS c_acctbal_x_o_totalprice,
  round(o_totalprice / nullif(c_acctbal, 0), 6) AS o_totalprice_per_c_acctbal
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def m3_interactions(spark, sf):
    from quarry.operators.features import interactions
    d = _orders_features(spark, sf)
    out = interactions(d, [("c_acctbal", "o_totalprice")], ratios=[("o_totalprice", "c_acctbal")])
    # products reach 1e9: two decimals keep them inside double precision on both engines
    return out.select("o_orderkey", sql_round(F.col("c_acctbal_x_o_totalprice"), 2).alias("c_acctbal_x_o_totalprice"),
                      sql_round(F.col("o_totalprice_per_c_acctbal"), 6).alias("o_totalprice_per_c_acctbal"))


# ---------------------------------------------------------------- scoring

@register("c2_c3_align_features", """
SELECT o_orderkey, c_acctbal, 0 AS c_missing_feature, c_nationkey FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey""")
def c2_c3_align_features(spark, sf):
    d = _orders_features(spark, sf).drop("split")
    kept, ids = C.drop_for_scoring(d, "o_totalprice", leakage=["o_orderstatus"], id_columns=["o_orderkey"])
    return C.align_features(kept, ["o_orderkey", "c_acctbal", "c_missing_feature", "c_nationkey"])


@register("c4_encode_like_training", """
SELECT o_orderkey, coalesce(o_orderpriority = '2-HIGH', false) AS "o_orderpriority_2-HIGH",
  coalesce(o_orderpriority = '3-MEDIUM', false) AS "o_orderpriority_3-MEDIUM",
  coalesce(o_orderpriority = '4-NOT SPECIFIED', false) AS "o_orderpriority_4-NOT SPECIFIED",
  coalesce(o_orderpriority = '5-LOW', false) AS "o_orderpriority_5-LOW"
FROM orders WHERE o_orderkey % 5 = 4""")
def c4_encode_like_training(spark, sf):
    """Indicators of all values that the training part holds."""
    from quarry.operators import saved
    o = mod_split(read_table(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "o_orderpriority", "split")
    train, test = o.where(F.col("split") == "train").drop("split"), o.where(F.col("split") == "test").drop("split")
    layout, codes = saved.fit_layout(train, None, id_columns=["o_orderkey"], encode=["o_orderpriority"])
    return saved.apply_layout(test, layout, codes, keep=["o_orderkey"])


@register("c4_codes_like_training", """
WITH v AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1.0 AS code FROM (
  SELECT DISTINCT c_name FROM customer WHERE c_custkey % 5 <> 4))
SELECT c.c_custkey, CAST(code AS DOUBLE) AS c_name FROM customer c LEFT JOIN v USING (c_name)""")
def c4_codes_like_training(spark, sf):
    """A column of too many values for indicators: codes frozen on the training part."""
    from quarry.operators import saved
    c = read_table(spark, sf, "customer").select("c_custkey", "c_name")
    layout, codes = saved.fit_layout(c.where(F.col("c_custkey") % 5 != 4), None, id_columns=["c_custkey"], encode=["c_name"])
    return saved.apply_layout(c, layout, codes, keep=["c_custkey"])


@register("c6_c7_c8_decode_layout", """
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS o_orderstatus,
  CAST(o_orderkey % 2 AS INTEGER) AS is_even FROM orders""")
def c6_c7_c8_decode_layout(spark, sf):
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 3).cast("double").alias("p_status"),
        (F.col("o_orderkey") % 2).cast("double").alias("p_even"))
    dec = C.decode_labels(o, "p_status", ["F", "O", "P"])
    dec = C.whole_number_predictions(dec, "p_even")
    return C.layout(dec.withColumnRenamed("o_orderkey", "id"), "id", ["o_orderstatus", "is_even"],
                    predicted=["p_status", "p_even"])


@register("c5_c10_prediction_summary")
def c5_c10_prediction_summary(spark, sf):
    pred = _fit_predict(spark, sf, "ridge")
    summary, _head = C.prediction_summary(pred.withColumnRenamed("o_totalprice", "actual"), "actual",
                                          order_by=["o_orderkey"])
    return summary


@register("c10_summary_of_predictions", """
SELECT count(*) AS rows, round(avg(abs(l_quantity * 1500.0 - l_extendedprice)), 6) AS mae FROM lineitem""")
def c10_summary_of_predictions(spark, sf):
    from quarry.plans import fixtures as X
    summary, _ = C.prediction_summary(X.reg_preds(spark, sf), order_by=["l_orderkey", "l_linenumber"])
    return finish(summary)


@register("c2_c8_score_new_table")
def c2_c8_score_new_table(spark, sf):
    """Train on the training part, save the layout, score the raw test rows end to end."""
    d = _orders_features(spark, sf)
    train, test = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    route = M.Route(M.REGRESSION, "o_totalprice", REG_SPEC, "ridge")
    model = M.build_model(route, train)
    used = [*REG_SPEC.numeric, *REG_SPEC.categorical, *REG_SPEC.datetime]
    meta = {"columns": used, "id_columns": ["o_orderkey"], "leakage": ["split"]}
    return C.score(model, route, test.drop("o_totalprice"), meta)


@register("m19_forecast_ahead")
def m19_forecast_ahead(spark, sf):
    """The week after the last day of the daily revenue, from an unlabelled table of dates."""
    from quarry.plans import fixtures as X
    daily = X.daily_orders(spark, sf).select("day", "revenue")
    future = daily.agg(F.max("day").alias("d")).select(F.explode(F.sequence(
        F.date_add("d", 1), F.date_add("d", 7))).alias("day"))
    return M.forecast_ahead(daily, future, "day", "revenue", lags=(1, 7), family="ridge")


@register("c9_forecast_table")
def c9_forecast_table(spark, sf):
    pred = _fit_predict(spark, sf, "ridge").withColumn("period", F.col("o_orderkey"))
    return C.forecast_table(pred, keep=["o_orderkey", "period"])


# ---------------------------------------------------------------- explanation

def _ridge(spark, sf):
    d = _orders_features(spark, sf)
    route = M.Route(M.REGRESSION, "o_totalprice", REG_SPEC, "ridge")
    return M.build_model(route, d.where(F.col("split") == "train")), d.where(F.col("split") == "test")


@register("x1_importances")
def x1_importances(spark, sf):
    model, test = _ridge(spark, sf)
    return XP.importances(model, test)


@register("x3_permutation_importance")
def x3_permutation_importance(spark, sf):
    from quarry.operators.evaluation import regression_metrics
    model, test = _ridge(spark, sf)

    def rmse(pred):
        return regression_metrics(pred.select(F.col("o_totalprice").alias("actual"),
                                              F.col("prediction").alias("predicted"))).first()["rmse"]
    return XP.permutation_importance(model, test, ["c_acctbal", "c_nationkey"], "o_orderkey", rmse)


@register("x4_linear_shapley")
def x4_linear_shapley(spark, sf):
    model, test = _ridge(spark, sf)
    return XP.linear_shapley(model, test)


@register("x4_linear_contributions", """
WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem)
SELECT 'l_quantity' AS feature, round(avg(abs(2.5 * (l_quantity - q))), 6) AS mean_abs_shap FROM lineitem, m
UNION ALL SELECT 'l_discount', round(avg(abs(-40.0 * (l_discount - d))), 6) FROM lineitem, m
UNION ALL SELECT 'l_tax', round(avg(abs(7.0 * (l_tax - t))), 6) FROM lineitem, m""")
def x4_linear_contributions(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return finish(XP.linear_contributions(li, {"l_quantity": 2.5, "l_discount": -40.0, "l_tax": 7.0}))


@register("x5_partial_dependence")
def x5_partial_dependence(spark, sf):
    model, test = _ridge(spark, sf)
    return XP.partial_dependence(model, test, points=20)


@register("x6_factorize_first_appearance", """
WITH o AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos FROM orders),
f AS (SELECT o_orderpriority, min(pos) AS first FROM o GROUP BY 1),
c AS (SELECT o_orderpriority, row_number() OVER (ORDER BY first) - 1 AS code FROM f)
SELECT o.o_orderkey, c.code AS o_orderpriority FROM o JOIN c ON o.o_orderpriority = c.o_orderpriority""")
def x6_factorize_first_appearance(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return XP.factorize(o, "o_orderpriority", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_orderpriority")


@register("k2_candidate_leaderboard")
def k2_candidate_leaderboard(spark, sf):
    d = _orders_features(spark, sf)
    _m, _r, log = M.sweep(d.where(F.col("split") == "train"), d.where(F.col("split") == "test"), M.REGRESSION,
                          "o_totalprice", REG_SPEC, "rmse", parallel=4)
    return M.candidate_leaderboard(log, "rmse", 20)


@register("m19_forecast_route")
def m19_forecast_route(spark, sf):
    from quarry.plans import fixtures as X
    d = X.daily_orders(spark, sf).select("day", "revenue")
    return M.forecast(d, "day", "revenue", family="gbt")


@register("m19_trend_forecast")
def m19_trend_forecast(spark, sf):
    """Four weeks of daily revenue ahead from a lasso over hinges and seasons."""
    from quarry.operators.timeseries import forecast_trend
    from quarry.plans import fixtures as X
    return forecast_trend(X.daily_orders(spark, sf), "day", "revenue", 28)


@register("m19_known_trend", """
WITH d AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders),
f AS (SELECT CAST(unnest(generate_series(b + 1, b + 60, INTERVAL 1 DAY)) AS DATE) AS day, a FROM d)
SELECT day, round(100 + 0.5 * (day - a) + 4 * sin(2 * pi() * (day - a) / 7), 4) AS predicted FROM f""")
def m19_known_trend(spark, sf):
    """A series with a line and a weekly wave on the order dates: 60 days ahead are met exactly."""
    from quarry.operators.timeseries import forecast_trend
    from quarry.plans import fixtures as X
    days = X.daily_orders(spark, sf).select("day")
    t = F.datediff("day", F.lit(days.agg(F.min("day").alias("d")).first()["d"]))
    series = days.withColumn("y", F.lit(100.0) + F.lit(0.5) * t + F.lit(4.0) * F.sin(F.lit(2 * 3.141592653589793 / 7) * t))
    got = forecast_trend(series, "day", "y", 60, change_points=0, seasons={"week": (7.0, 1)}, penalty=0.0)
    return got.withColumn("predicted", sql_round(F.col("predicted"), 4))
