"""Queries: experiment-log analytics (W1-W3, W7-W9, W11, K1, K4-K6, L2-L10,
J6-J7, P25, E8, E10, F10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import explog as L
from quarry.plans import fixtures as X
from quarry.plans.q_clean import _family_sql
from quarry.plans.registry import finish, register

NUM_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
ORDER = ["ts", "event_id"]

REASON_SQL = S.classify_sql("error", S.FAILURE_RULES, S.FAILURE_DEFAULT)

BEST_SQL = """s AS (SELECT * FROM log WHERE status <> 'crash'),
kb AS (SELECT run_id, num, model, metric_val,
  row_number() OVER (PARTITION BY run_id ORDER BY metric_val, num) AS r FROM s WHERE status = 'keep'),
ab AS (SELECT run_id, num, model, metric_val, row_number() OVER (PARTITION BY run_id ORDER BY metric_val, num) AS r FROM s),
best AS (SELECT ab.run_id, CASE WHEN kb.num IS NOT NULL THEN kb.num ELSE ab.num END AS num,
  CASE WHEN kb.num IS NOT NULL THEN kb.model ELSE ab.model END AS model,
  CASE WHEN kb.num IS NOT NULL THEN kb.metric_val ELSE ab.metric_val END AS metric_val,
  CASE WHEN kb.num IS NOT NULL THEN 'keep' ELSE 'fallback' END AS source
  FROM ab LEFT JOIN kb ON ab.run_id = kb.run_id AND kb.r = 1 WHERE ab.r = 1)"""

DECISION_SQL = """x AS (SELECT *, CASE WHEN status <> 'crash' THEN metric_val END AS sv FROM log),
p AS (SELECT *, min(sv) OVER (PARTITION BY run_id ORDER BY num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  AS prev_best FROM x),
d AS (SELECT *, CASE WHEN status = 'crash' THEN 'crash' WHEN prev_best IS NULL OR metric_val < prev_best
  THEN 'keep' ELSE 'discard' END AS decision,
  status <> 'crash' AND (prev_best IS NULL OR metric_val < prev_best) AS is_new_best FROM p)"""

FAILS_SQL = f"""fc AS (SELECT run_id, {REASON_SQL} AS reason, count(*) AS n FROM log WHERE status = 'crash' GROUP BY 1, 2),
fails AS (SELECT run_id, reason, n, CAST(row_number() OVER (PARTITION BY run_id ORDER BY n DESC, reason) AS BIGINT)
  AS rank FROM fc QUALIFY rank <= 2)"""


@register("w1_running_best", f"""
WITH {X.EXPLOG} SELECT run_id, num, metric_val, min(metric_val) OVER (PARTITION BY run_id ORDER BY num
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_best FROM log WHERE status <> 'crash'""")
def w1_running_best(spark, sf):
    return L.running_best(X.explog(spark, sf)).select("run_id", "num", "metric_val", "running_best")


@register("w2_best_index", f"""
WITH {X.EXPLOG}, s AS (SELECT * FROM log WHERE status <> 'crash'),
b AS (SELECT run_id, min(metric_val) AS best_val FROM s GROUP BY run_id)
SELECT b.run_id, min(s.num) AS best_num, b.best_val FROM b JOIN s ON s.run_id = b.run_id AND s.metric_val = b.best_val
GROUP BY b.run_id, b.best_val""")
def w2_best_index(spark, sf):
    return L.best_index(X.explog(spark, sf))


@register("w3_hits", f"""
WITH {X.EXPLOG}, k AS (SELECT run_id, num, metric_val,
  lag(metric_val) OVER (PARTITION BY run_id ORDER BY num) AS prev_val FROM log WHERE status = 'keep')
SELECT run_id, num, metric_val, prev_val, round(prev_val - metric_val, 6) AS delta FROM k WHERE prev_val IS NOT NULL""")
def w3_hits(spark, sf):
    return finish(L.hits(X.explog(spark, sf)))


@register("k1_leaderboard", f"""
WITH {X.EXPLOG} SELECT model, min(coalesce(test_rmse, metric_val)) AS best_value, count(*) AS n
FROM log WHERE status <> 'crash' GROUP BY model""")
def k1_leaderboard(spark, sf):
    return L.leaderboard(X.explog(spark, sf))


@register("k5_best_experiment", f"WITH {X.EXPLOG}, {BEST_SQL} SELECT * FROM best")
def k5_best_experiment(spark, sf):
    return L.best_experiment(X.explog(spark, sf))


@register("k6_top_failures", f"WITH {X.EXPLOG}, {FAILS_SQL} SELECT * FROM fails")
def k6_top_failures(spark, sf):
    return L.top_failures(X.explog(spark, sf))


@register("l6_keep_discard", f"""
WITH {X.EXPLOG}, {DECISION_SQL} SELECT run_id, num, prev_best, decision FROM d""")
def l6_keep_discard(spark, sf):
    return L.decisions(X.explog(spark, sf)).select("run_id", "num", "prev_best", "decision")


@register("w7_stagnation", f"""
WITH {X.EXPLOG}, {DECISION_SQL},
g AS (SELECT *, sum(CAST(is_new_best AS INTEGER)) OVER (PARTITION BY run_id ORDER BY num
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM d),
c AS (SELECT *, sum(CASE WHEN status <> 'crash' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, grp ORDER BY num
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs FROM g)
SELECT run_id, num, CAST(CASE WHEN grp > 0 THEN cs - 1 ELSE cs END AS BIGINT) AS no_improve FROM c""")
def w7_stagnation(spark, sf):
    return L.stagnation(X.explog(spark, sf)).select("run_id", "num", "no_improve")


@register("w8_family_saturation", f"""
WITH {X.EXPLOG}, s AS (SELECT run_id, num, {_family_sql("model || ' ' || description")} AS family,
  row_number() OVER (PARTITION BY run_id ORDER BY num DESC) AS r FROM log WHERE status <> 'crash')
SELECT run_id, family, count(*) AS n, count(*) >= 3 AS saturated FROM s WHERE r <= 8 GROUP BY 1, 2""")
def w8_family_saturation(spark, sf):
    log = X.explog(spark, sf)
    return L.family_saturation(log, text=F.concat_ws(" ", "model", "description"))


@register("w9_crash_streaks", f"""
WITH {X.EXPLOG}, g AS (SELECT *, sum(CASE WHEN status <> 'crash' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id
  ORDER BY num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM log)
SELECT run_id, min(num) AS start_num, max(num) AS end_num, count(*) AS length FROM g WHERE status = 'crash'
GROUP BY run_id, isl HAVING count(*) >= 3""")
def w9_crash_streaks(spark, sf):
    return L.crash_streaks(X.explog(spark, sf))


@register("l9_improvement_pct", f"""
WITH {X.EXPLOG}, {DECISION_SQL}
SELECT run_id, num, metric_val, prev_best, round((metric_val - prev_best) / abs(prev_best) * 100.0, 6) AS pct
FROM d WHERE is_new_best AND prev_best IS NOT NULL AND prev_best <> 0 AND prev_best <> metric_val""")
def l9_improvement_pct(spark, sf):
    return finish(L.improvement_pct(X.explog(spark, sf)))


@register("l8_train_vs_test", f"""
WITH {X.EXPLOG} SELECT run_id, num, model, train_rmse AS train, test_rmse AS test,
  round(abs(train_rmse - test_rmse) / greatest(abs(test_rmse), 1e-10), 6) AS gap_ratio,
  abs(train_rmse - test_rmse) / greatest(abs(test_rmse), 1e-10) > 0.3 AS overfit FROM log WHERE status <> 'crash'""")
def l8_train_vs_test(spark, sf):
    return finish(L.train_vs_test(X.explog(spark, sf)))


@register("l7_e10_f10_diagnostics", f"""
WITH {X.EXPLOG}, {BEST_SQL}, {FAILS_SQL},
counts AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status <> 'crash') AS success_count
  FROM log GROUP BY 1),
fagg AS (SELECT run_id, string_agg(reason || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY rank) AS top_failures
  FROM fails GROUP BY 1),
j AS (SELECT c.run_id, c.total, c.success_count, b.metric_val, b.num, CAST(5000.0 AS DOUBLE) AS threshold,
  coalesce(b.metric_val <= 5000.0, false) AS threshold_met, f.top_failures,
  CAST(greatest(0, least(100, 30 + least(25, CAST(round_even(c.success_count / c.total * 25, 0) AS INTEGER))
    + CASE WHEN b.metric_val IS NOT NULL THEN 15 ELSE 0 END
    + CASE WHEN coalesce(b.metric_val <= 5000.0, false) THEN 15 ELSE 0 END)) AS INTEGER) AS score
  FROM counts c LEFT JOIN best b ON c.run_id = b.run_id LEFT JOIN fagg f ON c.run_id = f.run_id)
SELECT run_id, total, success_count, total - success_count AS failure_count,
  round(success_count / total, 6) AS success_rate, metric_val AS best_metric_value, num AS best_num, threshold,
  threshold_met, coalesce(top_failures, 'No dominant failure mode') AS top_failures, score AS readiness_score,
  CASE WHEN score >= 90 THEN 'A+' WHEN score >= 80 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 60 THEN 'C'
  ELSE 'D' END AS grade FROM j""")
def l7_e10_f10_diagnostics(spark, sf):
    return finish(L.diagnostics(X.explog(spark, sf), "rmse"))


@register("l7_r2_bonus", f"""
WITH {X.EXPLOG}, {BEST_SQL},
c AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status <> 'crash') AS ok FROM log GROUP BY 1),
j AS (SELECT c.run_id, c.total, c.ok, b.metric_val, (l.event_id % 100) / 100.0 AS r2 FROM c
  LEFT JOIN best b ON c.run_id = b.run_id LEFT JOIN log l ON b.run_id = l.run_id AND b.num = l.num)
SELECT run_id, CAST(greatest(0, least(100, 30 + least(25, CAST(round_even(ok / total * 25, 0) AS INTEGER))
  + CASE WHEN metric_val IS NOT NULL THEN 15 + CASE WHEN r2 > 0.85 THEN 5 ELSE 0 END + CASE WHEN r2 > 0.95 THEN 5 ELSE 0 END
    ELSE 0 END + CASE WHEN metric_val <= 5000.0 THEN 15 ELSE 0 END + 10)) AS INTEGER) AS readiness_score FROM j""")
def l7_r2_bonus(spark, sf):
    log = X.explog(spark, sf).withColumn("r2", (F.col("event_id") % 100) / 100.0)
    return L.diagnostics(log, "rmse", has_artifact=True).select("run_id", "readiness_score")


@register("e8_metric_table", f"""
WITH {X.EXPLOG}, {BEST_SQL}
SELECT l.run_id, l.num, 'rmse' AS metric, round(l.train_rmse, 6) AS train, round(l.test_rmse, 6) AS test
FROM log l JOIN best b ON l.run_id = b.run_id AND l.num = b.num""")
def e8_metric_table(spark, sf):
    log = X.explog(spark, sf)
    return finish(L.metric_table(log, L.best_experiment(log)))


# ---------------------------------------------------------------- five-column log

CLEAN_SQL = f"""c AS (SELECT commit, CASE WHEN regexp_full_match(val_bpb_text, '{NUM_RE}')
  THEN TRY_CAST(trim(val_bpb_text) AS DOUBLE) END AS val_bpb, memory_gb, upper(trim(status_text)) AS status,
  description, ts, event_id FROM res)"""


@register("l2_clean_results", f"WITH {X.RESULTS}, {CLEAN_SQL} SELECT * FROM c")
def l2_clean_results(spark, sf):
    return L.clean_results(X.results_log(spark, sf))


@register("l3_outcome_counts", f"""
WITH {X.RESULTS}, {CLEAN_SQL}
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'KEEP') AS n_keep,
  count(*) FILTER (WHERE status = 'DISCARD') AS n_discard, count(*) FILTER (WHERE status = 'CRASH') AS n_crash,
  round(count(*) FILTER (WHERE status = 'KEEP') / (count(*) FILTER (WHERE status IN ('KEEP', 'DISCARD'))), 6)
  AS keep_rate FROM c""")
def l3_outcome_counts(spark, sf):
    return finish(L.outcome_counts(L.clean_results(X.results_log(spark, sf))))


@register("l4_near_baseline", f"""
WITH {X.RESULTS}, {CLEAN_SQL},
v AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS vidx FROM c WHERE status <> 'CRASH')
SELECT vidx, val_bpb, status FROM v WHERE val_bpb <= (SELECT val_bpb FROM v WHERE vidx = 0) + 0.0005""")
def l4_near_baseline(spark, sf):
    return L.near_baseline(L.clean_results(X.results_log(spark, sf)), ORDER)


@register("l5_results_summary", f"""
WITH {X.RESULTS}, {CLEAN_SQL},
b AS (SELECT val_bpb AS baseline FROM c ORDER BY ts, event_id LIMIT 1),
k AS (SELECT val_bpb AS best, description AS best_description FROM c WHERE status = 'KEEP'
  ORDER BY val_bpb, ts, event_id LIMIT 1)
SELECT baseline, best, round(baseline - best, 6) AS improvement,
  round((baseline - best) / baseline * 100.0, 6) AS improvement_pct, best_description FROM b, k""")
def l5_results_summary(spark, sf):
    return finish(L.results_summary(L.clean_results(X.results_log(spark, sf)), ORDER))


@register("l10_kept_progress", f"""
WITH {X.RESULTS}, {CLEAN_SQL},
p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM c),
k AS (SELECT pos, val_bpb, description, min(val_bpb) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  AS running_min, lag(val_bpb) OVER (ORDER BY pos) - val_bpb AS delta FROM p WHERE status = 'KEEP')
SELECT pos, val_bpb, description, running_min, round(delta, 6) AS delta,
  round(sum(delta) OVER (), 6) AS total_improvement FROM k""")
def l10_kept_progress(spark, sf):
    return finish(L.kept_progress(L.clean_results(X.results_log(spark, sf)), ORDER))


# ---------------------------------------------------------------- runs table

UPDATES_SQL = """upd AS (SELECT id, user_id, 'done' AS status, started + 5 AS started, finished + 1000 AS finished,
  total_experiments + 1 AS total_experiments, token_input, token_output, o_orderpriority FROM runs
  WHERE CAST(regexp_extract(id, '[0-9]+') AS BIGINT) % 3 = 0)"""


def _updates(runs):
    key = F.regexp_extract("id", "[0-9]+", 0).cast("long")
    return runs.where(key % 3 == 0).select(
        "id", "user_id", F.lit("done").alias("status"), (F.col("started") + 5).alias("started"),
        (F.col("finished") + 1000).alias("finished"), (F.col("total_experiments") + 1).alias("total_experiments"),
        "token_input", "token_output", "o_orderpriority")


@register("w11_upsert_runs", f"""
WITH {X.RUNS}, {UPDATES_SQL},
u AS (SELECT *, 0 AS src FROM runs UNION ALL SELECT *, 1 FROM upd),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY finished DESC, src DESC) AS rn,
  first_value(started) OVER (PARTITION BY id ORDER BY src) AS first_started FROM u)
SELECT id, user_id, status, first_started AS started, finished, total_experiments, token_input, token_output,
  o_orderpriority FROM r WHERE rn = 1""")
def w11_upsert_runs(spark, sf):
    runs = X.runs(spark, sf)
    return L.upsert_runs(runs, _updates(runs))


@register("j6_union_history", f"""
WITH {X.RUNS}, {UPDATES_SQL}
SELECT * FROM upd UNION ALL SELECT * FROM runs WHERE id NOT IN (SELECT id FROM upd)""")
def j6_union_history(spark, sf):
    from quarry.operators.joins import union_history
    runs = X.runs(spark, sf)
    return union_history(runs, _updates(runs))


@register("j7_unclaimed_guests", f"""
WITH {X.RUNS} SELECT * FROM runs WHERE user_id IS NULL AND id LIKE 'guest-%'
  AND id NOT IN (SELECT id FROM runs WHERE CAST(regexp_extract(id, '[0-9]+') AS BIGINT) % 4 = 0)
ORDER BY started DESC, id LIMIT 20""")
def j7_unclaimed_guests(spark, sf):
    from quarry.operators.joins import unclaimed_guest_runs
    runs = X.runs(spark, sf)
    listed = runs.where(F.regexp_extract("id", "[0-9]+", 0).cast("long") % 4 == 0)
    return unclaimed_guest_runs(runs, listed, 20)


@register("k4_list_runs", f"""
WITH {X.RUNS} SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY started DESC, id) AS BIGINT) AS rank
FROM runs WHERE user_id IS NOT NULL QUALIFY rank <= 100""")
def k4_list_runs(spark, sf):
    return L.list_runs(X.runs(spark, sf), 100)


@register("k4_list_guest_runs", f"""
WITH {X.RUNS}, g AS (SELECT *, '10.0.0.' || CAST(total_experiments AS VARCHAR) AS guest_ip FROM runs WHERE total_experiments <> 3)
SELECT *, CAST(row_number() OVER (PARTITION BY guest_ip ORDER BY started DESC, id) AS BIGINT) AS rank
FROM g WHERE user_id IS NULL AND id LIKE 'guest-%' QUALIFY rank <= 50""")
def k4_list_guest_runs(spark, sf):
    n = F.col("total_experiments")
    runs = X.runs(spark, sf).withColumn("guest_ip", F.when(n != 3, F.concat(F.lit("10.0.0."), n.cast("string"))))
    return L.list_guest_runs(runs)


@register("p25_run_stats_best_model", f"""
WITH {X.RUNS} SELECT count(*) AS runs, count(*) FILTER (WHERE status = 'done' AND total_experiments > 4) AS successful,
  CAST(coalesce(sum(total_experiments), 0) AS BIGINT) AS experiments,
  CAST(coalesce(sum(token_input + token_output), 0) AS BIGINT) AS tokens FROM runs""")
def p25_run_stats_best_model(spark, sf):
    return L.run_stats(X.runs(spark, sf).withColumn("best_model", F.when(F.col("total_experiments") > 4, "m")))


@register("p25_run_stats", f"""
WITH {X.RUNS} SELECT count(*) AS runs, count(*) FILTER (WHERE status = 'done') AS successful,
  CAST(coalesce(sum(total_experiments), 0) AS BIGINT) AS experiments,
  CAST(coalesce(sum(token_input + token_output), 0) AS BIGINT) AS tokens FROM runs""")
def p25_run_stats(spark, sf):
    return L.run_stats(X.runs(spark, sf))


@register("l1_read_log_tsv", f"""
WITH {X.EXPLOG} SELECT num AS experiment, model, 'rmse' AS metric, metric_val AS metric_value, train_rmse, test_rmse,
  CAST(NULL AS DOUBLE) AS train_r2, CAST(NULL AS DOUBLE) AS test_r2, test_rmse AS rmse, CAST(NULL AS DOUBLE) AS mape,
  CAST(NULL AS DOUBLE) AS mae, CAST(NULL AS DOUBLE) AS r2, CAST(NULL AS DOUBLE) AS nse, status, description
FROM log""")
def l1_read_log_tsv(spark, sf):
    from quarry.sources.files import write_table
    from quarry.streaming.leaderboard import scratch
    log = X.explog(spark, sf)
    cols = {"experiment": F.col("num"), "model": F.col("model"), "metric": F.lit("rmse"),
            "metric_value": F.col("metric_val"), "train_rmse": F.col("train_rmse"), "test_rmse": F.col("test_rmse"),
            "train_r2": F.lit(None).cast("double"), "test_r2": F.lit(None).cast("double"), "rmse": F.col("test_rmse"),
            "mape": F.lit(None).cast("double"), "mae": F.lit(None).cast("double"), "r2": F.lit(None).cast("double"),
            "nse": F.lit(None).cast("double"), "status": F.col("status"), "description": F.col("description")}
    path = scratch(spark, "l1") + "/results.tsv"
    write_table(log.select(*[c.alias(k) for k, c in cols.items()]), path, fmt="tsv")
    return L.read_log(spark, path)
