"""Experiment-log analytics (W1-W3, W7-W9, W11, K1, K4-K6, L1-L10, J6-J7, P25,
E8, E10).

A log has one row per experiment: ``run_id``, ``num`` (order inside the run),
``model``, ``metric_val``, ``status`` (keep / discard / crash) and optional
``train_<m>``/``test_<m>``, ``error`` columns.  Everything order-dependent is
computed per run with the bucketed primitives of ``ordered``; aggregates use
``min_by``/``max_by`` so no run is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.scalars import failure_reason, grade, model_family, overfit_ratio, to_number
from quarry.operators.ordered import DEFAULT_BUCKET_ROWS, join_null_safe, lag_join, row_index, running
from quarry.operators.stats import top_k_per_group
from quarry.sources.files import delimited_reader, line_facts

# Column names of the two log layouts.
LOG_SCHEMA = T.StructType([
    T.StructField("experiment", T.LongType()), T.StructField("model", T.StringType()),
    T.StructField("metric", T.StringType()), T.StructField("metric_value", T.DoubleType()),
    T.StructField("train_rmse", T.DoubleType()), T.StructField("test_rmse", T.DoubleType()),
    T.StructField("train_r2", T.DoubleType()), T.StructField("test_r2", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()), T.StructField("mape", T.DoubleType()),
    T.StructField("mae", T.DoubleType()), T.StructField("r2", T.DoubleType()),
    T.StructField("nse", T.DoubleType()), T.StructField("status", T.StringType()),
    T.StructField("description", T.StringType())])
"""L1 the 15-column tab-separated log (missing metrics are empty strings)."""

RESULTS_SCHEMA = T.StructType([
    T.StructField("commit", T.StringType()), T.StructField("val_bpb", T.DoubleType()),
    T.StructField("memory_gb", T.DoubleType()), T.StructField("status", T.StringType()),
    T.StructField("description", T.StringType())])
"""L1 the 5-column variant."""

# Good-enough thresholds per metric.
GOOD_ENOUGH = {"r2": 0.90, "auc": 0.92, "f1": 0.88, "accuracy": 0.90, "mape": 0.10, "rmse": 5000.0,
               "mae": 3000.0, "nse": 0.85}
LOWER_IS_BETTER = {"rmse", "mae", "mape", "mse", "logloss", "smape", "wape", "val_bpb"}


def read_log(spark, path: str, variant: str = "full") -> DataFrame:
    """L1 read a tab-separated log; empty metric fields become null.  Fields are quoted as
    ``sources.files.write_table`` quotes them (quotes doubled, tabs and line breaks inside)."""
    schema = LOG_SCHEMA if variant == "full" else RESULTS_SCHEMA
    raw = delimited_reader(spark, "\t", line_facts(spark, path)[1]).schema(
        T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])).csv(path)
    return raw.select(*[(to_number(F.col(f.name)) if isinstance(f.dataType, T.DoubleType)
                         else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in schema.fields])


def _better(a: Column, b: Column, lower: bool) -> Column:
    return a < b if lower else a > b


def _best_agg(c: Column, lower: bool) -> Column:
    return F.min(c) if lower else F.max(c)


def _success(log: DataFrame) -> DataFrame:
    return log.where(F.col("status") != "crash")


def running_best(log: DataFrame, lower: bool = True, run: Sequence[str] = ("run_id",),
                 bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """W1 cumulative best metric per run over successful experiments."""
    return running(_success(log), list(run), ["num"],
                   [("running_best", "min" if lower else "max", "metric_val")], bucket_rows=bucket_rows)


def best_index(log: DataFrame, lower: bool = True, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """W2 the first experiment reaching the run's best value."""
    v = F.col("metric_val")
    key = F.struct((v if lower else -v).alias("v"), F.col("num").alias("n"))
    return _success(log).groupBy(*run).agg(F.min_by("num", key).alias("best_num"),
                                           _best_agg(v, lower).alias("best_val"))


def hits(log: DataFrame, lower: bool = True, run: Sequence[str] = ("run_id",), value: str = "metric_val",
         order: str = "num") -> DataFrame:
    """W3 each kept experiment's gain over the previous kept one (the first
    kept experiment, the baseline, has none): (run..., num, value, prev, delta)."""
    kept = log.where(F.col("status") == "keep").select(*run, order, value)
    ix = row_index(kept, [order], list(run), name="_k")
    j = lag_join(ix, list(run), "_k", value, 1, "prev_val").where(F.col("prev_val").isNotNull())
    d = (F.col("prev_val") - F.col(value)) if lower else (F.col(value) - F.col("prev_val"))
    return j.withColumn("delta", d).drop("_k")


def leaderboard(log: DataFrame, lower: bool = True, test_col: str | None = "test_rmse") -> DataFrame:
    """K1 best value per model (``test_<metric>`` when present, else the
    primary metric) over successful experiments, best first."""
    v = F.coalesce(F.col(test_col), F.col("metric_val")) if test_col else F.col("metric_val")
    g = _success(log).groupBy("model").agg(_best_agg(v, lower).alias("best_value"),
                                           F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.asc("best_value") if lower else F.desc("best_value"), "model")


def best_experiment(log: DataFrame, lower: bool = True, run: Sequence[str] = ("run_id",),
                    extra: Sequence[str] = ()) -> DataFrame:
    """K5 best kept experiment per run; runs without a keep fall back to their
    best successful one: (run..., num, model, metric_val, source, ``extra`` columns)."""
    v = F.col("metric_val")
    key = F.struct((v if lower else -v).alias("v"), F.col("num").alias("n"))
    rec = F.struct("num", "model", "metric_val", *extra)
    s = _success(log)
    g = s.groupBy(*run).agg(F.min_by(F.when(F.col("status") == "keep", rec),
                                     F.when(F.col("status") == "keep", key)).alias("k"),
                            F.min_by(rec, key).alias("a"))
    pick = F.coalesce("k", "a")
    return g.select(*run, pick["num"].alias("num"), pick["model"].alias("model"),
                    pick["metric_val"].alias("metric_val"),
                    F.when(F.col("k").isNotNull(), "keep").otherwise("fallback").alias("source"),
                    *[pick[c].alias(c) for c in extra])


def top_failures(log: DataFrame, k: int = 2, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """K6 the k most frequent failure reasons per run (reason text ties by name)."""
    c = (log.where(F.col("status") == "crash").withColumn("reason", failure_reason(F.col("error")))
         .groupBy(*run, "reason").agg(F.count(F.lit(1)).alias("n")))
    return top_k_per_group(c, list(run), [F.desc("n"), F.asc("reason")], k, rank_name="rank")


def decisions(log: DataFrame, lower: bool = True, run: Sequence[str] = ("run_id",),
              bucket_rows: int = DEFAULT_BUCKET_ROWS, keep_index: bool = False,
              more: Sequence[tuple] = ()) -> DataFrame:
    """L6 keep / discard / crash from the metrics: keep the first success and
    every strict improvement on the best so far, discard the rest.  With
    ``keep_index`` the run position ``_idx`` stays for later passes; ``more`` running
    columns are computed in the same pass."""
    succ = F.col("status") != "crash"
    x = log.withColumn("_sv", F.when(succ, F.col("metric_val")))
    r = running(x, list(run), ["num"], [("prev_best", "min" if lower else "max", "_sv", False), *more],
                bucket_rows=bucket_rows, keep_index=keep_index)
    better = F.col("prev_best").isNull() | _better(F.col("metric_val"), F.col("prev_best"), lower)
    return r.withColumn("decision", F.when(~succ, "crash").when(better, "keep").otherwise("discard")) \
        .withColumn("is_new_best", succ & better).drop("_sv")


def stagnation(log: DataFrame, lower: bool = True, run: Sequence[str] = ("run_id",),
               bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """W7 rounds without improvement after each experiment: successful
    experiments since the last new best (crashes do not count; a new best
    resets to 0)."""
    # successes so far never fall, so their number at the last new best is the largest
    # seen at one: two running passes over one run position
    d = decisions(log.withColumn("_succ", (F.col("status") != "crash").cast("long")), lower, run, bucket_rows,
                  keep_index=True, more=[("_cs", "sum", "_succ")])
    g = running(d.withColumn("_at", F.when(F.col("is_new_best"), F.col("_cs"))), list(run), ["num"],
                [("_best_cs", "max", "_at")], bucket_rows=bucket_rows, idx="_idx")
    return g.withColumn("no_improve", F.col("_cs") - F.coalesce("_best_cs", F.lit(0))).drop(
        "_succ", "_cs", "_at", "_best_cs", "_idx")


def crash_streaks(log: DataFrame, min_len: int = 3, run: Sequence[str] = ("run_id",),
                  bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """W9 runs of consecutive crashes of length >= min_len (gaps and islands):
    (run..., start_num, end_num, length)."""
    x = log.withColumn("_ok", (F.col("status") != "crash").cast("long"))
    g = running(x, list(run), ["num"], [("_isl", "sum", "_ok")], bucket_rows=bucket_rows)
    isl = g.where(F.col("status") == "crash").groupBy(*run, "_isl").agg(
        F.min("num").alias("start_num"), F.max("num").alias("end_num"), F.count(F.lit(1)).alias("length"))
    return isl.where(F.col("length") >= min_len).drop("_isl")


def family_saturation(log: DataFrame, last: int = 8, threshold: int = 3, run: Sequence[str] = ("run_id",),
                      text: Column | None = None) -> DataFrame:
    """W8 model families among the last ``last`` successful experiments per
    run; ``saturated`` when a family appears >= threshold times."""
    s = _success(log).withColumn("family", model_family(text if text is not None else F.col("model")))
    ix = row_index(s.select(*run, "num", "family"), ["num"], list(run), name="_i")
    mx = ix.groupBy(*run).agg(F.max("_i").alias("_mx"))
    tail = join_null_safe(ix, mx, list(run)).where(F.col("_i") > F.col("_mx") - last)
    return tail.groupBy(*run, "family").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "saturated", F.col("n") >= threshold)


def improvement_pct(log: DataFrame, lower: bool = True, run: Sequence[str] = ("run_id",),
                    bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """L9 percent change of each new best against the previous best."""
    d = decisions(log, lower, run, bucket_rows)
    pct = (F.col("metric_val") - F.col("prev_best")) / F.abs(F.col("prev_best")) * 100.0
    return d.where(F.col("is_new_best") & F.col("prev_best").isNotNull() & (F.col("prev_best") != 0)
                   & (F.col("prev_best") != F.col("metric_val"))).select(*run, "num", "metric_val", "prev_best",
                                                                          pct.alias("pct"))


def train_vs_test(log: DataFrame, train: str = "train_rmse", test: str = "test_rmse",
                  limit: float = 0.3) -> DataFrame:
    """L8 train and test metric per successful experiment with the overfit flag."""
    g = overfit_ratio(train, test)
    return _success(log).select("run_id", "num", "model", F.col(train).alias("train"), F.col(test).alias("test"),
                                g.alias("gap_ratio"), (g > limit).alias("overfit"))


def good_enough(best: DataFrame, metric: str, user_threshold: float | None = None) -> DataFrame:
    """E10 threshold test of each run's best value: the stricter of the
    built-in and the user threshold, compared by direction."""
    lower = metric in LOWER_IS_BETTER
    t = GOOD_ENOUGH.get(metric)
    if user_threshold is not None:
        t = user_threshold if t is None else (min(t, user_threshold) if lower else max(t, user_threshold))
    met = (F.col("metric_val") <= F.lit(t)) if lower else (F.col("metric_val") >= F.lit(t))
    return best.withColumns({"threshold": F.lit(t).cast("double"),
                             "threshold_met": F.coalesce(met, F.lit(False)) if t is not None else F.lit(False)})


def diagnostics(log: DataFrame, metric: str = "rmse", has_artifact: bool = False,
                run: Sequence[str] = ("run_id",)) -> DataFrame:
    """L7 per-run diagnostics: counts, success rate, best metric, threshold
    test, failure modes, readiness score 30 + round(rate x 25) + 15 (best) +
    5/5 (r2 > .85/.95) + 15 (threshold) + 10 (artifact), clipped, and grade.  The r2
    is the best experiment's, where the log has an ``r2`` column."""
    lower = metric in LOWER_IS_BETTER
    counts = log.groupBy(*run).agg(F.count(F.lit(1)).alias("total"),
                                   F.count(F.when(F.col("status") != "crash", 1)).alias("success_count"))
    best = good_enough(best_experiment(log, lower, run, [c for c in ("r2",) if c in log.columns]), metric)
    fails = top_failures(log, 2, run).groupBy(*run).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "reason", "n"))),
        lambda s: F.concat(s["reason"], F.lit(" ("), s["n"].cast("string"), F.lit(")"))), ", ").alias("top_failures"))
    j = join_null_safe(join_null_safe(counts, best, list(run), "left"), fails, list(run), "left")
    rate = F.col("success_count") / F.col("total")
    has_best = F.col("metric_val").isNotNull()
    r2 = F.col("r2") if "r2" in j.columns else F.lit(None).cast("double")
    score = (F.lit(30) + F.least(F.lit(25), F.bround(rate * 25, 0).cast("int"))
             + F.when(has_best, 15).otherwise(0)
             + F.when(has_best & (r2 > 0.85), 5).otherwise(0) + F.when(has_best & (r2 > 0.95), 5).otherwise(0)
             + F.when(F.coalesce("threshold_met", F.lit(False)), 15).otherwise(0)
             + F.lit(10 if has_artifact else 0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), score))
    return j.select(*run, "total", "success_count", (F.col("total") - F.col("success_count")).alias("failure_count"),
                    rate.alias("success_rate"), F.col("metric_val").alias("best_metric_value"),
                    F.col("num").alias("best_num"), "threshold",
                    F.coalesce("threshold_met", F.lit(False)).alias("threshold_met"),
                    F.coalesce("top_failures", F.lit("No dominant failure mode")).alias("top_failures"),
                    score.alias("readiness_score"), grade(score).alias("grade"))


def metric_table(log: DataFrame, nums: DataFrame, metrics: Sequence[str] = ("rmse",),
                 run: Sequence[str] = ("run_id",)) -> DataFrame:
    """E8 (run, metric, train, test) for chosen experiments (e.g. the best)."""
    sel = join_null_safe(log, nums.select(*run, "num"), [*run, "num"])
    items = [F.struct(F.lit(m).alias("metric"), F.col(f"train_{m}").cast("double").alias("train"),
                      F.col(f"test_{m}").cast("double").alias("test")) for m in metrics]
    return sel.select(*run, "num", F.explode(F.array(*items)).alias("s")).select(*run, "num", "s.*")


# ---------------------------------------------------------------- five-column results log

def clean_results(res: DataFrame) -> DataFrame:
    """L2 numeric coercion and trimmed upper-case status."""
    out = res
    if "val_bpb_text" in res.columns:
        out = out.withColumn("val_bpb", to_number(F.col("val_bpb_text"))).drop("val_bpb_text")
    else:
        out = out.withColumn("val_bpb", to_number(F.col("val_bpb")))
    st = "status_text" if "status_text" in res.columns else "status"
    out = out.withColumn("memory_gb", to_number(F.col("memory_gb")))
    return out.withColumn("status", F.upper(F.trim(F.col(st)))).drop(*([st] if st != "status" else []))


def outcome_counts(res: DataFrame) -> DataFrame:
    """L3 outcome counts and keep rate keep / (keep + discard)."""
    s = F.col("status")
    g = res.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(s == "KEEP", 1)).alias("n_keep"),
                F.count(F.when(s == "DISCARD", 1)).alias("n_discard"), F.count(F.when(s == "CRASH", 1)).alias("n_crash"))
    dec = F.col("n_keep") + F.col("n_discard")
    return g.withColumn("keep_rate", F.when(dec > 0, F.col("n_keep") / dec))


def near_baseline(res: DataFrame, order_by: Sequence, margin: float = 0.0005) -> DataFrame:
    """L4 non-crash experiments at or below baseline + margin, where the
    baseline is the first non-crash value; index counts non-crash rows only."""
    valid = res.where(F.col("status") != "CRASH")
    base = valid.agg(F.min_by("val_bpb", F.struct(*order_by)).alias("b")).first()["b"]
    if base is None:
        return valid.limit(0)
    ix = row_index(valid, list(order_by), name="vidx")
    return ix.where(F.col("val_bpb") <= F.lit(base + margin)).select("vidx", "val_bpb", "status")


def results_summary(res: DataFrame, order_by: Sequence) -> DataFrame:
    """L5 baseline (first row), best kept value, improvement, percent and the
    best experiment's description (first on ties)."""
    o = F.struct(*order_by)
    kept = F.col("status") == "KEEP"
    key = F.struct(F.col("val_bpb").alias("v"), o.alias("o"))
    g = res.agg(F.min_by("val_bpb", o).alias("baseline"),
                F.min(F.when(kept, F.col("val_bpb"))).alias("best"),
                F.min_by(F.when(kept, F.col("description")), F.when(kept, key)).alias("best_description"))
    imp = F.col("baseline") - F.col("best")
    return g.select("baseline", "best", imp.alias("improvement"),
                    (imp / F.col("baseline") * 100.0).alias("improvement_pct"), "best_description")


def kept_progress(res: DataFrame, order_by: Sequence, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """L10 kept experiments with their overall index, the running minimum over
    kept rows, the gain over the previous kept row and the total gain."""
    ix = row_index(res, list(order_by), name="pos")
    kept = ix.where(F.col("status") == "KEEP").select("pos", "val_bpb", "description")
    r = running(kept, [], ["pos"], [("running_min", "min", "val_bpb")], bucket_rows=bucket_rows)
    ki = row_index(r, ["pos"], name="_k")
    j = lag_join(ki, [], "_k", "val_bpb", 1, "_prev")
    j = j.withColumn("delta", F.col("_prev") - F.col("val_bpb")).drop("_prev", "_k")
    total = j.agg(F.sum("delta").alias("t")).first()["t"]
    return j.withColumn("total_improvement", F.lit(total).cast("double"))


# ---------------------------------------------------------------- runs table

def upsert_runs(current: DataFrame, updates: DataFrame, key: str = "id", version: str = "finished",
                keep_first: Sequence[str] = ("started",)) -> DataFrame:
    """W11 latest row per id wins (by ``version``, updates win ties), while the
    ``keep_first`` columns keep their first-inserted value.  One aggregation
    with map-side combining, no sort of a whole id."""
    u = current.withColumn("_src", F.lit(0)).unionByName(updates.withColumn("_src", F.lit(1)))
    cols = [c for c in current.columns if c != key]
    latest = F.max_by(F.struct(*cols), F.struct(F.col(version), F.col("_src")))
    firsts = [F.min_by(c, F.struct(F.col("_src"), F.col(version))).alias(f"_first_{c}") for c in keep_first]
    g = u.groupBy(key).agg(latest.alias("_l"), *firsts)
    return g.select(key, *[(F.col(f"_first_{c}") if c in keep_first else F.col(f"_l.{c}")).alias(c) for c in cols])


def list_runs(runs: DataFrame, n: int = 100) -> DataFrame:
    """K4 each owner's runs, newest first, at most n (salted top-n per user)."""
    owned = runs.where(F.col("user_id").isNotNull())
    return top_k_per_group(owned, ["user_id"], [F.desc("started"), F.asc("id")], n, rank_name="rank")


def list_guest_runs(runs: DataFrame, n: int = 50, address: str = "guest_ip") -> DataFrame:
    """K4 guest runs without an owner per address, newest first, at most n."""
    guests = runs.where(F.col("user_id").isNull() & F.col("id").startswith("guest-") & F.col(address).isNotNull())
    return top_k_per_group(guests, [address], [F.desc("started"), F.asc("id")], n, rank_name="rank")


def run_stats(runs: DataFrame) -> DataFrame:
    """P25 run count, successful runs (done and, where the table tells, with a best
    model), summed experiments and tokens."""
    good = F.col("status") == "done"
    if "best_model" in runs.columns:
        good = good & F.col("best_model").isNotNull()
    return runs.agg(F.count(F.lit(1)).alias("runs"),
                    F.count(F.when(good, 1)).alias("successful"),
                    F.coalesce(F.sum("total_experiments"), F.lit(0)).alias("experiments"),
                    F.coalesce(F.sum(F.col("token_input") + F.col("token_output")), F.lit(0)).alias("tokens"))
