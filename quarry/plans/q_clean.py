"""Queries: cleaning transforms (T*), scalar helpers (F*), sources (IO3, IO14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import transforms as T
from quarry.plans import fixtures as X
from quarry.plans.registry import finish, register
from quarry.session import read_table
from quarry.sources.files import preview, read_parquet

NUM_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


@register("io3_parquet_scan", """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 6) AS total
FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_orderpriority""")
def io3_parquet_scan(spark, sf):
    o = read_parquet(spark, f"{sf}/orders.parquet", columns=["o_orderpriority", "o_totalprice", "o_orderdate"],
                     where=F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return finish(o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"),
                                                    F.sum("o_totalprice").alias("total")))


@register("io14_preview", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100""")
def io14_preview(spark, sf):
    return preview(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"),
                   ["o_orderkey"], 100)


@register("t1_drop_nulls", f"""
WITH {X.LI_NULLS} SELECT * FROM li WHERE l_quantity IS NOT NULL""")
def t1_drop_nulls(spark, sf):
    return T.drop_nulls(X.li_nulls(spark, sf), "l_quantity")


@register("t2_fill_mean", f"""
WITH {X.LI_NULLS} SELECT l_orderkey, l_linenumber,
  round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM li)), 6) AS l_quantity FROM li""")
def t2_fill_mean(spark, sf):
    return finish(T.fill_mean(X.li_nulls(spark, sf), "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity"))


@register("t3_fill_median", f"""
WITH {X.LI_NULLS} SELECT l_orderkey, l_linenumber,
  round(coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM li)), 6) AS l_quantity FROM li""")
def t3_fill_median(spark, sf):
    return finish(T.fill_median(X.li_nulls(spark, sf), "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity"))


@register("t4_fill_mode", f"""
WITH {X.LI_NULLS}, m AS (SELECT l_returnflag AS v FROM li WHERE l_returnflag IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, v ASC LIMIT 1)
SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, (SELECT v FROM m)) AS l_returnflag FROM li""")
def t4_fill_mode(spark, sf):
    return T.fill_mode(X.li_nulls(spark, sf), "l_returnflag").select("l_orderkey", "l_linenumber", "l_returnflag")


@register("t5_one_hot", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal,
  coalesce(c_mktsegment = 'BUILDING', false) AS c_mktsegment_BUILDING,
  coalesce(c_mktsegment = 'FURNITURE', false) AS c_mktsegment_FURNITURE,
  coalesce(c_mktsegment = 'HOUSEHOLD', false) AS c_mktsegment_HOUSEHOLD,
  coalesce(c_mktsegment = 'MACHINERY', false) AS c_mktsegment_MACHINERY
FROM customer""")
def t5_one_hot(spark, sf):
    # the oracle spells out the five TPC-H segments; Spark derives them from the data
    return T.one_hot(read_table(spark, sf, "customer"), "c_mktsegment")


@register("t6_label_encode", f"""
WITH {X.LI_NULLS} SELECT l_orderkey, l_linenumber,
  dense_rank() OVER (ORDER BY coalesce(l_returnflag, 'nan')) - 1 AS l_returnflag FROM li""")
def t6_label_encode(spark, sf):
    return T.label_encode(X.li_nulls(spark, sf), "l_returnflag").select("l_orderkey", "l_linenumber", "l_returnflag")


@register("t7_log_transform", f"""
WITH {X.LI_NULLS} SELECT l_orderkey, l_linenumber,
  round(ln(1 + greatest(coalesce(l_quantity, 0.0), 0.0)), 6) AS l_quantity FROM li""")
def t7_log_transform(spark, sf):
    return finish(T.log_transform(X.li_nulls(spark, sf), "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity"))


@register("t8_standardize", """
SELECT l_orderkey, l_linenumber,
  round((l_extendedprice - avg(l_extendedprice) OVER ()) / (stddev_samp(l_extendedprice) OVER () + 1e-10), 6)
  AS l_extendedprice FROM lineitem""")
def t8_standardize(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return finish(T.standardize(li, "l_extendedprice"))


@register("t9_bin", """
WITH e AS (SELECT quantile_cont(l_extendedprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM lineitem),
d AS (SELECT DISTINCT unnest(q) AS edge FROM e),
inner_edges AS (SELECT edge FROM d WHERE edge > (SELECT min(edge) FROM d) AND edge < (SELECT max(edge) FROM d))
SELECT l.l_orderkey, l.l_linenumber, round(l.l_extendedprice, 6) AS l_extendedprice,
  (SELECT count(*) FROM inner_edges WHERE edge < l.l_extendedprice) AS l_extendedprice_binned
FROM lineitem l""")
def t9_bin(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return finish(T.bin_column(li, "l_extendedprice", 5))


@register("t10_drop_column", """
SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer""")
def t10_drop_column(spark, sf):
    return T.drop_column(read_table(spark, sf, "customer"), "c_acctbal")


@register("t11_to_numeric", f"""
WITH {X.ORDERS_TEXT} SELECT o_orderkey,
  CASE WHEN regexp_full_match(custkey_text, '{NUM_RE}') THEN TRY_CAST(trim(custkey_text) AS DOUBLE) END
  AS custkey_text FROM ot""")
def t11_to_numeric(spark, sf):
    return T.to_numeric(X.orders_text(spark, sf), "custkey_text").select("o_orderkey", "custkey_text")


@register("t12_to_datetime", f"""
WITH {X.ORDERS_TEXT} SELECT o_orderkey, order_date AS order_date_raw,
  CAST(year(TRY_CAST(order_date AS TIMESTAMP)) AS INTEGER) AS order_date_year,
  CAST(month(TRY_CAST(order_date AS TIMESTAMP)) AS INTEGER) AS order_date_month,
  CAST(isodow(TRY_CAST(order_date AS TIMESTAMP)) - 1 AS INTEGER) AS order_date_dayofweek FROM ot""")
def t12_to_datetime(spark, sf):
    return T.to_datetime(X.orders_text(spark, sf).select("o_orderkey", "order_date"), "order_date")


@register("t13_transform_steps", f"""
WITH {X.LI_NULLS}, a AS (SELECT * FROM li WHERE l_returnflag IS NOT NULL),
b AS (SELECT l_orderkey, l_linenumber, coalesce(l_quantity, (SELECT avg(l_quantity) FROM a)) AS l_quantity,
  l_extendedprice, l_returnflag FROM a)
SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity,
  round(ln(1 + greatest(l_extendedprice, 0.0)), 6) AS l_extendedprice,
  coalesce(l_returnflag = 'N', false) AS l_returnflag_N, coalesce(l_returnflag = 'R', false) AS l_returnflag_R
FROM b""")
def t13_transform_steps(spark, sf):
    steps = [{"column": "l_returnflag", "action": "drop_nulls"},
             {"column": "l_quantity", "action": "fill_mean"},
             {"column": "l_extendedprice", "action": "log_transform"},
             {"column": "no_such_column", "action": "standardize"},
             {"column": "l_returnflag", "action": "one_hot"}]
    out, _log = T.transform(X.li_nulls(spark, sf), steps)
    return finish(out)


@register("t14_hygiene", """
WITH d AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber = 2 THEN CAST('inf' AS DOUBLE) ELSE l_discount END AS l_discount FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_linenumber = 1)
SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN isinf(l_discount) THEN NULL ELSE l_discount END AS l_discount
FROM d""")
def t14_hygiene(spark, sf):
    li = read_table(spark, sf, "lineitem")
    d = li.select("l_orderkey", "l_linenumber",
                  F.when(F.col("l_linenumber") == 2, F.lit(float("inf"))).otherwise(F.col("l_discount"))
                  .alias("l_discount"))
    d = d.unionByName(li.where(F.col("l_linenumber") == 1).select("l_orderkey", "l_linenumber", "l_discount"))
    return T.hygiene(d)


@register("t15_date_columns_prep", f"""
WITH {X.ORDERS_TEXT}, r AS (
  SELECT 'custkey_text' AS name, avg(CASE WHEN (contains(custkey_text, '-') OR contains(custkey_text, '/'))
    AND TRY_CAST(custkey_text AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS ratio FROM ot
  UNION ALL
  SELECT 'order_date', avg(CASE WHEN (contains(order_date, '-') OR contains(order_date, '/'))
    AND TRY_CAST(order_date AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM ot)
SELECT name FROM r WHERE ratio >= 0.7""")
def t15_date_columns_prep(spark, sf):
    cols = T.date_columns_prep(X.orders_text(spark, sf))
    return spark.createDataFrame([(c,) for c in cols], "name string")


@register("t17_forward_fill", f"""
WITH {X.LI_NULLS}
SELECT l_orderkey, l_linenumber, round(coalesce(last_value(l_quantity IGNORE NULLS) OVER (
  PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0), 6) AS l_quantity FROM li""")
def t17_forward_fill(spark, sf):
    # (l_orderkey, l_linenumber) repeats in this data: the price breaks ties
    li = X.li_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    out = T.forward_fill(li, ["l_quantity"], ["l_linenumber", "l_extendedprice"], entity=["l_orderkey"])
    return finish(out.select("l_orderkey", "l_linenumber", "l_quantity"))


@register("t17_forward_fill_global", """
WITH e AS (SELECT event_id, ts, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value FROM events)
SELECT event_id, round(coalesce(last_value(value IGNORE NULLS) OVER (
  ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0), 6) AS value FROM e""")
def t17_forward_fill_global(spark, sf):
    ev = read_table(spark, sf, "events")
    e = ev.select("event_id", "ts", F.when(F.col("event_type") == "view", None).otherwise(F.col("value")).alias("value"))
    return finish(T.forward_fill(e, ["value"], ["ts", "event_id"]).select("event_id", "value"))


@register("t18_f5_actual_vs_predicted", """
SELECT l_orderkey, l_linenumber, l_extendedprice AS actual, l_quantity * 1500.0 AS predicted, l_shipdate AS date,
  round(l_quantity * 1500.0 - l_extendedprice, 4) AS error,
  round(round(l_quantity * 1500.0 - l_extendedprice, 4) / nullif(l_extendedprice, 0.0) * 100.0, 2) AS pct_error
FROM lineitem""")
def t18_f5_actual_vs_predicted(spark, sf):
    li = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y_true"),
        (F.col("l_quantity") * 1500.0).alias("Prediction"), F.col("l_shipdate").alias("timestamp"))
    a = T.align_names(li)
    return a.withColumns(S.error_cols())


@register("t19_clean_text", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(html), '<[^>]*>', ' ', 'g'),
  '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def t19_clean_text(spark, sf):
    p = read_table(spark, sf, "pages")
    return T.clean_text(p, "html", "text").select("page_id", "text")


@register("f1_f2_date_parts", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS wd, CAST(day(o_orderdate) AS INTEGER) AS d,
  CAST(hour(o_orderdate) AS INTEGER) AS h FROM orders""")
def f1_f2_date_parts(spark, sf):
    o = read_table(spark, sf, "orders")
    d = S.to_timestamp_safe(F.col("o_orderdate"))
    return o.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), S.weekday_mon0(d).alias("wd"),
                    F.dayofmonth(d).alias("d"), F.hour(d).alias("h"))


@register("f3_math", """
SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity), 6) AS lq, round(exp(l_discount) - 1, 6) AS ed,
  round(sqrt(abs(l_extendedprice - 30000)), 6) AS sq, round(least(greatest(l_tax, 0.02), 0.06), 6) AS clipped
FROM lineitem""")
def f3_math(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return finish(li.select("l_orderkey", "l_linenumber", F.log1p("l_quantity").alias("lq"),
                            F.expm1("l_discount").alias("ed"),
                            F.sqrt(F.abs(F.col("l_extendedprice") - 30000)).alias("sq"),
                            S.clip("l_tax", 0.02, 0.06).alias("clipped")))


@register("f4_text", """
SELECT doc_id, CAST(length(text) AS INTEGER) AS n_len, contains(text, 'the') AS has_the,
  regexp_matches(text, '[0-9]{3}') AS has_digits, lower(substr(trim(text), 1, 12)) AS head,
  CAST(len(string_split(text, ' ')) AS INTEGER) AS n_parts FROM documents""")
def f4_text(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.length("text").alias("n_len"), F.col("text").contains("the").alias("has_the"),
                    F.col("text").rlike("[0-9]{3}").alias("has_digits"),
                    F.lower(F.substring(F.trim("text"), 1, 12)).alias("head"),
                    F.size(F.split("text", " ")).alias("n_parts"))


@register("f6_overfit_flags", f"""
WITH {X.EXPLOG} SELECT run_id, num,
  round(abs(train_rmse - test_rmse) / greatest(abs(test_rmse), 1e-10), 6) AS gap,
  abs(train_rmse - test_rmse) / greatest(abs(test_rmse), 1e-10) > 0.3 AS overfit,
  abs(train_rmse - test_rmse) / greatest(abs(train_rmse), abs(test_rmse)) > 0.2 AS overfit_sym
FROM log WHERE success""")
def f6_overfit_flags(spark, sf):
    log = X.explog(spark, sf).where("success")
    g = S.overfit_ratio("train_rmse", "test_rmse")
    return finish(log.select("run_id", "num", g.alias("gap"), (g > 0.3).alias("overfit"),
                             (S.overfit_ratio_sym("train_rmse", "test_rmse") > 0.2).alias("overfit_sym")))


@register("f7_sentinel_metrics", f"""
WITH {X.EXPLOG}, m AS (SELECT run_id, round(metric_val * 10) * 50.0 AS v FROM log)
SELECT run_id, count(*) FILTER (WHERE isnan(v) OR isinf(v) OR v IN (999.0, 999.9, 999.99, 9999.0, 99999.0,
  1000.0, 10000.0, -1.0, -999.0, -9999.0, 0.0) OR v >= 500) AS n_sentinel, count(*) AS n FROM m GROUP BY run_id""")
def f7_sentinel_metrics(spark, sf):
    log = X.explog(spark, sf).withColumn("v", F.round(F.col("metric_val") * 10) * 50.0)
    return log.groupBy("run_id").agg(F.count(F.when(S.is_sentinel("v", True), 1)).alias("n_sentinel"),
                                     F.count(F.lit(1)).alias("n"))


@register("f8_failure_reasons", f"""
WITH {X.EXPLOG}, c AS (SELECT {S.classify_sql('error', S.FAILURE_RULES, S.FAILURE_DEFAULT)} AS reason
  FROM log WHERE status = 'crash')
SELECT reason, count(*) AS n FROM c GROUP BY reason""")
def f8_failure_reasons(spark, sf):
    log = X.explog(spark, sf).where(F.col("status") == "crash")
    return log.groupBy(S.failure_reason("error").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _family_sql(t: str) -> str:
    return S.classify_sql(t, S.FAMILY_RULES, S.FAMILY_DEFAULT, S.FAMILY_EMPTY)


def _model_name_sql(t: str) -> str:
    parts = [f"WHEN regexp_matches(coalesce({t}, ''), '{p}') THEN '{n}'" for p, n in S.MODEL_NAME_PATTERNS]
    return "CASE " + " ".join(parts) + " ELSE 'Custom Model' END"


@register("f9_model_family", f"""
SELECT family, count(*) AS n FROM (SELECT {_family_sql('text')} AS family FROM documents) GROUP BY family""")
def f9_model_family(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.groupBy(S.model_family("text").alias("family")).agg(F.count(F.lit(1)).alias("n"))


@register("f9_model_name", f"""
SELECT model_name, count(*) AS n FROM (SELECT {_model_name_sql('text')} AS model_name FROM conversations)
GROUP BY model_name""")
def f9_model_name(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.groupBy(S.model_name("text").alias("model_name")).agg(F.count(F.lit(1)).alias("n"))


@register("f12_metric_pick", f"""
WITH {X.EXPLOG}, m AS (SELECT run_id, num,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE test_rmse END AS test_rmse2, train_rmse, event_id FROM log)
SELECT run_id, num, CASE WHEN test_rmse2 IS NOT NULL THEN 'rmse' ELSE 'r2' END AS metric_name,
  round(CASE WHEN test_rmse2 IS NOT NULL THEN test_rmse2 ELSE train_rmse / 100.0 END, 6) AS metric_val FROM m""")
def f12_metric_pick(spark, sf):
    log = X.explog(spark, sf)
    mp = F.create_map(
        F.lit("test_rmse"), F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("test_rmse")),
        F.lit("id"), F.col("event_id").cast("double"),
        F.lit("r2"), F.col("train_rmse") / 100.0,
        F.lit("train_rmse"), F.col("train_rmse"))
    name, val = S.pick_metric(mp, "rmse")
    return finish(log.select("run_id", "num", name.alias("metric_name"), val.alias("metric_val")))
