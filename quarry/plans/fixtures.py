"""Inputs derived from the driver tables by deterministic SQL (both engines).

Each fixture is a DataFrame builder plus the same derivation as a DuckDB CTE.
The experiment log is numbered with the skew-safe ``row_index``; the CTE uses
``row_number()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.ordered import row_index
from quarry.session import read_table


def li_nulls(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(F.col("l_linenumber") == 2, None).otherwise(F.col("l_returnflag")).alias("l_returnflag"))


LI_NULLS = """li AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END AS l_returnflag FROM lineitem)"""


def orders_text(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    dirty = F.when(k % 7 == 0, "n/a").when(k % 11 == 0, "1d").otherwise(F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", dirty.alias("custkey_text"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), "o_totalprice")


ORDERS_TEXT = """ot AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN '1d'
       ELSE CAST(o_custkey AS VARCHAR) END AS custkey_text,
  strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_totalprice FROM orders)"""


def _status(event_type):
    return F.when(event_type == "error", "crash").when(event_type == "purchase", "keep").otherwise("discard")


def _error_text(event_id):
    m = event_id % 4
    return (F.when(m == 0, "No module named x").when(m == 1, "Timeout 900s")
            .when(m == 2, "FileNotFoundError").otherwise("ValueError"))


def explog(spark: SparkSession, sf: str) -> DataFrame:
    """Experiment log (A1/A3) from events: one run per user."""
    ev = read_table(spark, sf, "events")
    st = _status(F.col("event_type"))
    base = ev.select(
        F.col("user_id").alias("run_id"), "event_id", "ts", F.col("event_type").alias("model"),
        F.lit("rmse").alias("metric_name"), F.col("value").alias("metric_val"), st.alias("status"),
        (F.col("value") * (F.lit(1.0) + (F.col("event_id") % 5).cast("double") / 10.0)).alias("train_rmse"),
        F.col("value").alias("test_rmse"), F.col("props").alias("description"),
        F.when(F.col("event_type") == "error", _error_text(F.col("event_id"))).otherwise("").alias("error"),
        (F.col("event_type") != "error").alias("success"))
    ix = row_index(base, ["ts", "event_id"], ["run_id"], name="num", tie_break=False)
    return ix.withColumn("num", F.col("num") + 1)


EXPLOG = """log AS (SELECT user_id AS run_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS num,
  event_id, ts, event_type AS model, 'rmse' AS metric_name, value AS metric_val,
  CASE event_type WHEN 'error' THEN 'crash' WHEN 'purchase' THEN 'keep' ELSE 'discard' END AS status,
  value * (1.0 + CAST(event_id % 5 AS DOUBLE) / 10.0) AS train_rmse, value AS test_rmse,
  props AS description,
  CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'No module named x'
       WHEN 1 THEN 'Timeout 900s' WHEN 2 THEN 'FileNotFoundError' ELSE 'ValueError' END ELSE '' END AS error,
  event_type <> 'error' AS success FROM events)"""


def results_log(spark: SparkSession, sf: str) -> DataFrame:
    """Five-column log (A2) as one sequence in time order, raw text status."""
    ev = read_table(spark, sf, "events")
    return ev.select(
        F.lpad(F.lower(F.hex("event_id")), 7, "0").alias("commit"),
        F.col("value").cast("string").alias("val_bpb_text"),
        F.round(F.col("value") / 10.0, 1).alias("memory_gb"),
        F.concat(F.lit(" "), _status(F.col("event_type"))).alias("status_text"),
        F.concat_ws(" ", "event_type", "props").alias("description"), "ts", "event_id")


RESULTS = """res AS (SELECT lpad(lower(hex(event_id)), 7, '0') AS commit, CAST(value AS VARCHAR) AS val_bpb_text,
  round(value / 10.0, 1) AS memory_gb,
  ' ' || CASE event_type WHEN 'error' THEN 'crash' WHEN 'purchase' THEN 'keep' ELSE 'discard' END AS status_text,
  event_type || ' ' || props AS description, ts, event_id FROM events)"""


def reg_preds(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").alias("actual"),
                     (F.col("l_quantity") * 1500.0).alias("predicted"))


REG_PREDS = """rp AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice AS actual,
  l_quantity * 1500.0 AS predicted FROM lineitem)"""


def bin_preds(spark: SparkSession, sf: str) -> DataFrame:
    lab = read_table(spark, sf, "labels")
    doc = read_table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    j = lab.join(doc, "doc_id")
    score = (F.col("n_chars") % 100).cast("double") / 100.0
    return j.select("doc_id", "lang", F.col("toxic").alias("actual"), score.alias("score"),
                    (score >= 0.5).cast("int").alias("predicted"))


BIN_PREDS = """bp AS (SELECT l.doc_id, d.lang, l.toxic AS actual, CAST(d.n_chars % 100 AS DOUBLE) / 100.0 AS score,
  CAST(CAST(d.n_chars % 100 AS DOUBLE) / 100.0 >= 0.5 AS INTEGER) AS predicted
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def multi_preds(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    m = F.col("o_custkey") % 3
    pred = F.when(m == 0, "F").when(m == 1, "O").otherwise("P")
    return o.select("o_orderkey", F.col("o_orderstatus").alias("actual"), pred.alias("predicted"))


MULTI_PREDS = """mp AS (SELECT o_orderkey, o_orderstatus AS actual,
  CASE o_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS predicted FROM orders)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs table (A12) from orders; ``finished`` = started + totalprice seconds."""
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    guest = k % 2 == 0
    rid = F.when(guest, F.concat(F.lit("guest-"), k.cast("string"))).otherwise(F.concat(F.lit("usr-"), k.cast("string")))
    d = F.col("o_orderdate")
    # epoch seconds of a timestamp_ntz without consulting the session zone
    started = (F.datediff(F.to_date(d), F.lit("1970-01-01").cast("date")).cast("long") * 86400
               + F.hour(d) * 3600 + F.minute(d) * 60 + F.second(d)).cast("double")
    status = (F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "error")
              .otherwise("running"))
    return o.select(rid.alias("id"),
                    F.when(guest, None).otherwise(F.concat(F.lit("u"), (F.col("o_custkey") % 50).cast("string")))
                    .alias("user_id"),
                    status.alias("status"), started.alias("started"),
                    (started + F.col("o_totalprice")).alias("finished"),
                    (k % 13).cast("int").alias("total_experiments"),
                    (F.col("o_custkey") % 1000 * 10).cast("int").alias("token_input"),
                    (k % 97).cast("int").alias("token_output"), "o_orderpriority")


RUNS = """runs AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'guest-' ELSE 'usr-' END || CAST(o_orderkey AS VARCHAR) AS id,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'u' || CAST(o_custkey % 50 AS VARCHAR) END AS user_id,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'error' ELSE 'running' END AS status,
  CAST(epoch(o_orderdate) AS DOUBLE) AS started, CAST(epoch(o_orderdate) AS DOUBLE) + o_totalprice AS finished,
  CAST(o_orderkey % 13 AS INTEGER) AS total_experiments, CAST(o_custkey % 1000 * 10 AS INTEGER) AS token_input,
  CAST(o_orderkey % 97 AS INTEGER) AS token_output, o_orderpriority FROM orders)"""


def daily_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("n_orders"),
        F.avg("o_totalprice").alias("avg_price"), F.max("o_totalprice").alias("max_price"))


DAILY = """daily AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS revenue,
  count(*) AS n_orders, avg(o_totalprice) AS avg_price, max(o_totalprice) AS max_price FROM orders GROUP BY 1)"""
