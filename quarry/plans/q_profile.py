"""Queries: profiling (P1-P15, P18), joins (J1-J9) and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import joins as J
from quarry.operators import profile as P
from quarry.operators.ordered import lag_join, row_index
from quarry.plans import fixtures as X
from quarry.plans.flagship import FLAT, flagship
from quarry.plans.registry import finish, register
from quarry.session import read_table

NUM_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
PATH_RE = r"(?i)\.(jpg|jpeg|png|gif|bmp|tiff|webp|csv|json|txt)$"


def profile_sql(source: str, cols: list[tuple[str, str]], with_cte: str = "") -> str:
    """DuckDB profile of ``source`` in the same flat layout as the Spark
    ``profile_columns`` (kinds: numeric, datetime, string)."""
    parts = []
    for pos, (c, kind) in enumerate(cols):
        if kind == "numeric":
            x = f"CASE WHEN isnan(CAST({c} AS DOUBLE)) OR isinf(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END"
            nn = f"({c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE)))"
            typ = "'numeric'"
        elif kind == "datetime":
            x = "CAST(NULL AS DOUBLE)"
            nn = f"({c} IS NOT NULL)"
            typ = "'datetime'"
        else:
            x = f"CASE WHEN regexp_full_match({c}, '{NUM_RE}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"
            nn = f"({c} IS NOT NULL)"
            nr = f"avg(CASE WHEN {nn} THEN CAST({x} IS NOT NULL AS DOUBLE) END)"
            dr = (f"avg(CASE WHEN {nn} THEN CAST(TRY_CAST({c} AS TIMESTAMP) IS NOT NULL AND "
                  f"(contains({c}, '-') OR contains({c}, '/')) AS DOUBLE) END)")
            sl = f"avg(CASE WHEN {nn} THEN CAST(contains({c}, '-') OR contains({c}, '/') AS DOUBLE) END)"
            pr = f"avg(CASE WHEN {nn} THEN CAST(regexp_matches({c}, '{PATH_RE}') AS DOUBLE) END)"
            al = f"avg(CASE WHEN {nn} THEN length({c}) END)"
            typ = (f"CASE WHEN {nr} < 0.7 AND {dr} >= 0.8 AND {sl} > 0 THEN 'datetime' "
                   f"WHEN {nr} > 0.8 THEN 'numeric' WHEN {al} > 5 AND {pr} > 0.5 THEN 'filepath' "
                   f"WHEN {al} > 40 AND {nr} < 0.3 THEN 'text' "
                   f"WHEN count(DISTINCT {c}) / greatest(count(CASE WHEN {nn} THEN 1 END), 1) < 0.05 THEN 'categorical' "
                   f"ELSE 'high_cardinality' END")
        typ = f"CASE WHEN count(CASE WHEN {nn} THEN 1 END) = 0 THEN 'empty' ELSE {typ} END"
        n = f"count({x})"
        num = f"({typ}) = 'numeric'"
        r4 = lambda e: f"CASE WHEN {num} THEN round({e}, 4) END"
        is_cat = f"({typ}) IN ('categorical', 'high_cardinality')"
        is_text = f"({typ}) = 'text'"
        top = (f"(SELECT max(k) FROM (SELECT count(*) AS k FROM {source} WHERE {nn} GROUP BY CAST({c} AS VARCHAR)))")
        parts.append(f"""SELECT {pos} AS position, '{c}' AS name, {typ} AS type,
  count(DISTINCT CASE WHEN {nn} THEN CAST({c} AS VARCHAR) END) AS "unique",
  count(*) - count(CASE WHEN {nn} THEN 1 END) AS nulls,
  round((count(*) - count(CASE WHEN {nn} THEN 1 END)) * 100.0 / count(*), 1) AS null_pct,
  {r4(f'avg({x})')} AS mean, {r4(f'stddev_samp({x})')} AS std, {r4(f'min({x})')} AS min,
  {r4(f'max({x})')} AS max, {r4(f'quantile_cont({x}, 0.25)')} AS p25, {r4(f'quantile_cont({x}, 0.5)')} AS p50,
  {r4(f'quantile_cont({x}, 0.75)')} AS p75,
  CASE WHEN {num} AND {n} > 2 THEN round(skewness({x}), 3) END AS skew,
  CASE WHEN {is_cat} THEN round({top} * 100.0 / count(CASE WHEN {nn} THEN 1 END), 1) END AS majority_pct,
  CASE WHEN {is_text} THEN round(avg(CASE WHEN {nn} THEN length(CAST({c} AS VARCHAR)) END), 1) END AS avg_len
FROM {source}""")
    body = "\nUNION ALL\n".join(parts)
    return (f"WITH {with_cte}\n" if with_cte else "") + body


ORDERS_COLS = [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "string"),
               ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "string")]


@register("p2_p4_profile_orders", profile_sql("orders", ORDERS_COLS))
def p2_p4_profile_orders(spark, sf):
    return P.profile_columns(read_table(spark, sf, "orders")).select(*FLAT)


TEXT_COLS = [("o_orderkey", "numeric"), ("custkey_text", "string"), ("order_date", "string"),
             ("o_totalprice", "numeric")]


@register("p3_semantic_types_orders_text", profile_sql("ot", TEXT_COLS, X.ORDERS_TEXT))
def p3_semantic_types_orders_text(spark, sf):
    return P.profile_columns(X.orders_text(spark, sf)).select(*FLAT)


DOC_COLS = [("doc_id", "numeric"), ("text", "string"), ("lang", "string"), ("source", "string"),
            ("n_chars", "numeric")]


@register("p8_profile_documents", profile_sql("documents", DOC_COLS))
def p8_profile_documents(spark, sf):
    return P.profile_columns(read_table(spark, sf, "documents")).select(*FLAT)


@register("p7_top_values", """
WITH v AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
  UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY 2)
SELECT "column", value, n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS BIGINT) AS rank
FROM v QUALIFY rank <= 5""")
def p7_top_values(spark, sf):
    from quarry.operators.stats import top_k_per_group
    o = read_table(spark, sf, "orders")
    vc = P.value_counts(o, ["o_orderstatus", "o_orderpriority", "o_custkey"])
    return top_k_per_group(vc, ["column"], [F.desc("n"), F.asc("value")], 5, rank_name="rank")


@register("p9_class_balance", """
WITH v AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
  UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY 2
  UNION ALL SELECT 'o_totalprice', CAST(o_totalprice AS VARCHAR), count(*) FROM orders GROUP BY 2),
k AS (SELECT "column", count(*) AS k, sum(n) AS tot FROM v GROUP BY 1)
SELECT v."column", v.value, round(v.n / k.tot, 3) AS share FROM v JOIN k ON v."column" = k."column"
WHERE k.k > 1 AND k.k <= 20""")
def p9_class_balance(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice")
    return P.class_balance(o)


def _corr_sql(source: str, cols: list[str], k: int = 8) -> str:
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    sel = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, '{cols[i]}' AS col1, '{cols[j]}' AS col2, abs(corr({cols[i]}, {cols[j]})) AS c "
        f"FROM {source}" for i, j in pairs)
    ids = " UNION ALL ".join(
        f"SELECT '{c}' AS col, count(DISTINCT {c}) * 1.0 / count(*) > 0.95 AS id_like FROM {source}" for c in cols)
    return f"""WITH p AS ({sel}), ids AS ({ids})
SELECT col1, col2, round(c, 3) AS corr, CAST(row_number() OVER (ORDER BY c DESC, i, j) AS INTEGER) AS rank
FROM p WHERE c IS NOT NULL AND NOT isnan(c)
  AND col1 NOT IN (SELECT col FROM ids WHERE id_like) AND col2 NOT IN (SELECT col FROM ids WHERE id_like)
QUALIFY rank <= {k}"""


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]


@register("p10_top_correlations", _corr_sql("lineitem", LI_NUM))
def p10_top_correlations(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return P.top_correlations(li, LI_NUM)


@register("p6_serial_correlation", """
WITH e AS (SELECT value, ts, event_id, lag(value) OVER (ORDER BY ts, event_id) AS prev FROM events)
SELECT 'value' AS "column", round(corr(prev, value), 6) AS serial_corr FROM e""")
def p6_serial_correlation(spark, sf):
    ev = read_table(spark, sf, "events")
    return finish(P.serial_correlation(ev, ["value"], ["ts", "event_id"]))


@register("j9_lagged_pairs", """
SELECT user_id, round(corr(prev, value), 6) AS lag_corr, count(prev) AS n_pairs FROM (
  SELECT user_id, value, lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
GROUP BY user_id""")
def j9_lagged_pairs(spark, sf):
    ev = read_table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    ix = row_index(ev, ["ts", "event_id"], ["user_id"], name="i")
    pairs = lag_join(ix, ["user_id"], "i", "value", 2, "prev")
    return finish(pairs.groupBy("user_id").agg(F.corr("prev", "value").alias("lag_corr"),
                                              F.count("prev").alias("n_pairs")))


def _candidates_sql(prof: str, table: str) -> str:
    """Target-candidate rules (P12/P13) over a profile CTE, in SQL."""
    tn = ", ".join(f"'{t}'" for t in P.TARGET_NAMES)
    ide = ", ".join(f"'{t}'" for t in P.ID_EXACT)
    cie = ", ".join(f"'{t}'" for t in P.CAT_ID_EXACT)
    suf = " OR ".join(f"ends_with(lower(name), '{x}')" for x in P.CAT_ID_SUFFIXES)
    return f"""WITH prof AS ({prof}), r AS (SELECT count(*) AS n_rows FROM {table}),
f AS (SELECT name, position, type, "unique",
  type = 'numeric' AND (lower(name) IN ({ide}) OR ends_with(lower(name), 'id') OR "unique" / n_rows > 0.95) AS id_like,
  (lower(name) IN ({cie}) OR {suf}) AS cat_id FROM prof, r),
s AS (SELECT name, position, type, "unique", CASE WHEN lower(name) IN ({tn}) THEN 0
  WHEN type IN ('categorical', 'high_cardinality') AND "unique" BETWEEN 2 AND 50 AND NOT cat_id THEN 1
  WHEN type = 'numeric' AND "unique" > 10 AND NOT id_like THEN 2 END AS score FROM f)
SELECT name, type, "unique", score, CAST(row_number() OVER (ORDER BY score, position) AS INTEGER) AS rank
FROM s WHERE score IS NOT NULL QUALIFY rank <= 5"""


CUST_COLS = [("c_custkey", "numeric"), ("c_name", "string"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"),
             ("c_mktsegment", "string")]


@register("p12_p13_target_candidates", _candidates_sql(profile_sql("customer", CUST_COLS), "customer")
          .replace("SELECT name, type, \"unique\", score,", "SELECT name, score,"))
def p12_p13_target_candidates(spark, sf):
    c = read_table(spark, sf, "customer")
    prof = P.profile_columns(c, quantiles=False)
    return P.target_candidates(prof, c.count()).select("name", F.col("score").cast("int").alias("score"),
                                                        F.col("rank").cast("int").alias("rank"))


@register("p14_statistical_id", """
WITH s AS (SELECT count(*) AS rows FROM orders),
c AS (SELECT 'o_orderkey' AS name, count(o_orderkey) AS n, count(DISTINCT o_orderkey) AS d,
        min(o_orderkey) AS mn, max(o_orderkey) AS mx FROM orders
  UNION ALL SELECT 'o_custkey', count(o_custkey), count(DISTINCT o_custkey), min(o_custkey), max(o_custkey) FROM orders
  UNION ALL SELECT 'o_totalprice', count(o_totalprice), count(DISTINCT o_totalprice), NULL, NULL FROM orders)
SELECT name, (d / rows > 0.9) OR coalesce(mn IN (0, 1) AND mx - mn + 1 = n AND n = d, false) AS is_id FROM c, s""")
def p14_statistical_id(spark, sf):
    o = read_table(spark, sf, "orders")
    return P.statistical_id(o, ["o_orderkey", "o_custkey", "o_totalprice"])


OBJ_COLS = [("o_orderkey", "numeric"), ("o_orderstatus", "string"), ("o_totalprice", "numeric"),
            ("o_orderpriority", "string")]


@register("p15_infer_objective", "WITH c AS (" + _candidates_sql(
    profile_sql("(SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders)", OBJ_COLS),
    "orders") + """)
SELECT name AS target, CASE WHEN type IN ('categorical', 'high_cardinality') AND "unique" <= 2
  THEN 'binary_classification' WHEN type IN ('categorical', 'high_cardinality') AND "unique" <= 20
  THEN 'multiclass_classification' ELSE 'regression' END AS task,
  CASE WHEN type IN ('categorical', 'high_cardinality') AND "unique" <= 2 THEN 'auc'
  WHEN type IN ('categorical', 'high_cardinality') AND "unique" <= 20 THEN 'f1' ELSE 'rmse' END AS metric,
  CASE WHEN type IN ('categorical', 'high_cardinality') AND "unique" <= 20 THEN 'higher_is_better'
  ELSE 'lower_is_better' END AS direction FROM c WHERE rank = 1""")
def p15_infer_objective(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    prof = P.profile_columns(o, quantiles=False)
    return P.infer_objective(prof, o.count())


@register("p15_objective_fallback", """
SELECT 'ps_b' AS target, 'regression' AS task, 'rmse' AS metric, 'lower_is_better' AS direction
UNION ALL SELECT 'ps_b', 'forecasting', 'mape', 'lower_is_better'
UNION ALL SELECT 'ps_b', 'clustering', 'silhouette', 'higher_is_better'
UNION ALL SELECT 'ps_note', 'regression', 'rmse', 'lower_is_better'""")
def p15_objective_fallback(spark, sf):
    """No column qualifies as a target: the last numeric one is taken, else the last."""
    o = read_table(spark, sf, "orders")
    flat = o.select(F.lit(1.0).alias("ps_a"), (F.col("o_orderkey") % 3).alias("ps_b"),
                    F.concat(F.lit("note number "), F.col("o_orderkey").cast("string"),
                             F.lit(" of a longer text about the order")).alias("ps_note"))
    n = o.count()
    prof = P.profile_columns(flat, quantiles=False)
    out = P.infer_objective(prof, n)
    for task in ("forecasting", "clustering"):
        out = out.unionByName(P.infer_objective(prof, n, task))
    return out.unionByName(P.infer_objective(P.profile_columns(flat.select("ps_note"), quantiles=False), n))


def _corr_matrix_sql(target: str, feats: list[str], k: int) -> str:
    allc = [target] + feats
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS col1, '{b}' AS col2, corr({a}, {b}) AS c FROM lineitem"
                               for a in allc for b in allc)
    rk = " UNION ALL ".join(f"SELECT '{f}' AS f, {i} AS pos, abs(corr({f}, {target})) AS a FROM lineitem"
                            for i, f in enumerate(feats))
    return f"""WITH pairs AS ({pairs}), rk AS (SELECT f, row_number() OVER (ORDER BY a DESC, pos) AS r FROM ({rk})
  WHERE a IS NOT NULL), keep AS (SELECT '{target}' AS f UNION ALL SELECT f FROM rk WHERE r <= {k})
SELECT col1, col2, round(c, 6) AS corr FROM pairs
WHERE col1 IN (SELECT f FROM keep) AND col2 IN (SELECT f FROM keep)"""


@register("p18_correlation_matrix", _corr_matrix_sql("l_extendedprice", ["l_quantity", "l_discount", "l_tax"], 2))
def p18_correlation_matrix(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return finish(P.correlation_matrix(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], k=2))


# ---------------------------------------------------------------- joins

@register("j1_join_candidates", """
WITH r AS (
  SELECT (SELECT count(DISTINCT c_custkey) * 1.0 / count(*) FROM customer) > 0.5
     AND (SELECT count(DISTINCT s_suppkey) * 1.0 / count(*) FROM supplier) > 0.5 AS hi_id,
    (SELECT count(DISTINCT c_name) * 1.0 / count(*) FROM customer) > 0.5
     AND (SELECT count(DISTINCT s_name) * 1.0 / count(*) FROM supplier) > 0.5 AS hi_name,
    (SELECT count(DISTINCT c_nationkey) * 1.0 / count(*) FROM customer) > 0.5
     AND (SELECT count(DISTINCT s_nationkey) * 1.0 / count(*) FROM supplier) > 0.5 AS hi_nation,
    (SELECT count(DISTINCT c_acctbal) * 1.0 / count(*) FROM customer) > 0.5
     AND (SELECT count(DISTINCT s_acctbal) * 1.0 / count(*) FROM supplier) > 0.5 AS hi_acct),
c AS (SELECT * FROM (VALUES (0, 'id'), (1, 'name'), (2, 'nationkey'), (3, 'acctbal')) AS t(position, name))
SELECT name, position FROM c, r WHERE ends_with(name, 'id') OR name IN ('id', 'key', 'index', 'code', 'name',
  'date', 'timestamp') OR (name = 'id' AND hi_id) OR (name = 'name' AND hi_name)
  OR (name = 'nationkey' AND hi_nation) OR (name = 'acctbal' AND hi_acct)""")
def j1_join_candidates(spark, sf):
    ren = {"c_custkey": "id", "c_name": "name", "c_nationkey": "nationkey", "c_acctbal": "acctbal"}
    c = read_table(spark, sf, "customer").select(*[F.col(k).alias(v) for k, v in ren.items()])
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                                                 F.col("s_nationkey").alias("nationkey"),
                                                 F.col("s_acctbal").alias("acctbal"))
    cands = J.join_candidates({"customer.csv": c, "supplier.csv": s})
    return spark.createDataFrame([(x, c.columns.index(x)) for x in cands], "name string, position int")


NULLKEY_CTE = """c AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS cust_id,
    c_name AS name, c_acctbal AS acctbal, c_mktsegment AS status FROM customer),
  o AS (SELECT CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_custkey END AS cust_id, o_orderkey,
    o_totalprice AS total, o_orderstatus AS status FROM orders)"""


def _nullkey_tables(spark, sf):
    c = read_table(spark, sf, "customer")
    o = read_table(spark, sf, "orders")
    ck = F.when(F.col("c_custkey") % 50 == 0, None).otherwise(F.col("c_custkey"))
    ok = F.when(F.col("o_custkey") % 50 == 0, None).otherwise(F.col("o_custkey"))
    return (c.select(ck.alias("cust_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"),
                     F.col("c_mktsegment").alias("status")),
            o.select(ok.alias("cust_id"), "o_orderkey", F.col("o_totalprice").alias("total"),
                     F.col("o_orderstatus").alias("status")))


@register("j2_auto_join_null_keys", f"""
WITH {NULLKEY_CTE}
SELECT coalesce(c.cust_id, o.cust_id) AS cust_id, c.name, c.acctbal, c.status, o.o_orderkey, o.total,
  o.status AS status_orders
FROM c FULL OUTER JOIN o ON c.cust_id IS NOT DISTINCT FROM o.cust_id""")
def j2_auto_join_null_keys(spark, sf):
    c, o = _nullkey_tables(spark, sf)
    out, info = J.auto_join({"customer.csv": c, "orders.csv": o})
    assert info["key"] == "cust_id", info
    return out


@register("j2_auto_join_three_tables", f"""
WITH {NULLKEY_CTE},
s AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_suppkey END AS cust_id, s_name AS label, s_acctbal AS acctbal FROM supplier),
a AS (SELECT coalesce(c.cust_id, o.cust_id) AS cust_id, c.name, c.acctbal, c.status, o.o_orderkey, o.total,
  o.status AS status_orders FROM c FULL OUTER JOIN o ON c.cust_id IS NOT DISTINCT FROM o.cust_id)
SELECT coalesce(a.cust_id, s.cust_id) AS cust_id, a.name, a.acctbal, a.status, a.o_orderkey, a.total, a.status_orders,
  s.label, s.acctbal AS acctbal_supplier FROM a FULL OUTER JOIN s ON a.cust_id IS NOT DISTINCT FROM s.cust_id""")
def j2_auto_join_three_tables(spark, sf):
    c, o = _nullkey_tables(spark, sf)
    s = read_table(spark, sf, "supplier").select(
        F.when(F.col("s_suppkey") % 9 != 0, F.col("s_suppkey")).alias("cust_id"), F.col("s_name").alias("label"),
        F.col("s_acctbal").alias("acctbal"))
    return J.auto_join({"customer.csv": c, "orders.csv": o, "supplier.csv": s}, key="cust_id")[0]


@register("j3_fan_out", f"""
WITH {NULLKEY_CTE},
cl AS (SELECT cust_id, count(*) AS nl FROM c GROUP BY 1), cr AS (SELECT cust_id, count(*) AS nr FROM o GROUP BY 1),
j AS (SELECT nl, nr FROM cl FULL OUTER JOIN cr ON cl.cust_id IS NOT DISTINCT FROM cr.cust_id)
SELECT CAST(sum(nl) AS BIGINT) AS rows_before,
  CAST(sum(CASE WHEN nl IS NOT NULL AND nr IS NOT NULL THEN nl * nr ELSE coalesce(nl, nr) END) AS BIGINT) AS rows_after,
  sum(CASE WHEN nl IS NOT NULL AND nr IS NOT NULL THEN nl * nr ELSE coalesce(nl, nr) END) > sum(nl) * 1.5 AS warn
FROM j""")
def j3_fan_out(spark, sf):
    c, o = _nullkey_tables(spark, sf)
    return J.fan_out(c, o, "cust_id")


@register("j4_concat", """
SELECT r_regionkey, r_name, NULL::BIGINT AS p_partkey, NULL::VARCHAR AS p_name, NULL::VARCHAR AS p_brand,
  NULL::VARCHAR AS p_type, NULL::INTEGER AS p_size, NULL::DOUBLE AS p_retailprice FROM region
UNION ALL SELECT NULL, NULL, p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part""")
def j4_concat(spark, sf):
    r, p = read_table(spark, sf, "region"), read_table(spark, sf, "part")
    out, info = J.auto_join({"region.csv": r, "part.csv": p})
    assert info["method"] == "concat"
    return out


@register("j5_zip_tail", """
WITH a AS (SELECT o_orderkey, o_totalprice AS actual, row_number() OVER (ORDER BY o_orderkey) - 1 AS ai FROM orders),
n AS (SELECT count(*) AS n FROM orders),
p AS (SELECT o_orderkey AS pk, o_totalprice * 0.9 AS predicted,
  row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders WHERE o_orderkey % 5 = 0)
SELECT a.ai - CAST(floor(n.n * 0.8) AS BIGINT) AS idx, a.o_orderkey, round(a.actual, 6) AS actual, p.pk,
  round(p.predicted, 6) AS predicted
FROM a, n, p WHERE a.ai >= CAST(floor(n.n * 0.8) AS BIGINT) AND p.idx = a.ai - CAST(floor(n.n * 0.8) AS BIGINT)""")
def j5_zip_tail(spark, sf):
    o = read_table(spark, sf, "orders")
    a = o.select("o_orderkey", F.col("o_totalprice").alias("actual"))
    p = o.where(F.col("o_orderkey") % 5 == 0).select(F.col("o_orderkey").alias("pk"),
                                                     (F.col("o_totalprice") * 0.9).alias("predicted"))
    return finish(J.zip_tail(a, p, ["o_orderkey"], ["pk"]))


@register("entry_flagship_profile", profile_sql(
    "j", [("orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"), ("l_linenumber", "numeric"),
          ("l_quantity", "numeric"), ("l_extendedprice", "numeric"), ("l_discount", "numeric"), ("l_tax", "numeric"),
          ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "datetime"), ("o_custkey", "numeric"),
          ("o_orderstatus", "string"), ("o_totalprice", "numeric"), ("o_orderdate", "datetime"),
          ("o_orderpriority", "string")],
    """j AS (SELECT coalesce(l.l_orderkey, o.o_orderkey) AS orderkey, l.* EXCLUDE (l_orderkey),
    o.* EXCLUDE (o_orderkey) FROM lineitem l FULL OUTER JOIN orders o ON l.l_orderkey IS NOT DISTINCT FROM o.o_orderkey)"""))
def entry_flagship_profile(spark, sf):
    return flagship(spark, sf)


@register("k3_top_features_by_corr", """
WITH c AS (SELECT 'l_quantity' AS feature, 0 AS pos, abs(corr(l_quantity, l_extendedprice)) AS a FROM lineitem
  UNION ALL SELECT 'l_discount', 1, abs(corr(l_discount, l_extendedprice)) FROM lineitem
  UNION ALL SELECT 'l_tax', 2, abs(corr(l_tax, l_extendedprice)) FROM lineitem
  UNION ALL SELECT 'l_linenumber', 3, abs(corr(l_linenumber, l_extendedprice)) FROM lineitem
  UNION ALL SELECT 'l_suppkey', 4, abs(corr(l_suppkey, l_extendedprice)) FROM lineitem)
SELECT feature, round(a, 6) AS abs_corr, CAST(row_number() OVER (ORDER BY a DESC, pos) AS INTEGER) AS rank FROM c
QUALIFY rank <= 20""")
def k3_top_features_by_corr(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return finish(P.top_features_by_corr(li, "l_extendedprice",
                                         ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"], 20))


@register("p11_signals")
def p11_signals(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    pr = P.profile(d)
    return P.signals(pr["columns"], pr["class_balance"])


@register("p11_notable_trait")
def p11_notable_trait(spark, sf):
    lab = read_table(spark, sf, "labels").join(read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars"),
                                               "doc_id")
    pr = P.profile(lab)
    sig = P.signals(pr["columns"], pr["class_balance"])
    return P.notable_trait(pr["columns"], pr["class_balance"], sig, "toxic", lab.count())


@register("t16_detect_date_column", """
WITH ot AS (SELECT CAST(o_orderkey AS VARCHAR) AS okey, strftime(o_orderdate, '%Y-%m-%d') AS period,
  o_orderpriority FROM orders),
r AS (SELECT avg(CASE WHEN TRY_CAST(period AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS rp FROM ot)
SELECT 'period' AS name FROM r WHERE rp > 0.7""")
def t16_detect_date_column(spark, sf):
    from quarry.operators.transforms import detect_date_column
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("okey"),
                                               F.date_format("o_orderdate", "yyyy-MM-dd").alias("period"),
                                               "o_orderpriority")
    c = detect_date_column(o)
    return spark.createDataFrame([(c,)] if c else [], "name string")


@register("u3_distinct_rows_and_classes", """
SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders""")
def u3_distinct_rows_and_classes(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")
    return o.distinct().orderBy("o_orderstatus", "o_orderpriority")


@register("j8_grid_rows", """
SELECT g.grid_value, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price FROM orders,
  (SELECT CAST(unnest([0.0, 0.5, 1.0, 1.5, 2.0]) AS DOUBLE) AS grid_value) g GROUP BY 1""")
def j8_grid_rows(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    g = J.grid_rows(o, "grid", [0.0, 0.5, 1.0, 1.5, 2.0])
    return finish(g.groupBy("grid_value").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price")))
