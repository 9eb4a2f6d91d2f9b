"""Queries: chart data (P19-P24) and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import charts as C
from quarry.operators import timeseries as TS
from quarry.plans import fixtures as X
from quarry.plans.registry import finish, register
from quarry.session import read_table


@register("p19_chart_grouped_desc", """
SELECT c_mktsegment AS label, round(sum(c_acctbal), 6) AS value FROM customer WHERE c_mktsegment IS NOT NULL
GROUP BY 1 ORDER BY value DESC, label LIMIT 3""")
def p19_chart_grouped_desc(spark, sf):
    return finish(C.grouped(read_table(spark, sf, "customer"), "c_mktsegment", "c_acctbal", "sum", "desc", 3))


@register("p19_chart_grouped_mean_by_key", """
SELECT n_nationkey AS label, round(avg(c_acctbal), 6) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1 ORDER BY label LIMIT 20""")
def p19_chart_grouped_mean_by_key(spark, sf):
    c = read_table(spark, sf, "customer").join(read_table(spark, sf, "nation"),
                                               F.col("c_nationkey") == F.col("n_nationkey"))
    return finish(C.grouped(c, "n_nationkey", "c_acctbal", "mean", "none", 20))


@register("p20_histogram", """
WITH v AS (SELECT l_extendedprice AS x FROM lineitem),
s AS (SELECT count(*) AS n, min(x) AS lo0, max(x) AS hi0 FROM v),
p AS (SELECT least(30, greatest(10, n // 20)) AS k, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
  CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM s),
e AS (SELECT b AS bin, p.lo + b * ((p.hi - p.lo) / p.k) AS elo,
  CASE WHEN b + 1 = p.k THEN p.hi ELSE p.lo + (b + 1) * ((p.hi - p.lo) / p.k) END AS ehi
  FROM p, range(0, 30) t(b) WHERE b < p.k),
i0 AS (SELECT x, least(greatest(CAST(floor((x - p.lo) * (p.k / (p.hi - p.lo))) AS BIGINT), 0), p.k - 1) AS i,
  p.k FROM v, p),
i1 AS (SELECT i0.x, CASE WHEN i0.x < e.elo THEN i0.i - 1 ELSE i0.i END AS i, i0.k FROM i0 JOIN e ON e.bin = i0.i),
i2 AS (SELECT CASE WHEN i1.x >= e.ehi AND i1.i <> i1.k - 1 THEN i1.i + 1 ELSE i1.i END AS bin
  FROM i1 JOIN e ON e.bin = i1.i),
c AS (SELECT bin, count(*) AS cnt FROM i2 GROUP BY bin)
SELECT CAST(e.bin AS INTEGER) AS bin, round(e.elo, 6) AS lo, round(e.ehi, 6) AS hi,
  printf('%.2f-%.2f', e.elo, e.ehi) AS label, coalesce(c.cnt, 0) AS count
FROM e LEFT JOIN c ON c.bin = e.bin""")
def p20_histogram(spark, sf):
    return finish(C.histogram(read_table(spark, sf, "lineitem"), "l_extendedprice"))


@register("p21_pie_counts", """
SELECT l_shipmode AS label, count(*) AS value FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'AIR' WHEN 1 THEN 'RAIL'
  WHEN 2 THEN 'SHIP' ELSE 'TRUCK' END AS l_shipmode FROM lineitem) GROUP BY 1 ORDER BY value DESC, label LIMIT 3""")
def p21_pie_counts(spark, sf):
    li = read_table(spark, sf, "lineitem")
    m = F.col("l_linenumber") % 4
    mode = F.when(m == 0, "AIR").when(m == 1, "RAIL").when(m == 2, "SHIP").otherwise("TRUCK")
    return C.value_counts_top(li.select(mode.alias("l_shipmode")), "l_shipmode", 3)


@register("p22_raw_pairs", """
SELECT o_orderpriority AS label, o_totalprice AS value FROM orders
WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL ORDER BY o_orderkey LIMIT 200""")
def p22_raw_pairs(spark, sf):
    return C.raw_pairs(read_table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", ["o_orderkey"], 20)


@register("p23_column_summary", """
SELECT 'o_totalprice' AS "column", round(min(o_totalprice), 6) AS min, round(max(o_totalprice), 6) AS max,
  round(avg(o_totalprice), 6) AS mean, NULL::BIGINT AS n_distinct, NULL::VARCHAR AS top FROM orders
UNION ALL
SELECT 'o_orderpriority', NULL, NULL, NULL, (SELECT count(DISTINCT o_orderpriority) FROM orders),
  (SELECT string_agg(v, '|' ORDER BY r) FROM (SELECT o_orderpriority AS v,
     row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1) WHERE r <= 3)""")
def p23_column_summary(spark, sf):
    return finish(C.column_summary(read_table(spark, sf, "orders"), ["o_totalprice", "o_orderpriority"]))


@register("p24_seasonality", f"""
WITH {X.DAILY}, b AS (SELECT year(day) AS y, month(day) AS m, isodow(day) - 1 AS dow, revenue AS v FROM daily),
s AS (SELECT count(DISTINCT y) >= 2 AND count(DISTINCT m) >= 2 AS by_year FROM b),
g AS (SELECT CASE WHEN s.by_year THEN 'year' ELSE 'weekday' END AS kind,
  CAST(CASE WHEN s.by_year THEN y ELSE dow END AS INTEGER) AS "row", m, v FROM b, s)
SELECT kind, "row", {", ".join(f"round(avg(v) FILTER (WHERE m = {m}), 6) AS m{m}" for m in range(1, 13))}
FROM g GROUP BY kind, "row\"""")
def p24_seasonality(spark, sf):
    return finish(C.seasonality(X.daily_orders(spark, sf), "day", "revenue"))


@register("w4_rolling_mean", f"""
WITH {X.DAILY}, s AS (SELECT day, revenue, row_number() OVER (ORDER BY day) - 1 AS idx FROM daily),
w AS (SELECT greatest(3, count(*) // 50) AS w FROM daily)
SELECT a.day, round(avg(b.revenue), 6) AS rolling_mean FROM s a, w JOIN s b
  ON b.idx BETWEEN a.idx - w.w // 2 AND a.idx + (w.w - 1) // 2 GROUP BY a.day""")
def w4_rolling_mean(spark, sf):
    d = X.daily_orders(spark, sf).select("day", "revenue")
    return finish(TS.rolling_mean(d, ["day"], "revenue").select("day", "rolling_mean"))


@register("w4_rolling_mean_per_user", """
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) AS rolling_mean FROM events""")
def w4_rolling_mean_per_user(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    out = TS.rolling_mean(ev, ["ts", "event_id"], "value", window=10, entity=["user_id"])
    return finish(out.select("event_id", "rolling_mean"))


LAG_FEATS = ["n_orders", "avg_price", "max_price"]


def _lagcorr_sql() -> str:
    L = "(SELECT least(20, count(*) // 5) FROM daily)"
    rows = []
    for f in LAG_FEATS:
        for k in range(-20, 21):
            rows.append(f"SELECT '{f}' AS feature, {k} AS lag, corr({f}, y{k + 20}) AS c FROM sh")
    leads = ", ".join(f"lead(revenue, {k}) OVER (ORDER BY day) AS y{k + 20}" for k in range(-20, 21))
    return f"""WITH {X.DAILY}, sh AS (SELECT day, n_orders, avg_price, max_price, {leads} FROM daily),
base AS (SELECT 'n_orders' AS f, 0 AS pos, abs(corr(n_orders, revenue)) AS a FROM daily
  UNION ALL SELECT 'avg_price', 1, abs(corr(avg_price, revenue)) FROM daily
  UNION ALL SELECT 'max_price', 2, abs(corr(max_price, revenue)) FROM daily),
top AS (SELECT f FROM base ORDER BY coalesce(a, 0) DESC, pos LIMIT 5),
c AS ({" UNION ALL ".join(rows)})
SELECT feature, CAST(lag AS INTEGER) AS lag, round(c, 6) AS corr,
  row_number() OVER (PARTITION BY feature ORDER BY abs(coalesce(c, 0)) DESC, lag) = 1 AS is_peak
FROM c WHERE feature IN (SELECT f FROM top) AND abs(lag) <= {L}"""


@register("w5_lag_correlation", _lagcorr_sql())
def w5_lag_correlation(spark, sf):
    d = X.daily_orders(spark, sf)
    out = TS.lag_correlation(d, ["day"], "revenue", LAG_FEATS)
    return finish(out.withColumn("lag", F.col("lag").cast("int")))


@register("w6_series_max", f"""
WITH {X.DAILY} SELECT round(revenue, 6) AS max_value, day AS max_date FROM daily ORDER BY revenue DESC, day LIMIT 1""")
def w6_series_max(spark, sf):
    return finish(TS.series_max(X.daily_orders(spark, sf), "day", "revenue"))


@register("w10_lag_features", """
SELECT event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 7) OVER w AS value_lag7,
  round(avg(value) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS value_roll7_mean,
  round(stddev_samp(value) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS value_roll7_std,
  min(value) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS value_roll7_min,
  max(value) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS value_roll7_max
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def w10_lag_features(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    out = TS.lag_features(ev, ["user_id"], ["ts", "event_id"], "value", lags=(1, 7), windows=(7,))
    return finish(out.drop("user_id", "ts", "value"))


@register("m19_seasonal_naive", f"""
WITH {X.DAILY} SELECT day, revenue AS actual, lag(revenue, 7) OVER (ORDER BY day) AS predicted FROM daily""")
def m19_seasonal_naive(spark, sf):
    d = X.daily_orders(spark, sf).select("day", "revenue")
    out = TS.seasonal_naive(d, [], ["day"], "revenue", 7)
    return finish(out.select("day", F.col("revenue").alias("actual"), "predicted"))


@register("m4_fourier_terms", f"""
WITH {X.DAILY}, t AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS t FROM daily)
SELECT day, t, round(sin(2 * pi() * t / 7.0), 6) AS sin1, round(cos(2 * pi() * t / 7.0), 6) AS cos1,
  round(sin(4 * pi() * t / 7.0), 6) AS sin2, round(cos(4 * pi() * t / 7.0), 6) AS cos2 FROM t""")
def m4_fourier_terms(spark, sf):
    d = TS.time_index(X.daily_orders(spark, sf).select("day"), ["day"])
    return finish(TS.fourier_terms(d, "t", 7.0, 2))
