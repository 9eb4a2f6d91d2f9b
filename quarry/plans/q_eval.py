"""Queries: evaluation metrics (E1-E6, E9) and splits (V1-V8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import evaluation as E
from quarry.operators import splits as V
from quarry.plans import fixtures as X
from quarry.plans.registry import finish, register
from quarry.session import read_table

REG_SQL = """round(sqrt(avg(pow(predicted - actual, 2))), 6) AS rmse, round(avg(pow(predicted - actual, 2)), 6) AS mse,
  round(avg(abs(predicted - actual)), 6) AS mae, round(avg(abs((predicted - actual) / nullif(actual, 0.0))), 6) AS mape,
  round(avg(2.0 * abs(predicted - actual) / nullif(abs(actual) + abs(predicted), 0.0)), 6) AS smape,
  round(sum(abs(predicted - actual)) / nullif(sum(abs(actual)), 0.0), 6) AS wape,
  round(1.0 - sum(pow(predicted - actual, 2)) / nullif(var_pop(actual) * count(actual), 0.0), 6) AS r2,
  count(*) AS n"""


@register("e1_e3_regression_metrics", f"WITH {X.REG_PREDS} SELECT l_returnflag, {REG_SQL} FROM rp GROUP BY 1")
def e1_e3_regression_metrics(spark, sf):
    return finish(E.regression_metrics(X.reg_preds(spark, sf), by=["l_returnflag"]))


@register("e1_e3_regression_metrics_total", f"WITH {X.REG_PREDS} SELECT {REG_SQL} FROM rp")
def e1_e3_regression_metrics_total(spark, sf):
    return finish(E.regression_metrics(X.reg_preds(spark, sf)))


def _cls_sql(src: str, average: str, positive: str = "1") -> str:
    per = f"""cm AS (SELECT CAST(actual AS VARCHAR) AS a, CAST(predicted AS VARCHAR) AS p, count(*) AS n FROM {src}
  GROUP BY 1, 2),
cls AS (SELECT a AS c FROM cm UNION SELECT p FROM cm),
per AS (SELECT c, coalesce((SELECT sum(n) FROM cm WHERE a = c), 0) AS support,
  coalesce((SELECT sum(n) FROM cm WHERE a = c AND p = c), 0) AS tp,
  coalesce((SELECT sum(n) FROM cm WHERE p = c), 0) AS pred_n FROM cls),
m AS (SELECT c, support, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS pr,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM per),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m),
acc AS (SELECT sum(n) FILTER (WHERE a = p) / sum(n) AS accuracy FROM cm)"""
    if average == "binary":
        agg = f"(SELECT pr FROM f WHERE c = '{positive}') AS precision, (SELECT rc FROM f WHERE c = '{positive}') AS recall, (SELECT f1 FROM f WHERE c = '{positive}') AS f1"
    elif average == "macro":
        agg = "(SELECT avg(pr) FROM f) AS precision, (SELECT avg(rc) FROM f) AS recall, (SELECT avg(f1) FROM f) AS f1"
    else:
        agg = ("(SELECT sum(pr * support) / sum(support) FROM f) AS precision, "
               "(SELECT sum(rc * support) / sum(support) FROM f) AS recall, "
               "(SELECT sum(f1 * support) / sum(support) FROM f) AS f1")
    return f"""{per}, r AS (SELECT accuracy, {agg} FROM acc)
SELECT round(accuracy, 6) AS accuracy, round(coalesce(precision, 0.0), 6) AS precision,
  round(coalesce(recall, 0.0), 6) AS recall, round(coalesce(f1, 0.0), 6) AS f1 FROM r"""


@register("e4_binary_classification", f"WITH {X.BIN_PREDS}, " + _cls_sql("bp", "binary"))
def e4_binary_classification(spark, sf):
    return finish(E.classification_metrics(X.bin_preds(spark, sf)))


@register("e4_macro_classification", f"WITH {X.MULTI_PREDS}, " + _cls_sql("mp", "macro"))
def e4_macro_classification(spark, sf):
    return finish(E.classification_metrics(X.multi_preds(spark, sf), average="macro"))


@register("e4_weighted_classification", f"WITH {X.MULTI_PREDS}, " + _cls_sql("mp", "weighted"))
def e4_weighted_classification(spark, sf):
    return finish(E.classification_metrics(X.multi_preds(spark, sf), average="weighted"))


AUC_SQL = """s AS (SELECT {by} score, count(*) FILTER (WHERE actual = 1) AS pos, count(*) FILTER (WHERE actual = 0) AS neg
  FROM bp GROUP BY {by} score),
c AS (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS neg_below FROM s)
SELECT {by} round(sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc,
  CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM c {group}"""


@register("e5_auc", f"WITH {X.BIN_PREDS}, " + AUC_SQL.format(by="", part="", group=""))
def e5_auc(spark, sf):
    return finish(E.auc(X.bin_preds(spark, sf)))


@register("e5_auc_by_lang", f"WITH {X.BIN_PREDS}, " + AUC_SQL.format(by="lang,", part="PARTITION BY lang",
                                                                      group="GROUP BY lang"))
def e5_auc_by_lang(spark, sf):
    return finish(E.auc(X.bin_preds(spark, sf), by=["lang"]))


@register("e6_logloss", f"""
WITH {X.BIN_PREDS} SELECT round(avg(-(actual * ln(least(greatest(score, 1e-15), 1 - 1e-15)) +
  (1 - actual) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))), 6) AS logloss FROM bp""")
def e6_logloss(spark, sf):
    return finish(E.logloss(X.bin_preds(spark, sf)))


@register("e9_residual_histogram", f"""
WITH {X.REG_PREDS}, v AS (SELECT predicted - actual AS x FROM rp),
s AS (SELECT min(x) AS lo0, max(x) AS hi0 FROM v),
p AS (SELECT 50 AS k, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
  CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM s),
e AS (SELECT b AS bin, p.lo + b * ((p.hi - p.lo) / p.k) AS elo,
  CASE WHEN b + 1 = p.k THEN p.hi ELSE p.lo + (b + 1) * ((p.hi - p.lo) / p.k) END AS ehi FROM p, range(0, 50) t(b)),
i0 AS (SELECT x, least(greatest(CAST(floor((x - p.lo) * (p.k / (p.hi - p.lo))) AS BIGINT), 0), p.k - 1) AS i, p.k
  FROM v, p),
i1 AS (SELECT i0.x, CASE WHEN i0.x < e.elo THEN i0.i - 1 ELSE i0.i END AS i, i0.k FROM i0 JOIN e ON e.bin = i0.i),
i2 AS (SELECT CASE WHEN i1.x >= e.ehi AND i1.i <> i1.k - 1 THEN i1.i + 1 ELSE i1.i END AS bin FROM i1 JOIN e
  ON e.bin = i1.i),
c AS (SELECT bin, count(*) AS cnt FROM i2 GROUP BY bin)
SELECT CAST(e.bin AS INTEGER) AS bin, round(e.elo, 6) AS lo, round(e.ehi, 6) AS hi,
  printf('%.2f-%.2f', e.elo, e.ehi) AS label, coalesce(c.cnt, 0) AS count FROM e LEFT JOIN c ON c.bin = e.bin""")
def e9_residual_histogram(spark, sf):
    return finish(E.residual_histogram(X.reg_preds(spark, sf)))


# ---------------------------------------------------------------- splits

@register("v1_time_split", """
WITH o AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos,
  count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN pos < CAST(floor(n * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM o""")
def v1_time_split(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return V.time_split(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "split")


@register("v2_mod_split", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'test' ELSE 'train' END AS split FROM orders""")
def v2_mod_split(spark, sf):
    return V.mod_split(read_table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@register("v2_hash_split")
def v2_hash_split(spark, sf):
    return V.hash_split(read_table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 0.8, 42)


@register("v3_prep_summary", """
SELECT count(*) AS rows, 2 AS cols, 'o_totalprice' AS target, ['o_orderdate'] AS datetime_columns,
  count(*) FILTER (WHERE o_orderkey % 5 <> 4) AS train_rows, count(*) FILTER (WHERE o_orderkey % 5 = 4) AS val_rows
FROM orders""")
def v3_prep_summary(spark, sf):
    o = V.mod_split(read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return V.prep_summary(o, "o_totalprice", date_columns=["o_orderdate"])


@register("v4_stratified_kfold", """
SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold
FROM labels""")
def v4_stratified_kfold(spark, sf):
    lab = read_table(spark, sf, "labels").select("doc_id", "toxic")
    return V.stratified_kfold(lab, "toxic", ["doc_id"], 5)


@register("v4_kfold_hash")
def v4_kfold_hash(spark, sf):
    return V.kfold(read_table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 5)


@register("v4_group_kfold")
def v4_group_kfold(spark, sf):
    return V.group_kfold(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 5)


@register("v5_walk_forward", """
WITH c AS (SELECT * FROM (VALUES (0, DATE '1997-01-01', DATE '1998-01-01'), (1, DATE '1998-01-01', DATE '1999-01-01'),
  (2, DATE '1999-01-01', NULL)) AS t(fold, cut, hi)),
d AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders)
SELECT d.o_orderkey, d.day, CASE WHEN d.day <= c.cut THEN 'train' ELSE 'test' END AS role, c.fold
FROM d JOIN c ON d.day <= c.cut OR (d.day > c.cut AND (c.hi IS NULL OR d.day <= c.hi))""")
def v5_walk_forward(spark, sf):
    import datetime as dt
    o = read_table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    cuts = [dt.date(1997, 1, 1), dt.date(1998, 1, 1), dt.date(1999, 1, 1)]
    return V.walk_forward(o, "day", cuts)


@register("v6_class_weights", """
WITH c AS (SELECT toxic AS label, count(*) AS count FROM labels GROUP BY 1)
SELECT label, count, round((SELECT sum(count) FROM c) / ((SELECT count(*) FROM c) * count), 6) AS weight,
  round((SELECT max(count) FROM c) / (SELECT min(count) FROM c), 6) AS imbalance_ratio FROM c""")
def v6_class_weights(spark, sf):
    return finish(V.class_weights(read_table(spark, sf, "labels"), "toxic"))


@register("v7_oversample", """
WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1), m AS (SELECT max(n) AS mx FROM c)
SELECT l.doc_id, l.quality, l.toxic, CAST(g.copy AS INTEGER) AS copy FROM labels l JOIN c ON l.toxic = c.toxic, m,
  generate_series(1, CAST(floor(m.mx / c.n) AS BIGINT)) AS g(copy)""")
def v7_oversample(spark, sf):
    return V.oversample(read_table(spark, sf, "labels"), "toxic")


@register("v8_synthetic_minority")
def v8_synthetic_minority(spark, sf):
    lab = read_table(spark, sf, "labels")
    doc = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    j = lab.join(doc, "doc_id").select("toxic", F.col("n_chars").cast("double").alias("n_chars"),
                                      F.col("quality").cast("double").alias("quality"))
    return V.synthetic_minority(j, "toxic", ["n_chars", "quality"], 1, k=3)
