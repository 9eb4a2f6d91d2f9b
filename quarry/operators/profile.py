"""Table profiling.

The profile is built from a fixed number of distributed passes, whatever the
number of rows:

* one value-count table ``groupBy(column, value).count()`` over the stacked
  columns (distinct counts, top values, class balance, samples), combined
  map-side so a dominant value costs nothing extra,
* the text columns' parse ratios from that table: every distinct value is
  parsed once and weighs as often as it occurs; they settle the types,
* one aggregation with the moments of the columns that hold numbers (pass A),
* exact quantiles of those columns through ``stats.quantiles_df`` (bands
  around the ranks).

Results are small per-column tables (one row per column or per
column x top-value) and stay lazy DataFrames; only decisions that pick
columns (correlation pairs, signals) collect those bounded tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.scalars import to_number, to_timestamp_safe
from quarry.operators.ordered import lag_join, row_index
from quarry.session import keep_table
from quarry.operators.stats import quantiles_df, stack

# File extensions that make a column a file path.
PATH_PATTERN = r"(?i)\.(jpg|jpeg|png|gif|bmp|tiff|webp|csv|json|txt)$"

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                  T.DecimalType, T.BooleanType)
_TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, _NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, _TIME_TYPES):
        return "datetime"
    if isinstance(dt, T.StringType):
        return "string"
    return "other"


def _num(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.BooleanType):
        return c.cast("double")
    if isinstance(dt, _NUMERIC_TYPES):
        x = c.cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
    if isinstance(dt, T.StringType):
        return to_number(c)
    return F.lit(None).cast("double")


def _text(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


def profileable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if _kind(f.dataType) != "other"]


def _text_stats(vc: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per text column of a value-count table: (name, nr, dr, sl, pr, avg_len) shares of the
    non-null rows that are numbers, dates, hold a date's separator or end like a path, and
    their mean length.  Each distinct value is parsed once and counts ``n`` times."""
    v, n = F.col("value"), F.col("n")
    sep = v.contains("-") | v.contains("/")
    rows = F.sum(n)
    share = lambda flag: F.sum(F.when(flag, n).otherwise(F.lit(0))) / rows
    # a date needs a '-' or '/' (bare numbers parse as years in Spark)
    return vc.where(F.col("column").isin(*cols)).groupBy(F.col("column").alias("name")).agg(
        share(to_number(v).isNotNull()).alias("nr"),
        share(sep & to_timestamp_safe(v).isNotNull()).alias("dr"), share(sep).alias("sl"),
        share(v.rlike(PATH_PATTERN)).alias("pr"), (F.sum(F.length(v) * n) / rows).alias("avg_len"))


def _pass_a(df: DataFrame, numbers: Sequence[str], sketches: bool) -> DataFrame:
    """(name, rows, seen, moments...) of the columns that hold numbers, one row per column;
    ``seen`` counts the values but not-a-number, the moments leave infinite ones out.  With
    ``sketches`` also approximate distinct counts and quartiles.

    The columns are stacked and aggregated by name: one compact aggregate that whole-stage
    codegen handles for any number of columns (a single aggregate holding a dozen functions
    per column outgrows the generated-code limits on wide tables)."""
    def value(c: str) -> Column:
        dt = df.schema[c].dataType
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            return F.nanvl(_q(c).cast("double"), F.lit(None).cast("double"))
        return _num(_q(c), dt)

    v = F.col("v")
    x = F.when(F.abs(v) != F.lit(float("inf")), v)
    long = stack(df, numbers, [value(c) for c in numbers], value="v").select("column", "v", x.alias("x"))
    x = F.col("x")
    aggs = [F.count(F.lit(1)).alias("rows"), F.count(v).alias("seen"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
            F.skewness(x).alias("skew_pop"), F.count(x).alias("n_num")]
    if sketches:
        aggs += [F.approx_count_distinct(x, rsd=0.01).alias("approx_unique"),
                 F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000).alias("approx_q")]
    return long.groupBy(F.col("column").alias("name")).agg(*aggs)


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) over non-null values, values as text.  Values are
    grouped in their own type (integers, doubles, text: one stack of the
    columns of a type each) and only the distinct survivors are formatted as text."""
    groups: dict[str, list] = {"long": [], "double": [], "string": []}
    for c in cols:
        dt, col = df.schema[c].dataType, _q(c)
        if isinstance(dt, _INTEGRAL):
            groups["long"].append((c, col.cast("long")))
        elif isinstance(dt, T.DecimalType):
            # a decimal's text tells all its digits apart; as double they would merge
            groups["string"].append((c, col.cast("string")))
        elif isinstance(dt, (T.DoubleType, T.FloatType)):
            d = col.cast("double")
            groups["double"].append((c, F.when(~F.isnan(d), d)))
        else:
            groups["string"].append((c, _text(col, dt)))
    out = None
    for made in groups.values():
        if made or (out is None and made is groups["string"]):
            long = stack(df, [c for c, _ in made], [v for _, v in made], value="v").where(F.col("v").isNotNull())
            g = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")).select(
                "column", F.col("v").cast("string").alias("value"), "n")
            out = g if out is None else out.unionAll(g)
    return out


def _semantic_type(c=F.col) -> Column:
    """P3 precedence: empty, datetime, numeric, filepath, text, categorical,
    high_cardinality (typed columns map directly)."""
    nn, nr, uniq = c("non_null"), c("nr"), c("unique")
    is_date = (nr < 0.7) & (c("dr") >= 0.8) & (c("sl") > 0)
    is_text = (c("avg_len") > 40) & (nr < 0.3)
    is_path = (c("avg_len") > 5) & (c("pr") > 0.5)
    return (F.when(nn == 0, "empty")
            .when(c("kind") == "numeric", "numeric")
            .when(c("kind") == "datetime", "datetime")
            .when(is_date, "datetime")
            .when(nr > 0.8, "numeric")
            .when(is_path, "filepath")
            .when(is_text, "text")
            .when(uniq / F.greatest(nn, F.lit(1)) < 0.05, "categorical")
            .otherwise("high_cardinality"))


def profile_columns(df: DataFrame, cols: Sequence[str] | None = None, order_by: Sequence | None = None,
                    quantiles: bool = True, top: int = 5, vc: DataFrame | None = None,
                    exact: bool = True) -> DataFrame:
    """P1-P8 per-column profile (one row per column).

    Columns: position, name, type, unique, nulls, null_pct, sample, mean, std,
    min, max, p25, p50, p75, skew, serial_corr, top_values, majority_pct,
    avg_len, text_sample.  ``serial_corr`` needs ``order_by`` (row order).
    With ``exact=False`` numeric columns take their distinct count from a
    HyperLogLog sketch and their quartiles from ``percentile_approx``, both in
    the single statistics pass; only text and datetime columns go through the
    value-count table."""
    cols = list(cols or profileable(df))
    spark = df.sparkSession
    kinds = {c: _kind(df.schema[c].dataType) for c in cols}
    vc_cols = cols if exact else [c for c in cols if kinds[c] != "numeric"]
    if vc is None:
        # counted once: distinct counts, top values and samples all read the kept table
        vc = keep_table(value_counts(df, vc_cols), "value-counts") if vc_cols else spark.createDataFrame(
            [], "column string, value string, n long")
    # one row per column, whatever the table holds (bounded by the column count)
    names = spark.createDataFrame([(i, c, kinds[c]) for i, c in enumerate(cols)],
                                  "position int, name string, kind string")
    text_cols = [c for c in cols if kinds[c] == "string"]
    typed = names.join(vc.groupBy(F.col("column").alias("name")).agg(
        F.count(F.lit(1)).alias("unique"), F.sum("n").alias("non_null")), "name", "left")
    ratios = ("nr", "dr", "sl", "pr", "avg_len")
    if text_cols:
        typed = typed.join(_text_stats(vc, text_cols), "name", "left")
    else:
        typed = typed.withColumns({c: F.lit(None).cast("double") for c in ratios})
    typed = spark.createDataFrame(
        typed.select("position", "name", "kind", "unique", "non_null", *ratios).collect(),
        "position int, name string, kind string, unique long, non_null long, " + ", ".join(f"{c} double" for c in ratios))
    # a text column's type is settled by its values; only numeric ones have moments and quartiles
    settled = typed.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("unique", "non_null")})
    parsed = {r["name"] for r in settled.where((F.col("kind") == "string") & (_semantic_type() == "numeric")).collect()}
    numbers = [c for c in cols if kinds[c] == "numeric" or c in parsed]
    # the table is read once for it; the joins below take its one row per column
    a = _pass_a(df, numbers, sketches=not exact)
    found = a.collect()
    rows = found[0]["rows"] if found else df.count()
    prof = typed.join(spark.createDataFrame(found, a.schema).drop("rows"), "name", "left").withColumn("rows", F.lit(rows))
    counted = F.when(F.col("kind") == "numeric", F.col("seen")).otherwise(F.col("non_null"))
    prof = prof.withColumn("non_null", counted).withColumns(
        {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("non_null", "n_num")})
    fallback = F.lit(0) if exact else F.coalesce("approx_unique", F.lit(0))
    prof = prof.withColumn("unique", F.coalesce("unique", fallback))
    prof = prof.withColumn("type", _semantic_type())
    if quantiles and not exact:
        prof = prof.withColumns({k: F.col("approx_q")[i] for i, k in enumerate(("p25", "p50", "p75"))})
    elif quantiles and numbers:
        q = quantiles_df(df, numbers, [0.25, 0.5, 0.75])
        qp = q.groupBy(F.col("column").alias("name")).agg(
            *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(a_)
              for p, a_ in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
        prof = prof.join(qp, "name", "left")
    else:
        prof = prof.withColumns({k: F.lit(None).cast("double") for k in ("p25", "p50", "p75")})
    # top values and samples: bounded per column
    # top values are reported for categorical / high-cardinality types, which
    # only text columns can have: numeric value counts are not ranked
    text_vc = vc.where(F.col("column").isin(*text_cols)) if text_cols else vc.limit(0)
    topagg = smallest_per_column(text_vc, F.struct((-F.col("n")).alias("m"), "value"), top).select(
        F.col("column").alias("name"),
        F.transform("least", lambda s: F.struct(s["value"].alias("value"), (-s["m"]).alias("n"))).alias("_top"))
    smp = smallest_per_column(vc, F.struct("value"), 3).select(F.col("column").alias("name"), F.col("least").alias("_smp"))
    prof = prof.join(topagg, "name", "left").join(smp, "name", "left")
    if order_by is not None:
        sc = serial_correlation(df, [c for c in cols if _kind(df.schema[c].dataType) in ("numeric", "string")],
                                order_by)
        prof = prof.join(sc.withColumnRenamed("column", "name"), "name", "left")
    else:
        prof = prof.withColumn("serial_corr", F.lit(None).cast("double"))
    is_num = F.col("type") == "numeric"
    is_cat = F.col("type").isin("categorical", "high_cardinality")
    is_text = F.col("type") == "text"
    r4 = lambda c: F.when(is_num, F.round(F.col(c), 4))
    n = F.col("n_num")
    skew = F.when(n > 2, F.col("skew_pop") * F.sqrt(n * (n - 1)) / (n - 2))
    return prof.select(
        "position", "name", "type", F.col("unique").cast("long").alias("unique"),
        (F.col("rows") - F.col("non_null")).alias("nulls"),
        F.round((F.col("rows") - F.col("non_null")) * 100.0 / F.nullif(F.col("rows"), F.lit(0)), 1).alias("null_pct"),
        F.transform("_smp", lambda s: s["value"]).alias("sample"),
        r4("mean").alias("mean"), r4("std").alias("std"), r4("min").alias("min"), r4("max").alias("max"),
        r4("p25").alias("p25"), r4("p50").alias("p50"), r4("p75").alias("p75"),
        F.when(is_num, F.round(skew, 3)).alias("skew"),
        F.when(is_num, F.round(F.col("serial_corr"), 3)).alias("serial_corr"),
        F.when(is_cat, F.transform("_top", lambda s: F.struct(s["value"].alias("value"), s["n"].alias("n"))))
        .alias("top_values"),
        F.when(is_cat, F.round(F.col("_top")[0]["n"] * 100.0 / F.col("non_null"), 1)).alias("majority_pct"),
        F.when(is_text, F.round(F.col("avg_len"), 1)).alias("avg_len"),
        F.when(is_text, F.substring(F.col("_smp")[0]["value"], 1, 200)).alias("text_sample"),
    )


def smallest_per_column(vc: DataFrame, key: Column, k: int) -> DataFrame:
    """(column, least): the ``k`` smallest distinct keys of each column in order.

    Found one after the other as minima above the last one: ``k`` aggregates that combine
    before the shuffle (one row per column and task) instead of a sort of all values.
    The joined side has one row per column, which bounds the broadcast."""
    rows = vc.select("column", key.alias("key"))
    step = rows.groupBy("column").agg(F.min("key").alias("low"))
    steps = [step]
    for _ in range(k - 1):
        step = (rows.join(F.broadcast(step), "column").where(F.col("key") > F.col("low"))
                .groupBy("column").agg(F.min("key").alias("low")))
        steps.append(step)
    out = steps[0]
    for s in steps[1:]:
        out = out.unionAll(s)
    return out.groupBy("column").agg(F.array_sort(F.collect_list("low")).alias("least"))


def serial_correlation(df: DataFrame, cols: Sequence[str], order_by: Sequence) -> DataFrame:
    """P6 lag-1 autocorrelation of each column's non-null numeric values in row
    order; 0 when 2 or fewer values.  Returns (column, serial_corr)."""
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    items = [F.struct(F.lit(c).alias("column"), _num(_q(c), df.schema[c].dataType).alias("x"),
                      F.struct(*order).alias("_o")) for c in cols]
    long = df.select(F.explode(F.array(*items)).alias("_s")).select("_s.*").where(F.col("x").isNotNull())
    ix = row_index(long, ["_o"], ["column"], name="_i")
    pairs = lag_join(ix, ["column"], "_i", "x", 1, "_prev")
    return pairs.groupBy("column").agg(
        F.when(F.count("x") > 2, F.corr("_prev", "x")).otherwise(F.lit(0.0)).alias("serial_corr"))


def class_balance(df: DataFrame, cols: Sequence[str] | None = None, vc: DataFrame | None = None,
                  max_classes: int = 20) -> DataFrame:
    """P9 normalised shares (3 digits) for columns with 2..20 distinct values:
    (column, value, share)."""
    cols = list(cols or profileable(df))
    vc = vc if vc is not None else value_counts(df, cols)
    per = vc.groupBy("column").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("tot"))
    ok = per.where((F.col("k") > 1) & (F.col("k") <= max_classes))
    return vc.join(ok, "column").select("column", "value",
                                        F.round(F.col("n") / F.col("tot"), 3).alias("share"))


def id_like_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Columns whose distinct count exceeds ``threshold`` x rows (one agg)."""
    if not cols:
        return []
    rows = df.count()
    # distinct counts from one stacked value-count table (no per-column Expand)
    d = {r["column"]: r["d"] for r in value_counts(df, cols).groupBy("column").agg(
        F.count(F.lit(1)).alias("d")).collect()}
    return [c for c in cols if rows and d.get(c, 0) / rows > threshold]


def top_correlations(df: DataFrame, numeric_cols: Sequence[str], k: int = 8,
                     exclude_id_like: bool = True) -> DataFrame:
    """P10 top-k absolute pairwise Pearson correlations (pairwise-complete),
    ids excluded: (col1, col2, corr, rank).  One pass over the table (``pairwise_corr``)."""
    cols = list(numeric_cols)
    if exclude_id_like:
        ids = set(id_like_columns(df, cols))
        cols = [c for c in cols if c not in ids]
    if len(cols) < 2:
        schema = "col1 string, col2 string, corr double, rank int"
        return df.sparkSession.createDataFrame([], schema)
    xs = [to_number(_q(c)) if isinstance(df.schema[c].dataType, T.StringType) else _q(c).cast("double") for c in cols]
    m = np.abs(pairwise_corr(df, xs))
    found = [(cols[i], cols[j], float(m[i, j]), i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))
             if np.isfinite(m[i, j])]
    found.sort(key=lambda t: (-t[2], t[3], t[4]))
    rows = [(a, b, v, r) for r, (a, b, v, _, _) in enumerate(found[:k], start=1)]
    return df.sparkSession.createDataFrame(rows, "col1 string, col2 string, corr double, rank int").withColumn(
        "corr", F.round("corr", 3))


def pairwise_corr(df: DataFrame, xs: Sequence[Column]) -> np.ndarray:
    """Pearson correlations of all column pairs over the rows where both are present (nan
    where undefined; not-a-number values count as missing).

    Every task adds up the products of its rows as n x n matrices and the driver adds one
    such set per task, so the cost is one pass for any number of columns.  Values are
    centred on their column's mean first."""
    n = len(xs)
    named = df.select(*[F.nanvl(x.cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, x in enumerate(xs)])
    means = named.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(n)]).first()
    mu = [m if m is not None and math.isfinite(m) else 0.0 for m in means]
    arr = named.select(F.array(*[F.col(f"c{i}") - F.lit(mu[i]) for i in range(n)]).alias("v"))

    def add_up(batches):
        import numpy as np
        import pandas as pd
        total = np.zeros((5, n, n))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["v"].tolist(), dtype=float).reshape(len(pdf), n)
            here = np.isfinite(x)
            x = np.where(here, x, 0.0)
            w = here.astype(float)
            total += np.stack([w.T @ w, x.T @ w, w.T @ x, (x * x).T @ w, x.T @ x])
        yield pd.DataFrame({"m": [total.tobytes()]})

    total = np.zeros((5, n, n))
    for r in arr.mapInPandas(add_up, "m binary").toLocalIterator():     # 5 n^2 numbers per task
        total += np.frombuffer(r["m"]).reshape(5, n, n)
    c, sx, sy, sxx, sxy = total
    syy = sxx.T
    with np.errstate(all="ignore"):
        cov = sxy - sx * sy / c
        vx, vy = sxx - sx * sx / c, syy - sy * sy / c
        # what rounding leaves of a constant is no variance
        flat = (vx <= 1e-14 * sxx) | (vy <= 1e-14 * syy) | (c < 2)
        out = np.where(flat, np.nan, cov / np.sqrt(vx * vy))
    return np.clip(out, -1.0, 1.0)


def top_features_by_corr(df: DataFrame, target: str, features: Sequence[str], k: int = 20) -> DataFrame:
    """K3 features ranked by |corr with the target| (one aggregate), top k."""
    x = lambda c: _q(c).cast("double")
    items = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), F.abs(F.corr(x(c), x(target))).alias("abs_corr"))
             for i, c in enumerate(features)]
    long = df.agg(F.array(*items).alias("a")).select(F.explode("a").alias("a")).select("a.*")
    w = Window.orderBy(F.desc_nulls_last("abs_corr"), "pos")  # one row per feature: bounded
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "feature", "abs_corr", "rank")


def correlation_matrix(df: DataFrame, target: str, features: Sequence[str], k: int = 20) -> DataFrame:
    """P18 pairwise correlations among the target and its top-k features by
    |corr with target|: (col1, col2, corr) for all ordered pairs."""
    names = [target, *features]
    m = pairwise_corr(df, [_q(c).cast("double") for c in names])
    order = sorted((i for i in range(1, len(names)) if np.isfinite(m[0, i])), key=lambda i: (-abs(m[0, i]), i))[:k]
    keep = [0, *order]
    rows = [(names[a], names[b], float(m[a, b]) if np.isfinite(m[a, b]) else None) for a in keep for b in keep]
    return df.sparkSession.createDataFrame(rows, "col1 string, col2 string, corr double")


# Well-known target column names.
TARGET_NAMES = ("churn", "target", "label", "class", "y", "outcome", "default", "fraud", "survived",
                "response", "converted", "clicked", "purchased", "defaulted", "attrition", "cancelled",
                "retained", "approved", "spam", "toxic", "sentiment", "result", "status", "success")
# Identifier names and suffixes.
ID_EXACT = ("id", "index", "row_id", "rowid", "record_id")
CAT_ID_EXACT = ("name", "id", "code", "key", "uuid", "uid", "rowid", "row_id", "index")
CAT_ID_SUFFIXES = ("_name", "_code", "_key", "_id", "_num", "_no", "_number")


def flags(profile: DataFrame, rows: int | Column) -> DataFrame:
    """P13 id-like (numeric) and identifier-like (categorical) flags."""
    lo = F.lower("name")
    rows_c = F.lit(rows) if isinstance(rows, int) else rows
    id_like = (F.col("type") == "numeric") & (lo.isin(*ID_EXACT) | lo.endswith("id")
                                              | (F.col("unique") / rows_c > 0.95))
    cat_id = lo.isin(*CAT_ID_EXACT)
    for s in CAT_ID_SUFFIXES:
        cat_id = cat_id | lo.endswith(s)
    return profile.withColumns({"id_like": id_like, "categorical_identifier": cat_id})


def target_candidates(profile: DataFrame, rows: int | Column, k: int = 5) -> DataFrame:
    """P12 known names (score 0), categoricals with 2..50 values not
    identifier-like (1), numerics with >10 values not id-like (2); top k by
    (score, position).  The profile has one row per column, so the ranking
    window is bounded by the column count."""
    p = flags(profile, rows)
    lo = F.lower("name")
    known = lo.isin(*TARGET_NAMES)
    cat = F.col("type").isin("categorical", "high_cardinality") & F.col("unique").between(2, 50) \
        & ~F.col("categorical_identifier")
    num = (F.col("type") == "numeric") & (F.col("unique") > 10) & ~F.col("id_like")
    score = F.when(known, 0).when(cat, 1).when(num, 2)
    c = p.withColumn("score", score).where(F.col("score").isNotNull())
    w = Window.orderBy("score", "position")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "name", "score", "rank")


def statistical_id(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P14 a column is an id if distinct/rows > 0.9 or its integers step by 1
    from 0 or 1 (min in (0,1), max-min+1 = count = distinct, no sort)."""
    items = []
    for c in cols:
        x = _q(c)
        isint = isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        items.append(F.struct(F.lit(c).alias("name"), F.count(x).alias("n"),
                              (F.min(x).cast("double") if isint else F.lit(None).cast("double")).alias("mn"),
                              (F.max(x).cast("double") if isint else F.lit(None).cast("double")).alias("mx")))
    a = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*items).alias("s"))
    e = a.select("rows", F.explode("s").alias("s")).select("rows", "s.*")
    d = value_counts(df, cols).groupBy(F.col("column").alias("name")).agg(F.count(F.lit(1)).alias("d"))
    e = e.join(d, "name", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    seq = F.col("mn").isin(0.0, 1.0) & (F.col("mx") - F.col("mn") + 1 == F.col("n")) & (F.col("n") == F.col("d"))
    return e.select("name", ((F.col("d") / F.col("rows") > 0.9) | F.coalesce(seq, F.lit(False))).alias("is_id"))


def infer_objective(profile: DataFrame, rows: int | Column, task: str | None = None) -> DataFrame:
    """P15 rule-based objective: target, task, metric and direction, one row.

    The target is the first candidate (P12), else the last numeric column, else the last
    column.  ``task`` states a task that the target's type cannot tell (``forecasting``,
    ``clustering``); an empty profile gives no row."""
    first = target_candidates(profile, rows).where(F.col("rank") == 1).select(F.col("name").alias("first"))
    p = profile.join(first, profile["name"] == first["first"], "left")
    order = (F.when(F.col("first").isNotNull(), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
             .when(F.col("type") == "numeric", F.struct(F.lit(1).alias("a"), (-F.col("position")).alias("b")))
             .otherwise(F.struct(F.lit(2).alias("a"), (-F.col("position")).alias("b"))))
    best = p.agg(F.min_by(F.struct("name", "type", "unique"), order).alias("t")).where("t IS NOT NULL").select(
        F.col("t.name").alias("target"), F.col("t.type").alias("type"), F.col("t.unique").alias("unique"))
    cat = F.col("type").isin("categorical", "high_cardinality")
    inferred = (F.when(cat & (F.col("unique") <= 2), "binary_classification")
                .when(cat & (F.col("unique") <= 20), "multiclass_classification")
                .otherwise("regression"))
    best = best.withColumn("task", F.lit(task) if task else inferred)
    metric = (F.when(F.col("task") == "binary_classification", "auc")
              .when(F.col("task") == "multiclass_classification", "f1")
              .when(F.col("task") == "forecasting", "mape")
              .when(F.col("task") == "clustering", "silhouette").otherwise("rmse"))
    higher = F.col("task").contains("classification") | (F.col("task") == "clustering")
    return best.select("target", "task", metric.alias("metric"),
                       F.when(higher, "higher_is_better").otherwise("lower_is_better").alias("direction"))


def signals(profile: DataFrame, balance: DataFrame) -> DataFrame:
    """P11 dataset signals as rows (signal, detail): text present,
    datetime+numeric (serial corr > 0.5 columns), file paths, imbalance > 85 %,
    else tabular."""
    spark = profile.sparkSession
    p = profile.select("name", "type", "serial_corr").collect()  # one row per column
    text = [r["name"] for r in p if r["type"] == "text"]
    dt = [r["name"] for r in p if r["type"] == "datetime"]
    num = [r["name"] for r in p if r["type"] == "numeric"]
    fp = [r["name"] for r in p if r["type"] == "filepath"]
    out = []
    if text:
        out.append(("text_columns", ",".join(text)))
    if dt and num:
        hi = [r["name"] for r in p if r["serial_corr"] is not None and abs(r["serial_corr"]) > 0.5]
        out.append(("datetime_numeric", ",".join(hi)))
    if fp:
        out.append(("filepath_columns", ",".join(fp)))
    imb = balance.groupBy("column").agg(F.max("share").alias("m")).where(F.col("m") > 0.85).orderBy("column")
    for r in imb.collect():  # at most one row per column
        out.append(("imbalanced_target", f"{r['column']}:{r['m']}"))
    if not out:
        out.append(("tabular", ""))
    return spark.createDataFrame(out, "signal string, detail string")


def notable_trait(profile: DataFrame, balance: DataFrame, sig: DataFrame, target: str, rows: int) -> DataFrame:
    """P11 the single most notable trait, first rule that holds: the target's
    majority class above 70 % (or an imbalance signal), a datetime signal,
    more than 50 columns, more than 100 000 rows, mostly numeric features,
    categorical features, else plain.  One row (trait, detail)."""
    spark = profile.sparkSession
    top = (balance.where(F.col("column") == target).orderBy(F.desc("share"), "value").limit(1).collect())
    share, major = (top[0]["share"], top[0]["value"]) if top else (0.0, "")
    names = {r["signal"] for r in sig.collect()}  # a handful of rows
    types = [r["type"] for r in profile.select("type").collect()]  # one row per column
    n_num = sum(t == "numeric" for t in types)
    n_cat = sum(t in ("categorical", "high_cardinality") for t in types)
    if (share > 0.7 or "imbalanced_target" in names) and share > 0:
        row = ("class_imbalance", f"{target}={major}:{share}")
    elif "datetime_numeric" in names:
        row = ("time_structure", "")
    elif len(types) > 50:
        row = ("high_dimensional", str(len(types)))
    elif rows > 100_000:
        row = ("large", str(rows))
    elif n_num and n_num > n_cat:
        row = ("mostly_numeric", str(n_num))
    elif n_cat:
        row = ("categorical", str(n_cat))
    else:
        row = ("plain", "")
    return spark.createDataFrame([row], "trait string, detail string")


def profile(df: DataFrame, order_by: Sequence | None = None) -> dict:
    """P1 the full profile as a dict of small DataFrames (lazy)."""
    cols = profileable(df)
    vc = keep_table(value_counts(df, cols), "value-counts")
    prof = profile_columns(df, cols, order_by=order_by, vc=vc)
    bal = class_balance(df, cols, vc=vc)
    return {"columns": prof, "class_balance": bal}
