"""Chart data (P19-P24): small result tables computed by aggregates.

All chart shapes are bounded by the limit asked for (20 groups unless stated, <= 30 bins,
12 months), and every aggregate runs with map-side combining, so a dominant group costs
no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.scalars import to_number

AGGS = {"sum": F.sum, "mean": F.avg, "count": F.count, "max": F.max, "min": F.min}


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def grouped(df: DataFrame, x: str, y: str, agg: str = "sum", sort: str = "none", limit: int = 20) -> DataFrame:
    """P19 ``groupBy(x).agg(y)``, null keys dropped; sort by value asc/desc or
    by key; at most ``limit`` groups.  Ties break on the key."""
    yv = _q(y) if agg == "count" else (_q(y) if not isinstance(df.schema[y].dataType, T.StringType)
                                       else to_number(_q(y)))
    g = df.where(_q(x).isNotNull()).groupBy(_q(x).alias("label")).agg(AGGS[agg](yv).alias("value"))
    if sort == "desc":
        g = g.orderBy(F.desc_nulls_last("value"), F.asc("label"))
    elif sort == "asc":
        g = g.orderBy(F.asc_nulls_last("value"), F.asc("label"))
    else:
        g = g.orderBy("label")
    return g.limit(limit)


def value_counts_top(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """P21 pie / counts: the ``limit`` most frequent non-null values."""
    return (df.where(_q(column).isNotNull()).groupBy(_q(column).alias("label"))
            .agg(F.count(F.lit(1)).alias("value")).orderBy(F.desc("value"), F.asc("label")).limit(limit))


def raw_pairs(df: DataFrame, x: str, y: str, order_by: Sequence, limit: int = 20) -> DataFrame:
    """P22 the first ``limit * 10`` rows (in ``order_by``) with both values."""
    yv = to_number(_q(y)) if isinstance(df.schema[y].dataType, T.StringType) else _q(y).cast("double")
    return (df.where(_q(x).isNotNull() & _q(y).isNotNull()).orderBy(*order_by)
            .limit(limit * 10).select(_q(x).alias("label"), yv.alias("value")))


def histogram_bins(n: int) -> int:
    return min(30, max(10, n // 20))


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """P20 equal-width histogram with numpy's rules: ``bins`` defaults to
    min(30, max(10, n // 20)); range widened by 0.5 when min = max; bin i is
    [e_i, e_i+1) except the last, which is closed.  Output (bin, lo, hi,
    label, count) for every bin, empty ones included."""
    x = to_number(_q(column)) if isinstance(df.schema[column].dataType, T.StringType) else _q(column).cast("double")
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    st = vals.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not st["n"]:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, label string, count long")
    k = bins or histogram_bins(st["n"])
    lo, hi = float(st["lo"]), float(st["hi"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / k
    edges = [lo + i * step for i in range(k)] + [hi]  # numpy.linspace
    e = F.array(*[F.lit(v) for v in edges])
    raw = F.floor((F.col("x") - F.lit(lo)) * F.lit(k / (hi - lo))).cast("int")
    i0 = F.least(F.greatest(raw, F.lit(0)), F.lit(k - 1))
    # correct rounding at the edges exactly as numpy does
    i1 = F.when(F.col("x") < F.element_at(e, i0 + 1), i0 - 1).otherwise(i0)
    i2 = F.when((F.col("x") >= F.element_at(e, i1 + 2)) & (i1 != k - 1), i1 + 1).otherwise(i1)
    counts = vals.select(i2.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    frame = spark.range(k).select(F.col("id").cast("int").alias("bin"))
    out = frame.join(counts, "bin", "left").select(
        "bin", F.element_at(e, F.col("bin") + 1).alias("lo"), F.element_at(e, F.col("bin") + 2).alias("hi"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    return out.withColumn("label", F.format_string("%.2f-%.2f", "lo", "hi")).select(
        "bin", "lo", "hi", "label", "count")


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P23 numeric columns: min / max / mean; other columns: distinct count and
    top 3 values.  One row per column."""
    from quarry.operators.profile import value_counts
    from quarry.operators.stats import top_k_per_group
    spark = df.sparkSession
    num = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    cat = [c for c in columns if c not in num]
    parts = []
    if num:
        items = [F.struct(F.lit(c).alias("column"), F.min(_q(c)).cast("double").alias("min"),
                          F.max(_q(c)).cast("double").alias("max"), F.avg(_q(c)).alias("mean")) for c in num]
        parts.append(df.agg(F.array(*items).alias("s")).select(F.explode("s").alias("s")).select("s.*")
                     .withColumns({"n_distinct": F.lit(None).cast("long"), "top": F.lit(None).cast("string")}))
    if cat:
        vc = value_counts(df, cat)
        d = vc.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
        t = top_k_per_group(vc, ["column"], [F.desc("n"), F.asc("value")], 3, rank_name="r")
        t = t.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))),
                                                             lambda s: s["value"]), "|").alias("top"))
        parts.append(d.join(t, "column").select(
            "column", F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"),
            F.lit(None).cast("double").alias("mean"), "n_distinct", "top"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if parts else spark.createDataFrame([], "column string")


MONTHS = list(range(1, 13))


def seasonality(df: DataFrame, date: str, value: str) -> DataFrame:
    """P24 mean of ``value`` by year x month when there are >= 2 years and
    >= 2 months, else by weekday (Mon=0) x month.  Wide: (kind, row, m1..m12)."""
    d = _q(date)
    v = to_number(_q(value)) if isinstance(df.schema[value].dataType, T.StringType) else _q(value).cast("double")
    base = df.select(F.year(d).alias("y"), F.month(d).alias("m"), F.weekday(d).alias("dow"), v.alias("v")) \
        .where(F.col("m").isNotNull())
    ym = base.groupBy("y", "m").agg(F.count(F.lit(1)).alias("_n"))  # at most years x 12 rows
    st = ym.agg(F.count_distinct("y").alias("ny"), F.count_distinct("m").alias("nm")).first()
    by_year = st["ny"] >= 2 and st["nm"] >= 2
    row = "y" if by_year else "dow"
    wide = base.groupBy(F.col(row).alias("row")).pivot("m", MONTHS).agg(F.avg("v"))
    return wide.select(F.lit("year" if by_year else "weekday").alias("kind"), "row",
                       *[F.col(str(m)).alias(f"m{m}") for m in MONTHS])
