"""Distributed exact statistics.

``percentile``/``median``/``mode`` aggregates keep every distinct value of a
group in one buffer, and a global aggregate merges them in one task.  At
scale the library computes them instead as:

* exact quantiles: stack the columns to (column, x); a mergeable sketch
  brackets each needed rank in a narrow value band, one aggregation counts
  the values below each band and the distinct values inside the bands (one
  output row per value: a value's interval among the band bounds tells which
  bands it lies below), and the exact order statistics are read off that
  small table (the verified fallback counts every distinct value and takes a
  skew-safe running count over them);
* mode: ``groupBy(value).count()`` (map-side combined) and a top-1;
* top-k per group: a salted two-stage ranking so no group is ranked in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.scalars import to_number
from quarry.operators.ordered import join_null_safe, row_index, running
from quarry.session import cut_lineage


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _as_double(df: DataFrame, c: str, coerce: bool) -> Column:
    """Numeric columns cast directly; text is parsed only when ``coerce``."""
    is_text = isinstance(df.schema[c].dataType, T.StringType)
    return to_number(_q(c)) if (coerce and is_text) else _q(c).cast("double")


def stack(df: DataFrame, names: Sequence[str], values: Sequence[Column], by: Sequence[str] = (),
          value: str = "x") -> DataFrame:
    """(by..., column, value) one row per row of ``df`` and name.

    The values, all of one type, go into one plain array: a struct with the name for every
    value makes generated methods that the JVM no longer compiles on a dozen columns."""
    if not names:
        return df.select(*[_q(b) for b in by], F.lit("").alias("column"), F.lit(None).cast("double").alias(value)).limit(0)
    long = df.select(*[_q(b) for b in by], F.posexplode(F.array(*values)).alias("_pos", value))
    name = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("_pos") + 1)
    return long.select(*[_q(b) for b in by], name.alias("column"), value)


def stack_numeric(df: DataFrame, cols: Sequence[str], coerce: bool = True) -> DataFrame:
    """(column, x) rows for every non-null numeric value of ``cols``."""
    return _stack(df, cols, coerce, ())


def _stack(df: DataFrame, cols: Sequence[str], coerce: bool, by: Sequence[str]) -> DataFrame:
    long = stack(df, cols, [_as_double(df, c, coerce) for c in cols], by)
    return long.where(F.col("x").isNotNull() & ~F.isnan("x"))


def _interpolate(keys, both: DataFrame) -> DataFrame:
    val = F.col("_xlo") + (F.col("_h") - F.col("_lo")) * (F.col("_xhi") - F.col("_xlo"))
    return both.select(*keys, "p", val.alias("value"))


def _targets(n: DataFrame, keys, probs) -> DataFrame:
    ps = F.array(*[F.lit(float(p)) for p in probs])
    return (n.select(*keys, "_n", F.explode(ps).alias("p"))
            .withColumn("_h", (F.col("_n") - 1) * F.col("p"))
            .withColumn("_lo", F.floor("_h").cast("long"))
            .withColumn("_hi", F.ceil("_h").cast("long")))


def quantiles_by_sort(df: DataFrame, cols: Sequence[str], probs: Sequence[float], coerce: bool = True,
                      by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles from all distinct values: values are counted per
    (group, value) first (a dominant value becomes one row), a running count
    over the distinct values in order (range-partitioned, skew-safe) gives
    each value's last rank, and the order statistics are the first values
    whose running count passes the needed ranks.  Deterministic throughout."""
    long = _stack(df, cols, coerce, by)
    keys = [*by, "column"]
    vc = long.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("_c"))
    cum = running(vc, keys, ["x"], [("_cum", "sum", "_c")])
    n = vc.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    targets = _targets(n, keys, probs)
    cand = join_null_safe(cum, targets.select(*keys, "p", "_lo", "_hi"), keys)
    picks = cand.groupBy(*keys, "p").agg(
        F.min(F.when(F.col("_cum") > F.col("_lo"), F.col("x"))).alias("_xlo"),
        F.min(F.when(F.col("_cum") > F.col("_hi"), F.col("x"))).alias("_xhi"))
    return _interpolate(keys, join_null_safe(targets, picks, [*keys, "p"], "left"))


def quantiles_df(df: DataFrame, cols: Sequence[str], probs: Sequence[float], coerce: bool = True,
                 by: Sequence[str] = (), accuracy: int = 100_000) -> DataFrame:
    """Exact linear-interpolation quantiles: rows (by..., column, p, value).

    Selection instead of a sort: a mergeable sketch (``percentile_approx``,
    rank error <= n / accuracy) brackets each needed rank in a value band
    [lo, hi]; one aggregation then counts the values below the band and the
    distinct values inside it, and a running count over the band's distinct
    values (a small table) finds the exact order statistics.  Every bracket
    is verified; a group whose bracket misses falls back to the full sort."""
    long = _stack(df, cols, coerce, by)
    keys = [*by, "column"]
    fast = _quantiles_small_band(long, keys, probs, accuracy)
    if fast is not None:
        return fast
    d = 3.0 / accuracy
    lo_p = [max(0.0, p - d) for p in probs]
    hi_p = [min(1.0, p + d) for p in probs]
    sk = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("x").alias("_min"), F.max("x").alias("_max"),
        F.percentile_approx("x", F.array(*[F.lit(v) for v in lo_p + hi_p]), accuracy).alias("_a"))
    k = len(probs)
    rows = []
    for i, p in enumerate(probs):
        lo = F.col("_min") if lo_p[i] == 0.0 else F.col("_a")[i]
        hi = F.col("_max") if hi_p[i] == 1.0 else F.col("_a")[k + i]
        rows.append(F.struct(F.lit(float(p)).alias("p"), lo.alias("_blo"), hi.alias("_bhi")))
    targets = _targets(sk.select(*keys, "_n"), keys, probs)
    bands = sk.select(*keys, F.explode(F.array(*rows)).alias("_t")).select(*keys, "_t.*")
    targets = join_null_safe(targets, bands, [*keys, "p"])
    j = join_null_safe(long, targets.select(*keys, "p", "_blo", "_bhi"), keys)
    cell = F.when(F.col("x") < F.col("_blo"), F.lit(None)).otherwise(F.col("x"))
    agg = (j.where(F.col("x") <= F.col("_bhi")).groupBy(*keys, "p", cell.alias("bx"))
           .agg(F.count(F.lit(1)).alias("_c")))
    below = agg.where(F.col("bx").isNull()).select(*keys, "p", F.col("_c").alias("_below"))
    band = agg.where(F.col("bx").isNotNull())
    cum = running(band, [*keys, "p"], ["bx"], [("_cum", "sum", "_c")])
    t = join_null_safe(targets, below, [*keys, "p"], "left").withColumn("_below", F.coalesce("_below", F.lit(0)))
    # the order statistic of rank r is the first band value whose count reaches r + 1
    cand = join_null_safe(cum, t.select(*keys, "p", "_below", "_lo", "_hi"), [*keys, "p"])
    reach = F.col("_below") + F.col("_cum")
    picks = cand.groupBy(*keys, "p").agg(
        F.min(F.when(reach > F.col("_lo"), F.col("bx"))).alias("_xlo"),
        F.min(F.when(reach > F.col("_hi"), F.col("bx"))).alias("_xhi"),
        F.max(reach).alias("_reach"))
    ok = (F.col("_below") <= F.col("_lo")) & (F.col("_reach") > F.col("_hi"))
    # one row per group x probability: fixed once so the check and the result agree
    both = cut_lineage(join_null_safe(t, picks, [*keys, "p"], "left").withColumn("_ok", F.coalesce(ok, F.lit(False))))
    good = _interpolate(keys, both.where("_ok"))
    bad_groups = both.where(~F.col("_ok")).select(*keys).distinct()
    if bad_groups.limit(1).count() == 0:
        return good
    redo = quantiles_by_sort(join_null_safe(df, bad_groups.select(*by), list(by)) if by else df, cols, probs,
                             coerce, by)
    return good.unionByName(join_null_safe(redo, bad_groups, keys))


MAX_SMALL_ROWS = 200_000


def _quantiles_small_band(long: DataFrame, keys, probs, accuracy: int):
    """Fast path of the selection when the sketch table (one row per group)
    and the bands (distinct values near each rank) stay under
    MAX_SMALL_ROWS: both are counted first and only then collected, so the
    driver never receives more than that bound.  Returns None otherwise."""
    import math
    probs = sorted({float(p) for p in probs})
    d = 3.0 / accuracy
    lo_p = [max(0.0, p - d) for p in probs]
    hi_p = [min(1.0, p + d) for p in probs]
    sk = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("x").alias("_min"), F.max("x").alias("_max"),
        F.percentile_approx("x", F.array(*[F.lit(v) for v in lo_p + hi_p]), accuracy).alias("_a"))
    groups = sk.limit(MAX_SMALL_ROWS + 1).collect()
    if len(groups) > MAX_SMALL_ROWS:
        return None
    k = len(probs)
    spark = long.sparkSession
    bands = []
    for g in groups:
        los = [float(g["_min"] if lo_p[i] == 0.0 else g["_a"][i]) for i in range(k)]
        his = [float(g["_max"] if hi_p[i] == 1.0 else g["_a"][k + i]) for i in range(k)]
        bands.append((*[g[c] for c in keys], *los, *his))
    if not bands or not k:
        return spark.createDataFrame([], long.select(*keys).schema.add("p", "double").add("value", "double"))
    # one pass, one output row per value: a value falls into interval i = #(lo <= x) of its
    # group; the rows below band j are those with i < j, and a value inside any band keeps
    # its own cell.  The bounds are joined to the rows (one row per group, bounded by the
    # check above), so the expressions are the same few for any number of groups
    bschema = long.select(*keys).schema
    for c in [f"_lo{i}" for i in range(k)] + [f"_hi{i}" for i in range(k)]:
        bschema = bschema.add(c, "double")
    j = join_null_safe(long, F.broadcast(spark.createDataFrame(bands, bschema)), keys)
    x, interval, inband = F.col("x"), F.lit(0), F.lit(False)
    for i in range(k):
        interval = interval + (x >= F.col(f"_lo{i}")).cast("int")
        inband = inband | ((x >= F.col(f"_lo{i}")) & (x <= F.col(f"_hi{i}")))
    agg = (j.select(*keys, interval.alias("_i"), F.when(inband, x).alias("bx"))
           .groupBy(*keys, "_i", "bx").agg(F.count(F.lit(1)).alias("_c")))
    band_rows = agg.limit(MAX_SMALL_ROWS + 1).collect()
    if len(band_rows) > MAX_SMALL_ROWS:
        return None
    per_key: dict = {}
    for r in band_rows:
        per_key.setdefault(tuple(r[c] for c in keys), []).append((r["_i"], r["bx"], r["_c"]))
    cells: dict = {}
    for band in bands:
        key, los, his = band[:len(keys)], band[len(keys):len(keys) + k], band[len(keys) + k:]
        rows_k = per_key.get(key, [])
        for j_, (p, lo, hi) in enumerate(zip(probs, los, his), start=1):
            below = sum(c for i, _, c in rows_k if i < j_)
            cells[(*key, p)] = [(None, below)] + [(v, c) for _, v, c in rows_k if v is not None and lo <= v <= hi]
    n_of = {tuple(g[c] for c in keys): g["_n"] for g in groups}
    out = []
    for key, items in cells.items():
        n = n_of[key[:-1]]
        h = (n - 1) * key[-1]
        rlo, rhi = math.floor(h), math.ceil(h)
        below = sum(c for v, c in items if v is None)
        vals = sorted((v, c) for v, c in items if v is not None)
        xlo = xhi = None
        acc = below
        for v, c in vals:
            acc += c
            if xlo is None and acc > rlo:
                xlo = v
            if acc > rhi:
                xhi = v
                break
        if below > rlo or xlo is None or xhi is None:
            return None  # a bracket missed: let the general path handle it
        out.append((*key, xlo + (h - rlo) * (xhi - xlo)))
    return spark.createDataFrame(out, long.select(*keys).schema.add("p", "double").add("value", "double"))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    coerce: bool = True) -> dict[str, list[float | None]]:
    """{column: [q(p) for p in probs]}; the collected table is cols x probs rows."""
    rows = quantiles_df(df, cols, probs, coerce).collect()
    out = {c: [None] * len(probs) for c in cols}
    pos = {float(p): i for i, p in enumerate(probs)}
    for r in rows:
        out[r["column"]][pos[r["p"]]] = r["value"]
    return out


def mode_value(df: DataFrame, column: str):
    """Most frequent non-null value, the smallest on ties (None if all null)."""
    c = _q(column)
    top = (df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), F.asc("v")).limit(1).collect())
    return top[0]["v"] if top else None


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    rank_name: str | None = None, salts: int = 64) -> DataFrame:
    """The first ``k`` rows of each group by ``order`` (a total order).

    Stage 1 ranks inside (group, salt) and keeps k rows each; stage 2 ranks the
    at most ``k * salts`` survivors of a group.  A hot group is thus ranked by
    ``salts`` tasks, and the final window sees a bounded number of rows.
    """
    g = [_q(c) for c in group]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[_q(c) for c in df.columns]), F.lit(salts)))
    w1 = Window.partitionBy(*g, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*g).orderBy(*order)
    out = stage1.withColumn("_r2", F.row_number().over(w2)).where(F.col("_r2") <= k)
    if rank_name:
        out = out.withColumn(rank_name, F.col("_r2").cast("long"))
    return out.drop("_salt", "_r1", "_r2")
