"""Order-dependent analytics that stay balanced when one key is huge.

Spark rows have no order, and ``Window.partitionBy(key)`` puts every row of a
key into one task.  Everything order-sensitive in the library goes through the
primitives below instead:

* ``row_index``: dense 0-based position of each row inside its entity (or in
  the whole table).  Rows are range-partitioned on (entity, order, tie-break),
  so a key holding a third of the data is split over many tasks; each task
  numbers its rows, the numbered rows are checkpointed (reliable checkpoint in
  ``spark.checkpoint.dir``), and a table with one row per (partition, entity)
  carries the counts of earlier partitions forward.
* ``running``: cumulative sum/min/max/count/last-non-null.  Rows are cut into
  buckets of ``bucket_rows`` consecutive positions; the window runs inside a
  bucket and a per-bucket summary supplies the prefix of earlier buckets.
* ``halo``: bounded frames (lags, rolling and centred windows).  The rows a
  frame needs from a neighbouring bucket are copied into it, the window runs
  per bucket, and the copies are dropped.
* ``rolling_mean_prefix``: rolling means with frames too wide for a halo,
  from prefix sums looked up by an equi-join on the position.

Partition keys may be null; they are matched null-safe (pandas keeps null
run ids together too).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import cut_lineage

DEFAULT_BUCKET_ROWS = 1 << 20
_UNB = Window.unboundedPreceding


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sortable(dt: T.DataType) -> bool:
    if isinstance(dt, (T.MapType, T.VariantType)):
        return False
    if isinstance(dt, T.ArrayType):
        return _sortable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(_sortable(f.dataType) for f in dt.fields)
    return True


def _tie_break(df: DataFrame, used: Sequence[str]) -> list[Column]:
    return [F.col(f"`{f.name}`") for f in df.schema.fields
            if f.name not in used and _sortable(f.dataType)]


def _names(cols) -> list[str]:
    return [c for c in cols if isinstance(c, str)]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null; keeps the left key columns."""
    if not keys:
        raise ValueError("join_null_safe needs at least one key (no cross joins)")
    ren = right.select(*[F.col(f"`{k}`").alias(f"__r_{k}") for k in keys],
                       *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        e = F.col(f"`{k}`").eqNullSafe(F.col(f"`__r_{k}`"))
        cond = e if cond is None else cond & e
    return left.join(ren, cond, how).drop(*[f"__r_{k}" for k in keys])


def row_index(df: DataFrame, order_by: Sequence, partition_by: Sequence[str] = (),
              name: str = "idx", num_partitions: int | None = None, tie_break: bool = True) -> DataFrame:
    """Add ``name`` = 0-based position by ``order_by`` within ``partition_by``.

    ``order_by`` entries are column names or sort Columns (``F.col(c).desc()``).
    With ``tie_break`` all other sortable columns extend the order, so the
    numbering is a function of the data, not of the partitioning.
    """
    part = [F.col(f"`{c}`") for c in partition_by]
    order = [_as_col(c) for c in order_by]
    keys = part + order
    if tie_break:
        keys += _tie_break(df, list(partition_by) + _names(order_by))
    # without a number adaptive execution merges small partitions by what they really hold
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    ranged = (ranged.sortWithinPartitions(*keys)
              .withColumn("__ri_pid", F.spark_partition_id())
              .withColumn("__ri_pos", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    # The range bounds are sampled with a seed tied to the RDD id, so two plan
    # branches over the same input could partition differently.  A reliable
    # checkpoint fixes (_pid, _pos) once for both branches and survives the
    # loss of executors.
    ranged = cut_lineage(ranged)
    if not partition_by:
        # one row per range partition: a proven bound for the broadcast
        counts = ranged.groupBy("__ri_pid").agg(F.count(F.lit(1)).alias("__ri_n"))
        offs = counts.select("__ri_pid", F.coalesce(
            F.sum("__ri_n").over(Window.orderBy("__ri_pid").rowsBetween(_UNB, -1)), F.lit(0)).alias("__ri_off"))
        out = ranged.join(F.broadcast(offs), "__ri_pid").withColumn(name, F.col("__ri_off") + F.col("__ri_pos"))
        return out.drop("__ri_pid", "__ri_pos", "__ri_off")
    # one row per (partition, entity); a hot entity contributes one row per partition
    grp = ranged.groupBy("__ri_pid", *part).agg(F.min("__ri_pos").alias("__ri_start"), F.count(F.lit(1)).alias("__ri_n"))
    carry = grp.select("__ri_pid", *part, "__ri_start", F.coalesce(
        F.sum("__ri_n").over(Window.partitionBy(*part).orderBy("__ri_pid").rowsBetween(_UNB, -1)),
        F.lit(0)).alias("__ri_carry"))
    out = join_null_safe(ranged, carry, ["__ri_pid", *partition_by])
    out = out.withColumn(name, F.col("__ri_pos") - F.col("__ri_start") + F.col("__ri_carry"))
    return out.drop("__ri_pid", "__ri_pos", "__ri_start", "__ri_carry")


# ---------------------------------------------------------------- running aggregates

_COMBINE = {
    "sum": lambda a, b: F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(
        F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "count": lambda a, b: a + F.coalesce(b, F.lit(0)),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
    "last": lambda a, b: F.coalesce(a, b),
}


def _win_agg(kind: str, c: Column) -> Column:
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](c) if kind != "last" \
        else F.last(c, ignorenulls=True)


def running(df: DataFrame, partition_by: Sequence[str], order_by: Sequence,
            specs: Sequence[tuple], bucket_rows: int = DEFAULT_BUCKET_ROWS,
            idx: str | None = None, keep_index: bool = False) -> DataFrame:
    """Cumulative aggregates per entity in order.

    ``specs``: tuples ``(out_name, kind, column[, inclusive=True])`` with kind in
    sum, count, min, max, last (last non-null value, i.e. forward fill).
    ``inclusive=False`` excludes the current row (``rows unbounded .. -1``).
    ``idx`` names an existing dense 0-based position column (skips indexing).
    """
    base = df if idx else row_index(df, order_by, partition_by, name="_idx")
    ix = idx or "_idx"
    part = [F.col(f"`{c}`") for c in partition_by]
    base = base.withColumn("_bkt", F.floor(F.col(ix) / F.lit(bucket_rows)).cast("long"))
    wb = Window.partitionBy(*part, "_bkt").orderBy(ix)
    b, sums = base, []
    for spec in specs:
        out, kind, c = spec[0], spec[1], _as_col(spec[2])
        inclusive = spec[3] if len(spec) > 3 else True
        frame = wb.rowsBetween(_UNB, 0 if inclusive else -1)
        b = b.withColumn(f"_in_{out}", _win_agg(kind, c).over(frame))
        if kind == "last":
            sums.append(F.max_by(c, F.when(c.isNotNull(), F.col(ix))).alias(f"_tot_{out}"))
        else:
            sums.append({"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](c).alias(f"_tot_{out}"))
    # one row per entity and bucket, combined before the shuffle
    summary = base.groupBy(*part, "_bkt").agg(*sums)
    wprev = Window.partitionBy(*part).orderBy("_bkt").rowsBetween(_UNB, -1)
    carry_cols = []
    for spec in specs:
        out, kind = spec[0], spec[1]
        tot = F.col(f"_tot_{out}")
        agg = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}.get(kind)
        carried = F.last(tot, ignorenulls=True).over(wprev) if kind == "last" else agg(tot).over(wprev)
        carry_cols.append(carried.alias(f"_cy_{out}"))
    # bucket 0 of an entity has nothing before it, so the carry has a row for at most
    # rows / bucket_rows later buckets
    carry = summary.select(*partition_by, "_bkt", *carry_cols).where(F.col("_bkt") > 0)
    b = join_null_safe(b, carry, [*partition_by, "_bkt"], "left")
    for spec in specs:
        out, kind = spec[0], spec[1]
        b = b.withColumn(out, _COMBINE[kind](F.col(f"_in_{out}"), F.col(f"_cy_{out}")))
        b = b.drop(f"_in_{out}", f"_cy_{out}")
    b = b.drop("_bkt")
    return b if (keep_index or idx) else b.drop("_idx")


# ---------------------------------------------------------------- bounded frames

def halo(df: DataFrame, partition_by: Sequence[str], order_by: Sequence, before: int, after: int,
         compute: Callable[[Window], dict[str, Column]], bucket_rows: int = DEFAULT_BUCKET_ROWS,
         idx: str | None = None, keep_index: bool = False) -> DataFrame:
    """Evaluate window columns whose frames reach at most ``before`` rows back
    and ``after`` rows ahead.  ``compute(w)`` gets a Window partitioned by
    (entity, bucket) and ordered by position and returns new columns."""
    base = df if idx else row_index(df, order_by, partition_by, name="_idx")
    ix = idx or "_idx"
    bsz = max(int(bucket_rows), 4 * (before + after), 1)
    part = [F.col(f"`{c}`") for c in partition_by]
    b = base.withColumn("_bkt", F.floor(F.col(ix) / F.lit(bsz)).cast("long"))
    off = F.col(ix) - F.col("_bkt") * F.lit(bsz)
    # each row lands in its own bucket, plus the next bucket when it is in the
    # last ``before`` rows, plus the previous one when it is in the first ``after``
    targets = F.array(F.struct(F.col("_bkt").alias("b"), F.lit(0).alias("h")))
    if before > 0:
        targets = F.when(off >= bsz - before, F.array_union(
            targets, F.array(F.struct((F.col("_bkt") + 1).alias("b"), F.lit(1).alias("h"))))).otherwise(targets)
    if after > 0:
        targets = F.when(off < after, F.array_union(
            targets, F.array(F.struct((F.col("_bkt") - 1).alias("b"), F.lit(1).alias("h"))))).otherwise(targets)
    b = b.withColumn("__ht", F.explode(targets)).withColumn("_bkt", F.col("__ht.b")) \
         .withColumn("_halo", F.col("__ht.h")).drop("__ht")
    w = Window.partitionBy(*part, "_bkt").orderBy(ix)
    for name, c in compute(w).items():
        b = b.withColumn(name, c)
    b = b.filter(F.col("_halo") == 0).drop("_halo", "_bkt")
    return b if (keep_index or idx) else b.drop("_idx")


def lag_join(df: DataFrame, partition_by: Sequence[str], idx: str, value: str, k: int, name: str) -> DataFrame:
    """``value`` of the row ``k`` positions earlier (negative k: later), by an
    equi-join on (entity, idx); unique keys, so no skew."""
    prev = df.select(*partition_by, (F.col(idx) + F.lit(k)).alias(idx), F.col(value).alias(name))
    return join_null_safe(df, prev, [*partition_by, idx], "left")


def rolling_mean_prefix(df: DataFrame, partition_by: Sequence[str], order_by: Sequence, value: str,
                        before: int, after: int, name: str,
                        bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Mean over rows [i-before, i+after] (edges partial) from prefix sums, for
    frames too wide to copy as a halo."""
    v = F.col(value)
    b = running(df, partition_by, order_by,
                [("_ps", "sum", F.coalesce(v, F.lit(0.0))), ("_pc", "count", v)],
                bucket_rows=bucket_rows, keep_index=True)
    ends = b.select(*partition_by, "_idx", "_ps", "_pc")
    hi = ends.select(*partition_by, (F.col("_idx") - F.lit(after)).alias("_idx"),
                     F.col("_ps").alias("_hps"), F.col("_pc").alias("_hpc"))
    lo = ends.select(*partition_by, (F.col("_idx") + F.lit(before + 1)).alias("_idx"),
                     F.col("_ps").alias("_lps"), F.col("_pc").alias("_lpc"))
    j = join_null_safe(join_null_safe(b, hi, [*partition_by, "_idx"], "left"),
                       lo, [*partition_by, "_idx"], "left")
    if partition_by:
        last = b.groupBy(*partition_by).agg(F.max("_idx").alias("_mx"))
        last = join_null_safe(last, ends.withColumnRenamed("_idx", "_mx"), [*partition_by, "_mx"]) \
            .select(*partition_by, F.col("_ps").alias("_tps"), F.col("_pc").alias("_tpc"))
        j = join_null_safe(j, last, list(partition_by), "left")
    else:
        # one series: its totals are a single row, used as literals
        tot = b.agg(F.max_by("_ps", "_idx").alias("s"), F.max_by("_pc", "_idx").alias("c")).first()
        j = j.withColumns({"_tps": F.lit(tot["s"]).cast("double"), "_tpc": F.lit(tot["c"]).cast("long")})
    s = F.coalesce(F.col("_hps"), F.col("_tps")) - F.coalesce(F.col("_lps"), F.lit(0.0))
    c = F.coalesce(F.col("_hpc"), F.col("_tpc")) - F.coalesce(F.col("_lpc"), F.lit(0))
    return j.withColumn(name, F.when(c > 0, s / c)).drop(
        "_ps", "_pc", "_hps", "_hpc", "_lps", "_lpc", "_tps", "_tpc", "_idx")
