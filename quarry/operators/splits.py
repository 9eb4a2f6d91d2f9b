"""Splits, folds and resampling (V1-V8).

Splits are predicates on each row (a position or a hash), never
``randomSplit`` (which depends on partitioning) and never a join; the parts of
a split are exact complements.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ordered import DEFAULT_BUCKET_ROWS, halo, row_index


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def time_split(df: DataFrame, order_by: Sequence, share: float = 0.8, name: str = "split") -> DataFrame:
    """V1 the first floor(share x n) rows in order are 'train', the rest 'test'."""
    n = df.count()
    cut = int(n * share)
    ix = row_index(df, order_by, name="_tpos")
    return ix.withColumn(name, F.when(F.col("_tpos") < cut, "train").otherwise("test")).drop("_tpos")


def hash_split(df: DataFrame, key: Sequence[str], share: float = 0.8, seed: int = 42,
               name: str = "split") -> DataFrame:
    """V2 seeded random split: pmod(xxhash64(seed, key), 100) < share x 100."""
    h = F.pmod(F.xxhash64(F.lit(seed), *[_q(k) for k in key]), F.lit(100))
    return df.withColumn(name, F.when(h < int(round(share * 100)), "train").otherwise("test"))


def mod_split(df: DataFrame, key: str, k: int = 5, test_part: int = 4, name: str = "split") -> DataFrame:
    """V2 deterministic form: rows with key % k == test_part are 'test'."""
    return df.withColumn(name, F.when(F.pmod(_q(key), F.lit(k)) == test_part, "test").otherwise("train"))


def prep_summary(df: DataFrame, target: str, split: str = "split", date_columns: Sequence[str] = ()) -> DataFrame:
    """V3 rows, cols, target, datetime columns, train rows, val rows."""
    g = df.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(_q(split) == "train", 1)).alias("train_rows"),
               F.count(F.when(_q(split) == "test", 1)).alias("val_rows"))
    return g.select("rows", F.lit(len([c for c in df.columns if c != split])).alias("cols"),
                    F.lit(target).alias("target"),
                    F.array(*[F.lit(c) for c in date_columns]).cast("array<string>").alias("datetime_columns"),
                    "train_rows", "val_rows")


def kfold(df: DataFrame, key: Sequence[str], k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """V4 k-fold: fold = pmod(xxhash64(seed, key), k)."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), *[_q(c) for c in key]), F.lit(k)).cast("int"))


def stratified_kfold(df: DataFrame, label: str, order_by: Sequence, k: int = 5, name: str = "fold") -> DataFrame:
    """V4 stratified: within each class, rows in ``order_by`` order are dealt
    to folds round-robin (position % k).  The per-class position uses the
    range-partitioned row index, so a dominant class is not numbered by one
    task.  Pass a hash column as ``order_by`` for a shuffled deal."""
    ix = row_index(df, order_by, [label], name="_p")
    return ix.withColumn(name, (F.col("_p") % k).cast("int")).drop("_p")


def group_kfold(df: DataFrame, group: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """V4 group k-fold: all rows of a group share the fold of its hash."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), _q(group)), F.lit(k)).cast("int"))


def walk_forward(df: DataFrame, date: str, cuts: Sequence, horizon=None) -> DataFrame:
    """V5 one train/test assignment per cut: train = date <= cut, test =
    cut < date <= next cut (the last cut: date <= cut + horizon, or open).
    Each row is expanded over the short literal list of cuts."""
    cuts = list(cuts)
    items = []
    for i, c in enumerate(cuts):
        hi = cuts[i + 1] if i + 1 < len(cuts) else horizon
        items.append(F.struct(F.lit(i).alias("fold"), F.lit(c).alias("cut"),
                              (F.lit(hi) if hi is not None else F.lit(None)).alias("hi")))
    x = df.withColumn("_c", F.explode(F.array(*items)))
    d = _q(date)
    cut = F.col("_c.cut").cast(df.schema[date].dataType)
    hi = F.col("_c.hi").cast(df.schema[date].dataType)
    role = F.when(d <= cut, "train").when((d > cut) & (hi.isNull() | (d <= hi)), "test")
    return x.withColumn("role", role).where(F.col("role").isNotNull()).withColumn(
        "fold", F.col("_c.fold")).drop("_c")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """V6 balanced weights n / (k x count(class)) and the imbalance ratio
    (largest over smallest class), one row per class."""
    c = df.groupBy(_q(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    st = c.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k"), F.max("count").alias("mx"),
               F.min("count").alias("mn")).first()
    return c.select("label", "count", (F.lit(st["n"]) / (F.lit(st["k"]) * F.col("count"))).alias("weight"),
                    F.lit(st["mx"] / st["mn"]).alias("imbalance_ratio"))


def oversample(df: DataFrame, label: str, split: str | None = None) -> DataFrame:
    """V7 random oversampling with integer factors: each class is replicated
    floor(max_count / count) times (train rows only when ``split`` is given).
    The factor table has one row per class; the planner picks the join by its size."""
    part = df.where(_q(split) == "train") if split else df
    counts = part.groupBy(_q(label).alias("_lbl")).agg(F.count(F.lit(1)).alias("_n"))
    st = counts.agg(F.max("_n").alias("mx"), F.count(F.lit(1)).alias("k")).first()
    mx = st["mx"]
    factors = counts.select("_lbl", F.floor(F.lit(mx) / F.col("_n")).cast("int").alias("_f"))
    rep = part.join(factors, _q(label).eqNullSafe(F.col("_lbl"))).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("_f")))).drop("_lbl", "_f", "_n")
    if split:
        rest = df.where(~(_q(split) == "train") | _q(split).isNull()).withColumn("copy", F.lit(1))
        return rep.unionByName(rest)
    return rep


def synthetic_minority(df: DataFrame, label: str, features: Sequence[str], minority, k: int = 5,
                       seed: int = 7, projections: int = 6, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """V8 SMOTE-style rows for the ``minority`` class: every minority row is paired with its
    ``k`` nearest neighbours and gives a row x + u (neighbour - x) per pair, u hashed in [0, 1).

    Neighbours are found by locality: along each of several random projections the k rows
    before and after a row are its candidates (halo windows, 2 k projections per row, no
    pairs of whole buckets), and the k at the smallest Euclidean distance are taken."""
    m = df.where(_q(label) == F.lit(minority)).select(*[_q(c).cast("double").alias(c) for c in features])
    m = m.na.drop()
    m = row_index(m, list(features), name="_row")
    rnd = random.Random(seed)
    found = None
    for _ in range(projections):
        proj = sum((F.col(c) * F.lit(rnd.gauss(0, 1)) for c in features), F.lit(0.0))
        me = F.struct("_row", *features)
        near = halo(m.withColumn("_proj", proj), [], ["_proj", "_row"], k, k,
                    lambda w: {"_near": F.array(*[f(me, j).over(w) for j in range(1, k + 1) for f in (F.lag, F.lead)])},
                    bucket_rows=bucket_rows)
        near = near.select(F.struct("_row", *features).alias("x"), F.explode("_near").alias("y")).where("y IS NOT NULL")
        found = near if found is None else found.unionAll(near)
    found = found.dropDuplicates(["x", "y"]).withColumn("d", sum(
        ((F.col(f"x.{c}") - F.col(f"y.{c}")) * (F.col(f"x.{c}") - F.col(f"y.{c}")) for c in features), F.lit(0.0)))
    # at most 2 k projections candidates per row
    w = Window.partitionBy("x._row").orderBy("d", "y._row")
    pairs = found.withColumn("j", F.row_number().over(w)).where(F.col("j") <= k)
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("x._row"), F.col("j")), F.lit(1 << 20)) / float(1 << 20)
    return pairs.select(*[(F.col(f"x.{c}") + u * (F.col(f"y.{c}") - F.col(f"x.{c}"))).alias(c) for c in features],
                        F.lit(minority).alias(label))
