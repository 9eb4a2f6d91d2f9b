"""Mixing sources to target weights by capped water-filling.

Targets: sources share the total by weight; a source whose share exceeds its size
times ``max_epochs`` is clamped there and the excess goes to the others by weight,
until no share is above its clamp.  Rows: every document is repeated whole
``floor(target / source size)`` times; a seeded hash order decides which documents
are taken once more, up to the point where the source's words come nearest to its
target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, materialize, send_if_few
from quarry.operators.ordered import join_null_safe, row_index

#: Cells of one level of the seeded order; two levels leave about one document in
#: CELLS^2 to rank inside a cell, however large a source is.
CELLS = 2048
#: One-row-per-source tables of more rows are joined without a broadcast.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_weights(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Add ``weight``: the sequence repeated over the sources in code-point order, null last."""
    ranked = row_index(sizes, [F.col("source").asc_nulls_last()], name="__rank", tie_break=False)
    return ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                    (F.col("__rank") % len(weights) + 1).cast("int"))).drop("__rank")


def water_fill(sizes: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Add ``target`` to a table of (source, source_size, weight).

    One small aggregate per round; at least one source is clamped in every round but
    the last, and clamped sources stay clamped."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = None
    while True:
        open_ = F.lit(True) if level is None else ~F.coalesce(F.col("weight") * level > cap, F.lit(False))
        r = sizes.agg(F.sum("source_size").alias("total"),
                      F.sum(F.when(open_, F.col("weight"))).alias("w"),
                      F.sum(F.when(~open_, cap)).alias("clamped"),
                      F.count(F.when(open_, 1)).alias("n")).first()
        if not r["total"] or not r["n"]:
            break
        nxt = (r["total"] - (r["clamped"] or 0.0)) / r["w"]
        if level is not None and nxt <= level:
            break
        level = nxt
    if level is None:
        return sizes.withColumn("target", F.lit(0.0))
    return sizes.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def _cells(df: DataFrame, cell: str, more: Sequence[str] = ()) -> DataFrame:
    """Per source the first cell at which the running size reaches ``need``."""
    w = Window.partitionBy("sid").orderBy(cell)
    sums = df.groupBy("sid", cell).agg(F.sum("size").alias("s"), F.first("need").alias("need"))
    run = sums.withColumn("upto", F.sum("s").over(w))
    return (run.filter("upto - s < need and upto >= need")
            .select("sid", F.col(cell).alias(f"{cell}_at"), (F.col("need") - (F.col("upto") - F.col("s"))).alias("left")))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3.0, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, ``size`` (words), ``source_size``, ``target`` (of its
    source), ``copies`` (times the mix takes it), ``taken`` (= copies * size).

    A source's taken words differ from its target by at most half its largest document
    that is not taken once more.  Null texts and texts without words have size 0, null
    is a source of its own, sorted last.  The order is a seeded hash of id and text, so
    reruns agree; rows that repeat an id are ranked by their own texts, and rows that
    repeat both are numbered and ranked one by one (they are alike, so any may be first)."""
    rows = _scan(docs.withColumn("__row", F.monotonically_increasing_id()), id_col, text_col, source_col)
    rows = materialize(rows.withColumn("size", word_count(F.col("text"))).drop("text"), "mix-scan")
    rows = materialize(_numbered(rows, _tied(rows)), "mix-rows")
    plan = _plan(rows, weights, max_epochs, seed)
    return _copies(rows, plan, max_epochs, seed).select(
        F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _scan(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """What decides about a row: id, source key, text hash; behind them its text."""
    text, source = F.col(f"`{text_col}`").cast("string"), F.col(f"`{source_col}`").cast("string")
    return docs.select("__row", F.col(f"`{id_col}`").alias("id"), source.alias("source"),
                       F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("sid"), F.xxhash64(text).alias("th"),
                       text.alias("text"))


def _tied(rows: DataFrame) -> DataFrame:
    """(id, th) that several rows share."""
    return materialize(rows.groupBy("id", "th").count().filter("count > 1").select("id", "th"), "mix-tied")


def _numbered(rows: DataFrame, tied: DataFrame) -> DataFrame:
    """Add ``again``: 0, 1, ... among the rows of one id and text."""
    zero = F.lit(0).cast("long")
    if tied.isEmpty():
        return rows.withColumn("again", zero)
    own = join_null_safe(rows.select("id", "th", "__row"), tied, ["id", "th"], "left_semi")
    number = row_index(own, ["__row"], ["id", "th"], name="again", tie_break=False).select("__row", "again")
    return rows.join(number, "__row", "left").withColumn("again", F.coalesce("again", zero))


def _placed(rows: DataFrame, seed: int) -> DataFrame:
    """Add the place in the seeded order: hash ``h`` and its two levels of cells."""
    order = F.xxhash64(F.lit(seed), F.col("id").cast("string"), F.lit("|"), "th", "again")
    return (rows.withColumn("h", order).withColumn("c1", F.shiftrightunsigned("h", 64 - 11).cast("int"))
            .withColumn("c2", (F.shiftrightunsigned("h", 64 - 22) % CELLS).cast("int")))


def _place() -> Column:
    return F.struct("h", "id", "th", "again")


def _plan(rows: DataFrame, weights: Sequence[float], max_epochs: float, seed: int) -> DataFrame:
    """One row per source (``sid``): its size and target, how often it is taken whole
    (``whole``), and up to where in the order once more (``c1_at``, ``c2_at``, ``last``)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = water_fill(source_weights(sizes, weights), max_epochs)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(share + F.lit(1e-12)).cast("long")
    table = table.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("sid"), "source_size", "target",
                         whole.alias("whole"),
                         F.greatest(F.col("target") - whole * F.col("source_size"), F.lit(0.0)).alias("need"))
    table = materialize(table, "mix-targets")
    rows = _placed(rows.select("sid", "id", "th", "again", "size"), seed)
    rows = rows.join(send_if_few(table.select("sid", "need"), BROADCAST_SOURCES), "sid")
    first = _cells(rows.filter("need > 0"), "c1")
    # a source's rows meet its cell by source and cell, so a large source stays spread
    at1 = rows.drop("need").join(first.withColumnRenamed("c1_at", "c1"), ["sid", "c1"])
    second = _cells(at1.withColumn("need", F.col("left")).drop("left"), "c2").withColumnRenamed("left", "left2")
    at2 = at1.join(second.withColumnRenamed("c2_at", "c2"), ["sid", "c2"])
    w = Window.partitionBy("sid").orderBy("h", "id", "th", "again").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = at2.withColumn("upto", F.sum("size").over(w))
    # the document on the border goes in if that brings the source nearer to its target
    cut = (last.filter(F.col("upto") - F.col("size") / 2.0 <= F.col("left2"))
           .groupBy("sid").agg(F.max(_place()).alias("last")))
    marks = (table.join(first.select("sid", "c1_at"), "sid", "left")
             .join(second.select("sid", "c2_at"), "sid", "left").join(cut, "sid", "left"))
    return materialize(marks, "mix-marks")


def _copies(rows: DataFrame, plan: DataFrame, max_epochs: float, seed: int) -> DataFrame:
    """Add ``copies`` (and the plan's columns) to rows with id, sid, th and again."""
    rows = _placed(rows, seed).join(send_if_few(plan, BROADCAST_SOURCES), "sid")
    before = (F.col("c1") < F.col("c1_at")) | ((F.col("c1") == F.col("c1_at")) & (
        (F.col("c2") < F.col("c2_at")) | ((F.col("c2") == F.col("c2_at")) & (_place() <= F.col("last")))))
    # no crossing cell though words are needed: all of the source is (rounding)
    once = F.when(F.col("need") <= 0, F.lit(False)).otherwise(
        F.when(F.col("c1_at").isNull(), F.lit(True)).otherwise(F.coalesce(before, F.lit(False))))
    copies = F.least(F.col("whole") + once.cast("long"), F.lit(int(max_epochs)).cast("long"))
    return rows.withColumn("copies", copies)


def take(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3.0, seed: int = 7,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every input row as often as ``mix`` takes it, with all its columns and
    ``copy`` (1, 2, ...; with underscores in front if the input has a column of that name).

    Every row is taken by itself, also where ids repeat or are null.  An empty table, or one
    without words, gives no rows.  Rows find their place in the order from their own values,
    so texts are not shuffled; only where rows repeat id and text are they numbered."""
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    rows = _scan(numbered, id_col, text_col, source_col)
    rows = materialize(rows.withColumn("size", word_count(F.col("text"))).drop("text"), "mix-scan")
    tied = _tied(rows)
    plan = _plan(materialize(_numbered(rows, tied), "mix-rows"), weights, max_epochs, seed)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    text, source = F.col(f"`{text_col}`").cast("string"), F.col(f"`{source_col}`").cast("string")
    decides = [F.col(f"`{id_col}`").alias("id"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("sid"),
               F.xxhash64(text).alias("th")]
    if tied.isEmpty():
        own = docs.select(whole, *decides).withColumn("again", F.lit(0).cast("long"))
    else:
        numbered = materialize(numbered, "mix-input")
        number = _numbered(numbered.select("__row", *decides), tied).select("__row", "again")
        own = numbered.select("__row", whole, *decides).join(number, "__row")
    name = "copy"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    taken = _copies(own, plan.select("sid", "whole", "need", "c1_at", "c2_at", "last"), max_epochs, seed).filter("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__n")).select(
        *[F.col("doc").getField(c).alias(c) for c in docs.columns], F.col("__n").alias(name))
