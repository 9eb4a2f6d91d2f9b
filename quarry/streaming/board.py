"""Incremental leaderboard over an arriving experiment log (ST1).

Both jobs keep their state in Spark's state store and write only what a micro-batch has
changed, one folder per batch (a batch run again writes the same folder again):

* the board: per (run, model) an aggregate in update mode; a changed key's new row replaces
  its older ones when the board is read, and every few batches they are merged into a base;
* the running best: per run one keyed value, so every arriving row is put out once, with
  the best up to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.streaming.leaderboard import leaderboard_aggregate, scratch

KEYS = ("run_id", "model")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _children(spark: SparkSession, folder: str) -> dict[int, str]:
    """{batch: path} of the complete tables below ``folder`` (named by their batch)."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return {}
    paths = [s.getPath() for s in fs.listStatus(top)]
    return {int(p.getName().rsplit("-", 1)[1]): p.toString() for p in paths
            if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_board(spark: SparkSession, out: str) -> DataFrame:
    """The board as of the last whole batch: the newest base and the changes after it, the
    newest row of every key."""
    bases, deltas = _children(spark, f"{out}/base"), _children(spark, f"{out}/delta")
    since = max(bases, default=-1)
    tables = [bases[since]] if bases else []
    tables += [p for n, p in sorted(deltas.items()) if n > since]
    if not tables:
        raise FileNotFoundError(f"{out}: no whole batch")
    rows = spark.read.parquet(*tables)
    newest = F.max_by(F.struct(*[c for c in rows.columns if c not in KEYS]), "batch").alias("r")
    return rows.groupBy(*KEYS).agg(newest).select(*KEYS, *[f"r.{c}" for c in rows.columns if c not in (*KEYS, "batch")])


def compact(spark: SparkSession, out: str, batch: int) -> None:
    """Merge everything up to ``batch`` into a new base; what lay below the base before it
    is removed (a reader that has just listed the last base still finds its files)."""
    before = _children(spark, f"{out}/base")
    board = read_board(spark, out).withColumn("batch", F.lit(batch).cast("long"))
    board.write.mode("overwrite").parquet(f"{out}/base/upto-{batch:012d}")
    if before:
        last = max(before)
        _remove(spark, [p for n, p in before.items() if n < last])
        _remove(spark, [p for n, p in _children(spark, f"{out}/delta").items() if n <= last])


def start_board(spark: SparkSession, source: str, schema: T.StructType, out: str, lower: bool = True,
                fmt: str = "parquet", files_per_batch: int = 64, compact_every: int = 16, available_now: bool = True,
                checkpoint: str | None = None):
    """Stream the log files under ``source`` into the board below ``out`` (``read_board``).

    A batch writes the rows of the keys it met; state is one row per (run, model).  A
    restart with the same ``checkpoint`` goes on where it stopped."""
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(source)

    def put(changed: DataFrame, batch: int) -> None:
        (changed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite")
         .parquet(f"{out}/delta/batch-{batch:012d}"))
        if batch % compact_every == compact_every - 1:
            compact(changed.sparkSession, out, batch)

    w = (leaderboard_aggregate(stream, lower).writeStream.outputMode("update").foreachBatch(put)
         .option("checkpointLocation", checkpoint or scratch(spark, "st1")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


BEST = "run_id long, num long, model string, metric_val double, running_best double, is_new_best boolean"


class RunningBest(StatefulProcessor):
    """Per run the best value so far; every successful row comes out with the best up to it."""

    def __init__(self, lower: bool):
        self.lower = lower

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "best double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("num", kind="stable")
        held = self.best.get() if self.best.exists() else None
        worst = float("inf") if self.lower else float("-inf")
        before = held[0] if held is not None else worst
        value = got["metric_val"].astype("float64")
        filled = pd.concat([pd.Series([before]), value.fillna(worst)], ignore_index=True)
        upto = filled.cummin() if self.lower else filled.cummax()
        best = upto.iloc[1:].to_numpy()
        out = got[["num", "model", "metric_val"]].reset_index(drop=True)
        out.insert(0, "run_id", key[0])
        out["running_best"] = pd.Series(best).where(pd.Series(best) != worst, None)
        out["is_new_best"] = best != upto.iloc[:-1].to_numpy()
        self.best.update((float(best[-1]),))
        yield out

    def close(self) -> None:
        pass


def start_running_best(spark: SparkSession, source: str, schema: T.StructType, out: str, lower: bool = True,
                       fmt: str = "parquet", files_per_batch: int = 64, available_now: bool = True,
                       checkpoint: str | None = None):
    """W1 over an arriving log: every successful experiment once, with the best of its run
    up to it (rows of a run are expected in the order of ``num``; one that arrives late is
    compared with all that came before it).  A task holds a run's rows of one batch, which
    ``files_per_batch`` bounds."""
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(source)
    rows = stream.where("status <> 'crash'").select(F.col("run_id").cast("long").alias("run_id"), "num", "model", "metric_val")
    best = rows.groupBy("run_id").transformWithStateInPandas(RunningBest(lower), BEST, "Append", "None")
    w = (best.writeStream.outputMode("append").foreachBatch(
        lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch-{n:012d}"))
        .option("checkpointLocation", checkpoint or scratch(spark, "st1")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    key = "spark.sql.streaming.stateStore.providerClass"        # a started query keeps its own copy
    held = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        return w.start()
    finally:
        spark.conf.set(key, held)


def read_running_best(spark: SparkSession, out: str) -> DataFrame:
    """All rows put out so far."""
    done = _children(spark, out)
    if not done:
        raise FileNotFoundError(f"{out}: no whole batch")
    return spark.read.schema(BEST).parquet(*done.values())
