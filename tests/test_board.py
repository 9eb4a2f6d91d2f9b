"""Incremental leaderboard: several batches, restarts and compaction against the batch operators."""

import glob

import pytest

from quarry.operators import explog as L
from quarry.operators.ordered import row_index
from quarry.plans import fixtures as X
from quarry.streaming import board as B
from quarry.streaming.leaderboard import leaderboard_aggregate

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    kept = X.explog(spark, SF).select("run_id", "num", "model", "metric_val", "status").persist()
    yield kept
    kept.unpersist()


def _slices(log, n):
    last = log.agg({"num": "max"}).first()[0]
    return [log.where(f"num * {n} > {k * last} AND num * {n} <= {(k + 1) * last}") for k in range(n)]


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("lower", [True, False])
def test_board_equals_the_batch_one_after_batches_and_restarts(spark, log, tmpdir_path, lower):
    src, out, ckpt = (f"{tmpdir_path}/{x}" for x in ("src", "out", "ckpt"))
    with pytest.raises(FileNotFoundError):
        B.read_board(spark, out)
    seen = None
    for part in _slices(log, 3):
        part.repartition(3).write.mode("append").parquet(src)
        B.start_board(spark, src, log.schema, out, lower, files_per_batch=1, compact_every=2, checkpoint=ckpt).awaitTermination()
        seen = part if seen is None else seen.unionAll(part)
        assert _rows(B.read_board(spark, out)) == _rows(leaderboard_aggregate(seen, lower))
    best = {r.model: r.best_value for r in L.leaderboard(log.selectExpr("*", "cast(null as double) AS test_rmse"), lower).collect()}
    got = {}
    for r in B.read_board(spark, out).collect():
        if r.best_value is not None:
            got[r.model] = (min if lower else max)(got.get(r.model, r.best_value), r.best_value)
    assert got == best
    # nine batches, a base every second: old bases and what they hold are gone
    assert len(glob.glob(out + "/base/*")) == 2 and len(glob.glob(out + "/delta/*")) == 3


def test_a_batch_writes_changed_keys_only(spark, log, tmpdir_path):
    src, out, ckpt = (f"{tmpdir_path}/{x}" for x in ("src", "out", "ckpt"))
    log.coalesce(1).write.parquet(src)
    B.start_board(spark, src, log.schema, out, checkpoint=ckpt).awaitTermination()
    one = spark.createDataFrame([(1, 10_000, "new", 0.5, "keep")], log.schema)
    one.coalesce(1).write.mode("append").parquet(src)
    B.start_board(spark, src, log.schema, out, checkpoint=ckpt).awaitTermination()
    newest = sorted(glob.glob(out + "/delta/*"))[-1]
    assert [tuple(r) for r in spark.read.parquet(newest).select("run_id", "model", "best_value", "n").collect()] == [(1, "new", 0.5, 1)]
    # a batch that is run again changes nothing
    before = _rows(B.read_board(spark, out))
    B.compact(spark, out, 1)
    B.compact(spark, out, 1)
    assert _rows(B.read_board(spark, out)) == before


@pytest.mark.parametrize("lower", [True, False])
def test_running_best_equals_the_batch_one(spark, log, tmpdir_path, lower):
    src, out, ckpt = (f"{tmpdir_path}/{x}" for x in ("src", "out", "ckpt"))
    for part in _slices(log, 3):
        part.repartition(2, "run_id").write.mode("append").parquet(src)
        B.start_running_best(spark, src, log.schema, out, lower, files_per_batch=1, checkpoint=ckpt).awaitTermination()
    want = {(r.run_id, r.num): r.running_best for r in L.running_best(log, lower).collect()}
    got = B.read_running_best(spark, out).collect()
    assert {(r.run_id, r.num): r.running_best for r in got} == want and len(got) == len(want)
    prev = {}
    for r in sorted(got, key=lambda r: (r.run_id, r.num)):
        assert r.is_new_best == (prev.get(r.run_id) != r.running_best)
        prev[r.run_id] = r.running_best
