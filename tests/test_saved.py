"""Saved models: versions below a shared folder, reloaded in another session."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quarry.operators import models as M
from quarry.operators import saved

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ROWS = [(i, float(i % 7), "xyz"[i % 3], f"name{i % 150}", 3.0 * (i % 7) + "xyz".index("xyz"[i % 3]), "leak") for i in range(400)]
SCHEMA = "id long, a double, kind string, name string, y double, hint string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    train = spark.createDataFrame(ROWS, SCHEMA)
    layout, codes = saved.fit_layout(train, "y", leakage=["hint"], id_columns=["id"], encode=["kind", "name"])
    route = M.Route(M.REGRESSION, "y", M.FeatureSpec(numeric=layout.columns), "linear")
    model = saved.train_model(train, route, layout, codes, notes={"rows": len(ROWS)})
    assert saved.save(spark, path, model) == 1
    return path, model


def test_layout(stored):
    layout = stored[1].layout
    assert layout.indicators == {"kind": ["x", "y", "z"]} and layout.coded == ["name"]
    assert layout.columns == ["a", "name", "kind_y", "kind_z"] and layout.id_columns == ["id"]


def test_scores_in_a_new_session_are_equal(spark, stored, tmpdir_path):
    path, model = stored
    new = spark.createDataFrame(ROWS[:60], SCHEMA).drop("y").select("hint", "name", "kind", "a", "id")
    new.write.parquet(tmpdir_path + "/new")
    own = {r.id: r.y for r in saved.score(model, new).collect()}
    code = f"""
import sys, json; sys.path.insert(0, {ROOT!r})
from quarry.session import get_spark
from quarry.operators import saved
spark = get_spark("other", cpus="2", shuffle_partitions=2)
got = saved.load(spark, {path!r})
out = {{r.id: r.y for r in saved.score(got, spark.read.parquet({tmpdir_path + "/new"!r})).collect()}}
print("GOT", json.dumps([got.version, got.notes, out]))"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240)
    version, notes, out = json.loads(next(x for x in done.stdout.splitlines() if x.startswith("GOT"))[4:])
    assert version == 1 and notes == {"rows": 400}
    assert {int(k): v for k, v in out.items()} == own and len(own) == 60
    assert all(abs(own[r[0]] - r[4]) < 1e-6 for r in ROWS[:60])


def test_versions_are_whole_and_never_rewritten(spark, stored, tmpdir_path):
    path, model = tmpdir_path + "/store", stored[1]
    with pytest.raises(FileNotFoundError):
        saved.load(spark, path)
    assert [saved.save(spark, path, model) for _ in range(2)] == [1, 2]
    os.makedirs(path + "/v000003")              # a writer that is not done, or died
    open(path + "/v000003/claim", "w").close()
    assert saved.versions(spark, path) == [1, 2] and saved.load(spark, path).version == 2
    assert saved.save(spark, path, model) == 4 and saved.load(spark, path).version == 4
    assert saved.load(spark, path, 1).version == 1
    with pytest.raises(FileNotFoundError):
        saved.load(spark, path, 3)


def test_unseen_values_and_missing_columns(spark, stored):
    model = stored[1]
    new = spark.createDataFrame([(1, 2.0, "new", "name1"), (2, 2.0, None, "unseen"), (3, None, "z", None)],
                                "id long, a double, kind string, name string")
    rows = {r.id: r for r in saved.apply_layout(new, model.layout, model.codes, keep=["id"]).collect()}
    assert not rows[1].kind_y and not rows[1].kind_z and rows[1].name == 1.0
    assert rows[2].name is None and rows[3].kind_z and rows[3].a is None and rows[3].name is None
    assert saved.score(model, new).count() == 3
    assert saved.score(model, new.drop("name")).count() == 3
    with pytest.raises(ValueError, match="missing"):
        saved.score(model, new.select("id", "a"))
    assert saved.score(model, new.limit(0)).columns == ["id", "y"]


def test_classes_come_back_as_names(spark, tmpdir_path):
    train = spark.createDataFrame([(i, float(i % 10), "hi" if i % 10 > 4 else "lo") for i in range(200)], "id long, a double, y string")
    layout, codes = saved.fit_layout(train, "y")
    assert layout.id_columns == ["id"]           # found, not given
    route = M.Route(M.BINARY, "y", M.FeatureSpec(numeric=["a"]), "decision_tree")
    saved.save(spark, tmpdir_path, saved.train_model(train, route, layout, codes))
    out = saved.score(saved.load(spark, tmpdir_path), train.drop("y"))
    assert out.columns == ["id", "y", "probability"]
    assert {(r.id, r.y) for r in out.collect()} == {(i, "hi" if i % 10 > 4 else "lo") for i in range(200)}


def test_streamed_scores_equal_batch_scores(spark, stored, tmpdir_path):
    from quarry.streaming.leaderboard import start_saved_scoring
    path, model = stored
    new = spark.createDataFrame(ROWS, SCHEMA).drop("y")
    src, out, ckpt = (f"{tmpdir_path}/{x}" for x in ("src", "out", "ckpt"))
    new.where("id < 200").write.parquet(src)
    start_saved_scoring(spark, src, new.schema, path, out, checkpoint=ckpt).awaitTermination()
    new.where("id >= 200").write.mode("append").parquet(src)
    start_saved_scoring(spark, src, new.schema, path, out, checkpoint=ckpt).awaitTermination()
    want = {(r.id, r.y) for r in saved.score(model, new).collect()}
    got = spark.read.parquet(out).collect()
    assert len(got) == 400 and {(r.id, r.y) for r in got} == want
