"""Saved models (ST2, C2-C8): a fitted pipeline, its route and the table layout it was
trained on, kept together as one version below a shared folder.

    <path>/v000001/model        the Spark ML pipeline
    <path>/v000001/codes/<n>    value -> code tables of coded columns (parquet)
    <path>/v000001/card.json    route, layout and the caller's notes

``card.json`` is written last, so a version that has one is whole; versions are never
rewritten and readers pick the newest (or a stated one).  Everything is read and written
through Spark or its file systems, so a new session on other machines scores alike.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.models import FeatureSpec, Route, build_model, predict
from quarry.operators.scoring import align_features, drop_for_scoring
from quarry.operators.transforms import label_codes, label_text, one_hot

#: A column of more values is never made into indicator columns, however long the table.
MAX_INDICATORS = 10_000


@dataclass
class Layout:
    """What training decided about the columns of a table.

    ``columns``: features in order.  ``indicators``: values of the one-hot columns, in the
    order frozen at training.  ``coded``: columns replaced by codes (their tables lie with
    the model).  ``max_missing``: share of features a table may lack (they are 0)."""
    target: str | None = None
    columns: list[str] = field(default_factory=list)
    id_columns: list[str] = field(default_factory=list)
    leakage: list[str] = field(default_factory=list)
    indicators: dict[str, list[str]] = field(default_factory=dict)
    coded: list[str] = field(default_factory=list)
    max_missing: float = 0.5


@dataclass
class SavedModel:
    model: PipelineModel
    route: Route
    layout: Layout
    codes: dict[str, DataFrame]
    version: int | None = None
    notes: dict[str, Any] = field(default_factory=dict)


def fit_layout(train: DataFrame, target: str | None, leakage: Sequence[str] = (), id_columns: Sequence[str] | None = None,
               encode: Sequence[str] = (), max_missing: float = 0.5) -> tuple[Layout, dict[str, DataFrame]]:
    """C2-C4 the layout of a training table and the code tables of its coded columns.

    Ids are detected unless given.  A column of ``encode`` becomes indicator columns, or,
    with more than max(100, 0.5 % of the rows) values, codes in the order of its values;
    values are counted first and only short lists reach the driver."""
    kept, ids = drop_for_scoring(train, target, leakage, id_columns)
    layout = Layout(target, [], ids, list(leakage), {}, [], max_missing)
    codes: dict[str, DataFrame] = {}
    if encode:
        text = {c: label_text(F.col(f"`{c}`"), train.schema[c].dataType) for c in encode}
        n = train.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(t).alias(c) for c, t in text.items()]).first()
        for c in encode:
            if n[c] <= min(max(100, int(0.005 * n["n"])), MAX_INDICATORS):
                values = train.select(text[c].alias("v")).distinct().collect()     # bounded just above
                layout.indicators[c] = sorted(r["v"] for r in values)
            else:
                layout.coded.append(c)
                codes[c] = label_codes(train, c).select(F.col("_lbl").alias("value"), F.col("_code").cast("double").alias("code"))
    layout.columns = [c for c in apply_layout(kept, layout, codes, align=False).columns if c not in ids]
    return layout, codes


def apply_layout(df: DataFrame, layout: Layout, codes: dict[str, DataFrame], keep: Sequence[str] = (),
                 align: bool = True) -> DataFrame:
    """C2-C4 the features of a table as at training, behind the columns of ``keep``.

    Target and leakage go; indicator columns follow the frozen values (a null is the value
    ``nan``, unseen values are all false); codes come from the frozen tables (unseen: null);
    missing features are 0, others dropped.  Stateless, so it also runs on a stream."""
    aside = {c: f"__keep{i}" for i, c in enumerate(keep)}
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in layout.leakage and c != layout.target],
                    *[F.col(f"`{c}`").alias(a) for c, a in aside.items()])
    for c, values in layout.indicators.items():
        if c in out.columns:
            out = out.withColumn(c, label_text(F.col(f"`{c}`"), out.schema[c].dataType))
            out = one_hot(out, c, categories=values)
    for i, c in enumerate(layout.coded):
        if c in out.columns:
            table = codes[c].select(F.col("value").alias(f"__value{i}"), F.col("code").alias(f"__code{i}"))
            out = out.join(table, label_text(F.col(f"`{c}`"), out.schema[c].dataType) == F.col(f"__value{i}"), "left")
            out = out.select(*[F.col(f"__code{i}").alias(c) if x == c else F.col(f"`{x}`") for x in out.columns
                               if not x.endswith((f"__value{i}", f"__code{i}")) or x == c])
    if not align:
        return out.drop(*aside.values())
    align_features(out, layout.columns, layout.max_missing)     # raises where too many are missing
    return out.select(*[F.col(a).alias(c) for c, a in aside.items()],
                      *[F.col(f"`{c}`") if c in out.columns else F.lit(0).alias(c) for c in layout.columns if c not in aside])


def train_model(train: DataFrame, route: Route, layout: Layout, codes: dict[str, DataFrame],
                notes: dict[str, Any] | None = None) -> SavedModel:
    """Fit ``route`` on the features of the layout."""
    # the target is a column beside the features here
    features = apply_layout(train, Layout(**{**asdict(layout), "target": None}), codes, keep=[route.target])
    return SavedModel(build_model(route, features), route, layout, codes, None, dict(notes or {}))


def score(saved: SavedModel, df: DataFrame) -> DataFrame:
    """C2-C8 a new table's predictions in the layout ``id..., target`` (and ``probability`` or
    ``margin`` where the model has them), decoded to the training classes."""
    ids = [c for c in saved.layout.id_columns if c in df.columns]
    features = apply_layout(df, saved.layout, saved.codes, keep=ids)
    pred = predict(saved.model, features, saved.route, keep=ids)
    return pred.withColumnRenamed("predicted", saved.route.target)


# ------------------------------------------------------------------ files

def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, False)        # an existing file is an error
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _get(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _folder(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/v{version:06d}"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions below ``path``."""
    fs = _fs(spark, path)[0]
    return [v for v in _numbers(spark, path) if fs.exists(_fs(spark, _folder(path, v) + "/card.json")[1])]


def save(spark: SparkSession, path: str, saved: SavedModel) -> int:
    """Keep a model as the next version below ``path``; returns its number.

    The number is claimed by creating a file, so of two writers one takes the next."""
    version = max(_numbers(spark, path), default=0) + 1
    while True:
        try:
            _put(spark, _folder(path, version) + "/claim", "")
            break
        except Exception as e:  # noqa: BLE001 - py4j wraps FileAlreadyExistsException
            if "FileAlreadyExists" not in str(e):
                raise
            version += 1
    folder = _folder(path, version)
    saved.model.write().save(folder + "/model")
    for i, c in enumerate(saved.layout.coded):
        saved.codes[c].write.parquet(f"{folder}/codes/{i}")
    card = {"route": asdict(saved.route), "layout": asdict(saved.layout), "notes": saved.notes}
    _put(spark, folder + "/card.json", json.dumps(card, indent=1))
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> SavedModel:
    """The newest whole version below ``path``, or a stated one."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{path}: no saved model" + (f" of version {version}" if version else ""))
    version = version or known[-1]
    folder = _folder(path, version)
    card = json.loads(_get(spark, folder + "/card.json"))
    route = Route(**{**card["route"], "spec": FeatureSpec(**card["route"]["spec"])})
    layout = Layout(**card["layout"])
    codes = {c: spark.read.parquet(f"{folder}/codes/{i}") for i, c in enumerate(layout.coded)}
    return SavedModel(PipelineModel.load(folder + "/model"), route, layout, codes, version, card["notes"])
