"""Scoring new tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.profile import statistical_id


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def drop_for_scoring(df: DataFrame, target: str | None, leakage: Sequence[str] = (),
                     id_columns: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """C2 remove target, leakage and id columns; ids are detected with P14 when
    not given and kept aside (returned names) for the output layout."""
    cols = [c for c in df.columns if c != target and c not in leakage]
    if id_columns is None:
        ints = [f.name for f in df.schema.fields if f.name in cols and isinstance(
            f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.StringType))]
        id_columns = [r["name"] for r in statistical_id(df, ints).collect() if r["is_id"]] if ints else []
    return df.select(*[_q(c) for c in cols]), list(id_columns)


def align_features(df: DataFrame, columns: Sequence[str], max_missing: float = 0.5) -> DataFrame:
    """C3 exactly the training columns in training order: missing ones are 0,
    extra ones dropped; more than ``max_missing`` missing is an error."""
    missing = [c for c in columns if c not in df.columns]
    if columns and len(missing) / len(columns) > max_missing:
        raise ValueError(f"{len(missing)} of {len(columns)} expected columns are missing: {missing[:10]}")
    return df.select(*[(_q(c) if c in df.columns else F.lit(0).alias(c)) for c in columns])


def freeze_encoding(train: DataFrame, column: str) -> dict:
    """C4 what training decides about a categorical column: its sorted categories and
    whether they are one-hot columns or, beyond max(100, 0.5 % of the training rows),
    codes in the frozen order."""
    values = [r[0] for r in train.select(_q(column).cast("string")).where(_q(column).isNotNull()).distinct().collect()]
    return {"categories": sorted(values), "one_hot": len(values) <= max(100, int(0.005 * train.count()))}


def encode_like_training(df: DataFrame, column: str, categories: Sequence, as_codes: bool = False) -> DataFrame:
    """C4 one-hot with the category list frozen at training, or (``as_codes``, also frozen
    at training) codes in the frozen order, unseen values null."""
    from quarry.operators.transforms import one_hot
    if as_codes:
        table = df.sparkSession.createDataFrame([(str(v), i) for i, v in enumerate(categories)], "__v string, __code int")
        out = df.join(table, _q(column).cast("string") == F.col("__v"), "left")
        return out.select(*[F.col("__code").alias(c) if c == column else df[c] for c in df.columns])
    return one_hot(df, column, categories=categories)


def score(model, route, df: DataFrame, meta: dict) -> DataFrame:
    """C2-C8 score a new table with what training saved: ids kept aside, target and leakage
    dropped, features aligned to the training columns, categories as frozen, predictions
    under the target's name in the layout ``id, target``.

    ``meta``: ``columns`` (training features in order), ``id_columns``, ``leakage``,
    ``frozen`` ({column: categories for codes}), ``max_missing``."""
    from quarry.operators.models import predict
    ids = [c for c in meta.get("id_columns", []) if c in df.columns]
    feats, _ = drop_for_scoring(df, route.target, meta.get("leakage", ()), id_columns=ids)
    named = {c: f"__id_{c}" for c in ids}
    for column, categories in meta.get("frozen", {}).items():
        if column in feats.columns:
            feats = encode_like_training(feats, column, categories, as_codes=True)
    feats = feats.withColumns({a: _q(c) for c, a in named.items()})
    columns = list(meta["columns"])
    align_features(feats, columns, meta.get("max_missing", 0.5))       # raises where too many are missing
    aligned = feats.select(*[(_q(c) if c in feats.columns else F.lit(0).alias(c)) for c in columns],
                           *[_q(a) for a in named.values()])
    pred = predict(model, aligned, route, keep=list(named.values()))
    if route.task != "regression":
        pred = whole_number_predictions(pred, "predicted") if isinstance(
            pred.schema["predicted"].dataType, T.DoubleType) else pred
    return pred.select(*[_q(a).alias(c) for c, a in named.items()], F.col("predicted").alias(route.target))


def decode_labels(df: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    """C6 integer predictions -> sorted class names, only when every value is
    an integer inside the class range (checked by one aggregate)."""
    x = _q(column).cast("double")
    r = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx"),
               F.count(F.when(x != F.floor(x), 1)).alias("frac")).first()
    if r["mn"] is None or r["frac"] > 0 or r["mn"] < 0 or r["mx"] >= len(classes):
        return df
    arr = F.array(*[F.lit(str(c)) for c in classes])
    return df.withColumn(column, F.element_at(arr, x.cast("int") + 1))


def whole_number_predictions(df: DataFrame, column: str) -> DataFrame:
    """C7 0/1 float predictions become integers (after a min/max check)."""
    x = _q(column)
    r = df.agg(F.count(F.when(~x.isin(0.0, 1.0), 1)).alias("other")).first()
    return df.withColumn(column, x.cast("int")) if r["other"] == 0 else df


def layout(pred: DataFrame, id_column: str | None, targets: Sequence[str],
           predicted: Sequence[str] = ("predicted",)) -> DataFrame:
    """C8 output ``id, target...``: prediction columns renamed to the target
    names of the sample layout, in its order."""
    cols = ([_q(id_column)] if id_column else []) + [_q(p).alias(t) for p, t in zip(predicted, targets)]
    return pred.select(*cols)


def forecast_table(pred: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """C9 predictions on the unlabelled companion with id / date passed
    through (every row, not only the last)."""
    from quarry.operators.transforms import align_names
    return align_names(pred.select(*keep, "predicted"))


def prediction_summary(pred: DataFrame, actual: str | None = "actual", predicted: str = "predicted",
                       order_by: Sequence | None = None, preview: int = 10) -> tuple[DataFrame, DataFrame]:
    """C10 (rows, mae) and a preview of ``preview`` rows in a stated order."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if actual:
        aggs.append(F.avg(F.abs(_q(predicted) - _q(actual))).alias("mae"))
    head = pred.orderBy(*(order_by or pred.columns[:1])).limit(preview)
    return pred.agg(*aggs), head
