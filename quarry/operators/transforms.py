"""Column cleaning transforms.

Each action is ``(df, column, **opts) -> DataFrame``.  Statistics an action
needs (mean, median, mode, quantile edges, category list) come from one
aggregate whose result is a single bounded row, applied as literals.  Category
lists are bounded by ``max_categories``; label codes for unbounded
cardinality are computed distributed (distinct -> row index -> join).
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.scalars import to_number, to_timestamp_safe
from quarry.operators.ordered import row_index

MAX_CATEGORIES = 1000


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def drop_nulls(df: DataFrame, column: str) -> DataFrame:
    """T1 drop rows where ``column`` is null (NaN counts as null)."""
    c = _q(column)
    cond = c.isNotNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        cond = cond & ~F.isnan(c)
    return df.filter(cond)


def _fill_with(df: DataFrame, column: str, stat: Column) -> DataFrame:
    x = to_number(_q(column))
    v = df.agg(stat.alias("v")).first()["v"]
    return df.withColumn(column, F.coalesce(x, F.lit(v).cast("double")) if v is not None else x)


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    """T2 numeric-coerce, null -> mean."""
    return _fill_with(df, column, F.avg(to_number(_q(column))))


def fill_median(df: DataFrame, column: str) -> DataFrame:
    """T3 numeric-coerce, null -> exact median (linear interpolation), from
    the distributed quantile sort rather than a single-task percentile buffer."""
    from quarry.operators.stats import exact_quantiles
    v = exact_quantiles(df, [column], [0.5])[column][0]
    x = to_number(_q(column))
    return df.withColumn(column, F.coalesce(x, F.lit(v).cast("double")) if v is not None else x)


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    """T4 null -> most frequent value, smallest on ties; all-null string -> ''."""
    from quarry.operators.stats import mode_value
    c = _q(column)
    v = mode_value(df, column)
    if v is None:
        if isinstance(df.schema[column].dataType, T.StringType):
            return df.withColumn(column, F.coalesce(c, F.lit("")))
        return df
    return df.withColumn(column, F.coalesce(c, F.lit(v).cast(df.schema[column].dataType)))


def _categories(df: DataFrame, column: str, max_categories: int) -> list:
    c = _q(column)
    vals = (df.select(c.alias("v")).where(c.isNotNull()).distinct()
            .orderBy("v").limit(max_categories + 1).collect())
    if len(vals) > max_categories:
        raise ValueError(f"{column}: more than {max_categories} categories; use label_encode")
    return [r["v"] for r in vals]


def _label(v) -> str:
    if isinstance(v, bool):
        return "True" if v else "False"
    return str(v)


def one_hot(df: DataFrame, column: str, max_categories: int = MAX_CATEGORIES,
            categories: Sequence | None = None) -> DataFrame:
    """T5 boolean indicator per sorted category, first dropped, columns named
    ``<col>_<value>`` appended at the end; null -> all false; original removed.
    ``categories`` freezes the list (scoring uses the training list)."""
    cats = list(categories) if categories is not None else _categories(df, column, max_categories)
    c = _q(column)
    new = [F.coalesce(c == F.lit(v), F.lit(False)).alias(f"{column}_{_label(v)}") for v in cats[1:]]
    return df.select(*[_q(x) for x in df.columns if x != column], *new)


def label_text(c: Column, dtype: T.DataType) -> Column:
    """String form used for label codes: null -> 'nan', booleans as True/False."""
    if isinstance(dtype, T.BooleanType):
        s = F.when(c, F.lit("True")).when(~c, F.lit("False"))
    else:
        s = c.cast("string")
    return F.coalesce(s, F.lit("nan"))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value text, code) with codes 0.. in sorted text order; distributed."""
    txt = label_text(_q(column), df.schema[column].dataType)
    distinct = df.select(txt.alias("_lbl")).distinct()
    return row_index(distinct, ["_lbl"], name="_code", tie_break=False)


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """T6 string-cast, sorted codes from 0, null -> class 'nan'."""
    codes = label_codes(df, column)
    txt = label_text(_q(column), df.schema[column].dataType)
    j = df.withColumn("_lbl", txt).join(codes, "_lbl", "left")
    return j.select(*[F.col("_code").alias(x) if x == column else _q(x) for x in df.columns])


def log_transform(df: DataFrame, column: str) -> DataFrame:
    """T7 log1p(max(coalesce(x, 0), 0))."""
    x = F.coalesce(to_number(_q(column)), F.lit(0.0))
    return df.withColumn(column, F.log1p(F.greatest(x, F.lit(0.0))))


def standardize(df: DataFrame, column: str) -> DataFrame:
    """T8 (x - mean) / (sample std + 1e-10)."""
    x = to_number(_q(column))
    r = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
    if r["m"] is None:
        return df.withColumn(column, x)
    s = r["s"] if r["s"] is not None else float("nan")
    return df.withColumn(column, (x - F.lit(r["m"])) / (F.lit(s) + F.lit(1e-10)))


def quantile_edges(df: DataFrame, column: str, bins: int = 5) -> list[float]:
    from quarry.operators.stats import exact_quantiles
    ps = [i / bins for i in range(bins + 1)]
    edges = [e for e in exact_quantiles(df, [column], ps)[column] if e is not None]
    return sorted(set(edges))


def bin_column(df: DataFrame, column: str, bins: int = 5) -> DataFrame:
    """T9 quantile bins 0..k-1 in ``<col>_binned``: right-closed, lowest value
    in the first bin, duplicate edges dropped."""
    edges = quantile_edges(df, column, bins)
    x = to_number(_q(column))
    if len(edges) < 2:
        val = F.lit(None).cast("long")
    else:
        below = functools.reduce(lambda a, b: a + b, [(x > F.lit(e)).cast("long") for e in edges[1:-1]],
                                 F.lit(0).cast("long"))
        val = F.when(x.isNotNull(), below)
    return df.withColumn(f"{column}_binned", val)


def drop_column(df: DataFrame, column: str) -> DataFrame:
    """T10."""
    return df.drop(column)


def to_numeric(df: DataFrame, column: str) -> DataFrame:
    """T11 unparsable -> null."""
    return df.withColumn(column, to_number(_q(column)))


def to_datetime(df: DataFrame, column: str) -> DataFrame:
    """T12 add ``_year``, ``_month``, ``_dayofweek`` (Mon=0); keep the original as ``_raw``."""
    ts = to_timestamp_safe(_q(column))
    out = df.withColumns({f"{column}_year": F.year(ts), f"{column}_month": F.month(ts),
                          f"{column}_dayofweek": F.weekday(ts)})
    return out.withColumnRenamed(column, f"{column}_raw")


ACTIONS = {
    "drop_nulls": drop_nulls, "fill_mean": fill_mean, "fill_median": fill_median,
    "fill_mode": fill_mode, "one_hot": one_hot, "label_encode": label_encode,
    "log_transform": log_transform, "standardize": standardize, "bin": bin_column,
    "drop_column": drop_column, "to_numeric": to_numeric, "to_datetime": to_datetime,
}


def transform(df: DataFrame, steps: Sequence[dict]) -> tuple[DataFrame, list[str]]:
    """T13 apply ``[{column, action, bins?}]`` in order; returns (result, log).
    Unknown columns are skipped with a log line; unknown actions raise.  The log counts
    what a step did: rows dropped, values filled, columns or classes made."""
    log: list[str] = []
    for step in steps:
        col, action = step.get("column", ""), step.get("action", "")
        if action not in ACTIONS:
            raise ValueError(f"unknown transform action {action!r}")
        if col and col not in df.columns:
            log.append(f"{action}: no column '{col}'")
            continue
        opts = {"bins": step["bins"]} if action == "bin" and "bins" in step else {}
        before, df = df, ACTIONS[action](df, col, **opts)
        log.append(f"{action} '{col}'" + _step_count(before, df, col, action))
    return df, log


def _step_count(before: DataFrame, after: DataFrame, col: str, action: str) -> str:
    if action in ("drop_nulls", "fill_mean", "fill_median", "fill_mode"):
        n = before.where(_q(col).isNull()).count()
        return f": {n} rows dropped" if action == "drop_nulls" else f": {n} values filled"
    if action == "one_hot":
        return f": {len(set(after.columns) - set(before.columns))} columns"
    if action == "label_encode":
        return f": {after.select(_q(col)).distinct().count()} classes"
    return ""


def hygiene(df: DataFrame) -> DataFrame:
    """T14 +-inf -> null in floating columns, then drop duplicate rows."""
    inf = F.lit(float("inf"))
    fixes = {f.name: F.when(F.abs(_q(f.name)) == inf, F.lit(None)).otherwise(_q(f.name))
             for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fixes).dropDuplicates() if fixes else df.dropDuplicates()


def date_like_ratio(c: Column) -> Column:
    """Share of non-null values that contain '-' or '/' and parse as a date."""
    s = c.cast("string")
    ok = (s.contains("-") | s.contains("/")) & to_timestamp_safe(s).isNotNull()
    return F.avg(F.when(s.isNotNull(), ok.cast("double")))


def date_columns_prep(df: DataFrame, threshold: float = 0.7) -> list[str]:
    """T15 string columns where >= 70 % of non-null values look like dates
    (ratio over all rows, not the first 20)."""
    cands = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cands:
        return []
    r = df.agg(*[date_like_ratio(_q(c)).alias(c) for c in cands]).first()
    return [c for c in cands if r[c] is not None and r[c] >= threshold]


DATE_NAME_PATTERN = r"(?i)(date|time|period|month|year|week|day)"


def detect_date_column(df: DataFrame, name_threshold: float = 0.7, any_threshold: float = 0.8) -> str | None:
    """T16 first column whose name mentions a date part and > 70 % parses;
    else the first string column with > 80 %; typed timestamp/date columns win."""
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return f.name
    cands = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cands:
        return None
    r = df.agg(*[F.avg(F.when(_q(c).isNotNull(), to_timestamp_safe(_q(c)).isNotNull().cast("double"))).alias(c)
                 for c in cands]).first()
    import re
    for c in cands:
        if re.search(DATE_NAME_PATTERN, c) and (r[c] or 0) > name_threshold:
            return c
    for c in cands:
        if (r[c] or 0) > any_threshold:
            return c
    return None


# Column names recognised as actual / predicted / date.
ACTUAL_NAMES = ("actual", "actuals", "y_true", "y_actual", "true")
PREDICTED_NAMES = ("predicted", "prediction", "pred", "forecast", "y_pred")
DATE_NAMES = ("date", "datetime", "time", "period", "timestamp")


def align_names(df: DataFrame) -> DataFrame:
    """T18 rename common label columns to actual / predicted / date."""
    mapping = {}
    for c in df.columns:
        lc = c.lower().strip()
        if lc in ACTUAL_NAMES:
            mapping[c] = "actual"
        elif lc in PREDICTED_NAMES:
            mapping[c] = "predicted"
        elif lc in DATE_NAMES:
            mapping[c] = "date"
    return df.withColumnsRenamed(mapping) if mapping else df


def clean_text_col(c: Column) -> Column:
    """T19 lowercase, strip HTML tags, strip punctuation, squeeze spaces."""
    s = F.lower(c)
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}\s]", "")
    s = F.regexp_replace(s, r"\s+", " ")
    return F.trim(s)


def clean_text(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, clean_text_col(_q(column)))


def forward_fill(df: DataFrame, columns: Sequence[str], order_by: Sequence, entity: Sequence[str] = (),
                 then_zero: bool = True, bucket_rows: int | None = None, idx: str | None = None) -> DataFrame:
    """T17 numeric-coerce, carry the last non-null value forward in order
    (per entity), then 0 for leading nulls.  Gap length is unbounded, so this
    uses the bucketed running 'last' with a carry between buckets."""
    from quarry.operators.ordered import DEFAULT_BUCKET_ROWS, running
    tmp = df.withColumns({f"__n_{c}": to_number(_q(c)) for c in columns})
    out = running(tmp, list(entity), order_by, [(f"__f_{c}", "last", f"__n_{c}") for c in columns],
                  bucket_rows=bucket_rows or DEFAULT_BUCKET_ROWS, idx=idx)
    fill = {c: (F.coalesce(F.col(f"__f_{c}"), F.lit(0.0)) if then_zero else F.col(f"__f_{c}")) for c in columns}
    return out.withColumns(fill).drop(*[f"__n_{c}" for c in columns], *[f"__f_{c}" for c in columns])

