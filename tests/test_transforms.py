"""Cleaning transforms against pandas semantics on hand-made rows."""

import math

import pandas as pd

from quarry.operators import transforms as T


def rows(df, col):
    return [r[col] for r in df.orderBy("id").collect()]


def test_fill_mode_prefers_smallest_on_ties(spark):
    df = spark.createDataFrame(pd.DataFrame({"id": range(6), "c": ["b", "a", None, "b", "a", None]}))
    assert rows(T.fill_mode(df, "c"), "c") == ["b", "a", "a", "b", "a", "a"]


def test_fill_mode_all_null_is_empty_string(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, c string")
    assert rows(T.fill_mode(df, "c"), "c") == ["", ""]


def test_fill_median_and_mean(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 4.0), (4, 10.0)], "id int, x double")
    assert rows(T.fill_median(df, "x"), "x") == [1.0, 4.0, 4.0, 10.0]
    assert rows(T.fill_mean(df, "x"), "x") == [1.0, 5.0, 4.0, 10.0]


def test_to_numeric_rejects_java_suffixes(spark):
    df = spark.createDataFrame([(1, "1d"), (2, " 2.5 "), (3, "n/a"), (4, "1e3"), (5, "NaN")], "id int, s string")
    assert rows(T.to_numeric(df, "s"), "s") == [None, 2.5, None, 1000.0, None]


def test_label_encode_sorted_with_nan_class(spark):
    # a CSV read gives NaN for missing text, which pandas turns into 'nan'
    pdf = pd.DataFrame({"id": range(5), "c": ["b", float("nan"), "a", "b", "c"]})
    sdf = spark.createDataFrame([(i, None if isinstance(v, float) else v) for i, v in zip(pdf.id, pdf.c)],
                                "id long, c string")
    got = rows(T.label_encode(sdf, "c"), "c")
    classes = sorted(pdf["c"].astype(str).unique())
    assert got == [classes.index(v) for v in pdf["c"].astype(str)]


def test_one_hot_drops_first_and_nulls_false(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "id int, c string")
    out = T.one_hot(df, "c")
    assert out.columns == ["id", "c_y", "c_z"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, False, False), (2, True, False), (3, False, False),
                                                               (4, False, True)]


def test_bin_matches_qcut_with_duplicate_edges(spark):
    vals = [1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 100.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, x double")
    exp = pd.qcut(pd.Series(vals), q=5, labels=False, duplicates="drop").tolist()
    assert rows(T.bin_column(df, "x", 5), "x_binned") == exp


def test_standardize_and_log(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, -3.0)], "id int, x double")
    s = pd.Series([1.0, 2.0, None, -3.0])
    exp = ((s - s.mean()) / (s.std() + 1e-10)).tolist()
    got = rows(T.standardize(df, "x"), "x")
    assert all((a is None and math.isnan(b)) or abs(a - b) < 1e-12 for a, b in zip(got, exp))
    assert rows(T.log_transform(df, "x"), "x") == [math.log1p(1.0), math.log1p(2.0), 0.0, 0.0]


def test_to_datetime_parts_and_raw(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "bad")], "id int, d string")
    out = T.to_datetime(df, "d")
    assert out.columns == ["id", "d_raw", "d_year", "d_month", "d_dayofweek"]
    r = out.orderBy("id").collect()
    assert (r[0]["d_year"], r[0]["d_month"], r[0]["d_dayofweek"]) == (2024, 1, 0)
    assert r[1]["d_year"] is None


def test_transform_log_skips_unknown_column(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, x double")
    out, log = T.transform(df, [{"column": "nope", "action": "drop_nulls"}, {"column": "x", "action": "to_numeric"}])
    assert "no column 'nope'" in log[0] and out.count() == 1


def test_hygiene_drops_duplicates_and_inf(spark):
    df = spark.createDataFrame([(1, float("inf")), (1, float("inf")), (2, 1.0)], "id int, x double")
    assert sorted((r["id"], r["x"]) for r in T.hygiene(df).collect()) == [(1, None), (2, 1.0)]


def test_clean_text(spark):
    df = spark.createDataFrame([(1, "<p>Hello, <b>World</b>!</p>")], "id int, t string")
    assert T.clean_text(df, "t").first()["t"] == "hello world"


def test_align_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x")], "y_true double, Prediction double, Period string")
    assert T.align_names(df).columns == ["actual", "predicted", "date"]
