"""Empty tables, all-null columns and single rows."""

from pyspark.sql import functions as F

from quarry.operators import charts as C
from quarry.operators import joins as J
from quarry.operators import ordered as O
from quarry.operators import profile as P
from quarry.operators import stats as S
from quarry.operators import transforms as T


def test_profile_all_null_and_single_row(spark):
    df = spark.createDataFrame([(1, None, "a")], "id long, x double, s string")
    rows = {r["name"]: r for r in P.profile_columns(df).collect()}
    assert rows["x"]["type"] == "empty" and rows["x"]["nulls"] == 1
    assert rows["id"]["type"] == "numeric" and rows["id"]["skew"] is None


def test_profile_empty_table(spark):
    df = spark.createDataFrame([], "id long, s string")
    rows = P.profile_columns(df).collect()
    assert {r["name"] for r in rows} == {"id", "s"}


def test_quantiles_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert S.exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_row_index_and_running_on_empty(spark):
    df = spark.createDataFrame([], "k long, t long, v double")
    assert O.row_index(df, ["t"], ["k"]).count() == 0
    assert O.running(df, ["k"], ["t"], [("c", "sum", "v")]).count() == 0


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(5.0,)] * 7, "x double")
    h = C.histogram(df, "x").orderBy("bin").collect()
    assert len(h) == 10 and sum(r["count"] for r in h) == 7 and h[0]["lo"] == 4.5 and h[-1]["hi"] == 5.5


def test_fill_and_bin_on_all_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, x double")
    assert [r["x"] for r in T.fill_median(df, "x").collect()] == [None, None]
    assert [r["x_binned"] for r in T.bin_column(df, "x").collect()] == [None, None]


def test_auto_join_with_empty_side(spark):
    a = spark.createDataFrame([(1, "x")], "cust_id long, v string")
    b = spark.createDataFrame([], "cust_id long, w string")
    out, info = J.auto_join({"a": a, "b": b})
    assert out.count() == 1 and info["key"] == "cust_id"
    assert F is not None
