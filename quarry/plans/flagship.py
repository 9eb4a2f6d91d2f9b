"""Flagship query: discover the key of lineitem and orders, outer-join them,
and profile every column of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.joins import auto_join
from quarry.operators.profile import profile_columns
from quarry.session import keep_table, read_table

FLAT = ["position", "name", "type", "unique", "nulls", "null_pct", "mean", "std", "min", "max",
        "p25", "p50", "p75", "skew", "majority_pct", "avg_len"]


def joined(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    li = read_table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "orderkey")
    o = read_table(spark, sf, "orders").withColumnRenamed("o_orderkey", "orderkey")
    return auto_join({"lineitem.csv": li, "orders.csv": o})


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    df, _info = joined(spark, sf)
    # the profile reads its input several times, each time the columns it needs: the join is
    # written once as a columnar table
    df = keep_table(df, "flagship")
    return profile_columns(df).select(*FLAT)
