"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def sql_round(c, digits: int):
    """round(x * 10^d) / 10^d on the double, which is how the SQL oracle rounds
    (Spark's own ``round`` rounds the exact decimal value instead; the two can
    differ when x lies within a rounding error of a tie)."""
    m = float(10 ** digits)
    return F.round(c * F.lit(m)) / F.lit(m)


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns the way the oracle does, at the very end."""
    fix = {f.name: sql_round(F.col(f"`{f.name}`"), digits) for f in df.schema.fields
           if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fix) if fix else df
