"""Named queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType

from photolake.plans.oracle_views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn`` under ``name``; ``sql`` may use the named views (space separated)."""
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn
    return register


def half_away(value: Column, digits: int) -> Column:
    """Round half away from zero in binary arithmetic, as DuckDB's ``round`` does."""
    unit = F.lit(float(10 ** digits))
    x = value.cast("double") * unit
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(-F.floor(-x + 0.5)).cast("double") / unit


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, so that both engines print the same digits."""
    return df.select(*[
        half_away(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema.fields])
