"""Registry of named queries (Spark builders) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from mixlab.plans.oracle_fixtures import with_fx

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []

ROUND_DIGITS = 6


def register(name: str, sql: str | None = None, fx: Sequence[str] = (), headline: bool = False):
    """Register ``fn(spark, sf_dir) -> DataFrame``; ``sql`` is its oracle
    (omit for operators that SQL cannot express: rows-only check)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_fx(sql, *fx)
        if headline:
            HEADLINE.append(name)
        return fn

    return deco


def rounded(df: DataFrame, digits: int = ROUND_DIGITS) -> DataFrame:
    """Round every floating column so results hash equal across engines."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
