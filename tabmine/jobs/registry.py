"""The registry of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.functions.columns import rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def report(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree; ``other`` has digits by column."""
    return df.select(*[rounded(F.col(c), other.get(c, digits)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
