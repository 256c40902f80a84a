"""Registering queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; sql is the same for DuckDB, if SQL can say it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with `place`, a row's file and its number there: what SQL's arg_min takes first among equal orders."""
    return table(spark, sf_dir, name).select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt over the cores: a small file is one task, however much is worked out from each of its rows."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, key)
