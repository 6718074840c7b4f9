"""Where the plans put their queries: a function (spark, sf_dir) and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a plan under its function's name."""

    def put(plan: Query) -> Query:
        QUERIES[plan.__name__] = plan
        if sql:
            SQL[plan.__name__] = sql
        return plan

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
