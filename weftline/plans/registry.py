"""Where queries are registered, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of a table reader under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])
