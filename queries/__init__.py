"""The registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTERED: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function of (spark, folder) under its name."""

    def add(run):
        REGISTERED[run.__name__] = Query(run, sql)
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


from queries import indexing, retrieval, textual  # noqa: E402,F401
