"""The registered queries of the corpus operators, with the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from typeloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``oracle`` is its SQL, left out where SQL cannot say it."""

    def register(function: Query) -> Query:
        @wraps(function)
        def shipped(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf)

        QUERIES[name] = shipped
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf}/{table}.parquet")
