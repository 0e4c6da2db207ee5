"""Registry of named queries over the driver's tables, with their SQL counterparts."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.session import ship_package, spread

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = shipped(fn)
            if oracle is not None:
                self.oracles[name] = oracle
            return fn

        return register


def shipped(fn: Query) -> Query:
    """The query with this package on the executors first."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    return run


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """One driver table; heavy=True spreads a small scan over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if heavy else df
