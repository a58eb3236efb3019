"""A query is a Spark callable, optionally paired with SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from claimweave.session import comparable

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    """Named queries; results leave through ``comparable``."""

    queries: dict[str, Query]
    oracles: dict[str, str]

    @classmethod
    def empty(cls) -> "Registry":
        return cls({}, {})

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return comparable(query(spark, sf_dir))

            run.__name__, run.__doc__ = name, query.__doc__
            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = sql
            return query

        return register
