"""How a plan module registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """``queries`` and ``sql`` of one module. A query without SQL is one that DuckDB's SQL cannot express on whole tables: sketches, fitted models, rounds of PageRank, parsers, erfc."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(run: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return run

        return keep
