"""How queries and their SQL are listed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with the DuckDB SQL of those that SQL can tell."""

    def __init__(self, common: str = ""):
        self.common = common
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, common: bool = True) -> Callable[[Query], Query]:
        """Lists a query under its function's name; sql goes behind the common table expressions."""

        def listed(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.oracles[query.__name__] = (f"WITH {self.common}\n{sql}" if common and self.common else sql).strip()
            return query

        return listed


def r4(x: Column | str) -> Column:
    """Four decimals, halves up: what sums in another order agree on."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 10000 + 0.5) / 10000


def r4_sql(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"
