"""Registry of checked queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalogue:
    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def check(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers the decorated query under ``name``."""

        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return register
