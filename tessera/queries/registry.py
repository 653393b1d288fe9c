"""Names, functions and SQL twins of a module's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} twice")
        self.queries[name] = run
        if sql:
            self.sql[name] = sql

    def __call__(self, name: str, sql: str | None = None):
        def wrap(f):
            self.add(name, f, sql)
            return f

        return wrap
