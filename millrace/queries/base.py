"""Registers queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans import dsl, sqlcompat
from ..session import register, table


class Catalogue:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLE: dict[str, str] = {}
        self.texts: list[str] = []

    def add(self, name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        assert name not in self.QUERIES, name
        self.QUERIES[name] = f
        if sql:
            self.ORACLE[name] = sql

    def query(self, sql: str | None = None) -> Callable:
        """Decorator: the function's name is the query's."""

        def deco(f: Callable) -> Callable:
            self.add(f.__name__, f, sql)
            return f

        return deco

    def dsl(self, name: str, text: str, sql: str) -> None:
        self.texts.append(text)
        self.add(name, lambda spark, d: dsl.run(text, lambda t: table(spark, d, t)), sql)

    def sql(self, name: str, text: str, duck: str | None = None) -> None:
        """A SQL model; ``duck`` where DuckDB spells it in another way."""

        def run(spark: SparkSession, d: str) -> DataFrame:
            register(spark, d)
            return sqlcompat.run_sql(spark, text)

        self.add(name, run, duck or text)
