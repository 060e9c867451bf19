"""Queries by name, with their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.tables import read

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of a directory, by attribute; each is one DataFrame, however often it is named."""

    def __init__(self, spark: SparkSession, directory: str):
        self._read = lambda name: read(spark, directory, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        self.__dict__[name] = self._read(name)
        return self.__dict__[name]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"two queries {name}")
        self.queries[name] = lambda spark, directory: build(Tables(spark, directory))
        if sql:
            self.sql[name] = sql
