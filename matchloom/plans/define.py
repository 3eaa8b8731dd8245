"""Registration of queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.session import table


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.dir = spark, d

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)


class Group:
    """A set of queries. Decorate a function of Tables with the group, giving its SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            self.queries[f.__name__] = lambda spark, d: f(Tables(spark, d))
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
