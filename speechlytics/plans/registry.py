"""How a module states its queries: a function (spark, sf_dir) -> DataFrame and, where possible, the same in SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from speechlytics.session import ship_package

Run = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.runs: dict[str, Run] = {}
        self.sqls: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Run], Run]:
        def add(run: Run) -> Run:
            key = name or run.__name__
            if key in self.runs:
                raise ValueError(f"query {key} is stated twice")

            @functools.wraps(run)
            def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship_package(spark)
                return run(spark, sf_dir)

            self.runs[key] = shipped
            if sql is not None:
                self.sqls[key] = sql
            return run

        return add

    def merge(self, *others: Registry) -> Registry:
        for other in others:
            both = self.runs.keys() & other.runs.keys()
            if both:
                raise ValueError(f"queries stated twice: {sorted(both)}")
            self.runs |= other.runs
            self.sqls |= other.sqls
        return self
