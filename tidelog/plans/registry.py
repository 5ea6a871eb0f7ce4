"""name to query and name to SQL; a query gets the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """tables.events is the events table, and so on."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self) -> str:
        """A fresh folder that driver and executors share."""
        return fresh_folder(self.spark)


def query(name: str, sql: str | None = None) -> Callable:
    def add(run: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: run(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return run

    return add
