"""Memory items by scope: append, search, delete."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import read_or_empty, written
from ..sources.versions import VersionedTable
from . import vectors
from .events import pending, running_numbers

SCOPES = ("user_id", "agent_id", "app_id", "run_id")


class Provider(Protocol):
    """A store of memory items."""

    def add(self, items: DataFrame) -> None: ...

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...

    def delete(self, scope: Mapping[str, str], filters: Mapping[str, str]) -> None: ...


def in_scope(scope: Mapping[str, object]) -> Column:
    """Rows that agree with every scope id that is given; ids that are not given don't bind."""
    out = F.lit(True)
    for name, value in scope.items():
        if value is not None:
            out = out & F.coalesce(F.col(name) == F.lit(value), F.lit(False))
    return out


class FrameStore:
    """Items (item_id, text, position and scope columns) as a DataFrame: a plan that grows with each change, and is written down after ``most`` of them."""

    def __init__(self, items: DataFrame, entity: str = "user_id", most: int = 50) -> None:
        self.items, self.entity, self.most, self.changes = items, entity, most, 0

    def _changed(self, items: DataFrame) -> None:
        self.changes = (self.changes + 1) % self.most
        self.items = items if self.changes else written(items)

    def add(self, items: DataFrame) -> None:
        self._changed(self.items.unionByName(items, allowMissingColumns=True))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return vectors.lexical(queries, self.items, entity=self.entity, query_id="query_id", needle="needle", text="text", position="position", k=k)

    def delete(self, scope: Mapping[str, object], filters: Mapping[str, object] = {}) -> None:  # noqa: B006
        """What agrees with the scope and all filters goes; at least one condition is needed."""
        if not any(v is not None for v in (*scope.values(), *filters.values())):
            raise ValueError("a delete needs a scope or a filter")
        self._changed(self.items.where(~(in_scope(scope) & in_scope(filters))))


def pages(items: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """The items with the page (from 1) that a listing in this order shows them on."""
    return running_numbers(items, list(order), "__n").withColumn("page", F.ceil(F.col("__n") / size)).drop("__n")


def delete_pages(table: VersionedTable, listed: DataFrame, delete: Callable[[VersionedTable, DataFrame], object] = VersionedTable.delete) -> int:
    """Delete what a listing holds from a table, all its pages in one commit; where that is refused (an OSError), page by page. Returns the number of commits."""
    try:
        delete(table, listed)
        return 1
    except OSError:
        own = written(listed)
        numbers = [r["page"] for r in own.select("page").distinct().orderBy("page").collect()]
        for n in numbers:
            delete(table, own.where(F.col("page") == n))
        return len(numbers)


class EntityStores:
    """Documents with texts and vectors, in folders by entity; an entity is built whole and once."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, entity: str) -> None:
        self.spark, self.path, self.schema, self.entity = spark, path, schema, entity

    def read(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, self.schema)

    def build(self, docs: DataFrame) -> int:
        """Write the documents of entities that have no store yet; returns how many entities."""
        todo = written(pending(docs, self.read().select(self.entity).distinct(), [self.entity]))
        n = todo.select(self.entity).distinct().count()
        if n:
            todo.write.mode("append").partitionBy(self.entity).parquet(self.path)
        return n


class FileStore:
    """Facts as rows in a folder: they are normalised, kept back, and appended when they are flushed, again if a write fails."""

    def __init__(self, spark: SparkSession, path: str, schema: str, *, attempts: int = 3, write: Callable[[DataFrame, str], None] | None = None) -> None:
        self.spark, self.path, self.schema, self.attempts = spark, path, schema, attempts
        self.write = write or (lambda df, at: df.write.mode("append").parquet(at))
        self.waiting: list[DataFrame] = []

    def store(self, facts: DataFrame, text: str = "text") -> None:
        """Texts lose blanks at their ends and runs of blanks; facts without text are left out."""
        clean = facts.withColumn(text, F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\\s+", " ")))
        self.waiting.append(clean.where(F.col(text) != ""))

    def flush(self) -> int:
        """Writes what was kept back, one table after the other; returns how many tables."""
        done = 0
        while self.waiting:
            for turn in range(self.attempts):
                try:
                    self.write(self.waiting[0], self.path)
                    break
                except OSError:
                    if turn + 1 == self.attempts:
                        raise
            self.waiting.pop(0)
            done += 1
        return done

    def items(self) -> DataFrame:
        """What was flushed so far."""
        return read_or_empty(self.spark, self.path, self.schema)
