"""Sinks: CSV, nested JSON, JSON lines, upserts and resumable output."""

from __future__ import annotations

from collections.abc import Sequence
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.events import pending, upsert
from .shared import read_or_empty, written


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, also where there are no rows."""
    if df.isEmpty():
        df.sparkSession.createDataFrame([(",".join(df.columns),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").option("header", True).csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Nested JSON documents, a line each, a file for each partition: with a file for each document, files and folders to make and list take most of the time."""
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Only the partitions that df holds are replaced: a rerun doesn't repeat rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert_files(df: DataFrame, path: str, key: str, into: str) -> None:
    """The rows at path (none, if nothing is there yet) with those of df put in by key, written to another folder (plain files aren't changed in place: see versions.VersionedTable)."""
    upsert(read_or_empty(df.sparkSession, path, df.schema), df, key).write.mode("overwrite").parquet(into)


def resume(df: DataFrame, path: str, on: Sequence[str]) -> int:
    """Append the rows whose key is not at path yet, all of them where nothing is; returns how many."""
    todo = written(pending(df, read_or_empty(df.sparkSession, path, df.schema).select(*on), on))
    n = todo.count()
    todo.write.mode("append").parquet(path)
    return n


def write_bar_chart(df: DataFrame, path: str, label: str, value: str, *, title: str = "", most: int = 200, height: float = 200.0) -> None:
    """An SVG drawing with a bar for each row, in order of the labels; a chart with more than ``most`` bars is refused."""
    rows = df.select(label, value).orderBy(label).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a chart has {most} bars at most")
    top = max([float(r[1]) for r in rows], default=0.0) or 1.0
    lines = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{24 * len(rows) + 20}" height="{height + 60:g}">', f"<title>{escape(title)}</title>"]
    for i, (name, n) in enumerate(rows):
        tall = round(height * float(n) / top, 2)
        lines.append(f'<rect class="bar" x="{24 * i + 10}" y="{height + 10 - tall:g}" width="20" height="{tall}" data-label={quoteattr(str(name))} data-value="{n}"/>')
        lines.append(f'<text x="{24 * i + 10}" y="{height + 30:g}">{escape(str(name))}</text>')
    lines.append("</svg>")
    df.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
