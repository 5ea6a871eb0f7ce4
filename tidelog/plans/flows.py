"""Streams, run over all that their source holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import versions
from ..streaming import streams
from .registry import query

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def drained(t, stream, mode="append", key=()):
    """The stream's rows, through a sink that fits the mode, in the shared folder."""
    at = t.scratch()
    put = {"append": streams.batches, "complete": streams.whole}[mode](f"{at}/rows") if mode != "update" else streams.latest(f"{at}/rows", stream.schema, key)
    streams.into(stream, put, f"{at}/checkpoint", mode)
    if mode == "update":
        return versions.VersionedTable(t.spark, f"{at}/rows", stream.schema, key).read()
    return t.spark.read.schema(stream.schema).parquet(f"{at}/rows")


def source(t):
    return streams.read(t.spark, f"{t.folder}/events.parquet", SCHEMA)


@query("STREAM1_tumbling_counts", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def tumbling(t):
    out = drained(t, streams.windowed(source(t), "ts", ["event_type"], "1 hour", late="60 days"), "update", ["event_type", "start"])
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "STREAM2_sessions",
    """
    SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts)
    AS s FROM (SELECT *, CAST(coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR, true)
    AS INTEGER) AS new FROM events)) GROUP BY user_id, s
    """,
)
def sessions(t):
    return drained(t, streams.sessions(source(t), "ts", "user_id", "2 hours"), "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("STREAM3_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def first_seen(t):
    return drained(t, streams.first_seen(source(t), "ts", ["user_id", "event_type"], "60 days")).select("user_id", "event_type")
