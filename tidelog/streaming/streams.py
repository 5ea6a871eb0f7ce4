"""Streaming forms: event-time windows and sessions with watermarks, and first-seen memory without duplicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.versions import VersionedTable


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files, or one file of it."""
    reader = spark.readStream.schema(schema)
    folder, _, name = path.rpartition("/")
    if _is_file(spark, path):
        reader, path = reader.option("pathGlobFilter", name), folder
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def windowed(events: DataFrame, ts: str, by: Sequence[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are dropped once their window has closed."""
    own = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return own.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(events: DataFrame, ts: str, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    own = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return own.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(items: DataFrame, ts: str, keys: Sequence[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark: the streaming form of a memory that skips what it holds."""
    return items.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for append mode: a folder for each batch, so that a batch that runs again replaces itself."""
    return lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}")


def whole(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for complete mode: every batch is the whole result so far and takes the last one's place."""
    return lambda batch, i: batch.write.mode("overwrite").parquet(path)


def latest(path: str, schema: StructType, key: Sequence[str], buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A sink for update mode: rows that changed are put into a versioned table by key; a batch that runs again changes nothing."""
    return lambda batch, i: VersionedTable(batch.sparkSession, path, schema, key, buckets=buckets).upsert(batch) and None


def into(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run all that is there through put(batch, id); with the checkpoint folder a rerun goes on where it stopped."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
