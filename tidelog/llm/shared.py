"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in most operators: a blank or one of the ASCII controls 9 to 13.
BLANKS = "[\\x20\\x09-\\x0D]+"


#: The most bytes of an Arrow batch that goes to a Python worker (one row at least): ten thousand long texts would fill its memory.
BATCH_BYTES = 8_000_000


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Holds the session's Arrow batches to so many bytes; a smaller setting of the caller's stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(name, str(most))


#: What the modules of this subpackage keep in a Python worker for the length of a task.
KEPT: list[dict] = []


def give_back(caches: bool = True) -> None:
    """Empties the caches and returns free memory to the system: an idle worker stands beside the JVM's next stages."""
    for cache in KEPT if caches else ():
        cache.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it has
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def eased(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over a task's batches that gives back its worker's memory at the end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own serves a local master, as in tests; a cluster must name one."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not own:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = getattr(spark.sparkContext, "_tidelog_dir", None) or f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
        spark.sparkContext._tidelog_dir = own
    return own


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


#: Whether a query's shuffle files go when it has ended, rather than when the driver's JVM collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is made and run meanwhile leaves no shuffle files behind."""
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def settled(df: DataFrame, label: str) -> DataFrame:
    """materialize() for one of many steps: the shuffles that made df leave no files behind."""
    with tidy(df.sparkSession):
        return materialize(df, label)


def dropped(*tables: DataFrame) -> None:
    """Deletes what materialize() or settled() gave back, once all that reads these tables has been written itself."""
    for t in tables:
        discard(t.sparkSession, t.written_at)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that materialize() wrote, once all that reads it has been written itself."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column, blanks: str = BLANKS) -> Column:
    """The words of a text as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), blanks), "")


def total_chars(docs: DataFrame, text: str = "text") -> int:
    """Characters of all texts, to size blocks by; one cheap pass."""
    return docs.agg(F.sum(F.length(text))).first()[0] or 0
