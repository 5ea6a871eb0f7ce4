"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset a local master gets a temporary one, as in tests; a cluster must name one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/tidelog-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in a fresh folder: every use sees the same rows, and lost executors cost a reread."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Small files below a path of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.base = spark, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}".rstrip("/"))

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """The entries of a folder; none where it doesn't exist."""
        at = self._path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a file whole, under a name of its own first; False where the name is taken already. At no time does a part of it stand under its name."""
        jvm = self.spark._jvm
        parent, _, last = name.rpartition("/")
        early, late = self._path(f"{parent}/.{last}-{uuid.uuid4().hex}"), self._path(name)
        stream = self.fs.create(early, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(early, late, none)
        except Exception as error:  # noqa: BLE001  (of the JVM: only a taken name is an answer)
            if "FileAlreadyExists" not in str(error):
                raise
            self.fs.delete(early, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet rows at a path; none where nothing was written yet."""
    return spark.read.schema(schema).parquet(path) if Folder(spark, path).exists() else spark.createDataFrame([], schema)
