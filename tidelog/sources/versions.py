"""A table by key that changes in versions: files are never changed, a manifest names those that count.

An update writes new files for the buckets of keys that really change, and then a manifest that names them beside the
untouched ones. The manifest's name is its version's number, and it gets that name by a rename that fails where the name is
taken: readers see the old version or the new one, a writer that dies before the rename leaves files that nobody reads,
and of two writers from one version the later one fails and nothing of it is seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import Folder


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class VersionedTable:
    """Rows with unique keys at a path, from nothing on: reads of a table that was never written are empty.

    Rows lie in ``buckets`` (fixed with the first version) by a hash of ``by``, or else of the key, and in a file in order
    of ``by`` and the key. The driver holds one name for each bucket; a bucket is one task, so ``by`` is for entities of moderate size.

    Edge cases: columns that are missing in an update are null and others are left out; a null key is a key; of rows of one
    update with the same key the one with the greatest content counts, so that a rerun gives the same table; an update
    that changes nothing writes nothing and makes no version.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: Sequence[str], *, by: Sequence[str] = (), buckets: int = 16) -> None:
        self.spark, self.path, self.key, self.by = spark, path.rstrip("/"), list(key), list(by)
        self.schema = spark.createDataFrame([], schema).schema
        self.folder = Folder(spark, self.path)
        self._buckets = buckets

    def version(self) -> int:
        """The number of the last version; 0: nothing was written yet."""
        return max((int(n[1:-5]) for n in self.folder.names("versions") if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """version, buckets, and the folder of each bucket that has rows."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "buckets": self._buckets, "folders": {}}
        return json.loads(self.folder.text(f"versions/v{version}.json"))

    def read(self, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version (the last one), or of some of its buckets."""
        folders = self.manifest(version)["folders"]
        paths = [f"{self.path}/{at}/vt_bucket={b}" for b, at in folders.items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*(self.by or self.key)), F.lit(n)).cast("int")

    def _shaped(self, df: DataFrame) -> DataFrame:
        own = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])
        rest = [f.name for f in self.schema if f.name not in self.key]
        # One row a key: partial maxima, no window.
        return own.groupBy(*self.key).agg(F.max(F.struct(F.lit(0).alias("_"), *rest)).alias("__row")).select(*self.key, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*self.schema.names)

    def _same_key(self, a: DataFrame, b: DataFrame) -> Column:
        out = F.lit(True)
        for c in self.key:
            out = out & a[c].eqNullSafe(b[f"__{c}"])
        return out

    def _keys(self, df: DataFrame, *more: Column) -> DataFrame:
        return df.select(*[F.col(c).alias(f"__{c}") for c in self.key], *more)

    def upsert(self, df: DataFrame) -> int:
        """Put rows in by key; returns the version that holds them, the last one if nothing changes."""
        new, now = self._shaped(df), self.manifest()
        content = F.struct(*self.schema.names)
        held = self._keys(self.read(now["version"]), content.alias("__content"), self._bucket(now["buckets"]).alias("__bucket"))
        met = new.withColumns({"__new": content, "vt_bucket": self._bucket(now["buckets"])}).join(held, self._same_key(new, held), "left")
        changed = self._kept(met.where(~F.col("__content").eqNullSafe(F.col("__new"))).select("vt_bucket", "__bucket", *self.schema.names))
        # A row whose ``by`` changes leaves its bucket: both are written anew.
        return self._commit(now, changed.select(*self.schema.names, "vt_bucket"), changed, changed.select(F.explode(F.array("vt_bucket", "__bucket")).alias("b")))

    def append_new(self, df: DataFrame) -> int:
        """Put in the rows whose key is not there yet; returns how many."""
        new, now = self._shaped(df), self.manifest()
        held = self._keys(self.read(now["version"]))
        fresh = self._kept(new.withColumn("vt_bucket", self._bucket(now["buckets"])).join(held, self._same_key(new, held), "left_anti"))
        n = fresh.count()
        self._commit(now, fresh, fresh, fresh.select(F.col("vt_bucket").alias("b")))
        return n

    def delete(self, keys: DataFrame) -> int:
        """Rows with these keys go; returns the version without them."""
        now = self.manifest()
        rows = self.read(now["version"]).withColumn("vt_bucket", self._bucket(now["buckets"]))
        asked = self._keys(keys.select(*self.key).distinct())
        gone = self._kept(rows.join(asked, self._same_key(rows, asked), "left_semi"))
        return self._commit(now, gone.where("false"), gone, gone.select(F.col("vt_bucket").alias("b")))

    def _kept(self, df: DataFrame) -> DataFrame:
        """Written beside the data: it is counted, dealt and written from the same rows."""
        self._changes = f"changes/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{self._changes}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self._changes}")

    def _commit(self, now: dict, put: DataFrame, gone: DataFrame, buckets: DataFrame) -> int:
        """The rows of some buckets without the keys of ``gone`` and with ``put``, as the next version."""
        touched = sorted(r["b"] for r in buckets.where("b IS NOT NULL").distinct().collect())  # no more than buckets
        if not touched:
            self.folder.delete(self._changes)
            return now["version"]
        old = self.read(now["version"], touched).withColumn("vt_bucket", self._bucket(now["buckets"]))
        less = self._keys(gone)
        rows = old.join(less, self._same_key(old, less), "left_anti").unionByName(put)
        at = f"data/{uuid.uuid4().hex}"
        rows.repartition("vt_bucket").sortWithinPartitions("vt_bucket", *self.by, *self.key).write.partitionBy("vt_bucket").parquet(f"{self.path}/{at}")
        written = {n.partition("=")[2] for n in self.folder.names(at) if n.startswith("vt_bucket=")}
        folders = {b: f for b, f in now["folders"].items() if int(b) not in touched} | dict.fromkeys(sorted(written), at)
        self.folder.delete(self._changes)
        self._swap(now["version"] + 1, {"version": now["version"] + 1, "buckets": now["buckets"], "folders": folders})
        return now["version"] + 1

    def _swap(self, version: int, manifest: dict) -> None:
        if not self.folder.publish(f"versions/v{version}.json", json.dumps(manifest)):
            raise Conflict(f"version {version} of {self.path} was made by another writer")

    def clean(self) -> list[str]:
        """Deletes versions before the last one and what only they, or writers that died, have written; for a table that nobody else reads or writes meanwhile. Returns the folders that went."""
        now = self.manifest()
        for n in self.folder.names("versions"):
            if n != f"v{now['version']}.json":
                self.folder.delete(f"versions/{n}")
        self.folder.delete("changes")
        gone = [f"data/{n}" for n in self.folder.names("data") if f"data/{n}" not in now["folders"].values()]
        for at in gone:
            self.folder.delete(at)
        return gone
