"""Centroid clustering of integer vectors with Hamerly's bounds.

Every vector keeps one upper bound of the distance to its centroid and one lower bound of the distance to any other. When
the centroids move, the upper bound grows by its own centroid's drift and the lower one shrinks by the largest drift of the
others; while upper stays below lower the vector can't change its cluster and nothing of it is computed. Otherwise the
upper bound is made exact, and if that isn't enough the vector is compared with every centroid, in integers. So the
clusters are those of a full scan in every round; bounds are widened by a rounding allowance, and equal distances are
never settled by bounds, as these must differ.

Scale: the vectors are written once, bucketed by a row number, and never move again. A round joins a bucket with its own
bucket of bounds (no shuffle), writes the new bounds (some 40 bytes a vector) and, with each task's last row, what the
task's changed vectors add to and take from the sums of the clusters; so sums cost only what changes. Centroids and sums of
clusters are the only things that come to the driver: clusters x components numbers.

Edge cases: vectors take part that have ``dim`` components, none null or non-finite, and each within 2**17 of zero (so that
a squared distance fits 64 bits); rows with equal ids or equal vectors each count; a null id is a row like others, and its
seed order is that of an empty id; with fewer vectors than ``k`` there are so many centroids; an empty table gives an empty
result; empty clusters keep their centroid; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, discard, eased, shared_dir

#: The largest component that takes part.
MOST = 2.0**17
#: What bounds are widened by, relative to their size, for the rounding of square roots and sums.
SLACK = 1e-9


def integral(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))


def usable(vector: Column, dim: int) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) <= MOST))
    return F.coalesce((F.size(vector) == dim) & fine, F.lit(False))


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, centroids), some rows at a time."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for at in range(0, len(x), 1024):
        for j, c in enumerate(centroids):
            gap = x[at : at + 1024] - c
            out[at : at + 1024, j] = (gap * gap).sum(1)
    return out


def _bucketed(df: DataFrame, label: str, buckets: int) -> tuple[DataFrame, str]:
    """(df as a table in the shared folder, bucketed by slot; its folder). The rows of a bucket are in one task already."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.write.bucketBy(buckets, "slot").sortBy("slot").option("path", path).saveAsTable(name)
    return spark.table(name), path


#: A vector's bounds; with a task's last row what it adds to the clusters' sums and sizes, and the number of its full scans.
STATE = "slot bigint, cluster int, upper double, lower double, distance bigint, moved array<bigint>"


def _round(centroids: np.ndarray, before: np.ndarray | None, last: bool):
    """Bounds and clusters of a round; ``before`` are the centroids that the bounds are of (None: no bounds yet); in the last round all distances are exact."""
    k, dim = centroids.shape
    if before is not None:
        drift = np.sqrt(((centroids - before).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        order = np.argsort(-drift)
        others = np.full(k, drift[order[0]])
        others[order[0]] = drift[order[1]] if k > 1 else 0.0

    def exact(x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        gap = x - centroids[cluster]
        return (gap * gap).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = np.zeros((k, dim + 1), np.int64)
        scans, held = 0, None

        def ready(cols: tuple, sums: list[int] | None) -> pa.RecordBatch:
            slots, cluster, upper, lower, distance = cols
            told = pa.array([None] * (len(slots) - 1) + [sums], pa.list_(pa.int64()))
            arrays = [pa.array(slots, pa.int64()), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(distance, pa.int64()), told]
            return pa.RecordBatch.from_arrays(arrays, names=["slot", "cluster", "upper", "lower", "distance", "moved"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, dim)
            n = len(x)
            if before is None:
                old, upper, lower = np.full(n, -1), np.full(n, np.inf), np.zeros(n)
            else:
                old = batch.column(2).to_numpy().astype(np.int64)
                upper = (batch.column(3).to_numpy() + drift[old]) * (1 + SLACK)
                lower = batch.column(4).to_numpy() - others[old]
            cluster, distance = old.copy(), np.full(n, -1, np.int64)
            doubtful = np.flatnonzero(upper >= lower)
            if before is not None:
                # An exact upper bound may settle it yet.
                distance[doubtful] = exact(x[doubtful], old[doubtful])
                upper[doubtful] = np.sqrt(distance[doubtful]) * (1 + SLACK)
                doubtful = doubtful[upper[doubtful] >= lower[doubtful]]
            if len(doubtful):
                scans += len(doubtful)
                every = squared(x[doubtful], centroids)
                best, rows = every.argmin(1), np.arange(len(doubtful))  # ties: the smaller number
                cluster[doubtful], distance[doubtful] = best, every[rows, best]
                upper[doubtful] = np.sqrt(distance[doubtful]) * (1 + SLACK)
                every[rows, best] = np.iinfo(np.int64).max
                lower[doubtful] = np.sqrt(every.min(1)) * (1 - SLACK) if k > 1 else np.inf
            gone = np.flatnonzero(cluster != old)
            own = np.concatenate([x[gone], np.ones((len(gone), 1), np.int64)], 1)
            np.add.at(moved, cluster[gone], own)
            if before is not None:
                np.subtract.at(moved, old[gone], own)
            if last:
                rest = np.flatnonzero(distance < 0)
                distance[rest] = exact(x[rest], cluster[rest])
            if held is not None:
                yield ready(held, None)
            held = (batch.column(0).to_numpy(), cluster, upper, lower, distance)
        if held is not None:
            yield ready(held, [*moved.ravel().tolist(), scans])

    return eased(run)


def _changes(state: DataFrame, buckets: int, k: int, dim: int) -> tuple[np.ndarray, int]:
    """(what a round adds to the clusters' sums and sizes (k, dim + 1), as Python integers; its full scans)."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k * (dim + 1) + 1, np.int64)
        for batch in batches:
            out += batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.int64()))], names=["moved"])

    # As many groups as a group has tasks: the square root of the tasks' rows comes to the driver.
    parts = state.where("moved IS NOT NULL").select("moved").repartition(math.isqrt(buckets) + 1).mapInArrow(added, "moved array<bigint>")
    out = sum(np.array(r["moved"], object) for r in parts.collect())
    return out[:-1].reshape(k, dim + 1), out[-1]


def centroid_clusters(vectors: DataFrame, *, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2, rows_per_bucket: int = 500_000, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray, list[int]]:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256; the final centroids; the number of full scans in each assignment).

    Centroids start as the k vectors of smallest sha256 of ``seed:id`` (ties: by components). Each round assigns all
    vectors and replaces every centroid that has any by floor(sum / count); then vectors are assigned once more. An
    inertia beyond 64 bits is null.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    own = vectors.where(usable(F.col(vector_col), dim)).select(F.col(id_col).alias("id"), integral(F.col(vector_col), scale).alias("x"))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    seeds = own.select("x", named.alias("name")).orderBy("name", "x").limit(k).collect()
    if not seeds:
        kind = own.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"), np.zeros((0, dim), np.int64), []
    centroids = np.array([r["x"] for r in seeds], np.int64)
    k = len(centroids)
    buckets = max(spark.sparkContext.defaultParallelism, -(-own.count() // rows_per_bucket))
    # Numbered where they lie, then dealt to buckets by the hash that bucketing uses: a bucket is one task and one file.
    table, _ = _bucketed(own.withColumn("slot", F.monotonically_increasing_id()).select("slot", "id", "x").repartition(buckets, "slot"), "cluster_vectors", buckets)
    sums, scans, before, state, folder = np.zeros((k, dim + 1), object), [], None, None, None
    for turn in range(rounds + 1):
        met = table.select("slot", "x")
        if state is not None:
            met = met.join(state.select("slot", "cluster", "upper", "lower"), "slot")
        old = folder
        state, folder = _bucketed(met.mapInArrow(_round(centroids, before, turn == rounds), STATE), "cluster_bounds", buckets)
        if old:
            discard(spark, old)
        changed, n = _changes(state, buckets, k, dim)
        sums, before = sums + changed, centroids
        scans.append(n)
        if turn < rounds:
            centroids = np.array([[int(v) // int(s[-1]) for v in s[:-1]] if s[-1] else c for s, c in zip(sums, centroids.tolist(), strict=True)], np.int64)
    return _told(table.select("slot", "id").join(state.select("slot", "cluster", "distance"), "slot").drop("slot"), state, centroids), centroids, scans


def _told(rows: DataFrame, state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with what holds for their cluster and for all: one row for each cluster comes to the driver."""
    parts = {r["cluster"]: int(r["n"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    fits = lambda n: n if n < 2**63 else None
    total = fits(sum(parts.values()))
    own = [(i, fits(n), total, hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, n in sorted(parts.items())]
    told = rows.sparkSession.createDataFrame(own, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
