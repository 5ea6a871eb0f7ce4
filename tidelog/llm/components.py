"""Connected components by alternating large and small stars: every round is joins and aggregations, O(log n) rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, settled

#: Edges (16 bytes each) that one task may join up by itself, counted beforehand: rounds of shuffles over so few cost more than they spread.
ONE_TASK = 1_000_000


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(a, b) to (node, root): every node with an edge, and the smallest node that it reaches.

    A node's neighbours are never gathered: their minimum is a hash aggregate, and it meets the edges in a join that
    AQE splits where one node has many. Only counts and checksums of the edges come to the driver. Loops count for
    nothing, repeated edges once; without edges there are no rows.
    """
    now = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    if now.count() <= one_task:
        roots = joined_up(now)
        dropped(now)
        return roots
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "u", "m")
        after = small.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, now = now, settled(after, "cc-edges")
        dropped(old)
        # Two independent checksums of 64 bits and the count tell whether a round changed anything.
        sums = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if sums == before:
            break
        before = sums
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def joined_up(edges: DataFrame) -> DataFrame:
    """The components of a counted, small number of edges (u, v), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
        if not parts:
            return
        names, of = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        a, b = of.reshape(2, -1)
        low = np.arange(len(names))
        while True:
            # Every edge pulls the higher of its ends' roots down, then paths are shortened.
            x, y = low[a], low[b]
            after = low.copy()
            np.minimum.at(after, np.maximum(x, y), np.minimum(x, y))
            while (after[after] != after).any():
                after = after[after]
            if (after == low).all():
                break
            low = after
        for at in range(0, len(names), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 100_000], pa.int64()), pa.array(names[low[at : at + 100_000]], pa.int64())], names=["node", "root"])

    return settled(edges.select("u", "v").coalesce(1).mapInArrow(run, "node bigint, root bigint"), "cc-roots")
