"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Rows are numbered in a total order (the id first, then every other column), the number goes through a keyed permutation of
0 .. n - 1, and the permuted place p gives shard p mod shards and slot p div shards. So the shuffle is the same whenever
and however the rows are read, shards differ by one row at most, slots have no gaps, and where any numbered row goes (or
which number stands at a slot) is computed from the number alone (``placed``, ``number_at``), without a table.

The permutation is a balanced Feistel network over the smallest even number of bits that holds n; a number that leaves
0 .. n - 1 walks on through the network until it is inside again: under four steps on average, and always in the end, as
the cycle that it is on leads back to where it began.

Scale: equal rows become one row with a count before anything moves, so that a row which a third of the table repeats is a
small number; the counted rows are cut by ranges of the order and numbered by the ranges' counts. No shuffle sorts within
one task; the driver sees two numbers for each range. ``rows`` is meant for light rows (an id and what a plan needs);
``write_shards`` brings full rows to their shards.

Edge cases: null ids come first; equal rows get a number each and it doesn't matter which; every column takes part in the
order, so rows that differ only elsewhere have a fixed place too; columns may have any names (``shard`` and ``slot``
included: rows come back as one struct); an empty table gives an empty result; with more shards than rows the last shards
have none; columns of a map type have no order and are refused by Spark.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, materialize

#: Fixed odd multipliers of the round function, of 32 bits.
MIX = (2654435761, 2246822519)
ROUNDS = 6
#: Copies of one row that a task numbers at a time.
COPIES = 100_000


def half_bits(n: int) -> int:
    """Bits of each half of the network for n numbers."""
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def _keyed(half: np.ndarray, key: int, mask: int) -> np.ndarray:
    """The round function: any function will do, as the network is a permutation with each."""
    low = np.uint64(0xFFFFFFFF)
    x = (half * np.uint64(MIX[0]) + np.uint64(key)) & low
    x = ((x ^ (x >> np.uint64(15))) * np.uint64(MIX[1])) & low
    return (x ^ (x >> np.uint64(13))) & np.uint64(mask)


def keys_of(seed: int) -> list[int]:
    """A key of 31 bits for each round, from the seed by a fixed rule."""
    return [(seed * 48271 + (i + 1) * 69621 * 69621) % 2147483647 for i in range(ROUNDS)]


def _network(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = x >> np.uint64(bits), x & np.uint64(mask)
    for key in keys:
        left, right = right, left ^ _keyed(right, key, mask)
    return (left << np.uint64(bits)) | right


def _back(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = x >> np.uint64(bits), x & np.uint64(mask)
    for key in reversed(keys):
        left, right = right ^ _keyed(left, key, mask), left
    return (left << np.uint64(bits)) | right


def _walked(step, x: np.ndarray, n: int) -> np.ndarray:
    """step until inside 0 .. n - 1, for those that are outside."""
    x = step(x.astype(np.uint64))
    while len(out := np.flatnonzero(x >= np.uint64(n))):
        x[out] = step(x[out])
    return x


def permuted(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places of row numbers, a permutation of 0 .. n - 1."""
    return _walked(functools.partial(_network, bits=half_bits(n), keys=keys_of(seed)), numbers, n)


def placed(numbers: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers."""
    place = permuted(numbers, n, seed)
    return (place % np.uint64(shards)).astype(np.int32), (place // np.uint64(shards)).astype(np.int64)


def number_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """The row number that stands at a slot of a shard."""
    place = slot.astype(np.uint64) * np.uint64(shards) + shard.astype(np.uint64)
    return _walked(functools.partial(_back, bits=half_bits(n), keys=keys_of(seed)), place, n).astype(np.int64)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted rows of a range, in order, with their range and the rows before them in it."""
    own, upto = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = upto + np.cumsum(n)
        if len(n):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(n), own), pa.int32()), pa.array(ends - n, pa.int64())], names=["row", "n", "range", "start"])
            upto = int(ends[-1])


def sharded(rows: DataFrame, *, id_col: str = "doc_id", shards: int = 40, seed: int = 0) -> DataFrame:
    """row (the given row as a struct, its id first), number (from 0), shard, slot."""
    spark = rows.sparkSession
    bounded_batches(spark)
    quoted = lambda c: F.col(f"`{c}`")
    counted = rows.select(F.struct(quoted(id_col), *[quoted(c) for c in rows.columns if c != id_col]).alias("row")).groupBy("row").agg(F.count("*").alias("n"))
    kind = counted.schema["row"].dataType.simpleString()
    # The struct's order is its columns' in turn, nulls first. Written once: a row's range and place stay what they are.
    cut = materialize(counted.repartitionByRange("row").sortWithinPartitions("row").mapInArrow(_numbered, f"row {kind}, n bigint, range int, start bigint"), "shard-rows")
    base, total, most = [], 0, 0
    for r in cut.groupBy("range").agg(F.sum("n").alias("n"), F.max("n").alias("most")).orderBy("range").collect():  # one row for each range
        base.append((r["range"], total))
        total, most = total + r["n"], max(most, r["most"])
    before = spark.createDataFrame(base, "range int, before bigint")
    # A row of many copies goes in parts, so that its numbers are made by many tasks.
    upto = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))
    parts = cut.join(F.broadcast(before), "range").select("row", F.col("start") + F.col("before"), "n", F.explode(upto)).toDF("row", "start", "n", "first")
    if most > COPIES:
        parts = parts.repartition("start", "first")
    each = F.sequence(F.lit(0).cast("long"), F.least(F.col("n") - F.col("first"), F.lit(COPIES).cast("long")) - 1)
    numbers = parts.select("row", "start", "first", F.explode(each).alias("i")).select("row", (F.col("start") + F.col("first") + F.col("i")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, slot = placed(batch.column(1).to_numpy(), total, shards, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shard, pa.int32()), pa.array(slot, pa.int64())], names=["row", "number", "shard", "slot"])

    return numbers.mapInArrow(run, f"row {kind}, number bigint, shard int, slot bigint")


def write_shards(rows: DataFrame, path: str, *, id_col: str = "doc_id", shards: int = 40, seed: int = 0, files: int | None = None) -> None:
    """slot and row of every row, as Parquet in a folder for each shard; a shard's files, taken by name, hold its slots in order. A large shard is many files."""
    out = sharded(rows, id_col=id_col, shards=shards, seed=seed)
    dealt = out.repartitionByRange(files, "shard", "slot") if files else out.repartitionByRange("shard", "slot")
    dealt.sortWithinPartitions("shard", "slot").select("shard", "slot", "row").write.partitionBy("shard").parquet(path)
