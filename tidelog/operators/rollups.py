"""Votes, thresholds, distributions, roll-ups and reconciliation."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..sources.shared import written


def votes(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key (ties: the smallest), its count, and whether there was a conflict."""
    counted = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("__b"), (F.count("*") > 1).alias("conflict")).select(key, F.col("__b.v").alias(value), (-F.col("__b.m")).alias("n"), "conflict")


def most_common(df: DataFrame, by: str, value: str, k: int) -> DataFrame:
    counted = df.groupBy(by, value).agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value))).where(F.col("rank") <= k)


def inverted(df: DataFrame, key: str, value: str) -> DataFrame:
    """value to its sorted distinct keys."""
    return df.groupBy(value).agg(F.sort_array(F.collect_set(key)).alias("keys"))


def summary(df: DataFrame, by: str, item: str, n: int) -> DataFrame:
    """Distinct items of each group: how many, and the first n."""
    keys = F.sort_array(F.collect_set(item))
    return df.groupBy(by).agg(F.size(keys).cast("long").alias("n_items"), F.slice(keys, 1, n).alias("examples"))


def at_least(df: DataFrame, size: str, limits: Sequence[int]) -> DataFrame:
    """For each limit how many rows reach it, and the percentage (rounded half to even)."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(size) >= k).alias("hit")) for k in limits]))
    counted = df.select(each.alias("x")).groupBy("x.k").agg(F.count_if("x.hit").alias("n"), F.count("*").alias("total"))
    return counted.select("k", "n", F.when(F.col("total") > 0, F.bround(100 * F.col("n") / F.col("total"), 4)).otherwise(0.0).alias("percent"))


def _ordered_bits(v: pd.Series) -> pd.Series:
    """Doubles as integers of the same order; NaN, which is any of many bit patterns, is above all."""
    bits = (v.where(v.notna(), float("nan")) + 0.0).to_numpy("float64").view("int64")
    return pd.Series(bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF))


def _from_bits(v: pd.Series) -> pd.Series:
    bits = v.to_numpy("int64")
    return pd.Series((bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)).view("float64"))


def _descended(rows: DataFrame, state: DataFrame, above: int, bits: int) -> DataFrame:
    """The state's buckets (g, r, top, before, n), each of the values that agree with ``top`` down to bit ``above``, cut at bit ``bits``: the part that holds rank r."""
    top = lambda at: F.lit(0).cast("long") if at == 64 else F.shiftright("x", at)
    inside = rows.withColumn("top", top(above)).join(state.select("g", "top").distinct(), ["g", "top"])
    parts = inside.groupBy("g", "top", top(bits).alias("next")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g", "top").orderBy("next"))
    met = parts.withColumn("upto", upto).join(state.select("g", "top", "r", "before"), ["g", "top"])
    holds = (F.col("before") + F.col("upto") > F.col("r")) & (F.col("before") + F.col("upto") - F.col("n") <= F.col("r"))
    return met.where(holds).select("g", "r", F.col("next").alias("top"), (F.col("before") + F.col("upto") - F.col("n")).alias("before"), "n")


def percentiles(df: DataFrame, value: str, by: Sequence[str], points: Mapping[str, float], *, direct: int = 100_000, step: int = 16) -> DataFrame:
    """Exact percentiles of each group by linear interpolation, a column for each of ``points`` (name to share).

    Values become integers of the same order. A rank is looked for in the histogram of their leading bits, then only
    among the values of the bucket that holds it, until no bucket holds more than ``direct`` values (or all bits are
    known). Histograms are partial sums, so that no task holds the values of a group: at most 2 ** ``step`` counts, or
    ``direct`` values. Nulls don't count; a group without values has nulls; a null is a group of its own; NaN is the
    largest value.
    """
    own = df.select(F.struct(F.lit(0).alias("_"), *by).alias("g"), F.col(value).cast("double").alias("v"))
    rows = written(own.where(F.col("v").isNotNull()).select("g", F.pandas_udf(_ordered_bits, LongType())("v").alias("x")))
    sizes = rows.groupBy("g").agg(F.count("*").alias("total"))
    place = {name: F.lit(float(p)) * (F.col("total") - 1) for name, p in points.items()}
    ranks = F.array_distinct(F.array(*[f(at).cast("long") for at in place.values() for f in (F.floor, F.ceil)]))
    state = sizes.select("g", F.explode(ranks).alias("r"), F.lit(0).cast("long").alias("top"), F.lit(0).cast("long").alias("before"), F.col("total").alias("n"))
    above = 64
    while above > step and not (state := written(state)).where(F.col("n") > direct).isEmpty():
        state, above = _descended(rows, state, above, above - step), above - step
    found = _descended(rows, state, above, 0).select("g", F.struct("r", F.pandas_udf(_from_bits, DoubleType())("top").alias("v")).alias("at"))
    found = found.groupBy("g").agg(F.map_from_entries(F.collect_list("at")).alias("at"))  # two entries a point at most

    def between(at: Column) -> Column:
        low, high = F.floor(at).cast("long"), F.ceil(at).cast("long")
        a, b = F.element_at("at", low), F.element_at("at", high)
        return F.when(a == b, a).otherwise((high - at) * a + (at - low) * b)

    told = sizes.join(found, "g").select("g", *[between(at).alias(name) for name, at in place.items()])
    return own.select("g").distinct().join(told, "g", "left").select(*[F.col(f"g.{c}").alias(c) for c in by], *points)


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    v = F.col(value)
    own = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
    return beside(own, percentiles(df, value, by, {"median": 0.5}), by).select(*by, "n", "mean", "median", "std", "low", "high")


def beside(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of two tables that have one for each group; null groups meet."""
    other = b.withColumnsRenamed({c: f"__{c}" for c in by})
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.lit(True))
    return a.join(other, same).drop(*[f"__{c}" for c in by])


def histogram(df: DataFrame, value: Column, width: float, low: float = 0.0, high: float | None = None) -> DataFrame:
    """(bin, n): left-closed bins of a width; values outside [low, high) have a null bin."""
    b = F.floor((value - low) / width)
    inside = (value >= low) if high is None else (value >= low) & (value < high)
    return df.select(F.when(inside, b).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def macro_micro(df: DataFrame, entity: str, score: str) -> DataFrame:
    """One row: the mean of the entities' means, and the mean of all rows."""
    each = df.groupBy(entity).agg(F.avg(score).alias("acc"), F.count(score).alias("n"))
    return each.agg(F.avg("acc").alias("macro"), (F.sum(F.col("acc") * F.col("n")) / F.sum("n")).alias("micro"))


def with_total(df: DataFrame, by: str, score: str) -> DataFrame:
    """Means by group, and one row for all (group null)."""
    return df.rollup(by).agg(F.avg(score).alias("mean"), F.count(score).alias("n"))


def disagreements(a: DataFrame, b: DataFrame, on: Sequence[str], value: str, count: str, tolerance: float = 0.01) -> DataFrame:
    """Keys whose means differ by more than the tolerance or whose counts differ."""
    other = b.select(*on, F.col(value).alias("__v"), F.col(count).alias("__n"))
    return a.join(other, list(on)).where((F.abs(F.col(value) - F.col("__v")) > tolerance) | (F.col(count) != F.col("__n"))).select(*on)


def audit(df: DataFrame, entity: str, *, terminal: Column, flag: Column) -> DataFrame:
    """For each entity whether its terminal row is there, and how many of its rows are flagged."""
    return df.groupBy(entity).agg(F.coalesce(F.bool_or(terminal), F.lit(False)).alias("has_terminal"), F.count_if(F.coalesce(flag, F.lit(False))).alias("flagged"))
