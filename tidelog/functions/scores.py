"""Weights, normal forms of vectors and scores of answers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def decay(hours: Column, floor: float = 0.01, span: float = 24.0) -> Column:
    """1 at once, ``floor`` after ``span`` hours; events before the point count as at once."""
    return F.exp(F.lit(math.log(floor) / span) * F.greatest(hours, F.lit(0.0)))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    n = l2_norm(v)
    return F.transform(v, lambda x: x.cast("double") / (n + 1e-12))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def set_accuracy(predicted: Column, truth: Column) -> Column:
    """The part of the distinct truths that was predicted; null for an empty truth."""
    return F.size(F.array_intersect(F.array_distinct(predicted), truth)) / F.nullif(F.size(F.array_distinct(truth)), F.lit(0))


def weighted_accuracy(predicted: Column, weights: Column) -> Column:
    """Weights of the truths that occur within a prediction, whatever their case, at most 1 in all."""
    hit = lambda k: F.exists(predicted, lambda p: F.contains(F.lower(p), F.lower(k)))
    each = F.transform(F.map_entries(weights), lambda e: F.when(hit(e.key), e.value * F.size(F.filter(predicted, lambda p: F.contains(F.lower(p), F.lower(e.key))))).otherwise(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda s, x: s + x)))


def _inversions(y: np.ndarray) -> int:
    """Pairs that stand in falling order: runs that double in length are merged, each value counting those before it that are larger."""
    n, total, width = len(y), 0, 1
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    while width < n:
        # All pairs of neighbouring runs at once: a run's number before its values makes one sorted array of them.
        pair = np.arange(n) // (2 * width)
        left = np.arange(n) // width % 2 == 0
        key = pair * (n + 1) + rank
        upto = np.searchsorted(key[left], key[~left], side="right")
        ends = np.searchsorted(pair[left], pair[~left], side="right")
        total += int((ends - upto).sum())
        rank = rank[np.argsort(key, kind="stable")]
        width *= 2
    return total


def tau_b(x: np.ndarray, y: np.ndarray) -> float | None:
    """Kendall's tau-b in n log n: pairs in falling order by merging, tied pairs by counts."""
    n = len(x)
    if n < 2 or n != len(y) or np.isnan(x).any() or np.isnan(y).any():
        return None
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    tied = lambda a: int((k := np.unique(a, axis=0, return_counts=True)[1].astype(object)) @ (k - 1)) // 2
    pairs, both = n * (n - 1) // 2, tied(np.stack([x, y], 1))
    by_x, by_y = pairs - tied(x), pairs - tied(y)
    if not by_x or not by_y:
        return None
    # Sorted by x and then y, a pair falls if its x differs and its y is the other way.
    falling = _inversions(y)
    agreeing = pairs - (pairs - by_x) - (pairs - by_y) + both - falling
    return (agreeing - falling) / math.sqrt(by_x * by_y)


def kendall_tau(a: Column, b: Column) -> Column:
    """Tau-b of two arrays of numbers of one length; null if either is null or constant, holds a null or NaN, or they are shorter than 2."""

    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        numbers = lambda v: None if v is None else np.array([math.nan if i is None else i for i in v], float)
        return pd.Series([None if x is None or y is None else tau_b(x, y) for x, y in zip(map(numbers, xs), map(numbers, ys), strict=True)], dtype="float64")

    return F.nanvl(F.pandas_udf(run, DoubleType())(a, b), F.lit(None).cast("double"))


def sample_size(n: Column, ratio: float, least: int = 1) -> Column:
    """floor(n * ratio), ``least`` at least, n at most."""
    return F.least(n, F.greatest(F.floor(n * ratio), F.lit(least)))


def inverse_permutation(a: Column) -> Column:
    """For each value 0, 1, ... of a permutation the place where it stands."""
    return F.transform(F.sort_array(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s.i.cast("int"))
