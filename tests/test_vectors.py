"""Exact search against a loop: cells, bounds, parts, ties, and rows that take no part."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.operators import vectors


def brute(queries, docs, k, other=False, visible=None, prefetch=None):
    out = {}
    for e, q, v in queries:
        fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
        if e is None or q is None or not fine(v):
            continue
        found = [(-float((np.array(w) * np.array(v)).sum()), d) for f, d, w in docs if f == e and d is not None and fine(w) and len(w) == len(v) and not (other and d == q)]
        found = sorted(found)[: max(k, prefetch or 0)]
        out[e, q] = [d for _, d in found if visible is None or visible(q, d)][:k]
    return {key: ids for key, ids in out.items() if ids}


def searched(spark, queries, docs, ids="bigint", **options):
    left = spark.createDataFrame(queries, f"e string, q {ids}, qv array<double>").repartition(3)
    right = spark.createDataFrame(docs, f"e string, d {ids}, dv array<double>").withColumn("note", F.lit("n")).repartition(3)
    out = {}
    for r in vectors.search(left, right, entity="e", query_id="q", doc_id="d", **options).orderBy("e", "q", "rank").collect():
        out.setdefault((r.e, r.q), []).append(r.d)
        assert r["rank"] == len(out[r.e, r.q]) and r.note == "n"
    return out


def test_a_vector_with_nan_loses_nobody(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [0.5, 0.5]), ("a", 3, [math.nan, 1.0])]
    assert searched(spark, rows, rows, k=2) == {("a", 1): [1, 2], ("a", 2): [1, 2]}


ODD = [("a", 901, None), ("a", 902, []), ("a", 903, [math.nan, 1.0, 2.0]), ("a", 904, [math.inf, 1.0, 2.0]), ("a", 905, [None, 1.0, 2.0]), ("a", None, [1.0, 2.0, 3.0]), (None, 906, [1.0, 2.0, 3.0]), ("a", 907, [1.0, 2.0]), ("a", 908, [2.0, 2.0]), ("b", 909, [5.0, 5.0, 5.0])]


@pytest.mark.parametrize("options", [{}, {"cell_rows": 20}, {"cell_rows": 20, "chunk_rows": 7, "query_rows": 30}])
@pytest.mark.parametrize("other", [False, True])
def test_search_against_a_loop(spark, options, other):
    """Small whole numbers, so that many products are equal; a hot entity, a small one, and rows that take no part."""
    rng = random.Random(4)
    rows = [("a" if i % 5 else "small", i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(200)] + ODD
    assert searched(spark, rows, rows, k=4, other=other, **options) == brute(rows, rows, 4, other)
    assert searched(spark, rows[:50], rows, k=500, other=other, **options) == brute(rows[:50], rows, 500, other)


def test_prefetch_then_visibility(spark):
    rng = random.Random(5)
    rows = [("a", i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    want = brute(rows, rows, 3, visible=lambda q, d: d < q, prefetch=15)
    for options in ({}, {"cell_rows": 10}):
        assert searched(spark, rows, rows, k=3, prefetch=15, visible=F.col("d") < F.col("q"), **options) == want


def test_ids_of_any_type(spark):
    rows = [("a", f"id{i % 10}{i}", [float(i % 3), 1.0]) for i in range(30)]
    for options in ({}, {"cell_rows": 5}):
        assert searched(spark, rows, rows, ids="string", k=3, other=True, **options) == brute(rows, rows, 3, other=True)


def test_bounds_spare_pairs_where_vectors_cluster(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(25, 16)) * 3
    rows = [("a", i, (centres[i % 25] + rng.normal(size=16) * 0.1).tolist()) for i in range(2000)]
    pairs = spark.sparkContext.accumulator(0)
    assert searched(spark, rows[:300], rows, k=5, cell_rows=40, scanned=pairs) == brute(rows[:300], rows, 5)
    assert pairs.value < 0.5 * 300 * 2000, pairs.value


def test_search_of_nothing(spark):
    rows = [("a", 1, [1.0])]
    for left, right in (([], rows), (rows, []), ([], []), (rows, [("b", 1, [1.0])])):
        assert searched(spark, left, right, k=2) == {}


def test_store_keeps_the_last_used(spark, tmp_path):
    store = vectors.Store(spark, f"{tmp_path}/store", ["e"], most=2)
    store.save(spark.createDataFrame([(i, f"t{i}") for i in range(3)], "e int, t string"))
    a, b = store.load(0), store.load(1)
    assert store.load(0) is a
    store.load(2)
    # 1 was used longest ago: it was given up, still reads, and comes back as another frame.
    assert list(store.loaded) == [(0,), (2,)] and not b.is_cached and a.is_cached
    assert [r.t for r in b.collect()] == ["t1"] and store.load(1) is not b
    assert list(store.loaded) == [(2,), (1,)]
    store.save(spark.createDataFrame([(1, "new")], "e int, t string"))
    assert [r.t for r in store.load(1).collect()] == ["new"]
