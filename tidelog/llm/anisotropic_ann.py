"""Approximate nearest neighbours for inner products: score-aware product quantisation, table scans, exact reranking.

The codebooks minimise |r|^2 + (eta - 1) (r . x/|x|)^2 over the residuals r, which makes error along a vector cost more
than error across it: that part changes the products which rank high. Each vector becomes 4 bits for every ``sub``
components. A scan adds up a query's table entries for a chunk of codes, two codes a byte; the ``rerank`` best of a
chunk, with all ties, are scored again on the original vectors in double precision.

Scale: the codebooks are fitted on at most ``fit_rows`` vectors in hash order; every vector is encoded and stays where
it is. Queries go to the rows: they are broadcast in turns of about ``query_rows``, and in each turn a task scans its
rows chunk by chunk and keeps ``top`` rows for each query. So a turn shuffles queries x tasks x ``top`` small rows, and
vectors are never copied or shuffled, however many queries there are. Equal vectors in a chunk (a vector that many rows
share) are cut to the ``top`` + 1 smallest ids, which loses nothing. The scan itself is queries times rows.

Edge cases: vectors that are null, zero, or hold null or non-finite components, rows without an id, and vectors that
don't have the usual length take no part; repeated rows (same id and vector) count once; ties go to the smaller id;
ids may be of any integer type (they come back as bigint); with fewer candidates than ``top`` all are returned; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, materialize

CENTERS = 16


def eta_of(dim: int, threshold: float = 0.2) -> float:
    """The weight of parallel against orthogonal error, for products above threshold x norm."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def encode(x: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 3) -> np.ndarray:
    """Codes (rows, parts) by coordinate descent on the score-aware loss."""
    parts, _, sub = books.shape
    n = len(x)
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).reshape(n, parts, sub)
    x = x.reshape(n, parts, sub)
    codes = np.stack([((x[:, m, None] - books[m]) ** 2).sum(2).argmin(1) for m in range(parts)], 1)
    along = np.stack([((x[:, m] - books[m][codes[:, m]]) * unit[:, m]).sum(1) for m in range(parts)], 1)
    for _ in range(sweeps):
        for m in range(parts):
            rest = along.sum(1) - along[:, m]
            gap = x[:, m, None] - books[m]
            own = (gap * unit[:, m, None]).sum(2)
            codes[:, m] = ((gap**2).sum(2) + (eta - 1) * (own + rest[:, None]) ** 2).argmin(1)
            along[:, m] = own[np.arange(n), codes[:, m]]
    return codes


def fit(x: np.ndarray, sub: int, eta: float, rounds: int = 10) -> np.ndarray:
    """Codebooks (parts, CENTERS, sub); alternates encoding and a weighted least-squares update of each center."""
    n, dim = x.shape
    parts = dim // sub
    rng = np.random.default_rng(7)
    books = np.stack([x.reshape(n, parts, sub)[rng.choice(n, CENTERS, replace=n < CENTERS), m] for m in range(parts)])
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(n, parts, sub)
    cut = x.reshape(n, parts, sub)
    for turn in range(rounds):
        codes = encode(x, books, eta if turn > 2 else 1.0, 1)
        weight = (eta if turn > 2 else 1.0) - 1
        along = np.stack([((cut[:, m] - books[m][codes[:, m]]) * unit[:, m]).sum(1) for m in range(parts)], 1)
        for m in range(parts):
            rest = along.sum(1) - along[:, m]
            own = codes[:, m]
            summed = lambda values, own=own: np.bincount(own, weights=values, minlength=CENTERS)
            goal = cut[:, m] + weight * unit[:, m] * (rest + (cut[:, m] * unit[:, m]).sum(1))[:, None]
            size = summed(np.ones(n))
            left = np.stack([np.stack([(i == j) * size + weight * summed(unit[:, m, i] * unit[:, m, j]) for j in range(sub)], 1) for i in range(sub)], 1)
            right = np.stack([summed(goal[:, i]) for i in range(sub)], 1)
            for c in np.flatnonzero(size):
                books[m, c] = np.linalg.solve(left[c] + 1e-9 * np.eye(sub), right[c])
            along[:, m] = ((cut[:, m] - books[m][own]) * unit[:, m]).sum(1)
    return books


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte; an odd last code stands alone."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], 1)
    return (codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.uint8)


def scan(query: np.ndarray, books: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
    """Approximate products of a query with packed rows, given as columns (bytes, rows)."""
    parts, _, sub = books.shape
    table = np.einsum("mcs,ms->mc", books, query.reshape(parts, sub))
    if parts % 2:
        table = np.concatenate([table, np.zeros((1, CENTERS))])
    pairs = (table[::2, :, None] + table[1::2, None, :]).reshape(len(bytes_), 256).astype(np.float32)
    out = pairs[0][bytes_[0]]
    for t, b in zip(pairs[1:], bytes_[1:], strict=True):
        out += t[b]
    return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


class Chunk:
    """Rows of a scan: ids, vectors and codes; of equal vectors the ``most`` smallest ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, most: int) -> None:
        rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
        kind = np.unique(rows, return_inverse=True)[1]
        order = np.lexsort((ids, kind))
        kind, own = kind[order], ids[order]
        fresh = np.append(True, (kind[1:] != kind[:-1]) | (own[1:] != own[:-1]))
        order, kind = order[fresh], kind[fresh]
        start = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
        place = np.arange(len(kind)) - np.repeat(start, np.diff(np.append(start, len(kind))))
        keep = order[place < most]
        self.ids, self.x = ids[keep], x[keep].astype(np.float64)
        self.codes = np.ascontiguousarray(codes[keep].T)

    def best(self, own_id: int, query: np.ndarray, books: np.ndarray, rerank: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, exact products) of the ``top`` rows other than the query's own among those that the scan puts first."""
        rough = scan(query, books, self.codes)
        rough[self.ids == own_id] = -np.inf
        take = min(rerank, len(rough))
        some = np.flatnonzero(rough >= np.partition(rough, len(rough) - take)[len(rough) - take])
        some = some[self.ids[some] != own_id]
        exact = (self.x[some] * query).sum(1)
        order = np.lexsort((self.ids[some], -exact))[:top]
        return self.ids[some][order], exact[order]


def nearest(vectors: DataFrame, is_query: Column, *, top: int = 20, rerank: int = 300, sub: int = 2, fit_rows: int = 20_000, block_rows: int = 32_768, query_rows: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's ``top`` rows of largest inner product, other than itself; is_query is over ``id``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    usual = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if usual is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = usual["d"]
    sub = next(s for s in range(min(sub, dim), 0, -1) if dim % s == 0)
    same = own.where(F.size("v") == dim)
    sample = same.orderBy(F.xxhash64("id"), "id", "v").limit(fit_rows).toArrow()
    eta = eta_of(dim)
    shared = spark.sparkContext.broadcast(fit(_matrix(sample.column("v"), dim), sub, eta))
    kind = dict(same.dtypes)["v"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = packed(encode(_matrix(batch.column(1), dim), shared.value, eta)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "v", "code"])

    coded = materialize(same.mapInArrow(index, f"id bigint, v {kind}, code binary"), "ann-codes")
    queries = materialize(coded.where(is_query).select("id", "v").dropDuplicates(["id", "v"]), "ann-queries")
    turns = max(1, -(-queries.count() // query_rows))
    turn_of = F.pmod(F.xxhash64("id", "v"), F.lit(turns))
    found = []
    for turn in range(turns):
        # About query_rows queries, whatever the table: the rows that this turn's scan is for.
        part = queries.where(turn_of == turn).orderBy("id", "v").toArrow()
        asked = spark.sparkContext.broadcast((part.column("id").to_numpy(), _matrix(part.column("v"), dim)))

        def search(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            names, queries = asked.value
            ids = np.full((len(names), top), -1, np.int64)
            scores = np.full((len(names), top), -np.inf)

            def scanned(rows: pa.Table) -> None:
                codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
                chunk = Chunk(rows.column("id").to_numpy(), rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim), codes, top + 1)
                for i, (name, query) in enumerate(zip(names.tolist(), queries, strict=True)):
                    new, exact = chunk.best(name, query, shared.value, rerank, top)
                    both, value = np.concatenate([ids[i], new]), np.concatenate([scores[i], exact])
                    order = np.lexsort((both, -value))
                    # A row that came up in an earlier chunk too counts once.
                    again = np.append(False, (both[order][1:] == both[order][:-1]) & (value[order][1:] == value[order][:-1]) & (value[order][1:] > -np.inf))
                    order = order[~again][:top]
                    ids[i], scores[i] = both[order], value[order]

            waiting, n = [], 0
            for batch in batches:
                waiting.append(batch)
                n += batch.num_rows
                if n >= block_rows:
                    scanned(pa.Table.from_batches(waiting))
                    waiting, n = [], 0
            if n:
                scanned(pa.Table.from_batches(waiting))
            for at in range(0, len(names), 2000):
                some = scores[at : at + 2000] > -np.inf
                each = np.repeat(names[at : at + 2000], some.sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(each, pa.int64()), pa.array(ids[at : at + 2000][some], pa.int64()), pa.array(scores[at : at + 2000][some], pa.float64())], names=["query_id", "vec_id", "score"])

        if part.num_rows:
            found.append(materialize(coded.mapInArrow(search, "query_id bigint, vec_id bigint, score double"), "ann-found"))
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    parts = functools.reduce(DataFrame.unionByName, found).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
