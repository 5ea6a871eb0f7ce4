"""Exact search over vectors of one entity, with visibility, and the lexical fallback."""

from __future__ import annotations

import functools
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..sources.shared import written


def unit_vectors(df: DataFrame, vector: str, name: str = "unit") -> DataFrame:
    return df.withColumn(name, scores.normalized(F.col(vector)))


def index(df: DataFrame, vector: str, metric: str = "ip", name: str = "indexed") -> DataFrame:
    """What an exact search compares: unit vectors for the inner product, the vectors themselves for ``l2``; rows without a vector are left out, an empty store gives an empty index."""
    if metric not in ("ip", "l2"):
        raise ValueError(f"metric is ip or l2, not {metric!r}")
    there = df.where(F.col(vector).isNotNull())
    return unit_vectors(there, vector, name) if metric == "ip" else there.withColumn(name, F.transform(vector, lambda x: x.cast("double")))


class Store:
    """Vectors in folders by entity and kind: one entity's kind is read once, from its own folder, and kept while it is among the ``most`` last used."""

    def __init__(self, spark, path: str, by: Sequence[str], most: int = 16) -> None:
        self.spark, self.path, self.by, self.most = spark, path, list(by), most
        self.loaded: OrderedDict[tuple, DataFrame] = OrderedDict()

    def save(self, df: DataFrame) -> None:
        df.write.mode("overwrite").partitionBy(*self.by).parquet(self.path)
        while self.loaded:
            self.loaded.popitem()[1].unpersist()

    def load(self, *key: object) -> DataFrame:
        """One entity's kind. What was not used for longest is given up when there are more than ``most``; a frame that is given up still works, but reads again."""
        if key not in self.loaded:
            own = self.spark.read.parquet(self.path)
            for name, value in zip(self.by, key, strict=True):
                own = own.where(F.col(name) == F.lit(value))
            self.loaded[key] = own.drop(*self.by).cache()
        self.loaded.move_to_end(key)
        while len(self.loaded) > self.most:
            self.loaded.popitem(last=False)[1].unpersist()
        return self.loaded[key]


def comparable(vector: Column) -> Column:
    """Vectors of finite numbers, with one component at least."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


#: Centres that are sent to all tasks, over all entities: some hundred MB at a thousand components.
CENTRES = 50_000


class Cells:
    """An entity's cells: a row for each centre, how far its vectors lie from it at most, and their number."""

    def __init__(self, centres: np.ndarray, radius: np.ndarray, n: np.ndarray) -> None:
        self.centres, self.radius, self.n = centres, radius, n

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What no product with a cell's vector exceeds: q . c + |q| r, with room for rounding."""
        size = np.linalg.norm(queries, axis=1)[:, None]
        return queries @ self.centres.T + size * self.radius + 1e-9 * (1 + size * (self.radius + np.linalg.norm(self.centres, axis=1)))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _runs(*columns: pa.Array) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    n = len(columns[0])
    fresh = np.zeros(max(0, n - 1), bool)
    for c in columns:
        fresh |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
    return np.concatenate([[0], np.flatnonzero(fresh) + 1, [n]]) if n else np.zeros(1, int)


class Chunk:
    """Some vectors of one cell, in the order of their ids."""

    def __init__(self, ids: list, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.place = {i: n for n, i in enumerate(ids)}
        self.norm = float(np.linalg.norm(x, axis=1).max(initial=0.0))

    def best(self, own: list, queries: np.ndarray, low: np.ndarray, take: int, other: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query the places and products of its ``take`` best rows that reach ``low``: a matrix product finds who may, sums in one fixed order decide."""
        rough = queries @ self.x.T
        near = 1e-9 * (1 + np.linalg.norm(queries, axis=1) * self.norm)
        if other:
            for i, q in enumerate(own):
                if q in self.place:
                    rough[i, self.place[q]] = -np.inf
        cut = np.partition(rough, rough.shape[1] - take, axis=1)[:, rough.shape[1] - take] if take < rough.shape[1] else np.full(len(own), -np.inf)
        cut = np.maximum(cut, low) - near
        for i in range(len(own)):
            some = np.flatnonzero((rough[i] >= cut[i]) & (rough[i] > -np.inf))
            score = (self.x[some] * queries[i]).sum(1)
            some, score = some[score >= low[i]], score[score >= low[i]]
            order = np.lexsort((some, -score))[:take]
            yield i, some[order], score[order]


def _meeting(take: int, other: bool, q_type: pa.DataType, d_type: pa.DataType, scanned: Accumulator | None):
    """Rows (key, kind, d, q, v, low) sorted by key, kind and d: a key's documents are held, its queries stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts, chunk, pairs = None, [], [], None, 0
        for batch in batches:
            keys, kinds = batch.column(0), batch.column(1)
            edges = _runs(keys, kinds)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows = batch.slice(a, b - a)
                if keys[a].as_py() != key:
                    key, ids, parts, chunk = keys[a].as_py(), [], [], None
                if kinds[a].as_py() == 0:
                    ids += rows.column(2).to_pylist()
                    parts.append(_vectors(rows.column(4)))
                    continue
                if not ids:
                    continue
                if chunk is None:
                    chunk, parts = Chunk(ids, np.concatenate(parts)), []
                step = max(1, 4_000_000 // len(ids))
                for at in range(0, rows.num_rows, step):
                    some = rows.slice(at, step)
                    own, low = some.column(3).to_pylist(), some.column(5).to_numpy(zero_copy_only=False)
                    pairs += len(own) * len(ids)
                    found = list(chunk.best(own, _vectors(some.column(4)), low, take, other))
                    who = np.concatenate([np.full(len(p), i) for i, p, _ in found])
                    which = np.concatenate([p for _, p, _ in found])
                    group, score = pa.array([key.split("|", 3)[3]] * len(who), pa.string()), pa.array(np.concatenate([s for _, _, s in found]), pa.float64())
                    yield pa.RecordBatch.from_arrays([group, pa.array([own[i] for i in who], q_type), pa.array([ids[i] for i in which], d_type), score], names=["g", "q", "d", "score"])
        if scanned is not None:
            scanned.add(pairs)

    return run


def search(queries: DataFrame, docs: DataFrame, *, entity: str, query_id: str, doc_id: str, k: int, visible: Column | None = None, prefetch: int | None = None, other: bool = False, cell_rows: int = 4096, chunk_rows: int = 32_768, query_rows: int = 500_000, scanned: Accumulator | None = None) -> DataFrame:
    """Each query's k best documents of its entity by inner product (columns qv and dv), ties to the smaller id: the columns of both sides, score and rank.

    Visibility is applied to the best ``prefetch`` (k without it), so that fewer than k may be left. With ``other`` a
    query doesn't meet the document of its own id.

    Documents are dealt to cells and stay there. An entity of more than ``cell_rows`` documents has several cells, each
    with a centre and a radius; a query first visits the cells with the largest bounds that hold enough documents, and then
    only those whose bound q . c + |q| r reaches its k-th score so far. So queries travel to the cells that can matter
    and documents never do; a cell of more than ``chunk_rows`` documents is several tasks, and only where one entity has
    more than ``query_rows`` queries are its documents held by several tasks. In a task the queries stream past a chunk.

    Edge cases: vectors take part that hold finite numbers only; rows without an entity, id or such a vector are left out
    and change nobody's neighbours; vectors of different lengths never meet; ids may be of any type that has an order, and
    are unique within their entity and side; ``scanned`` adds up the pairs whose product was computed.
    """
    spark = queries.sparkSession
    take = max(k, prefetch or 0)
    group = lambda v, e: F.concat_ws("|", F.size(v), F.col(e).cast("string"))
    named = lambda i, v: [F.col(entity).alias("e"), F.col(i).alias("i"), F.transform(v, lambda x: x.cast("double")).alias("v")]
    there = lambda df: df.where(F.col("e").isNotNull() & F.col("i").isNotNull() & comparable(F.col("v"))).withColumn("g", group("v", "e"))
    asked, held = there(queries.select(*named(query_id, "qv"))), there(docs.select(*named(doc_id, "dv")))
    sizes = held.groupBy("g").agg(F.count("*").alias("n")).join(asked.groupBy("g").agg(F.ceil(F.count("*") / query_rows).alias("salts")), "g")
    large = sizes.where(F.col("n") > cell_rows).select("g", F.ceil(F.col("n") / cell_rows).alias("cells")).orderBy(F.desc("cells")).limit(CENTRES)
    q_type, d_type = _arrow_type(asked, "i"), _arrow_type(held, "i")
    schema = f"g string, q {asked.schema['i'].dataType.simpleString()}, d {held.schema['i'].dataType.simpleString()}, score double"

    def met(holds: DataFrame, asks: DataFrame) -> DataFrame:
        """Documents (g, cell, part, i, v) and queries (g, cell, i, v, low) that visit a cell, all its parts."""
        parts = holds.groupBy("g", "cell").agg((F.max("part") + 1).alias("parts"))
        where = lambda *c: F.concat_ws("|", *c, "g")
        left = holds.join(sizes.select("g", "salts"), "g").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        left = left.select(where("cell", "part", "salt").alias("key"), F.lit(0).alias("kind"), F.col("i").alias("d"), F.lit(None).cast(asked.schema["i"].dataType).alias("q"), "v", F.lit(0.0).alias("low"))
        right = asks.join(parts, ["g", "cell"]).join(sizes.select("g", "salts"), "g").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        right = right.select(where("cell", "part", F.pmod(F.xxhash64("i"), "salts")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast(held.schema["i"].dataType).alias("d"), F.col("i").alias("q"), "v", "low")
        both = left.unionByName(right).repartition("key").sortWithinPartitions("key", "kind", "d")
        return both.mapInArrow(_meeting(take, other, q_type, d_type, scanned), schema)

    least = F.lit(float("-inf"))
    wanted = {r["g"]: r["cells"] for r in large.collect()}  # bounded by CENTRES, as are all centres below
    if not wanted:
        part = lambda n: F.pmod(F.xxhash64("i"), F.ceil(F.col(n) / chunk_rows))
        whole = held.join(sizes.select("g", "n"), "g").select("g", F.lit(0).alias("cell"), part("n").alias("part"), "i", "v")
        found = met(whole, asked.select("g", F.lit(0).alias("cell"), "i", "v", least.alias("low")))
    else:
        cells, dealt = _dealt(held, wanted, chunk_rows)
        found = _visits(met, asked, dealt, cells, take, other, least)
    order = Window.partitionBy("g", "q").orderBy(F.desc("score"), "d")
    first = found.withColumn("__p", F.row_number().over(order)).where(F.col("__p") <= take).select(F.col("g").alias("__g"), F.col("q").alias(query_id), F.col("d").alias("__d"), "score")
    joined = queries.withColumn("__g", group("qv", entity)).join(first, ["__g", query_id])
    joined = joined.join(docs.withColumn("__g", group("dv", entity)).drop(entity).withColumnRenamed(doc_id, "__d"), ["__g", "__d"]).withColumnRenamed("__d", doc_id)
    if visible is not None:
        joined = joined.where(visible)
    order = Window.partitionBy("__g", query_id).orderBy(F.desc("score"), doc_id)
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("__g")


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _dealt(held: DataFrame, wanted: dict[str, int], chunk_rows: int) -> tuple[dict[str, Cells], DataFrame]:
    """(the cells of large groups; all documents with cell and part). Centres are documents, the first in hash order, moved once to the mean of those that a sample puts there."""
    spark = held.sparkSession
    share = min(1.0, CENTRES / sum(wanted.values()))
    many = spark.createDataFrame([(g, max(1, int(n * share))) for g, n in wanted.items()], "g string, cells int")
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("i"), "i"))
    # Each group's first documents in hash order: no more rows than CENTRES leave each window (a window group limit cuts before the shuffle).
    seeds = held.join(F.broadcast(many), "g").withColumn("r", rank).where(F.col("r") <= CENTRES).where("r <= cells").select("g", "v").collect()
    centres: dict[str, list] = {}
    for r in seeds:
        centres.setdefault(r["g"], []).append(r["v"])
    shared = spark.sparkContext.broadcast({g: np.array(v) for g, v in centres.items()})
    kind = held.schema["i"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).to_pylist()
            cell, gap = np.zeros(len(groups), np.int32), np.zeros(len(groups))
            by: dict[str, list[int]] = {}
            for i, g in enumerate(groups):
                by.setdefault(g, []).append(i)
            for g, rows in by.items():
                x = _vectors(batch.column(2).take(pa.array(rows)))
                c = shared.value.get(g)
                if c is None:
                    gap[rows] = np.linalg.norm(x, axis=1)
                else:
                    own = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
                    cell[rows], gap[rows] = own, np.linalg.norm(x - c[own], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cell), pa.array(gap)], names=["g", "i", "v", "cell", "gap"])

    put = written(held.select("g", "i", "v").mapInArrow(assign, f"g string, i {kind}, v array<double>, cell int, gap double"))
    sized = put.groupBy("g", "cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius"))
    cells: dict[str, Cells] = {}
    rows: dict[str, list] = {}
    for r in sized.join(F.broadcast(many.select("g")), "g").orderBy("cell").collect():  # one row for each centre at most
        rows.setdefault(r["g"], []).append(r)
    for g, own in rows.items():
        c, radius, n = shared.value[g], np.full(len(shared.value[g]), -np.inf), np.zeros(len(shared.value[g]), np.int64)
        for r in own:
            radius[r["cell"]], n[r["cell"]] = r["radius"] * (1 + 1e-9), r["n"]
        cells[g] = Cells(c, radius, n)
    part = F.pmod(F.xxhash64("i"), F.ceil(F.col("n") / chunk_rows))
    return cells, put.join(sized.select("g", "cell", "n"), ["g", "cell"]).select("g", "cell", part.alias("part"), "i", "v")


def _visits(met, asked: DataFrame, dealt: DataFrame, cells: dict[str, Cells], take: int, other: bool, least: Column) -> DataFrame:
    """Two rounds: the cells of largest bounds until they hold enough documents, then the others whose bound reaches the score to beat."""
    shared = asked.sparkSession.sparkContext.broadcast(cells)
    kind = asked.schema["i"].dataType.simpleString()
    enough = take + other

    def visiting(second: bool):
        def picked(g: str, queries: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(query, cell) of the visits of some queries of a group."""
            own = shared.value.get(g)
            if own is None:
                # One cell: the first round has seen it all.
                rows = np.arange(0 if second else len(queries))
                return rows, np.zeros(len(rows), np.int64)
            bounds = own.bounds(queries)
            bounds[:, own.n == 0] = -np.inf
            order = np.argsort(-bounds, axis=1, kind="stable")
            n = own.n[order]
            # The first cells in order, up to the one with which there are enough.
            pick = (np.cumsum(n, axis=1) - n < enough) & (n > 0)
            if second:
                pick = ~pick & (n > 0) & (np.take_along_axis(bounds, order, 1) >= low[:, None])
            rows, at = np.nonzero(pick)
            return rows, order[rows, at]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                low = batch.column(3).to_numpy(zero_copy_only=False)
                by: dict[str, list[int]] = {}
                for i, g in enumerate(batch.column(0).to_pylist()):
                    by.setdefault(g, []).append(i)
                for g, rows in by.items():
                    # A query may visit every cell: few queries at a time, and few visits a batch.
                    for some in (np.array(rows[at : at + 256]) for at in range(0, len(rows), 256)):
                        who, cell = picked(g, _vectors(batch.column(2).take(pa.array(some))), low[some])
                        for at in range(0, len(who), 10_000):
                            take_ = pa.array(some[who[at : at + 10_000]])
                            columns = [batch.column(c).take(take_) for c in range(4)]
                            yield pa.RecordBatch.from_arrays([columns[0], pa.array(cell[at : at + 10_000], pa.int32()), *columns[1:]], names=["g", "cell", "i", "v", "low"])

        return run

    visits = f"g string, cell int, i {kind}, v array<double>, low double"
    one = written(met(dealt, asked.select("g", "i", "v", least.alias("low")).mapInArrow(visiting(False), visits)))
    rank = F.row_number().over(Window.partitionBy("g", "q").orderBy(F.desc("score"), "d"))
    kth = one.withColumn("r", rank).where(F.col("r") == take).select("g", F.col("q").alias("i"), F.col("score").alias("low"))
    again = asked.select("g", "i", "v").join(kth, ["g", "i"], "left").select("g", "i", "v", F.coalesce("low", least).alias("low"))
    two = met(dealt, again.mapInArrow(visiting(True), visits))
    return functools.reduce(DataFrame.unionByName, (one, two))


#: Characters of the pieces of a text that the lexical index knows.
GRAM = 3


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct runs of ``size`` characters, and all shorter ones, which short needles need."""
    at = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[at(n) for n in range(1, size + 1)]))


def lexical(queries: DataFrame, docs: DataFrame, *, entity: str, query_id: str, needle: str, text: str, position: str, k: int, direct: int = 1000) -> DataFrame:
    """The first k documents of a query's entity: 1.0 for those that hold the needle, whatever its case, else 0.1; ties in order of insertion.

    An entity of more than ``direct`` documents is searched through an index of its texts' pieces of three characters: a
    needle's candidates are the documents with its rarest piece, and only they are compared. What fills up a result behind
    the documents that hold the needle can only be among the entity's first k, so no query meets all documents of a large
    entity; smaller entities are joined whole.

    Edge cases: a null or empty needle is held by every text that isn't null; a null text holds nothing; documents
    without an entity are found by nobody; repeated positions are taken in any order.
    """
    own = queries.select(F.col(entity).alias("__e"), F.lower(F.coalesce(F.col(needle), F.lit(""))).alias("__n")).distinct()
    large = docs.groupBy(F.col(entity).alias("__e")).agg(F.count("*").alias("__size")).where(F.col("__size") > direct).join(own.select("__e").distinct(), "__e").select("__e")
    asked = queries.withColumn("__n", F.lower(F.coalesce(F.col(needle), F.lit("")))).withColumnRenamed(entity, "__e")
    rows = docs.withColumnRenamed(entity, "__e").withColumn("__low", F.lower(text))
    score = F.when(F.contains("__low", "__n"), 1.0).otherwise(0.1)
    rank = F.row_number().over(Window.partitionBy("__e", *([] if query_id == entity else [query_id])).orderBy(F.desc("score"), position))
    tidy = lambda df: df.drop("__n", "__low").withColumnRenamed("__e", entity)
    if large.isEmpty():
        return tidy(asked.join(rows, "__e").withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= k))
    small = asked.join(large, "__e", "left_anti").join(rows, "__e")

    # One row for each document and piece; the document itself stays where it is until it is a candidate.
    held = written(rows.join(large, "__e").withColumn("__d", F.monotonically_increasing_id()))
    post = held.select("__e", "__d", F.explode(grams(F.col("__low"))).alias("__g"))
    needles = own.join(large, "__e")
    pieces = needles.select("__e", "__n", F.explode(F.filter(grams(F.col("__n")), lambda g: F.length(g) == F.least(F.lit(GRAM), F.length("__n")))).alias("__g"))
    wanted = written(post.join(pieces.select("__e", "__g").distinct(), ["__e", "__g"]))
    counts = wanted.groupBy("__e", "__g").agg(F.count("*").alias("__c"))
    # Without a document that has one of its pieces a needle is held by none: its count is 0 and it has no candidates.
    rarest = pieces.join(counts, ["__e", "__g"], "left").groupBy("__e", "__n").agg(F.min(F.struct(F.coalesce("__c", F.lit(0)).alias("c"), F.col("__g").alias("g"))).alias("__r"))
    candidates = rarest.select("__e", "__n", F.col("__r.g").alias("__g")).join(wanted, ["__e", "__g"]).select("__e", "__n", "__d")
    hits = candidates.join(held.select("__d", "__low", F.col(position).alias("__at")), "__d").where(F.contains("__low", "__n")).select("__e", "__n", "__d", "__at")
    first = Window.partitionBy("__e").orderBy(position)
    early = held.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k).select("__e", "__d", F.col(position).alias("__at"))
    fill = needles.join(early, "__e").select("__e", "__n", "__d", "__at")
    best = F.row_number().over(Window.partitionBy("__e", "__n").orderBy("__at", "__d"))
    some = hits.withColumn("__r", best).where(F.col("__r") <= k).drop("__r").unionByName(fill).select("__e", "__n", "__d").distinct()
    found = asked.join(some, ["__e", "__n"]).join(held, ["__e", "__d"]).drop("__d")
    both = small.unionByName(found.select(*small.columns)).withColumn("score", score).withColumn("rank", rank)
    return tidy(both.where(F.col("rank") <= k))
