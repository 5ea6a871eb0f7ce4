"""Byte-level BPE by corpus-level merge replay, and its inverse.

Texts are split by the pattern into pieces, in runs of about ``RUN_CHARS`` characters; a run's texts become sequences of
numbers that name its distinct pieces. The pieces of all runs are dealt to shards by their hash, so that each distinct
piece of the corpus is in one shard and is replayed once: a shard's pieces are laid out as one sequence of byte symbols,
and an inverted index leads from each mergeable pair (named by the rank of what it makes) to the places where it stands.
Ranks are taken in rising order; every place of a rank is merged, left to right, and only the pairs with its two
neighbours are looked up again and entered in the index. That gives each piece the merges of the reference procedure
(lowest rank first, leftmost first): should a merge ever make a pair of a lower rank, the rest of the current rank waits
for it. The answers go back to the runs, and numbers are replaced by ids.

Scale: texts are read once and never shuffled; their numbers, about a third of the text, are written and shuffled once. A
run tells a shard its pieces in one row, compressed, however many they are, so that no row is made for each word. Shards
follow the corpus' size; a piece that every run has costs its shard one entry a run. The rank file (under 1 MB, of
fixed size) is read by the driver and broadcast.

Edge cases: null text counts as empty and gives no ids; texts and pieces of any length are encoded whole (time grows
with length x log of it); repeated rows each get a result; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import KEPT, bounded_batches, eased, give_back, settled, shared_dir, total_chars

#: Characters of a run, characters of the corpus for a shard, pieces that are laid out as one sequence, pieces that one row of numbers holds.
RUN_CHARS = 12_000_000
SHARD_CHARS = 4_000_000
CHUNK = 30_000
ROW_PIECES = 200_000


class Vocabulary:
    """Ranks of byte strings and the pairs that merge."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.split = regex.compile(pattern).findall
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = rank
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        first = np.full((256, 256), -1, dtype=np.int64)
        for a in range(256):
            for b in range(256):
                first[a, b] = self.pairs.get(int(self.of_byte[a]) << 20 | int(self.of_byte[b]), -1)
        self.first = first

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        ends = np.cumsum(lengths)
        inner = np.ones(len(flat), dtype=bool)
        inner[ends[lengths > 0] - 1] = False
        at = np.flatnonzero(inner)
        rank = self.first[flat[at], flat[at + 1]]
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        ranks, starts = np.unique(rank, return_index=True)
        index: dict[int, list[int]] = dict(zip(ranks.tolist(), (x.tolist() for x in np.split(at, starts[1:])), strict=True)) if len(at) else {}
        sym = self.of_byte[flat].tolist()
        here = np.arange(len(flat), dtype=np.int64)
        nxt = np.where(inner, here + 1, -1).tolist()
        prv = np.where(np.concatenate([[False], inner[:-1]]) if len(flat) else inner, here - 1, -1).tolist()
        pairs, queue = self.pairs, ranks.tolist()
        heapq.heapify(queue)
        while queue:
            now = heapq.heappop(queue)
            places = index.pop(now, None)
            if not places:
                continue
            places.sort()
            for done, p in enumerate(places):
                q = nxt[p]
                if q < 0 or sym[p] < 0 or pairs.get(sym[p] << 20 | sym[q]) != now:
                    continue
                sym[p], sym[q] = now, -1
                nxt[p] = after = nxt[q]
                lower = False
                if after >= 0:
                    prv[after] = p
                    made = pairs.get(now << 20 | sym[after])
                    if made is not None:
                        if made not in index:
                            index[made] = []
                            heapq.heappush(queue, made)
                        index[made].append(p)
                        lower = made < now
                before = prv[p]
                if before >= 0:
                    made = pairs.get(sym[before] << 20 | now)
                    if made is not None:
                        if made not in index:
                            index[made] = []
                            heapq.heappush(queue, made)
                        index[made].append(before)
                        lower = lower or made < now
                if lower and done + 1 < len(places):
                    index.setdefault(now, []).extend(places[done + 1 :])
                    heapq.heappush(queue, now)
                    break
        live = np.array(sym, dtype=np.int64)
        upto = np.concatenate([[0], np.cumsum(live >= 0)])
        packed = live[live >= 0].astype("<u4").tobytes()
        bounds = (4 * upto[np.concatenate([[0], ends])]).tolist()
        return [packed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def decode(self, ids: bytes) -> bytes:
        own = array("I")
        own.frombytes(ids)
        return b"".join(map(self.bytes_of.__getitem__, own))


_loaded: dict[bytes, Vocabulary] = {}
KEPT.append(_loaded)


def vocabulary(rank_file: bytes, pattern: str) -> Vocabulary:
    """One for each worker process."""
    key = hashlib.sha256(rank_file + pattern.encode()).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(rank_file, pattern)
    return _loaded[key]


class Numbers(dict):
    """piece to number, in the order of meeting."""

    def __missing__(self, piece: str) -> int:
        self[piece] = got = len(self)
        return got


def squeezed(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of each, compressed."""
    return zstandard.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unsqueezed(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def batch_of(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def runs(docs: DataFrame, pattern: str, shards: int, run_chars: int) -> DataFrame:
    """A run's texts (docs, sizes: pieces of each, numbers) and its pieces by shard (sizes: bytes of each, numbers, pieces); named by run."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        name, own, ids, codes, chars = TaskContext.get().partitionId() << 32, Numbers(), [], [], 0
        schema = None

        def told() -> Iterator[pa.RecordBatch]:
            each = np.array([len(x) for x in codes])
            flat = np.concatenate([np.zeros(0, np.int32), *codes])
            codes.clear()
            order = np.argsort(-np.bincount(flat, minlength=len(own)), kind="stable")
            number = np.empty(len(own), np.int32)
            number[order] = np.arange(len(own))
            # Rows of texts, of about ROW_PIECES pieces.
            part = (np.cumsum(each) - each) // ROW_PIECES
            bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(ids)]
            ends = np.concatenate([[0], np.cumsum(each)])
            for a, b in zip(bounds, bounds[1:], strict=False):
                yield batch_of({"run": [name], "shard": [None], "docs": [ids[a:b]], "sizes": [squeezed(each[a:b])], "numbers": [squeezed(number[flat[ends[a] : ends[b]]])], "pieces": [None]}, schema)
            del flat
            names = list(own)
            own.clear()
            pieces = [names[i].encode() for i in order]
            del names
            shard = np.fromiter(map(zlib.crc32, pieces), np.int64, len(pieces)) % shards
            by = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[by], prepend=-1)).tolist()
            out = {f.name: [] for f in schema}
            for a, b in zip(cuts, [*cuts[1:], len(by)], strict=True):
                some = [pieces[i] for i in by[a:b].tolist()]
                row = (name, int(shard[by[a]]), None, squeezed(np.array([len(p) for p in some])), squeezed(by[a:b]), zstandard.compress(b"".join(some), 3))
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
                if len(out["run"]) == 1000:
                    yield batch_of(out, schema)
                    out = {f.name: [] for f in schema}
            if out["run"]:
                yield batch_of(out, schema)

        for batch in batches:
            schema = schema or pa.schema([("run", pa.int64()), ("shard", pa.int32()), ("docs", pa.list_(batch.column(0).type)), ("sizes", pa.binary()), ("numbers", pa.binary()), ("pieces", pa.binary())])
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = x.as_py() or ""
                found = split(text)
                ids.append(doc)
                codes.append(np.fromiter(map(own.__getitem__, found), np.int32, len(found)))
                chars += len(text)
                if chars >= run_chars:
                    yield from told()
                    name, own, ids, codes, chars = name + 1, Numbers(), [], [], 0
        if ids:
            yield from told()

    return docs.mapInArrow(eased(run), f"run bigint, shard int, docs array<{kind}>, sizes binary, numbers binary, pieces binary")


def answers(told: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """(run, numbers, sizes, ids): the ids of a run's pieces by shard; every distinct piece of a shard is replayed once."""

    def run(rows: pa.Table) -> pa.Table:
        out = replayed(rows)
        give_back(caches=False)  # the next shard needs the vocabulary
        return out

    def replayed(rows: pa.Table) -> pa.Table:
        v, own = vocabulary(ranks.value, pattern), Numbers()
        asked = []
        for sizes, packed in zip(rows.column("sizes"), rows.column("pieces"), strict=True):
            text, ends = zstandard.decompress(packed.as_py()), np.cumsum(unsqueezed(sizes.as_py())).tolist()
            pieces = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            asked.append(np.fromiter(map(own.__getitem__, pieces), np.int64, len(pieces)))
        names, done = list(own), []
        for i in range(0, len(names), CHUNK):
            done += v.replay(names[i : i + CHUNK])
        n = np.array([len(x) // 4 for x in done], dtype=np.int64)
        out = pa.table({"run": rows.column("run"), "numbers": rows.column("numbers")})
        each = [zstandard.compress(b"".join([done[i] for i in which.tolist()]), 1) for which in asked]
        return out.append_column("sizes", pa.array([squeezed(n[which]) for which in asked], pa.binary())).append_column("ids", pa.array(each, pa.binary()))

    return told.select("shard", "run", "sizes", "numbers", "pieces").groupBy("shard").applyInArrow(run, "run bigint, numbers binary, sizes binary, ids binary")


def filled(rows: pa.Table, known: pa.Table) -> pa.Table:
    """doc_id, n_tokens and ids of one run's texts: its numbers are replaced by the ids of the pieces that they name."""
    parts = [(unsqueezed(k.as_py()), unsqueezed(s.as_py()), np.frombuffer(zstandard.decompress(x.as_py()), "<u4")) for k, s, x in zip(known.column("numbers"), known.column("sizes"), known.column("ids"), strict=True)]
    numbers, size, flat = (np.concatenate([np.zeros(0, "<u4"), *(p[i] for p in parts)]) for i in range(3))
    length, start = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    length[numbers], start[numbers] = size, np.cumsum(size, dtype=np.int64) - size
    docs, n_tokens, ids = [], [], []
    for own, sizes, codes in zip(rows.column("docs"), rows.column("sizes"), rows.column("numbers"), strict=True):
        code, pieces = unsqueezed(codes.as_py()), unsqueezed(sizes.as_py()).astype(np.int64)
        each = length[code]
        upto = np.concatenate([[0], np.cumsum(each)])
        out = flat[np.repeat(start[code] - upto[:-1], each) + np.arange(upto[-1])].astype("<u4").tobytes()
        ends = upto[np.concatenate([[0], np.cumsum(pieces)])]
        docs += own.as_py()
        n_tokens += np.diff(ends).tolist()
        ids += [out[4 * a : 4 * b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
    return pa.table({"doc_id": pa.array(docs, rows.schema.field("docs").type.value_type), "n_tokens": pa.array(n_tokens, pa.int64()), "ids": pa.array(ids, pa.binary())})


def by_run(told: DataFrame, chars: int) -> DataFrame:
    """told as a table in the shared folder, in folders by part and bucketed by run: a run's texts stay where they were written and only the ids of its pieces move to them."""
    spark = told.sparkSession
    name = f"bpe_runs_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // RUN_CHARS))
    told.write.partitionBy("part").bucketBy(buckets, "run").option("path", f"{shared_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name)


def bpe_encode(docs: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", run_chars: int | None = None) -> DataFrame:
    """doc_id, n_tokens and ids: the text's token ids as packed little-endian unsigned 32-bit integers. Shorter runs (RUN_CHARS, if not given) take less memory and more disk."""
    bounded_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(Path(rank_path).read_bytes())
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    told = runs(own, pattern, max(1, -(-total_chars(docs, text_col) // SHARD_CHARS)), run_chars or RUN_CHARS)
    held = by_run(told.withColumn("part", F.when(F.col("shard").isNull(), "texts").otherwise("pieces")), total_chars(docs, text_col))
    known = settled(answers(held.where("part = 'pieces'"), ranks, pattern), "bpe-pieces")
    texts = held.where("part = 'texts'").select("run", "docs", "sizes", "numbers")
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(rows: pa.Table, pieces: pa.Table) -> pa.Table:
        out = filled(rows, pieces)
        give_back()
        return out

    return texts.groupBy("run").cogroup(known.groupBy("run")).applyInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary")


def bpe_decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with ``decoded``, the bytes that the ids stand for."""
    ranks = encoded.sparkSession.sparkContext.broadcast(Path(rank_path).read_bytes())
    own = encoded.select("doc_id", "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([v.decode(x.as_py() or b"") for x in part.column(2)], pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary, decoded binary")
