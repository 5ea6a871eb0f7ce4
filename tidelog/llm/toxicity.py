"""Toxicity by multiple-instance learning: labels mark documents, the model scores sentences.

A sentence's score is a logistic function of the hashed words in it; a document's score is the noisy-or of its
sentences, 1 - prod(1 - p). The noisy-or is trained through from document labels, so the sentences that explain a
label are found without having been marked.

Scale: the model is of all labelled documents (``train_all``). A first fit on the driver takes at most ``fit_rows`` labelled rows of each class and ``fit_words`` words in all,
in hash order (both are parameters; rows are taken whole, and one that doesn't fit is left out alone; a class may
use half the words, and what the other doesn't need; eight characters count as a word at least); class weights restore the labelled proportions. If rows are left out, it
is only where the descent over all labelled documents starts. These lie in blocks. Each turn takes the gradient over all of them to find the words that have a weight
or deserve one, writes the documents' sentences with these words alone, and descends on them; each round is one job that adds up the blocks' gradients in whole numbers
(reruns agree to the bit), and the driver sees ``ADDERS`` sums of 2^18 numbers at most. ``train`` is the first fit alone. Scoring is a map over all whole texts without
a shuffle; the weights (2^18 doubles, fixed) are broadcast.

Edge cases: null and empty texts have no sentence and get the score of a single empty one; documents with null, unknown
or contradicting labels are not learned from; if one class is missing, no row of it fits, or there are no labels, every
sentence's score is the labelled proportion (0 without labels); ids may be of any type that sorts; repeated rows each
get a result (of texts with one id the smallest is learned from); only id, text and the labels are read, so
extra columns, languages and sources don't matter.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import KEPT, bounded_batches, dropped, eased, give_back, settled, tidy
from .url_filter import blocks_for, bloom, possible

BUCKETS = 1 << 18
STOPS = re.compile(r"[.!?\n。！？]+")
EDGES = string.punctuation + "«»“”‘’¿¡"
KEEP = 150_000


def _bucket(name: str) -> int:
    return 1 + zlib.crc32(name.encode()) % (BUCKETS - 1)


class Buckets(dict):
    """word to the buckets of itself and of its first four letters, packed (0: none); inflected forms share the second. Words that were met are kept, up to KEEP."""

    def __missing__(self, word: str) -> int:
        core = word.strip(EDGES)
        got = (_bucket(core) << 18 | (_bucket(core[:4] + "^") if len(core) > 4 else 0)) if core else 0
        if len(word) <= 64:
            if len(self) >= KEEP:
                self.clear()
            self[word] = got
        return got


_buckets = Buckets()
KEPT.append(_buckets)


def instances(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the words, index of their sentence), each pair once; sentences without words are not counted."""
    parts = [w for w in map(str.split, STOPS.split(text.lower())) if w]
    flat = [w for p in parts for w in p]
    ids = np.fromiter(map(_buckets.__getitem__, flat), np.int64, len(flat))
    sentence = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.zeros(0, np.int64)
    pair = np.concatenate([sentence << 18 | ids >> 18, sentence << 18 | ids & (BUCKETS - 1)])
    pair = np.unique(pair[pair & (BUCKETS - 1) > 0])
    return pair & (BUCKETS - 1), pair >> 18


class Bags:
    """The instances of some documents, end to end: a feature's bucket for each word of a sentence, how many each sentence has, how many sentences each document has."""

    def __init__(self, feat: np.ndarray, per_sentence: np.ndarray, per_doc: np.ndarray) -> None:
        self.feat, self.per_sentence, self.per_doc = feat, per_sentence, per_doc

    @classmethod
    def of(cls, rows: pa.Table | pa.RecordBatch) -> Bags:
        """From columns f and n: see bagged."""
        joined = lambda c: np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x.as_buffer(), "<i4") for x in rows.column(c))])
        return cls(joined("f"), joined("n"), pc.binary_length(rows.column("n")).to_numpy(zero_copy_only=False).astype(np.int64) // 4)

    def parts(self, most: int = 500_000) -> Iterator[tuple[slice, slice, slice]]:
        """Documents, sentences and instances in runs of about ``most`` instances, so that little is held beside them."""
        upto_s = np.concatenate([[0], np.cumsum(self.per_doc)])
        upto_f = np.concatenate([[0], np.cumsum(self.per_sentence)])
        ends, at = upto_f[upto_s], 0
        while at < len(self.per_doc):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield slice(at, end), slice(upto_s[at], upto_s[end]), slice(ends[at], ends[end])
            at = end

    def cut(self, docs: slice, sentences: slice, own: slice) -> Bags:
        return Bags(self.feat[own], self.per_sentence[sentences], self.per_doc[docs])

    def documents_with(self, which: np.ndarray) -> np.ndarray:
        """For each bucket, in how many of the marked documents it occurs."""
        out = np.zeros(BUCKETS, dtype=np.int64)
        for docs, sentences, own in self.parts():
            doc = np.repeat(np.repeat(np.arange(docs.stop - docs.start), self.per_doc[docs]), self.per_sentence[sentences])
            some = which[docs][doc]
            out += np.bincount(np.unique(doc[some] * BUCKETS + self.feat[own][some]) % BUCKETS, minlength=BUCKETS)
        return out

    def only(self, place: np.ndarray) -> Bags:
        """The instances whose bucket has a place (0 or more), named by it."""
        feat, counts = [], []
        for _, sentences, own in self.parts():
            now = place[self.feat[own]]
            sentence = np.repeat(np.arange(sentences.stop - sentences.start), self.per_sentence[sentences])
            counts.append(np.bincount(sentence[now >= 0], minlength=sentences.stop - sentences.start).astype(np.int32))
            feat.append(now[now >= 0].astype(np.int32))
        none = np.zeros(0, np.int32)
        return Bags(np.concatenate([none, *feat]), np.concatenate([none, *counts]), self.per_doc)


def slopes(parts: Iterable[Bags], y: np.ndarray, scale: np.ndarray, v: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """The gradient of the noisy-or's log loss, by weights and bias, over documents that come in parts."""
    grad, gb, at = np.zeros(len(v)), 0.0, 0
    for part in parts:
        docs = slice(at, at + len(part.per_doc))
        at = docs.stop
        sums = np.concatenate([[0.0], np.cumsum(v[part.feat])])
        ends = np.cumsum(part.per_sentence)
        z = b + sums[ends] - sums[ends - part.per_sentence]
        last = np.cumsum(part.per_doc)
        log_q = -np.add.reduceat(np.logaddexp(0, z), last - part.per_doc)
        q = np.exp(log_q)
        pull = np.where(y[docs] > 0, -q / np.maximum(1 - q, 1e-9), 1.0) * scale[docs]
        g = np.repeat(pull, part.per_doc) / (1 + np.exp(-z))
        grad += np.bincount(part.feat, weights=np.repeat(g, part.per_sentence), minlength=len(v))
        gb += g.sum()
    return grad, gb


class Descent:
    """Weights and bias on their way to the least penalised loss: Adam, with the signs kept (a weight that would cross zero stops there).

    Penalties are in documents: a word that pulls by less than l1 times the root of the positive documents keeps weight 0.
    """

    def __init__(self, v: np.ndarray, b: float, *, docs: int, positive: float, rounds: int, rate: float = 0.15, slowing: float = 3.0, l1: float = 0.13, l2: float = 0.3) -> None:
        self.v, self.b = v, b
        self.l1, self.l2 = min(3.0, l1 * max(1.0, positive) ** 0.5) / docs, l2 / docs
        self.rounds, self.rate, self.slowing, self.t = rounds, rate, slowing, 0
        self.m, self.s2, self.mb, self.sb = np.zeros_like(v), np.zeros_like(v), 0.0, 0.0

    def step(self, grad: np.ndarray, gb: float) -> None:
        self.t += 1
        t, v = self.t, self.v
        grad = grad + self.l2 * v
        side = np.where(v != 0, np.sign(v), -np.sign(grad))
        grad = np.where((v == 0) & (np.abs(grad) <= self.l1), 0.0, grad + self.l1 * side)
        self.m, self.s2, self.mb, self.sb = 0.9 * self.m + 0.1 * grad, 0.99 * self.s2 + 0.01 * grad**2, 0.9 * self.mb + 0.1 * gb, 0.99 * self.sb + 0.01 * gb**2
        rate = self.rate / (1 + self.slowing * t / self.rounds)
        step = v - rate * (self.m / (1 - 0.9**t)) / (np.sqrt(self.s2 / (1 - 0.99**t)) + 1e-6)
        self.v = np.where((side != 0) & (np.sign(step) != side), 0.0, step)
        self.b -= rate * (self.mb / (1 - 0.9**t)) / (np.sqrt(self.sb / (1 - 0.99**t)) + 1e-8)


def telling(seen: np.ndarray, clean: np.ndarray, negative: float, *, min_docs: int = 3, most_docs: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that get weights, each bucket's place among them or -1), from how many documents and negative documents hold each.

    Words in more than most_docs of the negative documents say nothing about a sentence and are left out.
    """
    names = np.flatnonzero((seen >= min_docs) & (clean <= most_docs * negative))
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[names] = np.arange(len(names), dtype=np.int32)
    return names, place


def fit(bags: Bags, y: np.ndarray, weight: np.ndarray, *, rounds: int = 150) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise the noisy-or's log loss over documents."""
    w, base = np.zeros(BUCKETS), float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 0, 1)) if len(y) else 0.0
    if not len(y) or base in (0.0, 1.0):
        return w, -50.0 if base == 0 else float(np.log(1e6))
    names, place = telling(bags.documents_with(np.ones(len(y), dtype=bool)), bags.documents_with(y == 0), float((y == 0).sum()))
    bags = bags.only(place)
    parts = [bags.cut(*part) for part in bags.parts()]
    scale = weight / weight.sum()
    own = Descent(np.zeros(len(names)), float(np.log(base / bags.per_doc.mean())), docs=len(y), positive=float(y.sum()), rounds=rounds)
    for _ in range(rounds):
        own.step(*slopes(parts, y, scale, own.v, own.b))
    w[names] = own.v
    return w, own.b


def learnable(labels: DataFrame, label_col: str) -> DataFrame:
    """(doc_id, y) of documents whose labels agree."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1))
    return known.groupBy("doc_id").agg(F.min(label_col).alias("y"), F.max(label_col).alias("__m")).where("y = __m").drop("__m")


def held_out(id_col: Column, mod: int, fold: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(mod)) == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, fit_rows: int, fit_words: int, usable: Column | None = None) -> tuple[np.ndarray, float]:
    """Fit on labelled rows for which ``usable`` (over doc_id) holds, within the bounds."""
    return first_fit(docs, usable_labels(labels, usable), fit_rows=fit_rows, fit_words=fit_words)[0]


def train_all(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 4000, fit_words: int = 5_000_000, rounds: tuple[int, ...] = (30, 20, 20), usable: Column | None = None) -> tuple[np.ndarray, float]:
    """Fit on all labelled rows for which ``usable`` (over doc_id) holds; the bounds are those of the fit it starts from."""
    known = settled(usable_labels(labels, usable), "toxic-known")
    model, counts, whole = first_fit(docs, known, fit_rows=fit_rows, fit_words=fit_words)
    give_back()
    if not whole:
        model = refit(docs, known, counts, model, rounds=rounds)
    dropped(known)
    return model


def usable_labels(labels: DataFrame, usable: Column | None) -> DataFrame:
    known = learnable(labels, "toxic")
    return known if usable is None else known.where(usable)


def first_fit(docs: DataFrame, known: DataFrame, *, fit_rows: int, fit_words: int) -> tuple[tuple[np.ndarray, float], dict[int, int], bool]:
    """(the model of the labelled rows within the bounds, the labels of each class, whether no labelled row is left out)."""
    bounded_batches(docs.sparkSession)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("y = 0").orderBy(*order).limit(fit_rows).unionByName(known.where("y = 1").orderBy(*order).limit(fit_rows))
    # Of rows with one id and different texts the smallest text is learned from, so that reruns agree.
    own = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    # At most fit_rows rows of each class, without their texts.
    sized = own.select("doc_id", "y", F.coalesce(F.greatest(F.regexp_count("text", F.lit("\\s+")), F.ceil(F.length("text") / 8)), F.lit(0)).alias("n")).orderBy(*order).collect()
    need = {c: sum(r["n"] for r in sized if r["y"] == c) for c in (0, 1)}
    left = {c: max(fit_words // 2, fit_words - need[1 - c]) for c in (0, 1)}
    fitting = []
    for r in sized:
        if r["n"] <= left[r["y"]]:
            left[r["y"]] -= r["n"]
            fitting.append(r)
    if {r["y"] for r in fitting} < {r["y"] for r in sized}:
        odds = counts.get(1, 0) / max(1, counts.get(0, 0))
        return (np.zeros(BUCKETS), float(np.log(np.clip(odds, 1e-20, 1e6)))), counts, False
    kept = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in fitting], own.select("doc_id").schema)

    rows = bagged(own.join(F.broadcast(kept), "doc_id")).toArrow().sort_by("doc_id")
    y = rows.column("y").to_numpy().astype(np.float64)
    bags = Bags.of(rows)
    del rows
    share = {c: counts.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)}
    whole = len(fitting) == len(sized) and max(counts.values(), default=0) <= fit_rows
    return fit(bags, y, np.array([share[int(c)] for c in y])), counts, whole


def bagged(own: DataFrame) -> DataFrame:
    """doc_id, y and, as four-byte numbers, f (the buckets of doc_id's instances, by sentence) and n (how many each sentence has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [instances(x.as_py() or "") for x in batch.column("text")]
            each = [np.bincount(s) if len(s) else np.zeros(1, np.int64) for _, s in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y").cast(pa.int32()), pa.array([f.astype("<u4").tobytes() for f, _ in rows], pa.binary()), pa.array([n.astype("<u4").tobytes() for n in each], pa.binary())], names=["doc_id", "y", "f", "n"])

    return own.select("doc_id", "text", "y").mapInArrow(eased(run), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, y int, f binary, n binary")


def packed_numbers(x: np.ndarray, each: np.ndarray) -> pa.Array:
    """Runs of four-byte numbers as binary values, each of so many numbers."""
    offsets = np.concatenate([[0], np.cumsum(each)]).astype("<i4") * 4
    return pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, "<i4"))])


#: Gradients are added up in this fraction of one, as whole numbers, so that their order doesn't matter.
FINE = 2.0**40
#: Instances of a block, on average, the blocks of a file, and the numbers of a gradient that are added up together.
BLOCK, IN_FILE, SLICE = 500_000, 4, 1 << 15
#: Tasks that add up a round's gradients before the driver does. There are many rounds, and the driver's JVM keeps a record of every task.
ADDERS = 4


def refit(docs: DataFrame, known: DataFrame, counts: dict[int, int], start: tuple[np.ndarray, float], *, rounds: tuple[int, ...]) -> tuple[np.ndarray, float]:
    """The model of all labelled documents, by turns of so many rounds of descent from start."""
    # As in the first fit, the smallest of the texts with one id.
    own = labelled_rows(docs, known, sum(counts.values())).join(known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    bags = settled(bagged(own), "toxic-bags")
    sizes = {r["y"]: r for r in bags.groupBy("y").agg(F.count("*").alias("docs"), F.sum(F.length("n")).alias("sentences"), F.sum(F.length("f")).alias("instances")).collect()}
    if len(sizes) < 2:  # no document of one class
        dropped(bags)
        return start
    total = {k: sum(r[k] for r in sizes.values()) for k in ("docs", "sentences", "instances")}
    held = held_by(bags)
    names, place = telling(held[0] + held[1], held[0], float(sizes[0]["docs"]))
    n_blocks = -(-total["instances"] // (4 * BLOCK)) or 1
    blocks = settled(packed(bags, place, n_blocks), "toxic-blocks")
    dropped(bags)

    labelled = sum(counts[c] for c in (0, 1))
    scale = np.array([counts[c] / sizes[c]["docs"] / labelled for c in (0, 1)])
    w, b = start
    if not w.any():
        b = float(np.log(counts[1] / labelled * total["docs"] * 4 / total["sentences"]))
    v, n, positive = w[names], total["docs"], float(sizes[1]["docs"])
    for k in rounds:
        # A word takes part if it has a weight or, over all documents, pulls by more than the penalty. All others stay at zero.
        down = Descent(v, b, docs=n, positive=positive, rounds=k)
        active = np.flatnonzero((v != 0) | (np.abs(summed(blocks, scale, v, b)[0]) > down.l1))
        place = np.full(len(v), -1, dtype=np.int32)
        place[active] = np.arange(len(active), dtype=np.int32)
        few = settled(narrowed(blocks, place), "toxic-active")
        # Larger steps at first, and as many as words that the start never met need.
        down = Descent(v[active], b, docs=n, positive=positive, rounds=k, rate=0.5, slowing=9.0)
        for _ in range(k):
            down.step(*summed(few, scale, down.v, down.b))
        dropped(few)
        v, b = np.zeros(len(v)), down.b
        v[active] = down.v
    dropped(blocks)
    out = np.zeros(BUCKETS)
    out[names] = v
    return out, b


def labelled_rows(docs: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """doc_id and text of the rows whose id is among the n known ones, and of few others: only these are shuffled to their labels."""
    own = docs.select("doc_id", "text")
    if own.schema["doc_id"].dataType != known.schema["doc_id"].dataType:  # equal ids may have different hashes
        return own
    blocks = blocks_for(n)
    return possible(own, "doc_id", bloom(known, "doc_id", blocks), blocks)


def held_by(bags: DataFrame) -> np.ndarray:
    """For each class and bucket, how many documents hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            own, y = Bags.of(batch), batch.column("y").to_numpy()
            for c in (0, 1):
                total[c] += own.documents_with(y == c)
        y, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[y, bucket], pa.int64())], names=["y", "bucket", "c"])

    with tidy(bags.sparkSession):
        rows = bags.mapInArrow(eased(run), "y int, bucket int, c bigint").groupBy("y", "bucket").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros((2, BUCKETS), dtype=np.int64)
    out[rows.column("y").to_numpy(), rows.column("bucket").to_numpy()] = rows.column("c").to_numpy()
    return out


def packed(bags: DataFrame, place: np.ndarray, n_blocks: int) -> DataFrame:
    """y, f, n and d of each block of documents: f holds places, d how many sentences each document has."""
    shared = bags.sparkSession.sparkContext.broadcast(place)
    kind = bags.schema["doc_id"].dataType.simpleString()

    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Bags.of(batch).only(shared.value)
            first = np.cumsum(own.per_doc) - own.per_doc
            f = packed_numbers(own.feat, np.add.reduceat(own.per_sentence, first, dtype=np.int64) if len(first) else first)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("doc_id"), batch.column("y"), f, packed_numbers(own.per_sentence, own.per_doc)], names=["h", "doc_id", "y", "f", "n"])

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("h", "ascending"), ("doc_id", "ascending")])
        own = Bags.of(rows)
        whole = [rows.column("y").to_numpy(), own.feat, own.per_sentence, own.per_doc]
        return pa.table({k: packed_numbers(x, np.array([len(x)])) for k, x in zip("yfnd", whole)})

    cut = bags.withColumn("h", F.xxhash64("doc_id")).mapInArrow(eased(less), f"h bigint, doc_id {kind}, y int, f binary, n binary")
    return cut.withColumn("block", F.pmod("h", F.lit(n_blocks))).repartition(-(-n_blocks // IN_FILE), "block").groupBy("block").applyInArrow(pack, "y binary, f binary, n binary, d binary")


def unpacked(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, Bags]:
    """A block's labels and instances."""
    y, feat, per_sentence, per_doc = (np.frombuffer(batch.column(k)[row].as_buffer(), "<i4") for k in "yfnd")
    return y, Bags(feat, per_sentence, per_doc)


def narrowed(blocks: DataFrame, place: np.ndarray) -> DataFrame:
    """The blocks with only the instances that have a place, named by it."""
    shared = blocks.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [unpacked(batch, row)[1].only(shared.value) for row in range(batch.num_rows)]
            f = pa.array([x.feat.tobytes() for x in own], pa.binary())
            n = pa.array([x.per_sentence.tobytes() for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("y"), f, n, batch.column("d")], names=["y", "f", "n", "d"])

    return blocks.mapInArrow(eased(run), blocks.schema)


def summed(blocks: DataFrame, scale: np.ndarray, v: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """The gradient over all blocks; a document counts by the scale of its class."""
    shared = blocks.sparkSession.sparkContext.broadcast((v, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bias = shared.value
        total = np.zeros(len(now) + 1, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                y, bags = unpacked(batch, row)
                grad, gb = slopes((bags.cut(*part) for part in bags.parts()), y, scale[y], now, bias)
                total += np.rint(np.append(grad, gb) * FINE).astype(np.int64)
        cuts = range(0, len(total), SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.int32()), pa.array([total[i : i + SLICE].tobytes() for i in cuts], pa.binary())], names=["at", "g"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = added(batches)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["at", "g"])

    # Without a key: as many tasks as add up, however many partitions the session's shuffles have.
    with tidy(blocks.sparkSession):
        rows = blocks.mapInArrow(eased(run), "at int, g binary").repartition(ADDERS).mapInArrow(eased(add), "at int, g binary").toArrow()
    shared.destroy()
    sums = added(rows.to_batches())
    total = np.concatenate([sums[at] for at in sorted(sums)]) / FINE
    return total[:-1], float(total[-1])


def added(batches: Iterable[pa.RecordBatch]) -> dict[int, np.ndarray]:
    """The sum of each slice of the gradients in columns at and g."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, g in zip(batch.column("at").to_pylist(), batch.column("g"), strict=True):
            own = np.frombuffer(g.as_buffer(), "<i8")
            if at in total:
                total[at] += own
            else:
                total[at] = own.copy()
    return total


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], *, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, n_sentences and offending: (start, end, score) of sentences at or above the threshold, in characters."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(np.append(weights, 0.0))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            scores, counts, spans = [], [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                feat, sent = instances(text)
                n = int(sent[-1]) + 1 if len(sent) else 1
                z = bias + np.bincount(sent, weights=w[feat], minlength=n)
                scores.append(float(-np.expm1(-np.logaddexp(0, z).sum())))
                counts.append(n if len(sent) else 0)
                spans.append(offending(text, z, threshold) if scores[-1] >= threshold and len(sent) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(spans, span)], names=["doc_id", "score", "n_sentences", "offending"])

    own = docs.select("doc_id", "text")
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(eased(run), f"doc_id {kind}, score double, n_sentences bigint, offending array<struct<start:bigint,end:bigint,score:double>>")


def offending(text: str, z: np.ndarray, threshold: float) -> list[dict]:
    """The sentences that reach the threshold, or else the highest one."""
    out, at, i = [], 0, 0
    limit = min(np.log(threshold / (1 - threshold)), z.max())
    for stop in [*STOPS.finditer(text), None]:
        end = stop.start() if stop else len(text)
        if text[at:end].split() and i < len(z):
            if z[i] >= limit:
                out.append({"start": at, "end": end, "score": float(1 / (1 + np.exp(-z[i])))})
            i += 1
        at = stop.end() if stop else end
    return out


def toxicity(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 4000, fit_words: int = 5_000_000, threshold: float = 0.3, fold_mod: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, offending; learned from documents that are not held out."""
    model = train_all(docs, labels, fit_rows=fit_rows, fit_words=fit_words, usable=~held_out(F.col("doc_id"), fold_mod))
    scored = score_toxicity(docs, model, threshold=threshold)
    return scored.select("doc_id", held_out(F.col("doc_id"), fold_mod).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "offending")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, float], *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold; a map without a shuffle.

    Null and empty texts score as one empty sentence; repeated rows share a fate; columns may have any names and types that Arrow knows.
    """
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(np.append(weights, 0.0))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x in batch.column(at):
                feat, sent = instances(x.as_py() or "")
                z = bias + np.bincount(sent, weights=shared.value[feat], minlength=int(sent[-1]) + 1 if len(sent) else 1)
                good.append(bool(-np.expm1(-np.logaddexp(0, z).sum()) < threshold))
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(eased(run), docs.schema)
