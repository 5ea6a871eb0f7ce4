"""LM scoring by a Brown class-based bigram model with exchange clustering.

p(w | v) = p(class(w) | class(v)) * p(w | class(w)). Exchange clustering makes the class centres: a unit moves to the
class where the likelihood of the class bigrams gains most, until a sweep moves none (``sweeps`` at most). Units are the
``head`` most frequent words and ``tails`` groups of all other words by their ending. Then each other word of the
training texts leaves its group: it moves by the same gain, by its own counts of left and right classes. These words all
move at once against the centres, a neighbour outside the head counting by its group's class. Only a word that training
never met is left to the class of its ending. Class transitions are counted over the final classes and smoothed towards
the class's share, emissions by a pseudo-count that also feeds one unknown word in each class.

Scale: counts cover all training texts. Word counts and the request for them are one table of distinct words by block
(see ``blocks``); unit bigrams and the words' neighbours are summed in each task before they are shuffled. The exchange
sees a matrix of (head + tails + 1)^2 cells, whatever the corpus, on the driver; the other words are placed by Spark in
buckets of about ``BUCKET`` words. Word counts and classes are never collected or broadcast: they are joined to the
blocks' requests by word. Texts are kept as class sequences, a byte for each token, until all transitions are counted.

Edge cases: null and empty texts consist of one end token; without training documents every probability comes from the
smoothing; a null doc_id is not held out; repeated rows each get a result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .shared import bounded_batches, materialize

END = "\n"
#: Words that one task places at a time.
BUCKET = 40_000
#: How often a word has a class beside it: left classes are cells 0 to classes - 1, right ones follow.
CELL = np.dtype([("cell", "<u2"), ("n", "<u4")])


def words_of(text: str) -> list[bytes]:
    """Words after A-Z is lower-cased: bytes.split() parts at blanks and the controls 9 to 13 alone."""
    return text.encode().lower().split()


class Units(dict):
    """word to unit: its rank in the head, or its ending's group. Words that were met are kept, up to a bound."""

    def __init__(self, head: list[str], tails: int) -> None:
        super().__init__()
        self.head, self.tails = {w.encode(): i for i, w in enumerate(head)}, tails
        self.end = len(head) + tails

    def __missing__(self, word: bytes) -> int:
        got = self.head.get(word)
        if got is None:
            got = len(self.head) + tail_of(word, self.tails)
        if len(word) <= 64:
            if len(self) >= 150_000:
                self.clear()
            self[word] = got
        return got

    def of(self, text: str) -> np.ndarray:
        """Units from the end before the text to the end after it."""
        words = words_of(text)
        out = np.empty(len(words) + 2, dtype=np.int64)
        out[0] = out[-1] = self.end
        out[1:-1] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return out


def tail_of(word: bytes, tails: int) -> int:
    """The group of a word's last three characters."""
    return zlib.crc32(word.decode()[-3:].encode()) % tails


class Numbers(dict):
    """word to number, in the order of meeting."""

    def __missing__(self, word: bytes) -> int:
        self[word] = got = len(self)
        return got


def phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def between(pairs: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    """Counts of class pairs from counts of unit pairs."""
    out = np.zeros((classes, classes))
    for a in range(classes):
        out[a] = np.bincount(of, weights=pairs[of == a].sum(0), minlength=classes)
    return out


def exchange(pairs: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """The class of each unit, given counts of unit pairs; the last unit (the end) keeps class 0 to itself."""
    n = len(pairs)
    freq = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-freq[:-1], kind="stable")
    # The most frequent units open the classes; the first sweep puts the others where they fit best (-1: nowhere yet).
    of = np.full(n, -1, dtype=np.int64)
    of[-1] = 0
    of[order[: classes - 1]] = 1 + np.arange(len(order[: classes - 1]))
    if classes <= 2:
        return np.maximum(of, classes - 1) * (np.arange(n) < n - 1)
    c = np.zeros((classes, classes))
    known = np.flatnonzero(of >= 0)
    np.add.at(c, (of[known][:, None].repeat(len(known), 1), of[known][None, :].repeat(len(known), 0)), pairs[np.ix_(known, known)])
    for _ in range(sweeps):
        moved = 0
        for u in order:
            own = pairs[u, u]
            a = of[u]
            of[u] = -1
            right = np.bincount(of + 1, weights=pairs[u], minlength=classes + 1)[1:]
            left = np.bincount(of + 1, weights=pairs[:, u], minlength=classes + 1)[1:]
            if a >= 0:
                c[a] -= right
                c[:, a] -= left
                c[a, a] -= own
            rows, cols, r, k = c.sum(1) + left, c.sum(0) + right, right.sum() + own, left.sum() + own
            # The gain of each class: its row and its column change, and their crossing counts once. What others' sums gain is the same for all.
            gain = (phi(c + right) - phi(c)).sum(1) + (phi(c + left[:, None]) - phi(c)).sum(0)
            d = np.diag(c)
            gain += phi(d + right + left + own) - phi(d + right) - phi(d + left) + phi(d)
            gain -= phi(rows + r) - phi(rows) + phi(cols + k) - phi(cols)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if a >= 0 and gain[b] <= gain[a] + 1e-6:
                b = a
            moved += b != a
            of[u] = b
            c[b] += right
            c[:, b] += left
            c[b, b] += own
        if not moved:
            break
    return of


def count_words(docs: DataFrame) -> DataFrame:
    """(block, word, n): n counts the word in the block's training texts; a word of held-out texts alone has 0."""

    def run(block: int, rows: pa.Table) -> pa.Table:
        n, own = Counter(), set()
        for part, batch in blocks.texts(rows):
            for text, held in zip(batch, part.column("held_out").to_pylist(), strict=True):
                (own if held else n).update(words_of(text))
        own -= n.keys()
        names = [*n, *own]
        return pa.table({"block": pa.array([block] * len(names), pa.int32()), "word": pa.array(names, pa.binary()).cast(pa.string()), "n": pa.array([*n.values(), *[0] * len(own)], pa.int64())})

    return blocks.per_block(docs.select("block", "text", "held_out"), run, "block int, word string, n bigint")


def unit_pairs(docs: DataFrame, head: list[str], tails: int) -> np.ndarray:
    """Counts of unit pairs over all training texts."""
    size = len(head) + tails + 1
    shared = docs.sparkSession.sparkContext.broadcast((head, tails))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, total, some = Units(*shared.value), np.zeros(size * size, dtype=np.int64), []
        waiting = 0

        def add() -> None:
            if some:
                cells, n = np.unique(np.concatenate(some), return_counts=True)
                total[cells] += n
                some.clear()

        for batch in batches:
            for x in batch.column(0):
                u = units.of(x.as_py())
                some.append(u[:-1] * size + u[1:])
                waiting += len(u)
                if waiting > 1_000_000:
                    add()
                    waiting = 0
        add()
        cells = np.flatnonzero(total)
        for at in range(0, len(cells), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(cells[at : at + 100_000], pa.int64()), pa.array(total[cells[at : at + 100_000]], pa.int64())], names=["cell", "n"])

    sums = docs.where(~F.col("held_out")).select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(size, size)


def neighbours(docs: DataFrame, head: list[str], tails: int, of: np.ndarray, classes: int, most: int = 1_500_000) -> DataFrame:
    """(word, cells): for words outside the head, the classes beside them in training texts as CELLs; a word has a row for about every ``most`` tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((head, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, of = shared.value
        heads = {w.encode(): i for i, w in enumerate(names)}
        numbers, some, waiting = Numbers(), [], 0
        end = np.array([-1])

        def summed() -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            unit = np.fromiter((heads[w] if w in heads else len(names) + tail_of(w, tails) for w in words), np.int64, len(words))
            outside = np.append(unit >= len(names), False)
            kind = np.append(of[unit], of[-1])
            seq = np.concatenate([end, *some])
            at = np.flatnonzero(outside[seq])
            w = seq[at] * (2 * classes)
            keys, n = np.unique(np.concatenate([w + kind[seq[at - 1]], w + classes + kind[seq[at + 1]]]), return_counts=True)
            cells = np.empty(len(keys), CELL)
            cells["cell"], cells["n"] = keys % (2 * classes), n
            rows = keys // (2 * classes)
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            stops = np.append(starts[1:], len(rows))
            for i in range(0, len(starts), 50_000):
                a, b = starts[i : i + 50_000], stops[i : i + 50_000]
                offsets = np.append(a, b[-1] if len(b) else 0) - a[0]
                packed = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((offsets * CELL.itemsize).astype("<i4").tobytes()), pa.py_buffer(cells[a[0] : b[-1]].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array([words[r] for r in rows[a]], pa.binary()).cast(pa.string()), packed], names=["word", "cells"])

        for batch in batches:
            for x in batch.column(0):
                words = words_of(x.as_py())
                some += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), end]
                waiting += len(words) + 1
                if waiting > most:
                    yield from summed()
                    numbers.clear()
                    some.clear()
                    waiting = 0
        if some:
            yield from summed()

    return docs.where(~F.col("held_out")).select("text").mapInArrow(run, "word string, cells binary")


def place(counts: np.ndarray, own: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The class of each word: where the likelihood of the class bigrams ``c`` gains most if the word moves there from its own class.

    A row of ``counts`` has a word's left classes, then its right ones; each row has some.
    """
    classes = len(c)
    around, rows, cols, d = np.vstack([c, c.T]), c.sum(1), c.sum(0), np.diag(c)
    lost = lambda x, n: phi(x) - phi(np.maximum(x - n, 0))
    out = np.empty(len(counts), np.int64)
    for i in range(0, len(counts), 4096):
        part, a = counts[i : i + 4096], own[i : i + 4096]
        each = np.arange(len(part))
        w, cell = np.nonzero(part)
        n = part[w, cell]
        starts = np.flatnonzero(np.diff(w, prepend=-1))
        kinds, which = np.unique(np.stack([cell, n]), axis=1, return_inverse=True)
        x = around[kinds[0].astype(np.int64)]
        gain = np.add.reduceat((phi(x + kinds[1][:, None]) - phi(x))[which.reshape(-1)], starts)
        stay = np.add.reduceat(lost(around[cell, a[w]], n), starts)
        left, right = part[:, :classes], part[:, classes:]
        total, which = np.unique(right.sum(1), return_inverse=True)
        gain -= (phi(rows + total[:, None]) - phi(rows) + phi(cols + total[:, None]) - phi(cols))[which]
        stay -= lost(rows[a], total[which]) + lost(cols[a], total[which])
        # A class that is on both sides: the crossing of its row and column counts once.
        w, b = np.nonzero((left > 0) & (right > 0))
        k, r = left[w, b], right[w, b]
        gain[w, b] += phi(d[b] + r + k) - phi(d[b] + r) - phi(d[b] + k) + phi(d[b])
        k, r = left[each, a], right[each, a]
        stay += phi(d[a]) - phi(np.maximum(d[a] - r, 0)) - phi(np.maximum(d[a] - k, 0)) + phi(np.maximum(d[a] - r - k, 0))
        gain[each, a] = stay
        # Words move at once, so that a class which nothing is in yet is none of theirs.
        gain[:, 0] = gain[:, cols == 0] = -np.inf
        b = gain.argmax(1)
        out[i : i + 4096] = np.where(gain[each, b] <= stay + 1e-6, a, b)
    return out


def placed(cells: DataFrame, words: int, head: int, tails: int, of: np.ndarray, c: np.ndarray) -> DataFrame:
    """(word, c, k): count and class of each word of ``cells``."""
    shared, classes = cells.sparkSession.sparkContext.broadcast((of, c)), len(c)

    def run(rows: pa.Table) -> pa.Table:
        of, c = shared.value
        coded = rows.column("word").combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist()
        packed = rows.column("cells").combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(packed.buffers()[1], "<i8")[packed.offset : packed.offset + len(packed) + 1]
        data = np.frombuffer(packed.buffers()[2], CELL, (offsets[-1] - offsets[0]) // CELL.itemsize, offsets[0])
        key = np.repeat(coded.indices.to_numpy().astype(np.int64), np.diff(offsets) // CELL.itemsize) * (2 * classes) + data["cell"]
        counts = np.bincount(key, weights=data["n"], minlength=len(names) * 2 * classes).reshape(-1, 2 * classes)
        own = of[head + np.fromiter((tail_of(w.encode(), tails) for w in names), np.int64, len(names))]
        return pa.table({"word": pa.array(names, pa.string()), "c": pa.array(counts[:, classes:].sum(1).astype(np.int64), pa.int64()), "k": pa.array(place(counts, own, c), pa.int32())})

    bucket = F.pmod(F.xxhash64("word"), F.lit(max(1, -(-words // BUCKET)))).cast("int").alias("bucket")
    return cells.select("word", "cells", bucket).groupBy("bucket").applyInArrow(run, "word string, c bigint, k int")


def class_pairs(coded: DataFrame, classes: int) -> np.ndarray:
    """Counts of class pairs over the class sequences of training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                k = np.frombuffer(x.as_py(), "<u2" if classes > 256 else "u1").astype(np.int64)
                total += np.bincount(k[:-1] * classes + k[1:], minlength=classes * classes)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], names=["cell", "n"])

    sums = coded.where(~F.col("held_out")).select("classes").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes * classes)
    out[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(classes, classes)


def brown_scores(docs: DataFrame, held_out, *, classes: int = 48, head: int = 1500, tails: int = 256, sweeps: int = 6, mu: float = 50.0, delta: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; learned from rows for which ``held_out`` is false."""
    bounded_batches(docs.sparkSession)
    held = F.coalesce(held_out, F.lit(False)).alias("held_out")
    own = blocks.blocked(docs, F.col(id_col).alias("doc_id"), held, text_col=text_col)
    ends = docs.where(~held).count()
    requests = materialize(count_words(own), "brown-words")
    vocabulary = materialize(requests.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "brown-vocabulary")
    totals = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    top = [(r["word"], r["c"]) for r in vocabulary.orderBy(F.desc("c"), "word").limit(head).collect()]
    names = [w for w, _ in top]
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), held)
    pairs = unit_pairs(texts, names, tails)
    of = exchange(pairs, classes, sweeps)
    others = materialize(placed(neighbours(texts, names, tails, of, classes), v, len(names), tails, of, between(pairs, of, classes)), "brown-classes")
    kinds = np.bincount(of[: len(names)], minlength=classes).astype(np.float64)
    kinds[of[-1]] += ends > 0
    for r in others.groupBy("k").agg(F.count("*").alias("n")).collect():
        kinds[r["k"]] += r["n"]
    counts_head = np.array([c for _, c in top], dtype=np.float64)
    shared = docs.sparkSession.sparkContext.broadcast((names, counts_head, of))
    sign = "<u2" if classes > 256 else "u1"

    def run(block: int, rows: pa.Table, answers: pa.Table) -> pa.Table:
        names, counts_head, of = shared.value
        # Head words and the answers come first; words that training never met are numbered as they come and have count 0.
        met = [*(w.encode() for w in names), *answers.column("word").cast(pa.binary()).to_pylist()]
        numbers = Numbers(zip(met, range(len(met)), strict=True))
        count = np.concatenate([counts_head, answers.column("c").to_numpy()])
        kind = np.concatenate([of[: len(names)], answers.column("k").to_numpy()])
        ids, held, out = [], [], []
        for part, batch in blocks.texts(rows):
            ids += part.column("doc_id").to_pylist()
            held += part.column("held_out").to_pylist()
            seqs = [np.fromiter(map(numbers.__getitem__, words_of(text)), np.int64) for text in batch]
            if len(numbers) > len(count):
                new = list(numbers)[len(count) :]
                kind = np.append(kind, of[len(names) + np.fromiter((tail_of(w, tails) for w in new), np.int64, len(new))])
                count = np.append(count, np.zeros(len(new)))
            for seq in seqs:
                c = np.append(count[seq], ends)
                k = np.concatenate([of[-1:], kind[seq], of[-1:]])
                out.append((len(c), int((c > 0).sum()), float(np.log10((c + 1) / (n + v + 1)).sum()), float(np.log10(c + delta).sum()), k.astype(sign).tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
        return pa.table({"doc_id": pa.array(ids, rows.schema.field("doc_id").type), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(cols[0], pa.int64()), "n_known": pa.array(cols[1], pa.int64()), "base_score": pa.array(cols[2], pa.float64()), "emitted": pa.array(cols[3], pa.float64()), "classes": pa.array(cols[4], pa.binary())})

    answers = requests.join(others, "word").select("block", "word", "c", "k")
    kind = own.schema["doc_id"].dataType.simpleString()
    coded = materialize(blocks.met(own, answers, run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, emitted double, classes binary"), "brown-coded")
    move = class_pairs(coded, classes)
    share = (move.sum(0) + 1) / (move.sum() + classes)
    step = np.log10((move + mu * share) / (move.sum(1)[:, None] + mu))
    mass = move.sum(0) + delta * (kinds + 1)
    final = docs.sparkSession.sparkContext.broadcast(step - np.log10(mass))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = final.value
        for batch in batches:
            scores = []
            for x, emitted in zip(batch.column("classes"), batch.column("emitted").to_pylist(), strict=True):
                k = np.frombuffer(x.as_py(), sign)
                scores.append(emitted + float(step[k[:-1], k[1:]].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(scores, pa.float64())], names=[*batch.schema.names[:5], "score"])

    scored = coded.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
