"""N-gram Jaccard self-join by adaptive multi-match prefixes, down to connected components.

A document's set is its distinct word shingles. Sets are ordered by (estimated frequency, hash), rarest first. With
n shingles and threshold t, two sets that link share at least m shingles among the first n - ceil(t n) + m of each. Each
document picks its own m: a longer prefix is scanned, but more of it must be shared, so documents whose prefix holds
frequent shingles (passages, near copies) take a larger one. Two documents are verified if their prefixes share the
smaller of their two m; that loses no link. Verification compares the shingles of the texts themselves.

Frequencies come from one counter sketch of fixed size over all documents. Sets are named by 64 bits of a digest, and
those that would share a name by the other 64; equal sets are one node, so exact copies are never paired. First each prefix token's sets are verified against one of them (a
star, linear in the group), again with other pivots while large groups are not in one component; only sets that are
then in different components are paired, so a group of near copies doesn't cost the square of its size. Sets that share a
token are paired only if enough of both comes after it and their signatures (parities of shingles by hash bucket, which
bound from below how much two sets differ) allow the threshold: that drops documents which share a passage alone, and no link.

Scale: two maps over the texts; prefixes (about 1 - t of the shingles) are shuffled once by token. Texts are moved for the
pairs that are verified only, compressed: each round picks them by a broadcast of their counted keys, or beyond ``PICKED``
by a bitmap of bounded size whose false positives a join removes. Nothing that grows with the corpus is collected.

Edge cases: null and empty texts have no shingles, link with nothing and are their own component; a text with fewer
words than a shingle is one shingle; a null doc_id takes part, and is the component's id only if no other is in it;
repeated rows each get a result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import KEPT, bounded_batches, dropped, eased, settled, total_chars

#: The least and most counters of the frequency sketch, and the most bits of the bitmap of sets whose texts are fetched.
SKETCH = (1 << 16, 1 << 24)
SLICES = 16
MOST_BITS = 1 << 26
MOST_MATCHES = 4
#: What a token's place in its prefix is multiplied with to hold the set's m beside it.
MOST_PLACE = 8
#: Bits of a set's signature, the columns that hold them, and the two that it is folded into where rows are many.
BITS = 512
SIGNATURE = [f"p{i}" for i in range(BITS // 64)]
FOLDED = ["q0", "q1"]
#: Rounds of stars at most, before what is left is paired, and the share of the undecided sets that a round must link to be worth another.
STARS, WORTH = 5, 0.01
#: Keys (16 bytes each), counted beforehand, that may be broadcast to pick texts.
PICKED = 500_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word to hash; words of usual length that were met are kept, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[word] = got
        return got


_hashes = WordHashes()
KEPT.append(_hashes)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = (h ^ w[j : len(w) - n + 1 + j]) * _PRIME
        h ^= h >> np.uint64(29)
    return np.unique(h)


def overlap(x: list[bytes], y: list[bytes], k: int) -> tuple[int, int, int]:
    """Sizes of two word sequences' shingle sets and of their intersection, from the words themselves.

    Words are numbered, then windows of 2, 3, ... k words: numbers of a few bytes, however long the texts are.
    """
    if min(len(x), len(y)) < k:
        one = [max(min(len(w), 1), len(set(zip(*(w[j:] for j in range(k)), strict=False)))) for w in (x, y)]
        return one[0], one[1], int(bool(x) and x == y)
    numbers: dict[bytes, int] = {}
    seq = np.fromiter((numbers.setdefault(w, len(numbers)) for w in (*x, *y)), np.int64, len(x) + len(y))
    window = seq
    for j in range(1, k):
        window = np.unique(window[:-1] * len(numbers) + seq[j:], return_inverse=True)[1]
    a, b = np.unique(window[: len(x) - k + 1]), np.unique(window[len(x) :])
    return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))


def set_id(h: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """128 bits of a digest: a set's name, and what stands in for it where two sets would share a name."""
    if not len(h):
        return None, None
    digest = hashlib.md5(h.tobytes()).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def signature(h: np.ndarray) -> list[int]:
    """A bit for each of BITS buckets: whether the set has an odd number of shingles there. Two sets differ in at least as many shingles as their signatures in bits."""
    odd = np.bincount((h >> np.uint64(7)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def sketch_size(chars: int) -> int:
    """A counter for every 32 shingles or so, so that passages shared by a few dozen documents stand out, up to a fixed size."""
    size = SKETCH[0]
    while size < SKETCH[1] and 32 * 6 * size < chars:
        size <<= 1
    return size


def slot(h: np.ndarray, size: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (size - 1)


def ranked(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte: eighths of an octave."""
    return np.minimum(np.round(8 * np.log2(counts.astype(np.float64) + 1)), 255).astype(np.uint8)


def prefix(h: np.ndarray, ranks: np.ndarray, usual: float, num: int, den: int) -> tuple[np.ndarray, int]:
    """(the tokens of a set's prefix, how many must be shared).

    The estimated cost of m matches is what the prefix's posting lists hold beyond the sketch's usual load, for
    scanning, and the candidates that still share m of them, for verification.
    """
    n = len(h)
    need = -(-num * n // den)
    f = ranks[slot(h, len(ranks))]
    order = np.lexsort((h, f))
    load = np.cumsum(np.maximum(2.0 ** (f[order] / 8.0) - usual, 0.0))
    best = min(range(1, min(MOST_MATCHES, need) + 1), key=lambda m: (load[n - need + m - 1] * (1 + 20 / m**2), m))
    return h[order[: n - need + best]], best


def digests(docs: DataFrame, k: int, size: int) -> DataFrame:
    """doc_id, key, n, s and d (see set_id) and the signature for each document; and for each task its sketch in slices, n their number (other columns null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.uint32)
        names = ["doc_id", "key", "n", "s", "d", *SIGNATURE, "sketch"]
        none = [0] * len(SIGNATURE)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            sizes, ids, bits = [], [], []
            for x in batch.column(2):
                h = shingle_hashes(x.as_py(), k)
                sizes.append(len(h))
                ids.append(set_id(h))
                bits.append(signature(h) if len(h) else none)
                np.add.at(counts, slot(h, size), np.uint32(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), *(pa.array([x[i] for x in ids], pa.int64()) for i in (0, 1)), *(pa.array([x[i] for x in bits], pa.int64()) for i in range(len(SIGNATURE))), pa.nulls(len(ids), pa.binary())], names=names)
        if kind is not None and counts.any():
            parts = [zstandard.compress(x.astype("<u4").tobytes(), 1) for x in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, kind), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), *[pa.nulls(SLICES, pa.int64())] * (2 + len(SIGNATURE)), pa.array(parts, pa.binary())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "key", "text").mapInArrow(eased(run), f"doc_id {kind}, key bigint, n int, s bigint, d bigint, {', '.join(f'{c} bigint' for c in SIGNATURE)}, sketch binary")


def shared_names(told: DataFrame) -> list[int]:
    """The names that unequal sets share; among 10^10 sets a few are expected, so that they may come to the driver."""
    pairs = told.where("s IS NOT NULL").groupBy("s").agg((F.min("d") < F.max("d")).alias("odd")).where("odd")
    return [r["s"] for r in pairs.select("s").toLocalIterator()]


def merged(sketches: DataFrame, size: int) -> np.ndarray:
    """The ranks of the summed sketches of all tasks: slices are added up on the executors, a byte for each counter comes to the driver."""

    def run(rows: pa.Table) -> pa.Table:
        total = np.zeros(size // SLICES, dtype=np.uint32)
        for x in rows.column("sketch"):
            total += np.frombuffer(zstandard.decompress(x.as_py()), "<u4")
        return pa.table({"n": rows.column("n").slice(0, 1), "ranks": pa.array([ranked(total).tobytes()], pa.binary())})

    out = np.zeros((SLICES, size // SLICES), dtype=np.uint8)
    for r in sketches.select("n", "sketch").groupBy("n").applyInArrow(run, "n int, ranks binary").collect():
        out[r["n"]] = np.frombuffer(r["ranks"], np.uint8)
    return out.ravel()


def tokens(docs: DataFrame, ranks: np.ndarray, odd: list[int], k: int, num: int, den: int) -> DataFrame:
    """(token, s, at): a row for each token of each set's prefix, at = MOST_PLACE * place + m; within a task a set is given out once."""
    odd = frozenset(odd)
    middle = 2.0 ** (float(np.median(ranks)) / 8) - 1
    usual = middle + 3 * middle**0.5 + 1
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts, ids, places = [], [], []
            for x in batch.column(0):
                h = shingle_hashes(x.as_py(), k)
                s, d = set_id(h)
                s = d if s in odd else s
                if s is None or s in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(s)
                own, m = prefix(h, shared.value, usual, num, den)
                parts.append(own.view(np.int64))
                ids.append(s)
                places.append(np.arange(len(own), dtype=np.int64) * MOST_PLACE + m)
            if parts:
                owners = np.repeat(np.array(ids), [len(p) for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts), pa.int64()), pa.array(owners, pa.int64()), pa.array(np.concatenate(places), pa.int64())], names=["token", "s", "at"])

    return docs.select("text").mapInArrow(eased(run), "token bigint, s bigint, at bigint")


def fetched(docs: DataFrame, wanted: DataFrame, odd: list[int], k: int) -> DataFrame:
    """(s, z): the compressed text of one document for each wanted (key, s), a table; a text's set is worked out again, so that a key which two documents share brings no wrong text."""
    few, odd = wanted.count(), frozenset(odd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [], []
            for x in batch.column(0):
                text = x.as_py() or ""
                s, d = set_id(shingle_hashes(text, k))
                names.append(d if s in odd else s)
                texts.append(zstandard.compress(text.encode(), 3))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(texts, pa.binary())], names=["s", "z"])

    some = docs.join(F.broadcast(wanted.select("key").distinct()), "key", "left_semi") if few <= PICKED else possible(docs, wanted, few)
    return some.select("text").mapInArrow(eased(run), "s bigint, z binary").join(wanted.select("s"), "s", "left_semi").dropDuplicates(["s"])


def possible(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The documents whose key may be wanted, by a bitmap of bounded size."""
    bits = 1 << 16
    while bits < MOST_BITS and bits < 32 * n:
        bits <<= 1
    place = F.pmod(F.xxhash64("key"), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    words = wanted.groupBy(F.shiftright(place, 6).alias("i")).agg(F.bit_or(one).alias("w")).toArrow()
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    bitmap[words.column("i").to_numpy()] = words.column("w").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy()
            yield batch.select(["key", "text"]).filter(pa.array((shared.value[at >> 6] >> (at & 63) & 1).astype(bool)))

    return docs.select("key", "text", place.alias("place")).mapInArrow(eased(run), "key bigint, text string")


def linked(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose texts' shingles reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("za"), batch.column("zb"), strict=True):
                n, o, both = overlap(*(zstandard.decompress(z.as_py()).lower().split() for z in (x, y)), k)
                good.append(den * both >= num * (n + o - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    za, zb = (texts.select(F.col("s").alias(c), F.col("z").alias(f"z{c}")) for c in "ab")
    return pairs.select("a", "b").join(zb, "b").join(za, "a").select("a", "b", "za", "zb").mapInArrow(eased(run), "a bigint, b bigint")


def needed(n: Column, o: Column, num: int, den: int) -> Column:
    """How many shingles sets of these sizes must share."""
    return F.ceil((n + o) * num / F.lit(num + den) - 1e-9)


def differing(columns: list[str], x: str, y: str) -> Column:
    return sum((F.bit_count(F.col(f"{c}{x}").bitwiseXOR(F.col(f"{c}{y}"))) for c in columns), F.lit(0))


def near(x: str, y: str, num: int, den: int, signature: list[str]) -> Column:
    """Sets of these sizes can reach the threshold, their signatures (whole or folded) allow it, and this token can be one of the first m that they share: enough of both sets comes after it. x and y are suffixes of the columns."""
    n, o, m = F.col(f"n{x}").cast("long"), F.col(f"n{y}").cast("long"), F.least(f"m{x}", f"m{y}")
    both = needed(n, o, num, den)
    sized = (F.least(n, o) * den >= F.greatest(n, o) * num) & (n - F.col(f"i{x}") >= both - m + 1) & (o - F.col(f"i{y}") >= both - m + 1)
    return sized & (differing(signature, x, y) <= n + o - 2 * both)


def stars(shared: DataFrame, sets: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of each token's sets with its pivot, where they are not in one component and their signatures allow the threshold; every turn has other pivots.

    The pivots are a table of their own, so that AQE can split the join where a token is in many sets.
    """
    own = ("s", "n", "m", "i", "root", *FOLDED)
    pivot = F.min(F.struct(F.xxhash64("token", "s", F.lit(turn)).alias("h"), *own)).alias("p")
    pivots = settled(shared.groupBy("token").agg(pivot).select("token", *[F.col(f"p.{c}").alias(f"{c}p") for c in own]), "join-pivots")
    met = shared.join(pivots, "token").where((F.col("root") != F.col("rootp")) & near("", "p", num, den, FOLDED))
    pairs = met.select(F.least("s", "sp").alias("a"), F.greatest("s", "sp").alias("b")).distinct()
    star = settled(plausible(pairs, sets, num, den), "join-star")
    dropped(pivots)
    return star


def plausible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole signatures allow the threshold."""
    x, y = (sets.select(F.col("s").alias(c), *[F.col(p).alias(p + c) for p in ("n", *SIGNATURE)]) for c in "ab")
    n, o = F.col("na").cast("long"), F.col("nb").cast("long")
    return pairs.join(x, "a").join(y, "b").where(differing(SIGNATURE, "a", "b") <= n + o - 2 * needed(n, o, num, den)).select("a", "b")


def texts_of(docs: DataFrame, pairs: DataFrame, sets: DataFrame, odd: list[int], k: int) -> DataFrame:
    """The texts of the sets in pairs."""
    ids = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()
    wanted = settled(ids.join(sets, "s").select("key", "s"), "join-wanted")
    texts = settled(fetched(docs, wanted, odd, k), "join-texts")
    dropped(wanted)
    return texts


def _verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame, odd: list[int], k: int, num: int, den: int) -> DataFrame:
    """The pairs that link; their texts are there for no longer than it takes."""
    texts = texts_of(docs, pairs, sets, odd, k)
    out = settled(linked(pairs, texts, k, num, den), "join-linked")
    dropped(texts)
    return out


def jaccard_join(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of id and text), n_shingles and component_id of each document, where documents link at den * intersection >= num * union."""
    bounded_batches(docs.sparkSession)
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    own = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))
    size = sketch_size(total_chars(docs, text_col))
    told = settled(digests(own, k, size), "join-digests")
    if odd := shared_names(told):
        told = told.withColumn("s", F.when(F.col("s").isin(odd), F.col("d")).otherwise(F.col("s")))
        if left := shared_names(told):
            raise ValueError(f"{len(left)} sets share both halves of a digest with others")
    sets = told.where("s IS NOT NULL").groupBy("s").agg(F.min("doc_id").alias("low"), F.min("key").alias("key"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in SIGNATURE])
    sets = settled(sets, "join-sets")
    ranks = merged(told.where("sketch IS NOT NULL"), size)
    by_token = Window.partitionBy("token")
    prefixes = tokens(own, ranks, odd, k, num, den).repartition("token").groupBy("token", "s", "at").agg(F.count("*").alias("__c")).drop("__c")
    # By itself, so that the shuffle of all prefixes is gone before the few that are left meet their sets.
    shared = settled(prefixes.withColumn("sets", F.count("*").over(by_token)).where("sets > 1").drop("sets"), "join-prefixes")
    placed = [F.floor(F.col("at") / MOST_PLACE).cast("int").alias("i"), (F.col("at") % MOST_PLACE).cast("int").alias("m"), F.col("s").alias("root")]
    folded = [functools.reduce(Column.bitwiseXOR, [F.col(c) for c in SIGNATURE[i :: len(FOLDED)]]).alias(q) for i, q in enumerate(FOLDED)]
    apart = settled(shared.select("token", "s", *placed).join(sets.select("s", "n", *folded), "s"), "join-shared")
    dropped(shared)
    links, tried = [], None
    for turn in range(STARS):
        star = stars(apart, sets, turn, num, den)
        tried = star if tried is None else tried.unionByName(star)
        links.append(_verified(own, star, sets, odd, k, num, den))
        root = components(functools.reduce(DataFrame.unionByName, links))
        # What is in one component stays so: only tokens that were undecided are looked at again.
        named = settled(apart.drop("root").join(root.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s")), "join-named")
        dropped(apart)
        split = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("g")).where("lo <> hi").select("token", "g")
        split = settled(split, "join-split")
        apart = settled(named.join(split.select("token"), "token", "left_semi"), "join-apart")
        dropped(named)
        # Another round of stars is worth its price while groups are large and rounds link what is in them.
        sizes = split.agg(F.sum("g").alias("rows"), F.sum(F.col("g") * (F.col("g") - 1) / 2).alias("pairs")).first()
        if (sizes["pairs"] or 0) <= 4 * (sizes["rows"] or 0) or links[-1].count() < WORTH * apart.agg(F.countDistinct("s")).first()[0]:
            break
    # A token's sets meet each other now: with their whole signatures, as a folded one lets most pairs through that share a passage alone.
    whole = settled(apart.drop(*FOLDED).join(sets.select("s", *SIGNATURE), "s"), "join-whole")
    dropped(apart)
    x, y = (whole.select("token", *[F.col(c).alias(c + end) for c in ("s", "n", "m", "i", "root", *SIGNATURE)]) for end in "xy")
    met = x.join(y, "token").where((F.col("sx") < F.col("sy")) & (F.col("rootx") != F.col("rooty")) & near("x", "y", num, den, SIGNATURE))
    pairs = met.groupBy(F.col("sx").alias("a"), F.col("sy").alias("b"), F.least("mx", "my").alias("m")).agg(F.count("*").alias("c")).where("c >= m").select("a", "b")
    pairs = settled(pairs.join(tried, ["a", "b"], "left_anti"), "join-pairs")
    dropped(whole)
    links.append(_verified(own, pairs, sets, odd, k, num, den))
    edges = settled(functools.reduce(DataFrame.unionByName, links), "join-edges")
    roots = components(edges)
    of_set = sets.join(roots.withColumnRenamed("node", "s"), "s", "left").select("s", F.coalesce("root", "s").alias("root"), "low")
    of_root = of_set.groupBy("root").agg(F.min("low").alias("component_id"))
    named = of_set.join(of_root, "root").select("s", "component_id")
    return told.where("sketch IS NULL").join(named, "s", "left").select("doc_id", "key", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, joined: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each component: the one with the smallest id.

    Documents without words all stay, as do components without an id; of rows that repeat both id and text one stays. A
    row travels as one struct, so that its columns may have any names; an empty table gives an empty one.
    """
    grouped = joined.where("n_shingles > 0 AND component_id IS NOT NULL")
    stay = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).getField("key").alias("key"))
    gone = settled(grouped.select("key").distinct().join(stay, "key", "left_anti"), "join-gone")
    again = settled(joined.where("n_shingles > 0").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "join-again")
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = rows.join(gone, "key", "left_anti")
    if not again.isEmpty():
        left = left.join(again, "key", "left_anti").unionByName(left.join(again, "key").dropDuplicates(["key"]))
    return left.select("row.*")
