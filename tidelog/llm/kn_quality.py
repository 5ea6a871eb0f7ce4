"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, and a perplexity limit by language.

The model is of characters (order ``ORDER``; blanks run together, the text's start is padded), so that one model serves
languages without blanks and its tables grow slowly. Counts of the highest order and continuation counts of the lower
ones carry three discounts each, from their counts of counts. A document is rejected if its perplexity is above the
``quantile`` of trusted documents of its language, times ``margin``; a language with fewer than ``enough`` trusted documents is held
against the quantile of all.

Scale: every block of documents (see ``blocks``) gives its distinct n-grams once, each with its count in the block's trusted
texts. These counts are added up, so that the model is fitted on all trusted documents; which ones a block holds is told by ids
alone. The n-grams then meet the count tables in shuffle joins, sharded by n-gram and by history, so no table of the model is
broadcast whole or collected, and the answers meet the texts: all texts are moved twice. Quantiles are over all trusted documents
too, exact to 1/1000 of a nat, by a histogram that is pre-aggregated.

Edge cases: null and empty texts have no characters, perplexity 1 and are kept; documents with null, unknown or
contradicting labels are not trusted; without trusted documents nothing is rejected; a null language is a group of its
own; repeated rows each get a result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .shared import bounded_batches, materialize, settled
from .toxicity import learnable

#: Two pairs of characters: see Grams.
ORDER = 4
PAD = "\n"
_BLANKS = re.compile(r"\s+")


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, each after ORDER - 1 pads; the number of characters of each)."""
    clean = [_BLANKS.sub(" ", t).strip() for t in texts]
    flat = np.frombuffer("".join(PAD * (ORDER - 1) + t for t in clean).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    return flat, np.array([len(t) for t in clean], dtype=np.int64)


def _dense(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, the place of each element's value among them), without sorting if the range allows."""
    if size > 1 << 24:
        return np.unique(x, return_inverse=True)
    used = np.zeros(size, dtype=bool)
    used[x] = True
    names = np.flatnonzero(used)
    place = np.zeros(size, dtype=np.int32)
    place[names] = np.arange(len(names), dtype=np.int32)
    return names, place[x]


def pair_names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two code points (21 bits each) as one number."""
    return first.astype(np.int64) << 21 | second


class Grams:
    """The n-gram that ends at each character of some texts: two pairs of characters, named by their places among those that occur."""

    def __init__(self, texts: list[str]) -> None:
        flat, self.n = codes_of(texts)
        self.codes, small = _dense(flat, int(flat.max()) + 1 if len(flat) else 1)
        self.width = len(self.codes)
        pair = small[:-1].astype(np.int64) * self.width + small[1:]
        self.pairs, at = _dense(pair, self.width**2)
        inner = np.ones(len(flat), dtype=bool)
        ends = np.cumsum(self.n + ORDER - 1)
        for j in range(1, ORDER):
            inner[ends - j] = False
        start = np.flatnonzero(inner)
        key = at[start].astype(np.int64) * len(self.pairs) + at[start + 2]
        #: The distinct n-grams, and which of them each character ends.
        self.keys, self.of = _dense(key, len(self.pairs) ** 2)

    def names(self) -> np.ndarray:
        """The pairs' names, ascending: see pair_names."""
        return pair_names(self.codes[self.pairs // self.width], self.codes[self.pairs % self.width])

    def texts(self) -> list[str]:
        if not len(self.keys):
            return []
        first, last = self.pairs[self.keys // len(self.pairs)], self.pairs[self.keys % len(self.pairs)]
        wide = self.codes[np.stack([first // self.width, first % self.width, last // self.width, last % self.width], 1)].astype("<u4").tobytes().decode("utf-32-le")
        return [wide[i : i + ORDER] for i in range(0, len(wide), ORDER)]


class Known:
    """The answers of a block as sorted arrays: a dictionary of their texts would take ten times the memory."""

    def __init__(self, answers: pa.Table) -> None:
        wide = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer("".join(b.to_pylist()).encode("utf-32-le"), "<u4") for b in answers.column("g").chunks)]).reshape(-1, ORDER)
        first, last = pair_names(wide[:, 0], wide[:, 1]), pair_names(wide[:, 2], wide[:, 3])
        self.pairs = np.unique(np.concatenate([first, last]))
        keys = np.searchsorted(self.pairs, first) * len(self.pairs) + np.searchsorted(self.pairs, last)
        order = np.argsort(keys)
        self.keys, self.logp = keys[order], answers.column("logp").to_numpy()[order]

    def of(self, grams: Grams) -> np.ndarray:
        """The answer of each of grams.keys."""
        at = np.searchsorted(self.pairs, grams.names())
        keys = at[grams.keys // len(grams.pairs)] * len(self.pairs) + at[grams.keys % len(grams.pairs)]
        found = np.searchsorted(self.keys, keys)
        if not np.array_equal(self.keys[found], keys):
            raise ValueError("an n-gram of the block has no answer")
        return self.logp[found]


def count_grams(docs: DataFrame) -> DataFrame:
    """(g, c) over all texts of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in blocks.texts(pa.Table.from_batches([batch])):
                own = Grams([x or "" for x in some])
                yield pa.RecordBatch.from_arrays([pa.array(own.texts(), pa.string()), pa.array(np.bincount(own.of, minlength=len(own.keys)), pa.int64())], names=["g", "c"])

    return docs.select("text").mapInArrow(run, "g string, c bigint").groupBy("g").agg(F.sum("c").alias("c"))


def requests(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(block, g, n): the distinct n-grams of each block and how often its rows with the block's trusted ids hold them."""

    def run(block: int, rows: pa.Table, known: pa.Table) -> pa.Table:
        seen: dict[str, int] = {}
        learn = pc.is_in(rows.column("__id"), value_set=known.column("__id").combine_chunks())
        for part, batch in blocks.texts(rows.append_column("learn", learn)):
            own = Grams(batch)
            inside = np.repeat(part.column("learn").to_numpy(), own.n)
            for g, n in zip(own.texts(), np.bincount(own.of[inside], minlength=len(own.keys)).tolist()):
                seen[g] = seen.get(g, 0) + n
        names = sorted(seen)
        return pa.table({"block": pa.array([block] * len(names), pa.int32()), "g": pa.array(names, pa.string()), "n": pa.array([seen[g] for g in names], pa.int64())})

    return blocks.met(docs.select("block", "__id", "text"), trusted.select("block", "__id"), run, "block int, g string, n bigint")


class Level:
    """Counts of one order: grams (g, c), histories (h, total, gamma) and the discounts."""

    def __init__(self, grams: DataFrame, order: int) -> None:
        self.order = order
        # Up to three of the counts of counts are needed for each discount: four rows at most.
        seen = {r["c"]: r["n"] for r in grams.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
        one, two, three, four = (float(seen.get(i, 0)) for i in (1, 2, 3, 4))
        y = one / (one + 2 * two) if one + two else 0.5
        self.discount = [max(0.0, min(k, x)) for k, x in ((1, 1 - 2 * y * two / one if one else 0.5), (2, 2 - 3 * y * three / two if two else 0.75), (3, 3 - 4 * y * four / three if three else 1.0))]
        self.grams = grams
        c = F.col("c")
        d = self.cut(c)
        history = F.substring("g", 1, order - 1)
        # Written, so that a join on short histories, which many n-grams share, is one that AQE can split or broadcast.
        self.histories = materialize(grams.groupBy(history.alias("h")).agg(F.sum("c").alias("total"), (F.sum(d) / F.sum("c")).alias("gamma")), f"kn-histories-{order}")

    def cut(self, c: Column) -> Column:
        a, b, e = self.discount
        return F.when(c == 1, a).when(c == 2, b).otherwise(e)

    def lower(self) -> DataFrame:
        """Continuation counts of the next lower order."""
        return self.grams.groupBy(F.substring("g", 2, self.order - 1).alias("g")).agg(F.count("*").alias("c"))


def log_probabilities(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(g, logp) for the wanted n-grams: log10 of the probability of the last character after the others."""
    levels = [Level(counts, ORDER)]
    for order in range(ORDER - 1, 0, -1):
        levels.append(Level(materialize(levels[-1].lower(), f"kn-{order}"), order))
    kinds = levels[-1].grams.count()
    p = wanted.select("g", F.lit(1.0 / (kinds + 1)).alias("p"))
    for level in reversed(levels):
        own = level.grams.select(F.col("g").alias("__g"), F.col("c").alias("__c"))
        history = level.histories.withColumnRenamed("h", "__h")
        end = p.withColumn("__e", F.right("g", F.lit(level.order))).withColumn("__f", F.substring("__e", 1, level.order - 1))
        both = end.join(own, F.col("__e") == F.col("__g"), "left")
        if level.order == 1:
            # All characters have one history, the empty one.
            only = level.histories.first()
            both = both.withColumns({c: F.lit(only[c] if only else None).cast("double") for c in ("total", "gamma")})
        else:
            both = both.join(history, F.col("__f") == F.col("__h"), "left")
        seen = F.greatest(F.coalesce(F.col("__c"), F.lit(0)) - level.cut(F.col("__c")), F.lit(0.0))
        mixed = F.coalesce(seen, F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("p")
        p = both.select("g", F.coalesce(mixed, F.col("p")).alias("p"))
    return p.select("g", F.log10("p").alias("logp"))


def perplexities(docs: DataFrame, trusted: DataFrame, *, keep: tuple[Column, ...] = (), with_text: bool = False, block_chars: int = 24_000_000, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The kept columns (with text, if wanted), n_chars and perplexity; the model is fitted on the texts of all trusted ids."""
    own = blocks.blocked(docs, *keep, F.col(id_col).alias("__id"), text_col=text_col, chars=block_chars)
    # The ids meet the trusted ones without their texts.
    known = materialize(own.select("block", "__id").join(trusted.select(F.col("doc_id").alias("__id")), "__id", "left_semi"), "kn-known")
    wanted = settled(requests(own, known), "kn-requests")
    counts = materialize(wanted.where("n > 0").groupBy("g").agg(F.sum("n").alias("c")), "kn-counts")
    own = own.drop("__id")
    answers = wanted.join(log_probabilities(wanted.select("g").distinct(), counts), "g").select("block", "g", "logp")
    names = [c for c in own.columns if c != "block" and (with_text or c != "text")]

    def run(block: int, rows: pa.Table, known: pa.Table) -> pa.Table:
        answered = Known(known)
        size, total = [], []
        for _, batch in blocks.texts(rows):
            own = Grams(batch)
            size.append(own.n)
            total.append(np.bincount(np.repeat(np.arange(len(own.n)), own.n), weights=answered.of(own)[own.of], minlength=len(own.n)))
        n, s = np.concatenate(size), np.concatenate(total)
        out = {c: rows.column(c) for c in names}
        return pa.table(out | {"n_chars": pa.array(n, pa.int64()), "perplexity": pa.array(10 ** (-s / np.maximum(n, 1)), pa.float64())})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.select(*names).schema)
    return blocks.met(own, answers, run, f"{schema}, n_chars bigint, perplexity double")


def limits(scored: DataFrame, trusted: DataFrame, *, quantile: float, enough: int, margin: float) -> DataFrame:
    """(lang_key, most): the perplexity limit of each language; lang_key null holds for all others."""
    known = scored.join(trusted.select("doc_id"), "doc_id").where("n_chars > 0")
    step = F.ceil(F.log("perplexity") * 1000)
    counts = materialize(known.groupBy("lang_key", step.alias("step")).agg(F.count("*").alias("n")), "kn-histogram")
    every = counts.groupBy("step").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang_key"), "step", "n")
    both = counts.unionByName(every)
    group = Window.partitionBy("lang_key")
    upto = F.sum("n").over(group.orderBy("step"))
    runs = both.withColumn("upto", upto).withColumn("all", F.sum("n").over(group)).where((F.col("upto") >= quantile * F.col("all")) & ((F.col("all") >= enough) | F.col("lang_key").isNull()))
    return runs.groupBy("lang_key").agg((F.exp(F.min("step") / 1000) * margin).alias("most"))


def kn_quality(docs: DataFrame, labels: DataFrame, *, carry: tuple[str, ...] = (), quantile: float = 0.99, margin: float = 1.05, noise: float = 2.0, enough: int = 30, lang_col: str = "lang", block_chars: int = 24_000_000) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold and kept for each document, and the columns to carry (``text`` if named; null comes back empty).

    The mean over n characters strays as 1 / sqrt(n): the limit is widened by exp(noise / sqrt(n)), which keeps short clean texts.
    """
    bounded_batches(docs.sparkSession)
    trusted = materialize(learnable(labels, "quality").where("y = 1").select("doc_id"), "kn-trusted")
    key = F.coalesce(F.concat(F.lit("="), F.col(lang_col)), F.lit(""))
    others = [F.col(c).alias(f"own_{c}") for c in carry if c != "text"]
    scored = perplexities(docs, trusted, keep=(F.col("doc_id").alias("doc_id"), F.col(lang_col).alias("lang"), key.alias("lang_key"), *others), with_text="text" in carry, block_chars=block_chars)
    scored = materialize(scored, "kn-scores")
    most = materialize(limits(scored, trusted, quantile=quantile, enough=enough, margin=margin), "kn-limits")
    other = most.where("lang_key IS NULL").first()  # one row at most
    judged = scored.join(most.where("lang_key IS NOT NULL"), "lang_key", "left")
    threshold = F.coalesce(F.col("most"), F.lit(other["most"] if other else None).cast("double"))
    kept = F.col("n_chars").eqNullSafe(0) | threshold.isNull() | (F.col("perplexity") <= threshold * F.exp(F.lit(noise) / F.sqrt("n_chars")))
    return judged.select("doc_id", "lang", "n_chars", "perplexity", threshold.alias("threshold"), kept.alias("kept"), *[c if c == "text" else f"own_{c}" for c in carry])
