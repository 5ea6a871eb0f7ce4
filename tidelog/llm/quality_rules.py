"""Quality rules whose cutoffs are risk-controlled: no Python runs on the executors.

Every document gets a few rates (symbols, repeated lines, repeated words, capitals, exclamation marks). For each
stratum (language) and rule, every cutoff of a fixed grid is tested on the labelled holdout: with n trusted documents
of which the cutoff would reject k, the exact binomial tail P(Bin(n, risk) <= k) bounds the chance that the true false
rejection rate exceeds ``risk``. The cutoffs of a rule are nested, so they are tested in a fixed sequence from the
loosest down, which the first failure ends, and need no share of ``delta`` each; rules and strata share it by Bonferroni.
The rules share ``risk`` by ``SHARES``, so that with confidence 1 - delta no stratum loses more than ``risk`` of its good
documents. A rule decides in a stratum from ln(delta / strata / rules) / ln(1 - its risk) trusted documents on (see
``enough``); strata in which no rule can decide are tested together, as one, and the bound holds for them together.
Among the certified cutoffs the one with the most bad labelled documents rejected is taken, where a good one weighs as
much as 1 / risk bad ones (ties: the loosest); a rule without a gain rejects nothing in that stratum.

Scale: one pass over the texts makes a narrow digest, written to the shared folder. The holdout is joined to it by id;
the histogram has strata x rules x ``GRID`` rows and is pre-aggregated before it is shuffled. Repeated windows are
found by sorting a document's own window hashes inside its row, so nothing is exploded.

Edge cases: null and empty texts have no words and fail the base rule; a null language is a stratum of its own; labels
that are null, unknown or contradict each other for one document do not count; repeated rows each get a result;
without labels no cutoff is certified and the base rule alone decides; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BLANKS, materialize

GRID = 100
#: name, counted, per: a document is rejected if counted / per is above the cutoff.
RULES = (("symbols", "n_symbols", "n_words"), ("dup_lines", "n_dup_lines", "n_lines"), ("repeats", "n_repeat_words", "n_words"), ("capitals", "n_capitals", "word_chars"), ("shouts", "n_shouts", "n_words"))

#: What part of the risk each rule may use: fixed beforehand, and 1 together.
SHARES = {"symbols": 0.4, "dup_lines": 0.15, "repeats": 0.15, "capitals": 0.15, "shouts": 0.15}


def repeated_at(words: str) -> Column:
    """The sorted places of windows found at least twice; ``words`` is a sorted array of (h, i), window hash and place."""
    same = lambda x, j: F.coalesce(F.get(words, j - 1).getField("h") == x.h, F.lit(False)) | F.coalesce(F.get(words, j + 1).getField("h") == x.h, F.lit(False))
    return F.sort_array(F.transform(F.filter(words, same), lambda x: x.i))


def covered(at: Column) -> Column:
    """Words under three-word windows that start at the sorted places ``at``."""
    gaps = F.zip_with(F.slice(at, F.lit(2), F.greatest(F.size(at), F.lit(1))), F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda s, x: s + x))


def text_stats(docs: DataFrame, *keep: Column, text_col: str = "text") -> DataFrame:
    """The kept columns and the counts that the rules use, all long."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(*keep, text.alias("__t"), F.trim(F.regexp_replace(text, BLANKS, " ")).alias("__w"), F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("__l"))
    names = [c for c in one.columns if not c.startswith("__")]
    w = F.col("__w")
    two = one.select(
        *names,
        F.when(w == "", 0).otherwise(F.length(w) - F.length(F.replace(w, F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.length(F.replace(w, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("__t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("__t", F.lit("!")).cast("long").alias("n_shouts"),
        F.regexp_extract_all(w, F.lit("(?=([^ ]++ [^ ]++ [^ ]++))[^ ]++ "), F.lit(1)).alias("__g"),
    )
    # Only a text that repeats a window has its windows sorted.
    some = F.size(F.array_distinct("__g")) < F.size("__g")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    three = two.withColumn("__h", F.when(some, F.sort_array(F.transform("__g", lambda g, i: F.struct(F.xxhash64(g).alias("h"), i.alias("i"))))).otherwise(none)).drop("__g")
    four = three.withColumn("__at", repeated_at("__h")).drop("__h")
    return four.withColumn("n_repeat_words", covered(F.col("__at")).cast("long")).drop("__at")


def binomial_tail(n: Column, k: Column, p: float | Column) -> Column:
    """P(Bin(n, p) <= k), summed exactly term by term in logarithms."""
    p = p if isinstance(p, Column) else F.lit(p)
    odds = F.log(p) - F.log1p(-p)
    first = n * F.log1p(-p)
    zero = F.struct(first.alias("term"), first.alias("total"))

    def more(s: Column, i: Column) -> Column:
        term = s.term + F.log(n - i + 1) - F.log(i) + odds
        high = F.greatest(s.total, term)
        return F.struct(term.alias("term"), (high + F.log(F.exp(s.total - high) + F.exp(term - high))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, zero, more, lambda s: s.total))


def rate(counted: str, per: str) -> Column:
    return F.when(F.col(per) > 0, F.least(F.floor(F.lit(GRID) * F.col(counted) / F.col(per)), F.lit(GRID))).otherwise(0).cast("int")


def enough(risk: float, delta: float, strata: int) -> int:
    """How many trusted documents a stratum needs for its first rule to decide, if the cutoff rejects none of them."""
    return math.ceil(math.log(delta / (max(1, strata) * len(RULES))) / math.log1p(-risk * max(SHARES.values())))


def certified_cutoffs(stats: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """(stratum, pool, rule, cutoff, n_good, k_good, k_bad, tail): the cutoff that each rule may use in each stratum, and what it was tested on (pool: the stratum, or null for all small ones)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("good"), F.max("quality").alias("__m")).where("good = __m").drop("__m")
    held = stats.join(known, "doc_id").select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), rate(a, b).alias("bin")) for name, a, b in RULES])).alias("x"))
    counts = held.groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.bin").alias("bin")).agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b"))
    counts = materialize(counts, "quality-counts")
    strata = counts.agg(F.countDistinct("stratum")).first()[0]
    # Which strata are pooled follows from their sizes alone, not from what a rule would reject there.
    pools = counts.groupBy("stratum").agg((F.sum("g") / len(RULES)).alias("n")).select("stratum", F.when(F.col("n") >= enough(risk, delta, strata), F.col("stratum")).alias("pool"))
    pools = materialize(pools, "quality-pools")
    pooled = counts.join(pools, "stratum").groupBy("pool", "rule", "bin").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    group = Window.partitionBy("pool", "rule")
    above = group.orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    # Every cutoff from this bin to just below the next one rejects the same: the loosest stands for them.
    loosest = F.coalesce(F.lead("bin").over(group.orderBy("bin")) - 1, F.col("bin"))
    tested = pooled.select("pool", "rule", loosest.alias("cutoff"), F.sum("g").over(group).cast("double").alias("n_good"), *[F.coalesce(F.sum(c).over(above), F.lit(0)).cast("double").alias(f"k_{name}") for c, name in (("g", "good"), ("b", "bad"))])
    each = F.element_at(F.create_map(*[F.lit(x) for name, _, _ in RULES for x in (name, risk * SHARES[name])]), F.col("rule"))
    gain = F.col("k_bad") - F.col("k_good") / F.lit(risk)
    worth = tested.where((gain > 0) & (F.col("k_good") <= F.col("n_good") * each))
    # A tail grows with k_good, hence down the cutoffs: those that pass are what the sequence reaches before its first failure.
    sure = worth.withColumn("tail", binomial_tail(F.col("n_good"), F.col("k_good"), each)).where(F.col("tail") <= delta / (max(1, strata) * len(RULES)))
    best = sure.groupBy("pool", "rule").agg(F.max(F.struct(gain.alias("gain"), "cutoff", "n_good", "k_good", "k_bad", "tail")).alias("best"))
    return pools.join(best.withColumnRenamed("pool", "__p"), F.col("pool").eqNullSafe(F.col("__p"))).select("stratum", "pool", "rule", *[F.col(f"best.{c}").alias(c) for c in ("cutoff", "n_good", "k_good", "k_bad", "tail")])


def quality_rules(docs: DataFrame, labels: DataFrame, *, risk: float = 0.05, delta: float = 0.1, min_words: int = 50, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """A row for each document: doc_id, the counts, base_failed, rejected_by (rules, comma-joined, or null) and kept."""
    stratum = F.coalesce(F.concat(F.lit("="), F.col(lang_col)), F.lit("")).alias("stratum")
    stats = materialize(text_stats(docs, F.col(id_col).alias("doc_id"), stratum, text_col=text_col), "quality-stats")
    cuts = materialize(certified_cutoffs(stats, labels, risk, delta), "quality-cutoffs")
    wide = cuts.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"cut_{name}") for name, _, _ in RULES])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    by = F.concat_ws(",", *[F.when(rate(a, b) > F.col(f"cut_{name}"), F.lit(name)) for name, a, b in RULES])
    judged = stats.join(wide, "stratum", "left").withColumn("base_failed", failed).withColumn("rejected_by", F.nullif(by, F.lit("")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"), "rejected_by")
