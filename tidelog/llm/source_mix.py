"""Mixing sources to target weights by hash-threshold histograms, without sorting documents.

Every document has a fixed 30-bit hash. For each source the words are summed by hash bucket; the bucket in which the
source's budget runs out is the only one that is looked at again, in finer buckets, until the hash's bits are used up.
A document is taken if its hash lies below the threshold. A target above the source's size is met by nested budgets:
one threshold for the first copy of a document, a lower or equal one for the second, and so on.

Scale: words are counted once and the four-column digest is written to the shared folder; each level is a hash
aggregation with map-side combine, so a source that holds a third of all rows costs 1,024 rows from each task. Nothing
is collected. The table of budgets has a row for each source and copy; it is joined without a hint, so Spark
broadcasts it only when it is measured to be small and AQE splits a hot source otherwise.

Edge cases: null text has size 0; null is a source of its own, after the others; rows that agree in id and text share
a hash and are taken together; an empty table gives an empty mix; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

BITS = 30
STEP = 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def hash30(id_col: str, text_col: str) -> Column:
    """The first 30 bits of md5(id|text), so that any SQL engine can state them."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col), F.lit("")))
    return F.shiftright(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), 32 - BITS)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target): share of all words by weight, none above ``most`` times its source's size.

    A source is held at its limit if its limit per weight is below the level at which the others share what is left;
    in order of limit per weight those sources come first, so running sums find the level at once. One row a source.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = w.withColumn("level", level).withColumn("held", F.col("limit") / F.col("weight") <= F.col("level"))
    final = F.min(F.when(~F.col("held"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything).getField("level")
    return leveled.withColumn("final", final).select("source", "source_size", F.when(F.col("held"), F.col("limit")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame, copies: int) -> DataFrame:
    """(source, copy, threshold): documents with hash < threshold fill the source's budget for that copy."""
    budget = F.greatest(F.lit(0.0), F.least(F.col("target") - F.col("source_size") * F.col("copy"), F.col("source_size").cast("double")))
    state = goals.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(F.col("source").alias("s"), "copy", budget.alias("left"), F.lit(0).cast("long").alias("prefix"))
    for used in range(STEP, BITS + 1, STEP):
        inside = sized.join(state, sized.source.eqNullSafe(state.s) & (F.shiftright("h", BITS - used + STEP) == F.col("prefix")))
        bucket = F.shiftright("h", BITS - used).alias("bucket")
        counts = inside.groupBy("s", "copy", "left", bucket).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("s", "copy").orderBy("bucket")
        runs = counts.withColumn("upto", F.sum("n").over(run)).withColumn("below", F.col("upto") - F.col("n"))
        edge = runs.withColumn("last", F.lead("bucket").over(run).isNull()).where((F.col("upto") >= F.col("left")) | F.col("last"))
        first = edge.groupBy("s", "copy").agg(F.min(F.struct("bucket", "left", "below", "upto")).alias("e"))
        left = F.col("e.left") - F.col("e.below")
        if used < BITS:
            state = materialize(first.select("s", "copy", left.alias("left"), F.col("e.bucket").alias("prefix")), "mix-edge")
        else:
            over = F.col("e.upto") - F.col("e.left")
            state = first.select("s", "copy", (F.col("e.bucket") + F.when(over <= left, 1).otherwise(0)).alias("threshold"))
    return state


def mix_plan(sized: DataFrame, *, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(s, source_size, target, cuts) of each source, from rows of (source, size, h); cuts holds each copy's threshold."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = materialize(targets(sizes, weights, share, most), "mix-goals")
    cuts = thresholds(sized, goals, max(1, int(-(-most // 1)))).groupBy("s").agg(F.sort_array(F.collect_list(F.struct("copy", "threshold"))).alias("cuts"))
    return materialize(goals.join(cuts, goals.source.eqNullSafe(cuts.s), "left").drop("s"), "mix-plan").withColumnRenamed("source", "s")


def copies_of(h: str, size: str) -> Column:
    """How often a row is taken, next to its source's plan."""
    return F.when(F.col(size) > 0, F.coalesce(F.size(F.filter("cuts", lambda c: F.col(h) < c.threshold)), F.lit(0))).otherwise(0)


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, taken, h."""
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), hash30(id_col, text_col).alias("h")), "mix-sized")
    plan = mix_plan(sized, weights=weights, share=share, most=most)
    met = sized.join(plan, sized.source.eqNullSafe(plan.s)).withColumn("copies", copies_of("h", "size"))
    return met.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "h")


def mixed(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.0, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns; only the plan is joined to the texts.

    A row travels as one struct, so that its columns may have any names. Rows without words are not taken; null sources
    are one source; an empty table gives an empty one; rows that agree in id and text are taken together.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = docs.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), hash30(id_col, text_col).alias("h"), row.alias("row"))
    sized = materialize(own.drop("row"), "mix-sized")
    plan = mix_plan(sized, weights=weights, share=share, most=most).select("s", "cuts")
    met = own.join(plan, own.source.eqNullSafe(plan.s)).withColumn("copies", copies_of("h", "size")).where("copies > 0")
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
