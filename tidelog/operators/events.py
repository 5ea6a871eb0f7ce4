"""Event streams by entity and visit: joins over time, ordinals, windows, nesting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, times
from ..sources.shared import written


def dictionary_join(facts: DataFrame, names: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join to a dictionary; facts without an entry keep null. Spark broadcasts it if it is small enough."""
    return facts.join(names, list(on), "left")


def horizon_join(points: DataFrame, events: DataFrame, *, entity: str, at: str, ts: str, hours: float, day_only: str | None = None, bucket_hours: float | None = None) -> DataFrame:
    """Each point with the entity's events in (at, at + hours].

    Both sides are cut into time buckets of the horizon's length, a point takes part in the two that its horizon
    touches: an equi-join on (entity, bucket) that spreads a hot entity over its time. Events flagged ``day_only``
    count from the point's day on, whole days included. Columns of both sides must have different names, entity apart.
    """
    width = int((bucket_hours or max(hours, 24.0)) * 3_600_000_000)
    bucket = lambda c: F.floor(times.micros(c) / F.lit(width))
    end = times.plus_hours(F.col(at), hours)
    first = F.date_trunc("day", F.col(at)) if day_only else F.col(at)
    asked = points.withColumn("__until", end).withColumn("__b", F.explode(F.sequence(bucket(first), bucket(end))))
    held = events.withColumn("__b", bucket(F.col(ts)))
    inside = (times.micros(F.col(ts)) > times.micros(F.col(at))) & (times.micros(F.col(ts)) <= times.micros(F.col("__until")))
    if day_only:
        days = (F.to_date(ts) >= F.to_date(at)) & (F.to_date(ts) <= F.to_date("__until"))
        inside = F.when(F.col(day_only), days).otherwise(inside)
    return asked.join(held, [entity, "__b"]).where(inside).drop("__b", "__until")


def decayed(joined: DataFrame, *, at: str, ts: str, floor: float = 0.01, span: float = 24.0) -> DataFrame:
    """With weight, by the hours from the point to the event."""
    return joined.withColumn("weight", scores.decay(times.hours_between(F.col(at), F.col(ts)), floor, span))


def relative_weight(df: DataFrame, by: Sequence[str], order: Sequence[Column], weight: str = "weight") -> DataFrame:
    """relative: each weight over its group's first one, as doubles divide (x / 0 is infinite, 0 / 0 NaN); null where either is null."""
    w = F.col(weight).cast("double")
    first = F.first(w).over(Window.partitionBy(*by).orderBy(*order))
    # An ANSI division by zero is an error; the power -1 of a zero is an infinity of its sign.
    return df.withColumn("relative", F.when(first == 0, w * F.pow(first, F.lit(-1.0))).otherwise(F.try_divide(w, first)))


def with_ordinal(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "seq") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def running_numbers(df: DataFrame, order: Sequence[str | Column], name: str = "n") -> DataFrame:
    """1, 2, ... in a total order: counts by range partition, then ordinals within each, no global window.

    The rows are written once with their partition and place: both uses must see the same partitions.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m"))
    kept = written(spread)
    # Range partitions ascend with the order, and a row's id with its place in the partition.
    counted = kept.groupBy("__p").agg(F.count("*").alias("__c"), F.min("__m").alias("__first"))
    # One row for each partition.
    before = counted.select("__p", "__first", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return kept.join(F.broadcast(before), "__p").withColumn(name, (F.col("__m") - F.col("__first") + F.col("__before") + 1).cast("long")).drop("__p", "__m", "__first", "__before")


def dense_ids(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """1, 2, ... over the distinct keys in order."""
    return running_numbers(df.select(key).where(F.col(key).isNotNull()).distinct(), [key], name)


def next_event(df: DataFrame, by: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])


def history(df: DataFrame, by: str, order: Sequence[Column], what: Column, name: str = "history", most: int | None = None) -> DataFrame:
    """Everything up to and with each row (the last ``most`` rows if given)."""
    return df.withColumn(name, F.collect_list(what).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding if most is None else 1 - most, 0)))


class Prefixes:
    """Histories by reference: an entity's items once, in chunks, and for each row how many of them it has behind it.

    ``chunks``: by, chunk, items (at most ``size``, in order); ``rows``: the given rows with ``n``, the length of their
    history. Bytes are linear in the rows, whatever the length of a history; ``expand`` makes the arrays of the rows that
    are asked for.
    """

    def __init__(self, rows: DataFrame, chunks: DataFrame, by: str, size: int) -> None:
        self.rows, self.chunks, self.by, self.size = rows, chunks, by, size

    def expand(self, asked: DataFrame, key: str, name: str = "history") -> DataFrame:
        """key and its history for the rows of ``asked`` (rows of ``rows``, with by, key and n); a row's chunks meet by an equi-join."""
        last = F.floor((F.col("n") - 1) / self.size)
        own = asked.select(F.col(key).alias("__key"), F.col(self.by).alias("__by"), "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("__chunk"))
        met = own.join(self.chunks, F.col("__by").eqNullSafe(F.col(self.by)) & (F.col("__chunk") == F.col("chunk")))
        part = F.slice("items", F.lit(1), F.least(F.lit(self.size), F.col("n") - F.col("chunk") * self.size).cast("int"))
        parts = met.groupBy(F.col("__key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("chunk", part.alias("items")))).alias("__p"))
        return parts.select(key, F.flatten(F.transform("__p", lambda x: x["items"])).alias(name))


def history_by_reference(df: DataFrame, by: str, order: Sequence[str], what: str, size: int = 1024) -> Prefixes:
    """Everything up to and with each row, as (chunks, length): rows are numbered by ranges of (by, order), so that an entity may be many tasks; a null entity is one."""
    numbered = running_numbers(df, [by, *order], "__n")
    first = numbered.groupBy(F.col(by).alias("__by")).agg(F.min("__n").alias("__first"))
    placed = written(numbered.join(first, F.col(by).eqNullSafe(F.col("__by"))).withColumn("n", F.col("__n") - F.col("__first") + 1).drop("__n", "__first", "__by"))
    chunk = F.floor((F.col("n") - 1) / size).alias("chunk")
    items = F.transform(F.sort_array(F.collect_list(F.struct("n", F.col(what).alias("x")))), lambda s: s.x)
    return Prefixes(placed, placed.groupBy(by, chunk).agg(items.alias("items")), by, size)


def sliding(df: DataFrame, by: str, order: Sequence[Column], what: Column, size: int, stride: int = 1) -> DataFrame:
    """Complete windows of ``size`` rows, each ``stride`` after the last: by, window (from 0), items."""
    w = Window.partitionBy(by).orderBy(*order)
    items = F.collect_list(what).over(w.rowsBetween(0, size - 1))
    rows = df.select(by, (F.row_number().over(w) - 1).alias("__i"), items.alias("items"))
    return rows.where((F.size("items") == size) & (F.col("__i") % stride == 0)).select(by, (F.col("__i") / stride).cast("int").alias("window"), "items")


def gaps_and_anchors(df: DataFrame, by: str, order: Sequence[Column], target: Column) -> DataFrame:
    """Targets are masked and numbered (gap, from 0); the rest are anchors (gap null)."""
    w = Window.partitionBy(by).orderBy(*order)
    flag = F.coalesce(target, F.lit(False))
    return df.withColumn("gap", F.when(flag, F.coalesce(F.sum(flag.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")))


def segments(df: DataFrame, by: str, order: Sequence[Column], starts: Column, name: str = "segment") -> DataFrame:
    """A running number that grows at each row where ``starts`` holds (0: before the first)."""
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(Window.partitionBy(by).orderBy(*order)).cast("int"))


def nested(df: DataFrame, by: Sequence[str], order: Sequence[str], fields: Sequence[str], name: str = "items") -> DataFrame:
    """One row for each group with its rows as an array of structs in order."""
    items = F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    return df.groupBy(*by).agg(F.transform(items, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def ordered_unique(df: DataFrame, by: Sequence[str], order: str, fields: Sequence[str], name: str = "items") -> DataFrame:
    """The distinct combinations of some fields of each group as an array, in the order in which they first occur; repeats are merged before anything is gathered."""
    first = df.groupBy(*by, *fields).agg(F.min(order).alias("__first"))
    return nested(first, by, ["__first", *fields], fields, name)


def increments(df: DataFrame, by: str, order: Sequence[str], mark: Column, item: Column, name: str = "items") -> DataFrame:
    """by, the marks' ``order`` and what the group's growing list of items has gained since the mark before (items of rows that are no mark)."""
    window = Window.partitionBy(by).orderBy(*order)
    is_mark = F.coalesce(mark, F.lit(False))
    # Marks before a row: an item and the next mark have the same number.
    before = F.coalesce(F.sum(is_mark.cast("int")).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = df.select(by, F.struct(*order).alias("__o"), is_mark.alias("__mark"), item.alias("__x"), before.alias("__n"))
    gained = F.sort_array(F.collect_list(F.when(~F.col("__mark"), F.struct("__o", "__x"))))
    grouped = rows.groupBy(by, "__n").agg(F.max(F.when(F.col("__mark"), F.col("__o"))).alias("__at"), gained.alias("__g")).where(F.col("__at").isNotNull())
    return grouped.select(by, *[F.col(f"__at.{c}").alias(c) for c in order], F.transform("__g", lambda g: g["__x"]).alias(name))


def contexts(questions: DataFrame, rows: DataFrame, *, visit: str, qid: str, order: Sequence[str], line: Column) -> DataFrame:
    """For each visit that a question names: visit, qids (sorted), n_rows and context, its rows' lines in order; a visit without rows is reported with a null context."""
    asked = questions.groupBy(visit).agg(F.sort_array(F.collect_set(qid)).alias("qids"))
    # Only the rows of visits that are asked for are gathered.
    own = rows.withColumn("__line", line).join(asked.select(visit), visit, "left_semi")
    told = nested(own, [visit], list(order), ["__line"]).select(visit, F.size("items").alias("n_rows"), F.array_join(F.transform("items", lambda x: x["__line"]), "\n").alias("context"))
    return asked.join(told, visit, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str], what: str, *, nulls_win: bool = True) -> DataFrame:
    """The value of the latest row by group; a null time counts as later than all (or, with nulls_win off, earlier)."""
    key = F.struct(*[x for c in order for x in ((F.col(c).isNull() if nulls_win else F.col(c).isNotNull()).alias(f"{c}__n"), F.col(c))])
    return df.groupBy(*by).agg(F.max_by(what, key).alias(what))


def first_filled(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """For each column by itself the first value that is not null."""
    return df.groupBy(*by).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts groups to k before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def keyed_order(seed: str, *keys: str) -> Column:
    """A fixed shuffle: md5 of the seed and the keys."""
    return F.md5(F.concat_ws("::", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def sample_per_group(df: DataFrame, by: Sequence[str], keys: Sequence[str], k: int, seed: str = "7") -> DataFrame:
    return top_k(df, by, [keyed_order(seed, *keys), *[F.col(c) for c in keys]], k, "draw")


def batches(df: DataFrame, by: str, order: Sequence[Column], size: int) -> DataFrame:
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size).cast("int"))


def visible(visit: Column, ts: Column, *, cutoff_visit: Column, cutoff_ts: Column, inclusive: bool = False, until_visit: Column | None = None, until_ts: Column | None = None) -> Column:
    """May a row be seen at a cutoff? By time where the row's and the cutoff's are known, else by visit; an unknown visit (null, -1) is hidden under a visit cutoff.

    ``until_visit`` (exclusive) and ``until_ts`` (inclusive) limit further, where they are not null, and hide rows whose
    visit or time is unknown.
    """
    by_ts = ts <= cutoff_ts if inclusive else ts < cutoff_ts
    known = F.coalesce(visit >= 0, F.lit(False))
    by_visit = known & F.coalesce(visit <= cutoff_visit if inclusive else visit < cutoff_visit, F.lit(False))
    seen = F.when(cutoff_ts.isNotNull() & ts.isNotNull(), by_ts).when(cutoff_visit.isNotNull(), by_visit).otherwise(F.lit(True))
    if until_visit is not None:
        seen &= until_visit.isNull() | (known & F.coalesce(visit < until_visit, F.lit(False)))
    if until_ts is not None:
        seen &= until_ts.isNull() | F.coalesce(ts <= until_ts, F.lit(False))
    return seen


def seen_so_far(df: DataFrame, by: str, ts: str, name: str = "n") -> DataFrame:
    """For each row how many rows of its entity are no later, itself and its peers included; rows without entity or time have none and are left out."""
    return df.where(F.col(by).isNotNull() & F.col(ts).isNotNull()).withColumn(name, F.count("*").over(Window.partitionBy(by).orderBy(ts).rangeBetween(Window.unboundedPreceding, Window.currentRow)))


def pack(df: DataFrame, by: str, group: str, order: str, text: str, budget: int, *, item_chars: int = 900, note: Column | None = None, most_groups: int | None = None, bullet: str = "- ", cut_mark: str = " ...[TRUNCATED]") -> DataFrame:
    """by, place, group, order, line: what fits into ``budget`` characters, newest group first, notes before other rows, then in order.

    A longer text is cut to ``item_chars`` and marked. A line that doesn't fit ends its group, not the older ones; after
    ``most_groups`` groups with a line no other is opened. What is skipped depends on what was taken, so this is a fold: an
    entity's rows stream past it in order, and it holds a few numbers, whatever the entity's size.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    line = F.concat(F.lit(bullet), F.when(F.length(whole) > item_chars, F.concat(F.substring(whole, 1, item_chars), F.lit(cut_mark))).otherwise(whole))
    late = F.lit(0) if note is None else F.coalesce((~note).cast("int"), F.lit(1))
    rows = df.select(F.col(by).alias("e"), F.col(group).cast("bigint").alias("g"), late.alias("late"), F.col(order).cast("bigint").alias("o"), F.length(line).alias("size"), line.alias("line"))
    kind = df.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun = None, False
        for batch in batches:
            keep, places = [], []
            entities, groups, sizes = (batch.column(i).to_pylist() for i in (0, 1, 4))
            for i, (e, g, size) in enumerate(zip(entities, groups, sizes, strict=True)):
                if not begun or e != now:
                    # Characters and groups taken, the group that is shut, the last one with a line, lines taken.
                    now, begun, used, opened, shut, last, place = e, True, 0, 0, (), (), 0
                if shut == (g,) or used + size + 1 > budget or (most_groups is not None and last != (g,) and opened >= most_groups):
                    shut = (g,)
                    continue
                used, opened, last = used + size + 1, opened + (last != (g,)), (g,)
                keep.append(i)
                places.append(place)
                place += 1
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(places, pa.int32()), some.column(1), some.column(3), some.column(5)], names=["e", "place", "g", "o", "line"])

    streamed = rows.repartition("e").sortWithinPartitions("e", F.desc_nulls_first("g"), "late", "o", "line").mapInArrow(run, f"e {kind}, place int, g bigint, o bigint, line string")
    return streamed.toDF(by, "place", group, order, "line")


def ratio_sample(df: DataFrame, by: str, keys: Sequence[str], ratio: float, seed: str = "7") -> DataFrame:
    """floor(ratio * n) rows of each group, those that come first in a fixed shuffle, in the columns of df.

    Groups may be few and large: counts by hash bucket find the bucket in which a group's share ends, and only that
    bucket's rows are ranked (a 4096th of the group).
    """
    h = keyed_order(seed, *keys)
    bucket = F.conv(F.substring(h, 1, 3), 16, 10).cast("int")
    own = df.withColumns({"__h": h, "__b": bucket})
    counts = own.groupBy(by, "__b").agg(F.count("*").alias("__n"))
    run = Window.partitionBy(by).orderBy("__b")
    upto = counts.withColumn("__upto", F.sum("__n").over(run)).withColumn("__want", F.floor(F.sum("__n").over(Window.partitionBy(by)) * ratio))
    # One row for each group: its first bucket that isn't taken whole, and how many of that one's rows are.
    edge = upto.where("__upto > __want").groupBy(F.col(by).alias("__by")).agg(F.min(F.struct("__b", (F.col("__want") - F.col("__upto") + F.col("__n")).alias("left"))).alias("__e"))
    met = own.join(edge, F.col(by).eqNullSafe(F.col("__by")), "left")
    whole = met.where(F.col("__e").isNull() | (F.col("__b") < F.col("__e.__b")))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("__h", *keys))
    part = met.where(F.col("__b") == F.col("__e.__b")).withColumn("__r", rank).where(F.col("__r") <= F.col("__e.left"))
    return whole.select(*df.columns).unionByName(part.select(*df.columns))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace rows of old with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def pending(wanted: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    return wanted.join(done, list(on), "left_anti")


def full_coverage(wanted: DataFrame, matched: DataFrame, entity: str, visit: str, least: int) -> DataFrame:
    """Entities whose every visit is matched, with at least ``least`` visits."""
    have = matched.select(entity, visit).distinct().withColumn("__m", F.lit(1))
    both = wanted.select(entity, visit).distinct().join(have, [entity, visit], "left")
    return both.groupBy(entity).agg(F.count("*").alias("n_total"), F.count("__m").alias("n_matched")).where((F.col("n_total") == F.col("n_matched")) & (F.col("n_total") >= least))


def fingerprint_dedup(df: DataFrame, fields: Sequence[str], order: str) -> DataFrame:
    """The first row of each content fingerprint (sha-1 of the fields as JSON)."""
    return df.withColumn("fingerprint", F.sha1(F.to_json(F.struct(*sorted(fields))))).withColumn("__r", F.row_number().over(Window.partitionBy("fingerprint").orderBy(order))).where("__r = 1").drop("__r")
