"""Aggregations, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import events as ev
from ..operators import rollups as ru
from .registry import query

c = F.col


def q(name: str, sql: str, run) -> None:
    query(name, sql)(run)


def per_user(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"))


PER_USER = "(SELECT user_id, count(*) AS n FROM events GROUP BY user_id)"

q("AGG1_group_count", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id", per_user)
q(
    "AGG2_ordered_list",
    "SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS a FROM orders GROUP BY 1",
    lambda t: (
        ev.nested(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"]).select("o_custkey", F.transform("items", lambda x: x.o_orderkey).alias("a"))
    ),
)
q(
    "AGG3_distinct_concat",
    "SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS s FROM events GROUP BY 1",
    lambda t: t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("s")),
)
q(
    "AGG4_latest_row",
    "SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1",
    lambda t: ev.latest(t.events, ["user_id"], ["ts"], "event_id"),
)
q(
    "AGG5_last_by_time",
    """
    SELECT user_id, coalesce(arg_max(event_id, ts) FILTER (event_type <> 'error'), max(event_id)) AS event_id FROM events
    GROUP BY 1
    """,
    lambda t: ev.latest(t.events.withColumn("seen", F.when(c("event_type") != "error", c("ts"))), ["user_id"], ["seen"], "event_id", nulls_win=False),
)
q(
    "AGG6_first_value",
    "SELECT user_id, arg_min(event_type, ts) AS event_type FROM events GROUP BY 1",
    lambda t: t.events.groupBy("user_id").agg(F.min_by("event_type", "ts").alias("event_type")),
)
q(
    "AGG7_first_filled",
    """
    SELECT user_id, arg_min(value, ts) FILTER (value > 20) AS v, arg_min(event_type, ts) FILTER (event_type <> 'view')
    AS k FROM events GROUP BY 1
    """,
    lambda t: (
        ev.first_filled(
            t.events.select(
                "user_id",
                "ts",
                F.when(c("value") > 20, c("value")).alias("v"),
                F.when(c("event_type") != "view", c("event_type")).alias("k"),
            ),
            ["user_id"],
            "ts",
            ["v", "k"],
        )
    ),
)
q(
    "AGG8_any_flag",
    "SELECT user_id, bool_or(value > 45) AS any_warning FROM events GROUP BY 1",
    lambda t: t.events.groupBy("user_id").agg(F.bool_or(c("value") > 45).alias("any_warning")),
)
q(
    "AGG9_nested_items",
    """
    SELECT l_orderkey, l_shipdate, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem
    GROUP BY ALL
    """,
    lambda t: (
        ev.nested(t.lineitem, ["l_orderkey", "l_shipdate"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_partkey"]).select("l_orderkey", "l_shipdate", F.transform("items", lambda x: x.l_partkey).alias("parts"))
    ),
)
q(
    "AGG11_ordered_unique_filtered",
    """
    SELECT user_id, list(event_type ORDER BY m) AS a FROM (SELECT user_id, event_type, min((ts, event_id)) AS m FROM
    events WHERE event_type <> 'error' GROUP BY ALL) GROUP BY 1
    """,
    lambda t: (
        ev.nested(t.events.where("event_type <> 'error'"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", F.array_distinct(F.transform("items", lambda x: x.event_type)).alias("a"))
    ),
)
q(
    "AGG12_ordered_dedup",
    """
    SELECT user_id, list(event_type ORDER BY m) AS a FROM (SELECT user_id, event_type, min((ts, event_id)) AS m FROM
    events GROUP BY ALL) GROUP BY 1
    """,
    lambda t: (
        ev.nested(t.events, ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", F.array_distinct(c("items.event_type")).alias("a"))
    ),
)
q(
    "AGG13_composite_dedup",
    """
    SELECT l_orderkey, list(kind ORDER BY first, kind) AS kinds FROM (SELECT l_orderkey, l_returnflag || ':' || l_linestatus AS kind, min(l_linenumber) AS first FROM lineitem GROUP BY ALL) GROUP BY 1
    """,
    lambda t: (
        ev.ordered_unique(t.lineitem, ["l_orderkey"], "l_linenumber", ["l_returnflag", "l_linestatus"])
        .select("l_orderkey", F.transform("items", lambda x: F.concat_ws(":", x.l_returnflag, x.l_linestatus)).alias("kinds"))
    ),
)
q(
    "AGG14_most_common",
    """
    SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type)
    AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE r <= 2
    """,
    lambda t: ru.most_common(t.events, "user_id", "event_type", 2).drop("rank"),
)
q(
    "AGG15_majority_vote",
    """
    SELECT user_id, event_type, n, k > 1 AS conflict FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY
    n DESC, event_type) AS r, count(*) OVER (PARTITION BY user_id) AS k FROM (SELECT user_id, event_type, count(*) AS
    n FROM events GROUP BY ALL)) WHERE r = 1
    """,
    lambda t: ru.votes(t.events, "user_id", "event_type"),
)
q(
    "AGG16_invert_mapping",
    "SELECT n_regionkey, list(DISTINCT n_name ORDER BY n_name) AS keys FROM nation GROUP BY 1",
    lambda t: ru.inverted(t.nation, "n_name", "n_regionkey"),
)
q(
    "AGG17_summary_examples",
    "SELECT n_regionkey, count(*) AS n_items, list(n_name ORDER BY n_name)[1:2] AS examples FROM nation GROUP BY 1",
    lambda t: ru.summary(t.nation, "n_regionkey", "n_name", 2),
)
q(
    "AGG18_threshold_counts",
    f"""
    SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (n >= k) AS n, round_even(100.0::DOUBLE * count(*) FILTER (n >=
    k) / count(*), 4) AS percent FROM {PER_USER}, (VALUES (50), (60), (70), (80)) v(k) GROUP BY v.k
    """,
    lambda t: ru.at_least(per_user(t), "n", [50, 60, 70, 80]),
)
q(
    "AGG19_population_stats",
    """
    SELECT event_type, count(value) AS n, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std, min(value)
    AS low, max(value) AS high FROM events GROUP BY 1
    """,
    lambda t: ru.describe(t.events, "value", ["event_type"]),
)
q(
    "AGG20_percentiles",
    """
    SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95)
    AS p95 FROM events GROUP BY 1
    """,
    lambda t: ru.percentiles(t.events, "value", ["event_type"], {"p50": 0.5, "p90": 0.9, "p95": 0.95}),
)
q(
    "AGG21_distribution",
    "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    lambda t: t.events.groupBy("event_type").agg(F.count("*").alias("n")),
)
q(
    "AGG22_histogram",
    "SELECT CAST(floor(value / 5) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1",
    lambda t: ru.histogram(t.events, c("value"), 5.0),
)
q(
    "AGG23_binned_mean",
    """
    SELECT CAST(CASE WHEN l_quantity < 40 THEN floor(l_quantity / 5) END AS BIGINT) AS bin, avg(l_discount) AS mean
    FROM lineitem GROUP BY 1
    """,
    lambda t: (
        t.lineitem
        .select(F.when(c("l_quantity") < 40, F.floor(c("l_quantity") / 5)).alias("bin"), "l_discount")
        .groupBy("bin")
        .agg(F.avg("l_discount").alias("mean"))
    ),
)
q(
    "AGG24_sample_std",
    """
    SELECT l_returnflag, l_linestatus, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std, count(*) AS n FROM lineitem
    GROUP BY ALL
    """,
    lambda t: (
        t.lineitem
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("std"), F.count("*").alias("n"))
    ),
)
q(
    "AGG25_grading_summary",
    """
    SELECT source, count(*) AS total, count(quality) AS valid, avg(quality) AS mean, stddev_pop(quality) AS std FROM
    documents LEFT JOIN labels USING (doc_id) GROUP BY 1
    """,
    lambda t: (
        t.documents
        .select("doc_id", "source")
        .join(t.labels, "doc_id", "left")
        .groupBy("source")
        .agg(F.count("*").alias("total"), F.count("quality").alias("valid"), F.avg("quality").alias("mean"), F.stddev_pop("quality").alias("std"))
    ),
)
q(
    "AGG26_macro_micro",
    """
    SELECT avg(a) AS macro, sum(a * n) / sum(n) AS micro FROM (SELECT user_id, avg(value) AS a, count(value) AS n FROM
    events GROUP BY 1)
    """,
    lambda t: ru.macro_micro(t.events, "user_id", "value"),
)
q(
    "AGG27_label_collapse",
    """
    SELECT CASE WHEN event_type IN ('click', 'view') THEN 'look' ELSE event_type END AS kind, count(*) AS n FROM events
    GROUP BY 1
    """,
    lambda t: (
        t.events.groupBy(F.when(c("event_type").isin("click", "view"), "look").otherwise(c("event_type")).alias("kind")).agg(F.count("*").alias("n"))
    ),
)
q(
    "AGG28_means_and_total",
    "SELECT event_type, avg(value) AS mean, count(value) AS n FROM events GROUP BY ROLLUP (event_type)",
    lambda t: ru.with_total(t.events, "event_type", "value"),
)
q(
    "AGG29_nested_counters",
    "SELECT CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events",
    lambda t: t.events.select(F.from_json("props", "k bigint").alias("u")).agg(F.sum("u.k").alias("k")),
)
q(
    "AGG30_entity_stats",
    """
    SELECT user_id, count(*) AS visits, CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM (SELECT user_id, CAST(ts
    AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1
    """,
    lambda t: (
        t.events
        .groupBy("user_id", F.to_date("ts").alias("d"))
        .agg(F.count("*").alias("n"))
        .groupBy("user_id")
        .agg(F.count("*").alias("visits"), F.sum("n").alias("total"), F.max("n").alias("most"))
    ),
)
q(
    "AGG31_stay_days",
    """
    SELECT user_id, avg(d) AS mean_days FROM (SELECT user_id, event_type, floor((epoch_us(max(ts)) - epoch_us(min(ts)))
    / 86400000000) AS d FROM events GROUP BY ALL) GROUP BY 1
    """,
    lambda t: (
        t.events
        .groupBy("user_id", "event_type")
        .agg(times.whole_days(F.min("ts"), F.max("ts")).alias("d"))
        .groupBy("user_id")
        .agg(F.avg("d").alias("mean_days"))
    ),
)
q(
    "AGG33_full_coverage",
    """
    SELECT o_custkey, count(*) AS n_total, count(*) FILTER (o_totalprice > 20000) AS n_matched FROM orders GROUP BY
    1 HAVING n_total = n_matched AND n_total >= 3
    """,
    lambda t: ev.full_coverage(t.orders, t.orders.where("o_totalprice > 20000"), "o_custkey", "o_orderkey", 3),
)
q(
    "AGG34_id_sets",
    "SELECT o_custkey AS visit, list(DISTINCT o_orderkey ORDER BY o_orderkey) AS qids FROM orders GROUP BY 1",
    lambda t: t.orders.groupBy(c("o_custkey").alias("visit")).agg(F.sort_array(F.collect_set("o_orderkey")).alias("qids")),
)

# ---- sorts and limits (the order shows in an ordinal) ------------------------------------------------------------
q(
    "SRT1_nulls_last",
    """
    SELECT doc_id, row_number() OVER (ORDER BY quality NULLS LAST, doc_id) AS pos FROM documents LEFT JOIN labels USING
    (doc_id)
    """,
    lambda t: (
        _numbered(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), [c("quality").asc_nulls_last(), c("doc_id")]).select("doc_id", "pos")
    ),
)
q(
    "SRT2_time_then_type",
    """
    SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d'), event_type,
    event_id) AS INTEGER) AS pos FROM events
    """,
    lambda t: (
        ev.with_ordinal(t.events, ["user_id"], [F.date_format("ts", "yyyy-MM-dd"), c("event_type"), c("event_id")], "pos").select("user_id", "event_id", "pos")
    ),
)
q(
    "SRT3_sentinel",
    """
    SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN
    '9999-12-31' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END, event_id) AS INTEGER) AS pos FROM events
    """,
    lambda t: (
        ev.with_ordinal(t.events, ["user_id"], [F.coalesce(F.when(c("event_type") != "error", times.time_text(c("ts"))), F.lit("9999-12-31")), c("event_id")], "pos").select("user_id", "event_id", "pos")
    ),
)
q(
    "SRT4_two_descending",
    f"SELECT user_id, n FROM {PER_USER} ORDER BY n DESC, user_id DESC",
    lambda t: per_user(t).orderBy(F.desc("n"), F.desc("user_id")),
)
q(
    "SRT5_numeric_suffix",
    """
    SELECT o_custkey, v, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY i) AS INTEGER) AS pos FROM (SELECT
    o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, 'V' || i AS v FROM orders)
    """,
    lambda t: (
        ev.with_ordinal(ev.with_ordinal(t.orders, ["o_custkey"], [c("o_orderkey")], "i").withColumn("v", F.concat(F.lit("V"), c("i").cast("string"))), ["o_custkey"], [__import__("tidelog.functions.texts", fromlist=["x"]).suffix_number(c("v"), "V")], "pos").select("o_custkey", "v", "pos")
    ),
)
q(
    "SRT6_lexicographic_drop_last",
    """
    SELECT o_custkey, v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC) AS r FROM (SELECT
    o_custkey, 'V' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM orders)) WHERE r > 1
    """,
    lambda t: (
        ev.with_ordinal(
            ev.with_ordinal(t.orders, ["o_custkey"], [c("o_orderkey")], "i").withColumn("v", F.concat(F.lit("V"), c("i").cast("string"))),
            ["o_custkey"],
            [F.desc("v")],
            "r",
        )
        .where("r > 1")
        .select("o_custkey", "v")
    ),
)
q("LIM1_head", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10", lambda t: t.customer.select("c_custkey").orderBy("c_custkey").limit(10))
q(
    "LIM2_top_k_random",
    """
    SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5('7::'
    || event_id), event_id) AS r FROM events) WHERE r <= 2
    """,
    lambda t: ev.sample_per_group(t.events, ["user_id", "event_type"], ["event_id"], 2).select("user_id", "event_id"),
)
q(
    "LIM3_top_k_score",
    "SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 25",
    lambda t: t.events.orderBy(F.desc("value"), "event_id").limit(25).select("event_id"),
)
q(
    "LIM4_prefetch_filter",
    """
    SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)
    AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE
    r <= 10 AND event_type <> 'error') WHERE r2 <= 4
    """,
    lambda t: (
        ev.top_k(ev.top_k(t.events, ["user_id"], [F.desc("value"), c("event_id")], 10, "r").where("event_type <> 'error'"), ["user_id"], [F.desc("value"), c("event_id")], 4).select("user_id", "event_id")
    ),
)
q(
    "LIM5_batches",
    """
    SELECT event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 8) AS INTEGER)
    AS batch FROM events
    """,
    lambda t: ev.batches(t.events, "user_id", [c("ts"), c("event_id")], 8).select("event_id", "batch"),
)


def _numbered(df, order):
    """A total order shown as a number."""
    return ev.running_numbers(df, order, "pos")
