"""Windows over ordered rows, sampling, questions, calls to models, and the remaining helpers."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import jsons, nulls, texts, times
from ..operators import events as ev
from ..operators import rollups as ru
from ..operators import synthesis as sy
from .registry import query

c = F.col
ORDER = "PARTITION BY user_id ORDER BY ts, event_id"


def q(name: str, sql: str, run) -> None:
    query(name, sql)(run)


def order():
    return [c("ts"), c("event_id")]


q(
    "WIN1_visit_index",
    """
    SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER)
    AS i FROM orders
    """,
    lambda t: ev.with_ordinal(t.orders, ["o_custkey"], [c("o_orderdate"), c("o_orderkey")], "i").select("o_orderkey", "i"),
)
q(
    "WIN2_dense_ids",
    """
    SELECT printf('P%06d', row_number() OVER (ORDER BY o_custkey)) AS patient_id, o_custkey FROM (SELECT DISTINCT o_custkey
    FROM orders WHERE o_custkey IS NOT NULL)
    """,
    lambda t: ev.dense_ids(t.orders, "o_custkey").select(texts.entity_id(c("n")).alias("patient_id"), "o_custkey"),
)
q(
    "WIN3_event_ordinal",
    """
    SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S'),
    event_type, event_id) AS INTEGER) AS seq FROM events
    """,
    lambda t: (
        ev.with_ordinal(t.events.withColumn("day", F.to_date("ts")), ["user_id", "day"], [times.time_text(c("ts")), c("event_type"), c("event_id")]).select("event_id", "seq")
    ),
)
q(
    "WIN4_ordinal_by_type",
    """
    SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INTEGER) AS
    seq FROM events
    """,
    lambda t: ev.with_ordinal(t.events, ["user_id", "event_type"], order()).select("event_id", "seq"),
)
q(
    "WIN5_sequence_assembly",
    """
    SELECT o_custkey, what, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY s, d, k) AS INTEGER) AS pos FROM
    (SELECT o_custkey, 'adm' AS what, 0 AS s, min(o_orderdate) AS d, 0 AS k FROM orders GROUP BY 1 UNION ALL SELECT
    o_custkey, 'E' || o_orderkey, 1, o_orderdate, o_orderkey FROM orders UNION ALL SELECT o_custkey, 'dis', 2, max(o_orderdate),
    0 FROM orders GROUP BY 1)
    """,
    lambda t: (
        ev.with_ordinal(t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("d")).select("o_custkey", F.lit("adm").alias("what"), F.lit(0).alias("s"), "d", F.lit(0).cast("long").alias("k")).unionByName(t.orders.select("o_custkey", F.concat(F.lit("E"), c("o_orderkey").cast("string")).alias("what"), F.lit(1).alias("s"), c("o_orderdate").alias("d"), c("o_orderkey").cast("long").alias("k"))).unionByName(t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("d")).select("o_custkey", F.lit("dis").alias("what"), F.lit(2).alias("s"), "d", F.lit(0).cast("long").alias("k"))), ["o_custkey"], [c("s"), c("d"), c("k")], "pos").select("o_custkey", "what", "pos")
    ),
)
q(
    "WIN6_first_last_match",
    """
    SELECT user_id, arg_min(event_id, ts) FILTER (event_type = 'error') AS a, arg_max(event_id, ts) FILTER (event_type
    = 'error') AS z FROM events GROUP BY 1
    """,
    lambda t: (
        t.events
        .groupBy("user_id")
        .agg(
                F.min_by("event_id", F.when(c("event_type") == "error", c("ts"))).alias("a"),
                F.max_by("event_id", F.when(c("event_type") == "error", c("ts"))).alias("z"),
            )
    ),
)
q(
    "WIN7_visits_by_first_time",
    """
    SELECT user_id, d, CAST(row_number() OVER (PARTITION BY user_id ORDER BY m) AS INTEGER) AS pos FROM (SELECT user_id,
    CAST(ts AS DATE) AS d, min(ts) AS m FROM events GROUP BY ALL)
    """,
    lambda t: (
        ev.with_ordinal(t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min("ts").alias("m")), ["user_id"], [c("m")], "pos").select("user_id", "d", "pos")
    ),
)
q(
    "WIN8_sliding_window",
    f"""
    SELECT user_id, CAST(i / 2 AS INTEGER) AS \"window\", items FROM (SELECT user_id, row_number() OVER ({ORDER}) -
    1 AS i, list(event_id) OVER ({ORDER} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS items FROM events) WHERE len(items)
    = 5 AND i % 2 = 0
    """,
    lambda t: ev.sliding(t.events, "user_id", order(), c("event_id"), 5, 2),
)
q(
    "WIN9_shuffled_ranking",
    f"""
    SELECT user_id, list(event_id ORDER BY md5('7::' || event_id)) AS items, list(r ORDER BY md5('7::' || event_id))
    AS truth FROM (SELECT *, CAST(row_number() OVER ({ORDER}) - 1 AS INTEGER) AS r FROM events) GROUP BY 1
    """,
    lambda t: sy.shuffled_ranking(t.events, ["user_id"], order(), "event_id"),
)
q(
    "WIN10_gap_numbers",
    f"""
    SELECT event_id, CAST(CASE WHEN event_type = 'click' THEN coalesce(sum(CAST(event_type = 'click' AS INTEGER)) OVER
    ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS INTEGER) AS gap FROM events
    """,
    lambda t: ev.gaps_and_anchors(t.events, "user_id", order(), c("event_type") == "click").select("event_id", "gap"),
)
q(
    "WIN11_gaps_and_anchors",
    f"""
    SELECT event_id, CASE WHEN event_type = 'click' THEN 'GAP ' || CAST(coalesce(sum(CAST(event_type = 'click' AS INTEGER))
    OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) ELSE event_type END AS shown FROM
    events
    """,
    lambda t: (
        ev.gaps_and_anchors(t.events, "user_id", order(), c("event_type") == "click").select("event_id", F.coalesce(F.concat(F.lit("GAP "), c("gap").cast("string")), c("event_type")).alias("shown"))
    ),
)
q(
    "WIN12_same_time_groups",
    "SELECT o_custkey, o_orderdate, list(o_orderkey ORDER BY o_orderkey) AS keys FROM orders GROUP BY ALL",
    lambda t: t.orders.groupBy("o_custkey", "o_orderdate").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys")),
)
q(
    "WIN13_turn_segments",
    """
    SELECT conv_id, turn, CAST(sum(CAST(role = 'assistant' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS
    INTEGER) AS segment FROM conversations
    """,
    lambda t: ev.segments(t.conversations, "conv_id", [c("turn")], c("role") == "assistant").select("conv_id", "turn", "segment"),
)
def truncated(t):
    """The prefix before the first user turn, and the last two user turns with what follows them."""
    seg = ev.segments(t.conversations, "conv_id", [c("turn")], c("role") == "user")
    last = seg.groupBy("conv_id").agg(F.max("segment").alias("last"))
    return seg.join(last, "conv_id").where((c("segment") == 0) | (c("segment") > c("last") - 2)).select("conv_id", "turn")


q(
    "WIN14_truncate_turns",
    """
    SELECT conv_id, turn FROM (SELECT *, max(s) OVER (PARTITION BY conv_id) AS m FROM (SELECT conv_id, turn, sum(CAST(role
    = 'user' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations)) WHERE s = 0 OR s > m -
    2
    """,
    truncated,
)
q(
    "WIN15_last_n",
    """
    SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations
    WHERE role <> 'system') WHERE r <= 3
    """,
    lambda t: ev.top_k(t.conversations.where("role <> 'system'"), ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn"),
)
q(
    "WIN16_fifo_buffer",
    """
    SELECT conv_id, turn, list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)
    AS buffer FROM conversations
    """,
    lambda t: (
        t.conversations
        .select("conv_id", "turn", F.collect_list("turn").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, -1)).alias("b"))
        .select("conv_id", "turn", F.when(F.size("b") > 0, c("b")).alias("buffer"))
    ),
)
q(
    "WIN18_incremental_slice",
    """
    SELECT conv_id, max(turn) FILTER (asks) AS turn, list(turn ORDER BY turn) FILTER (NOT asks) AS gained FROM (SELECT conv_id, turn, role = 'user' AS asks,
    coalesce(sum(CAST(role = 'user' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM conversations)
    GROUP BY conv_id, n HAVING bool_or(asks)
    """,
    lambda t: ev.increments(t.conversations, "conv_id", ["turn"], c("role") == "user", c("turn"), "gained").withColumn("gained", F.when(F.size("gained") > 0, c("gained"))),
)
q(
    "WIN19_repair_pairs",
    f"""
    SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER ({ORDER}) AS fact
    FROM events
    """,
    lambda t: (
        t.events.select(
            "event_id",
            F.last(F.when(c("event_type") == "signup", c("event_id")), ignorenulls=True)
            .over(Window.partitionBy("user_id").orderBy(*order()).rowsBetween(Window.unboundedPreceding, 0))
            .alias("fact"),
        )
    ),
)
q(
    "WIN20_rate_window",
    """
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND
    CURRENT ROW) AS n FROM events
    """,
    lambda t: (
        t.events.select(
            "event_id",
            F.count("*").over(Window.partitionBy("user_id").orderBy(times.micros(c("ts"))).rangeBetween(-3_600_000_000, 0)).alias("n"),
        )
    ),
)
q(
    "MTH2_relative_weight",
    f"SELECT event_id, value / first_value(value) OVER ({ORDER}) AS relative FROM events",
    lambda t: ev.relative_weight(t.events, ["user_id"], order(), "value").select("event_id", "relative"),
)

# ---- sampling ----------------------------------------------------------------------------------------------------
q(
    "SMP1_k_per_visit_type",
    """
    SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5('7::' || event_id),
    event_id) AS r FROM events) WHERE r <= 2
    """,
    lambda t: ev.sample_per_group(t.events, ["user_id", "event_type"], ["event_id"], 2).select("event_id"),
)
q(
    "SMP2_decision_points",
    f"""
    SELECT user_id, event_id, CAST(row_number() OVER ({ORDER}) AS INTEGER) AS pos FROM (SELECT *, row_number() OVER
    (PARTITION BY user_id ORDER BY md5('7::' || event_id), event_id) AS r FROM events) WHERE r <= 5
    """,
    lambda t: (
        ev.with_ordinal(ev.sample_per_group(t.events, ["user_id"], ["event_id"], 5), ["user_id"], order(), "pos").select("user_id", "event_id", "pos")
    ),
)
q(
    "SMP4_balanced_pick",
    """
    SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(label <> CASE WHEN
    CAST('0x' || substr(md5('7::' || user_id), 1, 8) AS BIGINT) % 2 = 0 THEN 'No' ELSE 'Yes' END AS INTEGER), md5('7::'
    || event_id), event_id) AS r FROM (SELECT *, CASE WHEN value > 25 THEN 'Yes' ELSE 'No' END AS label FROM events))
    WHERE r = 1
    """,
    lambda t: (
        sy.balanced_pick(t.events.withColumn("label", F.when(c("value") > 25, "Yes").otherwise("No")), "user_id", "label", ["event_id"]).select("user_id", "event_id")
    ),
)
q(
    "SMP5_negative_sample",
    """
    SELECT user_id, n_name FROM (SELECT u.user_id, n_name, row_number() OVER (PARTITION BY u.user_id ORDER BY md5('7::'
    || u.user_id || '::' || n_name)) AS r FROM (SELECT DISTINCT user_id FROM events) u JOIN nation ON n_regionkey =
    u.user_id % 5 WHERE NOT contains(lower(n_name), '1')) WHERE r = 1
    """,
    lambda t: (
        ev.sample_per_group(t.events.select("user_id", (c("user_id") % 5).alias("n_regionkey")).distinct().join(t.nation, "n_regionkey").where(~texts.similar_names(c("n_name"), F.lit("1"))), ["user_id"], ["user_id", "n_name"], 1).select("user_id", "n_name")
    ),
)
q(
    "SMP6_coin",
    "SELECT event_id, CAST('0x' || substr(md5('7::' || event_id), 1, 8) AS BIGINT) % 2 AS coin FROM events",
    lambda t: t.events.select("event_id", sy.coin("7", "event_id").alias("coin")),
)

# ---- questions ---------------------------------------------------------------------------------------------------
KINDS = ("click", "error", "purchase", "signup", "view")
q(
    "QST2_weighted_options",
    """
    SELECT point_id, event_type, max(w) AS weight FROM (SELECT p.event_id AS point_id, e.event_type, exp(-ln(100) /
    24 * (epoch_us(e.ts) - epoch_us(p.ts)) / 3.6e9) AS w FROM events p JOIN events e ON p.user_id = e.user_id AND e.ts
    > p.ts AND e.ts <= p.ts + INTERVAL 24 HOUR WHERE p.event_type = 'signup') GROUP BY ALL
    """,
    lambda t: (
        sy.weighted_options(ev.decayed(ev.horizon_join(t.events.where("event_type = 'signup'").select("user_id", c("event_id").alias("point_id"), c("ts").alias("at")), t.events, entity="user_id", at="at", ts="ts", hours=24), at="at", ts="ts"), "point_id", "event_type").select("point_id", F.explode("answer").alias("event_type", "weight"))
    ),
)
q(
    "QST4_visit_questions",
    """
    SELECT user_id || '-T' || printf('%04d', i) || '-T3-N-0' AS qid, event_type AS answer FROM (SELECT user_id, i -
    1 AS i, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
    WHERE i > 1)
    """,
    lambda t: (
        ev.next_event(ev.with_ordinal(t.events, ["user_id"], order()), "user_id", order(), ["event_type"])
        .where("next_event_type IS NOT NULL")
        .select(F.format_string("%d-T%04d-T3-N-0", "user_id", "seq").alias("qid"), c("next_event_type").alias("answer"))
    ),
)
q(
    "QST6_sorting_questions",
    f"""
    SELECT user_id, \"window\", list(event_id ORDER BY md5('7::' || event_id)) AS items FROM (SELECT user_id, CAST(i
    / 5 AS INTEGER) AS \"window\", unnest(items) AS event_id FROM (SELECT user_id, row_number() OVER ({ORDER}) - 1 AS
    i, list(event_id) OVER ({ORDER} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS items FROM events) WHERE len(items)
    = 5 AND i % 5 = 0) GROUP BY ALL
    """,
    lambda t: (
        sy.shuffled_ranking(ev.sliding(t.events, "user_id", order(), c("event_id"), 5, 5).select("user_id", "window", F.posexplode("items").alias("p", "event_id")), ["user_id", "window"], [c("p")], "event_id").select("user_id", "window", "items")
    ),
)
q(
    "QST7_messages",
    "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY 1",
    lambda t: (
        sy.messages(t.conversations, "conv_id", ["turn"], "role", "text").select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit(": "), m.text)), "\n").alias("prompt"))
    ),
)

# ---- models as opaque functions ----------------------------------------------------------------------------------
q(
    "UDF1_model_calls",
    "SELECT c_custkey, '{\"answer\": \"' || substr(md5('q ' || c_name), 1, 8) || '\"}' AS reply FROM customer",
    lambda t: (
        sy.ask_model(t.customer.select("c_custkey", F.concat(F.lit("q "), c("c_name")).alias("prompt")), "c_custkey", "prompt").select("c_custkey", "reply")
    ),
)
q(
    "UDF2_rewrite",
    "SELECT c_custkey, substr(md5('rewrite ' || c_name), 1, 8) AS query FROM customer",
    lambda t: (
        sy.ask_model(t.customer.select("c_custkey", F.concat(F.lit("rewrite "), c("c_name")).alias("prompt")), "c_custkey", "prompt").select("c_custkey", jsons.parse_answer(c("reply")).getField("answer")[0].alias("query"))
    ),
)


class Failing:
    """A client that fails on every other prompt."""

    def ask(self, prompt: str) -> str:
        if int(prompt) % 2:
            raise ValueError("odd")
        return prompt


q(
    "UDF5_errors_are_rows",
    """
    SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) END AS reply, CASE WHEN n_nationkey
    % 2 = 1 THEN 'ValueError: odd' END AS error FROM nation
    """,
    lambda t: sy.ask_model(t.nation.select("n_nationkey", c("n_nationkey").cast("string").alias("prompt")), "n_nationkey", "prompt", Failing, workers=4),
)


class Shy:
    """A client that refuses every third prompt, as long as it is in its bad mood."""

    def __init__(self, bad: bool, pace: sy.Pace) -> None:
        self.bad, self.pace = bad, pace

    def ask(self, prompt: str) -> str:
        self.pace.wait()
        if self.bad and int(prompt) % 3 == 0:
            raise sy.RateLimited("429")
        return ("first " if self.bad else "second ") + prompt


@query("UDF5_concurrent_resume", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'second ' ELSE 'first ' END || c_custkey AS reply, NULL AS error FROM customer")
def concurrent_resume(t):
    """Two runs over one table of replies: the first fails for a third of the keys, the second asks only for them."""
    asked, at = t.customer.select("c_custkey", c("c_custkey").cast("string").alias("prompt")), t.scratch()
    for bad in (True, False):
        out = sy.ask_the_rest(asked, ["c_custkey"], "prompt", at, functools.partial(Shy, bad), rounds=2, workers=8, per_second=1e6, attempts=1)
    return out


# ---- remaining helpers -------------------------------------------------------------------------------------------
q(
    "AUX6_missing_list",
    "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    lambda t: ev.pending(t.documents.select("doc_id"), t.labels, ["doc_id"]).distinct(),
)
q(
    "AUX8_bucket_by_visit",
    """
    SELECT CASE WHEN event_id % 3 = 0 THEN -1 ELSE CAST(user_id AS INTEGER) END AS visit, count(*) AS n FROM events
    GROUP BY 1
    """,
    lambda t: (
        t.events
        .select(
                F.coalesce(texts.suffix_number(F.when(c("event_id") % 3 == 0, "UNK").otherwise(F.concat(F.lit("V"), c("user_id").cast("string"))), "V"), F.lit(-1)).alias("visit"),
            )
        .groupBy("visit")
        .agg(F.count("*").alias("n"))
    ),
)
q(
    "AUX9_notes_first",
    f"""
    SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'signup', ts, event_id) AS
    INTEGER) AS seq FROM events
    """,
    lambda t: ev.with_ordinal(t.events, ["user_id"], [c("event_type") != "signup", *order()]).select("event_id", "seq"),
)
q(
    "AUX16_null_safe",
    """
    SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN event_id % 100 END, -1) AS number, CASE WHEN event_id % 3 = 0 THEN event_type END AS text,
    CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) END AS at FROM events
    """,
    lambda t: (
        t.events
        .select("event_id", "event_type", "ts", F.when(c("event_id") % 4 == 0, (c("event_id") % 100).cast("string")).when(c("event_id") % 4 == 1, "x12").when(c("event_id") % 4 == 2, "").alias("n"))
        .withColumn("s", F.when(c("event_id") % 3 == 0, F.concat(F.lit(" \t"), "event_type", F.lit("\n"))).when(c("event_id") % 3 == 1, " \n "))
        .withColumn("d", F.when(c("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(c("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise("soon"))
        .select("event_id", F.coalesce(nulls.lenient(c("n"), "bigint"), F.lit(-1).cast("long")).alias("number"), F.nullif(nulls.strip(c("s")), F.lit("")).alias("text"), times.parse_time(c("d")).cast("timestamp_ntz").alias("at"))
    ),
)
q(
    "AUX17_summary_line",
    "SELECT c_custkey, c_name || '; ' || c_mktsegment AS line FROM customer",
    lambda t: (
        t.customer.select(
            "c_custkey",
            F.array_join(F.filter(F.array("c_name", F.lit(None).cast("string"), "c_mktsegment"), lambda x: x.isNotNull()), "; ").alias("line"),
        )
    ),
)
q(
    "AUX19_context_missing",
    """
    SELECT visit, qids, coalesce(n_rows, 0) AS n_rows, context FROM (SELECT o_custkey AS visit, list(DISTINCT o_orderkey ORDER BY o_orderkey) AS qids FROM orders GROUP BY 1)
    LEFT JOIN (SELECT user_id AS visit, CAST(count(*) AS INTEGER) AS n_rows, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type, chr(10) ORDER BY ts, event_id) AS context FROM events GROUP BY 1) USING (visit)
    """,
    lambda t: (
        ev.contexts(
            t.orders.select(c("o_custkey").alias("visit"), "o_orderkey"), t.events.withColumnRenamed("user_id", "visit"), visit="visit", qid="o_orderkey", order=["ts", "event_id"],
            line=F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type"),
        )
    ),
)
q(
    "AUX21_mapped_events",
    """
    SELECT event_id, CASE event_type WHEN 'click' THEN 'A' ELSE 'B' END AS kind FROM events WHERE event_type IN ('click',
    'purchase')
    """,
    lambda t: (
        t.events
        .join(t.spark.createDataFrame([("click", "A"), ("purchase", "B")], "event_type string, kind string"), "event_type")
        .select("event_id", "kind")
    ),
)
q(
    "AUX23_turn_of_event",
    """
    SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN CAST(sum(CAST(event_type = 'click' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) END AS turn FROM events
    """,
    lambda t: turn_of_event(t),
)


def turn_of_event(t):
    """Messages of a user in turns that a click begins; each event's turn is the first that holds an observation of it (errors are observed by none)."""
    turns = ev.segments(t.events, "user_id", order(), c("event_type") == "click", "turn")
    seen = turns.where("event_type <> 'error'").select("user_id", "turn", c("event_id").cast("string").alias("id"))
    first = seen.groupBy("user_id", "id").agg(F.min("turn").alias("turn"))
    return t.events.select("user_id", "event_id", c("event_id").cast("string").alias("id")).join(first, ["user_id", "id"], "left").select("user_id", "event_id", "turn")


q(
    "AUX32_note_lengths",
    "SELECT role, count(*) AS n, quantile_cont(length(text), 0.9) AS p90 FROM conversations GROUP BY 1",
    lambda t: ru.beside(t.conversations.groupBy("role").agg(F.count("*").alias("n")), ru.percentiles(t.conversations.withColumn("chars", F.length("text")), "chars", ["role"], {"p90": 0.9}), ["role"]),
)
q(
    "AUX35_message_blocks",
    "SELECT conv_id, turn, role, 'text' AS kind, text FROM conversations",
    lambda t: t.conversations.select("conv_id", "turn", "role", F.inline(F.array(F.struct(F.lit("text").alias("kind"), "text")))),
)
