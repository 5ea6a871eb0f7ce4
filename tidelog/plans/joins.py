"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, times
from ..operators import chat
from ..operators import events as ev
from ..operators import memory, vectors
from .registry import query

c = F.col


def q(name: str, sql: str, run) -> None:
    query(name, sql)(run)


q(
    "JOI1_dictionary",
    "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    lambda t: ev.dictionary_join(t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.customer, ["c_custkey"]).select("o_orderkey", "c_name"),
)
q(
    "JOI2_composite_dictionary",
    """
    SELECT l.l_orderkey, l.l_linenumber, d.n FROM lineitem l LEFT JOIN (SELECT l_returnflag, l_linestatus, count(*)
    AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL) d USING (l_returnflag, l_linestatus)
    """,
    lambda t: (
        ev.dictionary_join(t.lineitem, t.lineitem.where("l_returnflag <> 'N'").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), ["l_returnflag", "l_linestatus"]).select("l_orderkey", "l_linenumber", "n")
    ),
)
q(
    "JOI3_preaggregated",
    """
    SELECT o_orderkey, coalesce(s, 'Ordered') AS status FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT
    l_returnflag, ', ' ORDER BY l_returnflag) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
    """,
    lambda t: (
        t.orders
        .join(
                t.lineitem
                .groupBy(c("l_orderkey").alias("o_orderkey"))
                .agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ", ").alias("s")),
                "o_orderkey",
                "left",
            )
        .select("o_orderkey", F.coalesce("s", F.lit("Ordered")).alias("status"))
    ),
)
q(
    "JOI4_inner_distinct_keys",
    """
    SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'click' INTERSECT SELECT DISTINCT
    user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'purchase'
    """,
    lambda t: (
        (lambda e: e.where("event_type = 'click'").select("user_id", "day").distinct().join(e.where("event_type = 'purchase'").select("user_id", "day").distinct(), ["user_id", "day"]))(t.events.withColumn("day", F.to_date("ts")))
    ),
)
q(
    "JOI5_anti",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    lambda t: t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey"),
)
q(
    "JOI6_semi",
    "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    lambda t: t.customer.join(t.orders.where("o_orderstatus = 'P'"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey"),
)
q(
    "JOI7_full_outer_counts",
    """
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_orders, coalesce(b.n, 0) AS n_events FROM (SELECT o_custkey
    AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY
    1) b ON a.k = b.k
    """,
    lambda t: (
        t.orders
        .groupBy(c("o_custkey").alias("k"))
        .agg(F.count("*").alias("a"))
        .join(t.events.groupBy(c("user_id").alias("k")).agg(F.count("*").alias("b")), "k", "full")
        .select("k", F.coalesce("a", F.lit(0)).alias("n_orders"), F.coalesce("b", F.lit(0)).alias("n_events"))
    ),
)
q(
    "JOI8_lookup",
    "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    lambda t: t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey"), "left").select("c_custkey", "n_name"),
)
q(
    "JOI9_group_lookup",
    "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    lambda t: t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n")),
)

HORIZON = "SELECT p.event_id AS point_id, e.event_id, exp(-ln(100) / 24 * greatest((epoch_us(e.ts) - epoch_us(p.ts)) / 3.6e9, 0)) AS weight FROM events p JOIN events e ON p.user_id = e.user_id AND e.ts > p.ts AND e.ts <= p.ts + INTERVAL 24 HOUR WHERE p.event_type = 'signup'"


def points(t):
    return t.events.where("event_type = 'signup'").select("user_id", c("event_id").alias("point_id"), c("ts").alias("at"))


q(
    "JOI10_horizon_join",
    HORIZON,
    lambda t: (
        ev.decayed(ev.horizon_join(points(t), t.events, entity="user_id", at="at", ts="ts", hours=24), at="at", ts="ts").select("point_id", "event_id", "weight")
    ),
)
q(
    "JOI11_horizon_by_day",
    """
    SELECT p.event_id AS point_id, e.event_id FROM events p JOIN events e ON p.user_id = e.user_id AND CASE WHEN e.event_type
    = 'error' THEN CAST(e.ts AS DATE) BETWEEN CAST(p.ts AS DATE) AND CAST(p.ts + INTERVAL 24 HOUR AS DATE) ELSE e.ts
    > p.ts AND e.ts <= p.ts + INTERVAL 24 HOUR END WHERE p.event_type = 'signup'
    """,
    lambda t: (
        ev.horizon_join(points(t), t.events.withColumn("fuzzy", c("event_type") == "error").withColumn("ts", F.when(c("fuzzy"), F.date_trunc("day", "ts").cast("timestamp_ntz")).otherwise(c("ts"))), entity="user_id", at="at", ts="ts", hours=24, day_only="fuzzy").select("point_id", "event_id")
    ),
)
q(
    "JOI13_next_event",
    "SELECT event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event_type FROM events",
    lambda t: ev.next_event(t.events, "user_id", [c("ts"), c("event_id")], ["event_type"]).select("event_id", "next_event_type"),
)
VISITS = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders)"


def visits(t):
    return ev.with_ordinal(t.orders, ["o_custkey"], [c("o_orderdate"), c("o_orderkey")], "i")


q(
    "JOI15_terminal_window",
    """
    SELECT e.event_id FROM events e JOIN (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) m USING (user_id)
    WHERE e.ts >= m.last - INTERVAL 48 HOUR AND e.ts <= m.last - INTERVAL 30 MINUTE
    """,
    lambda t: (
        t.events
        .join(t.events.groupBy("user_id").agg(F.max("ts").alias("last")), "user_id")
        .where(times.hours_between(c("ts"), c("last")).between(0.5, 48))
        .select("event_id")
    ),
)
q(
    "JOI16_point_lookup",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42",
    lambda t: t.orders.where("o_orderkey = 42").select("o_orderkey", "o_totalprice"),
)
q(
    "JOI17_cutoff_coordinates",
    """
    SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r
    FROM events WHERE event_type = 'error') WHERE r = 1
    """,
    lambda t: (
        t.events
        .where("event_type = 'error'")
        .groupBy("user_id")
        .agg(F.min_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("x"))
        .select("user_id", "x.event_id", "x.ts")
    ),
)
q(
    "JOI18_option_lookup",
    "SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    lambda t: t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left"),
)
q(
    "JOI21_vector_join",
    """
    SELECT query_id, vec_id, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, CAST(row_number() OVER (PARTITION BY
    a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))
    DESC, b.vec_id) AS INTEGER) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
    WHERE rank <= 3
    """,
    lambda t: (
        vectors.search(t.embeddings.select("label", c("vec_id").alias("query_id"), c("embedding").alias("qv")), t.embeddings.select("label", "vec_id", c("embedding").alias("dv")), entity="label", query_id="query_id", doc_id="vec_id", k=3, other=True).select("query_id", "vec_id", "rank")
    ),
)

# ---- sets and restructuring --------------------------------------------------------------------------------------
q(
    "SET1_union_by_name",
    "SELECT n_nationkey, n_name, NULL AS r_name FROM nation UNION ALL SELECT NULL, NULL, r_name FROM region",
    lambda t: t.nation.select("n_nationkey", "n_name").unionByName(t.region.select("r_name"), allowMissingColumns=True),
)
q(
    "SET2_union_all",
    "SELECT event_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id FROM events WHERE value > 10",
    lambda t: t.events.where("event_type = 'click'").select("event_id").unionByName(t.events.where("value > 10").select("event_id")),
)
q("SET3_distinct", "SELECT DISTINCT user_id, event_type FROM events", lambda t: t.events.select("user_id", "event_type").distinct())
q(
    "SET4_except",
    "SELECT user_id FROM events EXCEPT SELECT user_id FROM events WHERE value > 40",
    lambda t: t.events.select("user_id").distinct().join(t.events.where("value > 40").select("user_id"), "user_id", "left_anti"),
)
q(
    "SET5_set_accuracy",
    "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS acc FROM nation",
    lambda t: (
        t.nation.select(
            "n_nationkey",
            scores.set_accuracy(F.array((c("n_nationkey") % 2).cast("int")), F.array(F.lit(0), F.lit(7), F.lit(7))).alias("acc"),
        )
    ),
)
q(
    "SET6_sectioned_union",
    """
    SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY s, ts, event_id) AS INTEGER) AS
    pos FROM (SELECT *, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 2 ELSE 1 END AS s FROM events)
    """,
    lambda t: (
        ev.with_ordinal(t.events, ["user_id"], [F.when(c("event_type") == "signup", 0).when(c("event_type") == "purchase", 2).otherwise(1), c("ts"), c("event_id")], "pos").select("user_id", "event_id", "pos")
    ),
)
q(
    "SET7_flatten",
    """
    SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
    l_suppkey) - 1 AS INTEGER) AS pos FROM lineitem
    """,
    lambda t: (
        ev.nested(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_partkey"])
        .select("l_orderkey", F.posexplode("items").alias("pos", "x"))
        .select("l_orderkey", "pos", "x.l_partkey")
    ),
)
q(
    "SET8_nest",
    "SELECT user_id, list(event_type ORDER BY ts, event_id) AS types FROM events GROUP BY user_id",
    lambda t: (
        ev.nested(t.events, ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", F.transform("items", lambda x: x.event_type).alias("types"))
    ),
)
q(
    "SET9_item_documents",
    """
    SELECT o_orderkey, 'order ' || o_orderkey AS text FROM orders UNION ALL SELECT l_orderkey, 'part ' || l_partkey
    FROM lineitem
    """,
    lambda t: (
        t.orders
        .select("o_orderkey", F.concat(F.lit("order "), c("o_orderkey").cast("string")).alias("text"))
        .unionByName(
                t.lineitem.select(c("l_orderkey").alias("o_orderkey"), F.concat(F.lit("part "), c("l_partkey").cast("string")).alias("text")),
            )
    ),
)
q(
    "SET10_fingerprint_dedup",
    """
    SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM
    events) WHERE r = 1
    """,
    lambda t: ev.fingerprint_dedup(t.events, ["user_id", "event_type"], "event_id").select("event_id"),
)
def scoped_delete(t):
    """Two deletes of a store; one without a scope or a filter is refused."""
    store = memory.FrameStore(t.events)
    store.delete({"user_id": 7, "agent_id": None}, {"event_type": "view"})
    store.delete({}, {"event_type": "error"})
    try:
        store.delete({"user_id": None})
    except ValueError:
        return store.items.select("event_id")
    raise AssertionError("a delete of everything must be refused")


q("SET11_scoped_delete", "SELECT event_id FROM events WHERE NOT coalesce(user_id = 7 AND event_type = 'view', false) AND event_type IS DISTINCT FROM 'error'", scoped_delete)

# ---- retrieval ---------------------------------------------------------------------------------------------------
q(
    "VEC4_lexical",
    """
    SELECT conv_id, turn, score FROM (SELECT conv_id, turn, CASE WHEN contains(lower(text), 'thing') THEN 1.0::DOUBLE
    ELSE 0.1::DOUBLE END AS score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS r FROM conversations)
    WHERE r <= 2
    """,
    lambda t: (
        vectors.lexical(t.conversations.select("conv_id").distinct().withColumn("needle", F.lit("Thing")), t.conversations, entity="conv_id", query_id="conv_id", needle="needle", text="text", position="turn", k=2).select("conv_id", "turn", "score")
    ),
)
q(
    "VEC6_retrieval_gate",
    """
    SELECT conv_id, turn, coalesce(stated, true) AS always, coalesce(stated, false) AS never, coalesce(stated, asks) AS question_only FROM (SELECT conv_id, turn,
    CASE turn % 5 WHEN 0 THEN true WHEN 1 THEN false END AS stated, regexp_matches(text, '[?？]') OR regexp_matches(lower(text), '(what|why|how|when|where|which|who)') AS asks FROM conversations)
    """,
    lambda t: (
        t.conversations
        .withColumn("stated", F.when(c("turn") % 5 == 0, " Question ").when(c("turn") % 5 == 1, "statement").when(c("turn") % 5 == 2, " "))
        .select("conv_id", "turn", *[chat.should_retrieve(c("text"), c("stated"), p).alias(p) for p in ("always", "never", "question_only")])
    ),
)
q(
    "FLT16_whitelist",
    "SELECT event_id FROM events WHERE user_id = 3 OR (user_id = 5 AND event_id % 2 = 0)",
    lambda t: (
        t.events
        .join(t.spark.createDataFrame([(3, None), (5, 0)], "user_id bigint, parity bigint"), "user_id")
        .where(c("parity").isNull() | (c("event_id") % 2 == c("parity")))
        .select("event_id")
    ),
)
