"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsons, nulls, scores, texts, times
from .registry import query


def q(name: str, sql: str, run) -> None:
    query(name, sql)(run)


c, lit = F.col, lambda x: F.lit(x)

# ---- projections -------------------------------------------------------------------------------------------------
q(
    "PRJ1_prune_existing",
    "SELECT event_id, user_id FROM events",
    lambda t: t.events.select([x for x in ("event_id", "absent", "user_id") if x in t.events.columns]),
)
q(
    "PRJ2_lenient_cast",
    """
    SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS BIGINT) AS n
    FROM events
    """,
    lambda t: (
        t.events.select(
            "event_id",
            nulls.lenient(F.when(c("event_id") % 3 == 0, "x").otherwise(F.concat(c("event_id").cast("string"), F.lit(".0"))), "bigint").alias("n"),
        )
    ),
)
q(
    "PRJ3_coerce_drop_null",
    "SELECT event_id FROM events WHERE event_id % 3 <> 0",
    lambda t: (
        t.events
        .select(nulls.lenient(F.when(c("event_id") % 3 != 0, c("event_id").cast("string")).otherwise("nan"), "bigint").alias("event_id"))
        .dropna()
    ),
)
q(
    "PRJ4_lenient_time",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) END AS t FROM events",
    lambda t: (
        t.events.select(
            "event_id",
            times.parse_time(F.when(c("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("no time"))
            .cast("timestamp_ntz")
            .alias("t"),
        )
    ),
)
q(
    "PRJ5_multi_format_time",
    """
    SELECT event_id, CASE event_id % 3 WHEN 2 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS t FROM
    events
    """,
    lambda t: (
        t.events.select(
            "event_id",
            times.parse_time(
                F.when(c("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
                .when(c("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
                .otherwise(F.date_format("ts", "yyyy-MM-dd")),
            )
            .cast("timestamp_ntz")
            .alias("t"),
        )
    ),
)
q(
    "PRJ6_fallback_time",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN date_trunc('day', ts) ELSE ts END AS t FROM events",
    lambda t: t.events.select("event_id", F.coalesce(F.when(c("event_type") != "error", c("ts")), F.to_date("ts").cast("timestamp_ntz")).alias("t")),
)
q(
    "PRJ7_day_to_midnight",
    "SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS t FROM orders",
    lambda t: t.orders.select("o_orderkey", F.to_date("o_orderdate").cast("timestamp_ntz").alias("t")),
)
q(
    "PRJ8_common_schema",
    """
    SELECT s_suppkey AS id, s_name AS name, NULL AS segment, 1 AS is_supplier FROM supplier UNION ALL SELECT c_custkey,
    c_name, c_mktsegment, 0 FROM customer
    """,
    lambda t: (
        t.supplier
        .select(c("s_suppkey").alias("id"), c("s_name").alias("name"), F.lit(None).cast("string").alias("segment"), F.lit(1).alias("is_supplier"))
        .unionByName(
                t.customer.select(
                    c("c_custkey").alias("id"),
                    c("c_name").alias("name"),
                    c("c_mktsegment").alias("segment"),
                    F.lit(0).alias("is_supplier"),
                ),
            )
    ),
)
q(
    "PRJ9_fill_null",
    "SELECT d.doc_id, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
    lambda t: t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(0)).alias("toxic")),
)
q(
    "PRJ10_nan_to_null",
    "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS v FROM events",
    lambda t: t.events.select("event_id", nulls.nan_to_null(F.when(c("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(c("value"))).alias("v")),
)
q(
    "PRJ11_time_text",
    """
    SELECT event_id, CASE WHEN event_type = 'signup' THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S')
    END AS t FROM events
    """,
    lambda t: t.events.select("event_id", times.time_text(c("ts"), c("event_type") == "signup").alias("t")),
)
q(
    "PRJ12_dose_text",
    """
    SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN trim(CAST(p_size AS VARCHAR) || CASE WHEN p_size % 2 = 0 THEN ' mg'
    ELSE '' END) END AS dose FROM part
    """,
    lambda t: t.part.select("p_partkey", texts.amount(F.when(c("p_size") % 5 != 0, c("p_size")), F.when(c("p_size") % 2 == 0, "mg")).alias("dose")),
)
q(
    "PRJ13_drop_keys",
    "SELECT n_nationkey, to_json({name: n_name}) AS j FROM nation",
    lambda t: (
        t.nation.select(
            "n_nationkey",
            F.to_json(F.map_filter(F.create_map(F.lit("name"), c("n_name"), F.lit("charttime"), F.lit("x")), lambda k, v: ~k.isin("charttime", "hadm_id"))).alias("j"),
        )
    ),
)
q(
    "PRJ14_placeholder",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer",
    lambda t: (
        t.customer.select(
            "c_custkey",
            nulls.placeholder_to_null(F.when(c("c_custkey") % 3 == 0, " ___\t").otherwise(F.concat(F.lit("\t"), c("c_name"), F.lit(" \n")))).alias("name"),
        )
    ),
)
q(
    "PRJ15_placeholder_nested",
    """
    SELECT o_custkey, kind, CASE kind WHEN 'variant' THEN '{"a":{"m":{"x":null,"y":[null,"ok",[null,1,{"z":null}]]},"n":null},"key":' || o_custkey || ',"orders":[' || orders || ']}'
      ELSE '{"key":' || o_custkey || ',"orders":[' || orders || ']}' END AS doc
    FROM (SELECT o_custkey, string_agg('{"key":' || o_orderkey || ',"note":{"by":' || CASE WHEN o_orderkey % 2 = 0 THEN '"clerk"' ELSE 'null' END || '},"status":' ||
    CASE o_orderstatus WHEN 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}', ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1), (VALUES ('variant'), ('typed')) AS k(kind)
    """,
    lambda t: cleaned_documents(t),
)


def cleaned_documents(t):
    """Whole documents of three and more levels, cleaned as a variant by its values and as a column by its schema."""
    note = F.struct(F.when(c("o_orderkey") % 2 == 0, "clerk").otherwise(" __ ").alias("by"))
    order = F.struct(c("o_orderkey").alias("key"), note.alias("note"), F.when(c("o_orderstatus") == "P", "___").otherwise(c("o_orderstatus")).alias("status"))
    docs = t.orders.groupBy("o_custkey").agg(F.struct(F.first("o_custkey").alias("key"), F.sort_array(F.collect_list(order)).alias("orders")).alias("typed"))
    dirty = F.concat(F.lit('{"a": {"m": {"x": "__", "y": [" ", "ok", ["_", 1, {"z": ""}]]}, "n": null}, '), F.substring(F.to_json("typed"), F.lit(2), F.lit(10_000_000)))
    both = docs.withColumn("variant", F.parse_json(dirty))
    shown = lambda kind: F.to_json(nulls.without_placeholders(c(kind), both.schema[kind].dataType), {"ignoreNullFields": "false"} if kind == "typed" else None)
    return both.select("o_custkey", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), shown(k).alias("doc")) for k in ("variant", "typed")])).alias("x")).select("o_custkey", "x.*")


q(
    "PRJ16_force_schema",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, NULL AS absent FROM events",
    lambda t: t.events.select("event_id", F.from_json("props", "k int, absent string").alias("p")).select("event_id", "p.k", "p.absent"),
)
q(
    "PRJ17_map_lines",
    "SELECT c_custkey, 'name: ' || c_name || chr(10) || 'segment: ' || c_mktsegment AS t FROM customer",
    lambda t: (
        t.customer.select(
            "c_custkey",
            texts.map_lines(F.create_map(F.lit("name"), c("c_name"), F.lit("blank"), F.lit(" \t"), F.lit("segment"), c("c_mktsegment"))).alias("t"),
        )
    ),
)
q(
    "PRJ18_flag",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'warning' END AS flag FROM lineitem",
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.when(c("l_linenumber").cast("string") == "1", "warning").alias("flag")),
)
q(
    "PRJ19_type_map",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'ACT' WHEN 'purchase' THEN 'BUY' END AS action FROM events",
    lambda t: (
        t.events.select("event_id", F.create_map(F.lit("click"), F.lit("ACT"), F.lit("purchase"), F.lit("BUY"))[c("event_type")].alias("action"))
    ),
)
q(
    "PRJ20_defaults",
    """
    SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'GOOD' END, 'UNKNOWN') AS q, CAST(coalesce(l.toxic, 0) AS
    INTEGER) AS age FROM documents d LEFT JOIN labels l USING (doc_id)
    """,
    lambda t: (
        t.documents
        .select("doc_id")
        .join(t.labels, "doc_id", "left")
        .select(
                "doc_id",
                F.coalesce(F.when(c("quality") == 1, "GOOD"), F.lit("UNKNOWN")).alias("q"),
                F.coalesce("toxic", F.lit(0)).cast("int").alias("age"),
            )
    ),
)

# ---- filters -----------------------------------------------------------------------------------------------------
q(
    "FLT1_warning_in",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1",
    lambda t: t.lineitem.where(F.trim(F.concat(F.lit(" "), c("l_linenumber").cast("string"))).isin("1", "1.0")).select("l_orderkey", "l_linenumber"),
)
q(
    "FLT2_folded_equal",
    "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'",
    lambda t: t.customer.where(F.lower(F.trim("c_mktsegment")) == "building").select("c_custkey"),
)
q(
    "FLT3_cohort_semi",
    "SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    lambda t: t.events.join(t.customer.where("c_acctbal > 5000").select(c("c_custkey").alias("user_id")), "user_id", "left_semi").select("event_id"),
)
q(
    "FLT4_status_and_cohort",
    """
    SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE
    c_nationkey = 3)
    """,
    lambda t: (
        t.orders
        .where("o_orderstatus <> 'P'")
        .join(t.customer.where("c_nationkey = 3"), c("o_custkey") == c("c_custkey"), "left_semi")
        .select("o_orderkey")
    ),
)
q(
    "FLT5_not_marker",
    "SELECT event_id FROM events WHERE event_id % 4 = 3",
    lambda t: (
        t.events
        .where(
                ~F.element_at(F.array(F.lit(""), F.lit("nan"), F.lit("None"), F.lit("x")), (c("event_id") % 4 + 1).cast("int")).isin(*nulls.CSV_NULLS),
            )
        .select("event_id")
    ),
)
q(
    "FLT6_filled",
    "SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) > 0",
    lambda t: t.documents.where(c("text").isNotNull() & (F.length("text") > 0)).select("doc_id"),
)
q("FLT7_time_known", "SELECT event_id FROM events WHERE ts IS NOT NULL", lambda t: t.events.where("ts IS NOT NULL").select("event_id"))
q(
    "FLT8_token_exclusion",
    "SELECT event_id FROM events WHERE upper(event_type) NOT IN ('ERROR', 'SIGNUP')",
    lambda t: t.events.where(~F.upper(F.trim("event_type")).isin("ERROR", "SIGNUP")).select("event_id"),
)
q(
    "FLT9_valid_text",
    """
    SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 5 AND upper(text) NOT
    IN ('N/A', 'NONE', 'NULL', 'UNKNOWN')
    """,
    lambda t: t.documents.where(nulls.valid_text(c("text"))).select("doc_id"),
)
q(
    "FLT10_precise_time",
    "SELECT event_id FROM events WHERE event_type <> 'signup'",
    lambda t: t.events.where(times.precise(times.time_text(c("ts"), c("event_type") == "signup"))).select("event_id"),
)
q(
    "FLT11_target_events",
    "SELECT event_id, event_type IN ('click', 'view') AND value > 5 AS target FROM events",
    lambda t: t.events.select("event_id", (c("event_type").isin("click", "view") & (c("value") > 5)).alias("target")),
)
q(
    "FLT12_skip_visit_zero",
    "SELECT event_id FROM events WHERE user_id <> 0",
    lambda t: (
        t.events.withColumn("v", F.concat(F.lit("V"), c("user_id").cast("string"))).where(c("v").isNotNull() & (c("v") != "V0")).select("event_id")
    ),
)
q(
    "FLT13_having_at_least",
    "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 60",
    lambda t: t.events.groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 60"),
)
q(
    "FLT14_from_visit",
    """
    SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
    AS i FROM orders) WHERE i >= 3
    """,
    lambda t: (
        __import__("tidelog.operators.events", fromlist=["x"])
        .with_ordinal(t.orders, ["o_custkey"], [c("o_orderdate"), c("o_orderkey")])
        .where("seq >= 3")
        .select("o_custkey", "o_orderkey")
    ),
)
q(
    "FLT18_is_question",
    """
    SELECT conv_id, turn, regexp_matches(text, '[?？]') OR regexp_matches(lower(text), '(what|when|which|who|how|why|where)')
    AS asks FROM conversations
    """,
    lambda t: t.conversations.select("conv_id", "turn", texts.is_question(c("text")).alias("asks")),
)

# ---- strings -----------------------------------------------------------------------------------------------------
q(
    "STR1_squeeze",
    "SELECT doc_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM documents",
    lambda t: t.documents.select("doc_id", texts.squeeze(c("text")).alias("t")),
)
q(
    "STR2_strip",
    "SELECT c_custkey, c_name AS t FROM customer",
    lambda t: t.customer.select("c_custkey", nulls.strip(F.concat(F.lit("\t "), c("c_name"), F.lit("\n"))).alias("t")),
)
q(
    "STR3_unit",
    "SELECT p_partkey, replace(p_name, ' ', '') || '/l' AS u FROM part",
    lambda t: t.part.select("p_partkey", texts.unit(F.concat(c("p_name"), F.lit(" / l"))).alias("u")),
)
q(
    "STR4_title",
    """
    SELECT p_partkey, array_to_string(list_transform(str_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])),
    '-') AS t FROM part
    """,
    lambda t: t.part.select("p_partkey", texts.title(F.replace(c("p_name"), F.lit(" "), F.lit("-"))).alias("t")),
)
q(
    "STR5_indicator_key",
    """
    SELECT p_partkey, p_name || '||' || upper(p_type[1]) || lower(p_type[2:]) || '||' || CASE WHEN p_size % 2 = 0 THEN
    'mg/dl' ELSE 'NA' END AS k FROM part
    """,
    lambda t: (
        t.part.select(
            "p_partkey",
            texts.indicator_key(c("p_name"), F.lower("p_type"), F.when(c("p_size") % 2 == 0, "mg / dl").otherwise("")).alias("k"),
        )
    ),
)
q(
    "STR6_fold",
    "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS f FROM customer",
    lambda t: t.customer.select("c_custkey", texts.fold(c("c_name")).alias("f")),
)
q(
    "STR7_similar_name",
    "SELECT p_partkey, contains(lower(p_name), 'ring') AS s FROM part",
    lambda t: t.part.select("p_partkey", texts.similar_names(c("p_name"), F.lit("Ring!")).alias("s")),
)
q(
    "STR8_sections",
    "SELECT c_custkey, c_name AS history, c_mktsegment AS plan FROM customer",
    lambda t: (
        t.customer
        .select(
                "c_custkey",
                texts.sections(F.concat(F.lit("intro HISTORY: "), c("c_name"), F.lit("\nPlan:\n"), c("c_mktsegment")), ["History", "Findings", "Plan"]).alias("m"),
            )
        .select("c_custkey", c("m")["History"].alias("history"), c("m")["Plan"].alias("plan"))
    ),
)
q(
    "STR9_after_marker",
    "SELECT c_custkey, '0' || substr(c_name, 11) AS t FROM customer",
    lambda t: t.customer.select("c_custkey", F.regexp_extract("c_name", "(?is)customer#(.*)", 1).alias("t")),
)
q(
    "STR10_chunks",
    """
    SELECT doc_id, unnest(range(greatest(1, CAST(ceil((length(text) - 150) / 1050.0) AS INTEGER)))) AS i, substr(text,
    CAST(i * 1050 + 1 AS INTEGER), 1200) AS t FROM documents WHERE length(text) > 0
    """,
    lambda t: t.documents.select("doc_id", F.posexplode(texts.chunks(c("text"))).alias("i", "t")),
)
q(
    "STR11_shorten",
    "SELECT doc_id, CASE WHEN length(text) > 20 THEN substr(text, 1, 20) || '...' ELSE text END AS t FROM documents",
    lambda t: t.documents.select("doc_id", texts.shorten(c("text"), 20).alias("t")),
)
q(
    "STR12_visit_of_text",
    "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'V' || n_nationkey ELSE 'UNK' END AS v FROM nation",
    lambda t: (
        t.nation.select(
            "n_nationkey",
            F.coalesce(F.nullif(F.upper(F.regexp_extract(F.when(c("n_nationkey") % 2 == 0, F.concat(F.lit("seen visit=v"), c("n_nationkey").cast("string"), F.lit(" then"))).otherwise("none"), "(?i)visit=(v\\d+)", 1)), F.lit("")), F.lit("UNK")).alias("v"),
        )
    ),
)
q(
    "STR13_parse_qid",
    """
    SELECT o_orderkey, printf('P%06d', o_custkey) AS entity, 2 AS visit, CAST(o_orderkey % 100 AS INTEGER) AS t, 'T3-N'
    AS kind, 1 AS i FROM orders
    """,
    lambda t: (
        t.orders
        .select(
                "o_orderkey",
                texts.parse_qid(F.concat(texts.visit_id(texts.entity_id(c("o_custkey")), F.lit(2)), F.format_string("-T%04d-T3-N-1", c("o_orderkey") % 100))).alias("x"),
            )
        .select("o_orderkey", "x.*")
    ),
)
q(
    "STR14_event_ordinal",
    """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN event_id ELSE 1000000000 END AS o FROM
    events
    """,
    lambda t: (
        t.events.select(
            "event_id",
            texts.event_ordinal(
                F.concat(
                    F.lit("P1"),
                    F.when(c("event_id") % 4 == 0, "-V0")
                    .when(c("event_id") % 4 == 1, "-V1-adm")
                    .when(c("event_id") % 4 == 2, F.concat(F.lit("-V1-E"), c("event_id").cast("string")))
                    .otherwise("-V1-dis"),
                ),
            )
            .cast("long")
            .alias("o"),
        )
    ),
)
q(
    "STR15_template",
    "SELECT event_id, 'user ' || user_id || ' did ' || event_type AS t FROM events",
    lambda t: t.events.select("event_id", texts.template("user %d did %s", c("user_id"), c("event_type")).alias("t")),
)
q(
    "STR16_lines",
    "SELECT r_regionkey, '0. ' || r_name || chr(10) || '1. end' AS t FROM region",
    lambda t: t.region.select("r_regionkey", texts.lines(F.array(c("r_name"), F.lit("end"))).alias("t")),
)
q(
    "STR17_lengths",
    "SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '\\S+')) AS tokens FROM documents",
    lambda t: t.documents.select("doc_id", F.length("text").alias("chars"), F.regexp_count("text", F.lit("\\S+")).alias("tokens")),
)
q(
    "STR18_contains_folded",
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'thing')",
    lambda t: t.documents.where(F.contains(F.lower("text"), F.lit("thing"))).select("doc_id"),
)
q(
    "STR19_flatten",
    "SELECT doc_id, trim(replace(text, chr(10), ' ')) AS t FROM documents",
    lambda t: t.documents.select("doc_id", F.trim(F.replace("text", F.lit("\n"), F.lit(" "))).alias("t")),
)

# ---- times -------------------------------------------------------------------------------------------------------
q(
    "DTM1_parse",
    "SELECT o_orderkey, o_orderdate AS t FROM orders",
    lambda t: t.orders.select("o_orderkey", times.parse_time(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("timestamp_ntz").alias("t")),
)
q(
    "DTM2_parse_or_null",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS t FROM orders",
    lambda t: (
        t.orders.select(
            "o_orderkey",
            times.parse_time(F.when(c("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("31/12"))
            .cast("timestamp_ntz")
            .alias("t"),
        )
    ),
)
q(
    "DTM3_hours_between",
    "SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS h FROM events",
    lambda t: t.events.select("event_id", times.hours_between(F.lit("2024-01-01 00:00:00").cast("timestamp"), c("ts")).alias("h")),
)
q(
    "DTM4_plus_hours",
    "SELECT event_id, ts + INTERVAL 90 MINUTE AS t FROM events",
    lambda t: t.events.select("event_id", times.plus_hours(c("ts"), 1.5).cast("timestamp_ntz").alias("t")),
)
q(
    "DTM5_day_compare",
    "SELECT event_id, CAST(ts AS DATE) < DATE '2024-01-15' AS early FROM events",
    lambda t: t.events.select("event_id", (F.to_date("ts") < F.lit("2024-01-15").cast("date")).alias("early")),
)
q(
    "DTM6_whole_days",
    """
    SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000) AS BIGINT) AS d FROM
    events
    """,
    lambda t: t.events.select("event_id", times.whole_days(F.lit("2024-01-01 00:00:00").cast("timestamp"), c("ts")).alias("d")),
)
q(
    "DTM7_text_compare",
    "SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%d %H:%M:%S') <= '2024-01-10'",
    lambda t: t.events.where(times.time_text(c("ts")) <= "2024-01-10").select("event_id"),
)

# ---- scores ------------------------------------------------------------------------------------------------------
q(
    "MTH1_decay",
    """
    SELECT event_id, exp(-ln(100) / 24 * greatest((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-02')) / 3.6e9, 0)) AS
    w FROM events
    """,
    lambda t: t.events.select("event_id", scores.decay(times.hours_between(F.lit("2024-01-02 00:00:00").cast("timestamp"), c("ts"))).alias("w")),
)
q(
    "MTH3_uniform_weight",
    """
    SELECT user_id, event_type, 1.0 / count(*) OVER (PARTITION BY user_id) AS w FROM (SELECT DISTINCT user_id, event_type
    FROM events)
    """,
    lambda t: (
        t.events
        .groupBy("user_id")
        .agg(F.collect_set("event_type").alias("a"))
        .select("user_id", F.explode(F.map_from_arrays("a", F.transform("a", lambda x: F.lit(1.0) / F.size("a")))).alias("event_type", "w"))
    ),
)
q(
    "MTH4_weighted_accuracy",
    """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0.75::DOUBLE WHEN 'O' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
    AS acc FROM orders
    """,
    lambda t: (
        t.orders.select(
            "o_orderkey",
            scores.weighted_accuracy(F.array(F.concat(F.lit("<"), c("o_orderstatus"), F.lit(">"))), F.create_map(F.lit("f"), F.lit(0.75), F.lit("o"), F.lit(0.25))).alias("acc"),
        )
    ),
)
q(
    "MTH7_sample_size",
    "SELECT user_id, least(count(*), greatest(CAST(floor(count(*) * 0.1) AS BIGINT), 3)) AS n FROM events GROUP BY user_id",
    lambda t: t.events.groupBy("user_id").agg(F.count("*").alias("k")).select("user_id", scores.sample_size(c("k"), 0.1, 3).alias("n")),
)
q(
    "MTH8_horizon_label",
    """
    SELECT event_id, CASE WHEN (epoch_us(TIMESTAMP '2024-01-15') - epoch_us(ts)) / 3.6e9 <= 24 THEN 'Yes' ELSE 'No'
    END AS label FROM events
    """,
    lambda t: (
        t.events.select(
            "event_id",
            F.when(times.hours_between(c("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp")) <= 24, "Yes").otherwise("No").alias("label"),
        )
    ),
)

# ---- arrays and maps ---------------------------------------------------------------------------------------------
BASKET = "SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem GROUP BY l_orderkey"


def basket(t):
    s = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    return t.lineitem.groupBy("l_orderkey").agg(F.transform(s, lambda x: x.l_partkey).alias("a"))


q("ARR1_first_n", f"SELECT l_orderkey, a[1:2] AS a FROM ({BASKET})", lambda t: basket(t).select("l_orderkey", F.slice("a", 1, 2).alias("a")))
q(
    "ARR2_project_items",
    f"SELECT l_orderkey, list_transform(a, lambda x: x * 2) AS a FROM ({BASKET})",
    lambda t: basket(t).select("l_orderkey", F.transform("a", lambda x: x * 2).alias("a")),
)
q(
    "ARR3_filter_items",
    f"SELECT l_orderkey, list_filter(a, lambda x: x % 2 = 0) AS a FROM ({BASKET})",
    lambda t: basket(t).select("l_orderkey", F.filter("a", lambda x: x % 2 == 0).alias("a")),
)
q(
    "ARR4_normal_list",
    "SELECT n_nationkey, [n_name] AS a FROM nation",
    lambda t: (
        t.nation.select(
            "n_nationkey",
            F.filter(F.transform(F.array(F.concat(F.lit(" "), c("n_name")), F.lit("  ")), lambda x: F.trim(x)), lambda x: x != "").alias("a"),
        )
    ),
)
q(
    "ARR5_candidates",
    f"SELECT l_orderkey, list_filter(a, lambda x, i: x <> a[1] AND list_position(a, x) = i)[1:3] AS a FROM ({BASKET})",
    lambda t: basket(t).select("l_orderkey", F.slice(F.array_distinct(F.array_except("a", F.slice("a", 1, 1))), 1, 3).alias("a")),
)
q(
    "ARR6_backfill",
    "SELECT n_nationkey, [n_name, 'Unrelated 1', 'Unrelated 2'] AS a FROM nation",
    lambda t: (
        t.nation.select(
            "n_nationkey",
            F.concat(F.array("n_name"), F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.concat(F.lit("Unrelated "), i.cast("string")))).alias("a"),
        )
    ),
)
q(
    "ARR7_keyed_shuffle",
    "SELECT o_custkey, list(o_orderkey ORDER BY md5('s::' || o_orderkey)) AS a FROM orders GROUP BY o_custkey",
    lambda t: (
        t.orders
        .groupBy("o_custkey")
        .agg(
                F.transform(F.sort_array(F.collect_list(F.struct(F.md5(F.concat(F.lit("s::"), c("o_orderkey").cast("string"))).alias("h"), "o_orderkey"))), lambda x: x.o_orderkey).alias("a"),
            )
    ),
)
q(
    "MAP1_weight_map",
    "SELECT user_id, event_type, max(value) AS high, max_by(value, ts) AS last FROM events GROUP BY ALL",
    lambda t: t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("high"), F.max_by("value", "ts").alias("last")),
)
q(
    "MAP2_apply_or_same",
    "SELECT event_id, CASE event_type WHEN 'view' THEN 'click' ELSE event_type END AS kind FROM events",
    lambda t: t.events.select("event_id", F.coalesce(F.create_map(F.lit("view"), F.lit("click"))[c("event_type")], c("event_type")).alias("kind")),
)
q(
    "MAP3_reverse",
    "SELECT r_name AS k, r_regionkey AS v FROM region",
    lambda t: (
        t.region
        .select(F.create_map("r_regionkey", "r_name").alias("m"))
        .select(F.explode(F.map_from_arrays(F.map_values("m"), F.map_keys("m"))).alias("k", "v"))
    ),
)
q(
    "MAP4_key_fallback",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'UNKNOWN' END AS kind FROM events",
    lambda t: (
        t.events.select(
            "event_id",
            F.coalesce(F.when(c("event_id") % 3 == 0, "a"), F.when(c("event_id") % 3 == 1, "b"), F.lit("UNKNOWN")).alias("kind"),
        )
    ),
)

# ---- JSON --------------------------------------------------------------------------------------------------------
wrapped = lambda: F.when(c("event_id") % 2 == 0, F.concat(F.lit("so:\n```json\n"), c("props"), F.lit("\n``` done"))).otherwise(F.concat(F.lit("so "), c("props"), F.lit(" done")))
q("JSN1_candidate", "SELECT event_id, props AS j FROM events", lambda t: t.events.select("event_id", jsons.json_candidate(wrapped()).alias("j")))
q(
    "JSN2_answer",
    "SELECT event_id, [event_type] AS answer, CASE WHEN event_id % 2 = 0 THEN 'r' END AS reason FROM events",
    lambda t: (
        t.events
        .select(
                "event_id",
                jsons.parse_answer(F.when(c("event_id") % 2 == 0, F.concat(F.lit('```json\n{"answer": ["'), c("event_type"), F.lit('"], "reason": "r"}\n```'))).otherwise(F.concat(c("event_type"), F.lit("\n")))).alias("x"),
            )
        .select("event_id", "x.*")
    ),
)
q(
    "JSN3_ranking",
    "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN [3, 1, 2] END AS a FROM events",
    lambda t: (
        t.events.select(
            "event_id",
            jsons.parse_ranking(F.when(c("event_id") % 3 == 0, "[3, 1, 2]").when(c("event_id") % 3 == 1, "I say [3,1,2] or [1]").otherwise("none")).alias("a"),
        )
    ),
)
q(
    "JSN4_to_json",
    "SELECT n_nationkey, to_json({n_name: n_name, n_regionkey: n_regionkey}) AS j FROM nation",
    lambda t: t.nation.select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("j")),
)
q(
    "JSN5_reply_list",
    "SELECT n_nationkey, [n_name] AS a FROM nation",
    lambda t: t.nation.select("n_nationkey", jsons.parse_answer(F.concat(F.lit('["'), c("n_name"), F.lit('"]'))).getField("answer").alias("a")),
)
q(
    "JSN6_grading_status",
    """
    SELECT CASE event_id % 4 WHEN 0 THEN 'VALID' WHEN 1 THEN 'PARSE_FAIL' WHEN 2 THEN 'LENGTH_MISMATCH' ELSE 'MISSING_DATA'
    END AS status, count(*) AS n FROM events GROUP BY 1
    """,
    lambda t: (
        t.events
        .select(
                jsons.grading_status(F.when(c("event_id") % 4 == 0, "[2, 1]").when(c("event_id") % 4 == 1, "ERROR").when(c("event_id") % 4 == 2, "[1]"), F.array(F.lit(1), F.lit(2))).alias("status"),
            )
        .groupBy("status")
        .agg(F.count("*").alias("n"))
    ),
)
q(
    "JSN7_roles",
    "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role FROM conversations",
    lambda t: (
        t.conversations.select("conv_id", "turn", jsons.role(F.when(c("role") == "system", "narrator").otherwise(F.upper("role"))).alias("role"))
    ),
)
