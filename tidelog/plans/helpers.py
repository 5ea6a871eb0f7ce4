"""Queries of the remaining helpers: scores and summaries as files, stores, lookups, memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, texts, times
from ..operators import events as ev
from ..operators import memory, synthesis
from ..sources import versions
from .registry import Tables, query

c = F.col


@query("AUX2_score_files", "SELECT event_type AS model, count(*) AS n FROM events GROUP BY 1")
def score_files(t: Tables):
    """Models are named by the folder that holds their rows."""
    t.events.select("event_id", "event_type").write.partitionBy("event_type").json(at := t.scratch())
    rows = t.spark.read.schema("event_id bigint").option("recursiveFileLookup", True).json(at)
    return rows.groupBy(F.regexp_extract(F.input_file_name(), "event_type=([^/]+)/", 1).alias("model")).agg(F.count("*").alias("n"))


@query(
    "AUX3_global_summaries",
    "SELECT event_type AS task, 'm' || user_id % 3 AS model, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS total, count(value) AS valid FROM events GROUP BY ALL",
)
def global_summaries(t: Tables):
    """A summary for each task and model in a folder of its own; the folders name them when all are read."""
    own = t.events.select("event_type", F.concat(F.lit("m"), (c("user_id") % 3).cast("string")).alias("model"), "value")
    each = own.groupBy("event_type", "model").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("total"), F.count("value").alias("valid"))
    each.withColumnRenamed("event_type", "task").write.partitionBy("task", "model").json(at := t.scratch())
    return t.spark.read.schema("mean double, std double, total bigint, valid bigint, task string, model string").json(at)


@query(
    "AUX4_first_entities",
    """
    SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id
    LIMIT 50) GROUP BY 1
    """,
)
def first_entities(t: Tables):
    first = t.events.select("user_id").distinct().orderBy("user_id").limit(50)
    return t.events.join(first, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "AUX5_nested_summary",
    """
    SELECT event_type, list(n ORDER BY user_id) AS counts FROM (SELECT event_type, user_id, count(*) AS n FROM events
    GROUP BY ALL) GROUP BY 1
    """,
)
def nested_summary(t: Tables):
    each = t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return ev.nested(each, ["event_type"], ["user_id"], ["n"]).select("event_type", F.transform("items", lambda x: x.n).alias("counts"))


@query(
    "AUX10_entity_of_qid",
    """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN printf('P%06d', o_custkey) WHEN 1 THEN 'S' || o_custkey ELSE CAST(o_orderkey AS VARCHAR) END AS entity,
    CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN o_orderstatus ELSE '{"key":' || o_orderkey || '}' END AS content FROM orders
    """,
)
def entity_of_qid(t: Tables):
    """The entity before ``-V``, else before the first dash, else the whole; contents that are no text as JSON, and nothing as an empty text."""
    visit = F.concat(texts.visit_id(texts.entity_id(c("o_custkey")), F.lit(1)), F.lit("-T0001-T3-D-0"))
    qid = F.when(c("o_orderkey") % 3 == 0, visit).when(c("o_orderkey") % 3 == 1, F.concat(F.lit("S"), c("o_custkey").cast("string"), F.lit("-x-1"))).otherwise(c("o_orderkey").cast("string"))
    content = F.when(c("o_orderkey") % 3 == 1, c("o_orderstatus").cast("variant")).when(c("o_orderkey") % 3 == 2, F.to_variant_object(F.struct(c("o_orderkey").alias("key"))))
    return t.orders.select("o_orderkey", texts.entity_of(qid).alias("entity"), texts.as_text(content).alias("content"))


@query("AUX14_paged_delete", "SELECT event_id, CAST(ceil(row_number() OVER (ORDER BY event_id) / 50.0) AS BIGINT) AS page FROM events WHERE user_id = 3 UNION ALL SELECT event_id, NULL FROM events WHERE user_id <> 3")
def paged_delete(t: Tables):
    """What a scope lists, in pages of fifty, and what is left when every page was deleted: pages that are refused go one by one."""
    listed = memory.pages(t.events.where(memory.in_scope({"user_id": 3})), ["event_id"], 50)
    at = versions.VersionedTable(t.spark, t.scratch(), "event_id bigint, user_id bigint", ["event_id"])
    at.upsert(t.events)
    memory.delete_pages(at, listed.select("event_id", "page"))
    left = at.read().select("event_id", F.lit(None).cast("long").alias("page"))
    return listed.select("event_id", "page").unionByName(left)


@query(
    "AUX18_default_reason",
    """
    SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE 'not_available' END AS
    reason FROM nation
    """,
)
def default_reason(t: Tables):
    from .sequences import Failing

    asked = synthesis.ask_model(t.nation.select("n_nationkey", c("n_nationkey").cast("string").alias("prompt")), "n_nationkey", "prompt", Failing)
    return asked.select("n_nationkey", F.coalesce("reply", F.lit("not_available")).alias("reason"))


@query(
    "AUX22_entity_store",
    """
    SELECT label, kind, doc, text, round(CAST('0x' || substr(md5('0:' || text), 1, 8) AS BIGINT) / 2147483648.0::DOUBLE - 1, 9) AS x FROM (
      SELECT conv_id % 7 AS label, 'note' AS kind, conv_id || '-' || turn || '-' || i AS doc, substr(text, i * 1050 + 1, 1200) AS text FROM (
        SELECT *, unnest(range(greatest(1, CAST(ceil((length(text) - 150) / 1050.0) AS INTEGER)))) AS i FROM conversations WHERE role = 'assistant' AND length(text) > 0)
      UNION ALL SELECT conv_id % 7, 'event', conv_id || '-' || turn, role || ': ' || text FROM conversations WHERE role <> 'assistant'
    )
    """,
)
def entity_store(t: Tables):
    """A note store and an event store for each entity, with texts and vectors. Entities that are there already are not built again: the second run finds all done."""
    own = t.conversations.withColumn("label", c("conv_id") % 7)
    name = lambda *more: F.concat_ws("-", c("conv_id").cast("string"), c("turn").cast("string"), *more)
    note = own.where("role = 'assistant'").select("label", "conv_id", "turn", F.posexplode(texts.chunks(c("text"))).alias("i", "text")).select("label", F.lit("note").alias("kind"), name(c("i").cast("string")).alias("doc"), "text")
    event = own.where("role <> 'assistant'").select("label", F.lit("event").alias("kind"), name().alias("doc"), F.concat_ws(": ", "role", "text").alias("text"))
    docs = note.unionByName(event).withColumn("vector", synthesis.hash_embedding(c("text")))
    stores = memory.EntityStores(t.spark, t.scratch(), docs.schema, "label")
    stores.build(docs.where("label < 3"))
    if stores.build(docs) != 4 or stores.build(docs) != 0:
        raise AssertionError("what is done is not built again")
    return stores.read().select("label", "kind", "doc", "text", F.round(c("vector")[0], 9).alias("x"))


@query("AUX29_keywords", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN [event_type] ELSE [] END AS keywords FROM events")
def keywords(t: Tables):
    return t.events.select("event_id", F.array_compact(F.array(F.when(c("event_id") % 2 == 0, c("event_type")), F.lit(None).cast("string"))).alias("keywords"))


@query(
    "AUX31_sort_by_parsed_time",
    """
    SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS
    INTEGER) AS pos FROM orders
    """,
)
def parsed_time(t: Tables):
    return ev.with_ordinal(t.orders, ["o_custkey"], [times.parse_time(F.date_format("o_orderdate", "yyyy-MM-dd")), c("o_orderkey")], "pos").select("o_custkey", "o_orderkey", "pos")


@query("AUX33_token_totals", "SELECT role, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def token_totals(t: Tables):
    usage = t.conversations.select("role", F.struct(F.regexp_count("text", F.lit("\\S+")).alias("tokens")).alias("usage"))
    return usage.groupBy("role").agg(F.sum("usage.tokens").alias("tokens"))