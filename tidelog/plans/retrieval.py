"""Visibility, history, packing, stores and exact search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import chat
from ..operators import events as ev
from ..operators import memory, synthesis, vectors
from .registry import Tables, query

c = F.col

#: Visits are days of the month; every fifth event's is unknown (-1), every seventh's null, and every third has no time.
PLACED = """
  SELECT event_id, user_id, event_type,
    CASE WHEN event_id % 5 = 0 THEN -1 WHEN event_id % 7 = 0 THEN NULL ELSE CAST(day(ts) AS INTEGER) END AS visit,
    CASE WHEN event_id % 3 <> 0 THEN ts END AS seen_at
  FROM events
"""


def placed(t: Tables):
    visit = F.when(c("event_id") % 5 == 0, -1).when(c("event_id") % 7 == 0, None).otherwise(F.dayofmonth("ts")).cast("int")
    return t.events.select("event_id", "user_id", "event_type", visit.alias("visit"), F.when(c("event_id") % 3 != 0, c("ts")).alias("at"))


@query(
    "FLT15_visibility",
    f"""
WITH placed AS ({PLACED}), cut AS (
  SELECT user_id, visit AS cut_visit, seen_at AS cut_at FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM placed WHERE event_type = 'error'
  ) WHERE r = 3
), bound AS (
  SELECT *, CASE WHEN cut_visit >= 0 THEN cut_visit END AS cutoff,
    CASE WHEN user_id % 4 = 1 THEN 9 END AS until_visit,
    CASE WHEN user_id % 4 = 2 THEN TIMESTAMP '2024-01-20' END AS until_at
  FROM cut
)
SELECT event_id FROM placed JOIN bound USING (user_id)
WHERE CASE WHEN cut_at IS NOT NULL AND seen_at IS NOT NULL THEN seen_at < cut_at
    WHEN cutoff IS NOT NULL THEN coalesce(visit >= 0 AND visit < cutoff, false) ELSE true END
  AND (until_visit IS NULL OR coalesce(visit >= 0 AND visit < until_visit, false))
  AND (until_at IS NULL OR coalesce(seen_at <= until_at, false))
""",
)
def visibility(t: Tables):
    """Every event against its user's cutoff: the coordinates of the user's third error, some of them unknown, and two further bounds."""
    own = placed(t)
    third = ev.with_ordinal(own.where("event_type = 'error'"), ["user_id"], [c("event_id")], "r").where("r = 3")
    bound = third.select("user_id", F.when(c("visit") >= 0, c("visit")).alias("cutoff"), c("at").alias("cut_at")).withColumns(
        {"until_visit": F.when(c("user_id") % 4 == 1, 9), "until_at": F.when(c("user_id") % 4 == 2, F.lit("2024-01-20").cast("timestamp_ntz"))}
    )
    seen = ev.visible(c("visit"), c("at"), cutoff_visit=c("cutoff"), cutoff_ts=c("cut_at"), until_visit=c("until_visit"), until_ts=c("until_at"))
    return own.join(bound, "user_id").where(seen).select("event_id")


@query("FLT15_seen_so_far", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events")
def seen_so_far(t: Tables):
    return ev.seen_so_far(t.events, "user_id", "ts").select("event_id", "n")


@query("FLT17_scope_match", "SELECT event_id FROM events WHERE user_id = 7 AND event_type = 'view'")
def scope_match(t: Tables):
    """Ids that are not given don't bind."""
    return t.events.where(memory.in_scope({"user_id": 7, "event_type": "view", "props": None})).select("event_id")


@query(
    "JOI12_history_prefix",
    """
    SELECT event_id, list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS history
    FROM events
    """,
)
def history_prefix(t: Tables):
    """Every event's history, expanded from chunks of its user's events and a length."""
    own = ev.history_by_reference(t.events.select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], "event_id", size=64)
    return own.expand(own.rows, "event_id")


VISITS = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders)"


@query("JOI14_prior_visits", f"SELECT a.o_orderkey, b.o_orderkey AS prior FROM {VISITS} a JOIN {VISITS} b ON a.o_custkey = b.o_custkey AND b.i < a.i")
def prior_visits(t: Tables):
    """The pairs of every customer."""
    own = ev.with_ordinal(t.orders, ["o_custkey"], [c("o_orderdate"), c("o_orderkey")], "i").select("o_orderkey", "o_custkey", "i")
    earlier = own.select("o_custkey", c("o_orderkey").alias("prior"), c("i").alias("j"))
    return own.join(earlier, "o_custkey").where("j < i").select("o_orderkey", "prior")


@query(
    "SRC13_vector_store",
    """
SELECT label, vec_id % 2 AS kind, vec_id, CAST(len(embedding) AS INTEGER) AS dim, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last
FROM embeddings
""",
)
def vector_store(t: Tables):
    """Every entity and kind is loaded from its own folder; a second load is the first one."""
    store = vectors.Store(t.spark, t.scratch(), ["label", "kind"])
    store.save(t.embeddings.withColumn("kind", c("vec_id") % 2))
    keys = sorted((r["label"], r["kind"]) for r in t.embeddings.select("label", (c("vec_id") % 2).alias("kind")).distinct().collect())  # one row for each folder
    out = None
    for label, kind in keys:
        own = store.load(label, kind)
        if store.load(label, kind) is not own:
            raise AssertionError("a loaded store is kept")
        end = lambda i: F.element_at("embedding", i).cast("double")
        part = own.select(F.lit(label).alias("label"), F.lit(kind).cast("long").alias("kind"), "vec_id", F.size("embedding").alias("dim"), end(1).alias("first"), end(-1).alias("last"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "VEC1_index",
    """
SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(embedding[i]::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-12), 9) AS ip, embedding[i]::DOUBLE AS l2
FROM embeddings, range(1, 65) r(i)
""",
)
def vector_index(t: Tables):
    """Both kinds of index, component by component."""
    both = vectors.index(vectors.index(t.embeddings, "embedding", "ip", "a"), "embedding", "l2", "b")
    return both.select("vec_id", F.posexplode(F.arrays_zip("a", "b")).alias("i", "x")).select("vec_id", "i", F.round("x.a", 9).alias("ip"), c("x.b").alias("l2"))


@query(
    "VEC2_embed_texts",
    "SELECT conv_id, turn, CAST(i AS INTEGER) AS i, CAST('0x' || substr(md5(i || ':' || text), 1, 8) AS BIGINT) / 2147483648.0::DOUBLE - 1 AS x FROM conversations, range(8) r(i)",
)
def embed_texts(t: Tables):
    return t.conversations.select("conv_id", "turn", F.posexplode(synthesis.hash_embedding(c("text"))).alias("i", "x"))


@query(
    "VEC3_prefetch_search",
    """
SELECT query_id, vec_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r2 FROM (
    SELECT a.vec_id AS query_id, b.vec_id,
      list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS s,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS r
    FROM embeddings a JOIN embeddings b ON a.label = b.label
  ) WHERE r <= 20 AND vec_id < query_id
) WHERE r2 <= 4
""",
)
def prefetch_search(t: Tables):
    """Every vector is a query: the 20 nearest of its label, of those the four best that came before it."""
    asked = t.embeddings.select("label", c("vec_id").alias("query_id"), c("embedding").alias("qv"))
    held = t.embeddings.select("label", "vec_id", c("embedding").alias("dv"))
    found = vectors.search(asked, held, entity="label", query_id="query_id", doc_id="vec_id", k=4, visible=c("vec_id") < c("query_id"), prefetch=20)
    return found.select("query_id", "vec_id")


@query(
    "WIN17_budget_packing",
    """
WITH RECURSIVE it AS (
  SELECT conv_id, CAST(floor(turn / 2) AS BIGINT) AS visit, CAST(turn AS BIGINT) AS turn,
    '- ' || CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || ' ...[TRUNCATED]' ELSE text END AS line,
    row_number() OVER (PARTITION BY conv_id ORDER BY floor(turn / 2) DESC, role <> 'system', turn) AS k
  FROM conversations
), f AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, 0::BIGINT AS used, 0 AS groups, NULL::BIGINT AS shut, NULL::BIGINT AS last, false AS took,
    NULL::BIGINT AS visit, NULL::BIGINT AS turn, NULL::VARCHAR AS line FROM it
  UNION ALL
  SELECT conv_id, k, CASE WHEN fits THEN used + length(line) + 1 ELSE used END,
    CASE WHEN fits AND last IS DISTINCT FROM visit THEN groups + 1 ELSE groups END, CASE WHEN fits THEN shut ELSE visit END,
    CASE WHEN fits THEN visit ELSE last END, fits, visit, turn, line
  FROM (
    SELECT f.conv_id, it.k, f.used, f.groups, f.shut, f.last, it.visit, it.turn, it.line,
      f.shut IS DISTINCT FROM it.visit AND f.used + length(it.line) + 1 <= 900 AND (f.groups < 3 OR f.last = it.visit) AS fits
    FROM f JOIN it ON it.conv_id = f.conv_id AND it.k = f.k + 1
  )
)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS INTEGER) AS place, visit, turn, line FROM f WHERE took
""",
)
def packing(t: Tables):
    own = t.conversations.withColumn("visit", F.floor(c("turn") / 2).cast("bigint"))
    return ev.pack(own, "conv_id", "visit", "turn", "text", 900, item_chars=300, note=c("role") == "system", most_groups=3)


@query(
    "UDF4_provider",
    """
SELECT query_id, item FROM (
  SELECT conv_id AS query_id, turn AS item, row_number() OVER (PARTITION BY conv_id ORDER BY contains(lower(text), 'thing') DESC, turn) AS r
  FROM conversations WHERE role <> 'system' AND conv_id % 10 <> 3
) WHERE r = 1
""",
)
def provider(t: Tables):
    """Items are added in two calls, one scope is deleted, and every conversation asks within its own scope."""
    rows = t.conversations.where("role <> 'system'").select("conv_id", (c("conv_id") % 10).alias("app_id"), c("turn").alias("position"), "text", "role")
    store = memory.FrameStore(rows.where("role = 'user'"), entity="conv_id")
    store.add(rows.where("role <> 'user'"))
    store.delete({"app_id": 3})
    asked = t.conversations.select("conv_id", c("conv_id").alias("query_id"), F.lit("thing").alias("needle")).distinct()
    return store.search(asked, 1).select("query_id", c("position").alias("item"))


@query(
    "AUX12_memory_turns",
    """
WITH RECURSIVE own AS (
  SELECT conv_id, turn, role = 'user' AS asks, text, lower(split_part(text, ' ', 1)) AS needle, regexp_matches(text, '[?？]') OR turn % 4 <> 2 AS gate,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role <> 'assistant', text) AS i
  FROM conversations WHERE role <> 'system'
), f AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS items, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS reply, 0 AS n_read FROM own
  UNION ALL
  SELECT conv_id, i, list_filter(CASE WHEN asks THEN list_concat(items, [text, reply]) ELSE list_append(items, text) END, lambda x: x <> ''), turn, reply, len(found)
  FROM (
    SELECT *, CASE WHEN asks THEN '{"answer": "' || substr(md5(
      CASE WHEN len(found) > 0 THEN 'Memory:' || chr(10) || array_to_string(list_transform(found, lambda x: '- ' || x || chr(10)), '') ELSE '' END || 'User: ' || trim(text)), 1, 8) || '"}' END AS reply
    FROM (
      SELECT f.conv_id, own.i, items, own.turn, asks, text, CASE WHEN asks AND gate AND trim(text) <> ''
        THEN list_concat(list_filter(items, lambda x: contains(lower(x), needle)), list_filter(items, lambda x: NOT contains(lower(x), needle)))[1:4] ELSE [] END AS found
      FROM f JOIN own ON own.conv_id = f.conv_id AND own.i = f.i + 1
    )
  )
)
SELECT conv_id, turn, reply, CAST(n_read AS INTEGER) AS n_read FROM f WHERE reply IS NOT NULL
""",
)
def memory_turns(t: Tables):
    """Chat turns that read what earlier ones have written back, beside the facts that the assistant's rows stand for."""
    gate = chat.should_retrieve(c("text"), F.when((c("turn") % 4 == 2) & ~c("text").rlike("[?？]"), "statement"), "always")
    rows = t.conversations.where("role <> 'system'").withColumns({"kind": F.when(c("role") == "user", chat.USER).otherwise(chat.FACT), "needle": F.split("text", " ")[0], "gate": gate})
    return chat.chat(rows, entity="conv_id", turn="turn", k=4)


@query(
    "AUX20_note_items",
    """
SELECT conv_id, turn, visit, i, substr(text, i * 1050 + 1, 1200) AS chunk FROM (
  SELECT conv_id, turn, CAST(floor(turn / 2) AS BIGINT) AS visit, text, unnest(range(greatest(1, CAST(ceil((length(text) - 150) / 1050.0) AS INTEGER)))) AS i
  FROM conversations WHERE length(text) > 0
)
""",
)
def note_items(t: Tables):
    """The notes of all visits in overlapping pieces, with their visit."""
    own = t.conversations.select("conv_id", "turn", F.floor(c("turn") / 2).cast("bigint").alias("visit"), F.posexplode(texts.chunks(c("text"))).alias("i", "chunk"))
    return own.select("conv_id", "turn", "visit", c("i").cast("long").alias("i"), "chunk")


@query(
    "AUX24_context_lookup",
    "SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c JOIN (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1) k ON k.conv_id = c.conv_id AND k.turn = c.turn",
)
def context_lookup(t: Tables):
    """Contexts by (entity, visit), for a table of keys."""
    keys = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return t.conversations.join(keys, ["conv_id", "turn"], "left_semi").select("conv_id", "turn", "role", "text")


@query(
    "AUX11_store_facts",
    """
SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations WHERE role <> 'system' AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''
""",
)
def store_facts(t: Tables):
    """Two tables of facts are stored and flushed; the first write fails once and is made again."""
    failures = iter([OSError("busy")])

    def write(df, at):
        for failure in failures:
            raise failure
        df.write.mode("append").parquet(at)

    store = memory.FileStore(t.spark, t.scratch(), "conv_id bigint, turn bigint, text string", write=write)
    for role in ("user", "assistant"):
        store.store(t.conversations.where(c("role") == role).select(c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"), F.concat(F.lit("  "), "text", F.lit("\n")).alias("text")))
    store.store(t.conversations.where("role NOT IN ('user', 'assistant', 'system')").select(c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"), "text"))
    if store.flush() != 3:
        raise AssertionError("every table is written")
    return store.items()
