"""Questions in full, rankings, samples and the panel mapping."""

from __future__ import annotations

import functools
import hashlib
import json

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import events as ev
from ..operators import rollups as ru
from ..operators import synthesis as sy
from .registry import Tables, query

c = F.col
KINDS = ("click", "error", "purchase", "signup", "view")
ORDER = "PARTITION BY user_id ORDER BY ts, event_id"


def order():
    return [c("ts"), c("event_id")]


@query(
    "QST1_next_action",
    f"""
WITH a AS (
  SELECT event_id, user_id, lead(event_type) OVER ({ORDER}) AS answer FROM events
), r AS (
  SELECT event_id, user_id, answer, x, md5('7::' || event_id || '::' || x) AS h
  FROM a, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS x) WHERE answer IS NOT NULL
), s AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY h) AS i FROM r WHERE x <> answer
), o AS (
  SELECT event_id, user_id, answer, x, h FROM s WHERE i <= 2 UNION ALL SELECT event_id, user_id, answer, x, h FROM r WHERE x = answer
)
SELECT event_id, user_id, answer, list(x ORDER BY md5('o::' || h)) AS options FROM o GROUP BY ALL
""",
)
def next_action(t: Tables):
    return sy.next_action_questions(t.events, entity="user_id", event_id="event_id", ts="ts", kind="event_type", kinds=KINDS, k=3)


POOL = ("click 0", "error 1", "purchase 2", "sign", "view 9", "scan 9")


@query(
    "QST2_parameter_questions",
    """
WITH j AS (
  SELECT p.event_id AS point_id, ['labs', 'imaging', 'micro', 'medication', 'procedure'][p.event_id % 5 + 1] AS kind, e.event_type || ' ' || (e.event_id % 4) AS option,
    e.ts, exp(-ln(100) / 24 * (epoch_us(e.ts) - epoch_us(p.ts)) / 3.6e9) AS w
  FROM events p JOIN events e ON p.user_id = e.user_id AND e.ts > p.ts AND e.ts <= p.ts + INTERVAL 24 HOUR WHERE p.event_type = 'signup'
), f AS (
  SELECT *, min(ts) OVER (PARTITION BY point_id) AS t0, max(w) OVER (PARTITION BY point_id) AS w0 FROM j
), g AS (
  SELECT point_id, kind, option, max(w / w0) AS weight FROM f WHERE kind <> 'labs' OR ts = t0 GROUP BY ALL
), h AS (
  SELECT *, least(count(*) OVER (PARTITION BY point_id), 4) AS m, row_number() OVER (PARTITION BY point_id ORDER BY weight DESC, option) AS r FROM g
), gt AS (
  SELECT point_id, kind, option, CASE WHEN kind = 'labs' THEN 1.0::DOUBLE / m ELSE weight END AS weight, m FROM h WHERE r <= 4
), q AS (
  SELECT DISTINCT point_id, kind, m FROM gt
), d AS (
  SELECT point_id, kind, m, x, row_number() OVER (PARTITION BY point_id ORDER BY md5('7::' || point_id || '::' || x)) AS r
  FROM q, (SELECT unnest(['click 0', 'error 1', 'purchase 2', 'sign', 'view 9', 'scan 9']) AS x)
  WHERE NOT EXISTS (
    SELECT 1 FROM gt WHERE gt.point_id = q.point_id
      AND (contains(replace(gt.option, ' ', ''), replace(x, ' ', '')) OR contains(replace(x, ' ', ''), replace(gt.option, ' ', '')))
  )
), o AS (
  SELECT point_id, kind, option, weight FROM gt UNION ALL SELECT point_id, kind, x, NULL FROM d WHERE r <= 4 - m
), b AS (
  SELECT point_id, kind, 4 - count(*) AS lack FROM o GROUP BY ALL
), every AS (
  SELECT * FROM o UNION ALL
  SELECT point_id, kind, CASE kind WHEN 'labs' THEN 'Unrelated lab order ' WHEN 'imaging' THEN 'Unrelated study ' WHEN 'micro' THEN 'Unrelated culture '
    WHEN 'medication' THEN 'Unrelated drug ' ELSE 'Unrelated procedure ' END || i, NULL FROM b, range(1, 5) r(i) WHERE i <= lack
)
SELECT point_id, kind, CAST(row_number() OVER (PARTITION BY point_id ORDER BY md5('o::' || md5('7::' || point_id || '::' || option))) - 1 AS INTEGER) AS pos, option, weight FROM every
""",
)
def parameter_questions(t: Tables):
    """Five kinds of questions: true options with their weights, unlike names of a pool, and names made up."""
    kinds = F.array(*map(F.lit, sy.PARAMETER_KINDS))
    points = t.events.where("event_type = 'signup'").select("user_id", c("event_id").alias("point_id"), c("ts").alias("at"), F.element_at(kinds, (c("event_id") % 5 + 1).cast("int")).alias("kind"))
    held = t.events.withColumn("option", F.concat("event_type", F.lit(" "), (c("event_id") % 4).cast("string")))
    joined = ev.decayed(ev.horizon_join(points, held, entity="user_id", at="at", ts="ts", hours=24), at="at", ts="ts")
    asked = sy.parameter_questions(joined, point="point_id", kind="kind", ts="ts", option="option", pool=POOL, k=4)
    shown = asked.select("point_id", "kind", "answer", F.posexplode("options").alias("pos", "option"))
    return shown.select("point_id", "kind", "pos", "option", F.try_element_at("answer", c("option")).alias("weight"))


@query(
    "QST3_terminal_horizon",
    """
WITH e AS (
  SELECT user_id, event_id, ts, (epoch_us(m) - epoch_us(ts)) / 3.6e9 AS away,
    CAST('0x' || substr(md5('7::' || user_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.5 AS want
  FROM events JOIN (SELECT user_id, max(ts) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1) USING (user_id)
), p AS (
  SELECT *, CASE WHEN CASE WHEN want THEN away >= 1 AND away < 24 ELSE away >= 24 AND away < 30 END THEN 0
      WHEN (away >= 1 AND away < 24) OR (away >= 24 AND away < 30) THEN 1 ELSE 2 END AS pool,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recent
  FROM e WHERE away BETWEEN 0 AND 72
)
SELECT user_id, event_id, CASE WHEN away <= 24 THEN 'Yes' ELSE 'No' END AS label FROM p WHERE pool < 2 OR recent <= 50
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pool, md5('7::' || event_id), event_id) = 1
""",
)
def terminal_horizon(t: Tables):
    ends = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("end"))
    return sy.discharge_points(t.events, ends, entity="user_id", event_id="event_id", ts="ts", end="end", hours=24, gap=1.0)


@query(
    "QST3_horizon_label",
    """
    SELECT event_id, CASE WHEN (epoch_us(m) - epoch_us(ts)) / 3.6e9 <= 72 THEN 'Yes' ELSE 'No' END AS label FROM events
    JOIN (SELECT user_id, max(ts) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1) USING (user_id)
    """,
)
def horizon_label(t: Tables):
    return sy.horizon_question(t.events, entity="user_id", event_id="event_id", ts="ts", terminal=c("event_type") == "purchase", hours=72)


@query(
    "QST5_factual_rows",
    """
WITH e AS (
  SELECT *, CAST(day(ts) AS BIGINT) AS visit, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS place,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS tm, json_extract_string(props, '$.k') AS k
  FROM events
), q AS (
  SELECT event_id, 'LAB' AS kind, tm, place, visit, 'value ' || k AS name, CASE WHEN event_id % 2 = 0 THEN 'is ' || k END AS answer,
    'was %s measured, and what was the value' AS ask FROM e WHERE event_type = 'view'
  UNION ALL SELECT event_id, 'MED', tm, place, visit, 'order ' || k, 'drug ' || k || ' | 1', 'which drugs were given with %s' FROM e WHERE event_type = 'purchase'
  UNION ALL SELECT event_id, 'IMG', tm, place, visit, 'region ' || k, 'report ' || k, 'what did the study of %s show' FROM e WHERE event_type = 'click'
)
SELECT event_id || '-' || lower(kind) AS question_id, kind, 'In event ' || event_id || ' at ' || tm || ', ' || replace(ask, '%s', name) || '?' AS explicit,
  'In ' || kind || ' event ' || place || ' of visit ' || visit || ', ' || replace(ask, '%s', name) || '?' AS relative,
  CASE WHEN answer IS NULL THEN 'not found' WHEN kind = 'LAB' THEN 'found; ' || answer ELSE answer END AS keywords FROM q
UNION ALL
SELECT user_id || '-V' || visit || '-adm_dis', 'ADM_DIS',
  'In visit ' || visit || ' of ' || user_id || ', what was the complaint on admission and the diagnosis at discharge?', NULL,
  arg_min(event_type, (ts, event_id)) || '; ' || arg_max(event_type, (ts, event_id)) FROM e GROUP BY user_id, visit
""",
)
def factual_rows(t: Tables):
    """Four projections of the events: values with an explicit and a relative question, and one question for each stay."""
    day = F.dayofmonth("ts").cast("long").alias("visit")
    own = t.events.select("*", day, F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").alias("k"))
    placed = ev.with_ordinal(own, ["user_id", "event_type", "day"], order(), "place")

    def some(kind: str, name: str, answer):
        return placed.where(c("event_type") == kind).select("event_id", "ts", "visit", "place", F.concat(F.lit(name), c("k")).alias("name"), answer.alias("answer"))

    labs = some("view", "value ", F.when(c("event_id") % 2 == 0, F.concat(F.lit("is "), c("k"))))
    drugs = some("purchase", "order ", F.concat(F.lit("drug "), c("k"), F.lit(" | 1")))
    images = some("click", "region ", F.concat(F.lit("report "), c("k")))
    at = F.struct("ts", "event_id")
    stays = own.groupBy(c("user_id").alias("entity"), "visit").agg(F.min_by("event_type", at).alias("complaint"), F.max_by("event_type", at).alias("diagnosis"))
    parts = [sy.factual_questions(labs, "LAB"), sy.factual_questions(drugs, "MED"), sy.factual_questions(images, "IMG"), sy.stay_questions(stays)]
    return functools.reduce(lambda a, b: a.unionByName(b), parts).withColumn("keywords", F.array_join("keywords", "; "))


@query(
    "QST6_joint_questions",
    """
WITH v AS (
  SELECT user_id, CAST(ts AS DATE) AS day, arg_min(event_id, (ts, event_id)) AS a, arg_max(event_id, (ts, event_id)) AS z FROM events GROUP BY ALL
), i AS (
  SELECT user_id, day, 0 AS side, 'adm ' || a AS text FROM v UNION ALL SELECT user_id, day, 1, 'dis ' || z FROM v
), n AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day, side) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS m FROM i
), w AS (
  SELECT user_id, CAST(s / 4 AS INTEGER) AS "window", CAST(pos - s AS INTEGER) AS rank, text FROM n JOIN range(0, 200, 4) r(s) ON pos >= s AND pos < s + 8 AND s + 8 <= m
), h AS (
  SELECT *, md5('7::' || user_id || '::' || "window" || '::' || rank) AS h FROM w
), p AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id, "window" ORDER BY h, rank) - 1 AS INTEGER) AS shown FROM h
)
SELECT user_id, "window", list(text ORDER BY shown) AS items, list(shown ORDER BY rank) AS answer FROM p GROUP BY ALL
""",
)
def joint_questions(t: Tables):
    """Four visits each, two apart, as their first and last events."""
    at = F.struct("ts", "event_id")
    visits = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by("event_id", at).alias("a"), F.max_by("event_id", at).alias("z"))
    told = visits.select("user_id", "day", F.concat(F.lit("adm "), c("a").cast("string")).alias("opening"), F.concat(F.lit("dis "), c("z").cast("string")).alias("closing"))
    return sy.joint_questions(told, "user_id", "day", "opening", "closing", 4, 2)


@query(
    "QST6_cloze_questions",
    """
WITH e AS (
  SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, event_type IN ('purchase', 'signup') AS target FROM events
), g AS (
  SELECT *, CASE WHEN target THEN row_number() OVER (PARTITION BY user_id, day, target ORDER BY ts, event_id) - 1 END AS gap,
    CASE WHEN target THEN row_number() OVER (PARTITION BY user_id, day, target ORDER BY md5('7::' || event_id)) - 1 END AS shown FROM e
)
SELECT user_id, day, list(CASE WHEN target THEN 'GAP ' || gap ELSE CAST(event_id AS VARCHAR) END ORDER BY ts, event_id) AS stream,
  list(CAST(event_id AS VARCHAR) ORDER BY shown) FILTER (target) AS options, list(CAST(shown AS INTEGER) ORDER BY gap) FILTER (target) AS answer
FROM g GROUP BY ALL HAVING count(*) FILTER (target) >= 2
""",
)
def cloze_questions(t: Tables):
    return sy.cloze_questions(t.events.withColumn("day", F.to_date("ts")), ["user_id", "day"], ["ts", "event_id"], "event_id", c("event_type").isin("purchase", "signup"), 2)


@query(
    "SMP3_ratio_sample",
    """
    SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('7::' || event_id), event_id)
    AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r <= floor(n * 0.1)
    """,
)
def ratio_sample(t: Tables):
    return ev.ratio_sample(t.events, "event_type", ["event_id"], 0.1).select("event_id")


@query(
    "MTH5_kendall_tau",
    """
WITH o AS (
  SELECT o_custkey, o_orderkey, o_totalprice AS x, CAST(left(o_orderpriority, 1) AS INTEGER) AS y FROM orders WHERE o_custkey IS NOT NULL
), p AS (
  SELECT a.o_custkey, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(abs(sign(a.x - b.x))) AS nx, sum(abs(sign(a.y - b.y))) AS ny
  FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY 1
)
SELECT o_custkey, CASE WHEN nx * ny > 0 THEN s / sqrt(nx * ny) END AS tau FROM (SELECT DISTINCT o_custkey FROM o) LEFT JOIN p USING (o_custkey)
""",
)
def kendall_tau(t: Tables):
    """Each customer's order prices against their priorities, which tie."""
    pairs = F.sort_array(F.collect_list(F.struct("o_orderkey", c("o_totalprice").alias("x"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("y"))))
    each = t.orders.where("o_custkey IS NOT NULL").groupBy("o_custkey").agg(pairs.alias("p"))
    return each.select("o_custkey", scores.kendall_tau(F.transform("p", lambda p: p.x), F.transform("p", lambda p: p.y)).alias("tau"))


@query(
    "MTH6_l2_normalise",
    "SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(embedding[i]::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-12), 9) AS x FROM embeddings, range(1, 65) r(i)",
)
def l2_normalise(t: Tables):
    return t.embeddings.select("vec_id", F.posexplode(scores.normalized(c("embedding"))).alias("i", "x")).select("vec_id", "i", F.round("x", 9).alias("x"))


@query(
    "ARR8_inverse_permutation",
    """
WITH p AS (
  SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY md5('7::' || o_orderkey)) - 1 AS INTEGER) AS shown FROM orders
)
SELECT o_custkey, list(shown ORDER BY rank) AS a FROM p GROUP BY 1
""",
)
def inverse_permutation(t: Tables):
    """Where each rank stands among a customer's shuffled orders."""
    shown = sy.shuffled_ranking(t.orders, ["o_custkey"], [c("o_orderdate"), c("o_orderkey")], "o_orderkey")
    return shown.select("o_custkey", scores.inverse_permutation(c("truth")).alias("a"))


class Panels:
    """Stands in for a model that sorts keys into panels; asked for the second time it errs on some."""

    def ask(self, prompt: str) -> str:
        turn, keys = prompt.split(": ", 1)
        digest = {k: hashlib.md5(k.encode()).hexdigest() for k in keys.split(", ")}
        return json.dumps({k: "pz" if turn == "turn 2" and d[1] in "01" else f"p{d[0]}" for k, d in digest.items()})


@query(
    "AUX1_panel_mapping",
    """
WITH k AS (
  SELECT user_id, count(*) AS n, 'p' || substr(md5('K' || user_id), 1, 1) AS voted FROM events WHERE user_id IS NOT NULL GROUP BY 1
), m AS (
  SELECT *, CASE voted WHEN 'p0' THEN 'pa' WHEN 'p1' THEN 'pb' ELSE voted END AS panel FROM k
)
SELECT panel, list('K' || user_id ORDER BY 'K' || user_id) AS keys, CAST(sum(n) AS BIGINT) AS n_events FROM m GROUP BY 1
""",
)
def panel_mapping(t: Tables):
    """Collect the keys, most frequent first; ask for batches in three turns; vote; canonicalise; invert; apply to the events."""
    keyed = t.events.where("user_id IS NOT NULL").select(F.concat(F.lit("K"), c("user_id").cast("string")).alias("key"))
    return sy.panel_mapping(keyed, "key", Panels, batch_sizes=(20, 7, 13), canonical={"p0": "pa", "p1": "pb"})


class Flaky:
    """Refuses each prompt as often as its last digit modulo 3, then answers odd prompts without JSON until it is asked to repair."""

    def __init__(self) -> None:
        self.asked: dict[str, int] = {}

    def ask(self, prompt: str) -> str:
        number = prompt.split()[-1]
        self.asked[number] = self.asked.get(number, 0) + 1
        if self.asked[number] <= int(number) % 3:
            raise sy.RateLimited("429")
        return f'{{"answer": "{number}"}}' if int(number) % 2 == 0 or prompt.startswith(sy.REPAIR) else f"it is {number}"


@query(
    "AUX34_chat_policy",
    "SELECT n_nationkey, '{\"answer\": \"' || n_nationkey || '\"}' AS reply, NULL AS error FROM nation",
)
def chat_policy(t: Tables):
    """Calls that are refused are made again after growing pauses, replies that are no JSON are asked to be repaired."""
    careful = functools.partial(sy.Careful, Flaky, attempts=4, pause=0.001, per_second=500.0)
    asked = t.nation.select("n_nationkey", F.concat(F.lit("number "), c("n_nationkey").cast("string")).alias("prompt"))
    return sy.ask_model(asked, "n_nationkey", "prompt", careful, attempts=1)


@query("AUX13_provider_adapter", "SELECT conv_id, turn, 'echo ' || length(text) || ' of ' || role AS reply FROM conversations")
def provider_adapter(t: Tables):
    """A function in place of a client, given a chat as messages."""
    chat = F.to_json(F.array(F.struct("role", c("text").alias("content"))))
    asked = t.conversations.select("conv_id", "turn", chat.alias("prompt"))
    adapter = functools.partial(sy.Adapter, lambda messages: f"echo {len(messages[-1]['content'])} of {messages[-1]['role']}")
    return sy.ask_model(asked, ["conv_id", "turn"], "prompt", adapter).select("conv_id", "turn", "reply")
