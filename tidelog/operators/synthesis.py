"""Questions from event streams, and calls to models behind an interface with an offline stand-in."""

from __future__ import annotations

import functools
import hashlib
import json
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, texts, times
from ..sources.shared import written
from ..sources.versions import VersionedTable
from . import events as ev
from . import rollups as ru


class Client(Protocol):
    """What answers a prompt. Clients are built on the executors, one for each task."""

    def ask(self, prompt: str) -> str: ...


class Offline:
    """A fixed answer for each prompt, without a network."""

    def ask(self, prompt: str) -> str:
        return '{"answer": "' + hashlib.md5(prompt.encode()).hexdigest()[:8] + '"}'


class RateLimited(Exception):
    """The service asks to be left alone for a while."""


#: What precedes a prompt whose reply was no JSON.
REPAIR = "Reply with JSON only. "


class Pace:
    """Starts of calls at least a gap apart, for all threads of a task; a refused call holds up all that come after it."""

    def __init__(self, per_second: float, *, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep = 1.0 / per_second, clock, sleep
        self.lock, self.next = threading.Lock(), 0.0

    def wait(self) -> None:
        with self.lock:
            at = max(self.clock(), self.next)
            self.next = at + self.gap
        pause = at - self.clock()
        if pause > 0:
            self.sleep(pause)

    def hold(self, seconds: float) -> None:
        with self.lock:
            self.next = max(self.next, self.clock() + seconds)


class Careful:
    """A client around another: calls at the pace of ``per_second``, tries again after a failure with a pause that doubles, and asks once to repair a reply that is no JSON.

    With a shared ``pace`` it starts no call before that one lets it, and a refusal (RateLimited) holds up the others too.
    """

    def __init__(self, inner: Callable[[], Client], *, attempts: int = 4, pause: float = 1.0, per_second: float = 5.0, pace: Pace | None = None) -> None:
        self.inner, self.attempts, self.pause = inner(), attempts, pause
        self.pace = pace or Pace(per_second)

    def patiently(self, prompt: str) -> str:
        for turn in range(self.attempts):
            self.pace.wait()
            try:
                return self.inner.ask(prompt)
            except Exception as error:
                if turn + 1 == self.attempts:
                    raise
                if isinstance(error, RateLimited):
                    self.pace.hold(self.pause * 2**turn)
                else:
                    self.pace.sleep(self.pause * 2**turn)
        raise ValueError("at least one attempt is needed")

    def ask(self, prompt: str) -> str:
        reply = self.patiently(prompt)
        try:
            json.loads(reply)
        except ValueError:
            reply = self.patiently(REPAIR + prompt)
        return reply


class Adapter:
    """A client from a function of messages (a list of role and content), for services that take chats; the prompt is the list as JSON."""

    def __init__(self, call: Callable[[list[dict]], str]) -> None:
        self.call = call

    def ask(self, prompt: str) -> str:
        return self.call(json.loads(prompt))


def asked_in_order(prompts: Iterator[str], client: Callable[[], Client], attempts: int, workers: int) -> Iterator[tuple[str | None, str | None]]:
    """(reply, error) of each prompt, in their order, with up to ``workers`` calls in flight: a client for each thread, and no more than twice as many prompts taken from the source as are in flight."""
    own = threading.local()

    def one(prompt: str) -> tuple[str | None, str | None]:
        if not hasattr(own, "client"):
            own.client = client()
        error = None
        for _ in range(attempts):
            try:
                return own.client.ask(prompt or ""), None
            except Exception as failed:  # noqa: BLE001  (a client may raise anything; the row carries it)
                error = f"{type(failed).__name__}: {failed}"
        return None, error

    if workers == 1:
        yield from map(one, prompts)
        return
    with ThreadPoolExecutor(workers) as pool:
        flying: deque = deque()
        for prompt in prompts:
            flying.append(pool.submit(one, prompt))
            if len(flying) >= 2 * workers:
                yield flying.popleft().result()
        while flying:
            yield flying.popleft().result()


def ask_model(df: DataFrame, key: str | Sequence[str], prompt: str, client: Callable[..., Client] = Offline, attempts: int = 2, *, workers: int = 1, per_second: float | None = None, tasks: int | None = None) -> DataFrame:
    """The key columns, reply, error: a failed call is a row with its error, after ``attempts`` tries.

    A task keeps ``workers`` calls in flight and gives the rows back in their order. ``per_second`` is a budget for the
    whole job: rows are dealt to ``tasks`` partitions (as many as can run at once) and each keeps to its share; the client
    is then built with the task's ``pace`` (see Careful), without it as it is.
    """
    keys = [key] if isinstance(key, str) else list(key)
    own = df.select(*keys, prompt)
    if per_second is not None:
        tasks = tasks or df.sparkSession.sparkContext.defaultParallelism
        own = own.repartition(tasks)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        build = client if per_second is None else functools.partial(client, pace=Pace(per_second / tasks))
        for part in parts:
            replies = list(asked_in_order(iter(part[prompt]), build, attempts, workers))
            yield part[keys].assign(reply=[r for r, _ in replies], error=[e for _, e in replies])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return own.mapInPandas(run, f"{kinds}, reply string, error string")


def ask_the_rest(df: DataFrame, key: Sequence[str], prompt: str, path: str, client: Callable[..., Client] = Offline, *, rounds: int = 8, **options: object) -> DataFrame:
    """Replies by key from a versioned table at ``path`` that is filled with what it lacks: keys, reply, error (of keys that failed again).

    The keys that have no reply yet are asked in ``rounds`` parts, and each part's replies are put in before the next is
    asked. A run that is cut short loses one part at most; another run asks only for what is missing or failed.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)
    table = VersionedTable(df.sparkSession, path, f"{kinds}, reply string", key)
    done = table.read().select(*[F.col(k).alias(f"__{k}") for k in key])
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    todo = written(df.select(*key, prompt).join(done, same, "left_anti"))
    failed = []
    for part in range(rounds):
        own = todo.where(F.pmod(F.xxhash64(*key), F.lit(rounds)) == part)
        replies = written(ask_model(own, key, prompt, client, **options))
        table.upsert(replies.where("error IS NULL").drop("error"))
        failed.append(replies.where("error IS NOT NULL"))
    return functools.reduce(DataFrame.unionByName, failed, table.read().withColumn("error", F.lit(None).cast("string")))


def panel_mapping(df: DataFrame, key: str, client: Callable[[], Client], *, batch_sizes: Sequence[int], canonical: Mapping[str, str]) -> DataFrame:
    """panel, keys, n_events: keys sorted into panels by a model that is asked for batches, once for each batch size.

    The most frequent keys come first. Each turn's replies (key to panel, as JSON) are votes; the most frequent panel of a
    key wins, is canonicalised (itself, if it has no other name), and is applied to the rows of df.
    """
    counted = df.groupBy(key).agg(F.count("*").alias("n"))
    ranked = ev.dense_ids(counted.withColumn("__by", F.struct((-F.col("n")).alias("m"), F.col(key).alias("k"))), "__by", "__place").select(F.col("__by.k").alias(key), "__place")
    turns = []
    for turn, size in enumerate(batch_sizes, 1):
        batch = ranked.groupBy(F.floor((F.col("__place") - 1) / size).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("__place", key))).alias("s"))
        turns.append(batch.select(F.lit(turn).alias("turn"), "batch", F.concat(F.lit(f"turn {turn}: "), F.array_join(F.transform("s", lambda x: x[key]), ", ")).alias("prompt")))
    replies = ask_model(functools.reduce(DataFrame.unionByName, turns), ["turn", "batch"], "prompt", client)
    cast = replies.select(F.explode(F.from_json("reply", "map<string,string>")).alias(key, "panel"))
    names = F.create_map(*[F.lit(x) for pair in canonical.items() for x in pair])
    voted = ru.votes(cast, key, "panel").select(key, F.coalesce(names[F.col("panel")], F.col("panel")).alias("panel"))
    return voted.join(counted, key).groupBy("panel").agg(F.sort_array(F.collect_set(key)).alias("keys"), F.sum("n").alias("n_events"))


def hash_embedding(text: Column, dim: int = 8) -> Column:
    """A stand-in for an embedding: each component from a digest of the text, in [-1, 1)."""
    part = lambda i: F.conv(F.substring(F.md5(F.concat(i.cast("string"), F.lit(":"), F.coalesce(text, F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**31) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), part)


def coin(seed: str, *keys: str) -> Column:
    """0 or 1, fixed by the keys."""
    return F.conv(F.substring(ev.keyed_order(seed, *keys), 1, 8), 16, 10).cast("long") % 2


def next_action_questions(events: DataFrame, *, entity: str, event_id: str, ts: str, kind: str, kinds: Sequence[str], k: int, seed: str = "7") -> DataFrame:
    """For each event with a successor: options (the true kind and k - 1 others in a fixed shuffle) and the answer."""
    asked = ev.next_event(events, entity, [F.col(ts), F.col(event_id)], [kind]).where(F.col(f"next_{kind}").isNotNull())
    truth = F.col(f"next_{kind}")
    order = lambda x: F.md5(F.concat_ws("::", F.lit(seed), F.col(event_id).cast("string"), x))
    others = F.transform(F.slice(F.sort_array(F.transform(F.filter(F.array(*map(F.lit, kinds)), lambda x: x != truth), lambda x: F.struct(order(x).alias("h"), x.alias("x")))), 1, k - 1), lambda s: s.x)
    options = F.transform(F.sort_array(F.transform(F.concat(F.array(truth), others), lambda x: F.struct(F.md5(F.concat(F.lit("o::"), order(x))).alias("h"), x.alias("x")))), lambda s: s.x)
    return asked.select(F.col(event_id), F.col(entity), truth.alias("answer"), options.alias("options"))


def weighted_options(joined: DataFrame, point: str, option: str, *, merge: str = "max") -> DataFrame:
    """A point's options with their weights as a map; an option that occurs twice keeps the larger (or the last) weight."""
    best = F.max("weight") if merge == "max" else F.max_by("weight", "place")
    each = joined.groupBy(point, option).agg(best.alias("weight"))
    return each.groupBy(point).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(option, "weight")))).alias("answer"))


#: How a parameter question of each kind calls an option that had to be made up, and whether its answers weigh alike.
PARAMETER_KINDS = {"labs": ("Unrelated lab order", True), "imaging": ("Unrelated study", False), "micro": ("Unrelated culture", False), "medication": ("Unrelated drug", False), "procedure": ("Unrelated procedure", False)}


def parameter_questions(joined: DataFrame, *, point: str, kind: str, ts: str, option: str, pool: Sequence[str], k: int, seed: str = "7") -> DataFrame:
    """point, kind, options, answer: which of k options come next, from the events that follow a point (``joined``, with their decaying ``weight``).

    True options are those of the first following time (labs, which weigh alike) or of all times (the others, by their
    weight relative to the first event's); the k heaviest are asked for. The rest are names of the pool that are not
    similar to a true one, in a fixed shuffle, and where the pool runs out, made up by the kind's pattern.
    """
    group = Window.partitionBy(point)
    alike = F.col(kind) == "labs"
    dated = joined.withColumns({"__t0": F.min(ts).over(group), "__w0": F.max("weight").over(group)}).where(~alike | (F.col(ts) == F.col("__t0")))
    each = dated.groupBy(point, kind, option).agg(F.max(F.col("weight") / F.col("__w0")).alias("w"))
    asked = each.groupBy(point, kind).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("m"), F.col(option).alias("o")))), 1, k).alias("g"))
    truth = F.transform("g", lambda x: x.o)
    own = asked.select(point, kind, truth.alias("__true"), F.transform("g", lambda x: F.when(alike, F.lit(1.0) / F.size("g")).otherwise(-x.m)).alias("__w"))
    order = lambda x: F.md5(F.concat_ws("::", F.lit(seed), F.col(point).cast("string"), x))
    free = F.filter(F.array(*map(F.lit, pool)), lambda x: ~F.exists("__true", lambda t: texts.similar_names(t, x)))
    others = F.slice(F.transform(F.sort_array(F.transform(free, lambda x: F.struct(order(x).alias("h"), x.alias("x")))), lambda s: s.x), F.lit(1), F.lit(k) - F.size("__true"))
    named = F.create_map(*[F.lit(x) for name, (text, _) in PARAMETER_KINDS.items() for x in (name, text)])
    short = own.withColumn("__others", others).withColumn("__short", F.lit(k) - F.size("__true") - F.size("__others"))
    made = F.when(F.col("__short") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col("__short"), F.lit(1))), lambda i: F.concat(named[F.col(kind)], F.lit(" "), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    every = short.withColumn("__all", F.concat("__true", "__others", made))
    options = F.transform(F.sort_array(F.transform("__all", lambda x: F.struct(F.md5(F.concat(F.lit("o::"), order(x))).alias("h"), x.alias("x")))), lambda s: s.x)
    return every.select(point, kind, options.alias("options"), F.map_from_arrays("__true", "__w").alias("answer"))


def horizon_question(events: DataFrame, *, entity: str, event_id: str, ts: str, terminal: Column, hours: float) -> DataFrame:
    """Yes if the entity's terminal event is at most ``hours`` away (also once it has passed)."""
    last = events.where(terminal).groupBy(entity).agg(F.max(ts).alias("__end"))
    met = events.join(last, entity)
    return met.select(event_id, F.when(times.hours_between(F.col(ts), F.col("__end")) <= hours, "Yes").otherwise("No").alias("label"))


def discharge_points(events: DataFrame, ends: DataFrame, *, entity: str, event_id: str, ts: str, end: str, hours: float, yes_ratio: float = 0.5, gap: float = 0.0, margin: float = 6.0, within: float = 72.0, last: int = 50, seed: str = "7") -> DataFrame:
    """One decision point for each entity, shortly before its end: entity, event_id, label (Yes: the end is at most ``hours`` away).

    Points are events of the last ``within`` hours. A fixed draw names the wanted pool: Yes in [gap, hours) before the
    end, No in [hours, hours + margin). If it is empty the other pool serves, and if both are, the ``last`` events.
    """
    away = times.hours_between(F.col(ts), F.col(end))
    met = events.join(ends, entity).withColumn("__away", away).where(F.col("__away").between(0, within))
    yes = (F.col("__away") < hours) & (F.col("__away") >= gap)
    no = (F.col("__away") >= hours) & (F.col("__away") < hours + margin)
    draw = F.conv(F.substring(ev.keyed_order(seed, entity), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    wanted = F.when(draw < yes_ratio, yes).otherwise(no)
    pool = F.when(wanted, 0).when(yes | no, 1).otherwise(2)
    recent = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(ts), F.desc(event_id)))
    pooled = met.withColumns({"__pool": pool, "__recent": recent}).where(f"__pool < 2 OR __recent <= {last}")
    one = ev.top_k(pooled, [entity], [F.col("__pool"), ev.keyed_order(seed, event_id), F.col(event_id)], 1, "__r")
    return one.select(entity, event_id, F.when(F.col("__away") <= hours, "Yes").otherwise("No").alias("label"))


def factual_questions(items: DataFrame, kind: str) -> DataFrame:
    """question_id, kind, explicit, relative, keywords from (event_id, ts, visit, place, name, answer) of one kind: LAB, MED or IMG.

    The explicit form names the event and its time, the relative one its place among its kind in the visit. A null
    answer stands for a laboratory value that the event doesn't have.
    """
    asks = {"LAB": "was %s measured, and what was the value", "MED": "which drugs were given with %s", "IMG": "what did the study of %s show"}[kind]
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    explicit = F.format_string(f"In event %s at %s, {asks}?", F.col("event_id").cast("string"), at, F.col("name"))
    relative = F.format_string(f"In {kind} event %d of visit %d, {asks}?", F.col("place").cast("long"), F.col("visit").cast("long"), F.col("name"))
    found = F.array(F.lit("found"), F.col("answer")) if kind == "LAB" else F.array("answer")
    keywords = F.when(F.col("answer").isNull(), F.array(F.lit("not found"))).otherwise(found)
    return items.select(F.concat_ws("-", F.col("event_id").cast("string"), F.lit(kind.lower())).alias("question_id"), F.lit(kind).alias("kind"), explicit.alias("explicit"), relative.alias("relative"), keywords.alias("keywords"))


def stay_questions(stays: DataFrame) -> DataFrame:
    """The fourth kind, ADM_DIS, in the same columns, from (entity, visit, complaint, diagnosis): one question a stay, without a relative form."""
    text = F.format_string("In visit %d of %s, what was the complaint on admission and the diagnosis at discharge?", F.col("visit").cast("long"), F.col("entity").cast("string"))
    keywords = F.array_compact(F.array("complaint", "diagnosis"))
    return stays.select(F.format_string("%s-V%d-adm_dis", F.col("entity").cast("string"), F.col("visit").cast("long")).alias("question_id"), F.lit("ADM_DIS").alias("kind"), text.alias("explicit"), F.lit(None).cast("string").alias("relative"), keywords.alias("keywords"))


def cloze_questions(df: DataFrame, by: Sequence[str], order: Sequence[str], key: str, target: Column, least: int, seed: str = "7") -> DataFrame:
    """Per group: its stream with the targets cut out (GAP 0, GAP 1, ...), the targets in a fixed shuffle, and which of them fills each gap.

    Groups with fewer than ``least`` targets ask nothing.
    """
    rows = df.withColumn("__t", F.coalesce(target, F.lit(False))).withColumn("__k", F.col(key).cast("string"))
    stream = F.sort_array(F.collect_list(F.struct(*order, "__t", "__k")))
    options = F.sort_array(F.collect_list(F.when(F.col("__t"), F.struct(ev.keyed_order(seed, key).alias("h"), F.col("__k").alias("k")))))
    grouped = rows.groupBy(*by).agg(stream.alias("s"), options.alias("o")).where(F.size("o") >= least)
    gaps = F.transform(F.filter("s", lambda x: x["__t"]), lambda x: x["__k"])
    shown = F.transform("o", lambda x: x.k)
    filled = F.transform("gaps", lambda k: (F.array_position("options", k) - 1).cast("int"))
    # A gap's number is its place among the cut-out rows.
    told = F.transform("s", lambda x: F.when(x["__t"], F.concat(F.lit("GAP "), (F.array_position("gaps", x["__k"]) - 1).cast("string"))).otherwise(x["__k"]))
    both = grouped.withColumns({"gaps": gaps, "options": shown})
    return both.select(*by, told.alias("stream"), "options", filled.alias("answer"))


def joint_questions(visits: DataFrame, entity: str, visit: str, opening: str, closing: str, size: int, stride: int, seed: str = "7") -> DataFrame:
    """Windows of ``size`` visits, each as its opening and its closing text: the texts in a fixed shuffle, and the true order of what is shown."""
    both = visits.select(entity, visit, F.posexplode(F.array(opening, closing)).alias("side", "text")).where(F.col("text").isNotNull())
    windows = ev.sliding(both, entity, [F.col(visit), F.col("side")], F.struct(visit, "side", "text"), 2 * size, 2 * stride)
    each = windows.select(entity, "window", F.posexplode("items").alias("rank", "x")).select(entity, "window", "rank", "x.*")
    shuffle = F.sort_array(F.collect_list(F.struct(ev.keyed_order(seed, entity, "window", "rank").alias("h"), "rank", "text")))
    shown = each.groupBy(entity, "window").agg(shuffle.alias("s"))
    truth = scores.inverse_permutation(F.transform("s", lambda x: x.rank))
    return shown.select(entity, "window", F.transform("s", lambda x: x.text).alias("items"), truth.alias("answer"))


def balanced_pick(df: DataFrame, by: str, label: str, keys: Sequence[str], seed: str = "7") -> DataFrame:
    """One row of each group: of the label that a coin names, else of the other."""
    wanted = F.when(coin(seed, by) == 0, "No").otherwise("Yes")
    return ev.top_k(df.withColumn("__w", (F.col(label) != wanted).cast("int")), [by], [F.col("__w"), ev.keyed_order(seed, *keys), *[F.col(c) for c in keys]], 1, "__r").drop("__w", "__r")


def shuffled_ranking(df: DataFrame, by: Sequence[str], order: Sequence[Column], key: str, seed: str = "7") -> DataFrame:
    """Per group the items in a fixed shuffle, and where each one stands in the true order."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    shown = F.sort_array(F.collect_list(F.struct(ev.keyed_order(seed, key).alias("h"), F.col(key).alias("item"), F.col("__rank").alias("rank"))))
    return ranked.groupBy(*by).agg(shown.alias("s")).select(*by, F.transform("s", lambda x: x.item).alias("items"), F.transform("s", lambda x: x.rank).alias("truth"))


def messages(df: DataFrame, by: str, order: Sequence[str], role: str, content: str) -> DataFrame:
    """Rows as one chat: an array of (role, content)."""
    return ev.nested(df, [by], list(order), [role, content], "messages")
