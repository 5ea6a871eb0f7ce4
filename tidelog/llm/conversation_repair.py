"""Conversation structure repair: Dijkstra on the lattice of (turn index, grammar state).

A conversation's role initials must read ``(s?(ua)+)?``. Rows may be kept (K, free), given the role that the grammar
wants (R, 1) or deleted (D, 2); a turn without text may be inserted anywhere (I, 5); a truncated row that stays costs 5
more; blank and repeated rows must go. The lattice is never built: nodes come off a heap by (cost, audit), the audit
being the edits' letters so far, and the first accepting end node that comes off is the repair. Equal costs go to the
ASCII-least audit: two paths of one cost to a node are never prefixes of each other (they have consumed the same rows,
and an insertion that leads back costs more), so their order can't change further on.

Scale: rows shrink to a digest of their text, equal rows of a turn to one row with a count, and the light rows are cut by
ranges of (conversation, turn). A task solves each conversation that lies inside its range at once. A conversation that is
longer than ``piece`` rows, or that a range's border may cut, is solved in pieces: Dijkstra from each of the four states
that may enter a piece to those that may leave it, right after its last row. Costs and the order of audits then fold over
the pieces, one small row for each, forwards for the best way into every state and backwards for the way taken. So a
conversation that holds a third of all rows is many tasks. Its texts meet the edits in a sorted stream of constant
memory; only that stream, which a digest of the whole repaired text needs, is one task a conversation.

Edge cases: a null id is a conversation of its own, a null role or text is one space; null turns come first; rows of equal
turn go by role, then by the SHA-256 of their text; repeated rows are duplicates; a conversation without rows (all dropped)
has zeros, an empty audit and the digest of nothing; an empty table gives an empty result; other columns are ignored,
whatever their names. A row of many copies is one step of the lattice; the audit has a letter for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, bounded_batches, eased, materialize

#: States of the grammar: nothing yet, after s, after u, after a. What an insertion or a new role leads to, and what a kept initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTING = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
NAMES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: A step of the lattice: the row's initial, whether it is truncated, and the number of copies that must be deleted (0: a free choice).
Step = tuple[str, bool, int]


def walk(steps: list[Step], state: int, whole: bool) -> Iterator[tuple[int, str, int]]:
    """(cost, audit, state) of the end nodes in the order in which they come off the heap; without ``whole`` nothing is inserted behind the last row."""
    heap, done = [(0, "", 0, state)], set()
    while heap:
        cost, audit, at, state = heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(steps):
            yield cost, audit, state
            if not whole:
                continue
        heappush(heap, (cost + INSERT, audit + "I", at, NEXT[state]))
        if at == len(steps):
            continue
        initial, truncated, forced = steps[at]
        if forced:
            heappush(heap, (cost + DELETE * forced, audit + "D" * forced, at + 1, state))
            continue
        stays = cost + TRUNCATED * truncated
        heappush(heap, (cost + DELETE, audit + "D", at + 1, state))
        heappush(heap, (stays + REROLE, audit + "R", at + 1, NEXT[state]))
        if (state, initial) in KEPT:
            heappush(heap, (stays, audit + "K", at + 1, KEPT[state, initial]))


def cheapest(steps: list[Step]) -> tuple[int, str]:
    """Cost and audit of a whole conversation's repair."""
    return next((cost, audit) for cost, audit, state in walk(steps, START, True) if state in ACCEPTING)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, copies (0: dropped), damaged as the crc32 of ``conv:turn`` says: a fixed test of a repair."""
    at, said = F.col(turn_col).cast("long"), F.coalesce(F.col(text_col), F.lit(" "))
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(blank(F.col(conv_col)), F.lit(":"), blank(at))) % 20
    return rows.select(
        F.col(conv_col).alias("conv"), at.alias("turn"), F.when(draw == 4, "user").otherwise(blank(F.col(role_col))).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias("text"), F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, copies of rows as they are."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), blank(F.col(role_col)).alias("role"), blank(F.col(text_col)).alias("text"), F.lit(1).alias("copies"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def light(rows: DataFrame) -> DataFrame:
    """conv, turn, role, digest, blank, open (truncated), n, again (role and text seen at an earlier turn): one row for all equal rows of a turn."""
    core = F.regexp_replace("text", f"{BLANKS}\\z", "")
    own = rows.select("conv", "turn", "role", _digest(F.col("text")).alias("digest"), (core == "").alias("blank"), (~core.rlike("[.!?]\\z")).alias("open"), F.col("copies").cast("long").alias("copies"))
    own = own.groupBy("conv", "turn", "role", "digest", "blank", "open").agg(F.sum("copies").alias("n"))
    # The least turn by partial sums and a join: a text that a conversation repeats a million times is no task of its own.
    first = own.where("n > 0 AND NOT blank").groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    first = first.select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first")
    met = own.join(first, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return met.select("conv", "turn", "role", "digest", "blank", "open", "n", again.alias("again"))


#: What a piece says of its rows: counts, least and greatest turn, turns at its ends (a turn may go on in the next piece) and initials there.
SAYS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, last_turn bigint, first_initial string, last_initial string"


def _row_steps(row: tuple) -> list[Step]:
    _, _, role, _, blank, truncated, n, again = row
    if not n:
        return []
    if blank or again:
        return [("", False, n)]
    return [(role[:1], truncated, 0)] + ([("", False, n - 1)] if n > 1 else [])


def _said(rows: list[tuple]) -> dict:
    """SAYS of a piece's light rows."""
    out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | dict.fromkeys(("low", "high", "last_turn", "first_initial", "last_initial"))
    for _, turn, role, _, blank, truncated, n, again in rows:
        if not n:
            continue
        initial, before = role[:1], out["last_initial"]
        out["illegal"] += (before is not None and before + initial not in LEGAL) + (n - 1)
        out["first_initial"], out["last_initial"] = initial if before is None else out["first_initial"], initial
        out["blank"] += n if blank else 0
        out["duplicate"] += 0 if blank else n if again else n - 1
        out["truncated"] += not blank and not again and truncated
        if turn is not None:
            out["turns"] += turn != out["last_turn"]
            out["low"], out["high"], out["last_turn"] = turn if out["low"] is None else out["low"], turn, turn
    return out


def _cut(piece: int, schema: pa.Schema):
    """Light rows in order to pieces (see ``pieces``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []

        def put(rows: list[tuple], whole: bool) -> None:
            steps = [s for r in rows for s in _row_steps(r)]
            if whole:
                ways = {0: cheapest(steps)}
            else:
                ways = {4 * enter + leave: (cost, audit) for enter in range(4) for cost, audit, leave in walk(steps, enter, False)}
            # Audits from one entering state, in order.
            rank = {k: i for i, k in enumerate(sorted(ways, key=lambda k: (k // 4, ways[k][1])))}
            held = range(1 if whole else 16)
            out.append(
                {"conv": rows[0][0], "whole": whole, "turn": rows[0][1], "role": rows[0][2], "digest": rows[0][3]}
                | {"rows": [{"turn": r[1], "role": r[2], "digest": r[3], "n": r[6], "forced": bool(r[4] or r[7])} for r in rows]}
                | {"costs": [ways[k][0] if k in ways else None for k in held], "audits": [ways[k][1] if k in ways else None for k in held], "ranks": [rank.get(k) for k in held]}
                | _said(rows)
            )

        rows, steps, settled = [], 0, False
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows and (row[0] != rows[0][0] or steps >= piece):
                    # Whole: begun behind another conversation of this range, and ended by the next.
                    ends = row[0] != rows[0][0]
                    put(rows, settled and ends)
                    settled = ends
                    rows, steps = [], 0
                rows.append(row)
                steps += max(1, row[6])
            if sum(len(x["rows"]) for x in out) >= 20_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        if rows:
            put(rows, False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return eased(run)


def pieces(own: DataFrame, piece: int) -> DataFrame:
    """Light rows to pieces: ``whole`` conversations with one way (cost, audit), other pieces with a way from each entering to each leaving state (4 * enter + leave) and the ways' order."""
    kind = own.schema["conv"].dataType.simpleString()
    order = ["conv", "turn", "role", "digest"]
    schema = (
        f"conv {kind}, whole boolean, turn bigint, role string, digest binary, rows array<struct<turn: bigint, role: string, digest: binary, n: bigint, forced: boolean>>, "
        f"costs array<bigint>, audits array<string>, ranks array<int>, {SAYS}"
    )
    spark = own.sparkSession
    arrow = _arrow(spark, schema)
    cut = own.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut(piece, arrow), schema)
    return materialize(cut.withColumn("piece", F.monotonically_increasing_id()), "repair-pieces")


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


#: Inserted behind the last row, by the state that it leaves.
CLOSING = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}


def _folded(schema: pa.Schema):
    """Forwards over a conversation's pieces: the state before each that the best way into each state comes from; with the last piece, the state that is left and the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, best, sums = [], None, {}, {}

        def close() -> None:
            if held is not None:
                cost, _, leave = min((c + INSERT * len(CLOSING[s]), rank, s) for s, (c, rank) in best.items())
                out.append(held | {"leave": leave, "cost": cost} | sums)

        for batch in batches:
            for x in batch.to_pylist():
                if held is not None and held["conv"] == x["conv"]:
                    out.append(held)
                    border = sums["last_initial"] is not None and x["first_initial"] is not None and sums["last_initial"] + x["first_initial"] not in LEGAL
                    sums["illegal"] += x["illegal"] + border
                    sums["turns"] += x["turns"] - (x["low"] is not None and x["low"] == sums["last_turn"])
                    for name in ("blank", "duplicate", "truncated"):
                        sums[name] += x[name]
                    sums["low"] = x["low"] if sums["low"] is None else sums["low"]
                    for name in ("high", "last_turn", "last_initial"):
                        sums[name] = sums[name] if x[name] is None else x[name]
                else:
                    close()
                    best, sums = {START: (0, 0)}, {name: x[name] for name in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "last_turn", "last_initial")}
                new = {}
                for leave in range(4):
                    ways = [(c + x["costs"][4 * s + leave], rank, s) for s, (c, rank) in best.items() if x["costs"][4 * s + leave] is not None]
                    if ways:
                        new[leave] = min(ways)
                audits = sorted(new, key=lambda s: (new[s][1], x["ranks"][4 * new[s][2] + s]))
                best = {s: (new[s][0], audits.index(s)) for s in new}
                held = {"piece": x["piece"], "conv": x["conv"], "turn": x["turn"], "role": x["role"], "digest": x["digest"], "enters": [new[s][2] if s in new else None for s in range(4)]}
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _traced(schema: pa.Schema):
    """Backwards over the pieces: the states at which the way taken enters and leaves each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave = None
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                closing = CLOSING[x["leave"]] if x["leave"] is not None else ""
                leave = leave if x["leave"] is None else x["leave"]
                enter = x["enters"][leave]
                out.append({"piece": x["piece"], "way": 4 * enter + leave, "closing": closing})
                leave = enter
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def solved(rows: DataFrame, piece: int = 1024) -> tuple[DataFrame, DataFrame]:
    """From conv, turn, role, text, copies: (conversations: conv, gaps, blank, duplicate, truncated, illegal, cost, audit; pieces with their light rows and audit)."""
    spark = rows.sparkSession
    bounded_batches(spark)
    cut = pieces(light(rows), piece)
    kind = rows.schema["conv"].dataType.simpleString()
    order = ["turn", "role", "digest"]
    sums = "cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint"
    schema = f"piece bigint, conv {kind}, turn bigint, role string, digest binary, enters array<int>, leave int, {sums}"
    parts = cut.where("NOT whole").drop("rows", "audits", "whole").repartition("conv").sortWithinPartitions("conv", *order)
    forwards = materialize(parts.mapInArrow(_folded(_arrow(spark, schema)), schema), "repair-forwards")
    taken = "piece bigint, way int, closing string"
    back = forwards.select("piece", "conv", *order, "enters", "leave").repartition("conv").sortWithinPartitions("conv", *[F.desc(c) for c in order])
    ways = materialize(back.mapInArrow(_traced(_arrow(spark, taken)), taken), "repair-ways")
    own = ["conv", *order, "rows"]
    chosen = cut.where("NOT whole").join(ways, "piece").select(*own, F.concat(F.get("audits", F.col("way")), "closing").alias("audit"))
    edits = cut.where("whole").select(*own, F.col("audits")[0].alias("audit")).unionByName(chosen)

    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    shown = ["conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal"]
    whole = cut.where("whole").select(*shown, F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    joined = chosen.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "audit"))), lambda x: x["audit"]), "").alias("audit"))
    joined = joined.withColumnRenamed("conv", "_conv")
    long = forwards.where("leave IS NOT NULL").select(*shown, "cost").join(joined, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    return whole.unionByName(long), edits


def _orders(schema: pa.Schema):
    """Edits to one order for each light row that stays or has insertions beside it: before and after (initials), says (its role, null: deleted), edit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                audit, at = x["audit"], 0
                for i, row in enumerate(x["rows"]):
                    before = after = 0
                    edit = ""
                    n = row["n"]
                    while n and at < len(audit) and audit[at] == "I":
                        before, at = before + 1, at + 1
                    if n and not row["forced"]:
                        edit, at, n = audit[at], at + 1, n - 1
                    # Insertions between a row and its copies stand before the copies, which are deleted.
                    while n:
                        if audit[at] == "I":
                            after, at = after + 1, at + 1
                        else:
                            n, at = n - 1, at + 1
                    if i + 1 == len(x["rows"]):
                        after += len(audit) - at
                    if before or after or edit in ("K", "R"):
                        out.append({"conv": x["conv"], "turn": row["turn"], "role": row["role"], "digest": row["digest"], "kind": 0, "edit": edit, "before": before, "after": after})
            for at in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_pylist(out[at : at + 20_000], schema)

    return run


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal conv, turn, role and text once a batch: a row that is repeated without end doesn't travel so."""
    for batch in batches:
        seen = set()
        keep = [key not in seen and not seen.add(key) for key in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str, str]]:
    """(conv, role, text, edit) of every repaired row, in order: orders and texts come sorted, an order before its text."""
    conv, state, order, key, any_yet = None, START, None, None, False

    def says(n: int) -> Iterator[tuple[object, str, str, str]]:
        nonlocal state
        for _ in range(n):
            state = NEXT[state]
            yield conv, NAMES[state], "", "I"

    for batch in batches:
        for own, turn, role, digest, kind, edit, before, after, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if not any_yet or own != conv:
                conv, state, order, any_yet = own, START, None, True
            if kind == 0:
                yield from says(before)
                if edit in ("K", "R"):
                    order, key = (edit, after), (turn, role, digest)
                else:
                    yield from says(after)
            elif order is not None and key == (turn, role, digest):
                edit, after = order
                order = None
                if edit == "K":
                    state = KEPT[state, role[:1]]
                    yield conv, role, text, "K"
                else:
                    state = NEXT[state]
                    yield conv, NAMES[state], text, "R"
                yield from says(after)


def _stream(rows: DataFrame, edits: DataFrame) -> DataFrame:
    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, turn bigint, role string, digest binary, kind int, edit string, before int, after int"
    orders = edits.select("conv", "rows", "audit").mapInArrow(_orders(_arrow(rows.sparkSession, schema)), schema)
    texts = rows.where("copies > 0").select("conv", "turn", "role", _digest(F.col("text")).alias("digest"), "text")
    texts = texts.mapInArrow(_thinned, texts.schema).select("conv", "turn", "role", "digest", F.lit(1).alias("kind"), "text")
    return orders.unionByName(texts, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", "kind")


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv, place (from 0), role, text, edit (K, R or I) of every row of the repaired conversations."""
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, place bigint, role string, text string, edit string"
    arrow = _arrow(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, place, last = [], 0, 0, object()
        for conv, role, text, edit in _lines(batches):
            place = place + 1 if conv == last else 0
            last = conv
            out.append({"conv": conv, "place": place, "role": role, "text": text, "edit": edit})
            size += len(text) + 100
            if size >= 4_000_000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return _stream(rows, edits).mapInArrow(eased(run), schema)


def digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of the repaired ``role:text`` lines, joined by newlines; conversations without rows are left out."""
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, repaired_sha256 string"
    arrow = _arrow(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, summed = [], None, None
        for conv, role, text, _ in _lines(batches):
            if summed is not None and conv == last:
                summed.update(b"\n")
            else:
                if summed is not None:
                    out.append({"conv": last, "repaired_sha256": summed.hexdigest()})
                last, summed = conv, hashlib.sha256()
            summed.update(f"{role}:{text}".encode())
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if summed is not None:
            out.append({"conv": last, "repaired_sha256": summed.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return _stream(rows, edits).mapInArrow(eased(run), schema)


def repair_report(rows: DataFrame, piece: int = 1024) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of conv, turn, role, text, copies."""
    found, edits = solved(rows, piece)
    named = digests(rows, edits).withColumnRenamed("conv", "_conv")
    met = found.join(named, F.col("conv").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return met.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))
