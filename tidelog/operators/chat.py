"""Chat with a memory: each turn may read what earlier turns of its entity have written.

A turn's prompt depends on the replies before it, so an entity's turns are one fold: read, compose, ask, write back. Over a
table they are a sorted stream by entity, over a stream of turns the memory is kept between batches; both give the
same rows. Entities run side by side; a memory holds its newest ``keep`` items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import is_question
from .synthesis import Client, Offline

FACT, USER = "fact", "user"


def should_retrieve(text: Column, kind: Column, policy: str = "always") -> Column:
    """Whether a message reads the memory: one of a stated kind only if that is a question, others by the policy (always, never, question_only; any other name is always)."""
    stated = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    other = {"never": F.lit(False), "question_only": is_question(text)}.get(policy.lower(), F.lit(True))
    return F.when(stated != "", stated == "question").otherwise(other)


class Memory:
    """An entity's items in order of insertion; of more than ``keep`` the oldest go."""

    def __init__(self, items: list[str], keep: int) -> None:
        self.items, self.keep = items, keep

    def add(self, text: str | None) -> None:
        if text:
            self.items.append(text)
            del self.items[: -self.keep]

    def search(self, needle: str, k: int) -> list[str]:
        """Items that hold the needle, whatever its case, then the others, each in order of insertion."""
        low = needle.lower()
        first = [x for x in self.items if low in x.lower()]
        return (first + [x for x in self.items if low not in x.lower()])[:k]


class Turn(NamedTuple):
    kind: str
    text: str | None
    needle: str | None
    gate: bool | None


def reply(memory: Memory, turn: Turn, client: Client, k: int) -> tuple[str, int] | None:
    """(reply, items read) of a user's turn, which is written back with its reply; a fact is written only."""
    if turn.kind == FACT:
        memory.add(turn.text)
        return None
    text = (turn.text or "").strip()
    found = memory.search((turn.needle or text).strip(), k) if turn.gate and text and k else []
    block = "Memory:\n" + "".join(f"- {x}\n" for x in found) if found else ""
    said = client.ask(f"{block}User: {text}")
    memory.add(turn.text)
    memory.add(said)
    return said, len(found)


def _shaped(rows: DataFrame, entity: str, turn: str) -> DataFrame:
    return rows.select(F.col(entity).alias("entity"), F.col(turn).cast("long").alias("turn"), "kind", "text", "needle", "gate")


def _schema(rows: DataFrame, entity: str, turn: str) -> str:
    return f"{entity} {rows.schema[entity].dataType.simpleString()}, {turn} bigint, reply string, n_read int"


def chat(rows: DataFrame, *, entity: str, turn: str, k: int = 4, keep: int = 1000, client: Callable[[], Client] = Offline) -> DataFrame:
    """entity, turn, reply, n_read of every user's turn in a table of turns (kind: fact or user; text; needle, what to look for, null: the text; gate).

    Facts of a turn come before its questions, equal ones by text. Nulls count as no text; a null entity is an entity.
    """
    own = _shaped(rows, entity, turn).repartition("entity").sortWithinPartitions("entity", "turn", "kind", "text", "needle")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asks, memory, now = client(), None, None
        for part in parts:
            out = []
            for r in part.astype(object).where(part.notna(), None).itertuples(index=False):
                if memory is None or r.entity != now:
                    memory, now = Memory([], keep), r.entity
                said = reply(memory, Turn(r.kind, r.text, r.needle, r.gate), asks, k)
                if said:
                    out.append((r.entity, r.turn, *said))
            yield pd.DataFrame(out, columns=[entity, turn, "reply", "n_read"])

    return own.mapInPandas(run, _schema(rows, entity, turn))


def chat_stream(rows: DataFrame, *, entity: str, turn: str, k: int = 4, keep: int = 1000, client: Callable[[], Client] = Offline) -> DataFrame:
    """The same over a stream of turns: an entity's memory is state, its turns of a batch are taken in order, and batches in order of arrival."""
    own = _shaped(rows, entity, turn)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        memory, asks = Memory(list(state.get[0]) if state.exists else [], keep), client()
        got = pd.concat(list(parts)).sort_values(["turn", "kind", "text", "needle"], na_position="first")
        out = []
        for r in got.astype(object).where(got.notna(), None).itertuples(index=False):
            said = reply(memory, Turn(r.kind, r.text, r.needle, r.gate), asks, k)
            if said:
                out.append((r.entity, r.turn, *said))
        state.update((memory.items,))
        yield pd.DataFrame(out, columns=[entity, turn, "reply", "n_read"])

    return own.groupBy("entity").applyInPandasWithState(run, _schema(rows, entity, turn), "items array<string>", "append", "NoTimeout")
