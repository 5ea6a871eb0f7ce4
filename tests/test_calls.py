"""Calls side by side: order, pace, refusals, and runs that go on where others stopped."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tidelog.operators import synthesis as sy


class Clock:
    """Time that passes only in sleeps."""

    def __init__(self):
        self.now, self.lock = 0.0, threading.Lock()

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        with self.lock:
            self.now += seconds


def test_pace_keeps_calls_apart():
    clock = Clock()
    pace = sy.Pace(4.0, clock=clock, sleep=clock.sleep)
    starts = []
    for _ in range(9):
        pace.wait()
        starts.append(clock.now)
    assert starts == [i * 0.25 for i in range(9)]
    pace.hold(10.0)
    pace.wait()
    assert clock.now == 12.0


def test_a_refusal_holds_up_the_others():
    clock, starts = Clock(), []

    class Refuses:
        def ask(self, prompt):
            starts.append(clock.now)
            if len(starts) == 1:
                raise sy.RateLimited("429")
            return "{}"

    pace = sy.Pace(1.0, clock=clock, sleep=clock.sleep)
    a, b = (sy.Careful(Refuses, pause=7.0, pace=pace) for _ in range(2))
    a.ask("x")
    b.ask("y")
    assert starts == [0.0, 7.0, 8.0]


def test_order_and_bound_of_concurrent_calls():
    lock, flying, most, taken = threading.Lock(), [0], [0], [0]

    class Slow:
        def ask(self, prompt):
            with lock:
                flying[0] += 1
                most[0] = max(most[0], flying[0])
            time.sleep(0.002 * (int(prompt) % 5))
            with lock:
                flying[0] -= 1
            if prompt == "13":
                raise ValueError("unlucky")
            return prompt

    def source():
        for i in range(60):
            taken[0] += 1
            yield str(i)

    out = []
    for i, got in enumerate(sy.asked_in_order(source(), Slow, 1, 6)):
        out.append(got)
        assert taken[0] <= i + 12 + 1
    assert out == [(None, "ValueError: unlucky") if i == 13 else (str(i), None) for i in range(60)]
    assert 2 <= most[0] <= 6


def test_budget_is_shared_by_tasks(spark):
    class Told:
        def __init__(self, pace):
            self.pace = pace

        def ask(self, prompt):
            return str(self.pace.gap)

    df = spark.range(20).select("id", F.col("id").cast("string").alias("p"))
    got = sy.ask_model(df, "id", "p", Told, per_second=8.0, tasks=4, workers=2)
    assert got.rdd.getNumPartitions() == 4 and {r.reply for r in got.collect()} == {"0.5"}


def listed(folder, bad):
    """A client that writes down each call as a line of a file (a class of this function's, so that tasks get it by value)."""

    class Listed:
        def ask(self, prompt):
            with open(f"{folder}/calls", "a") as f:
                f.write(prompt + "\n")
            if prompt in bad:
                raise ValueError("bad")
            return "re " + prompt

    return Listed


def test_a_rerun_asks_only_the_rest(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 0 else f"p{i}") for i in range(12)] + [(None, "null key")], "k int, p string")
    calls = lambda: (tmp_path / "calls").read_text().split("\n")[:-1] if (tmp_path / "calls").exists() else []
    run = lambda bad: sy.ask_the_rest(df, ["k"], "p", f"{tmp_path}/t", listed(str(tmp_path), bad), rounds=3, attempts=1, workers=3)
    first = {r.k: (r.reply, r.error) for r in run(("p3", "p7")).collect()}
    assert first[3] == (None, "ValueError: bad") and first[5] == ("re p5", None) and first[None] == ("re null key", None) and len(first) == 13
    assert len(calls()) == 13
    second = {r.k: (r.reply, r.error) for r in run(()).collect()}
    assert sorted(calls()[13:]) == ["p3", "p7"] and second[3] == ("re p3", None) and len(second) == 13
    run(())
    assert len(calls()) == 15


def test_a_run_that_is_cut_short_keeps_its_parts(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "k int, p string")
    upsert, turns = sy.VersionedTable.upsert, []

    def once(self, rows):
        if len(turns) == 2:
            raise KeyboardInterrupt
        turns.append(1)
        return upsert(self, rows)

    with monkeypatch.context() as m:
        m.setattr(sy.VersionedTable, "upsert", once)
        with pytest.raises(KeyboardInterrupt):
            sy.ask_the_rest(df, ["k"], "p", f"{tmp_path}/t", listed(str(tmp_path), ()), rounds=4)
    kept = sy.VersionedTable(spark, f"{tmp_path}/t", "k int, reply string", ["k"]).read().count()
    before = len((tmp_path / "calls").read_text().split())
    assert 0 < kept < before < 40
    assert sy.ask_the_rest(df, ["k"], "p", f"{tmp_path}/t", listed(str(tmp_path), ()), rounds=4).count() == 40
    assert len((tmp_path / "calls").read_text().split()) == before + 40 - kept
