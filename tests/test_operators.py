"""Cases that the tables don't hold, and folds that SQL can't state."""

import datetime as dt
import json
import math
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.functions import jsons, nulls, scores, texts, times
from tidelog.operators import events as ev
from tidelog.operators import synthesis as sy


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_lenient_casts(spark):
    df = spark.createDataFrame([("12.0",), ("12.5",), ("x",), ("nan",), (None,), ("7",)], "s string")
    rows = df.select(nulls.lenient(F.col("s"), "bigint").alias("n"), nulls.lenient(F.col("s"), "double").alias("d")).collect()
    assert [r.n for r in rows] == [12, None, None, None, None, 7]
    assert [r.d for r in rows] == [12.0, 12.5, None, None, None, 7.0]


def test_null_markers_stay_apart(spark):
    df = spark.createDataFrame([("nan",), ("___",), ("UNKNOWN",), (" _ \n",), ("real text",)], "s string")
    rows = df.select(nulls.marker_to_null(F.col("s")).isNull().alias("a"), nulls.placeholder_to_null(F.col("s")).isNull().alias("b"), nulls.valid_text(F.col("s")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [(True, False, False), (False, True, False), (False, False, False), (False, True, False), (False, False, True)]


def test_title_knows_more_than_blanks(spark):
    assert one(spark, texts.title(F.lit("cerebrospinal-fluid o'neil 3rd")))[0] == "Cerebrospinal-Fluid O'Neil 3Rd"


def test_sections_in_order(spark):
    text = "x CHIEF: cough\nPlan of care\nPLAN:\n rest "
    got = one(spark, texts.sections(F.lit(text), ["Chief", "Absent", "Plan"]))[0]
    assert got == {"Chief": "cough", "Plan": "of care\nPLAN:\n rest"}


def test_parse_qid_refuses_other_forms(spark):
    df = spark.createDataFrame([("P000001-V2-T0003-T3-N-1",), ("P1-V2",), (None,)], "q string")
    rows = [r.x for r in df.select(texts.parse_qid(F.col("q")).alias("x")).collect()]
    assert tuple(rows[0]) == ("P000001", 2, 3, "T3-N", 1) and rows[1:] == [None, None]


def test_tau_with_ties(spark):
    tau = lambda a, b: one(spark, scores.kendall_tau(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))[0]
    assert tau([1, 2, 3, 4], [1, 2, 3, 4]) == 1 and tau([1, 2], [2, 1]) == -1
    assert abs(tau([1, 1, 2], [1, 2, 3]) - 2 / 6**0.5) < 1e-12
    assert tau([1, 1], [1, 2]) is None and tau([1], [1]) is None


def test_weighted_accuracy_is_clipped(spark):
    acc = lambda p, w: one(spark, scores.weighted_accuracy(F.array(*map(F.lit, p)), F.create_map(*[F.lit(x) for kv in w.items() for x in kv])))[0]
    assert acc(["Give Aspirin now"], {"aspirin": 0.5, "asp": 0.7}) == 1.0
    assert acc(["none"], {"aspirin": 0.5}) == 0.0


def test_decay_clamps(spark):
    assert one(spark, scores.decay(F.lit(-5.0)), scores.decay(F.lit(24.0))) == (1.0, scores_floor := one(spark, scores.decay(F.lit(24.0)))[0]) and abs(scores_floor - 0.01) < 1e-12


def test_rankings(spark):
    df = spark.createDataFrame([("[1, 2]",), ("so [2,1] [3]",), ("ERROR: x",), (None,)], "s string")
    assert [r[0] for r in df.select(jsons.parse_ranking(F.col("s"))).collect()] == [[1, 2], [2, 1], None, None]
    status = df.select(jsons.grading_status(F.col("s"), F.array(F.lit(1), F.lit(2))))
    assert [r[0] for r in status.collect()] == ["VALID", "VALID", "PARSE_FAIL", "MISSING_DATA"]


def test_horizon_is_half_open(spark):
    at = dt.datetime(2024, 1, 1, 12)
    points = spark.createDataFrame([(1, at)], "e int, at timestamp")
    when = [at, at + dt.timedelta(microseconds=1), at + dt.timedelta(hours=24), at + dt.timedelta(hours=24, microseconds=1), at - dt.timedelta(hours=1)]
    events = spark.createDataFrame([(1, t, i) for i, t in enumerate(when)] + [(2, at, 9)], "e int, ts timestamp, i int")
    for width in (None, 24.0, 100.0):
        got = ev.horizon_join(points, events, entity="e", at="at", ts="ts", hours=24, bucket_hours=width)
        assert sorted(r.i for r in got.collect()) == [1, 2]
    fuzzy = events.withColumn("day", F.col("i") == 4)
    assert sorted(r.i for r in ev.horizon_join(points, fuzzy, entity="e", at="at", ts="ts", hours=24, day_only="day").collect()) == [1, 2, 4]


def test_latest_with_null_times(spark):
    df = spark.createDataFrame([(1, 5, "old"), (1, None, "undated"), (1, 9, "new")], "k int, t int, x string")
    assert ev.latest(df, ["k"], ["t"], "x").first().x == "undated"
    assert ev.latest(df, ["k"], ["t"], "x", nulls_win=False).first().x == "new"


def test_dense_ids(spark):
    keys = [3, 1, 1, None, 900, 44]
    got = ev.dense_ids(spark.createDataFrame([(k,) for k in keys], "k int").repartition(5), "k").collect()
    assert sorted((r.k, r.n) for r in got) == [(1, 1), (3, 2), (44, 3), (900, 4)]


def test_visibility_against_a_loop(spark):
    """All combinations of known and unknown places, cutoffs and bounds."""
    visits, times_ = [None, -1, 0, 1, 2], [None, "2024-01-01", "2024-01-02", "2024-01-03"]
    some_visit, some_time = [None, 1], [None, "2024-01-02"]
    rows = [(v, t, cv, ct, uv, ut) for v in visits for t in times_ for cv in some_visit for ct in some_time for uv in some_visit for ut in some_time]
    df = spark.createDataFrame(rows, "v int, t string, cv int, ct string, uv int, ut string")

    def seen(v, t, cv, ct, uv, ut, inclusive):
        v = -1 if v is None else v
        if uv is not None and (v < 0 or v >= uv):
            return False
        if ut is not None and (t is None or t > ut):
            return False
        if ct is not None and t is not None:
            return t <= ct if inclusive else t < ct
        if cv is not None:
            return v >= 0 and (v <= cv if inclusive else v < cv)
        return True

    for inclusive in (False, True):
        got = df.select("*", ev.visible(F.col("v"), F.col("t"), cutoff_visit=F.col("cv"), cutoff_ts=F.col("ct"), until_visit=F.col("uv"), until_ts=F.col("ut"), inclusive=inclusive).alias("s")).collect()
        assert len(got) == len(rows) and all(r.s == seen(*r[:6], inclusive) for r in got)


def test_relative_weight_after_a_first_zero(spark):
    rows = [(u, i, w) for u, ws in enumerate([[0.0, 3.0, -2.0, 0.0, None], [-0.0, 3.0, -2.0], [None, 1.0], [4.0, 1.0, 0.0, float("nan")], [float("inf"), 1.0], [0.0, float("inf"), float("nan")]]) for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "user_id bigint, i int, value double")
    got = [r.relative for r in ev.relative_weight(df, ["user_id"], [F.col("i")], "value").orderBy("user_id", "i").collect()]
    values = ", ".join(f"({u}, {i}, {'NULL' if w is None else repr(str(w))}::DOUBLE)" for u, i, w in rows)
    want = duckdb.sql(f"SELECT value / first_value(value) OVER (PARTITION BY user_id ORDER BY i) FROM (VALUES {values}) v(user_id, i, value) ORDER BY user_id, i").fetchall()
    assert list(map(str, got)) == [str(x) for (x,) in want]


def test_seen_so_far(spark):
    rows = [(1, 7, "b"), (2, 7, "a"), (3, 7, "b"), (4, 7, "c"), (5, 8, "a"), (6, None, "a"), (7, 7, None)]
    got = ev.seen_so_far(spark.createDataFrame(rows, "e int, u int, t string"), "u", "t").collect()
    assert sorted((r.e, r.n) for r in got) == [(1, 3), (2, 1), (3, 3), (4, 4), (5, 1)]


def test_prior_visits_of_every_customer(spark, tmp_path):
    from tidelog.plans import catalog

    rows = [(1, 10, "2024-01-01"), (2, 10, "2024-01-02"), (3, 11, "2024-01-05"), (4, 11, "2024-01-03"), (5, 11, "2024-01-04"), (6, None, "2024-01-01"), (7, None, "2024-01-02")]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.queries()["JOI14_prior_visits"](spark, str(tmp_path)).collect()
    assert sorted((r.o_orderkey, r.prior) for r in got) == [(2, 1), (3, 4), (3, 5), (5, 4)]


def test_packing_against_a_loop(spark):
    rng = random.Random(6)
    rows = [(e, v, p, "x" * rng.randrange(90), rng.random() < 0.3) for e in range(8) for v in range(5) for p in range(5)]
    df = spark.createDataFrame(rows, "e int, v bigint, p bigint, t string, note boolean")
    for cap in (None, 0, 2):
        got = defaultdict(list)
        for r in ev.pack(df, "e", "v", "p", "t", 260, item_chars=60, note=F.col("note"), most_groups=cap).orderBy("e", "place").collect():
            got[r.e].append((r.v, r.p, r.line))
        for e in range(8):
            used, want, groups = 0, [], 0
            for v in (4, 3, 2, 1, 0):
                if cap is not None and groups >= cap:
                    break
                added = False
                for _, _, p, t, _ in sorted((r for r in rows if r[:2] == (e, v)), key=lambda r: (not r[4], r[2])):
                    line = "- " + (t[:60] + " ...[TRUNCATED]" if len(t) > 60 else t)
                    if used + len(line) + 1 > 260:
                        break
                    used, added = used + len(line) + 1, True
                    want.append((v, p, line))
                groups += added
            assert got[e] == want, (cap, e)


def test_ratio_sample_of_a_hot_group(spark):
    rows = [(i, "hot" if i % 4 else None) for i in range(20_000)] + [(30_000 + i, "few") for i in range(7)]
    df = spark.createDataFrame(rows, "i bigint, g string")
    got = ev.ratio_sample(df, "g", ["i"], 0.3).collect()
    n = defaultdict(int)
    for r in got:
        n[r.g] += 1
    assert n == {"hot": 4500, None: 1500, "few": 2} and len({r.i for r in got}) == len(got)
    order = {r.i: r.h for r in df.withColumn("h", ev.keyed_order("7", "i")).collect()}
    picked = {r.i for r in got if r.g == "hot"}
    assert max(order[i] for i in picked) < min(order[i] for i, g in rows if g == "hot" and i not in picked)


def test_careful_client_waits_and_repairs(spark):
    from tidelog.plans.questions import Flaky

    calls = []

    class Strange(Flaky):
        def ask(self, prompt):
            calls.append(prompt)
            return super().ask(prompt)

    own = sy.Careful(Strange, attempts=3, pause=0.0, per_second=1e9)
    assert own.ask("number 5") == '{"answer": "5"}' and calls == ["number 5"] * 3 + [sy.REPAIR + "number 5"]
    with pytest.raises(sy.RateLimited):
        sy.Careful(Strange, attempts=1, pause=0.0, per_second=1e9).ask("number 8")


def test_yaml_settings():
    from tidelog.sources.config import flat, load_config, parse_yaml

    assert parse_yaml("a: 1\nb:\n  c: 'x # y'\n  d:\n  - 1\n  - two\ne: ~ # none\n") == {"a": 1, "b": {"c": "x # y", "d": [1, "two"]}, "e": None}
    assert load_config({"a": 1, "b": {"c": 2, "d": 3}}, text='{"b": {"c": 5}}', a=9) == {"a": 9, "b": {"c": 5, "d": 3}}
    assert load_config({"a": 1}) == {"a": 1} and flat({"a": {"b": [1]}, "c": "t"}) == {"a.b": "[1]", "c": "t"}
    with pytest.raises(ValueError):
        parse_yaml("a: 1\n    b: 2\n  c")


def test_chart_refuses_too_many_bars(spark, tmp_path):
    from tidelog.sources import writers

    with pytest.raises(ValueError):
        writers.write_bar_chart(spark.range(30).selectExpr("id", "id AS n"), f"{tmp_path}/x", "id", "n", most=20)


def test_failed_calls_are_rows(spark):
    from tidelog.plans.sequences import Failing

    df = spark.createDataFrame([(i, str(i)) for i in range(4)], "k int, prompt string")
    rows = sorted(sy.ask_model(df, "k", "prompt", Failing).collect())
    assert [r.reply for r in rows] == ["0", None, "2", None] and [r.error for r in rows] == [None, "ValueError: odd"] * 2


def test_times(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024-01-02T03:04:05",), ("2024-01-02",), ("soon",), (None,)], "s string")
    got = [r[0] for r in df.select(times.parse_time(F.col("s"))).collect()]
    assert got[0] == got[1] == dt.datetime(2024, 1, 2, 3, 4, 5) and got[2] == dt.datetime(2024, 1, 2) and got[3:] == [None, None]


def test_percentiles_by_selection(spark):
    """Every size of bucket gives what sorting gives: signs, wide exponents, many ties, nulls, a null group."""
    from tidelog.operators import rollups

    rng = random.Random(2)
    groups = {"wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(500)], "ties": [float(rng.randint(0, 3)) for _ in range(400)], "one": [7.5], "none": [None, None]}
    groups[None] = [rng.gauss(0, 1) for _ in range(301)] + [None, -0.0, 0.0, float("inf"), float("-inf")]
    df = spark.createDataFrame([(g, v, 1) for g, vs in groups.items() for v in vs], "g string, v double, x int").repartition(4)
    points = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p100": 1.0}
    for options in ({}, {"direct": 50}, {"direct": 1, "step": 8}):
        got = {r.g: r for r in rollups.percentiles(df, "v", ["g"], points, **options).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            own = sorted(v for v in vs if v is not None)
            for name, p in points.items():
                at = p * (len(own) - 1)
                want = None
                if own:
                    a, b = own[int(at)], own[-int(-at // 1)]
                    want = a if a == b else (-int(-at // 1) - at) * a + (at - int(at)) * b
                assert got[g][name] == pytest.approx(want, rel=1e-12) if own else got[g][name] is None, (g, name)
    whole = rollups.percentiles(df.where("g = 'ties'"), "v", [], {"m": 0.5}).collect()
    assert [r.m for r in whole] == [sorted(groups["ties"])[199] / 2 + sorted(groups["ties"])[200] / 2]
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double")
    assert rollups.percentiles(nan, "v", [], {"m": 0.5}).first().m == 2.0
    assert rollups.percentiles(df.where("false"), "v", ["g"], points).collect() == []


def test_tau_of_a_long_list(spark):
    """50,000 values with ties: counted pairs from a table of counts."""
    import numpy as np

    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 40, 50_000), rng.integers(0, 30, 50_000)
    table = np.zeros((40, 30), np.int64)
    np.add.at(table, (x, y), 1)
    above = np.cumsum(np.cumsum(table[::-1, ::-1], 0), 1)[::-1, ::-1]
    below = np.cumsum(np.cumsum(table[::-1], 0), 1)[::-1]
    con = sum(int(table[i, j]) * int(above[i + 1, j + 1]) for i in range(39) for j in range(29))
    dis = sum(int(table[i, j]) * int(below[i + 1, j - 1]) for i in range(39) for j in range(1, 30))
    ties = lambda k: sum(int(v) * (int(v) - 1) // 2 for v in k)
    pairs = 50_000 * 49_999 // 2
    want = (con - dis) / math.sqrt((pairs - ties(table.sum(1))) * (pairs - ties(table.sum(0))))
    df = spark.createDataFrame([(x.tolist(), y.tolist())], "a array<int>, b array<int>")
    assert abs(df.select(scores.kendall_tau(F.col("a"), F.col("b"))).first()[0] - want) < 1e-12


def test_tau_against_pairs(spark):
    rng = random.Random(7)
    rows = [([rng.choice([1.0, 2.0, 3.0, 4.5]) for _ in range(n)], [rng.randint(0, 3) * 1.0 for _ in range(n)]) for n in range(12) for _ in range(5)]
    odd = [(None, [1.0]), ([1.0, 2.0], [1.0]), ([1.0, None], [1.0, 2.0]), ([], [])]
    got = [r[0] for r in spark.createDataFrame(rows + odd, "a array<double>, b array<double>").select(scores.kendall_tau(F.col("a"), F.col("b"))).collect()]
    sign = lambda v: (v > 0) - (v < 0)
    for (a, b), tau in zip(rows, got, strict=False):
        s = [(sign(a[i] - a[j]), sign(b[i] - b[j])) for i in range(len(a)) for j in range(i)]
        n = sum(p != 0 for p, _ in s) * sum(q != 0 for _, q in s)
        assert (tau is None) == (n == 0) and (tau is None or abs(tau - sum(p * q for p, q in s) / n**0.5) < 1e-12)
    assert got[len(rows) :] == [None] * 4


def test_histories_by_reference(spark):
    rng = random.Random(8)
    rows = [(e, rng.randint(0, 20), i) for i, e in enumerate(["hot"] * 300 + ["a"] * 5 + ["one", None, None])]
    df = spark.createDataFrame(rows, "e string, t int, i int").repartition(6)
    for size in (1, 7, 1024):
        own = ev.history_by_reference(df, "e", ["t", "i"], "i", size)
        assert max(len(r["items"]) for r in own.chunks.collect()) <= size and own.rows.count() == len(rows)
        got = {r.i: r.history for r in own.expand(own.rows, "i").collect()}
        for e, t, i in rows:
            assert got[i] == [j for _, j in sorted((u, j) for f, u, j in rows if f == e and (u, j) <= (t, i))]
        assert [r.i for r in own.expand(own.rows.where("i = 304"), "i").collect()] == [304]


def test_packing_an_entity_larger_than_a_batch(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = [("e", v, p, "x" * (1 + (v * p) % 40)) for v in range(40) for p in range(25)] + [(None, 1, 1, None)]
        df = spark.createDataFrame(rows, "e string, v bigint, p bigint, t string")
        got = ev.pack(df, "e", "v", "p", "t", 3000).orderBy("place").collect()
        used, want = 0, []
        for v in range(39, -1, -1):
            for p in range(25):
                size = 3 + 1 + (v * p) % 40
                if used + size > 3000:
                    break
                used += size
                want.append((v, p))
        assert [(r.v, r.p) for r in got if r.e] == want and len(want) > 50
        assert [(r.place, r.line) for r in got if r.e is None] == [(0, "- ")]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_placeholders_at_any_depth(spark):
    from pyspark.sql import types as T

    doc = {"a": "___", "b": [" _ ", "x_", ["", {"c": "\t", "k___": "_ _"}]], "m": {"___": "y", "n": None}, "i": 7, "f": 1.5, "t": True, "u": "é_"}
    want = {"a": None, "b": [None, "x_", [None, {"c": None, "k___": "_ _"}]], "m": {"___": "y", "n": None}, "i": 7, "f": 1.5, "t": True, "u": "é_"}
    df = spark.createDataFrame([(json.dumps(doc),), (None,), ('"__"',), ("[]",)], "s string").select(F.parse_json("s").alias("v"))
    got = [r[0] for r in df.select(F.to_json(nulls.without_placeholders(F.col("v"), T.VariantType()))).collect()]
    assert json.loads(got[0]) == want and got[1:] == [None, "null", "[]"]
    kind = "struct<a: string, b: array<struct<c: string>>, m: map<string, array<string>>, n: int>"
    typed = spark.createDataFrame([((" __", [("_",), None, ("ok",)], {"__": ["", None, "z"]}, 3),), (None,)], f"d {kind}")
    rows = [r[0] for r in typed.select(nulls.without_placeholders(F.col("d"), typed.schema["d"].dataType)).collect()]
    assert rows[1] is None and (rows[0].a, [x and x.c for x in rows[0].b], rows[0].m, rows[0].n) == (None, [None, None, "ok"], {"__": [None, None, "z"]}, 3)


def test_lexical_search_by_index(spark):
    """The index against the loop: short, rare, absent, odd and empty needles; one entity of many documents, one small."""
    from tidelog.operators import vectors

    rng = random.Random(12)
    words = ["Blue", "green.", "réd", "blu", "99%", "a_b", "中文字", ""]
    docs = [("hot" if i % 9 else "few", i, None if i % 31 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))) for i in range(400)] + [(None, 500, "blue")]
    needles = ["BLUE", "b", "", None, "zzz", "n. r", "%", "_b", "文", "RÉD", "blue green. blue"]
    queries = [(e, f"{e}{i}", n) for e in ("hot", "few", "none", None) for i, n in enumerate(needles)]
    left, right = spark.createDataFrame(queries, "e string, q string, needle string"), spark.createDataFrame(docs, "e string, p int, body string").repartition(4)
    for direct in (10_000, 100):
        got = defaultdict(list)
        for r in vectors.lexical(left, right, entity="e", query_id="q", needle="needle", text="body", position="p", k=7, direct=direct).orderBy("q", "rank").collect():
            got[r.q].append((r.score, r.p, r.e, r.body))
        each = vectors.lexical(spark.createDataFrame([("hot", "N. R"), ("few", "b")], "e string, needle string"), right, entity="e", query_id="e", needle="needle", text="body", position="p", k=3, direct=direct)
        assert sorted((r.e, r["rank"]) for r in each.collect()) == [(e, i) for e in ("few", "hot") for i in (1, 2, 3)]
        for e, q, n in queries:
            own = [(1.0 if t is not None and (n or "").lower() in t.lower() else 0.1, p, f, t) for f, p, t in docs if e is not None and f == e]
            assert got[q] == sorted(own, key=lambda x: (-x[0], x[1]))[:7], (direct, q, n)


def test_stores_pages_and_deletes(spark, tmp_path):
    from tidelog.operators import memory
    from tidelog.sources import versions

    items = spark.range(25).select(F.col("id").alias("k"), (F.col("id") % 3).alias("user_id"))
    listed = memory.pages(items.where("user_id = 1"), ["k"], 3)
    assert [(r.k, r.page) for r in listed.orderBy("k").collect()] == [(k, i // 3 + 1) for i, k in enumerate(range(1, 25, 3))]
    calls = []

    def refuses(table, rows):
        calls.append(sorted(r.k for r in rows.collect()))
        if len(calls) == 1:
            raise OSError("too many")
        return table.delete(rows)

    table = versions.VersionedTable(spark, f"{tmp_path}/t", "k bigint, user_id bigint", ["k"])
    table.upsert(items)
    assert memory.delete_pages(table, listed, refuses) == 3 and [len(x) for x in calls] == [8, 3, 3, 2]
    assert sorted(r.k for r in table.read().collect()) == [k for k in range(25) if k % 3 != 1]
    store = memory.FrameStore(items, most=2)
    for i in range(5):
        store.delete({"user_id": None}, {"k": i})
        store.add(spark.createDataFrame([(100 + i, 0)], "k bigint, user_id bigint"))
    assert sorted(r.k for r in store.items.collect()) == [*range(5, 25), *range(100, 105)]
    with pytest.raises(ValueError):
        store.delete({"user_id": None}, {"k": None})
    stores = memory.EntityStores(spark, f"{tmp_path}/s", items.schema, "user_id")
    assert stores.read().count() == 0 and stores.build(items.where("user_id = 0")) == 1 and stores.build(items) == 2 and stores.build(items) == 0
    assert sorted(r.k for r in stores.read().collect()) == list(range(25))


def test_increments_and_contexts(spark):
    rows = [("a", 0, "m"), ("a", 1, "x"), ("a", 2, "y"), ("a", 3, "m"), ("a", 4, "m"), ("a", 5, "z"), ("b", 0, "x"), ("c", 1, None), ("c", 2, "m"), (None, 1, "x"), (None, 2, "m")]
    df = spark.createDataFrame(rows, "e string, t int, x string").repartition(3)
    got = ev.increments(df, "e", ["t"], F.col("x") == "m", F.col("x")).collect()
    assert sorted(((r.e, r.t, r["items"]) for r in got), key=str) == sorted([("a", 0, []), ("a", 3, ["x", "y"]), ("a", 4, []), ("c", 2, [None]), (None, 2, ["x"])], key=str)
    asked = spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), ("gone", 3)], "e string, q int")
    told = {r.e: (r.qids, r.n_rows, r.context) for r in ev.contexts(asked, df, visit="e", qid="q", order=["t"], line=F.concat_ws("-", F.col("t").cast("string"), "x")).collect()}
    assert told == {"a": ([1, 2], 6, "0-m\n1-x\n2-y\n3-m\n4-m\n5-z"), "gone": ([3], 0, None)}
