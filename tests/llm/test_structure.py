"""Conversation repair, clustering and sharding against brute force, and their SQL on rows that the tables don't hold."""

import hashlib
import itertools
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import centroid_clustering, conversation_repair, feistel_shards, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    """The contract's damage, row by row; a conversation's rows by turn, role and digest."""
    out = {}
    for conv, turn, role, text in rows:
        sp = lambda v: " " if v is None else str(v)
        role, text, draw = sp(role), sp(text), zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        text = "" if draw == 1 else text.translate({ord(c): None for c in ".!?"}) if draw == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1))
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    return out


def by_tables(rows):
    """All best ways by dynamic programming over the rows, each with its audit and repaired lines."""
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(BLANK)
        faults.append("blank" if not core else "again" if (role, text) in seen else "open" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    want = {0: "u", 1: "u", 2: "a", 3: "u"}
    best = {0: (0, "", ())}

    def inserted(best):
        for _ in range(3):
            for s, (c, a, lines) in list(best.items()):
                to = 3 if s == 2 else 2
                way = (c + 5, a + "I", (*lines, ("user:" if to == 2 else "assistant:")))
                best[to] = min(best.get(to, way), way)
        return best

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def put(to, way, new=new):
            new[to] = min(new.get(to, way), way)

        for s, (c, a, lines) in inserted(dict(best)).items():
            put(s, (c + 2, a + "D", lines))
            if fault in ("blank", "again"):
                continue
            worse = 5 * (fault == "open")
            put(3 if s == 2 else 2, (c + 1 + worse, a + "R", (*lines, f"{'assistant' if s == 2 else 'user'}:{text}")))
            initial = role[:1]
            if initial == want[s] or (s == 0 and initial == "s"):
                put({"s": 1, "u": 2, "a": 3}[initial], (c + worse, a + "K", (*lines, f"{role}:{text}")))
        best = new
    cost, audit, lines = min(way for s, way in inserted(dict(best)).items() if s in (0, 3))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = Counter(faults)
    return (gaps, count["blank"], count["again"], count["open"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


@pytest.fixture(scope="module")
def talk():
    """Conversations short, long, dropped, with nulls, ties, odd roles and blanks."""
    rng = random.Random(3)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "util"])
            text = rng.choice(["Yes.", "No", "", " \n", None, "a\u0085", "end. ", "Long text, it goes on. " * 3, f"own {turn}!", "tail. \t\x0b", "été?"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    rows += [(100, t, ["user", "assistant"][t % 2], f"text {t % 7}" + "." * (t % 3 > 0)) for t in range(300)]
    rows += [(101, 5, "user", "the same.")] * 50 + [(102, t // 40, "ua"[t % 2], f"s{t}.") for t in range(200)]
    return rows


def frame(spark, rows):
    """Columns that clash with inner names beside those that count."""
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return df.select("*", F.lit(1).alias("conv"), F.lit("x").alias("n"), F.lit(2).alias("digest"), F.lit(3).alias("piece"))


@pytest.mark.parametrize("piece", [1024, 7])
def test_repair_against_tables(spark, talk, piece):
    got = {r.conv: tuple(r)[1:] for r in conversation_repair.repair_report(conversation_repair.damaged(frame(spark, talk)), piece).collect()}
    after = damaged(talk)
    assert set(got) == {r[0] for r in talk}
    for conv in got:
        assert got[conv] == by_tables(after[conv])[0], conv


def test_repaired_rows_read_as_the_grammar(spark, talk):
    rows = conversation_repair.undamaged(frame(spark, talk))
    _, edits = conversation_repair.solved(rows, 16)
    out = {}
    for r in conversation_repair.repaired(rows, edits).collect():
        out.setdefault(r.conv, []).append(r)
    for conv, lines in out.items():
        lines.sort(key=lambda r: r.place)
        assert [r.place for r in lines] == list(range(len(lines)))
        initials = "".join(r.role[:1] for r in lines)
        assert initials.lstrip("s") == "ua" * (len(initials.lstrip("s")) // 2) and initials.count("s") <= 1, conv
        assert all(r.text == "" for r in lines if r.edit == "I")


def test_dijkstra_tries_all_edits():
    """Every edit script of short conversations, one by one."""
    rng = random.Random(9)
    for _ in range(150):
        steps = [(rng.choice("suat"), rng.random() < 0.3, 0) if rng.random() < 0.8 else ("", False, 1) for _ in range(rng.randint(0, 3))]
        best = None
        for edits in itertools.product("KRD", repeat=len(steps)):
            for extra in itertools.product(range(3), repeat=len(steps) + 1):
                cost, audit, read = 0, "", ""
                options = [""]
                for i in range(len(steps) + 1):
                    options = [o + "".join(x) for o in options for x in itertools.product("ua", repeat=extra[i])]
                    audit += "I" * extra[i]
                    cost += 5 * extra[i]
                    if i == len(steps):
                        break
                    (initial, open_, forced), e = steps[i], edits[i]
                    cost += {"K": 0, "R": 1, "D": 2}[e] + 5 * (open_ and e != "D") + 1000 * (bool(forced) and e != "D")
                    audit += e
                    options = [o + x for o in options for x in {"K": [initial], "R": "ua", "D": [""]}[e]]
                for read in options:
                    tail = read[1:] if read[:1] == "s" else read
                    if read == "" or (tail and tail == "ua" * (len(tail) // 2)):
                        best = min(best or (cost, audit), (cost, audit))
        assert conversation_repair.cheapest(steps) == best, steps


def test_repair_of_nothing(spark, talk):
    none = frame(spark, talk).where("false")
    assert conversation_repair.repair_report(conversation_repair.damaged(none)).collect() == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = conversation_repair.repair_report(conversation_repair.damaged(frame(spark, [(dropped, 0, "user", "Hello.")]))).first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_hamerly_clusters", "op13_feistel_shards"])
def test_queries_equal_sql(spark, talk, tmp_path, name):
    rng = random.Random(8)
    vectors = [(i, [rng.gauss(0, 0.3) for _ in range(64)]) for i in range(90)]
    vectors += [(5, vectors[0][1]), (None, vectors[1][1]), (200, None), (201, []), (202, [0.0] * 64), (203, [math.nan] * 64), (204, [math.inf] + [0.0] * 63), (205, [None] + [0.0] * 63), (206, [1.0] * 63), (207, [0.0] * 64)]
    texts = [(i % 40, None if i % 11 == 0 else "" if i % 13 == 0 else f"text ü中 {i % 9} " * (i % 5)) for i in range(300)] + [(None, None), (None, "x" * 3000)]
    frame(spark, talk).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = queries.QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def lloyd(x, seeds, rounds):
    c = x[seeds].copy()
    for turn in range(rounds + 1):
        d = ((x[:, None] - c) ** 2).sum(2)
        own = d.argmin(1)
        if turn < rounds:
            c = np.array([np.floor_divide(x[own == j].sum(0), (own == j).sum()) if (own == j).any() else c[j] for j in range(len(c))])
    return own, d[np.arange(len(x)), own], c


def test_bounds_give_the_clusters_of_full_scans(spark):
    rng = np.random.default_rng(4)
    # Few values, so that many distances are equal; some rows repeat.
    x = rng.integers(-3, 4, (600, 4))
    x = np.concatenate([x, x[:200], np.zeros((30, 4), np.int64)])
    rows = [(i, [float(v) for v in r], 1, 2.0) for i, r in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cluster int, upper double").repartition(5)
    for k, rounds in ((7, 6), (1, 2), (900, 1)):
        out, centroids, scans = centroid_clustering.centroid_clusters(df, k=k, rounds=rounds, dim=4, scale=1, rows_per_bucket=100)
        order = sorted(range(len(x)), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:k]
        own, distance, c = lloyd(x, order, rounds)
        got = sorted((r.id, r.cluster, r.distance, r.cluster_inertia, r.inertia) for r in out.collect())
        assert got == [(i, own[i], distance[i], distance[own == own[i]].sum(), distance.sum()) for i in range(len(x))]
        assert (centroids == c).all() and scans[0] == len(x)


def test_bounds_spare_scans(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(5 * i, 0.2, (200, 8)) for i in range(5)])
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    _, _, scans = centroid_clustering.centroid_clusters(df, k=20, rounds=15, dim=8)
    assert scans[0] == 1000 and sum(scans[1:]) < 0.5 * 1000 * 15, scans


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, [0.5]), (2, None)], "vec_id bigint, embedding array<double>")
    out, centroids, scans = centroid_clustering.centroid_clusters(df)
    assert out.collect() == [] and len(centroids) == 0 and scans == []
    one, _, _ = centroid_clustering.centroid_clusters(spark.createDataFrame([("a", [0.5] * 64), ("b", [2.0**18] * 64)], "vec_id string, embedding array<double>"))
    assert [(r.id, r.cluster, r.distance) for r in one.collect()] == [("a", 0, 0)]


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_network_is_a_permutation(n):
    numbers = np.arange(n)
    place = feistel_shards.permuted(numbers, n, 11)
    assert sorted(place.tolist()) == list(range(n))
    shard, slot = feistel_shards.placed(numbers, n, 7, 11)
    assert (feistel_shards.number_at(shard, slot, n, 7, 11) == numbers).all()
    assert n < 100 or (place != feistel_shards.permuted(numbers, n, 12)).mean() > 0.9


def test_shuffle_is_spread():
    n = 100_000
    place = feistel_shards.permuted(np.arange(n), n, 0).astype(np.int64)
    assert abs(np.corrcoef(np.arange(n), place)[0, 1]) < 0.02
    # Neighbours part: the distance of two random places is n / 3 on average.
    assert abs(np.abs(np.diff(place)).mean() / (n / 3) - 1) < 0.02
    # A run of numbers falls on all shards alike: chi-square of 40 shards, 39 degrees of freedom.
    seen = np.bincount(place[:4000] % 40, minlength=40)
    assert ((seen - 100) ** 2 / 100).sum() < 75


def test_shards_are_whole_and_the_same_again(spark, docs, corpus, tmp_path):
    clash = docs.withColumns({"shard": F.lit("s"), "slot": F.lit(None).cast("string"), "number": F.lit(1), "row": F.lit(0)})
    seen = []
    for parts in (1, 6):
        out = feistel_shards.sharded(clash.repartition(parts), shards=7, seed=3).collect()
        seen.append(sorted((r.number, r.shard, r.slot, str(r.row)) for r in out))
        assert [r[0] for r in seen[-1]] == list(range(len(corpus)))
        count = Counter(r.shard for r in out)
        assert max(count.values()) - min(count.values()) <= 1
        assert all(sorted(r.slot for r in out if r.shard == s) == list(range(count[s])) for s in count)
    assert seen[0] == seen[1]
    assert Counter(str(r.row) for r in out) == Counter(str(r) for r in clash.select("doc_id", *[c for c in clash.columns if c != "doc_id"]).collect())
    feistel_shards.write_shards(clash, f"{tmp_path}/shards", shards=7, seed=3, files=3)
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert sorted((r.shard, r.slot, str(r.row)) for r in back) == sorted(r[1:] for r in seen[0])


def test_many_copies_are_numbered_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(feistel_shards, "COPIES", 10)
    rows = spark.createDataFrame([(1, "a")] * 95 + [(2, "b")] + [(None, None)] * 12, "doc_id bigint, text string")
    out = feistel_shards.sharded(rows, shards=5).collect()
    assert sorted(r.number for r in out) == list(range(108)) and sorted((r.number, r.row.doc_id) for r in out)[:13] == [(i, None) for i in range(12)] + [(12, 1)]
    assert feistel_shards.sharded(rows.where("false")).collect() == []
    assert sorted((r.shard, r.slot) for r in feistel_shards.sharded(rows.limit(2), shards=9).collect()) in [sorted(x) for x in itertools.permutations([(0, 0), (1, 0)], 2)]
