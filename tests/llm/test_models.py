"""Models, search, joins and the tokenizer against brute force, references and planted cases."""

import base64
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidelog.llm import anisotropic_ann, bpe, brown_lm, jaccard_join, kn_quality, toxicity
from tidelog.llm.components import components

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_brown_base_score(docs, corpus, no_docs):
    rows = brown_lm.brown_scores(docs, toxicity.held_out(F.col("doc_id"), 7), classes=6, head=20, tails=8).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    seen = Counter()
    for i, t, *_ in corpus:
        if not held(i):
            seen.update([*BLANK.findall(lower(t)), "\n"])
    n, v = sum(seen.values()), len(seen)
    want = Counter()
    for i, t, *_ in corpus:
        w = [*BLANK.findall(lower(t)), "\n"]
        want[(i, held(i), len(w), sum(seen[x] > 0 for x in w), n, round(sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert brown_lm.brown_scores(no_docs, F.lit(False)).collect() == []


def test_brown_score_by_definition(spark):
    rng = random.Random(23)
    kinds = [["cat", "dog", "hen"], ["eats", "sees"], ["the", "a"], ["big", "red", "old"]]
    say = lambda: " ".join(w for _ in range(rng.randrange(1, 4)) for w in (rng.choice(kinds[2]), rng.choice(kinds[3]), rng.choice(kinds[0]), rng.choice(kinds[1])))
    rows = [(i, say() if i % 9 else "", False) for i in range(60)] + [(100 + i, f"{say()} new{i} the", True) for i in range(5)] + [(200, None, True)]
    classes, tails, mu, delta = 5, 3, 50.0, 0.5
    got = {r.doc_id: r for r in brown_lm.brown_scores(spark.createDataFrame(rows, "doc_id bigint, text string, held boolean"), F.col("held"), classes=classes, head=50, tails=tails, mu=mu, delta=delta).collect()}
    train = [BLANK.findall(lower(t)) for _, t, held in rows if not held]
    seen = Counter(w for t in train for w in t)
    names = sorted(seen, key=lambda w: (-seen[w], w))
    end = len(names) + tails
    unit = lambda w: names.index(w) if w in seen else len(names) + brown_lm.tail_of(w.encode(), tails)
    pairs = np.zeros((end + 1, end + 1))
    for t in train:
        u = [end, *map(unit, t), end]
        for a, b in zip(u, u[1:]):
            pairs[a, b] += 1
    of = brown_lm.exchange(pairs, classes, 6)
    move = Counter((of[a], of[b]) for a in range(end + 1) for b in range(end + 1) for _ in range(int(pairs[a, b])))
    total, into, out = sum(move.values()), Counter(), Counter()
    for (a, b), n in move.items():
        into[b] += n
        out[a] += n
    step = lambda a, b: (move[a, b] + mu * (into[b] + 1) / (total + classes)) / (out[a] + mu)
    members = Counter(of[unit(w)] for w in seen)
    members[of[end]] += 1
    emit = lambda n, k: (n + delta) / (into[k] + delta * (members[k] + 1))
    for k in range(classes):
        own = [seen[w] for w in seen if of[unit(w)] == k] + ([len(train)] if of[end] == k else [])
        assert abs(sum(emit(n, k) for n in [*own, 0]) - 1) < 1e-9 and abs(sum(step(k, b) for b in range(classes)) - 1) < 1e-9
    for i, t, _ in rows:
        w, before, want = BLANK.findall(lower(t)), of[end], 0.0
        for x in [*w, None]:
            k, n = (of[end], len(train)) if x is None else (of[unit(x)], seen[x])
            want += math.log10(step(before, k)) + math.log10(emit(n, k))
            before = k
        assert abs(got[i].score - want) < 1e-6, i


def test_brown_places_words_outside_the_head(spark):
    # Rare words of two kinds that end alike: their own neighbours, not their ending, must tell them apart.
    train = [f"{f} {n}{i}xyz" for i in range(40) for f, n in (("the", "n"), ("we", "v"), ("the", "n"), ("we", "v"))] + ["the cat", "we eat"] * 20
    rows = [(i, t, False) for i, t in enumerate(train)] + [(1000, "the n7xyz", True), (1001, "the v7xyz", True)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, held boolean")
    got = {r.doc_id: r for r in brown_lm.brown_scores(d, F.col("held"), classes=6, head=4, tails=1).collect()}
    assert got[1000].base_score == got[1001].base_score and got[1000].score > got[1001].score + 0.5


def test_exchange_finds_classes():
    # Two kinds of words that alternate: the exchange must tell them apart.
    rng = np.random.default_rng(1)
    pairs = np.zeros((9, 9))
    for a in range(4):
        for b in range(4, 8):
            pairs[a, b], pairs[b, a] = rng.integers(50, 99), rng.integers(50, 99)
    of = brown_lm.exchange(pairs, 3, 10)
    assert len(set(of[:4])) == 1 and len(set(of[4:8])) == 1 and of[0] != of[4] and of[8] == 0


def planted(spark, n=600):
    rng = random.Random(3)
    say = lambda k: " ".join(rng.choice(["river", "stone", "cloud", "green", "walk", "under", "light"]) for _ in range(k))
    rows, marks = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = ". ".join([say(6), say(5) + (" grumblefoot" if bad else ""), say(7)])
        rows.append((i, text, "en", "s", len(text)))
        marks.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_toxicity_finds_sentences(spark, docs, no_docs, labels):
    d, l = planted(spark)
    rows = toxicity.toxicity(d, l).collect()
    for r in rows:
        assert r.predicted == int(r.doc_id % 5 == 0), r
    texts = {r.doc_id: r.text for r in d.collect()}
    for r in rows:
        if r.predicted:
            assert any("grumblefoot" in texts[r.doc_id][s.start : s.end] for s in r.offending)
    model = toxicity.train(d, l, fit_rows=100, fit_words=10_000)
    assert toxicity.keep_clean(d, model).count() == 480 and toxicity.keep_clean(d, model).columns == d.columns
    some = toxicity.toxicity(docs, labels).collect()
    assert len(some) == docs.count() and all(0 <= r.score <= 1 for r in some)
    assert toxicity.toxicity(no_docs, labels).collect() == []
    assert len(toxicity.toxicity(docs, labels.where("false")).collect()) == docs.count()


def test_toxicity_leaves_out_only_what_does_not_fit(spark):
    d, l = planted(spark)
    huge = [(10_000 + i, "river stone " * 6000 if i % 2 else "river.stone." * 8000, "en", "s", 96_000) for i in range(20)]
    more = d.unionByName(spark.createDataFrame(huge, d.schema))
    marks = l.unionByName(spark.createDataFrame([(r[0], 1, 0) for r in huge], l.schema))
    model = toxicity.train(more, marks, fit_rows=4000, fit_words=11_500)
    assert toxicity.keep_clean(d, model).count() == 480
    # Nothing fits: the labelled proportion.
    w, bias = toxicity.train(d, l, fit_rows=4000, fit_words=3)
    assert not w.any() and abs(1 / (1 + math.exp(-bias)) - 0.2) < 1e-9


def test_toxicity_learns_from_every_labelled_document(spark):
    """The word of the last hundred toxic documents, in the order of their ids' hashes, is one that the first fit never meets."""
    d, l = planted(spark, 3000)
    order = [r.doc_id for r in l.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    late = d.withColumn("text", F.when(F.col("doc_id").isin(order[500:]), F.replace("text", F.lit("grumblefoot"), F.lit("snarkwort"))).otherwise(F.col("text")))
    start = toxicity.train(late, l, fit_rows=500, fit_words=100_000)
    assert toxicity.keep_clean(late, start).count() == 2500
    models = [toxicity.train_all(x, l, fit_rows=500, fit_words=100_000) for x in (late.repartition(7), late.coalesce(1))]
    assert toxicity.keep_clean(late, models[0]).count() == 2400
    assert models[0][1] == models[1][1] and (models[0][0] == models[1][0]).all()
    # The sums over blocks are those of all documents at once.
    own = late.join(toxicity.learnable(l, "toxic"), "doc_id")
    bags = toxicity.bagged(own)
    rows = bags.toArrow()
    y, whole, every = rows.column("y").to_numpy(), toxicity.Bags.of(rows), np.arange(toxicity.BUCKETS, dtype=np.int32)
    v, scale = np.random.default_rng(2).normal(size=toxicity.BUCKETS), np.array([0.0002, 0.0003])
    grad, bias = toxicity.slopes([whole], y, scale[y], v, -1.0)
    summed, summed_bias = toxicity.summed(toxicity.packed(bags, every, 5), scale, v, -1.0)
    assert np.allclose(grad, summed, atol=1e-10) and abs(bias - summed_bias) < 1e-10
    held = toxicity.held_by(bags)
    assert (held[0] == whole.documents_with(y == 0)).all() and (held[1] == whole.documents_with(y == 1)).all()


def test_toxicity_shuffles_labelled_texts_only(spark, monkeypatch):
    d, l = planted(spark, 3000)
    few = l.where("doc_id % 10 < 3")
    met, labelled_rows = [], toxicity.labelled_rows

    def told(*given):
        met.extend(labelled_rows(*given).collect())
        return labelled_rows(*given)

    monkeypatch.setattr(toxicity, "labelled_rows", told)
    toxicity.train_all(d, few, fit_rows=100, fit_words=100_000, rounds=(1,))
    ids = {r.doc_id for r in met}
    assert {i for i in range(3000) if i % 10 < 3} <= ids and len(ids) < 1000
    # Ids of two types are hashed apart and yet equal to a join.
    assert labelled_rows(d, few.withColumn("doc_id", F.col("doc_id").cast("int")), 900).count() == 3000


def test_toxicity_rounds_take_few_tasks(spark):
    """However many partitions shuffles have, a round's gradients are added up by few tasks: the driver keeps a record of each."""
    rng = np.random.default_rng(3)
    schema = "y binary, f binary, n binary, d binary"
    place = lambda n: rng.integers(0, 70_000, n)
    rows = [tuple(np.asarray(x, "<i4").tobytes() for x in ([0, 1], place(9), [2, 3, 4], [1, 2])) for _ in range(24)]
    v, scale = rng.normal(size=70_000), np.array([0.5, 0.25])
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, x in names.items():
            spark.conf.set(k, x)
        spark.sparkContext.setJobGroup("rounds", "")
        grad, bias = toxicity.summed(spark.createDataFrame(rows, schema).repartition(6), scale, v, 0.5)
        status = spark.sparkContext.statusTracker()
        stages = {s for j in status.getJobIdsForGroup("rounds") for s in status.getJobInfo(j).stageIds}
        tasks = sum(status.getStageInfo(s).numTasks for s in stages)
        assert 0 < tasks < 64
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, x in before.items():
            spark.conf.set(k, x)
    # To the bit what the blocks give one by one, in any order.
    each = [toxicity.slopes([bags], y, scale[y], v, 0.5) for y, bags in (toxicity.unpacked(pa.RecordBatch.from_pylist([dict(zip("yfnd", r, strict=True))]), 0) for r in rows)]
    want = sum(np.rint(np.append(*x) * toxicity.FINE).astype(np.int64) for x in each) / toxicity.FINE
    assert (grad == want[:-1]).all() and bias == want[-1]


def test_toxicity_takes_any_id_and_chooses_by_content(spark):
    d, l = planted(spark)
    name = F.concat(F.lit("k"), F.col("doc_id").cast("string"))
    named, marks = d.withColumn("doc_id", name), l.withColumn("doc_id", name)
    rows = toxicity.toxicity(named, marks).collect()
    assert all(r.predicted == int(int(r.doc_id[1:]) % 5 == 0) for r in rows)
    # A second text under every third id: whichever row comes first, the same model comes out.
    twice = d.unionByName(d.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("other words. "), "text")))
    models = [toxicity.train(x, l, fit_rows=4000, fit_words=100_000) for x in (twice.coalesce(1), twice.orderBy(F.desc("text")).repartition(5))]
    assert models[0][1] == models[1][1] and (models[0][0] == models[1][0]).all()
    long = spark.createDataFrame([(1, "calm words " * 200_000 + "grumblefoot"), (2, "calm " * 200_000)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_sentences for r in toxicity.score_toxicity(long, toxicity.train(d, l, fit_rows=4000, fit_words=100_000)).collect()} == {1: 1, 2: 1}


def kneser_ney(texts, order):
    """The interpolated modified model by definition: a function of (history, character)."""
    levels = [Counter()]
    for t in texts:
        x = kn_quality.PAD * (order - 1) + t
        levels[0].update(x[i : i + order] for i in range(len(t)))
    for n in range(order - 1, 0, -1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    cuts = []
    for level in levels:
        n = Counter(level.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        raw = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 0.75, 3 - 4 * y * n[4] / n[3] if n[3] else 1.0]
        cuts.append([max(0.0, min(k, x)) for k, x in zip((1, 2, 3), raw)])

    def p(history, char, at=0):
        if at == order:
            return 1 / (len(levels[-1]) + 1)
        level, cut = levels[at], lambda c: cuts[at][min(c, 3) - 1] if c else 0.0
        beside = [c for g, c in level.items() if g[:-1] == history]
        lower = p(history[1:], char, at + 1)
        if not beside:
            return lower
        c = level[history + char]
        return (max(c - cut(c), 0.0) + sum(map(cut, beside)) * lower) / sum(beside)

    return p


def test_kneser_ney_by_definition(spark):
    rng = random.Random(17)
    texts = ["abab abba", "bab", "aab b"] + ["".join(rng.choice("aaabbcd ") for _ in range(40)).strip().replace("  ", " ") for _ in range(6)]
    texts = [" ".join(t.split()) for t in texts]
    counts = kn_quality.count_grams(spark.createDataFrame([(t,) for t in texts], "text string")).cache()
    letters = [*sorted({c for t in texts for c in t}), "Z"]
    histories = [*sorted({r.g[:3] for r in counts.collect()}), "zzz", "zza"]
    wanted = spark.createDataFrame([(h + c,) for h in histories for c in letters], "g string")
    got = {r.g: 10**r.logp for r in kn_quality.log_probabilities(wanted, counts).collect()}
    p = kneser_ney(texts, kn_quality.ORDER)
    for h in histories:
        assert all(abs(got[h + c] - p(h, c)) < 1e-9 for c in letters)
        # With one character that the model doesn't know, the probabilities are whole.
        assert abs(sum(got[h + c] for c in letters) - 1) < 1e-9


def test_quality_model_counts_every_trusted_text(spark):
    rng = random.Random(23)
    texts = ["".join(rng.choice("aaaabbbcde") for _ in range(rng.randrange(1, 7))) for _ in range(20_600)]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    l = d.select("doc_id", (F.col("doc_id") % 200 != 0).cast("int").alias("quality"))
    p = kneser_ney([t for i, t in enumerate(texts) if i % 200], kn_quality.ORDER)
    pads = kn_quality.PAD * (kn_quality.ORDER - 1)
    for r in kn_quality.kn_quality(d, l, carry=("doc_id", "text")).where("doc_id % 500 = 0").collect():
        x = pads + texts[r.doc_id]
        logs = [math.log10(p(x[i : i + 3], x[i + 3])) for i in range(r.n_chars)]
        assert math.isclose(r.perplexity, 10 ** (-sum(logs) / len(logs)), rel_tol=1e-9)


def test_gram_keys_are_exact():
    many = "".join(chr(0x4E00 + i) for i in range(20000)) + "".join(chr(0x20000 + i) for i in range(40000))
    for texts in (["abcabc", "", "a"], ["", ""], [], [many, many[:10]]):
        own = kn_quality.Grams(texts)
        pads = kn_quality.PAD * (kn_quality.ORDER - 1)
        want = [(pads + t)[i : i + kn_quality.ORDER] for t in texts for i in range(len(t))]
        names = own.texts()
        assert [names[i] for i in own.of] == want and len(set(names)) == len(names) and own.n.tolist() == [len(t) for t in texts]


def test_quality_keeps_clean(spark, docs, no_docs, labels):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["river", "stone", "clouds", "green", "walking"]) for _ in range(60))
    rows = [(i, good() if i % 4 else "".join(rng.choice("#$%XQZ!&") for _ in range(300)), ["en", "de"][i % 2]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    l = d.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    out = kn_quality.kn_quality(d, l, carry=("doc_id", "text", "lang")).collect()
    assert len(out) == 400 and all(r.kept == (r.doc_id % 4 != 0) for r in out)
    some = kn_quality.kn_quality(docs, labels).collect()
    assert len(some) == docs.count() and all(r.kept for r in some if r.n_chars == 0)
    assert kn_quality.kn_quality(no_docs, labels).collect() == []
    assert all(r.kept for r in kn_quality.kn_quality(docs, labels.where("false")).collect())


def brute(corpus, k, num, den):
    def shingles(t):
        w = BLANK.findall(lower(t))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t, *_ in corpus]
    group = list(range(len(sets)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                group[find(a)] = find(b)
    low = {}
    for a, (i, s) in enumerate(sets):
        if i is not None:
            low[find(a)] = min(low.get(find(a), i), i)
    return Counter((i, len(s), low.get(find(a)) if s else i) for a, (i, s) in enumerate(sets))


def test_overlap_is_exact():
    rng = random.Random(12)
    for k in (1, 2, 4, 5):
        for _ in range(200):
            x, y = ([rng.choice([b"a", b"b", b"cc"]) for _ in range(rng.randrange(9))] for _ in range(2))
            a, b = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()) for w in (x, y))
            assert jaccard_join.overlap(x, y, k) == (len(a), len(b), len(a & b))


def test_sets_that_would_share_a_name_stay_apart(spark, docs, corpus, monkeypatch):
    own = jaccard_join.set_id
    # A name that a third of all sets have: the other half of the digest must tell them apart.
    docs = docs.persist()
    want = brute(corpus, 4, 85, 100)
    monkeypatch.setattr(jaccard_join, "set_id", lambda h: (own(h)[0] and (7 if own(h)[0] % 3 == 0 else own(h)[0]), own(h)[1]))
    got = jaccard_join.jaccard_join(docs, k=4, num=85)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want


def test_jaccard_join(docs, corpus, no_docs):
    for k, num in ((4, 85), (2, 50)):
        got = jaccard_join.jaccard_join(docs, k=k, num=num)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(corpus, k, num, 100)
    one = jaccard_join.one_of_each(docs, jaccard_join.jaccard_join(docs))
    left = Counter(r.doc_id for r in one.collect())
    assert one.columns == docs.columns and left[40] == 1 and not any(left[i] for i in range(41, 52)) and left[52] == left[53] == 1
    assert jaccard_join.jaccard_join(no_docs).collect() == []
    clash = docs.withColumns({"key": F.lit("k"), "row": F.lit("r"), "n": F.lit(1), "__key": F.lit(2)})
    kept = jaccard_join.one_of_each(clash, jaccard_join.jaccard_join(clash))
    assert kept.columns == clash.columns and Counter(r.doc_id for r in kept.collect()) == left and {(r.key, r.row, r.n, r["__key"]) for r in kept.collect()} == {("k", "r", 1, 2)}


def test_jaccard_chain_and_hot_group(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    # A passage that unrelated documents share.
    rows += [(1000 + i, " ".join(base[:60] + [f"u{i}x{j}" for j in range(60)])) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    for num in (75,):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(d, k=4, num=num).collect())
        assert got == brute(rows, 4, num, 100)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    rng = random.Random(2)
    edges += [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(160)]
    want = {}
    for a, b in edges:
        x, y = want.setdefault(a, a), want.setdefault(b, b)
        want = {n: min(x, y) if r in (x, y) else r for n, r in want.items()}
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    for one_task in (10**6, 0):
        got = {r.node: r.root for r in components(frame, one_task).collect()}
        assert got == {n: r for n, r in want.items() if n not in alone}
    assert components(frame.where("false")).collect() == [] and components(frame.where("false"), -1).collect() == []


def test_bpe_equals_reference(docs, corpus, no_docs, spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    odd = [(i, "".join(rng.choice("ab é\n\t日'sS1<|endoftext|>\U0001f600") for _ in range(300))) for i in range(30)] + [(90, "a" * 4000), (91, "ab" * 2000 + "  \n x")]
    for frame, rows in ((docs, corpus), (spark.createDataFrame(odd, "doc_id bigint, text string"), odd)):
        out = bpe.bpe_decode(bpe.bpe_encode(frame, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
        want = Counter((r[0], tuple(known.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
        assert Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()), bytes(r.decoded)) for r in out) == want
        assert all(r.n_tokens * 4 == len(r.ids) for r in out)
    # Texts of several runs, pieces of several shards.
    runs = [(i, " ".join(f"word{rng.randrange(3000)}" for _ in range(300))) for i in range(200)]
    told = spark.createDataFrame(runs, "doc_id bigint, text string").coalesce(1)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bpe, "RUN_CHARS", 40_000)
        patch.setattr(bpe, "SHARD_CHARS", 60_000)
        patch.setattr(bpe, "ROW_PIECES", 2_000)
        got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in bpe.bpe_encode(told, path, public_tokenizers.PATTERN).collect()}
    assert got == {i: known.encode_ordinary(t) for i, t in runs}
    assert bpe.bpe_encode(no_docs, path, public_tokenizers.PATTERN).collect() == []


def recall(found, ids, x, queries, top):
    place = {int(i): n for n, i in enumerate(ids)}
    hit = 0
    for i in queries:
        s = x @ x[place[i]]
        s[place[i]] = -np.inf
        hit += len(found[i] & {int(v) for v in ids[np.lexsort((ids, -s))[:top]]})
    return hit / (top * len(queries))


def test_recall_where_few_rows_are_reranked(spark):
    """On 24,000 rows under one in a hundred is scored exactly: the scan must find the others out. On the given table the query's own parameters hold."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(200, 32))
    x = (centers[rng.integers(0, 200, 24_000)] + 0.6 * rng.normal(size=(24_000, 32))).astype(np.float32)
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    real = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    for df, step, given in ((made.coalesce(1), 600, {"rerank": 220, "block_rows": 24_000}), (real, 20, {})):
        found = {}
        for r in anisotropic_ann.nearest(df, F.col("id") % step == 0, **given).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        rows = df.toArrow()
        ids, own = rows.column("vec_id").to_numpy(), np.array(rows.column("embedding").to_pylist(), dtype=np.float64)
        assert recall(found, ids, own, sorted(found), 20) >= 0.9


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(900, None, 1), (920, [0.0] * 16, 1), (940, [float("nan")] * 16, 1), (960, [None] + [1.0] * 15, 1), (None, x[0].tolist(), 1), (5, x[5].tolist(), 1), (980, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = {}
    for r in anisotropic_ann.nearest(df, F.col("id") % 20 == 0, top=20, rerank=100, block_rows=300, query_rows=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in range(900) if i % 20 == 0}
    hit, exact = 0, x.astype(np.float64)
    for i, found in got.items():
        found.sort()
        s = exact @ exact[i]
        s[i] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        hit += len({v for _, v, _ in found} & set(best.tolist()))
        assert [r for r, *_ in found] == list(range(1, 21)) and all(abs(t - s[v]) < 1e-9 for _, v, t in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
    assert hit >= 0.9 * 20 * len(got)
    turns = anisotropic_ann.nearest(df.repartition(7), F.col("id") % 20 == 0, top=20, rerank=900, block_rows=50, query_rows=10).collect()
    want = {(i, n + 1, int(v)) for i in got for n, v in enumerate(np.lexsort((np.arange(900), -np.where(np.arange(900) == i, -np.inf, exact @ exact[i])))[:20])}
    assert {(r.query_id, r["rank"], r.vec_id) for r in turns} == want
    few = anisotropic_ann.nearest(df.where("vec_id <= 5"), F.col("id") % 20 == 0).collect()
    assert len(few) == 5
    assert anisotropic_ann.nearest(df.where("false"), F.lit(True)).collect() == []
