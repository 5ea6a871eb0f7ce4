"""License scan, quality rules, source mix and URL filter against brute force."""

import random
import re
from collections import Counter
from math import comb, log, log1p

from pyspark.sql import functions as F

from tidelog.llm import license_scan, quality_rules, source_mix, url_filter

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_license_places(spark):
    texts = {1: "Under the MIT License, under the mit license. CC-BY-NC!", 2: None, 3: "", 4: "APACHE license (version 2)" * 3, 5: "under the mit licence", 6: "cc by", 7: "\u212aelvin under the mit license"}
    texts[8] = "intro words " + license_scan.TEMPLATES[0][1].replace("without limitation", "without any limitation") + " tail"
    df = spark.createDataFrame([(k, v, 9) for k, v in texts.items()], "doc_id bigint, text string, t int")
    got = {r.doc_id: r for r in license_scan.license_report(df).collect()}
    for k, v in texts.items():
        w, at, found = WORD.findall(lower(v)), [], set()
        for label, phrase in license_scan.PHRASES:
            p = phrase.split()
            here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += here
            found |= {label} if here else set()
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found))), k
    assert got[8].labels == "mit" and got[8].base_labels == "" and got[8].spans[0].start == 2 and 0.6 <= got[8].score <= 1
    assert got[2].labels == "" and got[2].score == 0


def test_license_diagonals_against_a_loop(spark):
    rng = random.Random(21)
    notices = [(label, WORD.findall(lower(t))) for label, t in license_scan.TEMPLATES]
    rows = []
    for i in range(120):
        out = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            own = list(rng.choice(notices)[1])
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = ["edited"] * rng.randrange(3)
            out += own[rng.randrange(1 + len(own) // 3) :] + [f"w{rng.randrange(50)}" for _ in range(rng.randrange(20))]
        rows.append((i, " ".join(out)))
    got = {r.doc_id: r for r in license_scan.license_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    seen = set()
    for i, text in rows:
        w, want = text.split(), set()
        for label, q in notices:
            hits = [(a, b) for a in range(len(w) - 2) for b in range(len(q) - 2) if w[a : a + 3] == q[b : b + 3]]
            width = max(3, (len(q) - 2) // 8) + 1
            bands = {}
            for a, b in hits:
                for band in ((a - b) // width - 1, (a - b) // width):
                    bands.setdefault(band, []).append((a, b))
            votes = {band: len({b for _, b in x}) for band, x in bands.items() if len({b for _, b in x}) >= 0.6 * (len(q) - 2)}
            for band, n in votes.items():
                if n > votes.get(band - 1, 0) and n >= votes.get(band + 1, 0):
                    want.add((min(a for a, _ in bands[band]), max(a for a, _ in bands[band]) + 3, label))
                    assert max(a for a, _ in bands[band]) + 3 - min(a for a, _ in bands[band]) <= len(q) + 2 * width
        phrases = {(a, a + len(p.split()), label) for label, p in license_scan.PHRASES for a in range(len(w)) if w[a : a + len(p.split())] == p.split()}
        assert {(s.start, s.end, s.label) for s in got[i].spans or []} == want | phrases, i
        assert got[i].labels == ",".join(sorted({x[2] for x in want | phrases}))
        seen |= {x[2] for x in want}
    assert len(seen) >= 8


def test_license_lines_in_use(spark):
    lines = ["This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "GNU Lesser General Public License", "general public remarks on a license"]
    df = spark.createDataFrame([(i, f"some words before. {t} And after.") for i, t in enumerate(lines)], "doc_id bigint, text string")
    got = {r.doc_id: (r.base_labels, r.labels) for r in license_scan.license_report(df).collect()}
    assert got == {0: ("", "gpl"), 1: ("mit", "mit"), 2: ("cc-by-nc", "cc-by-nc"), 3: ("apache-2", "apache-2"), 4: ("", "lgpl"), 5: ("", "")}


def test_license_empty(no_docs):
    assert license_scan.license_report(no_docs).collect() == []


def counts(t):
    t = t or ""
    w = BLANK.findall(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if BLANK.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(docs, corpus, labels):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(docs, labels).collect())
    want = Counter()
    for i, t, *_ in corpus:
        n, *rest = counts(t)
        want[(i, n, *rest, n < 50 or 100 * rest[-1] > 50 * n)] += 1
    assert got == want


def test_quality_binomial_and_cutoffs(spark, no_docs, labels):
    rows = [(n, k) for n in (50, 400) for k in (0, 1, 3)]
    df = spark.createDataFrame([(float(n), float(k)) for n, k in rows], "n double, k double")
    got = [r[0] for r in df.select(quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.01)).collect()]
    for (n, k), x in zip(rows, got):
        assert abs(x - sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1))) < 1e-9
    assert quality_rules.quality_rules(no_docs, labels).collect() == []


def noisy(i, bad):
    words = "plain words stand here in a row and go on"
    return " ".join(f"{w}{i}{j}{'##$%' if bad else ''}" for j in range(8) for w in words.split())


def test_quality_rejects_at_production_parameters(spark):
    """Cutoffs and verdicts of the query's own parameters, recomputed in Python; two small strata decide together."""
    rng = random.Random(8)
    sizes = {"en": 1500, "de": 700, "fr": 300, "es": 250, None: 30}
    rows = [(lang, rng.random() < 0.2, rng.random() < 0.002) for lang, n in sizes.items() for _ in range(n)]
    texts = [(i, noisy(i, bad or odd), lang) for i, (lang, bad, odd) in enumerate(rows)]
    d = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    l = spark.createDataFrame([(i, int(not bad)) for i, (_, bad, _) in enumerate(rows)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(d, l).collect()}
    risk, delta, n_rules = 0.05, 0.1, len(quality_rules.RULES)
    need = log(delta / len(sizes) / n_rules) / log1p(-risk * max(quality_rules.SHARES.values()))
    good = Counter(lang for lang, bad, _ in rows if not bad)
    pool = {lang: lang if good[lang] >= need else "small" for lang in sizes}
    assert pool == {"en": "en", "de": "de", "fr": "small", "es": "small", None: "small"}
    rate = {i: min(100, 100 * got[i].n_symbols // got[i].n_words) for i in got}
    for p in set(pool.values()):
        own = [i for i, (lang, _, _) in enumerate(rows) if pool[lang] == p]
        goods, bads = [rate[i] for i in own if not rows[i][1]], [rate[i] for i in own if rows[i][1]]
        best = (0, None)
        for cut in sorted({rate[i] for i in own}):
            k, kb, r = sum(x > cut for x in goods), sum(x > cut for x in bads), risk * quality_rules.SHARES["symbols"]
            tail = sum(comb(len(goods), j) * r**j * (1 - r) ** (len(goods) - j) for j in range(k + 1))
            if tail <= delta / len(sizes) / n_rules and kb - k / risk > best[0]:
                best = (kb - k / risk, cut)
        for i in own:
            assert got[i].kept == (best[1] is None or rate[i] <= best[1]), (p, best)
        assert best[1] is not None


def test_quality_risk_holds(spark):
    """Replicates of one population: the cutoff that each chooses may lose more than its risk in one of ten at most."""
    rng = random.Random(4)
    n, runs, risk = 600, 60, 0.05
    share = risk * quality_rules.SHARES["symbols"]
    rows, marks = [], []
    for r in range(runs):
        for _ in range(n):
            bad = rng.random() < 0.3
            # Three in a hundred good documents have some symbols, half of them many: a cutoff below those loses too much.
            x = rng.choice([3, 40]) if not bad and rng.random() < 0.03 else (rng.randrange(2, 60) if bad else 0)
            rows.append((len(rows), f"={r}", 100, 400, x, 10, 0, 0, 3, 0))
            marks.append((len(marks), int(not bad)))
    stats = spark.createDataFrame(rows, "doc_id bigint, stratum string, n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint, n_capitals bigint, n_shouts bigint")
    cuts = quality_rules.certified_cutoffs(stats, spark.createDataFrame(marks, "doc_id bigint, quality int"), risk, 0.1 * runs).where("rule = 'symbols'").collect()
    lost = lambda cut: 0.015 * (cut < 3) + 0.015 * (cut < 40)
    assert cuts and sum(lost(c.cutoff) > share for c in cuts) <= 0.1 * runs


def test_mix_targets_and_bounds(docs, corpus):
    rows = source_mix.mix_sources(docs).collect()
    assert len(rows) == len(corpus)
    sizes = Counter()
    for _, t, _, s, *_ in corpus:
        sizes[s] += len(BLANK.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= level * weight[s]}
        for s in full or open_:
            goal[s] = 2.0 * sizes[s] if full else level * weight[s]
        left -= sum(goal[s] for s in full)
        open_ = open_ - full if full else set()
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    biggest = max(len(BLANK.findall(t or "")) for _, t, *_ in corpus)
    assert all(abs(taken[s] - goal[s]) <= 2 * biggest for s in names)
    assert Counter(source_mix.mix_sources(docs.repartition(5)).collect()) == Counter(rows)
    again = source_mix.mixed(docs, share=1.5)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in rows)
    clash = docs.withColumns({"h": F.lit("own"), "size": F.lit(-1), "row": F.lit("r"), "copies": F.lit(5), "__h": F.lit(3)})
    assert Counter(source_mix.mixed(clash, share=1.5).select("doc_id", "h", "size", "row", "copies", "__h").collect()) == Counter((r.doc_id, "own", -1, "r", 5, 3) for r in again.collect())


def test_mix_empty(no_docs):
    assert source_mix.mix_sources(no_docs).collect() == []


def test_url_rules(spark):
    rules = [("COM", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1?q#f", "http://m.www.example.com/en/", "http://x.net/es/a", "http://net/es", None, "no scheme", "http://com", "x://y?z", "http://notexample.com/en/", "http://a.com/x", "ftp://b.example.com/en/://u"]
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id bigint, url string, key string")
    got = {r.page_id: r for r in url_filter.url_filter(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in ((lower(h), p, v) for h, p, v in rules) if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
    # A filter that is far too small passes more keys to the join, which removes them.
    small = url_filter.url_filter(df, spark.createDataFrame(rules, "host string, path string, verdict string"), blocks=1, broadcast_rows=0)
    assert {r.page_id: r for r in small.collect()} == got
    many = spark.createDataFrame(rules + [(f"h{i}.org", f"/{i % 7}/", "block") for i in range(9000)], "host string, path string, verdict string")
    assert {r.page_id: r for r in url_filter.url_filter(df, many, broadcast_rows=100).collect()} == got
    assert [url_filter.blocks_for(n) for n in (0, 4096, 4097, 10**9)] == [1024, 1024, 2048, 1 << 20]
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.url_filter(df, none).collect()} == {"allow"}
