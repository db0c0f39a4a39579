"""Jaccard join, top-k search, license scan and URL filter against brute force."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.llm import components, jaccard_join, license_scan, topk_search, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, ids=None):
    rows = [(ids[i] if ids else i, t, "s", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, component_id long")


def brute(texts, percent=80):
    sets = []
    for t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def varied(seed, base, edits):
    r = random.Random(seed)
    w = base.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def test_jaccard_equals_brute_force(spark):
    r = random.Random(4)
    texts = [None, "", "  ", "A b", "a B", "a b c", "x " * 40, "x " * 45]
    passage = " ".join(f"p{i}" for i in range(30))
    for g in range(4):
        base = " ".join(f"g{g}w{r.randrange(200)}" for _ in range(90))
        texts += [base] + [varied(100 * g + k, base, k % 5) for k in range(25)] + [base]
    texts += [passage + " " + " ".join(f"u{d}w{i}" for i in range(r.randint(3, 60))) for d in range(30)]
    want = brute(texts)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.classes(docs(spark, texts)).collect()}
    assert got == want


def test_pairs_of_one_list_are_handed_on_as_they_are_found():
    """A list of 60 000 entries that all fit has 1.8 billion pairs; what is gathered is one entry's."""
    import itertools

    n = np.full(60_000, 100)
    found = jaccard_join.run_pairs(np.arange(60_000), n, np.zeros(60_000, int), np.arange(60_000), 80)
    first = list(itertools.islice(found, 3))
    assert [(i[0], len(j)) for i, j in first] == [(0, 59_999), (1, 59_998), (2, 59_997)]


@pytest.mark.parametrize("pairs", [1, 10**6])
def test_long_lists_in_parts_equal_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(jaccard_join, "LIST", 4)
    monkeypatch.setattr(jaccard_join, "PAIRS", pairs)
    r = random.Random(14)
    texts = []
    for g in range(3):  # short texts out of few words: their shingles are common, and their lists long
        base = [f"g{g}w{i}" for i in range(8)]
        texts += [" ".join(r.sample(base, 8)) if k % 3 else " ".join(base + [f"x{k}"] * (k % 2)) for k in range(40)]
    base = " ".join(f"s{r.randrange(40)}" for _ in range(60))
    texts += [varied(k, base, k % 4) for k in range(40)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.classes(docs(spark, texts)).collect()}
    assert got == brute(texts)


def test_jaccard_of_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"v{i % 90_001}" for i in range(120_000))
    names = ("row", "own_id", "own_key", "id", "key", "node", "n", "h", "cell", "parts")
    df = docs(spark, [base, base + " more", long, long + " end", None, "alone here with five words"], [None, 7, 3, 4, None, None]).withColumns({c: F.lit(1) for c in names})
    got = {(x["doc_id"], x["n_shingles"]): x["component_id"] for x in jaccard_join.classes(df).collect()}
    assert got[(3, 90_001)] == 3 and got[(4, 90_002)] == 3 and got[(None, 56)] == 7 and got[(7, 57)] == 7
    assert got[(None, 0)] is None and got[(None, 1)] is None
    out = jaccard_join.keep_one(df)
    assert out.columns == df.columns and sorted(str(x["doc_id"]) for x in out.collect()) == ["3", "7", "None", "None"]


def test_jaccard_keeps_one(spark):
    base = " ".join(f"w{i}" for i in range(60))
    df = docs(spark, [base, base, "other text of its own here", None, "other text of its own here"], [5, 3, 9, 11, 9])
    out = jaccard_join.keep_one(df)
    assert sorted(x["doc_id"] for x in out.collect()) == [3, 9, 11]
    assert out.columns == df.columns
    assert jaccard_join.classes(docs(spark, [])).count() == 0


def test_run_pairs_equals_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        m = rng.integers(2, 30)
        n = np.sort(rng.integers(10, 60, m))
        pos, comp = rng.integers(0, 12, m), rng.integers(0, 4, m)
        found = list(jaccard_join.run_pairs(np.arange(m), n, pos, comp, 80))
        i, j = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, int) for k in (0, 1))
        got = {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist(), strict=True)}
        ok = lambda a, b: comp[a] != comp[b] and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b]) and min(n[a] - pos[a], n[b] - pos[b]) >= -(-80 * (n[a] + n[b]) // 180)
        assert got == {(a, b) for a in range(m) for b in range(a + 1, m) if ok(a, b)}


def test_components(spark):
    r = random.Random(9)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7)]
    top = {x: x for e in links for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in rng.normal(0, 0.3, (700, 12)).round(1)]  # many ties
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [float("nan")] * 12, 1), (902, [None] + [1.0] * 11, 1), (903, [float("inf")] * 12, 1), (20, vectors[20], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = topk_search.top_k(df, df.filter("vec_id % 100 = 0"), k=7).collect()
    ids = np.array([i for i, v, _ in rows if i < 900])
    ints = np.floor(64 * np.array([v for i, v, _ in rows if i < 900], dtype=np.float32).astype(float)).astype(int)
    for q in range(0, 700, 100):
        score = ints @ ints[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:7]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert mine == [(k + 1, ids[i], score[i]) for k, i in enumerate(order)]
    assert topk_search.top_k(df.filter("vec_id < 0"), df.filter("vec_id < 0")).count() == 0
    assert topk_search.top_k(df.filter("vec_id < 3"), df.filter("vec_id = 0")).count() == 2


def check_block(q, q_ids, x, k, bars):
    block = topk_search.Block(x, np.arange(len(x)), topk_search._working_type(q, x))
    found, reads = topk_search.search_block(q, q_ids, block, k, bars)
    for i, (rows, score) in enumerate(found):
        want = x @ q[i]
        order = [r for r in np.lexsort((np.arange(len(x)), -want)) if r != q_ids[i]][:k]
        order = [r for r in order if np.isnan(bars[i]) or want[r] >= bars[i]]
        assert [r for r in rows.tolist() if np.isnan(bars[i]) or want[r] >= bars[i]] == order
        assert score.tolist() == want[rows].tolist()
    return reads / len(x)


def test_lists_are_left_early_where_winners_stand_out():
    rng = np.random.default_rng(5)
    x = rng.integers(-20, 20, (3000, 6))
    x[:40] = rng.integers(-3, 4, (40, 6)) + np.array([90, 80, 95, -85, 90, 99])  # one direction
    share = check_block(x[:10], np.arange(10), x, 10, np.full(10, np.nan))
    assert (share < 0.5).mean() > 0.5
    far = check_block(-x[100:110], np.full(10, -1), x, 10, np.full(10, np.nan))
    assert far.max() <= 1.0


def test_lists_are_read_nearly_to_the_end_where_bounds_say_little():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 8, (600, 64)).round().astype(int)
    assert check_block(x[:8], np.arange(8), x, 2, np.full(8, np.nan)).min() >= 0.9


def test_a_bar_from_elsewhere_ends_queries_sooner():
    rng = np.random.default_rng(7)
    x = rng.normal(0, 8, (4000, 32)).round().astype(int)
    q = x[:30]
    kth = np.sort(q @ x.T, axis=1)[:, -21].astype(float)
    own, lent = check_block(q, np.arange(30), x, 20, np.full(30, np.nan)), check_block(q, np.arange(30), x, 20, kth)
    assert lent.mean() < own.mean()


@pytest.mark.parametrize("size", [3, 2**14, 2**24, 2**29])
def test_blocks_are_exact_in_every_working_type(size):
    rng = np.random.default_rng(size % 97)
    x = rng.integers(-size, size, (1500, 8))
    check_block(x[:5], np.arange(5), x, 4, np.full(5, np.nan))


def test_scores_beyond_64_bits_are_refused():
    x = np.full((3, 2), 2**31)
    with pytest.raises(ValueError, match="64 bits"):
        topk_search._working_type(x, x)


def test_many_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 200)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 10)
    rng = np.random.default_rng(9)
    x = rng.integers(-9, 9, (1500, 5))
    df = spark.createDataFrame([(i, [v / 64 for v in row.tolist()]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, df.filter("vec_id % 30 = 0"), k=5).collect()
    assert len(got) == 250
    for i in range(0, 1500, 30):
        score = x @ x[i]
        order = [r for r in np.lexsort((np.arange(1500), -score)) if r != i][:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == i) == [(n + 1, r, score[r]) for n, r in enumerate(order)]


def test_licenses_equal_brute_force(spark):
    r = random.Random(6)
    fill = lambda n: " ".join(f"w{r.randrange(50)}" for _ in range(n))
    names = dict(license_scan.TEMPLATES)
    texts = [None, "", "MIT", fill(200)]
    for name, t in license_scan.TEMPLATES:
        texts += [fill(r.randint(0, 90)) + " " + t.upper() + " " + fill(30), t]
    w = names["GPL-grant"].split()
    texts += [" ".join(["changed", *w[1:]]), " ".join(w[: len(w) // 2])]
    got = {(x["doc_id"], x["template"]) for x in license_scan.find_licenses(docs(spark, texts)).collect()}
    shingles = lambda t: {tuple(x[i : i + 5]) for x in [WORD.findall((t or "").lower())] for i in range(len(x) - 4)}
    want = {(i, n) for i, t in enumerate(texts) for n, s in license_scan.TEMPLATES if 100 * len(shingles(t) & shingles(s)) >= 80 * len(shingles(s))}
    assert got == want
    assert license_scan.find_licenses(docs(spark, [])).count() == 0


def test_bins_keep_their_promise():
    for window, least in ((12, 1), (12, 4), (48, 17), (384, 150), (768, 250)):
        b = license_scan.bins_of(window, least, 0.01)
        need, rng, missed = -(-80 * least // 100), np.random.default_rng(least), 0
        for _ in range(2000):
            t = rng.integers(0, 2**62, least)
            w = np.concatenate([t[:need], rng.integers(0, 2**62, window - 4 - need)])
            low = lambda x: {int(h % b): int(h) for h in sorted(x.tolist(), reverse=True)}  # noqa: E731, B023
            a, c = low(t), low(w)
            missed += not any(c.get(k) == v for k, v in a.items())
        assert missed / 2000 <= 0.02, (window, least)


def test_license_texts_edited_and_embedded(spark):
    r = random.Random(12)
    names = dict(license_scan.TEMPLATES)
    fill = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    texts, want = [], set()
    for name in ("MIT-text", "BSD-2-text", "BSD-3-text", "ISC-text", "zlib-text"):
        w = names[name].split()
        for edits in (0, 3, 60):
            own = list(w)
            for _ in range(edits):
                own[r.randrange(len(own))] = f"e{r.randrange(10**6)}"
            texts.append(fill(r.randint(0, 900)) + "\n" + "\n".join(own) + "\n" + fill(300))
    shingles = lambda t: {tuple(x[i : i + 5]) for x in [WORD.findall((t or "").lower())] for i in range(len(x) - 4)}
    want = {(i, n) for i, t in enumerate(texts) for n, s in license_scan.TEMPLATES if 100 * len(shingles(t) & shingles(s)) >= 80 * len(shingles(s))}
    df = docs(spark, texts).withColumns({c: F.lit(1) for c in ("template", "sh", "key", "row_key", "at", "h", "t", "class")})
    got = [(x["doc_id"], x["template"]) for x in license_scan.find_licenses(df.union(df)).collect()]
    assert sorted(got) == sorted(want) and len(want) >= 10


def test_templates_are_a_table_and_short_ones_are_refused(spark):
    table = license_scan.template_table(spark, [("own", "one two three four five six")])
    got = license_scan.find_licenses(docs(spark, ["so One two three four five six it is", None], [None, 3]), table).collect()
    assert [(x["doc_id"], x["template"], x["first_word"]) for x in got] == [(None, "own", 1)]
    with pytest.raises(Exception, match="fewer than 5 words"):
        license_scan.find_licenses(docs(spark, ["x"]), license_scan.template_table(spark, [("short", "one two")])).count()


def test_urls(spark):
    rows = [
        (1, "http://A.Example.org/es/x?y", None), (2, "https://example.org/en/12#z", "<a href='http://bad.example.com/'>"), (3, "http://x.com/fr/1", ""), (4, None, "<p>"), (5, "no scheme/x", "x"),
        (6, "http://bad.example.com/de/1", "<a href=//far.net/a>"), (7, "http://bad.example.com/en/1", None), (8, "http://far.net/", ""), (9, "http://good.org", "<img src='http://far.net/i'>"), (10, "http://com/fr/", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("trust", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2][2:] == ("example.org/en/1", "block")
    assert got[3][2:] == ("com/fr/", "allow") and got[10][2:] == ("com/fr/", "allow")
    assert got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[7][2:] == (None, "block")  # its host only has blocked pages
    assert got[9] == ("good.org", "", None, "allow")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_distrust_flows_against_links(spark):
    rows = [(1, "http://bad.com/de/1", "x"), (2, "http://hub.net/", "<a href='http://bad.com/'>"), (3, "http://ok.net/", "<a href='http://fine.com/'>"), (4, "http://fine.com/fr/1", "")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_scores_reach_hosts_behind_many_links_and_equal_plain_rounds(spark):
    r = random.Random(3)
    chain = [(f"c{i}.net", f"c{i + 1}.net", 1) for i in range(30)]
    edges = chain + [(f"h{r.randrange(12)}.net", f"h{r.randrange(12)}.net", r.randint(1, 3)) for _ in range(30)]
    edges = list({(a, b): n for a, b, n in edges if a != b}.items())
    edges = [(a, b, n) for (a, b), n in edges]
    seeds = [("c0.net", 3, 0), ("h1.net", 2, 5), ("h2.net", 0, 4), ("lone.net", 1, 1), ("c30.net", 0, 1)]
    got = {x["host"]: (x["trust"], x["distrust"]) for x in url_filter.spread(spark.createDataFrame(seeds, "host string, trust long, distrust long"), spark.createDataFrame(edges, "src string, dst string, n long")).collect()}
    hosts = {h for e in edges for h in e[:2]} | {s[0] for s in seeds}
    for kind in (0, 1):
        links = [(a, b, n) if kind == 0 else (b, a, n) for a, b, n in edges]
        out = collections.Counter()
        for a, _, n in links:
            out[a] += n
        v = {h: 0.0 for h in hosts} | {s[0]: s[1 + kind] / sum(x[1 + kind] for x in seeds) for s in seeds}
        x = dict(v)
        for _ in range(400):  # hosts without links give their part back to the seeds
            lost = sum(x[h] for h in hosts if not out[h])
            new = {h: 0.15 * v[h] + 0.85 * lost * v[h] for h in hosts}
            for a, b, n in links:
                new[b] += 0.85 * x[a] * n / out[a]
            x = new
        for h in hosts:
            assert got[h][kind] == pytest.approx(x[h], rel=2e-4, abs=1e-12), h
    assert got["c29.net"][0] > 0  # far behind its seed


def test_equal_scores_allow_and_the_blocking_rule_wins_ties(spark):
    rules = (("a.com", "/x/", "allow"), ("a.com", "/x/", "block"), ("b.com", "/ok", "allow"), ("b.com", "/no", "block"))
    rows = [(1, "http://a.com/x/1", ""), (2, "http://b.com/ok", ""), (3, "http://b.com/no", ""), (4, "http://b.com/", ""), (4, "http://b.com/", "")]
    got = sorted((x["page_id"], x["verdict"]) for x in url_filter.judge(spark.createDataFrame(rows[1:], "page_id long, url string, html string"), rules).collect())
    assert got == [(2, "allow"), (3, "block"), (4, "allow"), (4, "allow")]
    assert url_filter.judge(spark.createDataFrame(rows[:1], "page_id long, url string, html string"), rules).first()["verdict"] == "block"


def test_long_chains_become_one_component(spark):
    links = [(i, i + 1) for i in range(3000)]
    random.Random(1).shuffle(links)
    out = components.components(spark.createDataFrame(links, "a long, b long")).select("component").distinct().collect()
    assert [x[0] for x in out] == [0]
