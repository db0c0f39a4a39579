"""Language ID, secrets, source mix, HTML and the pipeline."""

import collections
import hashlib
import html as html_module
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidebars.llm import html_text, language_id, secret_scan, source_mix

SF = "/root/testdata/sf0.001"


def test_languages_are_learned_and_held_out(spark):
    r = random.Random(1)
    sounds = {"aa": ["ka", "ta", "na", "mo"], "bb": ["sch", "ein", "ung", "er"], "cc": ["ée", "oi", "que", "ai"]}
    text = lambda k: " ".join("".join(r.choices(sounds[k], k=3)) for _ in range(30))
    rows = [(i, text(k), k, "x") for i, k in enumerate(sorted(sounds) * 60)]
    df = spark.createDataFrame(rows + [(900, None, "aa", "x"), (901, "12 34 !", "aa", "x"), (902, "", None, "x"), (903, "\U00020000 \U00020001", None, "x")], "doc_id long, text string, lang string, source string")
    model = language_id.train(df.filter("doc_id % 5 <> 1"))
    got = {x["doc_id"]: x for x in language_id.identify(df, model).collect()}
    right = [got[i]["lang_pred"] == k for i, _, k, _ in rows]
    assert sum(right) / len(right) > 0.97
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] != "und"
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert language_id.identify(df.limit(0), model).count() == 0
    assert language_id.train(df.limit(0)) is None


def plain_kneser_ney(texts):
    """{lang: function of (three units, unit)} from plain dictionaries, and the vocabulary's size."""
    vocabulary, tables = set(), {}
    for lang, own in texts.items():
        counts = collections.Counter()
        for t in own:
            u = "\0\0\0" + re.sub("[^a-z]+", "\0", t.lower()).lstrip("\0")
            u += "" if u.endswith("\0") else "\0"
            counts.update(u[i : i + 4] for i in range(len(u) - 3))
        levels = {4: counts}
        for k in (3, 2, 1):
            levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
        vocabulary |= set(levels[1])
        tables[lang] = {}
        for k, c in levels.items():
            ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            total, kinds = collections.Counter(), collections.Counter()
            for g, n in c.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            tables[lang][k] = (c, d, total, kinds)

    def p(lang, context, x, k=4):
        if k == 0:
            return 1 / (len(vocabulary) + 1)
        c, d, total, kinds = tables[lang][k]
        context = context[len(context) - (k - 1) :]
        if not total[context]:
            return p(lang, context, x, k - 1)
        return max(c[context + x] - d, 0) / total[context] + d * kinds[context] / total[context] * p(lang, context, x, k - 1)

    return p, vocabulary


def test_model_equals_plain_kneser_ney(spark):
    import numpy as np

    r = random.Random(8)
    texts = {lang: ["".join(r.choices(letters, k=r.randint(1, 60))) for _ in range(15)] for lang, letters in (("x", "aabbcd  "), ("y", "abceee f "), ("z", "q"))}
    rows = [(lang, t) for lang, own in texts.items() for t in own]
    model = language_id.train(spark.createDataFrame(rows, "lang string, text string"))  # too few rows to leave some out
    p, vocabulary = plain_kneser_ney(texts)
    grams = ["".join(r.choices("\0abcdefqz", k=4)) for _ in range(400)] + [("\0\0\0" + t)[:4] for _, t in rows if t[0] != " " and t[:1] != ""]
    keys = np.array([int.from_bytes(g.encode("utf-16-be")) for g in grams], dtype=np.uint64)
    want = np.log([[p(lang, g[:3], g[3]) for lang in "xyz"] for g in grams])
    assert np.allclose(model.arrays.resolve(keys), want, atol=1e-5) and np.allclose(model.arrays.logs_of(keys), want, atol=1e-5)
    for context in ("abc", "ee\0", "zzz"):  # what no text held has its share
        assert sum(p("x", context, x) for x in [*vocabulary, "z"]) == pytest.approx(1)


def test_models_too_large_for_workers_give_the_same(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choices("abcde  " if i % 2 else "abxyz ", k=r.randint(5, 80))), "xy"[i % 2], 0) for i in range(120)] + [(900, None, None, 0), (901, "??", None, 0), (902, "ab ab", None, 0), (902, "ab ab", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, rid long")
    small, large = language_id.train(df), language_id.train(df, model_cells=0)
    assert small.arrays is not None and large.arrays is None
    key = lambda x: (x["doc_id"], x["lang_pred"])
    a, b = (sorted(language_id.identify(df, m).collect(), key=key) for m in (small, large))
    assert list(map(key, a)) == list(map(key, b)) and len(a) == len(rows)
    for x, y in zip(a, b, strict=True):
        assert x["score"] == pytest.approx(y["score"], abs=1e-4) and x["cross_entropy"] == pytest.approx(y["cross_entropy"], abs=1e-4)


def test_language_of_odd_tables(spark):
    long = "and the other " * 60_000
    rows = [(i, f"the one and the other {'x' * (i % 5)}", "en") for i in range(30)] + [(i + 30, f"der eine und die andere {'y' * (i % 5)}", "de") for i in range(30)]
    df = spark.createDataFrame(rows + [(90, long, None), (90, long, None)], "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("best", "entropy", "key", "score")})
    model = language_id.train(df)
    got = [x["lang_pred"] for x in language_id.identify(df, model).filter("doc_id = 90").collect()]
    assert got == ["en", "en"]
    one = language_id.train(df.filter("lang = 'en'"))
    assert {x["lang_pred"] for x in language_id.identify(df, one).collect()} == {"en"}
    assert language_id.identify(df.limit(0), None).count() == 0


PATTERN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in PATTERN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found)


def secrets_table(spark):
    r = random.Random(2)
    hexed = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    texts = [None, "", "Token=abc", "toKen : 'abcdef' API_KEY=\"x+/=.-_9\"", "AKIA" + "A1" * 8, "AKIA" + "B" * 15, hexed(23) + " " + hexed(24), "é" * 5 + ' token = "' + hexed(40) + '"', "ſecret=abcdefgh", "password password=passwd=secret1"]
    texts += ["word " * r.randint(0, 9) + 'token = "' + hexed(40) + '" end' for _ in range(60)]
    texts += [f"card {r.randrange(10**15, 10**16)} and mail user{r.randrange(10**11)}abcdefg@x" for _ in range(60)]
    texts += ["a" * 100_000 + " key AbC123" + hexed(20).upper()]
    return texts, spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")


def test_language_model_comes_from_all_grams(spark):
    import numpy as np

    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=110_000))  # over 90 000 different 4-grams, most of them once
    key = np.unique(language_id.keys_of(*language_id.letters([text, text[:500]]))[0])
    model = language_id.train(spark.createDataFrame([("x", text), ("x", text[:500])], "lang string, text string"))
    assert model.tables.grams[-1].count() == len(model.arrays.logs) == len(key) > 60_000


def test_secrets_keep_all_pattern_findings(spark):
    texts, df = secrets_table(spark)
    for r in secret_scan.find_secrets(df).collect():
        base = [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < 3]
        assert base == plain_spans(texts[r["doc_id"]])
        assert all(not any(s["start"] < b[2] and b[0] < s["end"] for b in base) for s in r["spans"] if s["kind"] == 3)
    assert secret_scan.find_secrets(df.limit(0)).count() == 0


def noted(spark, n, kinds, seed=3):
    """Texts with a noted secret of one of the kinds, a number and an address each."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(3, 12)))
    some = lambda n: " ".join(word() for _ in range(n))
    make = {
        "assign": lambda: r.choice(["token = ", "secret: ", "api_key=", "password = "]) + '"' + "".join(r.choices(r.choice(["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"]), k=r.randint(16, 40))) + '"',
        "hex": lambda: "see " + "".join(r.choices("0123456789abcdef", k=r.randint(26, 40))),
    }
    texts = [f"{some(9)} {make[kinds[i % len(kinds)]]()} {some(5)} card {r.randrange(10**15, 10**16)} +1 555-{r.randrange(10**4)}-{r.randrange(10**4)} {word()}{r.randrange(1000)}abcde@{word()}.net" for i in range(n)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_secret_network_finds_what_the_patterns_do_not(spark):
    r = random.Random(9)
    key = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=n))
    texts, df = noted(spark, 400, ["assign", "hex"])
    hidden = [f"walking along the river we noted {key(24)} and went home" for _ in range(40)]
    clean = [f"walking along the river we noted {r.randrange(10**11, 10**12)} and international went home on 2024-05-{r.randint(10, 28)}" for _ in range(40)]
    far = ["x/" * 60 + key(32) + " end", "dir/dir/dir/dir/dir/dir/dir/dir/dir/dir/dir/dir_KEY=" + key(32)]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(hidden + clean + far)], df.schema)
    found = {x["doc_id"]: x["spans"] for x in secret_scan.find_secrets(df.union(more)).collect()}
    hits = [[s for s in found[1000 + i] if s["kind"] == 3] for i in range(len(hidden))]
    assert sum(len(x) == 1 and len(hidden[i][x[0]["start"] : x[0]["end"]]) == 24 for i, x in enumerate(hits)) >= 36
    assert sum(bool(found[1040 + i]) for i in range(len(clean))) <= 2
    assert found[1080] and found[1081]  # secrets behind the first window
    assert sum(any(s["kind"] == 3 for s in found[i]) for i in range(400)) <= 20  # numbers and addresses beside the findings
    scores = [s["score"] for i in range(400) for s in found[i] if s["kind"] < 3]
    assert sum(x > 0.5 for x in scores) / len(scores) > 0.9


def test_a_kind_that_was_kept_back_is_found(spark):
    _, df = noted(spark, 400, ["assign", "hex"], 5)
    got = secret_scan.held_out_recall(df, 2).first()
    assert got["findings"] >= 200 and got["found"] / got["findings"] > 0.7


def test_secret_threshold_keeps_recall(spark):
    _, df = noted(spark, 300, ["assign"], 7)
    scanned = secret_scan.scan(df)
    sample = secret_scan.sample_labels(scanned, 150)
    assert (sample["kind"] >= 0).sum() == 150 and (sample["kind"] < 0).sum() == 150
    net = secret_scan.train(sample)
    assert net.recall >= 0.98 and net.precision >= 0.9 and 0 < net.threshold <= 1
    assert secret_scan.train(sample.iloc[:5]) is None
    assert secret_scan.train(sample, min_recall=1.0).recall == 1.0
    # examples that cannot be told apart: everything passes, and it says so
    same = sample.assign(window=sample["window"].iloc[0])
    net = secret_scan.train(same)
    assert net.recall == 1.0 and net.precision < 0.7
    found = secret_scan.find_secrets(df).select("model.*").distinct().collect()
    assert len(found) == 1 and found[0]["recall"] >= 0.98
    assert secret_scan.find_secrets(df.limit(2)).select("model").first()["model"] is None


def test_secret_network_learns_from_all_labels(spark, monkeypatch):
    _, df = noted(spark, 400, ["assign", "hex"], 8)
    all_labels = secret_scan.labels(secret_scan.scan(df))
    seen = []
    kept = secret_scan.written
    monkeypatch.setattr(secret_scan, "written", lambda rows, name: seen.append((name, kept(rows, name))) or seen[-1][1])
    net = secret_scan.learn(all_labels, piece=200)
    pieces = dict(seen)["secret-pieces"].collect()
    assert len(pieces) > 3 and sum(len(r["part"]) for r in pieces) == all_labels.count() == all_labels.distinct().count()
    assert net.recall >= 0.98 and net.precision >= 0.9
    one = secret_scan.learn(all_labels, piece=10**6)
    plain = secret_scan.train(all_labels.toPandas().sort_values(["o", "kind", "window"], ignore_index=True))
    assert one.recall >= 0.98 and plain.recall >= 0.98 and plain.precision >= 0.9 and one.precision >= 0.9


def test_network_gradients_are_those_of_its_loss():
    r = np.random.default_rng(4)
    net, x, y, w = secret_scan.CharCNN(), r.integers(0, 97, (6, secret_scan.WIDTH)), np.array([1, 0, 1, 0, 1, 0.0]), np.ones(6)

    def loss():
        p = 1 / (1 + np.exp(-net.forward(x)[-1]))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in net.gradients(x, y, w).items():
        own = getattr(net, name)
        for at in list(np.ndindex(own.shape))[:: max(1, own.size // 25)]:
            was, found = own[at], []
            for d in (1e-3, -1e-3):
                own[at] = was + d
                found.append(loss())
            own[at] = was
            assert abs((found[0] - found[1]) / 2e-3 - g[at]) < 2e-3, (name, at)


@pytest.mark.parametrize("value", ["ab12cd", "x/" * 40_000 + "Ab1234567890"])
def test_short_and_very_long_candidates(spark, value):
    (_, own, _), = secret_scan.scan_texts([f"note {value} end"])
    assert own and own[0][:2] == (5, 5 + len(value))
    df = spark.createDataFrame([(1, f"note {value} end"), (2, None)], "doc_id long, text string")
    assert secret_scan.find_secrets(df).count() == 2


def test_candidates_are_seen_whole():
    text = "é ab " + "x1" * 70 + " Antidisestablishmentarianism wordword aB345678/plainpart=ab12cd34ef end"
    (base, own, _), = secret_scan.scan_texts([text])
    spans = [text[a:b] for a, b, _ in own]
    assert spans == ["x1" * 70, "Antidisestablishmentarianism", "aB345678/plainpart=ab12cd34ef", "aB345678", "ab12cd34ef"]
    seen = [w[secret_scan.BEFORE : secret_scan.BEFORE + secret_scan.INSIDE] for w in own[0][2]]
    assert len(seen) == 6 and seen[-1] == "x1" * 20 and base == []


def test_redaction_masks_and_keeps_rows(spark):
    texts, df = secrets_table(spark)
    df = df.withColumns({c: F.lit(1) for c in ("id", "key", "row", "own_id", "row_key", "candidates")})
    assert secret_scan.redact(df).columns == df.columns
    twice = secret_scan.redact(df.filter("doc_id = 6").union(df.filter("doc_id = 6"))).collect()
    assert [x["text"] for x in twice] == [texts[6][:24] + "[SECRET]"] * 2
    out = {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()}
    assert len(out) == len(texts) and out[0] is None and out[1] == ""
    for i, t in enumerate(texts):
        if plain_spans(t):
            assert "[SECRET]" in out[i] and all(t[a:b] not in out[i] for a, _, b in plain_spans(t) if b - a > 20)


def waterfill(sizes, weights, most=3):
    total, open_, target = float(sum(sizes)), set(range(len(sizes))), {}
    while open_:
        w = sum(weights[i] for i in open_)
        rest = total - sum(target.values())
        full = [i for i in open_ if rest * weights[i] / w >= most * sizes[i]]
        if not full:
            target |= {i: rest * weights[i] / w for i in open_}
            break
        target |= {i: most * sizes[i] for i in full}
        open_ -= set(full)
    return [target[i] for i in range(len(sizes))]


def test_mix_meets_its_targets(spark, tmp_path):
    r = random.Random(5)
    names = ["a", "b", "c", "d", "e", None, "é"]
    rows = [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 60))), s, 9) for i, s in enumerate(r.choices(names, [900, 40, 300, 5, 60, 100, 20], k=1500))]
    rows += [(2000, None, "a", 9), (2001, "", "zero", 9), rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    sizes = collections.Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda x: x.encode()) + [None]
    want = dict(zip(order, waterfill([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = source_mix.op3_source_mix(spark, str(tmp_path), block_docs=64).collect()
    again = source_mix.op3_source_mix(spark.newSession(), str(tmp_path), block_docs=64).collect()
    key = lambda x: (x["doc_id"], x["size"], x["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    source = {i: s for i, _, s, _ in rows}
    taken = collections.Counter()
    for x in got:
        assert x["target"] == pytest.approx(want[source[x["doc_id"]]]) and x["source_size"] == sizes[source[x["doc_id"]]]
        assert x["taken"] <= 3 * x["size"]
        taken[source[x["doc_id"]]] += x["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= max(60, 0.02 * want[s])


def test_mix_rows_are_the_copies_taken(spark, tmp_path):
    rows = [(i, f"{'w ' * (1 + i % 7)}", "ab"[i % 3 == 0], i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size__ long").withColumnRenamed("size__", "size")
    plans = source_mix.plan(source_mix.word_sizes(df), 4, 32, 7)
    want = {r["doc_id"]: len(r["shards__"]) for r in source_mix.assign(source_mix.word_sizes(df).withColumnRenamed("size", "size__"), plans, 7).collect()}
    mixed = source_mix.mix(df, 4, 32)
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == {k: n for k, n in want.items() if n}
    source_mix.write_shards(mixed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == sum(want.values())
    ids = [r["doc_id"] for r in mixed.filter("shard = 0").collect()]
    assert ids != sorted(ids) and ids == [r["doc_id"] for r in source_mix.mix(df.repartition(7), 4, 32).filter("shard = 0").collect()]
    clashing = df.withColumns({c: F.lit(1) for c in ("row", "order", "turn", "size__", "s__", "block__", "shards__")})
    assert source_mix.mix(clashing, 4, 32, shard_col=None).columns == clashing.columns
    with pytest.raises(ValueError, match="already"):
        source_mix.mix(df.withColumn("shard", F.lit(1)))


def test_empty_tables_pass_every_stage(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_many_blocks_of_one_source_are_dealt_by_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_mix, "CELL", 4)
    r = random.Random(6)
    rows = [(i, "w " * r.randint(1, 30), "a" if i % 3 else f"b{i % 5}") for i in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = source_mix.op3_source_mix(spark, str(tmp_path), block_docs=8).collect()
    taken, target = collections.Counter(), {}
    for x in got:
        taken[rows[x["doc_id"]][2]] += x["taken"]
        target[rows[x["doc_id"]][2]] = x["target"]
        assert len(x["orders"]) == len(x["shards"]) and x["taken"] == x["size"] * len(x["shards"])
    assert all(abs(taken[s] - t) <= 40 for s, t in target.items())
    copies = collections.Counter(s for x in got for s in x["shards"])
    assert len(copies) == 16 and max(copies.values()) < 3 * min(copies.values())


def test_quotas_are_exact_and_shards_even(spark):
    q = spark.createDataFrame([("a", 300), ("b", 7), (None, 33), ("z", 0)], "source string, quota long")
    out = source_mix.split_quotas(q, 8, 3).collect()
    per = collections.Counter()
    for x in out:
        per[x["source"]] += x["quota"]
        assert x["quota"] >= 0
    assert per == {"a": 300, "b": 7, None: 33, "z": 0}
    shard = collections.Counter()
    for x in out:
        shard[x["shard"]] += x["quota"]
    assert max(shard.values()) - min(shard.values()) <= 3 and len(shard) == 8


def test_hypergeometric_has_its_mean(spark):
    df = spark.range(3000).select(source_mix._hypergeometric(F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(25).cast("long"), source_mix._uniform(F.col("id"))).alias("x"))
    r = df.agg(F.avg("x"), F.variance("x"), F.min("x"), F.max("x")).first()
    assert r[0] == pytest.approx(10, abs=0.15) and r[1] == pytest.approx(25 * 0.4 * 0.6 * 25 / 49, rel=0.15) and r[2] >= 0 and r[3] <= 20


PAGES = [
    ("<p>One<p>Two", "One\n\nTwo"),
    ("<ul><li>a<li>b<ol><li>c</ol></ul>x", "- a\n- b\n  1. c\n\nx"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"),
    ("<head><title>T</title></head><body>x<script>var a='</p>'</script><style>p{}</style>y", "xy"),
    ("<div hidden>no</div><span style='display: none'>no</span>yes", "yes"),
    ("a&amp;b &lt;c&gt;<br>d", "a&b <c>\nd"),
    ("<pre>  x\n   y</pre>z", "  x\n   y\n\nz"),
    ("<!-- x --><b>unclosed", "unclosed"),
    ("", ""),
    (None, ""),
    ("a < b and <", "a < b and <"),
    ("<h1>H</h1>t<img alt='pic'>", "H\n\ntpic"),
    ("<div>" * 3000 + "deep", "deep"),
    ("<table><tr><th colspan=2>head<tr><td>1<td>2</table>", "head\n1 | 2"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_layout(page, want):
    assert html_text.extract(page) == want


def test_all_visible_words_are_there(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->", "", r["html"])
        want = re.sub(r"<[^>]*>", " ", body)
        words = [w for w in html_module.unescape(want).split()]
        mine = [w for w in got[r["page_id"]].split() if w not in ("-", "|")]
        assert mine == [w for w in words if w not in ("-", "|")]


def drawn(r, depth=0):
    """A random block as (html with optional end tags left out, its lines), worked out from the tree and not from the tags."""
    word = lambda: "".join(r.choices("abcdefg", k=r.randint(1, 8)))
    run = lambda: " ".join(word() for _ in range(r.randint(1, 6)))
    kind = r.choice(["p", "h2", "pre", "table", "ul", "ol", "hidden", "quote"])
    if kind in ("p", "h2"):
        t = run()
        return f"<{kind}>" + t.replace(" ", r.choice([" ", "\n  ", " <b> "])) + ("</h2>" if kind == "h2" else r.choice(["", "</p>"])), [t]
    if kind == "hidden":
        return f"<div hidden><p>{run()}<table><td>{word()}</table></div><script>var x = '<p>{word()}</p>';</script>", []
    if kind == "pre":
        lines = [" " * r.randint(0, 3) + word() for _ in range(r.randint(1, 3))]
        return "<pre>" + "\n".join(lines) + "</pre>", lines
    if kind == "quote":
        t = run()
        return f"<blockquote>{t}</blockquote>", ["  " + t]
    if kind == "table":
        rows = [[drawn_table(r, depth) if depth < 4 and r.random() < 0.15 else (t := word(), [t]) for _ in range(r.randint(1, 4))] for _ in range(r.randint(1, 4))]
        wide = [min(html_text.WIDEST, max(len(line) for x in rows if len(x) > c for line in x[c][1])) for c in range(max(map(len, rows)))]
        end = r.choice(["", "</td>"])
        page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}{end}" for c, _ in x) for x in rows) + "</table>"
        lines = []
        for x in rows:
            for k in range(max(len(c) for _, c in x)):
                lines.append(" | ".join((c[k] if k < len(c) else "").ljust(w) for (_, c), w in zip(x, wide, strict=False)).rstrip())
        return page, lines
    page, lines = "", []
    for k in range(r.randint(1, 4)):
        t = run()
        mark = f"{k + 1}. " if kind == "ol" else "- "
        page += f"<li>{t}"
        lines.append(mark + t)
        if depth < 3 and r.random() < 0.3:
            inner = None
            while inner is None or not inner[0].startswith(("<ul", "<ol")):
                inner = drawn(r, depth + 1)
            page += inner[0]
            lines += [" " * len(mark) + x for x in inner[1]]
        page += r.choice(["", "</li>"])
    return f"<{kind}>{page}</{kind}>", lines


def drawn_table(r, depth):
    """A table inside a cell."""
    while True:
        page, lines = drawn(r, depth + 1)
        if page.startswith("<table"):
            return page, lines


def test_layout_equals_what_random_trees_say():
    r = random.Random(21)
    for _ in range(1500):
        blocks = [drawn(r) for _ in range(r.randint(0, 5))]
        want = "\n\n".join("\n".join(x) for _, x in blocks if x)
        page = r.choice(["<html><head><title>T</title><body>", "<body>", ""]) + r.choice(["", "\n", "<!-- c -->"]).join(x for x, _ in blocks)
        assert html_text.extract(page) == want, page


def test_deep_and_long_pages_take_time_in_proportion():
    import time

    for page in ("<div>" * 20_000 + "x", "<div><p>" * 10_000 + "x", "<b>" * 20_000 + "</i>" * 20_000 + "x", "<p>word " * 100_000):
        began = time.process_time()
        assert html_text.extract(page)
        assert time.process_time() - began < 2.5


@pytest.mark.parametrize("unit", ["<table><tr><td>a", "<table><tr><td>a<td>b", "<ul><li>a", "<ol><li>a<blockquote>b", "<dl><dd>a<table><caption>c<tr><td>b", "<li>a<pre>b</pre>"])
def test_text_at_every_level_takes_time_and_room_in_proportion(unit):
    import time

    size, took = [], []
    for n in (1000, 4000):
        began = time.process_time()
        text = html_text.extract(unit * n)
        took.append(time.process_time() - began)
        size.append(len(text))
        letters = lambda x: {c: x.count(c) for c in "abc"}
        assert letters(text) == letters(re.sub("<[^>]*>", "", unit * n))  # no text is lost, in whatever depth
    assert took[1] < 3 and size[1] < 4.5 * size[0]


def test_what_is_too_deep_keeps_its_marks_and_order():
    deep = "<blockquote>" * 30
    assert html_text.extract(deep + "<ol><li>a<li><li>b<ul><li>c</ul><table><td>d<td>e</table></ol>f").split() == ["1.", "a", "3.", "b", "-", "c", "d", "e", "f"]


def test_script_ends_at_its_own_end_tag():
    assert html_text.extract("<script>a </scripting> b</script>c") == "c"


def test_html_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "<p>a", 0), (1, "<p>a", 0), (None, None, 0), (2, "<p>" + "w " * 300_000, 0)], "page_id long, html string, text int")
    got = sorted(((r["page_id"], len(r["text"])) for r in html_text.extract_text(df).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 599_999), (None, 0)]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_odd_pages_end():
    r = random.Random(8)
    bits = ["<p", "<", ">", "'", '"', "<table>", "<td", "</tr>", "<li>", "</ul>", "<pre>", "</pre>", "<script>", "<!--", "&amp", "x ", "<br/>", "<select><option>", "</p>", "<div hidden>", "</div>"]
    for _ in range(400):
        html_text.extract("".join(r.choices(bits, k=40)))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(rows):
    """{doc_id: text} of what the quality rules keep, by dictionaries."""
    key = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line.strip(" \t\n\x0b\x0c\r").lower())
    hosts, out = {}, {}
    for r in rows:
        hosts.setdefault(r["source"], set()).add(r["text"] or "")
    held = {s: collections.Counter(k for t in own for k in {key(x) for x in t.split("\n") if WORD.search(x)}) for s, own in hosts.items()}
    for r in rows:
        text = r["text"] or ""
        w = WORD.findall(text)
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = collections.Counter(wins)
        repeated = len({i + k for i, g in enumerate(wins) if often[g] > 1 for k in range(5)})
        limit = max(10, 0.01 * len(hosts[r["source"]]))
        lines = [x for x in text.split("\n") if not WORD.search(x) or held[r["source"]][key(x)] <= limit]
        left = len(WORD.findall("\n".join(lines)))
        if len(w) >= 10 and 100 * repeated <= 20 * len(w) and left >= 10 and left >= 0.3 * len(w):
            out[r["doc_id"]] = "\n".join(lines)
    return out


def plain_components(texts):
    """{doc_id: smallest doc_id that links lead to}, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return {i: find(i) for i in ids}


def plain_mask(text):
    out, at = [], 0
    for a, _, b in plain_spans(text):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_pipeline_against_plain_python(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    out = {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out[name] = docs.collect()
    quality, joined, secrets, mixed, encoded = (out[n] for n, _ in corpus_pipeline.STAGES)
    kept = plain_quality(before)
    assert {r["doc_id"]: r["text"] for r in quality} == kept and len(quality) == len(kept)
    one = plain_components(kept)
    assert {r["doc_id"]: r["text"] for r in joined} == {i: kept[i] for i, c in one.items() if i == c} and len(joined) == len(set(one.values()))
    masked = {r["doc_id"]: r["text"] for r in secrets}
    assert set(masked) == {r["doc_id"] for r in joined}
    more = [i for i, t in masked.items() if t != plain_mask(kept[i])]
    assert len(more) <= 0.02 * len(masked) and all("[SECRET]" in masked[i] for i in more)  # what the network adds
    source = {r["doc_id"]: r["source"] for r in before}
    size = {i: len(WORD.findall(t)) for i, t in masked.items()}
    per, taken = collections.Counter(), collections.Counter()
    for i, n in size.items():
        per[source[i]] += n
    for r in mixed:
        taken[source[r["doc_id"]]] += size[r["doc_id"]]
        assert r["text"] == masked[r["doc_id"]]
    names = sorted(per, key=lambda x: x.encode())
    for s, want in zip(names, waterfill([per[s] for s in names], [1 + k % 3 for k in range(len(names))]), strict=True):
        assert abs(taken[s] - want) <= max(60, 0.02 * want, max(n for i, n in size.items() if source[i] == s))  # a source has some ten documents here
    times = collections.Counter(r["doc_id"] for r in mixed)
    assert max(times.values()) <= 3 and collections.Counter(r["doc_id"] for r in encoded) == times
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in encoded:
        ids = library.encode(masked[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(masked[r["doc_id"]].encode()).hexdigest()
