"""Exact duplicates, hard negatives and the prefix trie against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.llm import conversation_trie, exact_dedup, hard_negatives

DOCS = "doc_id long, text string, n long, keep_id string, word long"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_groups(rows):
    by = collections.defaultdict(list)
    for i, t in rows:
        by[lowered(t)].append(i)
    return {(i, lowered(t)): (max((x for x in by[lowered(t)] if x is not None), default=None), len(by[lowered(t)])) for i, t in rows}


def test_exact_groups_equal_brute_force(spark, monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(exact_dedup, "PREFIX", 6)
    base = ["", None, "A b", "a B", "É", "é", "x" * 5000, "x" * 4999 + "y", "X" * 5000, "prefix one", "prefix two", "prefiX two"]
    texts = base + [r.choice(["same", "SAME", "sa me", "other", "öther", "ÖTHER"]) for _ in range(200)] + [f"t{r.randrange(40)}" for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "a b"), (None, "only null id"), (3, "a B")]
    for words in (1, 1 << 20):  # one word: nearly every key shares its bit with others
        monkeypatch.setattr(exact_dedup, "WORDS", words)
        df = spark.createDataFrame([(i, t, 7, "clash", 9) for i, t in rows], DOCS)
        got = exact_dedup.groups(df, carry={"text": F.col("text"), "n": F.col("n")}).collect()
        want = plain_groups(rows)
        assert len(got) == len(rows)
        assert all(want[x["doc_id"], lowered(x["text"])] == (x["keep_id"], x["group_size"]) and x["n"] == 7 for x in got)
        kept = collections.Counter(lowered(x["text"]) for x in got if x["kept"])
        assert kept == collections.Counter({lowered(t) for t in texts} | {"only null id"})
        assert all(x["doc_id"] == x["keep_id"] for x in got if x["kept"])


def test_exact_groups_of_an_empty_table_and_hashes(spark):
    assert exact_dedup.groups(spark.createDataFrame([], DOCS)).count() == 0
    got = exact_dedup.groups(spark.createDataFrame([(1, "Ab", 0, "", 0)], DOCS), carry={"sha": F.sha2(exact_dedup.ascii_lower(F.col("text")), 256)}).first()
    assert got["sha"] == hashlib.sha256(b"ab").hexdigest() and got["kept"] and got["group_size"] == 1


def test_a_unique_text_is_not_hashed_whole(spark):
    """Only rows whose length and prefix are shared pass the bitmap."""
    keys = exact_dedup.shared_keys(spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 7)], "n int, p long"), "n", "p")
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "n int, p long")
    got = exact_dedup.marked(rows, F.xxhash64("n", "p"), exact_dedup.bitmap(keys), "open").collect()
    assert {(x["n"], x["p"]): x["open"] for x in got} == {(1, 5): True, (1, 6): False, (2, 7): False}


TURNS = "conv_id long, turn long, role string, text string, n long, depth string"


def plain_turns(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by[conv].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    return {c: [(x[2], x[4]) for x in sorted(t)] for c, t in by.items()}


def plain_grafts(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = {}
    for node, held in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(z[: len(x)] == x and len(z) == len(x) + 1 for z in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(held) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        rows[min(held), len(node)] = (parent, len(held), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return rows


def trie_rows(df):
    got = df.collect()
    rows = {(x["conv_id"], x["depth"]): (x["parent_conv_id"], x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"], x["ends_sha256"]) for x in got}
    assert len(rows) == len(got)
    return rows


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in range(60):  # few different turns: prefixes are shared, end inside others, and diverge inside blocks
        conv = c if c % 7 else -c
        rows += [(conv, k * 3 if k else None, r.choice(["user", "é", None]) if k > 2 else "user", "t" + "ü" * r.randrange(1 + (k > 1)) if k % 3 else None) for k in range(r.randrange(1, 11))]
    same = [(0, "user", "hello"), (1, "assistant", "ä" * 300), (2, "user", "bye")]
    for c in range(100, 140):  # many copies, and copies that go on
        rows += [(c, *t) for t in same] + ([(c, 3, "user", f"more {c % 3}")] if c % 4 == 0 else [])
    rows += [(200, k, "user", "x" * (k % 5)) for k in range(70)] + [(201, k, "user", "x" * (k % 5)) for k in range(66)] + [(201, 66, "user", "other")]
    rows += [(300, 1, "user", "tie"), (300, 1, "user", "tie"), (300, 1, "assistant", "tie"), (None, 0, "user", "no id")]
    r.shuffle(rows)
    return rows


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 3)
    rows = conversations(8)
    df = spark.createDataFrame([(*x, 5, "clash") for x in rows], TURNS).repartition(5)
    assert trie_rows(conversation_trie.prefix_trie(df)) == plain_trie(plain_turns(rows))
    turns = conversation_trie.numbered(df)
    want = plain_grafts(plain_turns(rows))
    assert any(not t for t in want.values())
    assert trie_rows(conversation_trie.trie(*conversation_trie.grafted(turns))) == plain_trie(want)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    df = spark.createDataFrame([(lone, 0, "user", "gone", 0, "")], TURNS)
    got = trie_rows(conversation_trie.trie(*conversation_trie.grafted(conversation_trie.numbered(df))))
    assert got == {(lone, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())}


def plain_negatives(rows, every, positives=5, negatives=10):
    rows = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for i, label, v in rows:
        if i % every:
            continue
        others = sorted((-dot(v, w), j, m == label) for j, m, w in rows if j != i)
        for ps, p, _ in [x for x in others if x[2]][:positives]:
            inside = [x for x in others if not x[2] and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:negatives]
            out |= {(i, p, r, j, -ps, -s) for r, (s, j, _) in enumerate(inside, 1)}
    return out


VECTORS = "vec_id long, label int, embedding array<float>, h long, place string"


@pytest.mark.parametrize(("seed", "size", "block"), [(1, 1.0, 40), (2, 1.0, 8192), (3, 3000.0, 64)])
def test_negatives_equal_brute_force(spark, monkeypatch, seed, size, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 9)
    r = np.random.default_rng(seed)
    rows = [(i, int(r.integers(0, 4)), [float(x) for x in np.float32(r.normal(0, 0.3, 6) * size)]) for i in range(240)]
    rows += [(1000 + i, i % 2, rows[10][2]) for i in range(60)]  # the same vector many times: ties everywhere
    rows += [(2000, None, rows[0][2]), (2010, 1, None), (2020, 1, [1.0, None] + [0.0] * 4), (2030, 1, [float("nan")] * 6), (2040, 2, [float("inf")] * 6), (2050, 1, []), (2060, 3, [0.5, 0.5]), (None, 1, rows[0][2])]
    df = spark.createDataFrame([(*x, 7, "clash") for x in rows], VECTORS)
    got = [tuple(x) for x in hard_negatives.mine(df, df.filter("vec_id % 10 = 0")).collect()]
    assert len(got) == len(set(got)) and len(got) > 500
    assert set(got) == plain_negatives(rows, 10)


def test_packed_products_are_exact():
    r = np.random.default_rng(6)
    for most, kind in ((150, np.float64), (2**20, object)):
        x, a = (r.integers(-most, most, (n, 64)) for n in (101, 7))
        packed = hard_negatives.Packed(x, a)
        assert packed.kind is kind and packed.fields >= 2
        assert (packed.scores(a) == a @ x.T).all()
    one = np.array([[3, 0]])
    assert (hard_negatives.Packed(one, one).scores(one) == 9).all()
    with pytest.raises(ValueError):
        hard_negatives.Packed(np.full((2, 8), 2**40), np.full((2, 8), 2**40))


def test_negatives_of_repeated_rows_and_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (5, 1, [0.9, 0.0]), (5, 1, [0.9, 0.0]), (6, 2, [0.5, 0.0]), (6, 2, [0.5, 0.0]), (0, 2, [0.5, 0.0]), (7, 1, [-1.0, 0.0])]
    df = spark.createDataFrame([(*x, 0, "") for x in rows], VECTORS)
    got = collections.Counter((x["anchor_id"], x["positive_id"], x["rank"], x["negative_id"]) for x in hard_negatives.mine(df.filter("label = 1 OR vec_id <> 0"), df.filter("vec_id = 0 AND label = 1")).collect())
    assert got == collections.Counter({(0, 5, 1, 6): 2, (0, 5, 2, 6): 2})  # two positives, each with two negatives
