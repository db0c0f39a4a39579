"""Exact n-gram Jaccard self-join with set-relation skipping.

Documents with equal shingle sets are one node. Shingles are ordered from rare to common
by their hash bucket's document count, over all documents. Two sets whose Jaccard
similarity reaches the threshold share a shingle in their prefixes under that order.

1. Nodes that agree on one of four MinHash values are compared with the value's leader,
   the node whose shingles are the most common ones on average: in a group of altered
   copies that is the original, to which all are nearest. Links of that kind gather large
   groups as stars.
2. Lists of the prefix shingles give the pairs that are not connected yet. A list is
   sorted by set size, so only the blocks of it within the size ratio are looked at, and
   positions in the prefix bound the overlap. Entries of one component are skipped.
3. Where a partner has a leader, only the leader is compared. The overlap with the
   partner is bounded from the leader's: by what the partner has over the leader and by
   what it lacks. Only partners that the bounds leave open are compared themselves.

The sets are compared exactly, on their 64-bit shingle hashes. Components then follow
from the links. No pair inside a component found in step 1 is built. Lists stream through
the tasks one after another; one list, five numbers an entry, is in memory at a time, and
equal sets are one entry a task in it, and its pairs are handed on ``PAIRS`` at a time. A list of more than ``LIST`` entries is dealt to
parts, and each two parts are a list of their own, of at most about twice as many.

Defined results: null and empty texts, and texts without words, have an empty set and are
linked with nothing; repeated rows are linked (they have equal sets); rows that share a
doc_id are told apart by their text, and a null doc_id is smaller than none, so it names a
component only where it is alone; texts of any length are read whole; an empty table gives
an empty table; other columns, of any name, pass through ``keep_one`` untouched.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.components import components
from tidebars.llm.durable import written
from tidebars.llm.shingles import mixed, overlap, shingle_sets, sliced

PERCENT = 80
BUCKET_BITS, CHUNK = 20, 1 << 13
KEY_BITS = 20  # buckets of the filter before the texts of nodes are fetched
SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], dtype=np.uint64)
LIST = 200_000  # entries of a list in one task's memory, about
SEEN = 2_000_000  # sets that a task remembers in order not to list them twice
PAIRS = 1_000_000  # pairs that a task gathers before it hands them on, about


def document_counts(docs: DataFrame) -> np.ndarray:
    """How many documents' shingles fall into each of 2**BUCKET_BITS hash buckets, over all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for s in sliced(texts):
                sets = [h >> np.uint64(64 - BUCKET_BITS) for h in shingle_sets(texts[s])]
                total += np.bincount(np.concatenate(sets).astype(np.int64), minlength=len(total))
        for k in range(len(total) // CHUNK):
            part = total[k * CHUNK : (k + 1) * CHUNK]
            if part.any():
                yield pd.DataFrame({"chunk": [k], "counts": [part.astype(np.uint32).tobytes() if part.max() < 2**32 else part.tobytes()]})

    def read(x: bytes) -> np.ndarray:
        return np.frombuffer(x, dtype=np.uint32 if len(x) == 4 * CHUNK else np.int64).astype(np.int64)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, dtype=np.int64)
        for x in pdf["counts"]:
            total += read(x)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "counts": [total.tobytes()]})

    parts = docs.select("text").mapInPandas(count, "chunk int, counts binary").withColumn("salt", F.spark_partition_id() % 32)
    some = parts.groupBy("chunk", "salt").applyInPandas(lambda pdf: add(pdf), "chunk int, counts binary")
    out = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for row in some.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").toLocalIterator():  # 2**BUCKET_BITS numbers
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = read(row["counts"])
    return out


def least_overlap(n: int, percent: int) -> int:
    """How much of a set of size ``n`` a linked set must share at least."""
    return -(-percent * n // 100)


def sets_table(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, row_key (hash of the text), node (hash of the set), n, and, once a set and task, how common its shingles are, MinHashes, prefix, and which of the prefix may have long lists."""
    counts = docs.sparkSession.sparkContext.broadcast(document_counts(docs))  # 8 MB
    longest = LIST

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order, seen = counts.value, set()
        for pdf in batches:
            texts = pdf["text"].tolist()
            for s in sliced(texts):
                node, size, common, mins, prefix, hot = [], [], [], [], [], []
                for h in shingle_sets(texts[s]):
                    size.append(len(h))
                    key = int.from_bytes(hashlib.md5(h.tobytes()).digest()[:8], "little", signed=True) if len(h) else None
                    node.append(key)
                    if key is None or key in seen:
                        common.append(None)
                        mins.append(None)
                        prefix.append(None)
                        hot.append(None)
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    p = len(h) - least_overlap(len(h), percent) + 1
                    seen_in = order[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                    by = np.lexsort((h, seen_in))[:p]
                    common.append(float(np.log1p(seen_in).mean()))
                    mins.append([mixed(h ^ x).min().view(np.int64) for x in SEEDS])
                    prefix.append(h[by].view(np.int64))
                    hot.append(h[by[seen_in[by] > longest]].view(np.int64))
                own = pdf[["doc_id", "row_key"]].iloc[s]
                yield own.assign(node=pd.array(node, dtype="Int64"), n=size, common=common, mins=mins, prefix=prefix, hot=hot)

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    kind = dict(docs.dtypes)["doc_id"]
    out = written(keyed.mapInPandas(run, f"doc_id {kind}, row_key long, node long, n int, common double, mins array<long>, prefix array<long>, hot array<long>"), "sets")
    counts.destroy()
    return out


def _alike(n: Column, m: Column, shared: Column, percent: int) -> Column:
    return 100 * shared >= percent * (n + m - shared)


def _in_buckets(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key may be among ``wanted``: those of its hash buckets, a table of at most 2**KEY_BITS numbers."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << KEY_BITS)).cast("int")
    some = F.broadcast(wanted.select(bucket(F.col(wanted.columns[0])).alias("bucket__")).distinct())
    return rows.withColumn("bucket__", bucket(F.col(key))).join(some, "bucket__", "left_semi").drop("bucket__")


def overlaps(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, shared) for (a, b) pairs of nodes, from the texts of one document each.

    Texts are fetched for the nodes in ``pairs`` only: a table of at most 2**KEY_BITS hash
    buckets goes to all tasks and lets few others through, then a join is exact.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct()
    own = sets.filter("prefix IS NOT NULL").select("node", "doc_id", "row_key").join(wanted, F.col("node") == F.col("w"), "left_semi")
    own = written(own.groupBy("node").agg(F.min(F.struct("doc_id", "row_key")).alias("r")), "jaccard-nodes")
    texts = docs.select(F.struct("doc_id", F.xxhash64("text").alias("row_key")).alias("r"), "text")
    texts = _in_buckets(texts, "r.row_key", own.select("r.row_key"))
    a, b = own.select(F.col("node").alias("a"), F.col("r").alias("r_a")), own.select(F.col("node").alias("b"), F.col("r").alias("r_b"))
    # the pairs carry the rows that stand for their nodes, so each side takes its texts in one join
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    right = texts.select(F.col("r").alias("r_b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("r").alias("r_a"), F.col("text").alias("text_a"))
    joined = both.join(right, "r_b").join(left, "r_a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, None
        for pdf in batches:
            for s in sliced(pdf["text_b"].tolist()):
                part = pdf.iloc[s]
                out = []
                for a, text, h in zip(part["a"], part["text_a"], shingle_sets(part["text_b"].tolist()), strict=True):
                    if a != key:  # a leader's pairs come one after another
                        key, kept = a, next(shingle_sets([text]))
                    out.append((len(kept), len(h), overlap(kept, h)))
                yield part[["a", "b"]].assign(n_a=[x[0] for x in out], n_b=[x[1] for x in out], shared=[x[2] for x in out])

    return joined.mapInPandas(run, "a long, b long, n_a int, n_b int, shared int").distinct()


def star_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): every node b with the leader a of each of its MinHash values, where their sizes allow a link."""
    keyed = sets.filter("mins IS NOT NULL").select("node", "n", "common", F.posexplode("mins").alias("k", "v"))
    lead = keyed.groupBy("k", "v").agg(F.max(F.struct("common", "node", "n")).alias("lead")).select(F.col("k").alias("lk"), F.col("v").alias("lv"), "lead.node", "lead.n")
    lead = lead.withColumnRenamed("node", "a").withColumnRenamed("n", "m")
    met = keyed.join(lead, (F.col("k") == F.col("lk")) & (F.col("v") == F.col("lv")))
    fits = (100 * F.col("m") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("m"))
    return met.filter((F.col("a") != F.col("node")) & fits).select("a", F.col("node").alias("b")).distinct()


def run_pairs(node: np.ndarray, n: np.ndarray, pos: np.ndarray, comp: np.ndarray, percent: int, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs of one list, sorted by size, that may be linked and are of different components, for one entry i after another.

    The entries of the most frequent component meet only those of the others. For each
    entry the list is skipped to the block within the size ratio. With ``side`` only entries of
    different sides meet.
    """
    names, of = np.unique(comp, return_inverse=True)
    main = of == np.bincount(of).argmax()
    firsts = np.arange(len(node)) if len(names) == len(node) else np.flatnonzero(~main)
    low = np.searchsorted(n, -(-percent * n[firsts] // 100), "left")
    high = np.searchsorted(n, 100 * n[firsts] // percent, "right")
    for i, a, b in zip(firsts, low, high, strict=True):
        j = np.arange(a, b)
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        good = (comp[j] != comp[i]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
        if side is not None:
            good &= side[j] != side[i]
        j = j[good]
        j = j[main[j] | (j > i)] if len(names) != len(node) else j[j > i]
        if len(j):
            yield np.full(len(j), i), j


def list_pairs(sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that share a prefix shingle and pass the bounds; b is its leader where it has one.

    ``known``: (node, component, lead) of the nodes that step 1 linked.
    """
    own = known.select(F.col("node").alias("k"), "component", "lead")
    rows = sets.filter("prefix IS NOT NULL").select("node", "n", "prefix")
    # only nodes that may be known are moved to their component; the others, the most, are components of their own
    bucket = F.pmod(F.xxhash64("node"), F.lit(1 << KEY_BITS)).cast("int")
    some = F.broadcast(known.select(bucket.alias("bucket__")).distinct())
    rows = rows.withColumn("bucket__", bucket)
    maybe = rows.join(some, "bucket__", "left_semi").join(own, F.col("node") == F.col("k"), "left")
    alone = rows.join(some, "bucket__", "left_anti").select("node", "n", "prefix", F.col("node").alias("component"), F.col("node").alias("lead"))
    rows = alone.unionByName(maybe.select("node", "n", "prefix", F.coalesce("component", "node").alias("component"), F.coalesce("lead", "node").alias("lead")))
    rows = rows.select("node", "n", "component", "lead", F.posexplode("prefix").alias("pos", "h"))
    # a cell is one list, or two parts of a long one: how many parts there are, and which two
    cell = F.lit(0).cast("long")
    long = sets.select(F.explode("hot").alias("long_h")).groupBy("long_h").agg(F.count("*").alias("size")).filter(F.col("size") > LIST)
    long = written(long.select("long_h", F.ceil(F.col("size") / LIST).cast("long").alias("parts")), "long-lists")
    if not long.isEmpty():
        own = F.pmod("node", "parts")
        other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        rows = rows.join(long, F.col("h") == F.col("long_h"), "left").withColumn("other", other)
        cell = F.when(F.col("parts").isNull(), cell).otherwise(F.shiftleft("parts", 40) + F.shiftleft(F.least(own, "other"), 20) + F.greatest(own, "other"))
    rows = rows.withColumn("cell", cell).select("node", "n", "component", "lead", "pos", "h", "cell")
    rows = rows.repartition(F.col("h"), F.col("cell")).sortWithinPartitions("h", "cell", "n", "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def starts(pdf: pd.DataFrame) -> np.ndarray:
            h, cell = pdf["h"].to_numpy(), pdf["cell"].to_numpy()
            return np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (cell[1:] != cell[:-1])]))

        def pairs(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            comp, cell = pdf["component"].to_numpy(), pdf["cell"].to_numpy()
            first = starts(pdf)
            size = np.diff(np.concatenate([first, [len(pdf)]]))
            lowest, highest = np.minimum.reduceat(comp, first), np.maximum.reduceat(comp, first)
            open_ = np.flatnonzero((size > 1) & (lowest != highest))
            if not len(open_):
                return
            node, n, pos, lead = (pdf[c].to_numpy().astype(np.int64) for c in ("node", "n", "pos", "lead"))
            left, right, gathered = [], [], 0

            def handed_on() -> pd.DataFrame:
                nonlocal gathered
                out = pd.DataFrame({"a": node[np.concatenate(left)], "b": lead[np.concatenate(right)]}).drop_duplicates()
                left.clear()
                right.clear()
                gathered = 0
                return out

            two = open_[(size[open_] == 2) & (cell[first[open_]] == 0)]  # by far the most
            i, j = first[two], first[two] + 1
            need = -(-percent * (n[i] + n[j]) // (100 + percent))
            good = (100 * n[i] >= percent * n[j]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
            left.append(i[good])
            right.append(j[good])
            for k in open_[(size[open_] > 2) | (cell[first[open_]] != 0)]:
                s = slice(first[k], first[k] + size[k])
                c, side = int(cell[first[k]]), None
                if c and (c >> 20) & 0xFFFFF != c & 0xFFFFF:  # two different parts: the pairs inside either are elsewhere
                    side = node[s] % (c >> 40)
                for i, j in run_pairs(node[s], n[s], pos[s], comp[s], percent, side):
                    left.append(i + first[k])
                    right.append(j + first[k])
                    gathered += len(j)
                    if gathered >= PAIRS:
                        yield handed_on()
            if left:
                yield handed_on()

        held: list[pd.DataFrame] = []  # the list that the last batch ended in
        for pdf in batches:
            if not len(pdf):
                continue
            cut = int(starts(pdf)[-1])
            same = bool(held) and (held[-1][["h", "cell"]].iloc[-1].tolist() == pdf[["h", "cell"]].iloc[0].tolist())
            if cut == 0 and same:
                held.append(pdf)
                continue
            done = pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = [pdf.iloc[cut:]]
            if len(done):
                yield from pairs(done)
        if held:
            yield from pairs(pd.concat(held, ignore_index=True))

    return rows.mapInPandas(run, "a long, b long").distinct()


def linked_nodes(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The written sets table, and (a, b) links of different nodes that connect all that are linked."""
    sets = sets_table(docs, percent)
    alike = _alike(F.col("n_a"), F.col("n_b"), F.col("shared"), percent)
    stars = written(overlaps(written(star_pairs(sets, percent), "star-pairs"), sets, docs).filter(alike), "star-links")
    groups = components(stars)
    leads = stars.groupBy("b").agg(F.min(F.struct("n_a", "a")).alias("x")).select(F.col("b").alias("m"), F.col("x.a").alias("lead"))
    known = written(groups.join(leads, F.col("node") == F.col("m"), "left").select("node", "component", "lead"), "star-groups")
    met = written(overlaps(written(list_pairs(sets, known, percent), "list-pairs"), sets, docs), "list-overlaps")
    # partners that only their leader stood for: the leader's overlap bounds theirs
    members = stars.join(leads, (F.col("b") == F.col("m")) & (F.col("a") == F.col("lead"))).select(
        F.col("lead").alias("l"), F.col("b").alias("y"), F.col("n_b").alias("n_y"), (F.col("n_b") - F.col("shared")).alias("more"), (F.col("n_a") - F.col("shared")).alias("less")
    )
    behind = met.filter(~alike).join(members, F.col("b") == F.col("l")).filter("a <> y")
    most = F.least(F.col("shared") + F.col("more"), F.col("n_a"), F.col("n_y"))
    behind = behind.filter(_alike(F.col("n_a"), F.col("n_y"), most, percent)).select("a", F.col("y").alias("b"), _alike(F.col("n_a"), F.col("n_y"), F.col("shared") - F.col("less"), percent).alias("sure"))
    behind = written(behind.distinct(), "behind-leaders")
    checked = overlaps(written(behind.filter("NOT sure").select("a", "b"), "open-pairs"), sets, docs).filter(alike)
    links = stars.select("a", "b").union(met.filter(alike).select("a", "b")).union(behind.filter("sure").select("a", "b")).union(checked.select("a", "b"))
    return sets, written(links.distinct(), "set-links")


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id and links (found links of its set to other sets) for every row of ``docs``."""
    sets, links = linked_nodes(docs, percent)
    groups = components(links)
    nodes = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    of = nodes.join(groups.withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    ids = of.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "c")
    count = links.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count("*").alias("links"))
    named = of.join(ids, F.col("component") == F.col("c")).join(count, F.col("node") == F.col("x"), "left").select(F.col("node").alias("k"), "component_id", "links")
    return sets.select("doc_id", "row_key", "n", "node").join(named, F.col("node") == F.col("k"), "left").select(
        "doc_id", "row_key", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links")
    )


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows of a component other than its smallest doc_id's; of repeated rows one stays."""
    found = classes(docs, percent).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    good = written(found.groupBy("doc_id", "row_key").agg(F.count("*").alias("times")), "kept-rows")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"))

    def rows(of: DataFrame) -> DataFrame:
        own = of.select(F.col("doc_id").alias("id"), F.col("row_key").alias("key"))
        return keyed.join(own, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left_semi")

    out = rows(good)
    if not good.filter("times > 1").isEmpty():  # only repeated rows need a shuffle to drop all but one
        out = rows(good.filter("times = 1")).unionByName(rows(good.filter("times > 1")).dropDuplicates(["own_id", "own_key"]))
    return out.select("row.*")


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i+4] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), h AS (SELECT doc_id, hash(s) AS s FROM g
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM h a JOIN h b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)
), r AS (
  SELECT a AS d, b AS c FROM l UNION SELECT r.d, l.b FROM r JOIN l ON r.c = l.a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, (SELECT min(c) FROM r WHERE d = w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""
