"""Exact top-k search by aggregating sorted lists without random access.

Candidates are dealt to blocks by hash, each with one sorted list a dimension. A query
reads the lists from the end that raises its score, all to the same depth, in rounds. What
has been read bounds a candidate's score from above (unread components count at the
frontier) and from below (at the list's far end), and the frontier alone bounds whatever
was not seen at all. The bar is the k-th best score or lower bound known so far: a query
first searches the block it hashes to, and carries that block's k-th score to all others.

A round costs little until it can decide something. The frontier's sum is held against
the bar first; then the bounds of ``PROBE`` candidates tell whether a bound of each would
leave few open; only then all are bounded, and outsiders, whose upper bound is below the
bar, are dropped for good. A query stops when at most ``RESOLVE`` times k are open; their
scores are resolved exactly. The probe decides when work is done, never what is found.

Defined results: vectors that are null, or hold a null or non-finite component, or have
no id take no part; shorter vectors count as filled up with zeros; repeated rows are
candidates each, and repeated queries are answered once; ties go to the smaller id; scores
that may not fit 64 bits are refused with an error; an empty table gives an empty table;
columns other than the id and the vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm.durable import written

BLOCK = 8192  # candidates of a block, about
QUERY_BLOCK = 16384  # queries that a copy of a block serves, about
AT_ONCE = 512  # queries that are bounded at once
DEPTHS = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)  # shares of the lists that are read before each test
PROBE = 128  # candidates of a block whose bounds are looked at first
FEW = 0.06  # share of open candidates under which bounding all of them pays
RESOLVE = 8  # a query stops when at most so many times k candidates are open


def to_ints(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(rows: pd.Series) -> np.ndarray:
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _working_type(q: np.ndarray, x: np.ndarray) -> type:
    """The fastest type in which all sums are exact."""
    most = max(1, x.shape[1]) * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0))
    if most >= 2**62:
        raise ValueError("scores may exceed 64 bits")
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class Block:
    """A block's sorted lists, and what they say about candidates at a depth."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, kind: type):
        self.x, self.ids, self.kind = x, ids, kind
        self.lists = np.sort(x, axis=0)  # ascending; a positive weight reads from the end, a negative one from the start
        self.by_id = np.argsort(ids, kind="stable")
        self.sorted_ids = ids[self.by_id]

    def frontier(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        return self.lists[len(self.x) - depth], self.lists[depth - 1]

    def above(self, depth: int, rows: slice | np.ndarray) -> np.ndarray:
        """What to multiply with (positive, negative) weights for upper bounds."""
        top, bottom = self.frontier(depth)
        return np.hstack([np.maximum(self.x[rows], top), np.minimum(self.x[rows], bottom)]).astype(self.kind)

    def below(self, depth: int, rows: slice | np.ndarray) -> np.ndarray:
        """The same for lower bounds."""
        (top, bottom), x = self.frontier(depth), self.x[rows]
        return np.hstack([np.where(x >= top, x, self.lists[0]), np.where(x <= bottom, x, self.lists[-1])]).astype(self.kind)

    def own(self, query_id: int) -> np.ndarray:
        """The rows that have the query's own id."""
        return self.by_id[np.searchsorted(self.sorted_ids, query_id, "left") : np.searchsorted(self.sorted_ids, query_id, "right")]


def search_block(q: np.ndarray, q_ids: np.ndarray, block: Block, k: int, bars: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each query the rows of the block's best candidates, at most k, and their scores, best first; and how deep its lists were read.

    ``bars``: a score that k candidates elsewhere reach, NaN where none is known; candidates below it may be missing.
    """
    n, kind = len(block.x), block.kind
    least = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    known = ~np.isnan(bars)
    bar = np.where(known, bars, 0).astype(kind)
    bar[~known] = least
    weights = np.hstack([np.maximum(q, 0), np.minimum(q, 0)]).astype(kind)
    out: list = [None] * len(q)
    reads = np.full(len(q), n)
    alive: dict[int, np.ndarray] = {}  # the candidates that queries have not dropped, once they have dropped some

    def resolve(i: int, rows: np.ndarray) -> None:
        rows = rows[block.ids[rows] != q_ids[i]]
        score = block.x[rows] @ q[i]
        best = np.lexsort((block.ids[rows], -score))[:k]
        out[i] = (rows[best], score[best])

    open_ = np.arange(len(q))
    for share in DEPTHS:
        depth = int(n * share)
        if n <= RESOLVE * k or not len(open_):
            break
        if depth < 1:
            continue
        unseen = weights[open_] @ np.concatenate(block.frontier(depth)).astype(kind)
        going = open_[(unseen <= bar[open_]) | ~known[open_]]  # else something that was not seen may still qualify
        fresh = np.array([i for i in going if i not in alive], dtype=int)
        if len(fresh):
            part = slice(0, PROBE)
            upper = weights[fresh] @ block.above(depth, part).T
            floor = bar[fresh]
            if not known[fresh].all():
                floor = np.maximum(floor, (weights[fresh] @ block.below(depth, part).T).max(1))
            fresh = fresh[(upper >= floor[:, None]).mean(1) <= FEW]
        if len(fresh):
            blind = fresh[~known[fresh]]
            if len(blind):
                lower = weights[blind] @ block.below(depth, slice(None)).T
                for j, i in enumerate(blind):
                    lower[j, block.own(q_ids[i])] = least
                bar[blind] = np.maximum(bar[blind], np.partition(lower, n - k, axis=1)[:, n - k])
                del lower
            upper = weights[fresh] @ block.above(depth, slice(None)).T
            for j, i in enumerate(fresh):
                alive[i] = np.flatnonzero(upper[j] >= bar[i])
            del upper
        for i in going:
            if i not in alive:
                continue
            if len(alive[i]) > RESOLVE * k and not (len(fresh) and i in fresh):
                alive[i] = alive[i][weights[i] @ block.above(depth, alive[i]).T >= bar[i]]
            if len(alive[i]) <= RESOLVE * k:
                reads[i] = depth
                resolve(i, alive[i])
        open_ = np.array([i for i in open_ if out[i] is None], dtype=int)
    for i in open_:  # lists that had to be read to the end
        resolve(i, alive.get(i, np.arange(n)))
    return out, reads


FOUND = "query_id long, qh long, id long, score long, depth double"


def _search(ql: pd.DataFrame, xl: pd.DataFrame, k: int) -> pd.DataFrame:
    """The candidates of one block for its queries (id, h, v, bar)."""
    parts = [pd.DataFrame({"query_id": [], "qh": [], "id": [], "score": [], "depth": []})]
    if ql.empty or xl.empty:
        return parts[0]
    qm, xm = _matrix(ql["v"]), _matrix(xl["v"])
    width = max(qm.shape[1], xm.shape[1])
    qm, xm = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (qm, xm))
    block = Block(xm, xl["id"].to_numpy(), _working_type(qm, xm))
    q_ids, hashes, bars = ql["id"].to_numpy(), ql["h"].to_numpy(), ql["bar"].to_numpy(dtype=float)
    for a in range(0, len(qm), AT_ONCE):
        s = slice(a, a + AT_ONCE)
        found, reads = search_block(qm[s], q_ids[s], block, k, bars[s])
        sizes = [len(r) for r, _ in found]
        parts.append(
            pd.DataFrame(
                {
                    "query_id": np.repeat(q_ids[s], sizes),
                    "qh": np.repeat(hashes[s], sizes),
                    "id": np.concatenate([block.ids[r] for r, _ in found]),
                    "score": np.concatenate([x for _, x in found]).astype(np.int64),
                    "depth": np.repeat(reads / len(xm), sizes),
                }
            )
        )
    return pd.concat(parts[1:], ignore_index=True)


def search(vectors: DataFrame, queries: DataFrame, k: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(query_id, qh, id, score, depth): every block's best candidates of every query, and what share of the block's lists it read for them."""

    def ready(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), to_ints(F.col(vector_col), scale).alias("v"))
        return df.filter("id IS NOT NULL AND v IS NOT NULL").withColumn("h", F.xxhash64("id", "v"))

    x, q = ready(vectors), ready(queries).dropDuplicates(["id", "h"])
    n_x, n_q = x.count(), q.count()
    x_blocks, q_blocks = max(1, math.ceil(n_x / BLOCK)), max(1, math.ceil(n_q / QUERY_BLOCK))
    block = F.pmod("h", F.lit(x_blocks)).cast("int")
    x, q = x.withColumn("xb", block), q.withColumn("home", block)

    def home(key: tuple, ql: pd.DataFrame, xl: pd.DataFrame) -> pd.DataFrame:
        return _search(ql.assign(bar=np.nan), xl, k)

    first = written(q.withColumnRenamed("home", "xb").groupBy("xb").cogroup(x.groupBy("xb")).applyInPandas(home, FOUND), "topk-home")
    if x_blocks == 1:
        return first
    bars = first.groupBy(F.col("query_id").alias("b_id"), F.col("qh").alias("b_h")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    bars = bars.filter(F.col("n") >= k).select("b_id", "b_h", F.col("least").cast("double").alias("bar"))
    q = q.join(bars, (F.col("id") == F.col("b_id")) & (F.col("h") == F.col("b_h")), "left").select("id", "h", "v", "bar", "home")
    q = q.withColumn("qb", F.pmod(F.shiftright("h", 20), F.lit(q_blocks)).cast("int")).withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(x_blocks - 1)))).filter("xb <> home")
    x = x.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def others(key: tuple, ql: pd.DataFrame, xl: pd.DataFrame) -> pd.DataFrame:
        return _search(ql, xl, k)

    return first.unionByName(q.groupBy("qb", "xb").cogroup(x.groupBy("qb", "xb")).applyInPandas(others, FOUND))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k candidates of ``vectors`` with the highest inner product for every row of ``queries``."""
    won = search(vectors, queries, k, scale, id_col, vector_col)
    rank = F.row_number().over(Window.partitionBy("query_id", "qh").orderBy(F.col("score").desc(), "id"))
    return won.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op1_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
) WHERE rank <= 20
"""
