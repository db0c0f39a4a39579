"""Hard negatives by Kronecker-packed products.

Candidates are dealt to blocks by hash, anchors to blocks of their own, and each pair of
blocks is one task. Several candidates' components, biased so that none is negative, stand
in separated fields of one wide integer, one integer a dimension; each is multiplied once by the
anchor's biased component and added up. A field is as wide as the largest sum, so no sum reaches the next
one, and masks unpack them; what the biases added is known from the components' sums, and what is left is the exact
score. Integers of up to 53 bits are held exactly in doubles, whose products run through
the processor's matrix routines; where not even two fields fit, Python's integers hold ``FIELDS``.

Two passes: the first finds each anchor's best rows of its own label, its positives; each positive's score
then sets a window, and the second pass finds the best rows of other labels in each window. A block
hands on its best ``k`` rows a list and no others, so what a window of ranks sorts is ``k`` rows a block.

Defined results: rows with a null label, id or vector, or a null or non-finite component take no
part; shorter vectors count as filled up with zeros; rows with the anchor's own id are neither its positives nor, where
labels differ, its negatives; other repeated rows are candidates each, and repeated anchors are answered once; higher scores come
first, ties by smaller id; an anchor without positives, or a positive with an empty
window, has no row; scores that may not fit 62 bits are refused with an error; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm.durable import written
from tidebars.llm.topk_search import _matrix, to_ints

BLOCK = 8192  # candidates of a block, about
ANCHOR_BLOCK = 8192  # anchors that a copy of a block serves, about
AT_ONCE = 256  # anchors that are multiplied at once
FIELDS = 16  # fields of an integer that has no width of its own


class Packed:
    """Candidates' components in fields of wide integers."""

    def __init__(self, x: np.ndarray, anchors: np.ndarray):
        """``anchors``: all that will be multiplied, for the bias and the fields' width."""
        self.n, self.dims = x.shape
        self.bias, self.anchor_bias = (-int(min(0, m.min(initial=0))) for m in (x, anchors))
        tops = [int(max(0, m.max(initial=0))) for m in (x, anchors)]
        most = max(1, self.dims) * (tops[0] + self.bias) * (tops[1] + self.anchor_bias)
        if most >= 2**62:
            raise ValueError("scores may exceed 62 bits")
        self.width = max(1, most.bit_length())
        self.fields = 53 // self.width if 2 * self.width <= 53 else FIELDS
        self.kind = np.float64 if 2 * self.width <= 53 else object
        self.sums = x.sum(1, dtype=np.int64)
        wide = np.zeros((self.dims, -(-self.n // self.fields)), dtype=np.int64 if self.kind is np.float64 else object)
        for f in range(self.fields):
            part = (x[f :: self.fields] + self.bias).T
            wide[:, : part.shape[1]] += part.astype(wide.dtype) << (self.width * f)
        self.wide = wide.astype(self.kind)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """The inner products (anchors, candidates)."""
        products = (anchors + self.anchor_bias).astype(self.kind) @ self.wide
        if self.kind is np.float64:
            products = products.astype(np.int64)
        out = np.empty((len(anchors), products.shape[1] * self.fields), dtype=np.int64)
        for f in range(self.fields):
            out[:, f :: self.fields] = (products >> (self.width * f)) & ((1 << self.width) - 1)
        added = self.anchor_bias * self.sums[None, :] + self.bias * anchors.sum(1)[:, None] + self.dims * self.bias * self.anchor_bias
        return out[:, : self.n] - added


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Of ``rows`` the k with the highest scores, ties to smaller ids, best first."""
    if len(rows) > k:
        bar = np.partition(scores[rows], len(rows) - k)[len(rows) - k]
        rows = rows[scores[rows] >= bar]
    return rows[np.lexsort((ids[rows], -scores[rows]))[:k]]


def _pairs(al: pd.DataFrame, xl: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the anchor, scores, rows of its label, rows of other labels), without rows of its own id."""
    if al.empty or xl.empty:
        return
    am, xm = _matrix(al["v"]), _matrix(xl["v"])
    width = max(am.shape[1], xm.shape[1])
    am, xm = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (am, xm))
    packed, ids, labels = Packed(xm, am), xl["id"].to_numpy(), xl["label"].to_numpy()
    own_ids, own_labels = al["id"].to_numpy(), al["label"].to_numpy()
    for a in range(0, len(am), AT_ONCE):
        scores = packed.scores(am[a : a + AT_ONCE])
        for j, s in enumerate(scores):
            same, other = labels == own_labels[a + j], ids != own_ids[a + j]
            yield a + j, s, np.flatnonzero(same & other), np.flatnonzero(~same & other)


def _positives(k: int) -> Callable:
    def found(key: tuple, al: pd.DataFrame, xl: pd.DataFrame) -> pd.DataFrame:
        ids, out = xl["id"].to_numpy(), [(np.zeros(0, int),) * 3]
        for i, scores, same, _ in _pairs(al, xl):
            rows = best(scores, ids, same, k)
            out.append((np.full(len(rows), i), ids[rows], scores[rows]))
        at, positive, score = (np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))
        return pd.DataFrame({"anchor_id": al["id"].to_numpy()[at], "h": al["h"].to_numpy()[at], "positive_id": positive, "positive_score": score})

    return found


def _negatives(k: int, low: int, high: int) -> Callable:
    def found(key: tuple, al: pd.DataFrame, xl: pd.DataFrame) -> pd.DataFrame:
        ids, out, windows = xl["id"].to_numpy(), [(np.zeros(0, int),) * 4], al["positives"].to_numpy()
        for i, scores, _, others in _pairs(al, xl):
            for p, positive in enumerate(windows[i]):
                score = int(positive["score"])
                inside = others[(scores[others] >= -(-low * score // 100)) & (scores[others] <= high * score // 100)]
                rows = best(scores, ids, inside, k)
                out.append((np.full(len(rows), i), np.full(len(rows), p), ids[rows], scores[rows]))
        at, place, negative, score = (np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))
        return pd.DataFrame({"anchor_id": al["id"].to_numpy()[at], "h": al["h"].to_numpy()[at], "place": place, "negative_id": negative, "negative_score": score})

    return found


def _meet(anchors: DataFrame, x: DataFrame, anchor_blocks: int, blocks: int, found: Callable, schema: str) -> DataFrame:
    """What ``found`` makes of every pair of an anchor block and a candidate block."""
    anchors = anchors.withColumn("ab", F.pmod(F.shiftright("h", 20), F.lit(anchor_blocks)).cast("int")).withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    x = x.withColumn("xb", F.pmod("h", F.lit(blocks)).cast("int")).withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    return anchors.groupBy("ab", "xb").cogroup(x.groupBy("ab", "xb")).applyInPandas(found, schema)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row of ``anchors`` its best ``positives`` rows of the same label, and for each of
    those the best ``negatives`` rows of other labels that score at least ``low`` and at most ``high``
    percent of the positive.
    """

    def ready(df: DataFrame) -> DataFrame:
        df = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), to_ints(F.col(f"`{vector_col}`"), scale).alias("v"))
        return df.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").withColumn("h", F.xxhash64("id", "label", "v"))

    x, a = ready(rows), written(ready(anchors).dropDuplicates(["id", "h"]), "anchors")
    blocks, anchor_blocks = max(1, math.ceil(x.count() / BLOCK)), max(1, math.ceil(a.count() / ANCHOR_BLOCK))
    found = _meet(a, x, anchor_blocks, blocks, _positives(positives), "anchor_id long, h long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id", "h").orderBy(F.col("positive_score").desc(), "positive_id")
    won = written(found.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < positives), "positives")
    lists = won.groupBy(F.col("anchor_id").alias("id"), "h").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: F.struct(p["positive_score"].alias("score"))).alias("positives"))  # at most ``positives`` each
    found = _meet(a.join(lists, ["id", "h"]), x, anchor_blocks, blocks, _negatives(negatives, low, high), "anchor_id long, h long, place int, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "h", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return found.join(won, ["anchor_id", "h", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", "embedding", label.alias("label"))
    return mine(rows, rows.filter("vec_id % 100 = 0"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
