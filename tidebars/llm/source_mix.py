"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks, hash buckets of about ``block_docs`` documents. Its
target fixes how many blocks it gives: whole passes over all its blocks, then blocks in
a permuted order, then documents of the one block that the target cuts in two. The
exact block quotas of all sources stand at the root of a binary tree over the output
shards; each node deals its quotas to its two halves by a multivariate hypergeometric
draw, so the leaves hold what a global shuffle would give them. Each leaf takes the next
blocks of every source's permuted sequence, disjoint from the other leaves', and shuffles
its documents locally: it orders them by a hash, in ``PIECES`` pieces.

Only SQL functions are used, and all randomness is a hash of a seed, so reruns agree
whatever the partitioning. What is joined to the documents is small and written first:
one row a source, one row a block, and the documents of one block a source. Running sums
over the blocks of a source go by cells of about ``CELL`` blocks, so no source is one task's
work; only what has one entry a source is (sources number in the thousands, not millions).

Defined results: a null source is a source (the last in order); a text that is null or
has no words has size 0 and takes part with no words; rows equal in doc_id, source and
size are one unit and are taken equally often; an empty table gives an empty table;
other columns, of any name, pass through ``mix`` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm.durable import written
from tidebars.llm.text import n_words

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
CELL = 1024
PIECES = 64


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that the parts determine."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))


def targets(units: DataFrame, block_docs: int, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row a source: its size, weight, target and number of blocks.

    Targets share the total size by weight, stop at ``most`` times a source's size, and
    pass the excess on by weight: sources by size per weight, ascending, are full as long
    as what the earlier full ones leave would overfill them.
    """
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", most * F.col("source_size").cast("double"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole).cast("double")
    per = per.withColumn(
        "full",
        F.col("cap") / F.col("weight") * (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        <= total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
    )
    level = F.try_divide(total - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0.0)), F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole))
    return per.select(
        "source",
        "source_size",
        "units",
        "weight",
        F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight"))).alias("target"),
        F.greatest(F.lit(1), F.ceil(F.col("units") / block_docs)).cast("long").alias("n_blocks"),
    )


def _ln_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series at x + 4."""
    y = x + 4.0
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) - F.ln(x * (x + 1.0) * (x + 2.0) * (x + 3.0))


def _hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` blocks out of ``total`` are among the ``good`` ones, at quantile ``u``.

    The distribution is inverted within 8 standard deviations, where all its mass is; the
    result always lies in its support, so quotas stay exact.
    """
    n = F.greatest(total, F.lit(1)).cast("double")
    mean = drawn * good / n
    spread = F.ceil(8 * F.sqrt(mean * (1 - good / n) * (n - drawn) / F.greatest(n - 1, F.lit(1.0)))) + 8
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - good), (F.floor(mean) - spread).cast("long"))
    high = F.least(drawn, good, (F.ceil(mean) + spread).cast("long"))
    k = F.sequence(low, F.greatest(low, high))
    logs = F.transform(k, lambda x: -(_ln_gamma(x + 1.0) + _ln_gamma(good - x + 1.0) + _ln_gamma(drawn - x + 1.0) + _ln_gamma(total - good - drawn + x + 1.0)))
    # one-element arrays bind what the inner folds use again and again
    mass = F.aggregate(
        F.transform(F.array(logs), lambda v: F.struct(v.alias("v"), F.array_max(v).alias("top"))),
        F.array().cast("array<double>"),
        lambda _, s: F.transform(s["v"], lambda x: F.exp(x - s["top"])),
    )
    below = F.aggregate(
        F.transform(F.array(mass), lambda p: F.struct(p.alias("p"), (u * F.aggregate(p, F.lit(0.0), lambda a, x: a + x)).alias("goal"))),
        F.lit(0).cast("long"),
        lambda _, s: F.aggregate(
            s["p"],
            F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n")),
            # counts the outcomes whose cumulative mass stays at or below the goal
            lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), (acc["n"] + F.when(acc["sum"] + x <= s["goal"], 1).otherwise(0)).alias("n")),
        )["n"],
    )
    return F.least(low + below, F.greatest(low, high))


def _dealer(seed: int, level: int) -> Callable[[Column, Column], Column]:
    """A fold over a node's (source, quota) entries that draws the left half's quotas one after another."""

    def deal(acc: Column, x: Column) -> Column:
        u = _uniform(F.lit(seed), F.lit(level), F.col("shard"), F.size(acc["left"]))
        got = _hypergeometric(acc["rest"], x["quota"], acc["seats"], u)
        return F.struct((acc["rest"] - x["quota"]).alias("rest"), (acc["seats"] - got).alias("seats"), F.concat(acc["left"], F.array(got)).alias("left"))

    return deal


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, source, quota): the exact block quotas (source, quota) dealt to ``shards`` (a power of two) leaves.

    The root is one row with an entry a source; each level is a projection that doubles the rows.
    """
    node = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "quota"))).alias("q")).select(F.lit(0).alias("shard"), "q")
    for level in range(int(math.log2(shards))):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["quota"])
        start = F.struct(total.alias("rest"), F.floor((total + F.col("shard") % 2) / 2).cast("long").alias("seats"), F.array().cast("array<bigint>").alias("left"))

        dealt = node.withColumn("left", F.aggregate("q", start, _dealer(seed, level))["left"])
        node = dealt.select(
            F.posexplode(
                F.array(
                    F.zip_with("q", "left", lambda x, n: F.struct(x["source"].alias("source"), n.alias("quota"))),
                    F.zip_with("q", "left", lambda x, n: F.struct(x["source"].alias("source"), (x["quota"] - n).alias("quota"))),
                )
            ).alias("side", "half"),
            "shard",
        ).select((F.col("shard") * 2 + F.col("side")).alias("shard"), F.col("half").alias("q"))
    return node.select("shard", F.inline("q"))


def _cut_block(units: DataFrame) -> DataFrame:
    """Which units of the cut blocks (one a source; column ``need``: words still to take) are taken once more.

    A random prefix first, then, in four rounds, the largest units that still fit, and the
    smallest one left if that comes nearer.
    """
    mine = Window.partitionBy("source")
    weight = F.col("size") * F.col("n")
    out = units.withColumn("rest", F.col("need")).withColumn("extra", F.lit(0))
    for turn in range(5):
        order = [F.col("u"), F.col("doc_id")] if turn == 0 else [weight.desc(), F.col("u"), F.col("doc_id")]
        fits = (F.col("extra") == 0) & (weight <= F.col("rest"))
        run = F.sum(F.when(fits, weight).otherwise(0)).over(mine.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("now", (fits & (run <= F.col("rest"))).cast("int"))
        out = out.withColumn("extra", F.col("extra") + F.col("now")).withColumn("rest", F.col("rest") - F.sum(weight * F.col("now")).over(mine))
    first = F.row_number().over(mine.orderBy(F.when(F.col("extra") == 0, weight).asc_nulls_last(), F.col("u"), F.col("doc_id"))) == 1
    last = first & (F.col("extra") == 0) & (weight - F.col("rest") < F.col("rest"))
    return out.withColumn("extra", F.col("extra") + last.cast("int")).select("source", "doc_id", "size", "extra")


def _running(rows: DataFrame, u: Column, ties: list[str], value: str, out: str) -> DataFrame:
    """``rows`` (source, n_blocks and others) with the running sum of ``value`` in each source, in the order of ``u`` in [0, 1), then ``ties``."""
    rows = rows.withColumn("u_", u).withColumn("cell", F.floor(F.col("u_") * F.ceil(F.col("n_blocks") / CELL)))
    sums = rows.groupBy("source", "cell").agg(F.sum(value).alias("part"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    sums = sums.select(F.col("source").alias("c_source"), F.col("cell").alias("c_cell"), F.coalesce(F.sum("part").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "cell").orderBy("u_", *ties).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum(value).over(inside))
    joined = rows.join(sums, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("cell") == F.col("c_cell")))
    return joined.withColumn(out, F.col("before") + F.col("inside")).drop("u_", "cell", "inside", "before", "c_source", "c_cell")


def plan(sizes: DataFrame, shards: int, block_docs: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For (doc_id, source, size): the written tables of sources, of blocks with the shards of their draws, and of cut blocks."""
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumn("u", _uniform(F.lit(seed), F.col("doc_id"), F.col("size")))
    units = written(units, "mix-units")
    sources = written(targets(units, block_docs), "mix-sources")
    own = sources.select(F.col("source").alias("s"), "n_blocks", "source_size", "target")
    placed = units.join(own, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.floor(F.col("u") * F.col("n_blocks")))
    blocks = placed.groupBy("source", "block").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("n_blocks").alias("n_blocks"))
    blocks = _running(blocks, _uniform(F.lit(seed), F.lit("block"), F.col("source"), F.col("block")), ["block"], "words", "end")
    passes = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    blocks = (
        blocks.withColumn("passes", F.least(passes, F.lit(MOST_REPEATS).cast("long")))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("whole", (F.col("end") <= F.col("rest")) & (F.col("words") > 0))
        .withColumn("need", F.when(~F.col("whole") & (F.col("end") - F.col("words") < F.col("rest")) & (F.col("words") > 0), F.col("rest") - (F.col("end") - F.col("words"))))
    )
    blocks = written(blocks.select("source", "block", "n_blocks", "passes", "whole", "need"), "mix-blocks")

    draws = blocks.withColumn("draws", F.expr("passes + CASE WHEN whole OR need IS NOT NULL THEN 1L ELSE 0L END"))
    leaves = split_quotas(draws.groupBy("source").agg(F.sum("draws").alias("quota")), shards, seed)
    ends = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    leaves = leaves.withColumn("to", F.sum("quota").over(ends)).groupBy(F.col("source").alias("s")).agg(F.array_sort(F.collect_list("to")).alias("ends"))  # one entry a shard
    drawn = draws.filter("draws > 0").select("source", "block", "n_blocks", F.explode(F.expr("sequence(1L, draws)")).alias("turn")).withColumn("one", F.lit(1).cast("long"))
    drawn = _running(drawn, _uniform(F.lit(seed), F.lit("draw"), F.col("source"), F.col("block"), F.col("turn")), ["block", "turn"], "one", "nth")
    shard = F.size(F.filter("ends", lambda e: e < F.col("nth")))
    homes = (
        drawn.join(written(leaves, "mix-leaves"), F.col("source").eqNullSafe(F.col("s")))
        .select("source", "block", "turn", shard.alias("shard"))
        .groupBy("source", "block")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "shard"))).alias("homes"))  # at most MOST_REPEATS
        .select(F.col("source").alias("h_source"), F.col("block").alias("h_block"), F.transform("homes", lambda x: x["shard"]).alias("shards"))
    )
    blocks_homed = blocks.join(homes, F.col("source").eqNullSafe(F.col("h_source")) & (F.col("block") == F.col("h_block")), "left").drop("h_source", "h_block", "n_blocks")
    blocks_homed = written(blocks_homed, "mix-homes")
    cut = blocks.filter("need IS NOT NULL").select(F.col("source").alias("c_source"), F.col("block").alias("c_block"), "need")
    part = written(_cut_block(placed.join(cut, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("block") == F.col("c_block")))), "mix-part")
    return sources, blocks_homed, part


def assign(rows: DataFrame, plans: tuple[DataFrame, DataFrame, DataFrame], seed: int) -> DataFrame:
    """``rows`` (doc_id, source, size__ and any others) with ``shards__``: the shard of each copy that the mix takes."""
    sources, blocks, part = plans
    own = sources.select(F.col("source").alias("s__"), F.col("n_blocks").alias("n_blocks__"), F.col("source_size").alias("source_size__"), F.col("target").alias("target__"))
    blocks = blocks.select(F.col("source").alias("b_source__"), F.col("block").alias("b_block__"), F.col("passes").alias("passes__"), F.col("whole").alias("whole__"), F.col("shards").alias("homes__"))
    part = part.select(F.col("source").alias("p_source__"), F.col("doc_id").alias("p_id__"), F.col("size").alias("p_size__"), F.col("extra").alias("extra__"))
    col = F.col
    out = (
        rows.join(own, col("source").eqNullSafe(col("s__")), "left")
        .withColumn("block__", F.floor(_uniform(F.lit(seed), col("doc_id"), col("size__")) * col("n_blocks__")))
        .join(blocks, col("source").eqNullSafe(col("b_source__")) & (col("block__") == col("b_block__")), "left")
        .join(part, col("source").eqNullSafe(col("p_source__")) & col("doc_id").eqNullSafe(col("p_id__")) & (col("size__") == col("p_size__")), "left")
    )
    copies = col("passes__") + F.when(col("whole__"), 1).otherwise(F.coalesce(col("extra__"), F.lit(0)))
    return out.withColumn("shards__", F.slice(F.coalesce(col("homes__"), F.array().cast("array<int>")), F.lit(1), copies.cast("int")))


def word_sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def _order(seed: int, shard: Column, turn: Column) -> Column:
    """Where a copy of a document stands in its shard."""
    return F.xxhash64(F.lit(seed), F.lit("order"), shard, F.col("doc_id"), F.col("size__"), turn)


def mix(docs: DataFrame, shards: int = 16, block_docs: int = 256, seed: int = 7, shard_col: str | None = "shard") -> DataFrame:
    """The mixed rows: every row of ``docs`` once for each time it is taken, with all its columns and, unless ``shard_col`` is None, its shard.

    A piece of a shard is in one partition, in the order of its hash. A column of ``docs`` that has the shard
    column's name is refused.
    """
    if shard_col in docs.columns:
        raise ValueError(f"there is a column {shard_col} already")
    plans = plan(word_sizes(docs), shards, block_docs, seed)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size__"))
    out = assign(rows, plans, seed).select("row", "doc_id", "size__", F.posexplode("shards__").alias("turn", "shard"))
    out = out.select("row", "shard", _order(seed, F.col("shard"), F.col("turn")).alias("order"))
    out = out.repartition("shard", F.pmod("order", F.lit(PIECES))).sortWithinPartitions("shard", "order")
    return out.select("row.*") if shard_col is None else out.select("row.*", F.col("shard").alias(shard_col))


def write_shards(mixed: DataFrame, path: str) -> None:
    """Write the mix, one folder a shard, its rows in their order."""
    mixed.write.partitionBy("shard").parquet(path)


def op3_source_mix(spark, sf_dir: str, shards: int = 16, block_docs: int = 256, seed: int = 7) -> DataFrame:
    sizes = written(word_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")), "mix-sizes")
    rows = assign(sizes.withColumnRenamed("size", "size__"), plan(sizes, shards, block_docs, seed), seed)
    return rows.select(
        "doc_id", F.col("size__").alias("size"), F.col("source_size__").alias("source_size"), F.col("target__").alias("target"),
        (F.col("size__") * F.size("shards__")).alias("taken"), F.col("shards__").alias("shards"),
        F.transform("shards__", lambda x, k: _order(seed, x, k)).alias("orders"),
    )
