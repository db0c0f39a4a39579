"""Monte-Carlo resampling of trades and returns; draws are hashes of seed, simulation and step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.rolling import over
from tidebars.operators.metrics import with_drawdown


def _indexed(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by)
    return rows.withColumn("_i", F.row_number().over(over(by, *order)) - 1).withColumn("_n", F.count("*").over(w))


def _draw(seed: int, *parts: str | Column) -> Column:
    """60 bits of an MD5, which other engines can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def bootstrap_trades(trades: DataFrame, by: Sequence[str], simulations: int, seed: int = 1, pnl: str = "net_pnl", order: Sequence[str] = ("exit_ts",)) -> DataFrame:
    """(by, sim, step, pnl): as many trades as there are, drawn with replacement."""
    rows = _indexed(trades, by, order)
    sizes = rows.groupBy(*by).agg(F.max("_n").alias("_n"))
    steps = sizes.select(*by, "_n", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))).alias("sim")).select("*", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("step"))
    steps = steps.withColumn("_i", F.pmod(_draw(seed, *by, "sim", "step"), F.col("_n"))).drop("_n")
    return steps.join(rows.select(*by, "_i", F.col(pnl).alias("pnl")), [*by, "_i"]).select(*by, "sim", "step", "pnl")


def reshuffle_trades(trades: DataFrame, by: Sequence[str], simulations: int, keep: float = 1.0, seed: int = 1, pnl: str = "net_pnl", order: Sequence[str] = ("exit_ts",)) -> DataFrame:
    """(by, sim, step, pnl): the trades in a random order, the first max(1, round(keep * n)) of them."""
    rows = _indexed(trades, by, order).select(*by, "_i", "_n", F.col(pnl).alias("pnl"), F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))).alias("sim"))
    rows = rows.withColumn("step", F.row_number().over(over([*by, "sim"], _draw(seed, *by, "sim", "_i"), "_i")) - 1)
    return rows.filter(F.col("step") < F.greatest(F.lit(1), F.bround(keep * F.col("_n"), 0))).select(*by, "sim", "step", "pnl")


def path_summary(paths: DataFrame, by: Sequence[str], cash: float) -> DataFrame:
    """(by, sim, final_equity, total_return_pct, max_drawdown_pct) of simulated profits."""
    w = over([*by, "sim"], "step").rowsBetween(Window.unboundedPreceding, 0)
    rows = with_drawdown(paths.withColumn("equity", cash + F.sum("pnl").over(w)), cash, [*by, "sim"], order="step")
    out = rows.groupBy(*by, "sim").agg(F.max_by("equity", "step").alias("final_equity"), (F.min("drawdown") * 100).alias("max_drawdown_pct"))
    return out.withColumn("total_return_pct", (F.col("final_equity") / cash - 1) * 100)


def simulations(trades: DataFrame, by: Sequence[str], cash: float, n: int, drop: float = 0.1, seed: int = 1, order: Sequence[str] = ("exit_ts",)) -> DataFrame:
    """Summaries of n simulations by each method: bootstrap, reshuffle, dropout."""
    parts = {"bootstrap": bootstrap_trades(trades, by, n, seed, order=order), "reshuffle": reshuffle_trades(trades, by, n, 1.0, seed, order=order), "dropout": reshuffle_trades(trades, by, n, 1 - drop, seed + 1, order=order)}
    rows = [path_summary(p, by, cash).withColumn("method", F.lit(k)) for k, p in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def method_summary(sims: DataFrame, by: Sequence[str], col: str = "total_return_pct") -> DataFrame:
    q = F.percentile(col, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    g = sims.groupBy(*by, "method").agg(F.count("*").alias("sims"), F.min(col).alias("least"), F.max(col).alias("most"), q.alias("_q"))
    return g.select(*by, "method", "sims", "least", F.get("_q", F.lit(0)).alias("p05"), F.get("_q", F.lit(1)).alias("median"), F.get("_q", F.lit(2)).alias("p95"), "most")


def highlights(sims: DataFrame, by: Sequence[str], col: str = "final_equity") -> DataFrame:
    """(by, worst, median, best): the simulations at the ends and in the middle, by result, then number."""
    w = over(by, col, "sim")
    rows = sims.withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    pick = lambda k: F.max(F.when(F.col("_k") == k, F.col("sim")))
    return rows.groupBy(*by).agg(pick(0).alias("worst"), pick(F.floor(F.col("_n") / 2)).alias("median"), pick(F.col("_n") - 1).alias("best"))


def path_bands(paths: DataFrame, by: Sequence[str], cash: float, shares: Sequence[float] = (0.05, 0.5, 0.95), accuracy: int = 1000) -> DataFrame:
    """(by, step, sims, q): the quantiles of simulated equity after every step, from mergeable sketches that are off by a rank of at most 1 / ``accuracy``.

    Simulations of a step are summed up where they are made, so no task holds all of a step's.
    """
    w = over([*by, "sim"], "step").rowsBetween(Window.unboundedPreceding, 0)
    rows = paths.withColumn("equity", cash + F.sum("pnl").over(w))
    return rows.groupBy(*by, "step").agg(F.count("*").alias("sims"), F.percentile_approx("equity", list(shares), accuracy).alias("q"))


def capped_paths(paths: DataFrame, most: int) -> DataFrame:
    """The paths of the first simulations only, for drawing."""
    return paths.filter(F.col("sim") < most)


def block_bootstrap(rows: DataFrame, by: Sequence[str], col: str, simulations: int, block: int, seed: int = 1) -> DataFrame:
    """(by, sim, mean): means of series put together from moving blocks, cut to the series' length.

    A block's sum comes from running sums, so a simulation costs one row a block.
    """
    ranked = _indexed(rows, by, ("session",))
    run = F.sum(col).over(over(by, "_i").rowsBetween(Window.unboundedPreceding, 0))
    sums = ranked.select(*by, F.col("_i").alias("_at"), run.alias("_run"))
    sizes = ranked.groupBy(*by).agg(F.max("_n").alias("_n"))
    b = F.least(F.lit(block), F.col("_n")).cast("int")
    draws = sizes.withColumn("_b", b).select(*by, "_n", "_b", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))).alias("sim"))
    draws = draws.select("*", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_n") / F.col("_b")) - 1).cast("int"))).alias("_k"))
    draws = draws.withColumn("_s", F.pmod(_draw(seed, *by, "sim", "_k"), F.col("_n") - F.col("_b") + 1)).withColumn("_len", F.least(F.col("_b"), F.col("_n") - F.col("_k") * F.col("_b")))
    ends = draws.withColumn("_at", (F.col("_s") + F.col("_len") - 1).cast("int")).join(sums, [*by, "_at"]).withColumnRenamed("_run", "_high").drop("_at")
    out = ends.withColumn("_at", (F.col("_s") - 1).cast("int")).join(sums, [*by, "_at"], "left").withColumn("_part", F.col("_high") - F.coalesce("_run", F.lit(0.0)))
    return out.groupBy(*by, "sim").agg((F.sum("_part") / F.max("_n")).alias("mean"))
