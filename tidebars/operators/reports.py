"""Tables that stand behind reports: summaries by variant and fold, stitched curves, policies out of sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.rolling import over, ratio
from tidebars.operators.bars import KEYS


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the last in order."""
    w = over(keys, *[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def union_keep_last(history: DataFrame, target: DataFrame, keys: Sequence[str] = (*KEYS, "ts")) -> DataFrame:
    """History and target rows together; where both have a key, the target's row stays."""
    both = history.select(*target.columns).withColumn("_from", F.lit(0)).unionByName(target.withColumn("_from", F.lit(1)))
    return keep_last(both, keys, ["_from"]).drop("_from")


def with_session(rows: DataFrame, bars: DataFrame, ts: str = "entry_ts", keys: Sequence[str] = KEYS) -> DataFrame:
    """``session`` of the bar at each row's time; a bar time that stands twice counts once, the later session."""
    known = bars.groupBy(*keys, F.col("ts").alias(ts)).agg(F.max("session").alias("session"))
    return rows.drop("session").join(known, [*keys, ts], "left")


def resolved_candidates(signals: DataFrame, outcomes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The first signal of each session that could be entered, with its outcome; those that could not do not use the session up."""
    found = signals.select(*keys, "session", "ts").join(outcomes, [*keys, "session", "ts"])
    return found.withColumn("_n", F.row_number().over(over([*keys, "session"], "ts"))).filter("_n = 1").drop("_n")


def fold_summary(folds: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, folds, mean_return, median_return, worst_return, winning_folds, trades) of (by, fold, ret, trades) rows."""
    return folds.groupBy(*by).agg(
        F.countDistinct("fold").alias("folds"), F.avg("ret").alias("mean_return"), F.median("ret").alias("median_return"), F.min("ret").alias("worst_return"),
        F.count(F.when(F.col("ret") > 0, 1)).alias("winning_folds"), F.sum("trades").alias("trades"),
    )


def summary_with(summary: DataFrame, stitched: DataFrame, by: Sequence[str]) -> DataFrame:
    """A summary with the stitched curve's figures beside it."""
    return summary.join(stitched, list(by), "left")


def state_summary(filtered: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, candidates, allowed, allowed_rate, groups_valid) of filtered candidates."""
    g = filtered.groupBy(*by).agg(F.count("*").alias("candidates"), F.count(F.when(F.col("allowed"), 1)).alias("allowed"), F.max((F.col("status") == "valid").cast("int")).alias("valid"))
    return g.withColumn("allowed_rate", ratio(F.col("allowed").cast("double"), F.col("candidates").cast("double")))


def stability_pivot(stability: DataFrame, variants: Sequence[str], value: str = "share") -> DataFrame:
    """A row a parameter, a column a variant."""
    return stability.groupBy("parameter").pivot("variant", list(variants)).agg(F.avg(value))


def combinations_per_fold(trials: DataFrame, by: Sequence[str]) -> DataFrame:
    return trials.groupBy(*by).agg((F.count("*") / F.countDistinct("fold")).alias("combinations"))


def stitched(equity: DataFrame, capital: DataFrame, base: float, by: Sequence[str]) -> DataFrame:
    """Fold curves that each start with ``base``, moved to the cash that their fold starts with."""
    own = capital.select(*by, "fold", "start_cash")
    return equity.join(own, [*by, "fold"]).withColumn("equity", F.col("equity") - base + F.col("start_cash")).drop("start_cash")


def unaligned(curve: DataFrame, sessions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sessions that only one of a curve and a reference has; none where they are aligned."""
    a, b = curve.select(*by, "session").distinct(), sessions.select(*by, "session").distinct()
    keys = [*by, "session"]
    return a.join(b, keys, "left_anti").withColumn("only_in", F.lit("curve")).unionByName(b.join(a, keys, "left_anti").withColumn("only_in", F.lit("reference")))


def with_flat(results: DataFrame, wanted: DataFrame, by: Sequence[str], cash: float) -> DataFrame:
    """Results of all wanted keys; those without any kept their cash and made no trade."""
    out = wanted.select(*by).distinct().join(results, list(by), "left")
    return out.fillna({c: v for c, v in {"final_equity": cash, "trades": 0, "net_pnl": 0.0, "total_return_pct": 0.0, "max_drawdown_pct": 0.0, "ret": 0.0}.items() if c in out.columns})


def trial_rows(scores: DataFrame, by: Sequence[str], skipped: DataFrame | None = None) -> DataFrame:
    """Log rows of evaluated trials, and of folds whose optimisation was left out, told apart by ``status``."""
    rows = scores.withColumn("status", F.when(F.col("score") == float("-inf"), "ineligible").otherwise("evaluated"))
    if skipped is None:
        return rows
    return rows.unionByName(skipped.select(*by).withColumn("status", F.lit("skipped")), allowMissingColumns=True)


def policies(routes: DataFrame, returns: DataFrame, general: str, by: Sequence[str], costs: Sequence[tuple[str, float]] = (("normal", 0.0), ("stress", 0.0005))) -> DataFrame:
    """(by, policy, cost, session, candidate, ret): every policy's decision and return, session by session.

    Policies are the routed candidate and the general one; each cost level takes its share off traded sessions.
    Sessions whose candidate has no return are cash.
    """
    decided = routes.select(*by, "session", F.lit("regime").alias("policy"), "candidate").unionByName(routes.select(*by, "session", F.lit("general").alias("policy"), F.lit(general).alias("candidate")))
    levels = F.array(*[F.struct(F.lit(n).alias("cost"), F.lit(x).alias("_off")) for n, x in costs])
    rows = decided.select("*", F.inline(levels)).join(returns.select(*by, "session", "candidate", "ret"), [*by, "session", "candidate"], "left")
    r = F.col("ret")
    return rows.withColumn("ret", F.when(r.isNull() | (r == 0), 0.0).otherwise(r - F.col("_off"))).drop("_off")


def two_policies(decided: DataFrame, accepted: Column, keep: Sequence[str]) -> DataFrame:
    """(keep, policy, candidate, routed): the general candidate, and the routed one where its gate was accepted; cash where there is none."""
    general = F.coalesce("general", F.lit("cash"))
    chosen = F.coalesce(F.when(accepted, F.col("candidate")).otherwise(F.col("general")), F.lit("cash"))
    pair = [F.struct(F.lit(n).alias("policy"), c.alias("candidate"), r.alias("routed")) for n, c, r in (("general", general, F.lit(False)), ("regime", chosen, accepted))]
    return decided.select(*keep, F.inline(F.array(*pair)))


def policy_capital(decisions: DataFrame, cash: float, by: Sequence[str]) -> DataFrame:
    """The decisions with the cash after each session; a policy that loses everything stays at 0."""
    w = over([*by, "policy", "cost"], "session").rowsBetween(Window.unboundedPreceding, 0)
    gain = 1 + F.col("ret")
    grown = F.when(F.min(gain).over(w) > 0, cash * F.exp(F.sum(F.ln(F.when(gain > 0, gain))).over(w))).otherwise(0.0)
    return decisions.withColumn("cash", grown)


def compared(figures: DataFrame, by: Sequence[str], base: str, col: str) -> DataFrame:
    """Figures with the difference to the variant ``base`` of the same group."""
    reference = figures.filter(F.col("variant") == base).select(*by, F.col(col).alias("_base"))
    return figures.join(reference, list(by), "left").withColumn(f"{col}_difference", F.col(col) - F.col("_base")).drop("_base")
