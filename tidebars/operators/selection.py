"""Scores over blocks, volatility regimes, and the choice of a candidate for each regime."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.rolling import full, over, ratio
from tidebars.operators.metrics import with_drawdown, with_path

REGIMES = ("low", "normal", "high")
DAYS = 252
EVEN = 1e-12  # falls as near as this are the same: paths of equal returns differ by rounding


def session_volatility(closes: DataFrame, keys: Sequence[str] = ("symbol",), n: int = 20) -> DataFrame:
    """(keys, session, volatility): the deviation of the n log returns before the session."""
    w = over(keys, "session")
    r = closes.withColumn("_r", F.ln(F.col("close") / F.lag("close").over(w)))
    return r.select(*keys, "session", full(F.stddev_pop, F.col("_r"), w, n, lag=1).alias("volatility"))


def thresholds(volatility: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, lower, upper): the exact terciles; none where nothing is known."""
    q = F.percentile("volatility", F.array(F.lit(1 / 3), F.lit(2 / 3)))
    return volatility.groupBy(*by).agg(q.alias("q")).select(*by, F.get("q", F.lit(0)).alias("lower"), F.get("q", F.lit(1)).alias("upper"))


def regimes(volatility: DataFrame, limits: DataFrame, by: Sequence[str]) -> DataFrame:
    v = F.col("volatility")
    tag = F.when(v <= F.col("lower"), "low").when(v <= F.col("upper"), "normal").when(v > F.col("upper"), "high").otherwise("unknown")
    return volatility.join(limits, list(by), "left").withColumn("regime", tag).drop("lower", "upper")


def block_scores(returns: DataFrame, trades: DataFrame, blocks: DataFrame, by: Sequence[str], min_total: int = 1, min_block: int = 1) -> DataFrame:
    """(by, score, eligible, reason, max_drawdown): the median of the blocks' Sharpe ratios less half their quartile range and the drawdown.

    ``returns``: (by, session, ret); ``trades``: (by, session); ``blocks``: (session, block), with keys of ``by`` where blocks differ by them.
    The first fault met, block after block, is the reason.
    """
    hits = trades.groupBy(*by, "session").agg(F.count("*").alias("_t"))
    rows = returns.join(blocks, [*[c for c in by if c in blocks.columns], "session"]).join(hits, [*by, "session"], "left")
    per = rows.groupBy(*by, "block").agg(F.avg("ret").alias("_m"), F.stddev_pop("ret").alias("_s"), F.coalesce(F.sum("_t"), F.lit(0)).alias("_t"))
    wanted = [F.lit(r["block"]) for r in blocks.select("block").distinct().collect()]  # spans of a calendar, few
    per = returns.select(*by).distinct().withColumn("block", F.explode(F.array(*wanted))).join(per, [*by, "block"], "left")
    name = F.concat(F.lit("block_"), F.col("block").cast("string"))
    fault = (
        F.when(F.col("_m").isNull(), F.concat(name, F.lit("_has_no_returns")))
        .when(F.col("_t") < min_block, F.concat(name, F.lit("_insufficient_trades")))
        .when(~(F.col("_s") > 0), F.concat(name, F.lit("_zero_variance")))
    )
    per = per.withColumn("_fault", fault).withColumn("_sharpe", ratio(F.col("_m"), F.when(F.col("_s") > 0, F.col("_s"))) * DAYS**0.5)
    q = F.percentile("_sharpe", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = per.groupBy(*by).agg(q.alias("_q"), F.min_by("_fault", F.when(F.col("_fault").isNotNull(), F.col("block"))).alias("_fault"))
    falls = with_drawdown(with_path(returns, by), 1.0, by, order="session", col="path").groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"), F.min("ret").alias("_least"))
    total = trades.groupBy(*by).agg(F.count("*").alias("_total"))
    out = out.join(falls, list(by)).join(total, list(by), "left")
    reason = F.when(F.col("_least") <= -1, "bankrupt_return").when(F.coalesce("_total", F.lit(0)) < min_total, "insufficient_total_trades").otherwise(F.coalesce("_fault", F.lit("eligible")))
    score = F.get("_q", F.lit(1)) - 0.5 * (F.get("_q", F.lit(2)) - F.get("_q", F.lit(0))) - F.abs("max_drawdown")
    return out.select(*by, reason.alias("reason"), F.when(reason == "eligible", score).alias("score"), (reason == "eligible").alias("eligible"), "max_drawdown")


def regime_scores(returns: DataFrame, trades: DataFrame, regime: DataFrame, by: Sequence[str], min_sessions: int, min_trades: int, shrink: float) -> DataFrame:
    """(by, candidate, regime, sessions, trades, score, reason): Sharpe ratios of moments drawn towards the candidate's own over all sessions."""
    all_ = returns.groupBy(*by, "candidate").agg(F.avg("ret").alias("_m"), F.avg(F.col("ret") * F.col("ret")).alias("_q"))
    hits = trades.groupBy(*by, "candidate", "session").agg(F.count("*").alias("_t"))
    rows = returns.join(regime, [*by, "session"]).filter(F.col("regime").isin(*REGIMES)).join(hits, [*by, "candidate", "session"], "left")
    per = rows.groupBy(*by, "candidate", "regime").agg(
        F.count("*").alias("sessions"), F.coalesce(F.sum("_t"), F.lit(0)).alias("trades"), F.avg("ret").alias("_rm"), F.avg(F.col("ret") * F.col("ret")).alias("_rq")
    )
    every = all_.select("*", F.explode(F.array(*map(F.lit, REGIMES))).alias("regime")).join(per, [*by, "candidate", "regime"], "left").fillna({"sessions": 0, "trades": 0})
    weight = F.col("sessions") / (F.col("sessions") + F.lit(shrink))
    mean = weight * F.col("_rm") + (1 - weight) * F.col("_m")
    variance = weight * F.col("_rq") + (1 - weight) * F.col("_q") - mean * mean
    every = every.withColumn("_v", F.greatest(variance, F.lit(0.0))).withColumn("_mean", mean)
    reason = F.when(F.col("sessions") < min_sessions, "insufficient_sessions").when(F.col("trades") < min_trades, "insufficient_trades").when(~(F.col("_v") > 0), "zero_variance").otherwise("eligible")
    score = F.when(reason == "eligible", F.col("_mean") / F.sqrt("_v") * DAYS**0.5)
    return every.select(*by, "candidate", "regime", "sessions", "trades", score.alias("score"), reason.alias("reason"))


def _general(x: str | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def library(scores: DataFrame, by: Sequence[str], general: str | Column) -> DataFrame:
    """(by, regime, candidate, reason): the best candidate of each regime, equals by name, or the general one (a name, or a column of ``scores``)."""
    chosen = F.min_by(F.when(F.col("score").isNotNull(), F.col("candidate")), F.when(F.col("score").isNotNull(), F.struct(-F.col("score"), F.col("candidate"))))
    out = scores.groupBy(*by, "regime").agg(chosen.alias("candidate"), F.first(_general(general)).alias("_g"))
    return out.select(*by, "regime", F.coalesce("candidate", "_g").alias("candidate"), F.when(F.col("candidate").isNull(), "fallback_no_eligible_candidate").otherwise("selected").alias("reason"))


def route(regime: DataFrame, chosen: DataFrame, by: Sequence[str], general: str | Column, confirm: int = 2) -> DataFrame:
    """(by, session, candidate): the candidate in use, changed once a regime that wants another has stood ``confirm`` sessions.

    An unknown regime goes back to the general candidate (a name, or a column of ``regime``) at once. The state is folded over one entry a session and key.
    """
    rows = regime.join(chosen.select(*by, "regime", F.col("candidate").alias("_goal")), [*by, "regime"], "left")
    known = F.col("regime").isin(*REGIMES)
    rows = rows.select(*by, "session", F.when(known, F.col("regime")).alias("_r"), F.coalesce("_goal", _general(general)).alias("_g"), _general(general).alias("_d"))
    all_ = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("session", "_r", "_g"))).alias("_all"), F.first("_d").alias("_d"))

    def step(acc: Column, x: Column) -> Column:
        unknown, same = x["_r"].isNull(), x["_g"] == acc["active"]
        n = F.when(acc["pending"] == x["_r"], acc["n"] + 1).otherwise(1)
        switch = ~unknown & ~same & (n >= confirm)
        active = F.when(unknown, F.col("_d")).when(switch, x["_g"]).otherwise(acc["active"])
        idle = unknown | same | switch
        entry = F.struct(x["session"].alias("session"), active.alias("candidate"))
        return F.struct(
            F.concat(acc["out"], F.array(entry)).alias("out"), active.alias("active"), F.when(~idle, x["_r"]).alias("pending"), F.when(idle, 0).otherwise(n).cast("int").alias("n")
        )

    kind = dict(regime.dtypes)["session"]
    start = F.struct(
        F.array().cast(f"array<struct<session:{kind},candidate:string>>").alias("out"), F.col("_d").alias("active"), F.lit(None).cast("string").alias("pending"), F.lit(0).alias("n")
    )
    return all_.select(*by, F.inline(F.aggregate("_all", start, step)["out"]))


def routes_by_role(final: DataFrame, days: DataFrame, tags: DataFrame, by: Sequence[str], min_sessions: int, min_trades: int, shrink: float) -> DataFrame:
    """(by, role, session, candidate, general): the candidate in use in each gate and test session, by what the finalists did in the calibration part's regimes.

    ``final``: (by, params_id, rank); ``days``: (by, role, params_id, session, ret, traded); ``tags``: (by, role, session, regime, general).
    """
    general = final.filter("rank = 1").select(*by, F.col("params_id").alias("general"))
    own = days.join(final.select(*by, "params_id"), [*by, "params_id"]).filter("role = 'calibration'").withColumnRenamed("params_id", "candidate")
    scores = regime_scores(
        own.select(*by, "candidate", "session", "ret"), own.filter("traded").select(*by, "candidate", "session"), tags.filter("role = 'calibration'").select(*by, "session", "regime"), by, min_sessions, min_trades, shrink
    )
    chosen = library(scores.join(general, list(by)), by, F.col("general"))
    per_role = chosen.select(*by, "regime", "candidate").withColumn("role", F.explode(F.array(F.lit("gate"), F.lit("test"))))
    routed = tags.filter("role IN ('gate', 'test')").select(*by, "role", "session", "regime", "general")
    return route(routed, per_role, [*by, "role"], F.col("general")).join(general, list(by))


def routed_returns(returns: DataFrame, routes: DataFrame, by: Sequence[str]) -> DataFrame:
    """The returns of the candidate in use, session by session; 0 where it has none."""
    return routes.join(returns.select(*by, "session", "candidate", "ret"), [*by, "session", "candidate"], "left").fillna({"ret": 0.0})


def paired(router: DataFrame, general: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, session, diff) of two return series over the same sessions; sessions of only one of them are marked unpaired."""
    a, b = router.select(*by, "session", F.col("ret").alias("_a")), general.select(*by, "session", F.col("ret").alias("_b"))
    both = a.join(b, [*by, "session"], "full")
    return both.select(*by, "session", (F.col("_a") - F.col("_b")).alias("diff"), (F.col("_a").isNull() | F.col("_b").isNull()).alias("unpaired"))


def gate(router: DataFrame, general: DataFrame, by: Sequence[str], simulations: int = 1000, block: int = 20, seed: int = 1) -> DataFrame:
    """(by, accepted, reason, mean_diff, low, high): whether a router beats the general candidate.

    The resampled mean difference must lie above 0 with 97.5%, and the router's drawdown may not be the deeper one by more than rounding.
    """
    from tidebars.operators.resampling import block_bootstrap

    diff = paired(router, general, by)
    sims = block_bootstrap(diff.filter("NOT unpaired"), by, "diff", simulations, block, seed)
    q = sims.groupBy(*by).agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    fall = lambda x, name: with_drawdown(with_path(x, by), 1.0, by, order="session", col="path").groupBy(*by).agg(F.min("drawdown").alias(name))
    out = diff.groupBy(*by).agg(F.avg("diff").alias("mean_diff"), F.max("unpaired").alias("_u")).join(q, list(by), "left").join(fall(router, "_dr"), list(by)).join(fall(general, "_dg"), list(by))
    low = F.get("_q", F.lit(0))
    reason = F.when(F.col("_u"), "unpaired_sessions").when(~F.coalesce(low > 0, F.lit(False)), "bootstrap_improvement_not_positive").when(F.col("_dr") < F.col("_dg") - EVEN, "drawdown_not_improved").otherwise("accepted")
    return out.select(*by, (reason == "accepted").alias("accepted"), reason.alias("reason"), "mean_diff", low.alias("low"), F.get("_q", F.lit(1)).alias("high"))


def last_closes(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return bars.groupBy(*keys, "session").agg(F.max_by("close", "ts").alias("close"))


def head_and_tail(rows: DataFrame, by: Sequence[str], order: str, share: float, least: int) -> DataFrame:
    """``part``: tail for the last max(least, round(share * n)) rows, head for the rest."""
    w = over(by, order)
    n = F.count("*").over(Window.partitionBy(*by))
    tail = F.greatest(F.lit(least), F.bround(share * n, 0).cast("int"))
    return rows.withColumn("part", F.when(F.row_number().over(w) > n - tail, "tail").otherwise("head"))
