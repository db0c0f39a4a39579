"""The robust protocol over calendar months, on the orders' daily history.

A set trades against the sum of the last ``length`` sessions' returns where that leaves a band of
``width`` deviations. A fold is twelve months of search in blocks of three, six of calibration, six for the gate and six out of
sample; the next one starts six months on, so the tests follow one another. Sets are scored
by blocks, finalists by their neighbours', regimes by the search part's volatility; the gate weighs the router
against the best set. Out of sample there are six series: the router and the best set, each at
normal and at stressed costs and with the band taken away.

Each step is a derived table, so the next one's plan starts from it. What is worked out for one
symbol grows with its sessions times the sets; windows hold one symbol's sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.rolling import full, over
from tidebars.operators import folds, metrics, reports, selection
from tidebars.plans import market as m

ROLES = (("search", 12), ("calibration", 6), ("gate", 6), ("test", 6))
BLOCK_MONTHS = 3
SETS = {"length": (5, 10, 15, 20), "width": (0.5, 1.0, 1.5)}
STEPS = {"length": (5, 20, 5), "width": (0.5, 1.5, 0.5)}
SHARE, COST = 0.1, 0.0005  # of the cash, a session's position and what trading it costs
SERIES = (("normal", 1.0, True), ("stress", 2.0, True), ("no_bands", 1.0, False))  # cost factor, and whether the band is asked
LEAST_TRADES, LEAST_BLOCK = 10, 2
BOOTSTRAP_BLOCK = 20
KEYS = ["symbol", "fold"]


def reversals(history: DataFrame, params: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(symbol, session, params_id, gain, banded, plain): each set's return of each session before costs, and whether it trades with and without its band.

    Sums and deviations are worked out once a length, from the sessions before; sets are joined as a table.
    """
    w = over(["symbol"], "session")
    ret = F.col("ret")
    at = [F.struct(F.lit(n).alias("length"), full(F.sum, ret, w, n, lag=1).alias("move"), full(F.stddev_pop, ret, w, n, lag=1).alias("sd")) for n in lengths]
    rows = history.select("symbol", "session", "ret", F.array(*at).alias("at")).select("symbol", "session", "ret", F.inline("at")).filter("move IS NOT NULL")
    plain = F.round("move", 9) != 0
    outside = F.round(F.abs("move") - F.col("width") * F.col("sd"), 9) > 0
    return rows.join(params, "length").select("symbol", "session", "params_id", (-SHARE * F.signum(F.round("move", 9)) * ret).alias("gain"), (plain & outside).alias("banded"), plain.alias("plain"))


def _net(traded: Column, factor: Column) -> Column:
    return F.when(traded, F.col("gain") - COST * factor).otherwise(0.0)


def sets(spark) -> DataFrame:
    return folds.grid(spark, SETS)


def gains(spark, sf) -> DataFrame:
    return m.of_orders(spark, sf, "month-gains", lambda: reversals(m.history(spark, sf), sets(spark), SETS["length"]))


def roles(spark, sf) -> DataFrame:
    return m.of_orders(spark, sf, "month-roles", lambda: folds.month_folds(m.history(spark, sf), ROLES, ROLES[-1][1]))


def days(spark, sf) -> DataFrame:
    """(symbol, fold, role, params_id, session, ret, traded): every set in every session of every role, at normal costs and with its band."""

    def plan() -> DataFrame:
        rows = roles(spark, sf).join(gains(spark, sf), ["symbol", "session"])
        return rows.select(*KEYS, "role", "params_id", "session", _net(F.col("banded"), F.lit(1.0)).alias("ret"), F.col("banded").alias("traded"))

    return m.of_orders(spark, sf, "month-days", plan)


def scores(spark, sf) -> DataFrame:
    """(symbol, fold, params_id, score, eligible, reason, max_drawdown) over the blocks of the search months."""

    def plan() -> DataFrame:
        own = days(spark, sf).filter("role = 'search'")
        by = [*KEYS, "params_id"]
        blocks = folds.with_blocks(roles(spark, sf), "search", BLOCK_MONTHS).select(*KEYS, "session", "block")
        return selection.block_scores(own.select(*by, "session", "ret"), own.filter("traded").select(*by, "session"), blocks, by, LEAST_TRADES, LEAST_BLOCK)

    return m.of_orders(spark, sf, "month-scores", plan)


def finalists(spark, sf) -> DataFrame:
    return m.of_orders(spark, sf, "month-finalists", lambda: folds.finalists(scores(spark, sf), sets(spark), STEPS, KEYS))


def tags(spark, sf) -> DataFrame:
    """(symbol, fold, role, session, volatility, regime, general): regimes by the limits of each fold's search part."""

    def plan() -> DataFrame:
        general = finalists(spark, sf).filter("rank = 1").select(*KEYS, F.col("params_id").alias("general"))
        by_role = roles(spark, sf).join(selection.session_volatility(m.history(spark, sf)), ["symbol", "session"])
        return selection.regimes(by_role, selection.thresholds(by_role.filter("role = 'search'"), KEYS), KEYS).join(general, KEYS)

    return m.of_orders(spark, sf, "month-tags", plan)


def routes(spark, sf) -> DataFrame:
    return m.of_orders(spark, sf, "month-routes", lambda: selection.routes_by_role(finalists(spark, sf), days(spark, sf), tags(spark, sf), KEYS, 10, 3, 10.0))


def gate(spark, sf) -> DataFrame:
    """(symbol, fold, accepted, reason, mean_diff, low, high): the router against the best set over the gate months."""

    def plan() -> DataFrame:
        own = routes(spark, sf).filter("role = 'gate'")
        made = days(spark, sf).filter("role = 'gate'").select(*KEYS, "session", "params_id", "ret")
        of = lambda c: own.select(*KEYS, "session", F.col(c).alias("params_id")).join(made, [*KEYS, "session", "params_id"]).select(*KEYS, "session", "ret")
        return selection.gate(of("candidate"), of("general"), KEYS, m.SIMULATIONS, BOOTSTRAP_BLOCK)

    return m.of_orders(spark, sf, "month-gate", plan)


def walk(spark, sf) -> DataFrame:
    """(symbol, fold, policy, cost, session, candidate, routed, traded, ret, cash): the six series out of sample, their cash carried from fold to fold.

    Folds without a finalist hold cash; folds whose gate did not accept the router trade the best set.
    """
    tests = roles(spark, sf).filter("role = 'test'").drop("role")
    decided = tests.join(routes(spark, sf).filter("role = 'test'").select(*KEYS, "session", "candidate", "general"), [*KEYS, "session"], "left").join(gate(spark, sf).select(*KEYS, "accepted"), KEYS, "left")
    made = gains(spark, sf).withColumnRenamed("params_id", "candidate")
    both = reports.two_policies(decided, F.coalesce("accepted", F.lit(False)), [*KEYS, "session"])
    rows = both.join(made, ["symbol", "candidate", "session"], "left")
    series = F.inline(F.array(*[F.struct(F.lit(n).alias("cost"), F.coalesce(F.col("banded" if b else "plain"), F.lit(False)).alias("traded"), F.lit(x).alias("factor")) for n, x, b in SERIES]))
    rows = rows.select(*KEYS, "policy", "session", "candidate", "routed", "gain", series).withColumn("ret", _net(F.col("traded"), F.col("factor")))
    return reports.policy_capital(rows.drop("gain", "factor"), m.CASH, ["symbol"])


def series_figures(spark, sf) -> DataFrame:
    """(symbol, policy, cost, sessions, trades, final_cash, max_drawdown): what became of each of the six series."""
    by = ["symbol", "policy", "cost"]
    rows = walk(spark, sf)
    falls = metrics.with_drawdown(rows, m.CASH, by, order="session", col="cash").groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"))
    out = rows.groupBy(*by).agg(F.count("*").alias("sessions"), F.sum(F.col("traded").cast("long")).alias("trades"), F.max_by("cash", "session").alias("final_cash"))
    return out.join(falls, by)
