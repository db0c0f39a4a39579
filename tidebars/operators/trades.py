"""What became of signals: entries, exits by first touch, sizes, capital and equity.

A signal enters at the next bar's open and leaves inside its session, so sessions are
independent. Prices are turned by the side (a short's high is its low), which leaves one
set of rules. A bar ends a trade, in this order, by the forced exit at its open, by an
open beyond the stop, an open beyond the target (filled at the target), by both levels
in its range (the stop unless told otherwise), by the stop, by the target. A trigger
touched on a bar that ends nothing moves the stop from the next bar on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.rolling import over, ratio
from tidebars.operators.bars import KEYS


@dataclass(frozen=True)
class Costs:
    slippage: float = 0.0  # points at entry and at exit
    commission: float = 0.0  # a unit and side
    point_value: float = 1.0
    factor: float = 1.0  # of both costs, for stress tests


def entries(signals: DataFrame, bars: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Signals with entry time and price: the next bar's open, in the same session and before the forced exit; others go.

    Signals of prepared bars know their next bar; for others it is looked up in ``bars``.
    """
    if "next_ts" not in signals.columns:
        w = over(keys, "ts")
        signals = signals.join(bars.select(*keys, "ts", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("ts", "open", "session")]), [*keys, "ts"])
    out = signals.filter((F.col("next_session") == F.col("session")) & (F.col("next_ts") < F.col("force_exit"))).drop("next_session")
    return out.withColumnRenamed("next_ts", "entry_ts").withColumnRenamed("next_open", "entry_open")


def fallback_levels(df: DataFrame, stop_points: float | None, target_points: float | None) -> DataFrame:
    """Missing stops and targets at fixed distances from the entry."""
    stop = F.lit(None).cast("double") if stop_points is None else F.col("entry_open") - F.col("side") * stop_points
    target = F.lit(None).cast("double") if target_points is None else F.col("entry_open") + F.col("side") * target_points
    return df.withColumn("stop", F.coalesce("stop", stop)).withColumn("target", F.coalesce("target", target))


def exits(entered: DataFrame, bars: DataFrame, keys: Sequence[str] = KEYS, stop_first: bool = True, variant: Sequence[str] = ()) -> DataFrame:
    """Entered signals with exit_ts, exit_price and reason; a trade that nothing ends leaves at the session's last close."""
    trade = [*keys, *variant, "session", "ts"]
    rest = [c for c in entered.columns if c not in trade]
    b = bars.select(*keys, "session", F.col("ts").alias("bar_ts"), "open", "high", "low", F.col("close").alias("bar_close"))
    s = F.col("side")
    rows = entered.join(b, [*keys, "session"]).filter("bar_ts >= entry_ts")
    rows = rows.withColumns(
        {
            "_o": s * F.col("open"),
            "_h": F.when(s > 0, F.col("high")).otherwise(-F.col("low")),
            "_l": F.when(s > 0, F.col("low")).otherwise(-F.col("high")),
        }
    )
    touched = F.min(F.when(F.col("_h") >= s * F.col("trigger"), F.col("bar_ts"))).over(Window.partitionBy(*trade))
    rows = rows.withColumn("_moved", F.coalesce(F.col("bar_ts") > touched, F.lit(False)))
    stop = s * F.when(F.col("_moved") & F.col("moved_stop").isNotNull(), F.col("moved_stop")).otherwise(F.col("stop"))
    target = s * F.col("target")
    o, high, low = F.col("_o"), F.col("_h"), F.col("_l")
    mark = lambda price, reason: F.struct((s * price).alias("price"), F.lit(reason).alias("reason"))
    both = mark(stop, "stop_loss") if stop_first else mark(target, "take_profit")
    hit = (
        F.when(F.col("bar_ts") >= F.col("force_exit"), mark(o, "force_exit"))
        .when(o <= stop, mark(o, "stop_loss"))
        .when(o >= target, mark(target, "take_profit"))
        .when((low <= stop) & (high >= target), both)
        .when(low <= stop, mark(stop, "stop_loss"))
        .when(high >= target, mark(target, "take_profit"))
    )
    rows = rows.withColumn("_hit", hit)
    found = rows.groupBy(*trade).agg(
        F.first(F.struct(*rest)).alias("_own"),  # the same in all rows of a trade
        F.min_by(F.when(F.col("_hit").isNotNull(), F.struct(F.col("bar_ts").alias("ts"), "_hit")), F.when(F.col("_hit").isNotNull(), F.col("bar_ts"))).alias("first"),
        F.max_by(F.struct(F.col("bar_ts").alias("ts"), F.struct(F.col("bar_close").alias("price"), F.lit("final_bar").alias("reason")).alias("_hit")), "bar_ts").alias("last"),
    )
    end = F.coalesce("first", "last")
    return found.select(*trade, "_own.*", end["ts"].alias("exit_ts"), end["_hit"]["price"].alias("exit_level"), end["_hit"]["reason"].alias("reason"))


def outcomes(exited: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Fills with slippage, and the result of a unit in points and in risks (gross_r, net_r)."""
    s, slip = F.col("side"), costs.slippage * costs.factor
    out = exited.withColumn("entry_price", F.col("entry_open") + s * slip).withColumn("exit_price", F.col("exit_level") - s * slip)
    out = out.withColumn("risk", F.abs(F.col("entry_price") - F.col("stop")))
    gross = s * (F.col("exit_price") - F.col("entry_price"))
    out = out.withColumn("gross_points", gross).withColumn("net_points", gross - 2 * costs.commission * costs.factor / costs.point_value)
    return out.withColumn("gross_r", ratio(F.col("gross_points"), F.col("risk"))).withColumn("net_r", ratio(F.col("net_points"), F.col("risk")))


def units(mode: str, base: Column, risk: Column, risk_share: float = 0.01, fixed: float = 1.0, point_value: float = 1.0, most: float | None = None) -> Column:
    """Units of a trade: fixed, or the share of ``base`` put at risk; capped, never negative.

    A null or zero stop distance gives null units, so the row stays to be seen; ``without_distance`` names such trades.
    """
    n = F.lit(fixed) if mode == "fixed" else F.when(risk > 0, risk_share * base / (risk * point_value))
    n = n if most is None else F.least(n, F.lit(most))
    return F.when(n.isNotNull(), F.greatest(n, F.lit(0.0)))


def without_distance(trades: DataFrame) -> DataFrame:
    """The trades whose size a risk share cannot be worked out for: no stop, or none that is away from the entry."""
    return trades.filter(F.col("risk").isNull() | ~(F.col("risk") > 0))


def ledger(trades: DataFrame, cash: float, by: Sequence[str], mode: str = "fixed", risk_share: float = 0.01, costs: Costs = Costs(), fixed: float = 1.0, most: float | None = None) -> DataFrame:
    """Trades with units, profit and the cash before and after each, for every key in ``by``.

    Fixed units and a fixed risk base add up; risking a share of the current cash multiplies,
    by 1 + share * net_r. With a cap on units the cash is folded trade after trade.
    """
    order = ("exit_ts", *[c for c in ("symbol",) if c in trades.columns and c not in by])
    w = over(by, *order) if by else Window.orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    per_unit = F.col("net_points") * costs.point_value
    if mode == "current" and most is not None:
        fields = F.struct(*[F.col(c) for c in order], F.col("risk").alias("_risk"), per_unit.alias("_per"), F.struct(*trades.columns).alias("_row"))
        all_ = trades.groupBy(*by).agg(F.array_sort(F.collect_list(fields)).alias("_all"))  # one entry a trade

        def step(acc: Column, x: Column) -> Column:
            n = units("current", acc["cash"], x["_risk"], risk_share, fixed, costs.point_value, most)
            after = acc["cash"] + n * x["_per"]
            entry = F.struct(x["_row"].alias("_row"), n.alias("units"), acc["cash"].alias("cash_before"), after.alias("cash_after"))
            return F.struct(F.concat(acc["out"], F.array(entry)).alias("out"), after.alias("cash"))

        row = dict(all_.select(F.col("_all")[0]["_row"].alias("r")).dtypes)["r"]
        empty = F.array().cast(f"array<struct<_row:{row},units:double,cash_before:double,cash_after:double>>")
        out = all_.select(F.inline(F.aggregate("_all", F.struct(empty.alias("out"), F.lit(cash).alias("cash")), step)["out"])).select("_row.*", "units", "cash_before", "cash_after")
    elif mode == "current":
        gain = 1 + risk_share * F.col("net_r")
        grown = F.exp(F.sum(F.ln(F.when(gain > 0, gain))).over(upto))
        # a trade that loses everything ends the account
        alive = F.min(F.when(gain > 0, 1).otherwise(0)).over(upto) == 1
        after = F.when(alive, cash * grown).otherwise(0.0)
        out = trades.withColumn("cash_after", after).withColumn("cash_before", F.lag("cash_after", 1, cash).over(w))
        out = out.withColumn("units", units("current", F.col("cash_before"), F.col("risk"), risk_share, fixed, costs.point_value))
    else:
        n = units(mode, F.lit(cash), F.col("risk"), risk_share, fixed, costs.point_value, most)
        out = trades.withColumn("units", n).withColumn("cash_after", cash + F.sum(F.col("units") * per_unit).over(upto))
        out = out.withColumn("cash_before", F.lag("cash_after", 1, cash).over(w))
    return out.withColumn("net_pnl", F.col("cash_after") - F.col("cash_before")).withColumn(
        "return_pct", 100 * ratio(F.col("net_pnl"), F.abs(F.col("entry_price") * F.col("units") * costs.point_value))
    )


def equity(bars: DataFrame, booked: DataFrame, cash: float, keys: Sequence[str] = KEYS, point_value: float = 1.0) -> DataFrame:
    """(keys, ts, session, cash, equity, in_position) for every bar: cash of ended trades plus the open one at the close."""
    t = booked.select(*keys, "session", "side", "entry_ts", "exit_ts", "entry_price", "units", "cash_before", "cash_after")
    rows = bars.select(*keys, "session", "ts", "close").join(t, [*keys, "session"], "left")
    opened = (F.col("ts") >= F.col("entry_ts")) & (F.col("ts") < F.col("exit_ts"))
    rows = rows.withColumn("in_position", F.coalesce(opened, F.lit(False)).cast("int"))
    rows = rows.withColumn("_cash", F.when(F.col("ts") >= F.col("exit_ts"), F.col("cash_after")).when(opened, F.col("cash_before")))
    known = F.last("_cash", ignorenulls=True).over(over(keys, "ts").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("cash", F.coalesce(known, F.lit(cash)))
    floating = F.when(F.col("in_position") == 1, F.col("side") * (F.col("close") - F.col("entry_price")) * F.col("units") * point_value).otherwise(0.0)
    return rows.select(*keys, "ts", "session", "cash", (F.col("cash") + floating).alias("equity"), "in_position")


def buy_and_hold(bars: DataFrame, keys: Sequence[str] = KEYS, costs: Costs = Costs(), n: float = 1.0) -> DataFrame:
    """One trade a key: in at the second bar's open, out at the last close; none if the second bar is of another session."""
    w = over(keys, "ts")
    ranked = bars.withColumn("_n", F.row_number().over(w))
    out = ranked.groupBy(*keys).agg(
        F.min_by("session", "ts").alias("_first"),
        F.max(F.when(F.col("_n") == 2, F.col("session"))).alias("_second"),
        F.max(F.when(F.col("_n") == 2, F.col("ts"))).alias("entry_ts"),
        (F.max(F.when(F.col("_n") == 2, F.col("open"))) + costs.slippage).alias("entry_price"),
        F.max("ts").alias("exit_ts"),
        (F.max_by("close", "ts") - costs.slippage).alias("exit_price"),
    )
    out = out.filter(F.col("_first") == F.col("_second")).drop("_first", "_second")
    return out.withColumn("net_pnl", n * ((F.col("exit_price") - F.col("entry_price")) * costs.point_value - 2 * costs.commission))


def hold_equity(bars: DataFrame, held: DataFrame, cash: float, keys: Sequence[str] = KEYS, costs: Costs = Costs(), n: float = 1.0) -> DataFrame:
    """(keys, ts, session, equity, in_position) of a ``buy_and_hold`` trade for every bar; keys without one keep their cash."""
    rows = bars.select(*keys, "ts", "session", "close").join(held.select(*keys, "entry_ts", "exit_ts", "entry_price", "net_pnl"), list(keys), "left")
    inside = F.coalesce((F.col("ts") >= F.col("entry_ts")) & (F.col("ts") < F.col("exit_ts")), F.lit(False))
    floating = n * ((F.col("close") - F.col("entry_price")) * costs.point_value - costs.commission)
    won = F.when(inside, floating).when(F.col("ts") >= F.col("exit_ts"), F.col("net_pnl")).otherwise(0.0)
    return rows.select(*keys, "ts", "session", (cash + won).alias("equity"), inside.cast("int").alias("in_position"))


def replay(bars: DataFrame, trades: DataFrame, sessions: DataFrame, cash: float, by: Sequence[str], share: float = 0.01, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Session after session on the cash that is there: (by, session, cash_before, cash_after, ret, trades), and (by, session, ts, equity) bar by bar.

    ``sessions``: (by, session) to go through; ``trades``: at most one for each of them, sized by ``share`` of the cash at risk.
    Growth is relative to a session's cash, so the bars need no cash to be known: that multiplies in later.
    """
    own = trades.select(*by, "session", "side", "entry_ts", "exit_ts", "entry_price", "risk", "net_r")
    days = sessions.select(*by, "session").distinct().join(own, [*by, "session"], "left")
    gain = F.greatest(1 + share * F.coalesce("net_r", F.lit(0.0)), F.lit(0.0))
    w = over(by, "session")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    grown = F.coalesce(F.exp(F.sum(F.ln(F.when(gain > 0, gain))).over(before)), F.lit(1.0))
    days = days.withColumn("cash_before", F.when(F.coalesce(F.min(gain).over(before), F.lit(1.0)) > 0, cash * grown).otherwise(0.0)).withColumn("cash_after", F.col("cash_before") * gain)
    rows = days.join(bars.select(*keys, "session", "ts", "close"), [*keys, "session"])
    open_ = (F.col("ts") >= F.col("entry_ts")) & (F.col("ts") < F.col("exit_ts"))
    floating = 1 + share * F.coalesce(ratio(F.col("side") * (F.col("close") - F.col("entry_price")), F.col("risk")), F.lit(0.0))  # nothing is at risk without a distance to the stop
    relative = F.when(open_, floating).when(F.col("ts") >= F.col("exit_ts"), gain).otherwise(1.0)
    curve = rows.select(*by, "session", "ts", (F.col("cash_before") * relative).alias("equity"))
    ret = F.when(F.col("cash_before") > 0, F.col("cash_after") / F.col("cash_before") - 1).otherwise(0.0)
    return days.select(*by, "session", "cash_before", "cash_after", ret.alias("ret"), F.col("entry_ts").isNotNull().cast("int").alias("trades")), curve


def source_tag(df: DataFrame, bands: bool, regime: bool) -> DataFrame:
    return df.withColumn("source", F.lit(("band" if bands else "raw") + ("_hmm" if regime else "")))
