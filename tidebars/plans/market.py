"""The library's pipelines over the given tables: events as ticks of five symbols, orders as a long daily history."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.functions.rolling import over
from tidebars.operators import bands, bars, breakout, folds, hidden, metrics, regimes, reports, resampling, selection, trades
from tidebars.operators.breakout import Rules
from tidebars.operators.trades import Costs
from tidebars.sources import incremental
from tidebars.sources.tables import load, materialize, renamed, scratch, states

CHANNEL = Rules(kind="channel", channel_bars=10, break_even=True)
RANGE = Rules(kind="opening_range", stop="atr", entry_bars=8)
COSTS = Costs(slippage=0.25, commission=0.1)
CASH = 100_000.0
N_VOL, N_BAND = 5, 5
WIDTH, ZONE = "30 minutes", "America/New_York"
CHANNELS = (6, 10, 14)
SYMBOLS = ("click", "error", "purchase", "signup", "view")
SWEEP = {"channel_bars": CHANNELS, "side_mode": ("both", "long")}
GATES = {"channel_bars": (10,), "use_bands": (False, True), "use_vwap": (False, True), "use_atr_buffer": (False, True)}
ROBUST = {"channel_bars": (4, 6, 8, 10, 12, 14), "reward": (1.0, 1.5, 2.0)}
ROBUST_STEPS = {"channel_bars": (4, 14, 2), "reward": (1.0, 2.0, 0.5)}
ROLES = (("search", 8), ("calibration", 4), ("gate", 4), ("test", 4))
#: The steps of a search over channels with bands; 419 244 points.
SPACE = folds.Space(
    {
        "channel_bars": {"type": "int", "low": 10, "high": 160, "step": 5},
        "band_sessions": {"type": "int", "low": 10, "high": 120, "step": 5},
        "atr_multiple": {"type": "float", "low": 0.75, "high": 4.0, "step": 0.25},
        "reward": {"type": "float", "low": 1.0, "high": 6.0, "step": 0.25},
        "break_even": {"type": "categorical", "choices": [False, True]},
    }
)
TRIALS = 64
SHARE = 0.01
SIMULATIONS = 1000


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    out = renamed(load(spark, f"{sf}/events.parquet"), {"symbol": "event_type", "ts": "ts", "price": "value", "seq": "event_id"})
    return out.withColumn("volume", F.lit(1.0))


def bars30(spark, sf) -> DataFrame:
    return bars.resample(ticks(spark, sf), WIDTH)


PARTS = ("session", "symbol")


def with_session(ticks_: DataFrame) -> DataFrame:
    """Ticks with the session that their bar will be in; bars do not reach over its end."""
    local = bars.tag_sessions(bars.to_zone(ticks_.withColumn("_ts", F.col("ts")), "UTC", ZONE))
    return local.drop("ts").withColumnRenamed("_ts", "ts")


def _as_ticks(events: DataFrame) -> DataFrame:
    out = renamed(events, {"symbol": "event_type", "ts": "ts", "price": "value", "seq": "event_id"} | {c: c for c in incremental.FILE if c in events.columns})
    return with_session(out)


_STATE: dict | None = None


@contextmanager
def one_state() -> Iterator[None]:
    """Inside, the ticks of a folder are looked at once, so that all tables of a query are of one state."""
    global _STATE
    before, _STATE = _STATE, {} if _STATE is None else _STATE
    try:
        yield
    finally:
        _STATE = before


def _once(key: tuple, work: Callable[[], object]) -> object:
    if _STATE is None:
        return work()
    if key not in _STATE:
        _STATE[key] = work()
    return _STATE[key]


def tick_parts(spark, sf) -> tuple[DataFrame, str]:
    """The content of the ticks by session and symbol, and the digest of all of it."""

    def look() -> tuple[DataFrame, str]:
        path = f"{sf}/events.parquet"
        folder = f"{scratch(spark)}/tick-parts/{incremental.settings_digest(path)}"
        parts = incremental.source_leaves(spark, path, folder, _as_ticks, PARTS, ["symbol", F.unix_micros(F.col("ts").cast("timestamp")), "price", "seq"])
        return parts, incremental.root_of(parts, PARTS, states(spark, folder)[-1])

    return _once(("ticks", sf), look)


def derived(spark, sf, name: str, plan, *settings: object) -> DataFrame:
    """A derived table of the ticks, built once for each content of theirs, each of the settings and each version of the code."""
    return materialize(spark, f"{scratch(spark)}/{name}", incremental.settings_digest(tick_parts(spark, sf)[1], settings), plan)


def refresh_tagged(spark, folder: str, ticks_: DataFrame, parts: DataFrame, root: str | None = None) -> dict:
    """The tagged bars brought up to ``ticks_`` (with session) of which ``parts`` are the digests: sessions that changed are built again."""

    def build(asked: DataFrame | None) -> DataFrame:
        rows = ticks_
        if asked is not None:  # the range of days reaches the scan, the parts decide
            low, high = asked.agg(F.min("session"), F.max("session")).first()
            rows = rows.filter(F.col("ts").between(F.lit(low) - F.expr("INTERVAL 2 DAYS"), F.lit(high) + F.expr("INTERVAL 2 DAYS"))).join(asked.filter("read").select(*PARTS), list(PARTS), "left_semi")
        return bars.tagged_bars(bars.resample(rows.withColumn("volume", F.lit(1.0)), WIDTH), target=ZONE)

    return incremental.refresh(spark, folder, parts, PARTS, build, "session", stored_by=["session"], root=root)


def tagged(spark, sf) -> DataFrame:
    """The tagged bars, which are far fewer than the ticks and which all that follows reads: a table by session, of whose days only changed ones are built again."""

    def look() -> DataFrame:
        folder = f"{scratch(spark)}/tagged-bars/{incremental.settings_digest(sf, WIDTH, ZONE)}"
        refresh_tagged(spark, folder, _as_ticks(load(spark, f"{sf}/events.parquet")), *tick_parts(spark, sf))
        return incremental.current(spark, folder, PARTS).select("symbol", "ts", "session", "bucket", *bars.BAR)

    return _once(("tagged", sf), look)


def refresh_bands(spark, folder: str, tagged_: DataFrame) -> dict:
    """The bands of each session as a table: a session is built again if its bars changed, or those of one that its windows reach."""

    def build(asked: DataFrame | None) -> DataFrame:
        rows = tagged_ if asked is None else tagged_.join(asked.filter("read").select(*PARTS), list(PARTS), "left_semi")
        out = bands.with_bands(bands.with_volatility(bars.session_wide(rows), N_VOL), N_BAND)
        return out if asked is None else out.join(asked.filter("rebuild").select(*PARTS), list(PARTS), "left_semi")

    parts = incremental.leaves(tagged_, PARTS, ["symbol", F.unix_micros(F.col("ts").cast("timestamp")), "bucket", *bars.BAR])
    return incremental.refresh(spark, folder, parts, PARTS, build, "session", N_VOL + 2 * N_BAND, stored_by=["session"])  # a band needs bodies, these a mean volatility, this one its own window


def appended_bands(spark, sf, days: int = 2) -> DataFrame:
    """The bands built from all but the last days of the ticks and brought up to all of them: what a daily run does."""
    every = _as_ticks(load(spark, f"{sf}/events.parquet"))
    last = every.agg(F.max("session").alias("last"))
    early = every.join(F.broadcast(last), F.col("session") <= F.date_sub("last", days), "left_semi")  # one row
    folder = f"{scratch(spark)}/appended/{incremental.settings_digest(sf, WIDTH, ZONE, N_VOL, N_BAND)}"
    columns = ["symbol", F.unix_micros(F.col("ts").cast("timestamp")), "price", "seq"]
    for ticks_ in (early, every):
        refresh_tagged(spark, f"{folder}/bars", ticks_, incremental.leaves(ticks_, PARTS, columns))
        refresh_bands(spark, f"{folder}/bands", incremental.current(spark, f"{folder}/bars", PARTS))
    return incremental.current(spark, f"{folder}/bands", PARTS)


def content_tree(spark, sf) -> DataFrame:
    """(level, session, symbol, rows, digest): the tree of the ticks' content, prices to nine decimals."""
    rows = _as_ticks(load(spark, f"{sf}/events.parquet"))
    parts = incremental.leaves(rows, PARTS, ["symbol", F.unix_micros(F.col("ts").cast("timestamp")), F.col("price").cast("decimal(30,9)"), "seq"])
    return incremental.flat(incremental.tree(parts, PARTS), PARTS)


def wide(spark, sf) -> DataFrame:
    return bars.session_wide(tagged(spark, sf))


def banded(spark, sf) -> DataFrame:
    return bands.with_bands(bands.with_volatility(wide(spark, sf), N_VOL), N_BAND)


def sigma_rows(spark, sf) -> DataFrame:
    return bands.with_volatility(wide(spark, sf), N_VOL)


def valid(spark, sf) -> DataFrame:
    from datetime import date

    return bars.valid_sessions(wide(spark, sf), bars.calendar(spark, date(2024, 1, 1), date(2024, 12, 31), [date(2024, 1, 1), date(2024, 1, 15)]))


def prepared(spark, sf, rules: Rules = CHANNEL) -> DataFrame:
    return breakout.prepare(tagged(spark, sf), rules, banded(spark, sf) if rules.use_bands else None)


def signals(spark, sf, rules: Rules = CHANNEL) -> DataFrame:
    return breakout.signals(prepared(spark, sf, rules), rules)


def closed(spark, sf, rules: Rules = CHANNEL, costs: Costs = COSTS) -> DataFrame:
    """Trades: the first signal of each session, entered, left and priced; a derived table, since ledgers, curves and figures all start from it."""

    def plan() -> DataFrame:
        taken = breakout.first_of_session(signals(spark, sf, rules))
        return trades.outcomes(trades.exits(trades.entries(taken), tagged(spark, sf)), costs)

    return derived(spark, sf, "trades", plan, rules, costs)


def booked(spark, sf, mode: str = "fixed", rules: Rules = CHANNEL) -> DataFrame:
    return trades.ledger(closed(spark, sf, rules), CASH, ["symbol"], mode, costs=COSTS)


def curve(spark, sf) -> DataFrame:
    return trades.equity(tagged(spark, sf), booked(spark, sf), CASH)


def all_figures(spark, sf) -> DataFrame:
    return metrics.figures(curve(spark, sf), booked(spark, sf), CASH, ["symbol"])


def daily_returns(spark, sf) -> DataFrame:
    c = curve(spark, sf)
    return metrics.session_returns(c, c.select("symbol", "session"), CASH, ["symbol"])


def grid_trades(spark, sf, values: dict, factors: tuple[float, ...] = (1.0,), rules: Rules = CHANNEL) -> DataFrame:
    """The trades of every parameter set of a grid, and of every cost level, in one pass over the bars.

    Indicators are worked out once for each channel length; sets are joined to the bars as a table, and costs to the trades.
    """
    params = folds.grid(spark, values, most=10_000)  # so many may be sent to all tasks
    names = [*values, "params_id"]
    own = replace(rules, **{k: F.col(k) for k in values if k != "channel_bars"}, channel_bars=tuple(values["channel_bars"]))
    b = tagged(spark, sf)
    ready = breakout.prepare(b, own, banded(spark, sf) if any(values.get("use_bands", ())) else None)
    rows = ready.filter("entry_allowed AND ts < force_exit").join(F.broadcast(params), "channel_bars")
    taken = breakout.first_of_session(breakout.signals(rows, own, variant=names), ["symbol", "params_id"])
    left = trades.exits(trades.entries(taken), b, variant=names)
    return trades.outcomes(left.withColumn("factor", F.explode(F.array(*map(F.lit, factors)))), replace(COSTS, factor=F.col("factor")))


def sweep(spark, sf) -> DataFrame:
    """Figures of every channel length and side mode."""
    return metrics.trade_figures(grid_trades(spark, sf, SWEEP), ["symbol", *SWEEP], "net_points")


def gated_trades(spark, sf) -> DataFrame:
    """Trades with and without each gate, at normal and double costs."""
    return derived(spark, sf, "gated-trades", lambda: grid_trades(spark, sf, GATES, (1.0, 2.0)), GATES, CHANNEL, COSTS, N_VOL, N_BAND)


def ablation(spark, sf) -> DataFrame:
    """Figures of every combination of gates, and what each makes against none."""
    own = [c for c in GATES if c != "channel_bars"]
    label = F.concat_ws("+", *[F.when(F.col(c), c.removeprefix("use_")) for c in own])
    found = gated_trades(spark, sf).withColumn("variant", F.when(label == "", "raw").otherwise(label))
    return reports.compared(metrics.trade_figures(found, ["symbol", "factor", "variant"], "net_points"), ["symbol", "factor"], "raw", "net_pnl")


def order_root(spark, sf) -> str:
    """The digest of the orders' content, kept by file."""
    columns = ["o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey"]

    def look() -> str:
        path = f"{sf}/orders.parquet"
        folder = f"{scratch(spark)}/order-parts/{incremental.settings_digest(path)}"
        parts = incremental.source_leaves(spark, path, folder, lambda rows: rows, (), columns)
        return incremental.root_of(parts, (), states(spark, folder)[-1])

    return _once(("orders", sf), look)


def of_orders(spark, sf, name: str, plan: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the orders, built once for each content of theirs and version of the code."""
    return materialize(spark, f"{scratch(spark)}/{name}", incremental.settings_digest(order_root(spark, sf), name), plan)


def history(spark, sf) -> DataFrame:
    return of_orders(spark, sf, "order-history", lambda: _history(spark, sf))


def _history(spark, sf) -> DataFrame:
    """(symbol, session, close, ret): each priority's last order value a day, and the log change squeezed into +-10%."""
    o = renamed(load(spark, f"{sf}/orders.parquet"), {"symbol": "o_orderpriority", "ts": "o_orderdate", "price": "o_totalprice", "seq": "o_orderkey"})
    day = o.groupBy("symbol", F.to_date("ts").alias("session")).agg(F.max_by("price", "seq").alias("close"))
    step = F.ln(F.col("close") / F.lag("close").over(over(["symbol"], "session")))
    return day.withColumn("ret", F.coalesce(F.least(F.greatest(step, F.lit(-1.0)), F.lit(1.0)) / 10, F.lit(0.0)))


def month_folds(spark, sf) -> DataFrame:
    return folds.month_folds(history(spark, sf), [("search", 12), ("calibration", 6), ("gate", 6), ("test", 6)], 12)


def labelled(spark, sf) -> DataFrame:
    return of_orders(spark, sf, "order-regimes", lambda: _labelled(spark, sf))


def _labelled(spark, sf) -> DataFrame:
    vol = selection.session_volatility(history(spark, sf))
    return selection.regimes(vol, selection.thresholds(vol, ["symbol"]), ["symbol"])


def candidates(spark, sf) -> DataFrame:
    """Three candidates a symbol: the returns as they are, turned round, and without those of Mondays."""
    h = history(spark, sf)
    fields = [("as_is", F.col("ret")), ("turned", -F.col("ret")), ("no_monday", F.when(F.weekday("session") == 0, 0.0).otherwise(F.col("ret")))]
    return h.select("symbol", "session", F.inline(F.array(*[F.struct(F.lit(n).alias("candidate"), x.alias("ret")) for n, x in fields])))


def candidate_trades(spark, sf) -> DataFrame:
    return candidates(spark, sf).filter("ret <> 0").select("symbol", "candidate", "session")


def regime_scores(spark, sf) -> DataFrame:
    return selection.regime_scores(candidates(spark, sf), candidate_trades(spark, sf), labelled(spark, sf).select("symbol", "session", "regime"), ["symbol"], 20, 5, 10.0)


def regime_library(spark, sf) -> DataFrame:
    return selection.library(regime_scores(spark, sf), ["symbol"], "as_is")


def routing(spark, sf) -> DataFrame:
    return of_orders(spark, sf, "order-routes", lambda: _routing(spark, sf))


def _routing(spark, sf) -> DataFrame:
    return selection.route(labelled(spark, sf).select("symbol", "session", "regime"), regime_library(spark, sf), ["symbol"], "as_is")


def block_scores(spark, sf) -> DataFrame:
    """Every candidate over calendar years as blocks."""
    c = candidates(spark, sf)
    blocks = c.select("session").distinct().withColumn("block", F.year("session") - 1995)
    out = selection.block_scores(c.withColumn("key", F.concat_ws("|", "symbol", "candidate")).select("key", "session", "ret"), candidate_trades(spark, sf).select(F.concat_ws("|", "symbol", "candidate").alias("key"), "session"), blocks, ["key"], 10, 5)
    return out


def gated(spark, sf) -> DataFrame:
    routed = selection.routed_returns(candidates(spark, sf), routing(spark, sf), ["symbol"])
    return selection.gate(routed.select("symbol", "session", "ret"), candidates(spark, sf).filter("candidate = 'as_is'").select("symbol", "session", "ret"), ["symbol"], SIMULATIONS)


def monte_carlo(spark, sf) -> DataFrame:
    sims = resampling.simulations(booked(spark, sf), ["symbol"], CASH, SIMULATIONS)
    return resampling.method_summary(sims, ["symbol"])


def simulated(spark, sf) -> DataFrame:
    return resampling.simulations(booked(spark, sf), ["symbol"], CASH, SIMULATIONS)


def path_highlights(spark, sf) -> DataFrame:
    """The numbers of the worst, the median and the best simulation of every method, by return to six decimals."""
    return resampling.highlights(simulated(spark, sf).withColumn("pct", F.round("total_return_pct", 6)), ["symbol", "method"], "pct")


def drawn_paths(spark, sf) -> DataFrame:
    """Every symbol's first three bootstrapped paths, step by step."""
    paths = resampling.capped_paths(resampling.bootstrap_trades(booked(spark, sf), ["symbol"], SIMULATIONS), 3)
    return paths.withColumn("equity", CASH + F.sum("pnl").over(over(["symbol", "sim"], "step").rowsBetween(Window.unboundedPreceding, 0)))


def path_bands(spark, sf) -> DataFrame:
    found = resampling.path_bands(resampling.bootstrap_trades(booked(spark, sf), ["symbol"], SIMULATIONS), ["symbol"], CASH)
    return found.select("symbol", "step", "sims", *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("p05", "median", "p95"))])


def walk_summary(spark, sf) -> DataFrame:
    """The older walk-forward's folds in figures, with those of the stitched curve beside them."""
    results = walk(spark, sf).select("symbol", "fold", (SHARE * F.col("result")).alias("ret"), F.lit(1).alias("trades"))
    return reports.summary_with(reports.fold_summary(results, ["symbol"]), walk_figures(spark, sf).select("symbol", "final_equity", "max_drawdown_pct"), ["symbol"])


def stability_by_symbol(spark, sf) -> DataFrame:
    found = folds.stability(best_lengths(spark, sf), ["symbol"], ["channel_bars"]).withColumnRenamed("symbol", "variant")
    return reports.stability_pivot(found, SYMBOLS)


def return_faults(spark, sf) -> DataFrame:
    """Why candidates' returns could not be used: one of them is blown up fifteenfold."""
    rows = candidates(spark, sf).withColumn("ret", F.when(F.col("candidate") == "turned", 15 * F.col("ret")).otherwise(F.col("ret")))
    return metrics.returns_fault(rows, ["symbol", "candidate"])


def allowed_signals(spark, sf) -> DataFrame:
    """The channel's signals at the times that the state policy lets through."""
    return breakout.allowed_times(signals(spark, sf), state_policy(spark, sf).filter("allowed"))


def stop_fallbacks(spark, sf) -> DataFrame:
    """Entered signals whose levels are taken away in odd hours and put at fixed distances from the entry."""
    taken = trades.entries(breakout.first_of_session(signals(spark, sf)))
    odd = F.hour("ts") % 2 == 1
    return trades.fallback_levels(taken.withColumns({c: F.when(~odd, F.col(c)) for c in ("stop", "target")}), 5.0, 8.0)


def state_filter(spark, sf) -> DataFrame:
    """Channel candidates with features, split, states, and whether the filter lets them through."""
    rows = candidate_parts(spark, sf)
    rows = regimes.fit_and_filter(rows, ["symbol"], breakout.FEATURES, states=2)
    ok = regimes.tradable_states(regimes.state_figures(rows.filter("part = 'head'"), ["symbol"]), ["symbol"], 1)
    return regimes.apply_filter(rows, ok, regimes.validate(rows, ok, ["symbol"]), ["symbol"])


def chosen(spark, sf) -> DataFrame:
    """The best channel length of every session fold's training part, and what every length makes in its test part."""
    results = length_trades(spark, sf).select("symbol", "session", F.col("channel_bars").cast("string").alias("params"), "net_r")
    spans = folds.session_folds(tagged(spark, sf).select("symbol", "session"), 8, 4, 4, ["symbol"])
    every = spans.select("symbol", "fold", "role").distinct().select("*", F.explode(F.array(*[F.lit(str(n)) for n in CHANNELS])).alias("params"))
    scored = spans.join(results, ["symbol", "session"]).groupBy("symbol", "fold", "role", "params").agg(F.sum("net_r").alias("r"))
    return every.join(scored, ["symbol", "fold", "role", "params"], "left").fillna({"r": 0.0})


def decision_log(spark, sf) -> DataFrame:
    """Every decision out of sample with what it rested on: the regime, whether the gate let the router trade and why, and the cash before and after."""
    keys = ["symbol", "fold"]
    tags = robust_tags(spark, sf).filter("role = 'test'").select(*keys, "session", "regime")
    rows = robust_walk(spark, sf).join(tags, [*keys, "session"], "left").join(robust_gate(spark, sf).select(*keys, F.col("reason").alias("gate_reason")), keys, "left")
    before = F.lag("cash", 1, CASH).over(over(["symbol", "policy", "cost"], "session"))
    return rows.withColumn("starting_cash", before).withColumn("daily_return", F.when(F.col("starting_cash") > 0, F.col("cash") / F.col("starting_cash") - 1).otherwise(0.0))


def search_trials(spark, sf) -> DataFrame:
    """The points of the search space that every fold tries."""
    searches = folds.session_folds(tagged(spark, sf).select("symbol", "session"), 8, 4, 4, ["symbol"]).select("symbol", "fold").distinct()
    return SPACE.with_values(SPACE.trials(searches, TRIALS))


def trial_neighbours(spark, sf) -> DataFrame:
    """(symbol, fold, trial, point, near and its values): the points one step from every trial."""
    near = SPACE.neighbours(search_trials(spark, sf).select("symbol", "fold", "trial", "point"))
    return SPACE.with_values(near, "near")


def bar_features(spark, sf) -> DataFrame:
    return breakout.with_features(prepared(spark, sf))


def candidate_parts(spark, sf) -> DataFrame:
    """The channel's trades with features, split into an earlier head and a later tail by symbol."""

    def plan() -> DataFrame:
        t = closed(spark, sf).join(bar_features(spark, sf).select("symbol", "ts", *breakout.FEATURES), ["symbol", "ts"])
        return selection.head_and_tail(t.select("symbol", "ts", "session", "net_r", *breakout.FEATURES), ["symbol"], "ts", 0.3, 3)

    return derived(spark, sf, "candidate-parts", plan, CHANNEL, COSTS)


def state_policy(spark, sf) -> DataFrame:
    """What becomes of candidates whose states are known, here by their bar's body and range: the best state is traded where the tail bears it out."""
    state = F.when(F.col("body_to_range") < 0.4, 0).when(F.col("bar_range_atr") < 0.2, 1).otherwise(2)
    rows = candidate_parts(spark, sf).withColumn("state", state)
    ok = regimes.tradable_states(regimes.state_figures(rows.filter("part = 'head'"), ["symbol"]), ["symbol"], 1, least=3)
    return regimes.apply_filter(rows, ok, regimes.validate(rows, ok, ["symbol"], least=5), ["symbol"])


def state_verdicts(spark, sf) -> DataFrame:
    """The figures that the filter is judged by, a row a symbol."""
    rows = state_policy(spark, sf).select("symbol", "ts", "part", "state", "net_r")
    ok = regimes.tradable_states(regimes.state_figures(rows.filter("part = 'head'"), ["symbol"]), ["symbol"], 1, least=3)
    return regimes.validate(rows, ok, ["symbol"], least=5)


def walk(spark, sf) -> DataFrame:
    """Fold after fold: the parameters in use, renewed only after a losing fold."""
    scored = chosen(spark, sf)
    best = folds.best(scored.filter("role = 'train'").withColumn("score", folds.objective(F.col("r"))), ["symbol", "fold"], "params").select("symbol", "fold", F.col("params").alias("best"))
    tests = scored.filter("role = 'test'").groupBy("symbol", "fold").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("params", "r")))).alias("results"))
    return folds.kept_parameters(best.join(tests, ["symbol", "fold"]), ["symbol"])


def content(spark, sf) -> DataFrame:
    """One row (rows, hash_sum, digest) of the 30-minute bars' content, numbers to nine decimals."""
    columns = ["symbol", F.unix_micros(F.col("ts").cast("timestamp")), *[F.col(c).cast("decimal(30,9)") for c in bars.BAR]]
    found = incremental.with_digest(incremental.leaves(bars30(spark, sf), [], columns))
    return found.select("rows", F.col("a").cast("string").alias("hash_sum"), "digest")


def out_of_sample(spark, sf) -> DataFrame:
    """Cash after every session of the routed and the general policy, at normal and at stressed costs."""
    return reports.policy_capital(reports.policies(routing(spark, sf), candidates(spark, sf), "as_is", ["symbol"]), CASH, ["symbol"])


def fold_results(spark, sf) -> DataFrame:
    """(symbol, fold, params, ret, trades) of every channel length in the folds' test parts, a risk of 1% a trade."""
    scored = chosen(spark, sf).filter("role = 'test'")
    return scored.select("symbol", "fold", "params", (F.col("r") * 0.01).alias("ret"), F.lit(1).alias("trades"))


def order_months(spark, sf) -> DataFrame:
    """Volume-weighted price bars a day of the line items, by return flag."""
    li = renamed(load(spark, f"{sf}/lineitem.parquet"), {"symbol": "l_returnflag", "ts": "l_shipdate", "amount": "l_extendedprice", "volume": "l_quantity", "order": "l_orderkey", "line": "l_linenumber"})
    rows = li.withColumn("price", F.col("amount") / F.col("volume")).withColumn("seq", F.struct("order", "line"))
    return bars.resample(rows, "1 day")


def holdings(spark, sf) -> DataFrame:
    """Folds compounded: cash at the start and end of each, by symbol and channel length."""
    return folds.carried_capital(fold_results(spark, sf), CASH, ["symbol", "params"])


def best_lengths(spark, sf) -> DataFrame:
    """(symbol, fold, channel_bars): the channel length that each fold's training part chose."""
    scored = chosen(spark, sf).filter("role = 'train'").withColumn("score", folds.objective(F.col("r")))
    return folds.best(scored, ["symbol", "fold"], "params").select("symbol", "fold", F.col("params").alias("channel_bars"))


# -- the robust walk-forward: search, neighbours, calibration, gate, test ----------------------


def step(spark, sf, name: str, plan) -> DataFrame:
    """A step of the protocol as a derived table, so that the next one's plan starts from it and a lost executor does not go back further."""
    return derived(spark, sf, f"robust-{name}", plan, ROBUST, ROBUST_STEPS, ROLES, SHARE, SIMULATIONS, CHANNEL, COSTS, CASH)


def robust_trades(spark, sf) -> DataFrame:
    """The trades of the whole search space at normal and stressed costs, built once for each state of the ticks."""
    return step(spark, sf, "trades", lambda: grid_trades(spark, sf, ROBUST, (1.0, 2.0)))


def roles(spark, sf) -> DataFrame:
    return step(spark, sf, "roles", lambda: folds.role_folds(tagged(spark, sf).select("symbol", "session"), ROLES, ROLES[-1][1], ["symbol"]))


def _candidate_days(spark, sf) -> DataFrame:
    """(symbol, fold, role, params_id, session, ret, traded): what each set makes of its cash in each session of each role."""
    t = robust_trades(spark, sf).filter("factor = 1").select("symbol", "params_id", "session", "net_r")
    every = roles(spark, sf).join(t.select("symbol", "params_id").distinct(), "symbol")  # sets that never trade are not eligible
    rows = every.join(t, ["symbol", "params_id", "session"], "left")
    return rows.select("symbol", "fold", "role", "params_id", "session", F.coalesce(SHARE * F.col("net_r"), F.lit(0.0)).alias("ret"), F.col("net_r").isNotNull().alias("traded"))


def _search_scores(spark, sf) -> DataFrame:
    """Each set's score over the two halves of each fold's search sessions."""
    own = candidate_days(spark, sf).filter("role = 'search'")
    half = ROLES[0][1] // 2
    days = roles(spark, sf).filter("role = 'search'")
    blocks = days.withColumn("block", F.when(F.row_number().over(over(["symbol", "fold"], "session")) <= half, 1).otherwise(2)).select("symbol", "fold", "session", "block")
    return selection.block_scores(own.select("symbol", "fold", "params_id", "session", "ret"), own.filter("traded").select("symbol", "fold", "params_id", "session"), blocks, ["symbol", "fold", "params_id"], 2, 1)


def _finalists(spark, sf, shortlist: int = 4) -> DataFrame:
    """(symbol, fold, params_id, median_score, rank): the best sets of each fold by the median of their own and their neighbours' scores."""
    return folds.finalists(search_scores(spark, sf), folds.grid(spark, ROBUST), ROBUST_STEPS, ["symbol", "fold"], shortlist)


def robust_tags(spark, sf) -> DataFrame:
    """(symbol, fold, role, session, volatility, regime, general): the regime of each session by the limits of its fold's search part; folds without a finalist have none."""

    def plan() -> DataFrame:
        keys = ["symbol", "fold"]
        general = finalists(spark, sf).filter("rank = 1").select(*keys, F.col("params_id").alias("general"))
        vol = selection.session_volatility(selection.last_closes(tagged(spark, sf)), n=4)
        by_role = roles(spark, sf).join(vol, ["symbol", "session"])
        return selection.regimes(by_role, selection.thresholds(by_role.filter("role = 'search'"), keys), keys).join(general, keys)

    return step(spark, sf, "tags", plan)


def _robust_routes(spark, sf) -> DataFrame:
    """(symbol, fold, role, session, candidate, general): the set in use in each gate and test session, by the regime's library."""
    return selection.routes_by_role(finalists(spark, sf), candidate_days(spark, sf), robust_tags(spark, sf), ["symbol", "fold"], 1, 1, 5.0)


def candidate_days(spark, sf) -> DataFrame:
    return step(spark, sf, "days", lambda: _candidate_days(spark, sf))


def search_scores(spark, sf) -> DataFrame:
    return step(spark, sf, "scores", lambda: _search_scores(spark, sf))


def finalists(spark, sf) -> DataFrame:
    return step(spark, sf, "finalists", lambda: _finalists(spark, sf))


def robust_routes(spark, sf) -> DataFrame:
    return step(spark, sf, "routes", lambda: _robust_routes(spark, sf))


def robust_gate(spark, sf) -> DataFrame:
    return step(spark, sf, "gate", lambda: _robust_gate(spark, sf))


def gate_replay(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The router and the general set on real capital through the gate sessions: by session, and bar by bar."""
    own = ["symbol", "fold", "policy"]
    pair = F.inline(F.array(F.struct(F.lit("router").alias("policy"), F.col("candidate").alias("params_id")), F.struct(F.lit("general").alias("policy"), F.col("general").alias("params_id"))))
    decided = robust_routes(spark, sf).filter("role = 'gate'").select("symbol", "fold", "session", pair)
    taken = decided.join(robust_trades(spark, sf).filter("factor = 1"), ["symbol", "params_id", "session"])
    days, curve = trades.replay(tagged(spark, sf), taken, decided, CASH, own, SHARE)
    return step(spark, sf, "gate-days", lambda: days), step(spark, sf, "gate-curve", lambda: curve)


def replayed(spark, sf) -> DataFrame:
    return gate_replay(spark, sf)[0]


def _robust_gate(spark, sf, least_trades: int = 1) -> DataFrame:
    """(symbol, fold, accepted, reason, ...): whether the router beat the general set, by bootstrap, trades and drawdowns at every close."""
    keys = ["symbol", "fold"]
    days, curve = gate_replay(spark, sf)
    of = lambda p: days.filter(F.col("policy") == p).select(*keys, "session", "ret")
    verdict = selection.gate(of("router"), of("general"), keys, SIMULATIONS, ROLES[2][1])
    falls = metrics.with_drawdown(curve, CASH, [*keys, "policy"], order="ts").groupBy(*keys).pivot("policy", ["router", "general"]).agg(F.min("drawdown"))
    falls = falls.select(*keys, F.col("router").alias("router_drawdown"), F.col("general").alias("general_drawdown"))
    count = days.groupBy(*keys, "policy").agg(F.sum("trades").alias("n")).groupBy(*keys).agg(F.min("n").alias("trades"))
    out = verdict.join(falls, keys).join(count, keys)
    reason = (
        F.when(F.col("trades") < least_trades, "insufficient_gate_trades")
        .when(F.col("accepted") & (F.col("router_drawdown") < F.col("general_drawdown") - 1e-12), "worse_close_marked_drawdown")
        .otherwise(F.col("reason"))
    )
    return out.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "accepted")


def robust_walk(spark, sf) -> DataFrame:
    """(symbol, policy, cost, fold, session, candidate, routed, ret, cash): every out-of-sample decision, and the cash that it led to, carried from fold to fold.

    Folds without a finalist hold cash; folds whose gate did not accept the router trade the general set.
    """
    keys = ["symbol", "fold"]
    tests = roles(spark, sf).filter("role = 'test'").drop("role")
    decided = tests.join(robust_routes(spark, sf).filter("role = 'test'").select(*keys, "session", "candidate", "general"), [*keys, "session"], "left").join(robust_gate(spark, sf).select(*keys, "accepted"), keys, "left")
    both = reports.two_policies(decided, F.coalesce("accepted", F.lit(False)), [*keys, "session"])
    levels = F.inline(F.array(F.struct(F.lit("normal").alias("cost"), F.lit(1.0).alias("factor")), F.struct(F.lit("stress").alias("cost"), F.lit(2.0).alias("factor"))))
    rows = both.select("*", levels)
    made = robust_trades(spark, sf).select("symbol", F.col("params_id").alias("candidate"), "session", "factor", (SHARE * F.col("net_r")).alias("ret"))
    rows = rows.join(made, ["symbol", "candidate", "session", "factor"], "left").fillna({"ret": 0.0})
    return reports.policy_capital(rows.drop("factor"), CASH, ["symbol"])


def stitched_returns(spark, sf) -> DataFrame:
    """(symbol, session, ret): the daily returns of the older walk-forward's stitched curve."""
    decided = walk_picks(spark, sf)
    _, curve = trades.replay(tagged(spark, sf), decided.join(length_trades(spark, sf), ["symbol", "channel_bars", "session"]), decided, CASH, ["symbol"], SHARE)
    return metrics.session_returns(curve, decided.select("symbol", "session"), CASH, ["symbol"])


def _stitched(spark, sf, taken: DataFrame, decided: DataFrame, by: list[str]) -> DataFrame:
    """Figures of one curve a key, from the trades taken in its sessions."""
    days, curve = trades.replay(tagged(spark, sf), taken, decided, CASH, by, SHARE)
    flags = curve.join(taken.select(*by, "session", "entry_ts", "exit_ts"), [*by, "session"], "left")
    held = F.coalesce((F.col("ts") >= F.col("entry_ts")) & (F.col("ts") < F.col("exit_ts")), F.lit(False)).cast("int")
    curve = flags.select(*by, "session", "ts", "equity", held.alias("in_position"))
    booked_ = days.filter("trades = 1").select(*by, "session", (F.col("cash_after") - F.col("cash_before")).alias("net_pnl"))
    return metrics.figures(curve, booked_, CASH, by)


def walk_picks(spark, sf) -> DataFrame:
    """(symbol, fold, session, channel_bars): the length in use in every test session of the older walk-forward."""

    def plan() -> DataFrame:
        picked = walk(spark, sf).select("symbol", "fold", F.col("params").cast("int").alias("channel_bars"))
        tests = folds.session_folds(tagged(spark, sf).select("symbol", "session"), 8, 4, 4, ["symbol"]).filter("role = 'test'").drop("role")
        return tests.join(picked, ["symbol", "fold"])

    return derived(spark, sf, "walk-picks", plan, CHANNELS, CHANNEL, COSTS)


def length_trades(spark, sf) -> DataFrame:
    """The trades of every channel length."""
    return derived(spark, sf, "length-trades", lambda: grid_trades(spark, sf, {"channel_bars": CHANNELS}), CHANNELS, CHANNEL, COSTS)


def walk_figures(spark, sf) -> DataFrame:
    """The older walk-forward as one curve: figures of the chosen lengths' test sessions, stitched from fold to fold."""
    decided = walk_picks(spark, sf)
    return _stitched(spark, sf, decided.join(length_trades(spark, sf), ["symbol", "channel_bars", "session"]), decided, ["symbol"])


# -- the regime filter inside the walk-forward -----------------------------------------------------

MODEL_KEYS = ["symbol", "fold", "channel_bars"]
LOOK, STATES = 16, 2  # sessions before a test part that its model learns from, and states


def length_candidates(spark, sf) -> DataFrame:
    """Of every channel length the first *resolvable* signal of each session, with its outcome and bar features: one that is not entered does not use the session up."""

    def plan() -> DataFrame:
        rules, b = replace(CHANNEL, channel_bars=CHANNELS), tagged(spark, sf)
        rows = breakout.prepare(b, rules).filter("entry_allowed AND ts < force_exit")
        entered = trades.entries(breakout.signals(rows, rules, variant=["channel_bars"]))
        left = trades.outcomes(trades.exits(entered, b, variant=["channel_bars"]), COSTS).filter("net_r IS NOT NULL")
        bars_ = breakout.with_features(prepared(spark, sf)).select("symbol", "ts", *breakout.FEATURES)
        return breakout.first_of_session(left, ["symbol", "channel_bars"]).join(bars_, ["symbol", "ts"])

    return derived(spark, sf, "length-candidates", plan, CHANNELS, CHANNEL, COSTS)


def filter_rows(spark, sf) -> DataFrame:
    """Each fold's own history and test part, for the length that it uses: (symbol, fold, channel_bars, session, ts, net_r, features, part)."""

    def plan() -> DataFrame:
        spans = folds.session_folds(tagged(spark, sf).select("symbol", "session"), LOOK, 4, 4, ["symbol"]).withColumn("fold", F.col("fold") + (LOOK - 8) // 4)
        own = spans.join(walk_picks(spark, sf).select(*MODEL_KEYS).distinct(), ["symbol", "fold"])
        rows = own.join(length_candidates(spark, sf), ["symbol", "channel_bars", "session"]).select(*MODEL_KEYS, "role", "session", "ts", "net_r", *breakout.FEATURES)
        past = selection.head_and_tail(rows.filter("role = 'train'"), MODEL_KEYS, "ts", 0.3, 3)
        return past.unionByName(rows.filter("role = 'test'").withColumn("part", F.lit("test"))).drop("role")

    return derived(spark, sf, "filter-rows", plan, CHANNELS, CHANNEL, COSTS, LOOK)


def filter_models(spark, sf) -> DataFrame:
    """The model of every symbol, fold and length as a written table, with how it was fitted."""
    return derived(spark, sf, "filter-models", lambda: hidden.fit_models(filter_rows(spark, sf).filter("part = 'head'"), MODEL_KEYS, breakout.FEATURES, states=STATES), CHANNELS, CHANNEL, COSTS, LOOK, STATES)


def filtered_candidates(spark, sf) -> DataFrame:
    """(symbol, fold, channel_bars, session, ts, state, status, allowed) of the test candidates, from the written models alone."""
    rows = hidden.states_of(filter_rows(spark, sf), filter_models(spark, sf), MODEL_KEYS, breakout.FEATURES)
    ok = regimes.tradable_states(regimes.state_figures(rows.filter("part = 'head'"), MODEL_KEYS), MODEL_KEYS, 1)
    out = regimes.apply_filter(rows, ok, regimes.validate(rows, ok, MODEL_KEYS), MODEL_KEYS)
    return out.filter("part = 'test'").select(*MODEL_KEYS, "session", "ts", "state", "status", "allowed")


def walk_with_filter(spark, sf) -> DataFrame:
    """The older walk-forward with (raw_hmm) and without (raw) the regime filter: figures of both curves. Folds without a model trade as they are."""
    decided = walk_picks(spark, sf)
    raw = trades.source_tag(decided.join(length_trades(spark, sf), ["symbol", "channel_bars", "session"]), False, False)
    verdicts = filtered_candidates(spark, sf).select(*MODEL_KEYS, "ts", "allowed")
    passed = decided.join(length_candidates(spark, sf), ["symbol", "channel_bars", "session"]).join(verdicts, [*MODEL_KEYS, "ts"], "left").filter(F.coalesce("allowed", F.lit(True)))
    columns = ["symbol", "session", "source", "side", "entry_ts", "exit_ts", "entry_price", "risk", "net_r"]
    taken = raw.select(*columns).unionByName(trades.source_tag(passed, False, True).select(*columns))
    both = decided.select("symbol", "session", F.explode(F.array(F.lit("raw"), F.lit("raw_hmm"))).alias("source"))
    return _stitched(spark, sf, taken, both, ["symbol", "source"])
