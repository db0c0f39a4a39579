"""Bars, trades and figures against literal expectations and plain Python."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidebars.functions.rolling import recurrence
from tidebars.operators import bands, bars, breakout, folds, metrics, regimes, resampling, selection, trades

BAR = "symbol string, ts timestamp_ntz, session date, open double, high double, low double, close double, volume double"


def hours(spark, rows, session=date(2025, 1, 2)):
    t0 = datetime(2025, 1, 2, 1)
    return spark.createDataFrame([("X", t0 + timedelta(hours=i), session, *map(float, r), 1.0) for i, r in enumerate(rows)], BAR)


def entered(spark, side=1, stop=95.0, target=120.0, trigger=None, moved=None, at=0, force=23):
    t0 = datetime(2025, 1, 2, 1)
    row = [("X", date(2025, 1, 2), t0 - timedelta(hours=1), side, stop, target, trigger, moved, t0 + timedelta(hours=force), t0 + timedelta(hours=at), 100.0)]
    return spark.createDataFrame(row, "symbol string, session date, ts timestamp_ntz, side int, stop double, target double, trigger double, moved_stop double, force_exit timestamp_ntz, entry_ts timestamp_ntz, entry_open double")


@pytest.mark.parametrize(
    ("bar_rows", "options", "want"),
    [
        ([(125, 126, 90, 95)], {}, (120.0, "take_profit")),
        ([(90, 94, 89, 92)], {}, (90.0, "stop_loss")),
        ([(100, 130, 90, 95)], {}, (95.0, "stop_loss")),
        ([(100, 101, 99, 100)], {"stop": None, "target": None}, (100.0, "final_bar")),
        ([(100, 106, 96, 104), (101, 102, 99, 100)], {"trigger": 105.0, "moved": 100.0}, (100.0, "stop_loss")),
        ([(100, 101, 99, 100), (90, 91, 89, 90)], {"stop": 50.0, "force": 1}, (90.0, "force_exit")),
        ([(100, 111, 99, 110)], {"side": -1, "stop": 110.0, "target": 80.0}, (110.0, "stop_loss")),
    ],
)
def test_exits(spark, bar_rows, options, want):
    got = trades.exits(entered(spark, **options), hours(spark, bar_rows)).select("exit_level", "reason").first()
    assert (got[0], got[1]) == want


def test_entry_needs_the_same_session_and_time(spark):
    b = hours(spark, [(1, 2, 0, 1)] * 3)
    s = b.select("symbol", "session", "ts", F.lit(1).alias("side"), (F.lit(datetime(2025, 1, 2, 3)).cast("timestamp_ntz")).alias("force_exit"))
    assert trades.entries(s, b).count() == 1  # the second bar would enter at the forced exit, the last has no next bar


def test_recurrence_equals_a_loop(spark):
    import random

    random.seed(3)
    xs = [random.random() * 10 for _ in range(700)]
    t0 = datetime(2025, 1, 1)
    df = spark.createDataFrame([("X", t0 + timedelta(minutes=i), x) for i, x in enumerate(xs)], "symbol string, ts timestamp_ntz, x double")
    got = [r[0] for r in recurrence(df, "x", "y", ["symbol"], "ts", 14, chunk=64).orderBy("ts").select("y").collect()]
    y = xs[0]
    for i, x in enumerate(xs):
        y = y if i == 0 else y + (x - y) / 14
        assert got[i] is None if i < 13 else abs(got[i] - y) < 1e-9


@pytest.mark.parametrize("length", [1, 2, 3])
@pytest.mark.parametrize("xs", [[10.0, 10.0, None, 10.0, 10.0], [None, 10.0, 4.0, None, None, 7.0, 1.0], [None, None], [3.0, None, 5.0]])
def test_recurrence_over_nulls_equals_a_loop(spark, xs, length):
    t0 = datetime(2025, 1, 1)
    df = spark.createDataFrame([("X", t0 + timedelta(minutes=i), x) for i, x in enumerate(xs)], "symbol string, ts timestamp_ntz, x double")
    got = [r[0] for r in recurrence(df, "x", "y", ["symbol"], "ts", length, chunk=2).orderBy("ts").select("y").collect()]
    y, n = None, 0
    for i, x in enumerate(xs):
        if x is not None:
            y, n = x if y is None else y + (x - y) / length, n + 1
        assert got[i] == (pytest.approx(y) if n >= length else None)


def exchanges(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join"), df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_plans_do_not_grow_with_the_grid(spark):
    from tidebars.plans import market

    sf = "/root/testdata/sf0.001"
    few = market.grid_trades(spark, sf, {"channel_bars": (6, 10), "side_mode": ("both", "long", "short")})
    many = market.grid_trades(spark, sf, {"channel_bars": (4, 6, 8, 10), "side_mode": ("both", "long", "short"), "reward": (1.0, 2.0), "break_even": (True, False)}, (1.0, 2.0))
    assert exchanges(few) == exchanges(many)
    assert "events" not in few._jdf.queryExecution().executedPlan().toString()  # only the derived bars are read


def test_replay_multiplies_and_marks_every_close(spark):
    days = [date(2025, 1, d) for d in (2, 3, 4)]
    t = lambda d, h: datetime(2025, 1, d, h)
    bars_ = spark.createDataFrame([("X", d, t(d.day, h), 100.0 + h - 8) for d in days for h in (8, 9, 10)], "symbol string, session date, ts timestamp_ntz, close double")
    won = [("X", "p", days[0], 1, t(2, 8), t(2, 10), 100.0, 10.0, 2.0), ("X", "p", days[2], -1, t(4, 9), t(4, 10), 101.0, 2.0, -1.0)]
    taken = spark.createDataFrame(won, "symbol string, policy string, session date, side int, entry_ts timestamp_ntz, exit_ts timestamp_ntz, entry_price double, risk double, net_r double")
    sessions = spark.createDataFrame([("X", "p", d) for d in days], "symbol string, policy string, session date")
    by_day, curve = trades.replay(bars_, taken, sessions, 1000.0, ["symbol", "policy"], 0.1)
    assert [(r["cash_before"], r["cash_after"], r["trades"]) for r in by_day.orderBy("session").collect()] == [(pytest.approx(1000), pytest.approx(1200), 1), (pytest.approx(1200), pytest.approx(1200), 0), (pytest.approx(1200), pytest.approx(1080), 1)]
    got = [r["equity"] for r in curve.orderBy("ts").collect()]
    assert got == pytest.approx([1000, 1010, 1200, 1200, 1200, 1200, 1200, 1200, 1080])


def test_gates_open_and_close(spark):
    rules = breakout.Rules(use_vwap=F.col("v"), use_bands=F.col("b"), use_atr_buffer=F.col("a"), atr_buffer=0.5)
    row = [("X", date(2025, 1, 2), datetime(2025, 1, 2, 9), 100.0, 99.0, 103.0, 102.0, 99.5, 90.0, 101.0, 5.0, True, datetime(2025, 1, 2, 16), v, b, a, up) for v in (False, True) for b in (False, True) for a in (False, True) for up in (None, 104.0)]
    names = "symbol string, session date, ts timestamp_ntz, range_high double, range_low double, high double, close double, low double, atr_stop double, vwap double, atr_session double, entry_allowed boolean, force_exit timestamp_ntz, v boolean, b boolean, a boolean, band_fe_pos_lower double"
    df = spark.createDataFrame(row, names).withColumns({"band_ae_pos_upper": F.lit(101.0), "band_ae_neg_lower": F.lit(1.0), "band_fe_neg_upper": F.lit(0.0), "up": F.col("band_fe_pos_lower"), "next_ts": F.col("ts"), "next_open": F.col("close"), "next_session": F.col("session")})
    got = {(r["v"], r["b"], r["a"], r["up"]) for r in breakout.signals(df, rules, variant=["v", "b", "a", "up"]).collect()}
    assert got == {(v, b, False, up) for v in (False, True) for b in (False, True) for up in (None, 104.0) if not b or up}  # the buffer of 2.5 keeps 102 out


def test_roles_follow_each_other(spark):
    days = spark.createDataFrame([("X", date(2025, 1, 1) + timedelta(days=i)) for i in range(13)], "symbol string, session date")
    got = {}
    for r in folds.role_folds(days, [("search", 4), ("gate", 2), ("test", 3)], 3, ["symbol"]).collect():
        got.setdefault((r["fold"], r["role"]), []).append(r["session"].day)
    assert {k: sorted(v) for k, v in got.items()} == {(0, "search"): [1, 2, 3, 4], (0, "gate"): [5, 6], (0, "test"): [7, 8, 9], (1, "search"): [4, 5, 6, 7], (1, "gate"): [8, 9], (1, "test"): [10, 11, 12]}
    assert folds.session_folds(days.filter("symbol = 'Y'"), 4, 2, 1).count() == 0


def test_neighbourhood_median(spark):
    near = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("d", "x")], "of string, params_id string")
    scores = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None), ("d", 2.0)], "params_id string, score double")
    got = {r["of"]: (r["median_score"], r["usable"]) for r in folds.neighbour_scores(near, scores).collect()}
    assert got == {"a": (1.0, True), "d": (float("-inf"), False)}


def test_robust_walk_forward_holds_together(spark):
    from tidebars.plans import market

    sf = "/root/testdata/sf0.01"
    rows = market.robust_walk(spark, sf).collect()
    tests = {(r["symbol"], r["fold"], r["session"]) for r in market.roles(spark, sf).filter("role = 'test'").collect()}
    assert len(rows) == 4 * len(tests) and {(r["symbol"], r["fold"], r["session"]) for r in rows} == tests
    final = {(r["symbol"], r["fold"], r["rank"]): r["params_id"] for r in market.finalists(spark, sf).collect()}
    general = {(r["symbol"], r["fold"]): r["candidate"] for r in rows if r["policy"] == "general"}
    assert all(c == final.get((*k, 1), "cash") for k, c in general.items())
    streams = {}
    for r in sorted(rows, key=lambda r: r["session"]):
        before = streams.get((r["symbol"], r["policy"], r["cost"]), market.CASH)
        assert r["cash"] == pytest.approx(before * (1 + r["ret"]))
        streams[(r["symbol"], r["policy"], r["cost"])] = r["cash"]
        if not r["routed"]:
            assert r["candidate"] == general[(r["symbol"], r["fold"])]
    ok = {(r["symbol"], r["fold"]) for r in market.robust_gate(spark, sf).filter("accepted").collect()}
    assert {(r["symbol"], r["fold"]) for r in rows if r["routed"]} == ok & {k[:2] for k in tests}


def test_drawdowns(spark):
    rows = [(1, datetime(2025, 5, 1), 95_000.0), (1, datetime(2026, 5, 1), 80_000.0), (1, datetime(2026, 6, 1), 100_000.0)]
    eq = spark.createDataFrame(rows, "k int, ts timestamp_ntz, equity double").withColumn("in_position", F.lit(0))
    none = spark.createDataFrame([], "k int, exit_ts timestamp_ntz, net_pnl double")
    got = {r["year"]: r["max_drawdown_pct"] for r in metrics.yearly(eq, none, 100_000.0, ["k"]).collect()}
    assert got[2026] == pytest.approx(-15.7894736842)
    assert metrics.figures(eq.filter("year(ts) = 2025"), none, 100_000.0, ["k"]).first()["max_drawdown_pct"] == pytest.approx(-5)


def test_session_returns(spark):
    rows = [(1, datetime(2025, 1, 1 + i), date(2025, 1, 1 + s), e) for i, (s, e) in enumerate([(0, 100.0), (0, 110.0), (2, 110.0), (2, 99.0)])]
    eq = spark.createDataFrame(rows, "k int, ts timestamp_ntz, session date, equity double")
    days = spark.createDataFrame([(1, date(2025, 1, d)) for d in (1, 2, 3)], "k int, session date")
    got = [r["ret"] for r in metrics.session_returns(eq, days, 100.0, ["k"]).orderBy("session").collect()]
    assert got == pytest.approx([0.1, 0.0, -0.1])


def test_compounding_and_cap(spark):
    rows = [("X", datetime(2025, 1, 1 + i), 100.0, 10.0, 0.1 * 10, 0.1) for i in range(6)]
    t = spark.createDataFrame(rows, "symbol string, exit_ts timestamp_ntz, entry_price double, risk double, net_points double, net_r double")
    last = lambda df: df.orderBy(F.col("exit_ts").desc()).first()["cash_after"]
    assert last(trades.ledger(t, 1000.0, ["symbol"], "current")) == pytest.approx(1000 * 1.001**6)
    assert last(trades.ledger(t, 1000.0, ["symbol"], "current", most=1e9)) == pytest.approx(1000 * 1.001**6)
    assert last(trades.ledger(t, 1000.0, ["symbol"], "current", most=0.5)) == pytest.approx(1000 + 6 * 0.5)
    assert last(trades.ledger(t, 1000.0, ["symbol"], "initial")) == pytest.approx(1000 + 6 * 1.0)


def test_regimes_and_routing(spark):
    days = [date(2025, 1, 1 + i) for i in range(7)]
    vol = spark.createDataFrame([(1, d, v) for d, v in zip(days, [1.0, 2.0, 3.0, None, 1.0, 2.0, 3.0])], "k int, session date, volatility double")
    limits = spark.createDataFrame([(1, 1.0, 2.0)], "k int, lower double, upper double")
    got = [r["regime"] for r in selection.regimes(vol, limits, ["k"]).orderBy("session").collect()]
    assert got == ["low", "normal", "high", "unknown", "low", "normal", "high"]
    seen = ["low", "low", "high", "high", "unknown", "high", "high"]
    tags = spark.createDataFrame([(1, d, r) for d, r in zip(days, seen)], "k int, session date, regime string")
    lib = spark.createDataFrame([(1, "low", "slow"), (1, "high", "fast")], "k int, regime string, candidate string")
    got = [r["candidate"] for r in selection.route(tags, lib, ["k"], "general").orderBy("session").collect()]
    assert got == ["general", "slow", "slow", "fast", "general", "general", "fast"]


def test_ties_and_shrinkage(spark):
    s = spark.createDataFrame([(1, "general", "low", 1.0), (1, "alpha", "low", 1.0), (1, "x", "high", None)], "k int, candidate string, regime string, score double")
    got = {r["regime"]: (r["candidate"], r["reason"]) for r in selection.library(s, ["k"], "general").collect()}
    assert got == {"low": ("alpha", "selected"), "high": ("general", "fallback_no_eligible_candidate")}


def test_gate(spark):
    days = [date(2025, 1, 1) + timedelta(days=i) for i in range(60)]
    base = spark.createDataFrame([(1, d, 0.001 * (-1) ** i) for i, d in enumerate(days)], "k int, session date, ret double")
    up, down = base.withColumn("ret", F.col("ret") + 0.001), base.withColumn("ret", F.col("ret") - 0.001)
    assert selection.gate(up, base, ["k"], 50).first()["reason"] == "accepted"
    assert selection.gate(down, base, ["k"], 50).first()["reason"] == "bootstrap_improvement_not_positive"


def test_neighbours(spark):
    p = folds.grid(spark, {"lookback": [10], "atr": [1.0], "flag": [True]})
    got = {(r["lookback"], r["atr"]) for r in folds.neighbours(p, {"lookback": (10, 20, 5), "atr": (0.75, 1.25, 0.25)}).collect()}
    assert got == {(15, 1.0), (10, 0.75), (10, 1.25)}
    with pytest.raises(ValueError, match="parameter sets"):
        folds.grid(spark, {"a": range(100)}, most=10)


def test_folds_do_not_overlap_when_the_step_is_the_test(spark):
    days = spark.createDataFrame([("X", date(2025, 1, 1) + timedelta(days=i)) for i in range(20)], "symbol string, session date")
    assert folds.overlapping(folds.session_folds(days, 4, 2, 2, ["symbol"])).count() == 0
    assert folds.overlapping(folds.session_folds(days, 4, 2, 1, ["symbol"])).count() > 0


def test_reoptimise_only_after_a_loss(spark):
    rows = [(1, 0, "a", {"a": 1.0, "b": 0.0}), (1, 1, "b", {"a": -1.0, "b": 0.0}), (1, 2, "b", {"a": 0.0, "b": 2.0})]
    df = spark.createDataFrame(rows, "k int, fold int, best string, results map<string,double>")
    got = [(r["params"], r["optimised"]) for r in folds.kept_parameters(df, ["k"]).orderBy("fold").collect()]
    assert got == [("a", True), ("a", False), ("b", True)]


def test_one_trade_bootstrap(spark):
    t = spark.createDataFrame([("X", datetime(2025, 1, 1), -10_000.0)], "symbol string, exit_ts timestamp_ntz, net_pnl double")
    got = resampling.simulations(t, ["symbol"], 100_000.0, 1).collect()
    assert [r["max_drawdown_pct"] for r in got] == pytest.approx([-10.0] * 3)


def test_block_bootstrap_of_constants(spark):
    rows = spark.createDataFrame([(1, date(2025, 1, 1) + timedelta(days=i), 0.5) for i in range(33)], "k int, session date, diff double")
    got = [r["mean"] for r in resampling.block_bootstrap(rows, ["k"], "diff", 20, 10).collect()]
    assert got == pytest.approx([0.5] * 20)


def test_tradable_states_hold_the_best_and_fill_up(spark):
    s = spark.createDataFrame([(1, 0, 5, 5.0, 1.0, 0.6), (1, 1, 5, -1.0, -0.2, 0.4), (1, 2, 1, 2.0, 2.0, 1.0)], "k int, state int, n int, total double, expectancy double, win_rate double")
    got = {r["state"] for r in regimes.tradable_states(s, ["k"], 1, least=3).collect()}
    assert got == {0, 2}  # the first that qualifies, and the best ranked one


def test_no_look_ahead(spark):
    t0 = datetime(2025, 1, 2, 8)
    rows = [("X", t0 + timedelta(days=d, hours=h), date(2025, 1, 2) + timedelta(days=d), 100.0 + d + h, 102.0 + d + h, 98.0 + d, 101.0 + d, 1.0) for d in range(15) for h in range(4)]
    b = spark.createDataFrame(rows, BAR)
    last = F.col("session") == F.lit(date(2025, 1, 16))
    c = b.withColumns({k: F.when(last, F.col(k) * 3).otherwise(F.col(k)) for k in ("open", "high", "low", "close")})
    rules = breakout.Rules(channel_bars=4, atr_sessions=3, atr_length=5)
    cols = ("ts", "range_high", "range_low", "atr_stop", "atr_session")
    a1, a2 = (breakout.prepare(x, rules).filter(~last).select(*cols).orderBy("ts").collect() for x in (b, c))
    assert a1 == a2


def test_summer_time_and_midnight(spark):
    rows = [("X", datetime(2024, 7, 1, 21, 30)), ("X", datetime(2024, 1, 2, 4, 0)), ("X", datetime(2024, 1, 2, 22, 30))]
    df = bars.to_zone(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz"), "UTC", "America/New_York")
    got = [(r["ts"], str(r["session"])) for r in bars.tag_sessions(df).collect()]
    assert got == [(datetime(2024, 7, 1, 17, 30), "2024-07-02"), (datetime(2024, 1, 1, 23, 0), "2024-01-02"), (datetime(2024, 1, 2, 17, 30), "2024-01-03")]
    tags = bars.tag_buckets(df).collect()
    assert [r["bucket"] for r in tags] == ["pre_target_1"]


def test_null_bands_let_nothing_pass(spark):
    row = spark.createDataFrame([(100.0, None, 110.0, 90.0, 80.0)], "close double, " + ", ".join(f"{c} double" for c in breakout.GATE))
    up, down = breakout.band_gate(F.col("close"))
    assert row.select(up, down).first() == (False, False)


def test_stream_equals_table(spark, tmp_path):
    from tidebars.streaming.bars import stream_bars

    t0 = datetime(2025, 1, 1)
    ticks = spark.createDataFrame([("X", t0 + timedelta(minutes=7 * i), float(i), 1.0, i) for i in range(100)], "symbol string, ts timestamp, price double, volume double, seq long")
    ticks.write.parquet(str(tmp_path / "in"))
    stream = stream_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bars_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: r["ts"]
    assert sorted(spark.table("bars_out").collect(), key=key) == sorted(bars.resample(ticks, "30 minutes").collect(), key=key)


def test_bands_are_null_until_there_is_history(spark):
    rows = [("X", date(2025, 1, 1) + timedelta(days=i), 0.1, 100.0, 101.0, *[102.0] * 4, *[99.0] * 4) for i in range(4)]
    df = spark.createDataFrame(rows, "symbol string, session date, sigma double, o_ref double, c_target_2 double, " + ", ".join(f"{x}_{b} double" for x in "hl" for b in bars.NAMES))
    got = [r["band_ae_pos_center"] for r in bands.with_bands(df, 2).orderBy("session").collect()]
    assert got[:2] == [None, None] and got[2] is not None
