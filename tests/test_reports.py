"""Report tables on small rows."""

from datetime import date, datetime

import pytest

from tidebars.operators import bands, folds, reports, resampling, trades


def test_union_keeps_the_target(spark):
    kind = "symbol string, ts timestamp_ntz, close double"
    t = [datetime(2025, 1, 1, h) for h in range(3)]
    old, new = spark.createDataFrame([("X", t[0], 1.0), ("X", t[1], 2.0)], kind), spark.createDataFrame([("X", t[1], 9.0), ("X", t[2], 3.0)], kind)
    assert [r["close"] for r in reports.union_keep_last(old, new).orderBy("ts").collect()] == [1.0, 9.0, 3.0]


def test_first_resolvable_candidate(spark):
    t = [datetime(2025, 1, 1, h) for h in range(3)]
    s = spark.createDataFrame([("X", date(2025, 1, 1), x) for x in t], "symbol string, session date, ts timestamp_ntz")
    out = s.filter(f"ts > timestamp_ntz '{t[0]}'").selectExpr("*", "1.5D AS net_r")
    assert [r["ts"] for r in reports.resolved_candidates(s, out).collect()] == [t[1]]


def test_flat_results_and_alignment(spark):
    got = reports.with_flat(spark.createDataFrame([("a", 5, 110.0)], "k string, trades int, final_equity double"), spark.createDataFrame([("a",), ("b",)], "k string"), ["k"], 100.0)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 5, 110.0), ("b", 0, 100.0)]
    a, b = (spark.createDataFrame([("x", date(2025, 1, d)) for d in days], "k string, session date") for days in ((1, 2), (2, 3)))
    assert sorted(r["only_in"] for r in reports.unaligned(a, b, ["k"]).collect()) == ["curve", "reference"]
    assert reports.unaligned(a, a, ["k"]).count() == 0


def test_stitched_and_compared(spark):
    eq = spark.createDataFrame([("v", 0, 110.0), ("v", 1, 90.0)], "variant string, fold int, equity double")
    cash = spark.createDataFrame([("v", 0, 100.0), ("v", 1, 110.0)], "variant string, fold int, start_cash double")
    assert [r["equity"] for r in reports.stitched(eq, cash, 100.0, ["variant"]).orderBy("fold").collect()] == [110.0, 100.0]
    figures = spark.createDataFrame([("s", "base", 1.0), ("s", "other", 3.0)], "strategy string, variant string, ret double")
    got = {r["variant"]: r["ret_difference"] for r in reports.compared(figures, ["strategy"], "base", "ret").collect()}
    assert got == {"base": 0.0, "other": 2.0}


def test_policies_trade_costs_only_when_trading(spark):
    routes = spark.createDataFrame([("X", date(2025, 1, d), "a") for d in (1, 2, 3)], "symbol string, session date, candidate string")
    returns = spark.createDataFrame([("X", date(2025, 1, 1), "a", 0.01), ("X", date(2025, 1, 2), "a", 0.0)], "symbol string, session date, candidate string, ret double")
    rows = reports.policy_capital(reports.policies(routes, returns, "a", ["symbol"], [("stress", 0.001)]), 100.0, ["symbol"])
    got = [r["cash"] for r in rows.filter("policy = 'regime'").orderBy("session").collect()]
    assert got == pytest.approx([100.9, 100.9, 100.9])


def test_trial_rows(spark):
    s = spark.createDataFrame([("v", 0, 1.0), ("v", 1, float("-inf"))], "variant string, fold int, score double")
    skipped = spark.createDataFrame([("v", 2)], "variant string, fold int")
    assert [r["status"] for r in reports.trial_rows(s, ["variant", "fold"], skipped).orderBy("fold").collect()] == ["evaluated", "ineligible", "skipped"]
    assert reports.combinations_per_fold(s, ["variant"]).first()["combinations"] == 1.0


def test_quantile_bands_of_paths_are_near_the_exact_ones(spark):
    """The sketch's ranks are off by a thousandth of the simulations at most."""
    import random

    r = random.Random(4)
    rows = [("a", s, k, r.gauss(0, 5)) for s in range(900) for k in range(6)]
    paths = spark.createDataFrame(rows, "symbol string, sim int, step int, pnl double").repartition(6)
    for accuracy in (50, 1000):
        got = {x["step"]: (x["sims"], x["q"]) for x in resampling.path_bands(paths, ["symbol"], 100.0, (0.05, 0.5, 0.95), accuracy).collect()}
        for step in range(6):
            equity = sorted(100 + sum(p for _, s, k, p in rows[6 * sim : 6 * sim + step + 1]) for sim in range(900))
            sims, found = got[step]
            assert sims == 900
            for share, q in zip((0.05, 0.5, 0.95), found, strict=True):
                rank = sum(x < q - 1e-9 for x in equity)
                assert abs(rank + 1 - share * 900) <= 900 / accuracy + 1


def test_shapes_follow_their_switches(spark):
    names = [f"band_{n}_{s}_{e}" for n in ("ae", "fe") for s in ("neg", "pos") for e in ("lower", "upper", "center")]
    df = spark.createDataFrame([("a", "2024-01-02", *map(float, range(12))), ("a", "2024-01-03", None, *map(float, range(11)))], "symbol string, session string, " + ", ".join(f"{n} double" for n in names))
    of = lambda **k: sorted((r["session"][-1], r["label"], r["kind"], r["low"], r["high"]) for r in bands.band_shapes(df, **k).collect())
    every = of()
    assert len([x for x in every if x[0] == "2"]) == 4 + 12 and ("2", "band_ae_neg", "zone", 0.0, 1.0) in every
    assert len([x for x in every if x[0] == "3"]) == 3 + 11  # a band without an edge has no zone
    assert {x[1].split("_")[1] for x in of(favourable=False)} == {"ae"} and not any("center" in x[1] for x in of(centers=False))
    assert of(adverse=False, favourable=False) == []


def test_a_trade_without_a_distance_to_its_stop_leaves_the_curve_whole(spark):
    bars = spark.createDataFrame([("a", "d", k, 10.0 + k) for k in range(4)], "symbol string, session string, ts int, close double")
    taken = spark.createDataFrame([("a", "d", 1, 1, 3, 11.0, 0.0, None)], "symbol string, session string, side int, entry_ts int, exit_ts int, entry_price double, risk double, net_r double")
    days, curve = trades.replay(bars, taken, taken.select("symbol", "session"), 100.0, ["symbol"])
    assert [r["equity"] for r in curve.orderBy("ts").collect()] == [100.0] * 4 and days.first()["cash_after"] == 100.0


def test_parameter_sets_without_some_parameters(spark):
    found = folds.without(folds.grid(spark, {"a": (1, 2), "b": (False, True), "c": (5,)}), ["b"])
    assert sorted((r["a"], r["c"]) for r in found.collect()) == [(1, 5), (2, 5)] and found.select("params_id").distinct().count() == 2
