"""The protocol over calendar months, held against plain Python on a small history."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidebars.operators import folds, reports, selection
from tidebars.plans import months


@pytest.fixture(scope="module")
def series():
    draw = random.Random(5)
    out = {}
    for symbol in ("a", "b"):
        day = dt.date(2020, 1, 1)
        rets = {}
        for _ in range(60):
            day += dt.timedelta(days=draw.choice((1, 1, 2)))
            rets[day] = draw.choice((0.0, draw.gauss(0, 0.05)))
        out[symbol] = rets
    return out


def test_reversals_equal_plain_sums(spark, series):
    rows = [(s, d, r) for s, x in series.items() for d, r in x.items()]
    params = folds.grid(spark, {"length": (3, 5), "width": (0.0, 1.0)})
    ids = {(r["length"], r["width"]): r["params_id"] for r in params.collect()}
    found = {(r["symbol"], r["session"], r["params_id"]): (r["gain"], r["banded"], r["plain"]) for r in months.reversals(spark.createDataFrame(rows, "symbol string, session date, ret double"), params, (3, 5)).collect()}
    wanted = {}
    for s, x in series.items():
        days = sorted(x)
        for (n, width), pid in ids.items():
            for k in range(n, len(days)):
                before = [x[d] for d in days[k - n : k]]
                move = round(math.fsum(before), 9)
                side = -1 if move > 0 else 1 if move < 0 else 0
                plain = move != 0
                wanted[s, days[k], pid] = (months.SHARE * side * x[days[k]], plain and round(abs(move) - width * statistics.pstdev(before), 9) > 0, plain)
    assert found.keys() == wanted.keys()
    for key, (gain, banded, plain) in wanted.items():
        assert found[key][0] == pytest.approx(gain, abs=1e-12)
        assert found[key][1:] == (banded, plain)
    assert {b for _, b, _ in wanted.values()} == {True, False}


def test_short_and_empty_histories_have_no_positions(spark):
    params = folds.grid(spark, {"length": (3,), "width": (0.5,)})
    schema = "symbol string, session date, ret double, length string"  # a column of a clashing name
    few = spark.createDataFrame([("a", dt.date(2020, 1, k), 0.1, "x") for k in (1, 2, 3)], schema)
    assert months.reversals(few, params, (3,)).count() == 0
    assert months.reversals(few.limit(0), params, (3,)).count() == 0
    gap = spark.createDataFrame([("a", dt.date(2020, 1, k), None if k == 2 else 0.1, "x") for k in range(1, 7)], schema)
    assert [r["session"].day for r in months.reversals(gap, params, (3,)).collect()] == [6]


def test_finalists_are_ranked_by_their_neighbours(spark):
    params = folds.grid(spark, {"n": (1, 2, 3)})
    ids = {r["n"]: r["params_id"] for r in params.collect()}
    own = {1: 9.0, 2: 1.0, 3: 5.0}
    scores = spark.createDataFrame([("a", ids[n], x, True) for n, x in own.items()], "symbol string, params_id string, score double, eligible boolean")
    out = {r["params_id"]: (r["score"], r["rank"]) for r in folds.finalists(scores, params, {"n": (1, 3, 1)}, ["symbol"], 2).collect()}
    assert out == {ids[1]: (5.0, 1), ids[3]: (3.0, 2)}  # medians of (9, 1) and (5, 1)


def test_routes_follow_the_calibration(spark):
    """The set that was better in a regime is used once the regime has stood two sessions."""
    final = spark.createDataFrame([("a", "p", 1), ("a", "q", 2)], "symbol string, params_id string, rank int")
    tags, days = [], []
    for k in range(1, 13):
        regime = "low" if k <= 6 else "high"
        tags.append(("a", "calibration", dt.date(2020, 1, k), regime, "p"))
        for pid, good in (("p", "low"), ("q", "high")):
            days.append(("a", "calibration", pid, dt.date(2020, 1, k), (0.01 if regime == good else -0.01) + 0.001 * (k % 3), True))
    asked = ["low", "high", "high", "high", "unknown", "high"]
    tags += [("a", "test", dt.date(2020, 2, k + 1), r, "p") for k, r in enumerate(asked)]
    out = selection.routes_by_role(
        final,
        spark.createDataFrame(days, "symbol string, role string, params_id string, session date, ret double, traded boolean"),
        spark.createDataFrame(tags, "symbol string, role string, session date, regime string, general string"),
        ["symbol"], 1, 1, 1.0,
    )
    assert [r["candidate"] for r in out.orderBy("session").collect()] == ["p", "p", "q", "q", "p", "p"]
    assert {r["role"] for r in out.collect()} == {"test"}


def test_policies_without_a_finalist_hold_cash(spark):
    rows = [(1, "q", "p"), (2, None, None)]
    decided = spark.createDataFrame(rows, "session int, candidate string, general string").withColumn("accepted", F.lit(True))
    found = {(r["session"], r["policy"]): r["candidate"] for r in reports.two_policies(decided, F.col("accepted"), ["session"]).collect()}
    assert found == {(1, "general"): "p", (1, "regime"): "q", (2, "general"): "cash", (2, "regime"): "cash"}
    refused = reports.two_policies(decided, F.lit(False), ["session"]).filter("session = 1").collect()
    assert {r["candidate"] for r in refused} == {"p"}


def test_six_series_out_of_sample(spark):
    """Each series has every test session once; without bands it trades at least as often, and stress costs more."""
    sf = "/root/testdata/sf0.001"
    rows = months.walk(spark, sf).toPandas()
    assert set(zip(rows["policy"], rows["cost"], strict=True)) == {(p, c) for p in ("general", "regime") for c in ("normal", "stress", "no_bands")}
    assert not rows.duplicated(["symbol", "policy", "cost", "session"]).any()
    wide = rows.pivot_table(index=["symbol", "policy", "session"], columns="cost", values="ret", aggfunc="sum")
    traded = rows.pivot_table(index=["symbol", "policy", "session"], columns="cost", values="traded", aggfunc="max").astype(bool)
    assert (traded["normal"] == traded["stress"]).all()
    assert (traded["no_bands"] | ~traded["normal"]).all() and traded["no_bands"].sum() > traded["normal"].sum() > 0
    assert (wide["normal"] - wide["stress"])[traded["normal"]].round(9).eq(months.COST).all()
    assert (wide["normal"] == wide["no_bands"])[traded["normal"]].all()
    for _, own in rows.sort_values("session").groupby(["symbol", "policy", "cost"]):
        assert own["cash"].iloc[-1] == pytest.approx(100_000 * (1 + own["ret"]).prod())
    tests = months.roles(spark, sf).toPandas()
    first, last = (tests[tests["role"] == "test"].groupby(["symbol", "fold"])["session"].agg(f) for f in ("min", "max"))
    search = tests[tests["role"] == "search"].groupby(["symbol", "fold"])["session"].max()
    assert (search < first).all() and (last.groupby("symbol").shift(1).dropna() < first[last.groupby("symbol").shift(1).notna()]).all()


def test_a_fall_that_both_share_is_not_a_deeper_one(spark):
    """Both lose the same in the end, after gains that differ, so that the falls differ by rounding only."""
    draw = random.Random(3)
    rows = []
    for symbol in range(60):
        for k in range(12):
            general = draw.uniform(0.001, 0.01) if k < 9 else -draw.uniform(0.01, 0.09)
            rows.append((symbol, k, general + (0.003 if k < 9 else 0.0), general))
    both = spark.createDataFrame(rows, "symbol int, session int, router double, general double")
    of = lambda c: both.select("symbol", "session", F.col(c).alias("ret"))
    out = selection.gate(of("router"), of("general"), ["symbol"], 200, 6).collect()
    assert {r["reason"] for r in out} == {"accepted"}
