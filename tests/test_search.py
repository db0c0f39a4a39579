"""The stepped search space, and bands of many look-backs."""

import itertools
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidebars.operators import bands, folds
from tidebars.operators.bars import NAMES
from tidebars.plans import market

AXES = {"look": {"type": "int", "low": 10, "high": 22, "step": 5}, "atr": {"type": "float", "low": 0.75, "high": 1.3, "step": 0.1}, "even": {"type": "categorical", "choices": [False, True]}, "mode": {"type": "categorical", "choices": ["both", "long", "short"]}}


def test_points_are_the_explicit_grid(spark):
    space = folds.Space(AXES)
    want = set(itertools.product([10, 15, 20], [0.75, 0.85, 0.95, 1.05, 1.15, 1.25], [False, True], ["both", "long", "short"]))
    assert space.size == len(want) == 108
    points = space.with_values(spark.range(space.size).withColumnRenamed("id", "point"))
    got = points.withColumn("back", space.number()).collect()
    assert {(r["look"], r["atr"], r["even"], r["mode"]) for r in got} == want
    assert all(r["point"] == r["back"] for r in got)
    types = dict(points.dtypes)
    assert (types["look"], types["atr"], types["even"]) == ("int", "double", "boolean")


def test_neighbours_are_those_of_the_grid(spark):
    space = folds.Space(AXES)
    points = space.with_values(spark.range(space.size).withColumnRenamed("id", "point"))
    near = space.with_values(space.neighbours(points.select("point")), "near").withColumn("back", space.number())
    plain = folds.neighbours(folds.identified(points.drop("point"), list(AXES)), {"look": (10, 20, 5), "atr": (0.75, 1.25, 0.1)}).drop("params_id")
    value = lambda r: (r["look"], round(r["atr"], 6), r["even"], r["mode"])
    of = {r["params_id"]: value(r) for r in folds.identified(points.drop("point"), list(AXES)).collect()}
    want = {(of[r["of"]], value(r)) for r in plain.collect()}
    number = {r["point"]: value(r) for r in points.collect()}
    rows = near.collect()
    assert {(number[r["point"]], value(r)) for r in rows} == want and len(rows) == len(want)
    assert all(r["near"] == r["back"] for r in rows)


def test_bounds_and_categories_of_a_known_case(spark):
    space = folds.Space({"lookback": {"type": "int", "low": 10, "high": 20, "step": 5}, "atr": {"type": "float", "low": 0.75, "high": 1.25, "step": 0.25}, "even": {"type": "categorical", "choices": [False, True]}})
    one = spark.createDataFrame([(10, 1.0, False)], "lookback int, atr double, even boolean").withColumn("point", space.number()).select("point")
    got = {(r["lookback"], r["atr"], r["even"]) for r in space.with_values(space.neighbours(one), "near").collect()}
    assert got == {(15, 1.0, False), (10, 0.75, False), (10, 1.25, False)}


@pytest.mark.parametrize("axes", [{"a": {"type": "int", "low": 1.5, "high": 3, "step": 1}}, {"a": {"type": "float", "low": 3, "high": 1, "step": 1}}, {"a": {"type": "float", "low": 1, "high": 3, "step": 0}}, {"a": {"type": "categorical", "choices": []}}, {"a": {"type": "other"}}])
def test_wrong_axes_are_refused(axes):
    with pytest.raises(ValueError):
        folds.Space(axes)


def test_trials_are_different_points_for_every_fold(spark):
    assert market.SPACE.size == 419_244
    searches = spark.createDataFrame([("a", k) for k in range(40)] + [("b", 0)], "symbol string, fold int")
    rows = market.SPACE.trials(searches, 64).collect()
    by = {}
    for r in rows:
        by.setdefault((r["symbol"], r["fold"]), {})[r["trial"]] = r["point"]
    assert len(by) == 41 and all(sorted(t) == list(range(1, 65)) and len(set(t.values())) == 64 for t in by.values())
    assert len({p for t in by.values() for p in t.values()}) > 2000 and all(0 <= p < 419_244 for t in by.values() for p in t.values())
    small = folds.Space(AXES).trials(searches.limit(2), 64).collect()
    assert len(small) == 128 and len({(r["symbol"], r["fold"], r["point"]) for r in small}) == 128
    tiny = folds.Space({"a": AXES["look"]}).trials(searches.limit(1), 64).collect()
    assert sorted(r["point"] for r in tiny) == [0, 1, 2]
    assert market.SPACE.trials(searches.limit(0), 64).count() == 0


def sessions(spark, n=60):
    r = random.Random(2)
    rows = []
    for s in ("a", "b"):
        for k in range(n):
            ref = r.uniform(90, 110)
            high, low = ref + r.uniform(0.5, 9), ref - r.uniform(0.5, 9)
            rows.append((s, date(2024, 1, 1) + timedelta(k), ref, r.uniform(low, high), None if k % 17 == 5 else r.uniform(0.01, 0.05), *[high, low] * len(NAMES)))
    names = ", ".join(f"h_{b} double, l_{b} double" for b in NAMES)
    return spark.createDataFrame(rows, f"symbol string, session date, o_ref double, c_target_2 double, sigma double, {names}").repartition(3)


def test_bands_of_many_lookbacks_equal_one_at_a_time(spark):
    df = sessions(spark)
    got = bands.bands_by_lookback(df, [7, 3, 12])
    key = ["symbol", "session"]
    for n in (3, 7, 12):
        want = {tuple(r[c] for c in key): r for r in bands.with_bands(df, n).collect()}
        mine = {tuple(r[c] for c in key): r for r in got.filter(F.col("lookback") == n).collect()}
        assert mine.keys() == want.keys()
        for k, w in want.items():
            for c in w.asDict():
                assert mine[k][c] == (pytest.approx(w[c], rel=1e-9) if isinstance(w[c], float) else w[c]), (n, k, c)
    assert got.filter("band_ae_pos_upper IS NOT NULL").count() > 60


def test_plan_of_lookbacks_does_not_grow(spark):
    df = sessions(spark)
    size = lambda n: bands.bands_by_lookback(df, range(2, 2 + n))._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(2) == size(40)
