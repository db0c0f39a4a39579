"""Hidden-state models: by groups, by chunks, written, read and applied."""

import os

import numpy as np
import pandas as pd
import pytest

from tidebars.operators import breakout, hidden, regimes
from tidebars.plans import market

FEATURES = ["a", "b"]


def series(n, seed, moves=0.05):
    r = np.random.default_rng(seed)
    state, out = 0, []
    for _ in range(n):
        state = 1 - state if r.random() < moves else state
        out.append((r.normal([0.0, 2.0][state], 0.7), r.normal([1.0, -1.0][state], 1.2)))
    return np.array(out)


@pytest.fixture(scope="module")
def rows(spark):
    frames = [pd.DataFrame(series(n, k), columns=FEATURES).assign(g=g, ts=np.arange(n), v=1) for k, (g, n) in enumerate({"x": 401, "y": 97, "z": 250, "few": 5}.items())]
    flat = pd.DataFrame({"a": [1.0] * 30, "b": np.arange(30.0), "g": "flat", "ts": np.arange(30), "v": 1})
    return spark.createDataFrame(pd.concat([*frames, flat]).sample(frac=1, random_state=1)).repartition(4)


def as_dict(models):
    return {r["g"]: r for r in models.collect()}


def test_chunks_give_the_models_of_groups(spark, rows, monkeypatch):
    monkeypatch.setattr(hidden, "ROUNDS", 6)
    whole = as_dict(hidden.fit_models(rows, ["g"], FEATURES, states=2))
    parts = as_dict(hidden.fit_long(rows, ["g"], FEATURES, states=2, chunk=37))
    assert whole.keys() == parts.keys() == {"x", "y", "z", "few", "flat"}
    assert whole["few"]["status"] == parts["few"]["status"] == "insufficient_samples" and parts["few"]["start"] is None and parts["few"]["n"] == 5
    for g in ("x", "y", "z", "flat"):
        assert (whole[g]["n"], whole[g]["status"], whole[g]["rounds"]) == (parts[g]["n"], "trained", parts[g]["rounds"])
        for c in ("centre", "spread", "start", "move", "mean", "var", "log_evidence"):
            assert np.allclose(whole[g][c], parts[g][c], rtol=1e-9, atol=1e-9), (g, c)


def test_states_follow_from_written_models(spark, rows, tmp_path):
    """Written by group, read back, and applied by SQL and by chunks: the states of the plain forward pass."""
    models = hidden.fit_models(rows, ["g"], FEATURES, states=2)
    models.write.partitionBy("g").parquet(str(tmp_path / "models"))
    read = spark.read.parquet(str(tmp_path / "models"))
    by = as_dict(read)
    want = {}
    for g, m in by.items():
        own = rows.filter(f"g = '{g}'").toPandas().sort_values("ts")
        if m["status"] == "trained":
            z = (own[FEATURES].to_numpy() - np.array(m["centre"])) / np.array(m["spread"])
            states = regimes.forward(z, *(np.array(m[c]) for c in ("start", "move", "mean", "var")))[0].argmax(1)
        else:
            states = [None] * len(own)
        want |= {(g, t): s for t, s in zip(own["ts"], states, strict=True)}
    for found in (hidden.states_of(rows, read, ["g"], FEATURES), hidden.states_of_long(rows, read, ["g"], FEATURES, chunk=23)):
        assert set(found.columns) == {*rows.columns, "state"}
        assert {(r["g"], r["ts"]): r["state"] for r in found.collect()} == want
    assert {r["state"] for r in hidden.states_of(rows, read, ["g"], FEATURES).collect()} == {0, 1, None}


def test_states_do_not_hang_on_what_comes_later(spark, rows):
    models = hidden.fit_models(rows, ["g"], FEATURES, states=2)
    some = rows.filter("ts < 50")
    later = {(r["g"], r["ts"]): r["state"] for r in hidden.states_of(rows, models, ["g"], FEATURES).filter("ts < 50").collect()}
    assert {(r["g"], r["ts"]): r["state"] for r in hidden.states_of(some, models, ["g"], FEATURES).collect()} == later


def test_models_of_nothing(spark, rows):
    assert hidden.fit_models(rows.limit(0), ["g"], FEATURES, states=2).count() == 0
    assert hidden.fit_long(rows.limit(0), ["g"], FEATURES, states=2).count() == 0
    assert hidden.states_of(rows.limit(0), hidden.fit_models(rows, ["g"], FEATURES, states=2), ["g"], FEATURES).count() == 0


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_filter_in_the_walk_forward_equals_plain_python(spark):
    """Models, states, verdicts and both curves, worked out again from the candidates in loops."""
    keys, feats = market.MODEL_KEYS, list(breakout.FEATURES)
    with market.one_state():
        rows = market.filter_rows(spark, SF).toPandas()
        got = market.filtered_candidates(spark, SF).toPandas()
        curves = {(r["symbol"], r["source"]): r for r in market.walk_with_filter(spark, SF).collect()}
        plain = {r["symbol"]: r for r in market.walk_figures(spark, SF).collect()}
        picks = market.walk_picks(spark, SF).toPandas()
        every = market.length_candidates(spark, SF).toPandas()
    allowed = {}
    for key, own in rows.groupby(keys):
        own = own.sort_values("ts")
        head, test = own[own.part == "head"], own[own.part == "test"]
        verdict, ok, state = None, set(), [None] * len(own)
        if len(head) >= 5 * market.STATES:
            centre, spread = head[feats].to_numpy().mean(0), head[feats].to_numpy().std(0)
            spread[spread == 0] = 1
            model = regimes.fit((head[feats].to_numpy() - centre) / spread, market.STATES, hidden.ROUNDS)[:4]
            state = regimes.forward((own[feats].to_numpy() - centre) / spread, *model)[0].argmax(1)
            own = own.assign(state=state)
            stats = own[own.part == "head"].groupby("state").net_r.agg(["mean", "sum", "count"])
            stats["win"] = own[own.part == "head"].groupby("state").net_r.apply(lambda v: (v > 0).mean())
            ok = {stats.reset_index().sort_values(["mean", "sum", "win", "count", "state"], ascending=False).state.iloc[0]}
            tail = own[own.part == "tail"]
            let = tail[tail.state.isin(ok)]
            verdict = "no_allowed_candidates" if not len(let) else "allow_rate_too_low" if len(let) / len(tail) < 0.05 else "no_improvement" if let.net_r.mean() <= tail.net_r.mean() else "valid"
        for ts, s in zip(test.ts, own[own.part == "test"].state if len(head) >= 5 * market.STATES else [None] * len(test), strict=True):
            allowed[(*key, ts)] = s in ok if verdict == "valid" else True
    assert {(*(r[k] for k in keys), r["ts"]): r["allowed"] for _, r in got.iterrows()} == allowed
    assert 0 < sum(not x for x in allowed.values()) < len(allowed)
    assert {s: (r["trades"], round(r["final_equity"], 6)) for (s, source), r in curves.items() if source == "raw"} == {s: (r["trades"], round(r["final_equity"], 6)) for s, r in plain.items()}
    for symbol, own in picks.merge(every, on=["symbol", "channel_bars", "session"]).groupby("symbol"):
        let = [allowed.get((symbol, f, n, ts), True) for f, n, ts in zip(own.fold, own.channel_bars, own.ts, strict=True)]
        r = curves[symbol, "raw_hmm"]
        assert r["trades"] == sum(let) and r["final_equity"] == pytest.approx(market.CASH * np.prod(1 + market.SHARE * own.net_r[let]))


def test_a_signal_that_is_not_entered_does_not_use_up_the_session(spark):
    """The first signal's next bar is the forced exit in one symbol's rows, so the candidate is a later one elsewhere; live rules take none."""
    with market.one_state():
        first = breakout.first_of_session(market.signals(spark, SF)).select("symbol", "session", "ts")
        live = {(r["symbol"], r["session"]) for r in market.closed(spark, SF).collect()}
        own = market.length_candidates(spark, SF).filter(f"channel_bars = {market.CHANNEL.channel_bars}")
        found = {(r["symbol"], r["session"]): r["ts"] for r in own.collect()}
        started = {(r["symbol"], r["session"]): r["ts"] for r in first.collect()}
    assert live <= set(found) and all(found[k] == started[k] for k in live) and all(found[k] >= started[k] for k in found)
