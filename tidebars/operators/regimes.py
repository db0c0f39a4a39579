"""A hidden-state filter for trade candidates: one small Gaussian model a group, fitted in parallel.

The fit is here, the tables of models and their use are in ``hidden``. All around, the
split, the state statistics, their ranking and the validation, are built-in functions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.rolling import over, ratio


def log_density(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * (np.log(2 * np.pi * var)[None] + (x[:, None] - mean[None]) ** 2 / var[None]).sum(2)


def forward(x: np.ndarray, start: np.ndarray, move: np.ndarray, mean: np.ndarray, var: np.ndarray, prior: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filtered state probabilities of each row given the rows up to it, and the rows' log evidence."""
    dens = log_density(x, mean, var)
    top = dens.max(1, keepdims=True)
    dens = np.exp(dens - top)
    out, evidence = np.empty_like(dens), np.empty(len(x))
    now = start if prior is None else prior @ move
    for t in range(len(x)):
        a = now * dens[t]
        s = a.sum()
        out[t] = a / s if s > 0 else 1.0 / len(a)
        evidence[t] = np.log(max(s, 1e-300)) + top[t, 0]
        now = out[t] @ move
    return out, evidence


def fit(x: np.ndarray, states: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float, int]:
    """Baum and Welch's updates for a diagonal Gaussian model, from quantiles of the first feature on; the log evidence before the last one, and their number."""
    order = np.argsort(x[:, 0], kind="stable")
    part = np.array_split(order, states)
    mean = np.array([x[p].mean(0) for p in part])
    floor = 1e-3 * x.var(0) + 1e-6
    var = np.maximum(np.array([x[p].var(0) for p in part]), floor)
    start, move = np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    move /= move.sum(1, keepdims=True)
    last, took = -np.inf, 0
    for took in range(1, rounds + 1):
        alpha, evidence = forward(x, start, move, mean, var)
        back = np.ones_like(alpha)
        dens = log_density(x, mean, var)
        dens = np.exp(dens - dens.max(1, keepdims=True))
        pairs = np.zeros_like(move)
        for t in range(len(x) - 2, -1, -1):
            b = dens[t + 1] * back[t + 1]
            joint = alpha[t][:, None] * move * b[None]
            pairs += joint / max(joint.sum(), 1e-300)
            back[t] = move @ b
            back[t] /= max(back[t].sum(), 1e-300)
        gamma = alpha * back
        gamma /= gamma.sum(1, keepdims=True)
        weight = gamma.sum(0) + 1e-9
        start, move = gamma[0], (pairs + 1e-6) / (pairs + 1e-6).sum(1, keepdims=True)
        mean = (gamma.T @ x) / weight[:, None]
        var = np.maximum(np.stack([(gamma[:, [k]] * (x - mean[k]) ** 2).sum(0) / weight[k] for k in range(states)]), floor)
        gain, last = evidence.sum() - last, evidence.sum()
        if gain < 1e-6 * abs(last):
            break
    return start, move, mean, var, float(last), took


def fit_and_filter(rows: DataFrame, by: Sequence[str], features: Sequence[str], order: str = "ts", states: int = 3) -> DataFrame:
    """``rows`` (with ``part`` head or not) and their filtered ``state``: fitted on the head, carried on into the rest without it being seen before.

    Groups with fewer head rows than five a state get no state.
    """
    from tidebars.operators import hidden

    return hidden.states_of(rows, hidden.fit_models(rows.filter("part = 'head'"), by, features, order, states), by, features, order)


def state_figures(rows: DataFrame, by: Sequence[str], value: str = "net_r") -> DataFrame:
    v = F.col(value)
    return rows.filter("state IS NOT NULL").groupBy(*by, "state").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.avg(v).alias("expectancy"), F.avg((v > 0).cast("double")).alias("win_rate"))


def tradable_states(stats: DataFrame, by: Sequence[str], k: int, least: int = 1, min_expectancy: float = 0.0) -> DataFrame:
    """The states to trade: the first k that qualify, the best of all, and further ones in rank order until there are k."""
    order = [F.col(c).desc() for c in ("expectancy", "total", "win_rate", "n", "state")]
    ok = (F.col("n") >= least) & (F.col("expectancy") > min_expectancy)
    ranked = stats.withColumn("rank", F.row_number().over(over(by, *order))).withColumn("_q", F.sum(ok.cast("int")).over(over(by, *order).rowsBetween(Window.unboundedPreceding, 0)))
    sure = ranked.withColumn("_sure", (ok & (F.col("_q") <= k)) | (F.col("rank") == 1))
    have = F.sum(F.col("_sure").cast("int")).over(Window.partitionBy(*by))
    spare = F.sum((~F.col("_sure")).cast("int")).over(over(by, "rank").rowsBetween(Window.unboundedPreceding, 0))
    return sure.withColumn("_have", have).withColumn("_spare", spare).filter("_sure OR _spare <= " + str(k) + " - _have").drop("_q", "_sure", "_have", "_spare")


def validate(rows: DataFrame, allowed: DataFrame, by: Sequence[str], least: int = 1, min_rate: float = 0.05, value: str = "net_r") -> DataFrame:
    """(by, n, allowed, allow_rate, baseline, filtered, improvement, status) over the tail rows."""
    tail = rows.filter("part = 'tail'").join(allowed.select(*by, "state", F.lit(True).alias("_ok")), [*by, "state"], "left")
    g = tail.groupBy(*by).agg(F.count("*").alias("n"), F.count("_ok").alias("allowed"), F.avg(value).alias("baseline"), F.avg(F.when(F.col("_ok"), F.col(value))).alias("filtered"))
    g = g.withColumn("allow_rate", ratio(F.col("allowed").cast("double"), F.col("n").cast("double"))).withColumn("improvement", F.col("filtered") - F.col("baseline"))
    status = F.when(F.col("n") < least, "insufficient_validation_samples").when(F.col("allowed") == 0, "no_allowed_candidates").when(F.col("allow_rate") < min_rate, "allow_rate_too_low").when(F.col("improvement") <= 0, "no_improvement").otherwise("valid")
    return g.withColumn("status", status)


def apply_filter(rows: DataFrame, allowed: DataFrame, verdict: DataFrame, by: Sequence[str], fallback: bool = True) -> DataFrame:
    """``rows`` with ``allowed``: by state where the filter proved itself, else all or none."""
    out = rows.join(allowed.select(*by, "state", F.lit(True).alias("_ok")), [*by, "state"], "left").join(verdict.select(*by, "status"), list(by), "left")
    return out.withColumn("allowed", F.when(F.col("status") == "valid", F.coalesce("_ok", F.lit(False))).otherwise(F.lit(fallback))).drop("_ok")
