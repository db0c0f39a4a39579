"""Scores to probabilities by Platt's logistic fit."""

from __future__ import annotations

import numpy as np


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 60, count: np.ndarray | None = None) -> tuple[float, float]:
    """(slope, offset) that turn scores into probabilities of ``y``, both classes drawn in by one count.

    Newton steps on the scaled scores, halved until they lower the loss, so that classes
    far apart do not make them leap. ``count``: how often each score occurs, once without it. A slope that is not positive gives (1, 0).
    """
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    count = np.ones(len(x)) if count is None else np.asarray(count, dtype=float)
    scale = max(float((count * np.abs(x)).sum() / count.sum()), 1e-9) if len(x) else 1e-9
    z = x / scale
    pos, neg = (count * y).sum(), (count * (1 - y)).sum()
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(a: float, b: float) -> float:
        t = a * z + b
        return float((count * (np.logaddexp(0, t) - goal * t)).sum() + 1e-3 * (a * a + b * b))

    a, b = 1.0, 0.0
    now = loss(a, b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w, off = count * p * (1 - p), count * (p - goal)
        ga, gb = (off * z).sum() + 2e-3 * a, off.sum() + 2e-3 * b
        haa, hab, hbb = (w * z * z).sum() + 2e-3, (w * z).sum(), w.sum() + 2e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = 1.0
        while step > 1e-6 and loss(a - step * da, b - step * db) > now:
            step /= 2
        new = loss(a - step * da, b - step * db)
        if not new < now - 1e-9:
            break
        a, b, now = a - step * da, b - step * db, new
    return (a / scale, b) if a > 0 else (1.0, 0.0)
