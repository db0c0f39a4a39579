"""Hidden-state models as tables: fitted by groups or by chunks, written, and applied from what was written.

A model is a row: its keys, how many rows it learned from, ``status``, and arrays with the features' centre
and spread, the first state's and the moves' probabilities, the means and variances by state, the log evidence
and the rounds that it took. ``fit_models`` fits each group in a task of its own. ``fit_long`` fits groups of any length:
the rows are cut into chunks, a chunk's steps multiply up to one small matrix, these are carried from
chunk to chunk forwards and backwards, and with what comes in from both sides every chunk works out its own part of
the sums that an EM round needs. Both give the same models. ``states_of`` and ``states_of_long`` tell the causally
filtered states, the first by SQL functions over the model's arrays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.ordering import placed
from tidebars.operators.regimes import fit
from tidebars.sources.tables import scratch

MODEL = (
    "n long, status string, centre array<double>, spread array<double>, start array<double>, move array<array<double>>, mean array<array<double>>, var array<array<double>>, "
    "log_evidence double, rounds int"
)
ROUNDS = 40
CHUNK = 4096  # rows of a chunk


def _keys_schema(df: DataFrame, by: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in by)


def fit_models(rows: DataFrame, by: Sequence[str], features: Sequence[str], order: str = "ts", states: int = 3, least: int | None = None) -> DataFrame:
    """(by, model): one model a group, each group in one task; groups of under ``least`` rows have status insufficient_samples and no parameters."""
    least = least if least is not None else 5 * states

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        x = pdf[list(features)].to_numpy(float)
        out = {c: [v] for c, v in zip(by, key, strict=True)} | {"n": [len(x)], "status": ["insufficient_samples"]} | {c: [None] for c in ("centre", "spread", "start", "move", "mean", "var", "log_evidence", "rounds")}
        if len(x) >= least:
            centre, spread = x.mean(0), x.std(0)
            spread = np.where(spread > 0, spread, 1)
            start, move, mean, var, evidence, rounds = fit((x - centre) / spread, states, ROUNDS)
            out |= {"status": ["trained"], "centre": [centre], "spread": [spread], "start": [start], "move": [move.tolist()], "mean": [mean.tolist()], "var": [var.tolist()], "log_evidence": [evidence], "rounds": [rounds]}
        return pd.DataFrame(out)

    return rows.select(*by, order, *features).groupBy(*by).applyInPandas(run, f"{_keys_schema(rows, by)}, {MODEL}")


# -- groups of any length: an EM round as a scan over chunks ---------------------------------------


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _densities(chunks: Sequence, model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For chunks of different lengths, padded: features (b, t, f), densities (b, t, k) over their largest, those logarithms, and which rows there are."""
    longest = max(len(c) for c in chunks)
    width = model["mean"].shape[2]
    x, there = np.zeros((len(chunks), longest, width)), np.zeros((len(chunks), longest), bool)
    for b, c in enumerate(chunks):
        x[b, : len(c)], there[b, : len(c)] = np.stack(c), True
    var, mean = model["var"][:, None], model["mean"][:, None]
    log = -0.5 * (np.log(2 * np.pi * var) + (x[:, :, None] - mean) ** 2 / var).sum(3)
    top = log.max(2)
    return x, np.where(there[:, :, None], np.exp(log - top[:, :, None]), 1.0), np.where(there, top, 0.0), there


def _models_of(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    deep = lambda c: np.stack([np.stack(list(map(np.asarray, v))) for v in pdf[c]])
    return {"start": np.stack(pdf["start"].tolist()), "move": deep("move"), "mean": deep("mean"), "var": deep("var")}


def _batched(pdf: pd.DataFrame, most: int = 64) -> Iterator[pd.DataFrame]:
    for at in range(0, len(pdf), most):
        yield pdf.iloc[at : at + most]


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each chunk's steps as one matrix, scaled to a largest entry of 1; the first chunk's begins with the start."""
    for pdf in batches:
        for part in _batched(pdf):
            m = _models_of(part)
            _, dens, _, there = _densities(part["xs"].tolist(), m)
            first = (part["chunk"].to_numpy() == 0)[:, None, None]
            k = dens.shape[2]
            p = np.broadcast_to(np.eye(k), (len(part), k, k)).copy()
            for t in range(dens.shape[1]):
                step = m["move"] * dens[:, t, None, :]
                if t == 0:  # all rows of the first chunk's matrix are the start
                    step = np.where(first, np.broadcast_to((m["start"] * dens[:, 0])[:, None, :], step.shape), step)
                new = p @ step
                if t == 0:
                    new = np.where(first, step, new)
                new /= np.maximum(new.max((1, 2), keepdims=True), 1e-300)
                p = np.where(there[:, t, None, None], new, p)
            yield part.drop(columns=["xs", "start", "move", "mean", "var"]).assign(p=list(p.reshape(len(part), -1)))


def _carry(by: Sequence[str]) -> Callable:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """What comes into each chunk from before, and from after."""
        pdf = pdf.sort_values("chunk")
        k = int(round(len(pdf["p"].iloc[0]) ** 0.5))
        ps = [np.asarray(p).reshape(k, k) for p in pdf["p"]]
        into, back = [np.full(k, 1 / k)], [np.ones(k)]
        for p in ps[:-1]:
            a = into[-1] @ p
            into.append(a / a.sum() if a.sum() > 0 else np.full(k, 1 / k))
        for p in ps[:0:-1]:
            b = p @ back[-1]
            back.append(b / max(b.sum(), 1e-300))
        return pd.DataFrame({**{c: [v] * len(pdf) for c, v in zip(by, key, strict=True)}, "chunk": pdf["chunk"].to_numpy(), "into": into, "back": back[::-1]})

    return run


def _forward(dens: np.ndarray, top: np.ndarray, there: np.ndarray, into: np.ndarray, first: np.ndarray, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Filtered probabilities of each row, and the chunks' log evidence."""
    alpha, evidence, now = np.zeros_like(dens), np.zeros(len(dens)), into
    for t in range(dens.shape[1]):
        before = np.einsum("bj,bjk->bk", now, m["move"])
        if t == 0:
            before = np.where(first[:, None], m["start"], before)
        a = before * dens[:, t]
        s = a.sum(1)
        post = np.where(s[:, None] > 0, a / np.where(s > 0, s, 1)[:, None], 1 / a.shape[1])
        now = np.where(there[:, t, None], post, now)
        alpha[:, t] = now
        evidence += np.where(there[:, t], np.log(np.maximum(s, 1e-300)) + top[:, t], 0)
    return alpha, evidence


def _round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each chunk's part of the sums of a round: of the states, of the features by state and their squares, of the moves, the evidence, and the first row's states."""
    for pdf in batches:
        for part in _batched(pdf):
            m = _models_of(part)
            x, dens, top, there = _densities(part["xs"].tolist(), m)
            first, into = part["chunk"].to_numpy() == 0, np.stack(part["into"].tolist())
            alpha, evidence = _forward(dens, top, there, into, first, m)
            back = np.stack(part["back"].tolist())  # of the chunk's last row
            k = dens.shape[2]
            gamma, moves = np.zeros_like(alpha), np.zeros((len(part), k, k))
            for t in range(dens.shape[1] - 1, -1, -1):
                g = alpha[:, t] * back
                gamma[:, t] = np.where(there[:, t, None], g / np.maximum(g.sum(1), 1e-300)[:, None], 0)
                b = dens[:, t] * back
                joint = (alpha[:, t - 1] if t else into)[:, :, None] * m["move"] * b[:, None, :]
                joint /= np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)
                moves += np.where((there[:, t] & ~(first & (t == 0)))[:, None, None], joint, 0)
                new = np.einsum("bjk,bk->bj", m["move"], b)
                back = np.where(there[:, t, None], new / np.maximum(new.sum(1), 1e-300)[:, None], back)
            sums = [gamma.sum(1), np.einsum("btk,btf->bkf", gamma, x).reshape(len(part), -1), np.einsum("btk,btf->bkf", gamma, x * x).reshape(len(part), -1), moves.reshape(len(part), -1), evidence[:, None], np.where(first[:, None], gamma[:, 0], 0)]
            yield part.drop(columns=["xs", "start", "move", "mean", "var", "into", "back"]).assign(s=list(np.concatenate(sums, axis=1)))


def _renewed(width: int, states: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Models after a round, from their sums."""
        for pdf in batches:
            out = pdf.drop(columns="s").copy()
            rows: dict[str, list] = {c: [] for c in ("start", "move", "mean", "var", "log_evidence", "rounds", "done")}
            for s, floor, last, rounds in zip(pdf["s"], pdf["floor"], pdf["log_evidence"], pdf["rounds"], strict=True):
                s, k, f = np.asarray(s), states, width
                cut = np.cumsum([k, k * f, k * f, k * k, 1])
                total, sx, sxx, moves, evidence, start = np.split(s, cut)
                weight, sx, sxx = total + 1e-9, sx.reshape(k, f), sxx.reshape(k, f)
                mean = sx / weight[:, None]
                var = np.maximum((sxx - 2 * mean * sx + mean**2 * total[:, None]) / weight[:, None], np.asarray(floor))
                moves = moves.reshape(k, k) + 1e-6
                gain = float(evidence[0]) - (-np.inf if pd.isna(last) else last)
                for c, v in zip(rows, (start, (moves / moves.sum(1, keepdims=True)).tolist(), mean.tolist(), var.tolist(), float(evidence[0]), rounds + 1, gain < 1e-6 * abs(evidence[0])), strict=True):
                    rows[c].append(v)
            yield out.assign(**rows)

    return run


def chunked(rows: DataFrame, by: Sequence[str], features: Sequence[str], centres: DataFrame, chunk: int) -> DataFrame:
    """(by, chunk, xs): the standardised features of placed rows (i), so many in a row; ``centres``: (by, centre, spread)."""
    z = F.zip_with(F.zip_with(F.array(*[F.col(c).cast("double") for c in features]), "centre", lambda x, c: x - c), "spread", lambda x, s: x / s)
    own = rows.join(centres.select(*by, "centre", "spread"), list(by)).select(*by, "i", F.expr(f"i DIV {chunk}").alias("chunk"), z.alias("z"))
    packed = own.groupBy(*by, "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "z"))), lambda r: r["z"]).alias("xs"))  # at most ``chunk`` rows
    return packed


def fit_long(rows: DataFrame, by: Sequence[str], features: Sequence[str], order: str = "ts", states: int = 3, least: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """The models of ``fit_models`` for groups of any number of rows: no task holds more of a group than a chunk, or one small matrix a chunk."""
    least, width, by = least if least is not None else 5 * states, len(features), list(by)
    base = _kept(placed(rows.select(*by, order, *features), by, order), "hidden-rows")
    figures = [f(c) for f in (F.avg, F.stddev_pop) for c in features]
    stats = base.groupBy(*by).agg(F.count("*").alias("n"), F.array(*figures[:width]).alias("centre"), F.transform(F.array(*figures[width:]), lambda s: F.when(s > 0, s).otherwise(1.0)).alias("spread"))
    stats = _kept(stats, "hidden-stats")
    large = stats.filter(F.col("n") >= least)
    chunks = _kept(chunked(base, by, features, large, chunk), "hidden-chunks")
    # the first models: the rows in the order of the first feature, in as many equal parts as there are states
    ranked = placed(base.select(*by, "i", *features), by, features[0], "i", name="r").join(large.select(*by, "n", "centre", "spread"), by)
    q, more = F.expr(f"n DIV {states}"), F.col("n") % states
    at = F.when(F.col("r") < more * (q + 1), F.floor(F.col("r") / (q + 1))).otherwise(more + F.floor((F.col("r") - more * (q + 1)) / q)).cast("int")
    zs = [(F.col(c) - F.get("centre", F.lit(k))) / F.get("spread", F.lit(k)) for k, c in enumerate(features)]
    ranked = ranked.select(*by, at.alias("state"), *[z.alias(f"z{k}") for k, z in enumerate(zs)])
    variances = ranked.groupBy(*by).agg(F.transform(F.array(*[F.var_pop(f"z{k}") for k in range(width)]), lambda v: 1e-3 * v + 1e-6).alias("floor"))
    parts = ranked.groupBy(*by, "state").agg(F.array(*[F.avg(f"z{k}") for k in range(width)]).alias("mean"), F.array(*[F.var_pop(f"z{k}") for k in range(width)]).alias("var"))
    parts = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("state", "mean", "var"))).alias("p")).join(variances, by)  # one entry a state
    stay, go = 0.9, 0.1 / max(1, states - 1)
    first_move = np.full((states, states), go) + np.eye(states) * (stay - go)
    first_move /= first_move.sum(1, keepdims=True)
    models = parts.select(
        *by,
        F.array(*[F.lit(1 / states)] * states).alias("start"),
        F.array(*[F.array(*map(F.lit, r)) for r in first_move.tolist()]).alias("move"),
        F.transform("p", lambda x: x["mean"]).alias("mean"),
        F.transform("p", lambda x: F.zip_with(x["var"], "floor", lambda v, f: F.greatest(v, f))).alias("var"),
        "floor",
        F.lit(None).cast("double").alias("log_evidence"),
        F.lit(0).alias("rounds"),
        F.lit(False).alias("done"),
    )
    models, finished = _kept(models, "hidden-models"), None
    keys, own = _keys_schema(rows, by), ["start", "move", "mean", "var"]
    for _ in range(ROUNDS):
        joined = chunks.join(models.select(*by, *own), by)
        products = joined.mapInPandas(_products, f"{keys}, chunk long, p array<double>")
        carried = products.groupBy(*by).applyInPandas(_carry(by), f"{keys}, chunk long, into array<double>, back array<double>")
        size = states * (2 * width + states + 2) + 1
        sums = joined.join(carried, [*by, "chunk"]).mapInPandas(_round, f"{keys}, chunk long, s array<double>").groupBy(*by).agg(F.array(*[F.sum(F.get("s", F.lit(k))) for k in range(size)]).alias("s"))
        models = _kept(models.join(sums, by).select(*models.columns, "s").mapInPandas(_renewed(width, states), models.schema), "hidden-models")
        over = models.filter("done")
        finished = over if finished is None else finished.unionByName(over)
        models = models.filter("NOT done")
        if models.isEmpty():
            break
    found = finished.unionByName(models).drop("done", "floor")
    trained = F.when(F.col("rounds").isNotNull(), "trained").otherwise("insufficient_samples")
    out = stats.join(found, by, "left").withColumn("status", trained)
    known = lambda c: F.when(F.col("rounds").isNotNull(), F.col(c)).alias(c)
    return out.select(*by, "n", "status", known("centre"), known("spread"), *own, "log_evidence", "rounds")


# -- states from written models -------------------------------------------------------------------


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def states_of(rows: DataFrame, models: DataFrame, by: Sequence[str], features: Sequence[str], order: str = "ts") -> DataFrame:
    """``rows`` with the causally filtered ``state``, null where the model has no parameters: SQL functions over the model's arrays, group by group.

    A group's rows are folded in their order, so a group should be one row a session or trade; longer ones go through ``states_of_long``.
    """
    by = list(by)
    row = F.struct(F.col(order), F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.struct(*[c for c in rows.columns if c not in by]).alias("row"))
    held = rows.select(*by, row.alias("r")).groupBy(*by).agg(F.array_sort(F.collect_list("r"), lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)).alias("rs"))
    held = held.join(models.select(*by, "centre", "spread", "start", "move", "mean", "var"), by, "left")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    log = lambda z: F.zip_with("mean", "var", lambda m, v: -0.5 * total(F.zip_with(F.zip_with(z, m, lambda a, b: (a - b) * (a - b)), v, lambda d, s: F.log(2 * np.pi * s) + d / s)))
    z = lambda x: F.zip_with(F.zip_with(x, "centre", lambda a, c: a - c), "spread", lambda a, s: a / s)
    move = lambda post: F.transform("start", lambda _, k: total(F.zip_with(post, "move", lambda p, m: p * F.get(m, k))))

    def step(acc: Column, r: Column) -> Column:
        weighed = let(log(z(r["x"])), lambda d: let(F.array_max(d), lambda top: F.zip_with(acc["before"], d, lambda b, y: b * F.exp(y - top))))
        post = let(weighed, lambda a: let(total(a), lambda s: F.transform(a, lambda y: F.when(s > 0, y / s).otherwise(1.0 / F.size(a)))))
        return let(post, lambda p: F.struct(move(p).alias("before"), F.concat(acc["states"], F.array((F.array_position(p, F.array_max(p)) - 1).cast("int"))).alias("states")))

    begin = F.struct(F.col("start").alias("before"), F.array().cast("array<int>").alias("states"))
    found = F.when(F.col("start").isNotNull(), F.aggregate("rs", begin, step)["states"]).otherwise(F.transform("rs", lambda r: F.lit(None).cast("int")))
    out = held.select(*by, F.inline(F.zip_with("rs", found, lambda r, s: F.struct(r["row"].alias("row"), s.alias("state")))))
    return out.select(*[F.col(c) if c in by else F.col(f"row.`{c}`") for c in rows.columns], "state")


def states_of_long(rows: DataFrame, models: DataFrame, by: Sequence[str], features: Sequence[str], order: str = "ts", chunk: int = CHUNK) -> DataFrame:
    """``states_of`` for groups of any length, by chunks."""
    by = list(by)
    base = _kept(placed(rows, by, order), "hidden-rows")
    own = models.filter("status = 'trained'").select(*by, "start", "move", "mean", "var", "centre", "spread")
    chunks = _kept(chunked(base, by, features, own, chunk), "hidden-chunks")
    joined = chunks.join(own.drop("centre", "spread"), by)
    keys = _keys_schema(rows, by)
    carried = joined.mapInPandas(_products, f"{keys}, chunk long, p array<double>").groupBy(*by).applyInPandas(_carry(by), f"{keys}, chunk long, into array<double>, back array<double>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _batched(pdf):
                m = _models_of(part)
                _, dens, top, there = _densities(part["xs"].tolist(), m)
                alpha, _ = _forward(dens, top, there, np.stack(part["into"].tolist()), part["chunk"].to_numpy() == 0, m)
                b, t = np.nonzero(there)
                yield pd.DataFrame({**{c: part[c].to_numpy()[b] for c in by}, "i": part["chunk"].to_numpy()[b] * chunk + t, "state": alpha[b, t].argmax(1).astype("int32")})

    found = joined.join(carried, [*by, "chunk"]).mapInPandas(run, f"{keys}, i long, state int")
    return base.join(found, [*by, "i"], "left").drop("i")
