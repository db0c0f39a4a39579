"""Walk-forward folds, parameter grids and the choice of parameters, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.functions.rolling import over


def session_folds(sessions: DataFrame, train: int, test: int, step: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, fold, role, session): ``train`` sessions, then ``test``, moving on by ``step``; whole folds only."""
    w = over(keys, "session") if keys else Window.orderBy("session")
    whole = Window.partitionBy(*keys)
    dense = sessions.select(*keys, "session").distinct().withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(whole))
    # the folds that a session is in, by arithmetic
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - (train + test - 1)) / step)).cast("int")
    high = F.least(F.floor(F.col("i") / step), F.floor((F.col("n") - (train + test)) / step)).cast("int")
    near = dense.withColumn("fold", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    at = F.col("i") - F.col("fold") * step
    role = F.when((at >= 0) & (at < train), "train").when((at >= train) & (at < train + test), "test")
    return near.select(*keys, "fold", role.alias("role"), "session").filter("role IS NOT NULL")


def role_folds(sessions: DataFrame, roles: Sequence[tuple[str, int]], step: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, fold, role, session): roles of so many sessions one after another, moving on by ``step``; whole folds only."""
    total = sum(n for _, n in roles)
    spans = session_folds(sessions, total, 0, step, keys)
    at = F.row_number().over(over([*keys, "fold"], "session")) - 1
    role, start = F.lit(None).cast("string"), 0
    for name, n in roles:
        role = F.when(at >= start, name).otherwise(role)
        start += n
    return spans.select(*keys, "fold", role.alias("role"), "session")


def month_folds(sessions: DataFrame, roles: Sequence[tuple[str, int]], step: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(keys, fold, role, session): roles of so many months one after another, moving on by ``step`` months.

    Folds start at the first session; the last one must be over by the last session, and all its roles must hold sessions.
    """
    days = sessions.select(*keys, "session").distinct()
    total = sum(n for _, n in roles)
    ends = days.groupBy(*keys).agg(F.min("session").alias("_a"), F.max("session").alias("_z"))
    count = F.floor((F.months_between(F.date_add("_z", 1), "_a") - total) / step)
    starts = ends.filter(count >= 0).select(*keys, F.explode(F.sequence(F.lit(0), count.cast("int"))).alias("_k"), "_a")
    spans, at = [], 0
    for name, n in roles:
        spans.append(F.struct(F.lit(name).alias("role"), F.add_months("_a", F.col("_k") * step + at).alias("_from"), F.add_months("_a", F.col("_k") * step + at + n).alias("_to")))
        at += n
    ranges = starts.select(*keys, "_k", F.inline(F.array(*spans)))
    found = days.join(ranges, list(keys)).filter((F.col("session") >= F.col("_from")) & (F.col("session") < F.col("_to")))
    whole = found.groupBy(*keys, "_k").agg(F.countDistinct("role").alias("_r")).filter(F.col("_r") == len(roles)).drop("_r")
    numbered = whole.withColumn("fold", F.row_number().over(over(keys, "_k")) - 1)
    return found.join(numbered, [*keys, "_k"]).select(*keys, "fold", "role", "session")


def with_blocks(folds: DataFrame, role: str, months: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The sessions of a role with ``block``: whole spans of so many months from the fold's first session on."""
    own = folds.filter(F.col("role") == role)
    first = F.min("session").over(Window.partitionBy(*keys, "fold"))
    return own.withColumn("block", F.floor(F.months_between("session", first) / months).cast("int"))


def lookback_window(folds: DataFrame, sessions: DataFrame, months: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(keys, fold, session): the sessions of the months before each fold's test part, none before the first session there is."""
    starts = folds.filter("role = 'test'").groupBy(*keys, "fold").agg(F.min("session").alias("_t"))
    return sessions.select(*keys, "session").distinct().join(starts, list(keys)).filter((F.col("session") < F.col("_t")) & (F.col("session") >= F.add_months("_t", -months))).drop("_t")


def overlapping(folds: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Sessions that stand in the test part of more than one fold."""
    return folds.filter("role = 'test'").groupBy(*keys, "session").agg(F.count("*").alias("folds")).filter("folds > 1")


def grid(spark: SparkSession, values: dict[str, Sequence], most: int = 500_000) -> DataFrame:
    """Every combination of the given parameter values, with an id of its content; refused beyond ``most``."""
    n = 1
    for v in values.values():
        n *= len(v)
    if n > most:
        raise ValueError(f"{n} parameter sets; at most {most} are allowed")
    out = spark.range(1).select()
    for name, v in values.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, v))).alias(name))
    return identified(out, list(values))


class Space:
    """A stepped search space whose points are numbers: a digit an axis, worked out where it is used, so no list of points is kept anywhere.

    ``axes``: name to {type: int or float, low, high, step} or {type: categorical, choices}.
    """

    def __init__(self, axes: dict[str, dict]):
        for name, x in axes.items():
            if x["type"] == "categorical":
                if not x.get("choices"):
                    raise ValueError(f"{name} has no choices")
            elif x["type"] not in ("int", "float"):
                raise ValueError(f"{name} has an unknown type")
            elif not (x["low"] <= x["high"] and x["step"] > 0) or (x["type"] == "int" and any(type(x[k]) is not int for k in ("low", "high", "step"))):
                raise ValueError(f"{name} has wrong bounds")
        self.axes = axes
        self.sizes = [len(x["choices"]) if x["type"] == "categorical" else int((x["high"] - x["low"]) / x["step"] + 1e-9) + 1 for x in axes.values()]
        self.radix, self.size = [], 1
        for n in self.sizes:
            self.radix.append(self.size)
            self.size *= n

    def digit(self, k: int, point: Column) -> Column:
        return F.pmod(F.floor(point / self.radix[k]), F.lit(self.sizes[k]))

    def with_values(self, df: DataFrame, point: str = "point") -> DataFrame:
        """``df`` with a column for each axis of its points."""
        values = {}
        for k, (name, x) in enumerate(self.axes.items()):
            d = self.digit(k, F.col(point))
            if x["type"] == "categorical":
                values[name] = F.get(F.array(*map(F.lit, x["choices"])), d)
            else:
                values[name] = F.lit(x["low"]) + d * x["step"]
                values[name] = values[name].cast("int") if x["type"] == "int" else F.round(values[name].cast("double"), 9)
        return df.withColumns(values)

    def number(self) -> Column:
        """The number of the point that the axes' columns name."""
        out = F.lit(0).cast("long")
        for k, (name, x) in enumerate(self.axes.items()):
            digit = F.array_position(F.array(*map(F.lit, x["choices"])), F.col(name)) - 1 if x["type"] == "categorical" else F.round((F.col(name) - x["low"]) / x["step"])
            out = out + digit.cast("long") * self.radix[k]
        return out

    def neighbours(self, df: DataFrame, point: str = "point") -> DataFrame:
        """``df`` with the points one step away in one numeric axis (``near``), a row each: a digit more or less, where there is one."""
        moves = []
        for k, x in enumerate(self.axes.values()):
            if x["type"] != "categorical":
                d = self.digit(k, F.col(point))
                moves += [F.when(d > 0, F.col(point) - self.radix[k]), F.when(d < self.sizes[k] - 1, F.col(point) + self.radix[k])]
        return df.withColumn("near", F.explode(F.filter(F.array(*moves), lambda p: p.isNotNull())))

    def trials(self, searches: DataFrame, n: int, seed: int = 1) -> DataFrame:
        """``searches`` (one row each) with ``n`` different points (trial, point) for every one, in the order of a hash.

        A large space is drawn from, four draws a trial, and the first of each point counts; a small one, of up to 16 points a trial, is put in order whole.
        """
        key = F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in searches.columns])
        hashed = lambda k: F.conv(F.substr(F.md5(F.concat_ws("|", key, k.cast("string"))), F.lit(1), F.lit(15)), 16, 10).cast("long")
        if self.size > 16 * n:
            rows = searches.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(4 * n - 1))))
            rows = rows.withColumn("point", hashed(F.col("draw")) % self.size)
            rows = rows.groupBy(*searches.columns, "point").agg(F.min("draw").alias("draw"))
        else:
            rows = searches.withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.size - 1).cast("long"))))
            rows = rows.withColumn("draw", hashed(F.col("point")))
        return rows.withColumn("trial", F.row_number().over(over(searches.columns, "draw", "point"))).filter(F.col("trial") <= n).select(*searches.columns, "trial", "point")


def identified(params: DataFrame, names: Sequence[str]) -> DataFrame:
    return params.withColumn("params_id", F.sha2(F.to_json(F.struct(*sorted(names))), 256))


def without(params: DataFrame, names: Sequence[str]) -> DataFrame:
    """The distinct parameter sets that are left when some parameters do not count."""
    out = params.drop(*names, "params_id").distinct()
    return identified(out, out.columns)


def neighbours(params: DataFrame, ranges: dict[str, tuple[float, float, float]]) -> DataFrame:
    """The sets one step away in one numeric parameter, inside (low, high, step); ``of`` is the set they belong to."""
    others = [c for c in params.columns if c not in ranges and c != "params_id"]
    moves = []
    for name, (low, high, step) in ranges.items():
        for sign in (-1, 1):
            moved = F.col(name) + sign * step
            fields = [(moved if c == name else F.col(c)).cast(dict(params.dtypes)[c]).alias(c) for c in [*others, *ranges]]
            moves.append(F.struct(((moved >= low - 1e-9) & (moved <= high + 1e-9)).alias("_in"), *fields))
    out = params.select(F.col("params_id").alias("of"), F.inline(F.array(*moves))).filter("_in").drop("_in").distinct()
    return identified(out, [*others, *ranges])


def neighbour_scores(near: DataFrame, scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, of, median_score, usable): the median over the rows of ``near`` (by, of, params_id); without a score counts as minus infinity.

    A set is usable if that median is finite, so a few neighbours without a score do not spoil it.
    """
    joined = near.join(scores.select(*by, "params_id", "score"), [*by, "params_id"], "left")
    low = F.lit(float("-inf"))
    middle = F.median(F.coalesce("score", low))
    return joined.groupBy(*by, "of").agg(middle.alias("median_score")).withColumn("usable", F.col("median_score") > low)


def objective(value: Column, lower_is_better: bool = False) -> Column:
    """A metric as a score: missing or not finite is minus infinity, drawdowns count by their size."""
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(ok, -F.abs(value) if lower_is_better else value).otherwise(float("-inf"))


def best(trials: DataFrame, by: Sequence[str], order: str = "trial") -> DataFrame:
    """The trial with the highest score of each group, the first of equals."""
    w = over(by, F.col("score").desc(), order)
    return trials.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top(candidates: DataFrame, k: int, by: Sequence[str], id_col: str = "params_id") -> DataFrame:
    """The k candidates of each group by score, ties by id."""
    w = over(by, F.col("score").desc(), id_col)
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def kept_parameters(folds: DataFrame, by: Sequence[str], limit: float = 0.0) -> DataFrame:
    """(by, fold, params, optimised): a new choice only after a fold whose result fell below ``limit``.

    ``folds``: (by, fold, best, results map<params, result>); the parameters in use are folded over the folds in order.
    """
    rows = folds.withColumn("_pairs", F.map_entries("results"))
    all_ = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("fold", "best", "_pairs"))).alias("_all"))  # one entry a fold

    def step(acc: Column, x: Column) -> Column:
        renew = acc["params"].isNull() | acc["bad"]
        now = F.when(renew, x["best"]).otherwise(acc["params"])
        result = F.get(F.filter(x["_pairs"], lambda p: p["key"] == now), F.lit(0))["value"]
        entry = F.struct(x["fold"].alias("fold"), now.alias("params"), renew.alias("optimised"), result.alias("result"))
        return F.struct(F.concat(acc["out"], F.array(entry)).alias("out"), now.alias("params"), F.coalesce(result < limit, F.lit(True)).alias("bad"))

    fold_type = dict(folds.dtypes)["fold"]
    empty = F.array().cast(f"array<struct<fold:{fold_type},params:string,optimised:boolean,result:double>>")
    start = F.struct(empty.alias("out"), F.lit(None).cast("string").alias("params"), F.lit(False).alias("bad"))
    return all_.select(*by, F.inline(F.aggregate("_all", start, step)["out"]))


def carried_capital(results: DataFrame, cash: float, by: Sequence[str]) -> DataFrame:
    """(by, fold, start_cash, end_cash): fold returns compounded in order."""
    w = over(by, "fold")
    end = cash * F.exp(F.sum(F.ln(F.greatest(1 + F.col("ret"), F.lit(1e-300)))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return results.withColumn("end_cash", end).withColumn("start_cash", F.lag("end_cash", 1, cash).over(w))


def stability(choices: DataFrame, by: Sequence[str], params: Sequence[str]) -> DataFrame:
    """(by, parameter, distinct_values, most_common, share, changes) of the parameters chosen fold after fold."""
    long = choices.select(*by, "fold", *[F.col(p).cast("string").alias(p) for p in params]).unpivot([*by, "fold"], list(params), "parameter", "value")
    changed = long.withColumn("_c", F.coalesce((F.col("value") != F.lag("value").over(over([*by, "parameter"], "fold"))).cast("int"), F.lit(0)))
    counted = changed.groupBy(*by, "parameter", "value").agg(F.count("*").alias("_n"), F.sum("_c").alias("_c"))
    return counted.groupBy(*by, "parameter").agg(
        F.count("value").alias("distinct_values"), F.min_by("value", F.struct(-F.col("_n"), F.col("value"))).alias("most_common"),
        (F.max("_n") / F.sum("_n")).alias("share"), F.sum("_c").alias("changes"),
    )


def finalists(scores: DataFrame, params: DataFrame, steps: dict[str, tuple], by: Sequence[str], shortlist: int = 4) -> DataFrame:
    """(by, params_id, score, rank): the best sets by the median of their own and their neighbours' scores, of those that are best by their own.

    ``scores``: (by, params_id, score, eligible); ``params``: the whole grid; ``steps`` as for ``neighbours``.
    """
    near = neighbours(params, steps).select("of", "params_id").unionByName(params.select(F.col("params_id").alias("of"), "params_id"))
    short = top(scores.filter("eligible"), shortlist, by).select(*by, F.col("params_id").alias("of"))
    found = neighbour_scores(short.join(near, "of"), scores, by).filter("usable")
    return top(found.select(*by, F.col("of").alias("params_id"), F.col("median_score").alias("score")), shortlist, by)
