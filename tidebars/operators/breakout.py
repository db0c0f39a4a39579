"""Indicators and breakout signals on session bars: opening range and price channel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.rolling import full, over, ratio, recurrence
from tidebars.operators.bars import KEYS, in_minutes, minute_of_day

#: The band edges that the gate needs.
GATE = ("band_ae_pos_upper", "band_fe_pos_lower", "band_ae_neg_lower", "band_fe_neg_upper")
SIDE_MODES = {"both": "both", "long": "long", "long_only": "long", "short": "short", "short_only": "short"}


@dataclass(frozen=True)
class Rules:
    """What a strategy trades on; a variant is one with other flags.

    What the signals read may be columns (a table of parameters joined to the bars), and ``channel_bars`` may be
    several lengths, which stand in one pass under each other, told apart by a column of that name.
    """

    kind: str = "channel"  # or opening_range
    range_start: int = 510
    range_end: int = 570
    entry_bars: int = 8
    channel_bars: int | Sequence[int] = 10
    force_exit: int = 990
    atr_sessions: int = 5
    atr_buffer: float = 0.05
    stop: str = "boundary"  # or atr
    atr_length: int = 14
    atr_multiple: float = 2.0
    reward: float = 1.5
    break_even: bool = True
    break_even_at: float = 1.0
    break_even_offset: float = 0.0
    side_mode: str = "both"
    use_bands: bool = False
    use_atr_buffer: bool = False
    use_vwap: bool = False


def opening_range(bars: DataFrame, start: int, end: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, session, range_high, range_low, range_mid, range_end) of the bars in the minutes [start, end)."""
    own = bars.filter(in_minutes(minute_of_day(F.col("ts")), start, end))
    out = own.groupBy(*keys, "session").agg(F.max("high").alias("range_high"), F.min("low").alias("range_low"), F.max("ts").alias("range_end"))
    return out.withColumn("range_mid", (F.col("range_high") + F.col("range_low")) / 2)


def session_ranges(bars: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, session, session_range, atr_session): the mean range of the n sessions before."""
    day = bars.groupBy(*keys, "session").agg((F.max("high") - F.min("low")).alias("session_range"))
    return day.withColumn("atr_session", full(F.avg, F.col("session_range"), over(keys, "session"), n, lag=1))


def with_vwap(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``vwap``: the session's volume-weighted typical price so far, null without volume."""
    w = over([*keys, "session"], "ts").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return bars.withColumn("vwap", ratio(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w)))


def with_true_range(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    prev = F.lag("close").over(over(keys, "ts"))
    return bars.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def with_channel(bars: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The highest high and lowest low of the n bars before."""
    w = over(keys, "ts")
    out = bars.withColumn("range_high", full(F.max, F.col("high"), w, n, lag=1)).withColumn("range_low", full(F.min, F.col("low"), w, n, lag=1))
    return out.withColumn("range_mid", (F.col("range_high") + F.col("range_low")) / 2)


def with_channels(bars: DataFrame, lengths: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """The channels of several lengths: every bar once for each, with ``channel_bars``."""
    w = over(keys, "ts")
    each = []
    for n in sorted(set(lengths)):
        high, low = full(F.max, F.col("high"), w, n, lag=1), full(F.min, F.col("low"), w, n, lag=1)
        bars = bars.withColumns({f"_h{n}": high, f"_l{n}": low})
        each.append(F.struct(F.lit(n).alias("channel_bars"), F.col(f"_h{n}").alias("range_high"), F.col(f"_l{n}").alias("range_low"), ((F.col(f"_h{n}") + F.col(f"_l{n}")) / 2).alias("range_mid")))
    plain = [c for c in bars.columns if not c.startswith(("_h", "_l"))]
    return bars.select(*plain, F.inline(F.array(*each)))


def with_force_exit(bars: DataFrame, minute: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """``force_exit``: the session's last bar at or before the minute of day, else its first bar."""
    w = Window.partitionBy(*keys, "session")
    last = F.max(F.when(minute_of_day(F.col("ts")) <= minute, F.col("ts"))).over(w)
    return bars.withColumn("force_exit", F.coalesce(last, F.min("ts").over(w)))


def prepare(bars: DataFrame, rules: Rules, bands: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bars with all that the signals read, ``entry_allowed``, and the next bar's time, open and session."""
    out = recurrence(with_true_range(with_vwap(bars, keys), keys), "true_range", "rma", keys, "ts", rules.atr_length)
    out = out.withColumn("atr_stop", F.col("rma") * rules.atr_multiple).drop("rma")
    w = over(keys, "ts")
    out = with_force_exit(out.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("ts", "open", "session")}), rules.force_exit, keys)
    out = out.join(session_ranges(bars, rules.atr_sessions, keys), [*keys, "session"], "left")
    if bands is not None:
        out = out.join(bands.select(*keys, "session", *GATE), [*keys, "session"], "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in GATE})
    if rules.kind == "channel":
        out = with_channel(out, rules.channel_bars, keys) if isinstance(rules.channel_bars, int) else with_channels(out, rules.channel_bars, keys)
        return out.withColumn("entry_allowed", F.col("range_high").isNotNull() & F.col("range_low").isNotNull())
    out = out.join(opening_range(bars, rules.range_start, rules.range_end, keys), [*keys, "session"], "left")
    after = F.coalesce(F.col("ts") > F.col("range_end"), F.lit(False))
    index = F.sum(after.cast("int")).over(over([*keys, "session"], "ts").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("entry_allowed", after & (index <= rules.entry_bars))


def band_gate(price: Column) -> tuple[Column, Column]:
    """(long, short): whether the price lies between the adverse and the favourable band; null bands let nothing pass."""
    up = (F.col("band_ae_pos_upper") < price) & (price < F.col("band_fe_pos_lower"))
    down = (F.col("band_fe_neg_upper") < price) & (price < F.col("band_ae_neg_lower"))
    known = F.lit(True)
    for c in GATE:
        known = known & F.col(c).isNotNull()
    return F.coalesce(known & up, F.lit(False)), F.coalesce(known & down, F.lit(False))


def _column(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def signals(prepared: DataFrame, rules: Rules, keys: Sequence[str] = KEYS, variant: Sequence[str] = ()) -> DataFrame:
    """One row a breakout bar (and variant): side, stop, target, break-even levels, force_exit, the next bar's time, open and session.

    Signals on a bar at or after its forced exit, without a known stop, or with no distance to it are none.
    """
    close = F.col("close")
    buffer = F.when(_column(rules.use_atr_buffer), _column(rules.atr_buffer) * F.col("atr_session")).otherwise(0.0)
    free_of_vwap, free_of_bands = ~_column(rules.use_vwap), ~_column(rules.use_bands)
    up, down = band_gate(close)
    long = (close > F.col("range_high") + buffer) & (free_of_vwap | (close > F.col("vwap"))) & (free_of_bands | up)
    short = (close < F.col("range_low") - buffer) & (free_of_vwap | (close < F.col("vwap"))) & (free_of_bands | down)
    mode = rules.side_mode if isinstance(rules.side_mode, Column) else F.lit(SIDE_MODES[rules.side_mode.strip().lower()])
    long, short = (F.coalesce(x & mode.isin("both", s), F.lit(False)) for x, s in ((long, "long"), (short, "short")))
    side = F.when(long, 1).when(short, -1)
    s = F.col("side")
    boundary = F.when(s > 0, F.col("range_low")).otherwise(F.col("range_high"))
    stop = F.when(_column(rules.stop) == "boundary", boundary).otherwise(F.when(s > 0, F.col("low") - F.col("atr_stop")).otherwise(F.col("high") + F.col("atr_stop")))
    risk = F.abs(close - F.col("stop"))
    out = prepared.filter("entry_allowed AND ts < force_exit").withColumn("side", side).filter("side IS NOT NULL")
    out = out.withColumn("stop", stop).withColumn("risk", risk).filter("risk > 0").withColumn("target", close + s * _column(rules.reward) * F.col("risk"))
    even = _column(rules.break_even)
    out = out.withColumn("trigger", F.when(even, close + s * _column(rules.break_even_at) * F.col("risk")))
    out = out.withColumn("moved_stop", F.when(even, close + s * _column(rules.break_even_offset)))
    return out.select(*keys, *variant, "session", "ts", "side", "close", "stop", "target", "trigger", "moved_stop", "force_exit", "next_ts", "next_open", "next_session")


def first_of_session(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The first signal of every session; with variants, their columns belong to the keys."""
    return df.withColumn("_n", F.row_number().over(over([*keys, "session"], "ts"))).filter("_n = 1").drop("_n")


def allowed_times(df: DataFrame, times: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The signals at the given (keys, ts)."""
    return df.join(times.select(*keys, "ts").distinct(), [*keys, "ts"], "left_semi")


def with_features(prepared: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Eight bar features, 0 where they are not known."""
    w = over(keys, "ts")
    close, span = F.col("close"), F.greatest(F.col("high") - F.col("low"), F.lit(1e-9))
    atr = F.nullif(F.col("atr_session"), F.lit(0.0))
    step = close / F.lag("close", 1).over(w) - 1
    from tidebars.functions.rolling import some

    out = prepared.withColumn("_r", step)
    features = {f"return_{k}": ratio(close, F.lag("close", k).over(w)) - 1 for k in (1, 3, 6)}
    features |= {
        "volatility_12": some(F.stddev_samp, F.col("_r"), w, 12, 3),
        "bar_range_atr": ratio(span, atr),
        "body_to_range": ratio(F.abs(close - F.col("open")), span),
        "close_vs_vwap_atr": ratio(close - F.col("vwap"), atr),
        "atr_stop_atr_session": ratio(F.col("atr_stop"), atr),
    }
    return out.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in features.items()}).drop("_r")


FEATURES = ("return_1", "return_3", "return_6", "volatility_12", "bar_range_atr", "body_to_range", "close_vs_vwap_atr", "atr_stop_atr_session")
