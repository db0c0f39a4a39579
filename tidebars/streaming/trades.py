"""Trades from a stream of bars: a stateful operator that closes a session when the watermark passes its end.

The rules look at a whole session (it must hold all buckets, and its forced exit is its last bar up to a minute), so
a key's state is the bars of its open sessions and the highs and lows of the last bars of those
before: bounded by a session and a channel. A timer at each session's end works it off; bars that come in any number of
batches, and in any order the watermark allows, give the trades that the table of all bars gives.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidebars.operators.bars import BUCKETS, KEYS
from tidebars.operators.breakout import Rules

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BARS = "end long, ts long, bucket string, open double, high double, low double, close double"
WINDOW = "at long, high double, low double"
FOUND = ("session", "ts", "side", "stop", "entry_ts", "entry_open", "exit_ts", "exit_level", "reason")
SCHEMA = "session date, ts timestamp, side int, stop double, entry_ts timestamp, entry_open double, exit_ts timestamp, exit_level double, reason string"
DAY = 86_400_000_000


def leaves(bars: list[tuple], side: int, stop: float, target: float, trigger: float | None, moved: float | None, forced: int) -> tuple[int, float, str]:
    """Where a trade that is entered at the first of these bars (ts, open, high, low, close) is left: time, level and reason."""
    at, touched = stop, False
    for ts, o, high, low, _ in bars:
        good, bad = (high, low) if side > 0 else (low, high)
        if ts >= forced:
            return ts, o, "force_exit"
        if side * (o - at) <= 0:
            return ts, o, "stop_loss"
        if side * (o - target) >= 0:
            return ts, target, "take_profit"
        if side * (bad - at) <= 0:
            return ts, at, "stop_loss"
        if side * (good - target) >= 0:
            return ts, target, "take_profit"
        if trigger is not None and not touched and side * (good - trigger) >= 0:
            at, touched = moved, True  # from the next bar on
    return bars[-1][0], bars[-1][4], "final_bar"


def session_trade(bars: list[tuple], window: list[tuple[float, float]], rules: Rules) -> tuple | None:
    """The first signal's trade of a whole session, if it has one and the next bar lets it in; ``window``: (high, low) of the channel's bars before."""
    of_day = lambda ts: ts % DAY // 60_000_000
    forced = max((b[0] for b in bars if of_day(b[0]) <= rules.force_exit), default=bars[0][0])
    recent = list(window)
    for k, (ts, _, high, low, close) in enumerate(bars):
        last = recent[-rules.channel_bars :]
        recent.append((high, low))
        if len(last) < rules.channel_bars or ts >= forced:
            continue
        top, bottom = max(h for h, _ in last), min(x for _, x in last)
        side = 1 if close > top and rules.side_mode != "short" else -1 if close < bottom and rules.side_mode != "long" else 0
        stop = bottom if side > 0 else top
        risk = abs(close - stop)
        if not side or not risk:
            continue
        if k + 1 == len(bars) or bars[k + 1][0] >= forced:
            return None
        even = (close + side * rules.break_even_at * risk, close + side * rules.break_even_offset * risk) if rules.break_even else (None, None)
        out = leaves(bars[k + 1 :], side, stop, close + side * rules.reward * risk, *even, forced)
        return (ts, side, stop, bars[k + 1][0], bars[k + 1][1], *out)
    return None


class SessionTrades(StatefulProcessor):
    def __init__(self, rules: Rules, keys: Sequence[str], buckets: int = len(BUCKETS), end_hour: int = 17) -> None:
        if rules.kind != "channel" or rules.stop != "boundary" or rules.side_mode not in ("both", "long", "short"):
            raise ValueError("only channels with boundary stops, in one of the plain side modes")
        self.rules, self.keys, self.buckets, self.end_hour = rules, list(keys), buckets, end_hour

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars, self.window = handle.getListState("bars", BARS), handle.getListState("window", WINDOW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ends: set[int] = set()
        for pdf in rows:
            end = pd.to_datetime(pdf["session"]).astype("datetime64[us]").astype("int64") + self.end_hour * 3_600_000_000
            ts = pdf["ts"].astype("datetime64[us]").astype("int64")
            self.bars.appendList([(int(e), int(t), *r) for e, t, *r in zip(end, ts, pdf["bucket"], pdf["open"], pdf["high"], pdf["low"], pdf["close"], strict=True)])
            ends |= {int(e) for e in end}
        for e in ends:
            self.handle.registerTimer(e // 1000)
        yield self.found(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = sorted(self.bars.get()) if self.bars.exists() else []
        done, rest = [b for b in held if b[0] <= until], [b for b in held if b[0] > until]
        self.bars.put(rest) if rest else self.bars.clear()
        window = [(h, low) for _, h, low in sorted(self.window.get())] if self.window.exists() else []
        out = []
        for end in sorted({b[0] for b in done}):
            own = [b for b in done if b[0] == end]
            if len({b[2] for b in own}) < self.buckets:
                continue
            bars = [(b[1], *b[3:]) for b in own]
            if (t := session_trade(bars, window, self.rules)) is not None:
                out.append((end - self.end_hour * 3_600_000_000, *t))
            window = [*window, *[(b[2], b[3]) for b in bars]][-self.rules.channel_bars :]
        if window:
            self.window.put([(k, *x) for k, x in enumerate(window)])
        yield self.found(key, out)

    def found(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=FOUND)
        for c in ("ts", "entry_ts", "exit_ts", "session"):
            out[c] = pd.to_datetime(out[c].astype("int64"), unit="us")
        out["session"] = out["session"].dt.date
        for c, v in zip(reversed(self.keys), reversed(key), strict=True):
            out.insert(0, c, v)
        return out

    def close(self) -> None:
        pass


def stream_trades(tagged: DataFrame, rules: Rules, late: str = "10 minutes", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, session, ts, side, stop, entry_ts, entry_open, exit_ts, exit_level, reason) of a stream of tagged bars, as ``trades.exits`` gives them; ``trades.outcomes`` prices them.

    The session's state store must be RocksDB's (``PROVIDER``).
    """
    rows = tagged.select(*keys, F.col("ts").cast("timestamp").alias("ts"), "session", "bucket", "open", "high", "low", "close").withWatermark("ts", late)
    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", " + SCHEMA
    return rows.groupBy(*keys).transformWithStateInPandas(SessionTrades(rules, keys), schema, "Append", "EventTime")
