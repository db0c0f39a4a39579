"""Ticks to bars, bars to sessions and intraday buckets, sessions to wide rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.sources.tables import require_columns

KEYS = ("symbol",)
#: Bucket, first minute of the day, minute after its end; the first that fits wins, and a range may run past midnight.
BUCKETS = (("target_1", 510, 780), ("target_2", 780, 1020), ("pre_target_2", 180, 510), ("pre_target_1", 1080, 180))
NAMES = tuple(sorted(b[0] for b in BUCKETS))
BAR = ("open", "high", "low", "close", "volume")


def resample(ticks: DataFrame, width: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """OHLCV bars of (keys, ts, price, volume, seq) ticks: left-closed windows named by their start, empty ones absent."""
    order = F.struct("ts", "seq")
    return (
        ticks.groupBy(*keys, F.window("ts", width).alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
        .select(*keys, F.col("w.start").alias("ts"), *BAR)
    )


def wider(bars: DataFrame, width: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bars of a coarser width from finer bars."""
    return (
        bars.groupBy(*keys, F.window("ts", width).alias("w"))
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
        .select(*keys, F.col("w.start").alias("ts"), *BAR)
    )


def to_zone(df: DataFrame, source: str, target: str, col: str = "ts") -> DataFrame:
    """The zone-less time ``col`` of zone ``source`` as zone ``target``'s."""
    return df.withColumn(col, F.convert_timezone(F.lit(source), F.lit(target), F.col(col)))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def tag_sessions(df: DataFrame, end_hour: int = 17) -> DataFrame:
    """``session``: the date, or the next one from ``end_hour`` on."""
    day = F.to_date("ts")
    return df.withColumn("session", F.when(F.hour("ts") >= end_hour, F.date_add(day, 1)).otherwise(day))


def in_minutes(minute: Column, start: int, end: int) -> Column:
    return ((minute >= start) & (minute < end)) if start < end else ((minute >= start) | (minute < end))


def tag_buckets(df: DataFrame, buckets: Sequence[tuple[str, int, int]] = BUCKETS) -> DataFrame:
    """``bucket``: the first whose half-open minutes hold the time; rows in none are dropped."""
    minute, tag = minute_of_day(F.col("ts")), F.lit(None).cast("string")
    for name, start, end in reversed(buckets):
        tag = F.when(in_minutes(minute, start, end), name).otherwise(tag)
    return df.withColumn("bucket", tag).filter("bucket IS NOT NULL")


def whole_sessions(df: DataFrame, keys: Sequence[str] = KEYS, n_buckets: int = len(BUCKETS)) -> DataFrame:
    """Rows of sessions that hold all buckets."""
    held = F.size(F.collect_set("bucket").over(Window.partitionBy(*keys, "session")))  # a handful of names
    return df.withColumn("_held", held).filter(F.col("_held") == n_buckets).drop("_held")


def calendar(spark, first: date, last: date, holidays: Sequence[date] = ()) -> DataFrame:
    """(session): the weekdays of a range but the given holidays."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("session")).filter(F.weekday("session") < 5)
    return days.filter(~F.col("session").isin(list(holidays))) if holidays else days


def valid_sessions(df: DataFrame, days: DataFrame) -> DataFrame:
    """Rows whose session is in the calendar."""
    return df.join(days.select("session"), "session", "left_semi")


def tagged_bars(bars: DataFrame, source: str = "UTC", target: str = "America/New_York", end_hour: int = 17, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bars in the session's zone with session and bucket, whole sessions only."""
    require_columns(bars, [*keys, "ts", *BAR])
    out = tag_buckets(tag_sessions(to_zone(bars, source, target), end_hour))
    return whole_sessions(out, keys).select(*keys, "ts", "session", "bucket", *BAR)


def session_wide(tagged: DataFrame, keys: Sequence[str] = KEYS, names: Sequence[str] = NAMES) -> DataFrame:
    """One row a session: {o,h,l,c}_{bucket} and the reference price o_ref, the first bucket's open."""
    wide = (
        tagged.groupBy(*keys, "session")
        .pivot("bucket", list(names))
        .agg(F.min_by("open", "ts").alias("o"), F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "ts").alias("c"))
    )
    columns = [F.col(f"{b}_{x}").alias(f"{x}_{b}") for b in names for x in "ohlc"]
    return wide.select(*keys, "session", *columns, F.col("pre_target_1_o").alias("o_ref"))


def target_rows(wide: DataFrame, shared: Sequence[str] = ()) -> DataFrame:
    """Two rows a session in one pass: slot 1 as it is, slot 2 with the two buckets before merged into one."""
    base = [c for c in wide.columns if not c.startswith(("o_", "h_", "l_", "c_", "_"))] if not shared else list(shared)

    def slot(n: int, before: dict[str, Column], last: str, target: str) -> Column:
        fields = [F.lit(n).alias("target_slot"), F.col("c_target_2").alias("daily_close"), F.col("o_pre_target_1").alias("o_ref")]
        fields += [x.alias(f"{k}_pre_target_1") for k, x in before.items()]
        fields += [F.col(f"{k}_{last}").alias(f"{k}_pre_target_2") for k in "ohlc"]
        return F.struct(*fields, *[F.col(f"{k}_{target}").alias(f"{k}_target") for k in "ohlc"])

    one = slot(1, {k: F.col(f"{k}_pre_target_1") for k in "ohlc"}, "pre_target_2", "target_1")
    merged = {
        "o": F.col("o_pre_target_1"),
        "h": F.greatest("h_pre_target_1", "h_pre_target_2"),
        "l": F.least("l_pre_target_1", "l_pre_target_2"),
        "c": F.col("c_pre_target_2"),
    }
    return wide.select(*base, F.inline(F.array(one, slot(2, merged, "target_1", "target_2"))))


def sessions_of(df: DataFrame) -> DataFrame:
    return df.select("session").distinct()


def select_session(df: DataFrame, session: date | None = None) -> DataFrame:
    """The rows of one session, by default the last."""
    if session is not None:
        return df.filter(F.col("session") == F.lit(session))
    return df.join(df.agg(F.max("session").alias("session")), "session", "left_semi")


def one_session(df: DataFrame) -> DataFrame:
    """df, or an error if it holds rows of more or fewer than one session."""
    n = df.select("session").distinct().limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if n == 0 else 'more than one'} session")
    return df


def between_dates(df: DataFrame, start: date, end: date | None = None, col: str = "session") -> DataFrame:
    df = df.filter(F.col(col) >= F.lit(start))
    return df if end is None else df.filter(F.col(col) <= F.lit(end))


def in_sessions(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of the given sessions, dates or timestamps."""
    return df.join(sessions.select(F.col("session").cast("date").alias("session")).distinct(), "session", "left_semi")


def spacing(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, minutes, label): the median time between bars, as 5m, 2h or 1d."""
    from tidebars.functions.rolling import over

    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(over(keys, "ts")).cast("timestamp"))) / 60e6
    m = df.select(*keys, gap.alias("gap")).groupBy(*keys).agg(F.median("gap").alias("minutes"))
    whole = F.round("minutes").cast("long")
    label = (
        F.when(whole % 1440 == 0, F.concat((whole / 1440).cast("long").cast("string"), F.lit("d")))
        .when(whole % 60 == 0, F.concat((whole / 60).cast("long").cast("string"), F.lit("h")))
        .otherwise(F.concat(whole.cast("string"), F.lit("m")))
    )
    return m.withColumn("label", label)
