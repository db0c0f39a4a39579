"""Bars and session tags of a tick stream, by the same functions as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidebars.operators.bars import KEYS, resample, tag_buckets, tag_sessions, to_zone


def stream_bars(ticks: DataFrame, width: str = "30 minutes", late: str = "10 minutes", keys: Sequence[str] = KEYS) -> DataFrame:
    """Bars of a stream of (keys, ts timestamp, price, volume, seq); a bar leaves once ticks so late can no longer come."""
    return resample(ticks.withWatermark("ts", late), width, keys)


def stream_tagged(ticks: DataFrame, width: str = "30 minutes", late: str = "10 minutes", source: str = "UTC", target: str = "America/New_York", keys: Sequence[str] = KEYS) -> DataFrame:
    """The same with session and bucket; sessions are not checked for gaps, which needs their end."""
    bars = stream_bars(ticks, width, late, keys)
    bars = bars.withColumn("ts", bars["ts"].cast("timestamp_ntz"))
    return tag_buckets(tag_sessions(to_zone(bars, source, target)))
