"""A replayed stream of bars gives the trades of the table."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidebars.operators import breakout, trades
from tidebars.operators.bars import tag_buckets, tag_sessions, whole_sessions
from tidebars.operators.breakout import Rules
from tidebars.streaming.trades import PROVIDER, SessionTrades, stream_trades


def walk(seed, days):
    r = random.Random(seed)
    price, out = 100.0, []
    start = datetime.datetime(2024, 1, 1, 18)
    for k in range(48 * days):
        ts = start + datetime.timedelta(minutes=30 * k)
        if ts.hour == 17 or r.random() < 0.07:  # bars that nobody traded in
            continue
        o = price + r.uniform(-0.3, 0.3)
        price = o + r.gauss(0, 0.8)
        out.append((ts, o, max(o, price) + abs(r.gauss(0, 0.4)), min(o, price) - abs(r.gauss(0, 0.4)), price))
    return [x for x in out if not (x[0].date() == datetime.date(2024, 1, 4) and x[0].hour < 8)]  # a session without a bucket


RULES = Rules(kind="channel", channel_bars=6, break_even=True, reward=1.5)


@pytest.mark.parametrize("batches", [1, 7])
def test_replayed_stream_equals_the_table(spark, tmp_path, batches):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = [(s, *b, 1.0) for s, seed in (("x", 1), ("y", 2)) for b in walk(seed, 14)]
    bars = tag_buckets(tag_sessions(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")))
    table = whole_sessions(bars)
    taken = breakout.first_of_session(breakout.signals(breakout.prepare(table, RULES), RULES))
    want = {tuple(r) for r in trades.exits(trades.entries(taken), table).select("symbol", F.col("session").cast("string"), "ts", "side", "entry_ts", "exit_ts", "reason", F.round("exit_level", 9)).collect()}
    path, end = str(tmp_path / "in"), datetime.datetime(2024, 3, 1)
    first = datetime.datetime(2024, 1, 1)
    step = (datetime.datetime(2024, 1, 16) - first) / batches
    for k in range(batches):
        low, high = first + k * step, first + (k + 1) * step
        bars.filter((F.col("ts") >= F.lit(low).cast("timestamp_ntz")) & (F.col("ts") < F.lit(high).cast("timestamp_ntz"))).coalesce(1).write.mode("append").parquet(path)
    # a bar long after moves the watermark over all ends
    late = spark.createDataFrame([("z", end, 1.0, 1.0, 1.0, 1.0, 1.0)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    tag_buckets(tag_sessions(late)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = stream_trades(stream.filter("symbol IS NOT NULL"), RULES)
    query = out.writeStream.format("memory").queryName(f"trades_{batches}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = {tuple(r) for r in spark.table(f"trades_{batches}").select("symbol", F.col("session").cast("string"), F.col("ts").cast("timestamp_ntz"), "side", F.col("entry_ts").cast("timestamp_ntz"), F.col("exit_ts").cast("timestamp_ntz"), "reason", F.round("exit_level", 9)).collect()}
    assert got == want and len(want) > 12
    assert len({x[6] for x in want}) >= 2


def test_rules_that_need_more_state_are_refused():
    with pytest.raises(ValueError):
        SessionTrades(Rules(kind="opening_range"), ["symbol"])
