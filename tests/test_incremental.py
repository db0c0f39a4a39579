"""Content trees, and derived tables that build only what changed again."""

import collections
import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebars.plans import market
from tidebars.sources import incremental, tables

BY = ["symbol", "day"]
ROWS = "symbol string, day date, k int, v double"


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def table(spark, rows):
    return spark.createDataFrame([(s, day(d), k, v) for s, d, k, v in rows], ROWS)


def sample(days=20, symbols="ab"):
    r = random.Random(1)
    return [(s, d, k, r.random()) for s in symbols for d in range(days) for k in range(3)]


def parts_of(df):
    return incremental.leaves(df, BY, df.columns)


def running(df):
    """A sum a day and the mean of it and the two before: a window with a look-back of two parts."""
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(-2, 0)
    days = df.groupBy("symbol", "day").agg(F.sum("v").alias("v")).withColumn("mean", F.avg("v").over(w))
    return days.withColumn("held", F.count("*").over(w)).filter("v > 0")


def brought_up(spark, folder, df, stored_by=None):
    asked_for = []

    def build(asked):
        if asked is None:
            return running(df)
        asked_for.extend(tuple(r) for r in asked.collect())
        return running(df.join(asked.filter("read").select(*BY), BY, "left_semi")).join(asked.filter("rebuild").select(*BY), BY, "left_semi")

    done = incremental.refresh(spark, folder, parts_of(df), BY, build, "day", 2, stored_by)
    got = incremental.current(spark, folder, BY)
    rows = lambda x: sorted((r["symbol"], r["day"], round(r["v"], 9), round(r["mean"], 9), r["held"]) for r in x.collect())
    assert rows(got) == rows(running(df))
    return done, {(s, d) for s, d, rebuild, _ in asked_for if rebuild}


@pytest.mark.parametrize("stored_by", [None, ["day"]])
def test_only_changed_parts_and_those_their_windows_reach_are_built_again(spark, tmp_path, stored_by):
    folder, rows = str(tmp_path / "t"), sample()
    assert brought_up(spark, folder, table(spark, rows), stored_by)[0]["whole"]
    assert brought_up(spark, folder, table(spark, rows[::-1]), stored_by)[0]["built"] == 0  # the order of rows does not count
    symbols = "ab" if stored_by else "b"
    rows.append(("b", 20, 0, 0.5))  # one day more
    done, built = brought_up(spark, folder, table(spark, rows), stored_by)
    assert built == {("b", day(20))} and done == {"built": 1, "read": 3, "whole": False}
    k = rows.index(next(x for x in rows if x[:3] == ("b", 7, 1)))
    rows[k] = ("b", 7, 1, 9.0)  # one row of one part
    assert brought_up(spark, folder, table(spark, rows), stored_by)[1] == {(s, day(d)) for s in symbols for d in (7, 8, 9)}
    rows = [x for x in rows if x[:2] != ("b", 12)]  # a part that goes
    done, built = brought_up(spark, folder, table(spark, rows), stored_by)
    assert built == {(s, day(d)) for s in symbols for d in (12, 13, 14)}
    rows = [x if x[:2] != ("a", 3) else (*x[:3], -1.0) for x in rows]  # a part whose rows the table leaves out
    brought_up(spark, folder, table(spark, rows), stored_by)
    rows = [x if x[:2] != ("a", 3) else (*x[:3], 1.0) for x in rows] + [("b", 12, 0, 2.0), ("c", 1, 0, 1.0)]  # both come back, and a new key
    assert {("a", day(3)), ("b", day(12)), ("c", day(1))} <= brought_up(spark, folder, table(spark, rows), stored_by)[1]


def test_tree_finds_changes_from_the_root_down(spark):
    rows = sample(6)
    flat = lambda r: incremental.flat(incremental.tree(parts_of(table(spark, r)), BY), BY)
    before = flat(rows)
    levels = collections.Counter(r["level"] for r in before.collect())
    assert levels == {0: 1, 1: 2, 2: 12}
    assert incremental.changed(before, flat(rows), BY).count() == 0
    later = [*rows[1:], ("b", 9, 0, 1.0)]
    got = {(r["symbol"], r["day"], r["was"] is None) for r in incremental.changed(before, flat(later), BY).collect()}
    assert got == {("a", day(0), False), ("b", day(9), True)}
    twice = flat([*rows, rows[0]])  # a repeated row counts
    assert [(r["symbol"], r["day"]) for r in incremental.changed(before, twice, BY).collect()] == [("a", day(0))]
    nulls = [parts_of(spark.createDataFrame([x], ROWS)).first()["a"] for x in (("a", day(0), None, 1.0), ("a", day(0), 0, 1.0))]
    assert nulls[0] != nulls[1]


def test_an_empty_source_has_a_root(spark, tmp_path):
    folder, rows = str(tmp_path / "t"), sample(2)
    empty = table(spark, rows).limit(0)
    assert incremental.root_of(parts_of(empty), BY) != incremental.root_of(parts_of(table(spark, rows)), BY)
    assert brought_up(spark, folder, table(spark, rows))[0]["whole"]
    assert brought_up(spark, folder, empty)[0]["built"] == 4


def test_only_new_files_are_read(spark, tmp_path):
    path, folder = str(tmp_path / "src"), str(tmp_path / "parts")
    rows = sample(4)
    seen = []

    def read(df):
        seen.append({r[0] for r in df.select("file_path").distinct().collect()})
        return df

    look = lambda again=False: incremental.source_leaves(spark, path, folder, read, BY, ["symbol", "day", "k", "v"], again)
    table(spark, rows[:12]).coalesce(1).write.parquet(path)
    look()
    look()
    table(spark, rows[12:]).coalesce(1).write.mode("append").parquet(path)
    found = look()
    assert len(seen) == 2 and not seen[0] & seen[1]
    assert incremental.root_of(found, BY) == incremental.root_of(parts_of(table(spark, rows)), BY)
    assert incremental.root_of(look(again=True), BY) == incremental.root_of(found, BY) and len(seen) == 3
    table(spark, rows[:5]).coalesce(1).write.mode("overwrite").parquet(path)
    assert incremental.root_of(look(), BY) == incremental.root_of(parts_of(table(spark, rows[:5])), BY)


def test_settings_and_code_name_the_folder(spark, monkeypatch):
    first = incremental.settings_digest("30 minutes")
    assert first == incremental.settings_digest("30 minutes") != incremental.settings_digest("15 minutes")
    monkeypatch.setattr(incremental, "code_version", lambda: "another")
    assert first != incremental.settings_digest("30 minutes")


def test_a_day_of_ticks_is_appended(spark, tmp_path):
    """Bars and bands after an append equal those of one build, and only the day's bars are built again."""
    r = random.Random(3)
    start = datetime.datetime(2024, 1, 1, 18)
    ticks = [(s, start + datetime.timedelta(minutes=20 * k), r.uniform(90, 110), k) for s in ("x", "y") for k in range(72 * 30)]
    df = market.with_session(spark.createDataFrame(ticks, "symbol string, ts timestamp_ntz, price double, seq long"))
    last = df.agg(F.max("session")).first()[0]
    columns = ["symbol", F.unix_micros(F.col("ts").cast("timestamp")), "price", "seq"]
    folder, done = str(tmp_path), []
    for rows in (df.filter(F.col("session") < F.lit(last)), df, df.withColumn("price", F.when(F.col("seq") == 72 * 12, 150.0).otherwise(F.col("price")))):
        done.append((market.refresh_tagged(spark, folder + "/bars", rows, incremental.leaves(rows, market.PARTS, columns)), market.refresh_bands(spark, folder + "/bands", incremental.current(spark, folder + "/bars", market.PARTS))))
        whole = str(tmp_path / f"whole{len(done)}")
        market.refresh_tagged(spark, whole + "/bars", rows, incremental.leaves(rows, market.PARTS, columns))
        market.refresh_bands(spark, whole + "/bands", incremental.current(spark, whole + "/bars", market.PARTS))
        for name in ("bars", "bands"):
            a, b = (incremental.current(spark, f"{f}/{name}", market.PARTS) for f in (folder, whole))
            assert a.count() == b.count() > 0 and a.select(*b.columns).exceptAll(b).isEmpty()
    assert [d[0]["whole"] for d in done] == [True, False, False]
    assert done[1][0]["built"] == 2  # the last day, of both symbols
    assert done[2][0]["built"] == 2 and done[2][1]["built"] == 2 * (1 + market.N_VOL + 2 * market.N_BAND)


def test_a_table_is_published_once(spark, tmp_path):
    path = str(tmp_path / "d" / "t")
    tables.publish(spark.range(3), path)
    tables.publish(spark.range(9), path)  # another application was first
    assert spark.read.parquet(path).count() == 3 and tables.states(spark, str(tmp_path / "d")) == [path]
