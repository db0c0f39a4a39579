"""Sources, sinks and fingerprints, and the registered queries against their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidebars import registry
from tidebars.sources import tables

SF = "/root/testdata/sf0.001"


def test_fingerprint_sees_values_and_schema_but_not_order(spark):
    df = spark.createDataFrame([(1, 101.0), (2, 102.0)], "k int, close double")
    digest = lambda x: tables.fingerprint(x).first()["digest"]
    assert digest(df) == digest(df.orderBy(F.col("k").desc()))
    assert digest(df) != digest(df.withColumn("close", F.col("close") + 1))
    assert digest(df) != digest(df.withColumn("k", F.col("k").cast("long")))
    assert tables.composite_fingerprint([df], {"a": 1}) != tables.composite_fingerprint([df], {"a": 2})


def test_ordered_fingerprint_sees_the_order_and_not_the_partitions(spark):
    df = spark.range(200).selectExpr("id", "id % 7 AS v")
    digest = lambda x, by: tables.fingerprint(x, by).first()["digest"]
    assert digest(df, ["id"]) == digest(df.repartition(5), ["id"])
    assert digest(df, ["id"]) != digest(df.withColumn("id", 199 - F.col("id")).withColumn("v", F.col("id") % 7), ["v", "id"])


def test_records_are_json(spark, tmp_path):
    tables.save_records(spark.createDataFrame([(1, "x")], "k int, v string"), str(tmp_path / "r"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()] == ['{"k":1,"v":"x"}']
    tables.save(spark.range(2), str(tmp_path / "c"), kind="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_save_refuses_and_materialize_rebuilds(spark, tmp_path):
    df = spark.range(3)
    tables.save(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="exists"):
        tables.save(df, str(tmp_path / "t"))
    tables.save(spark.range(5), str(tmp_path / "t"), overwrite=True)
    assert tables.load(spark, str(tmp_path / "t")).count() == 5
    built = []
    plan = lambda: built.append(1) or spark.range(4)
    for digest in ("a", "a", "b"):
        assert tables.materialize(spark, str(tmp_path / "d"), digest, plan).count() == 4
    assert len(built) == 2


def test_append_once(spark):
    old, new = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z"), (2, "z")], "k int, v string")
    assert sorted(tuple(r) for r in tables.append_once(old, new, ["k"]).collect()) == [(1, "x"), (2, "z")]
    assert tables.not_committed(new, old, ["k"]).count() == 2


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["bars_30m", "session_wide", "session_bands", "target_rows", "channel_trades", "range_signals", "performance", "regime_library", "wilder_average_over_gaps", "gated_trades", "walk_forward_figures", "router_gate"])
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = lambda x: sorted(repr([None if v is None else str(v) for v in r]) for r in x)
    mine = rows([tuple(r[c] for c in columns) for r in got.collect()])
    want = rows(duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall())
    assert mine == want
