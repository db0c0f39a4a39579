"""Queries against their SQL on ticks that the given tables hardly have."""

import duckdb
import pytest

import __spark_entry__ as entry

TICKS = "/root/testdata/sf0.01/events.parquet"


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """Ticks of which some cost nothing, at opens, closes and between them."""
    folder = tmp_path_factory.mktemp("zeros")
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 41 = 0 THEN 0.0 ELSE value END AS value) FROM '{TICKS}') TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def quiet(tmp_path_factory):
    """Ticks of which two symbols always cost the same, so that they are never traded."""
    folder = tmp_path_factory.mktemp("quiet")
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_type IN ('click', 'view') THEN 5.0 ELSE value END AS value) FROM '{TICKS}') TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def check(spark, folder, name):
    """The rows as text, in which null, NaN and infinities differ; and the rows themselves."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, folder).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return want


@pytest.mark.parametrize("name", ["volatility", "volatility_today", "session_bands", "one_band_row", "band_overlays", "band_shapes", "appended_bands", "bands_by_lookback"])
def test_prices_of_zero(spark, zeros, name):
    values = {x for r in check(spark, zeros, name) for x in r if isinstance(x, float)}
    assert float("inf") in values or any(x != x for x in values)


@pytest.mark.parametrize("name", ["performance", "walk_forward_figures"])
def test_symbols_without_trades(spark, quiet, name):
    rows = {r[0]: r for r in check(spark, quiet, name)}
    assert [None in rows[x] and rows[x][1] == 0 for x in ("click", "view")] == [True, True]
