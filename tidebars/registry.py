"""Queries over the given tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.operators import bands, bars, breakout, folds, metrics, reports, selection, trades
from tidebars.plans import market as m
from tidebars.plans import months

DIGITS = 6


class Query(NamedTuple):
    plan: Callable[..., DataFrame]
    exact: Sequence[str]  # columns that are returned as they are
    rounded: Sequence[str] = ()  # doubles, returned with DIGITS decimals
    source: str | None = None  # the SQL relation with the same columns
    digits: int = DIGITS
    more: str = ""  # relations after the chain's that the source needs


BANDS = tuple(f"band_{n}_{s}_{e}" for n in ("ae", "fe") for s in ("pos", "neg") for e in ("center", "upper", "lower"))
WIDE = tuple(f"{x}_{b}" for b in bars.NAMES for x in "ohlc")
OHLCV = ("open", "high", "low", "close", "volume")
TARGET = tuple(f"{x}_{b}" for b in ("pre_target_1", "pre_target_2", "target") for x in "ohlc")

_HIT = """CASE WHEN bar_ts >= force_exit THEN 'force_exit' WHEN o <= st THEN 'stop_open' WHEN o >= tg THEN 'take_profit'
  WHEN lo <= st THEN 'stop_loss' WHEN hi >= tg THEN 'take_profit' END"""


def _sigma_terms(n: int) -> str:
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    w = f"OVER (PARTITION BY symbol ORDER BY session ROWS {n - 1} PRECEDING)"
    return f"""CASE WHEN count(ron) {w} = {n} AND count(roc) {w} = {n} AND count(rs) {w} = {n} THEN
      sqrt(var_samp(ron) {w} + {k} * var_samp(roc) {w} + {1 - k} * avg(rs) {w}) END"""


def _lagged(x: str, n: int, agg: str = "avg", order: str = "session") -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END"


_PIVOT = ", ".join(
    f"first(open ORDER BY ts) FILTER (bucket = '{b}') AS o_{b}, max(high) FILTER (bucket = '{b}') AS h_{b}, min(low) FILTER (bucket = '{b}') AS l_{b}, last(close ORDER BY ts) FILTER (bucket = '{b}') AS c_{b}"
    for b in bars.NAMES
)
_HIGH, _LOW = (", ".join(f"{x}_{b}" for b in bars.NAMES) for x in "hl")
_EDGES = ", ".join(
    f"o_ref {'+' if s == 'pos' else '-'} mu_{n} {dict(center='', upper='+ delta', lower='- delta')[e]} AS band_{n}_{s}_{e}" for n in ("ae", "fe") for s in ("pos", "neg") for e in ("center", "upper", "lower")
)


def _slot(n: int) -> str:
    if n == 1:
        parts = [f"{x}_pre_target_1 AS {x}_pre_target_1, {x}_pre_target_2 AS {x}_pre_target_2, {x}_target_1 AS {x}_target" for x in "ohlc"]
    else:
        first = {"o": "o_pre_target_1", "h": "greatest(h_pre_target_1, h_pre_target_2)", "l": "least(l_pre_target_1, l_pre_target_2)", "c": "c_pre_target_2"}
        parts = [f"{first[x]} AS {x}_pre_target_1, {x}_target_1 AS {x}_pre_target_2, {x}_target_2 AS {x}_target" for x in "ohlc"]
    return f"SELECT symbol, session, {n} AS target_slot, c_target_2 AS daily_close, o_pre_target_1 AS o_ref, {', '.join(parts)} FROM wide"


def _channel(name: str, n: int, mode: str = "both", source: str = "tagged", long: str = "close > rh", short: str = "close < rl", reward: float = 1.5) -> str:
    """From bars to priced trades of a channel of n bars, as a chain of relations that end in ``name``."""
    short = "FALSE" if mode == "long" else short
    return f"""
{name}_p AS (
  SELECT *, {_lagged('high', n, 'max', 'ts')} AS rh, {_lagged('low', n, 'min', 'ts')} AS rl,
    coalesce(max(ts) FILTER (hour(ts) * 60 + minute(ts) <= 990) OVER (PARTITION BY symbol, session), min(ts) OVER (PARTITION BY symbol, session)) AS force_exit,
    lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS entry_ts, lead(open) OVER (PARTITION BY symbol ORDER BY ts) AS entry_open, lead(session) OVER (PARTITION BY symbol ORDER BY ts) AS nxt
  FROM {source}
), {name}_g AS (
  SELECT *, CASE WHEN side > 0 THEN rl ELSE rh END AS stop, abs(close - CASE WHEN side > 0 THEN rl ELSE rh END) AS risk0 FROM (
    SELECT *, CASE WHEN {long} THEN 1 WHEN {short} THEN -1 END AS side FROM {name}_p WHERE ts < force_exit AND rh IS NOT NULL AND rl IS NOT NULL
  ) WHERE side IS NOT NULL
), {name}_s AS (
  SELECT symbol, session, ts, side, close, stop, close + side * {reward} * risk0 AS target, close + side * risk0 AS trig, close AS moved_stop, force_exit, entry_ts, entry_open, nxt
  FROM {name}_g WHERE risk0 > 0
), {name}_e AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY ts) AS rn FROM {name}_s) WHERE rn = 1 AND nxt = session AND entry_ts < force_exit
), {name}_b AS (
  SELECT e.*, b.ts AS bar_ts, b.close AS bar_close, side * b.open AS o, CASE WHEN side > 0 THEN b.high ELSE -b.low END AS hi, CASE WHEN side > 0 THEN b.low ELSE -b.high END AS lo
  FROM {name}_e e JOIN tagged b ON b.symbol = e.symbol AND b.session = e.session AND b.ts >= e.entry_ts
), {name}_m AS (
  SELECT *, side * target AS tg, side * CASE WHEN bar_ts > touched THEN moved_stop ELSE stop END AS st FROM (
    SELECT *, min(bar_ts) FILTER (hi >= side * trig) OVER (PARTITION BY symbol, session, ts) AS touched FROM {name}_b)
), {name}_h AS (
  SELECT *, {_HIT} AS how FROM {name}_m
), {name}_x AS (
  SELECT symbol, session, ts, min(bar_ts) FILTER (how IS NOT NULL) AS exit_ts, arg_min(how, bar_ts) FILTER (how IS NOT NULL) AS how,
    arg_min(side * CASE how WHEN 'force_exit' THEN o WHEN 'stop_open' THEN o WHEN 'stop_loss' THEN st ELSE tg END, bar_ts) FILTER (how IS NOT NULL) AS exit_level,
    max(bar_ts) AS last_ts, arg_max(bar_close, bar_ts) AS last_close
  FROM {name}_h GROUP BY ALL
), {name}_o AS (
  SELECT e.symbol, e.session, e.ts, e.side, e.stop, e.entry_ts, e.entry_open + side * 0.25 AS entry_price, coalesce(x.exit_ts, last_ts) AS exit_ts,
    coalesce(CASE how WHEN 'stop_open' THEN 'stop_loss' ELSE how END, 'final_bar') AS reason, coalesce(exit_level, last_close) - side * 0.25 AS exit_price
  FROM {name}_e e JOIN {name}_x x USING (symbol, session, ts)
), {name} AS (
  SELECT *, side * (exit_price - entry_price) AS gross_points, side * (exit_price - entry_price) - 0.2 AS net_points, abs(entry_price - stop) AS risk,
    side * (exit_price - entry_price) / nullif(abs(entry_price - stop), 0) AS gross_r, (side * (exit_price - entry_price) - 0.2) / nullif(abs(entry_price - stop), 0) AS net_r
  FROM {name}_o
)"""


def _gated(bands: bool, vwap: bool, buffer: bool) -> str:
    """The channel with some of the gates."""
    room = "0.05 * atr_session" if buffer else "0"
    known = " AND ".join(f"{c} IS NOT NULL" for c in breakout.GATE)
    long, short = [f"close > rh + {room}"], [f"close < rl - {room}"]
    if vwap:
        long, short = [*long, "close > vwap"], [*short, "close < vwap"]
    if bands:
        long, short = [*long, known, "band_ae_pos_upper < close AND close < band_fe_pos_lower"], [*short, known, "band_fe_neg_upper < close AND close < band_ae_neg_lower"]
    return _channel(f"g{bands:d}{vwap:d}{buffer:d}", 10, source="gated", long=" AND ".join(long), short=" AND ".join(short)).strip()


_FLAGS = [(a, b, c) for a in (False, True) for b in (False, True) for c in (False, True)]


def _drawn(seed: int, *parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 15))::BIGINT"


def _paths(name: str, rows: str) -> str:
    """Summaries of simulated (symbol, sim, step, pnl) rows."""
    return f"""{name}_e AS (
  SELECT symbol, sim, step, 100000 + sum(pnl) OVER (PARTITION BY symbol, sim ORDER BY step ROWS UNBOUNDED PRECEDING) AS equity FROM ({rows})
), {name} AS (SELECT symbol, '{name}' AS method, sim, (last(equity ORDER BY step) / 100000 - 1) * 100 AS pct FROM {name}_e GROUP BY symbol, sim)"""


CHAIN = (
    f"""
bars30 AS (
  SELECT event_type AS symbol, date_trunc('hour', e.ts) + INTERVAL 30 MINUTE * (minute(e.ts) // 30) AS ts,
    first(value ORDER BY e.ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY e.ts, event_id) AS close, count(*)::DOUBLE AS volume
  FROM events e GROUP BY 1, 2
), local AS (
  SELECT * REPLACE (ts - INTERVAL 5 HOUR AS ts) FROM bars30
), placed AS (
  SELECT *, CAST(CASE WHEN hour(ts) >= 17 THEN ts::DATE + 1 ELSE ts::DATE END AS DATE) AS session,
    CASE WHEN mi >= 510 AND mi < 780 THEN 'target_1' WHEN mi >= 780 AND mi < 1020 THEN 'target_2' WHEN mi >= 180 AND mi < 510 THEN 'pre_target_2' WHEN mi >= 1080 OR mi < 180 THEN 'pre_target_1' END AS bucket
  FROM (SELECT *, hour(ts) * 60 + minute(ts) AS mi FROM local)
), tagged AS (
  SELECT symbol, ts, session, bucket, open, high, low, close, volume FROM placed
  WHERE bucket IS NOT NULL AND (symbol, session) IN (SELECT (symbol, session) FROM placed WHERE bucket IS NOT NULL GROUP BY symbol, session HAVING count(DISTINCT bucket) = 4)
), wide AS (
  SELECT symbol, session, {_PIVOT}, first(open ORDER BY ts) FILTER (bucket = 'pre_target_1') AS o_ref FROM tagged GROUP BY symbol, session
), valid AS (
  SELECT * FROM wide WHERE isodow(session) < 6 AND session BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' AND session NOT IN (DATE '2024-01-01', DATE '2024-01-15')
), slots AS ({_slot(1)} UNION ALL {_slot(2)}
), returns AS (
  SELECT *, ln(o_pre_target_1 / lag(c_target_2) OVER (PARTITION BY symbol ORDER BY session)) AS ron, ln(c_target_2 / o_pre_target_1) AS roc,
    ln(greatest({_HIGH}) / o_pre_target_1) * ln(greatest({_HIGH}) / c_target_2) + ln(least({_LOW}) / o_pre_target_1) * ln(least({_LOW}) / c_target_2) AS rs,
    ln(c_pre_target_2 / o_pre_target_1) AS roct, ln(greatest(h_pre_target_1, h_pre_target_2) / o_pre_target_1) * ln(greatest(h_pre_target_1, h_pre_target_2) / c_pre_target_2)
      + ln(least(l_pre_target_1, l_pre_target_2) / o_pre_target_1) * ln(least(l_pre_target_1, l_pre_target_2) / c_pre_target_2) AS rst
  FROM wide
), today AS (SELECT symbol, session, sqrt(ron * ron + roct * roct + rst) AS sigma_today FROM returns
), vol AS (SELECT *, {_sigma_terms(m.N_VOL)} AS sigma FROM returns
), tau AS (
  SELECT *, abs(ln(c_target_2 / o_ref)) / nullif(sigma, 0) AS z_body, sigma / nullif({_lagged('sigma', m.N_BAND)}, 0) AS z_sigma FROM vol
), dir AS (
  SELECT *, CASE WHEN strong AND c_target_2 > o_ref THEN 'bullish' WHEN strong AND c_target_2 < o_ref THEN 'bearish' ELSE 'neutral' END AS direction FROM (
    SELECT *, CASE WHEN z_sigma IS NOT NULL THEN z_body > least(greatest(0.4 * pow(z_sigma, -0.5), 0.26), 1.75) END AS strong, greatest({_HIGH}) - o_ref AS up, o_ref - least({_LOW}) AS down FROM tau)
), eps AS (
  SELECT *, CASE direction WHEN 'bullish' THEN down WHEN 'bearish' THEN up ELSE greatest(up, down) END / nullif(sigma, 0) AS ae,
    CASE direction WHEN 'bullish' THEN up WHEN 'bearish' THEN down ELSE greatest(up, down) END / nullif(sigma, 0) AS fe FROM dir
), mu AS (
  SELECT *, {_lagged('ae', m.N_BAND)} * lag(sigma) OVER (PARTITION BY symbol ORDER BY session) AS mu_ae, {_lagged('fe', m.N_BAND)} * lag(sigma) OVER (PARTITION BY symbol ORDER BY session) AS mu_fe,
    0.1 * lag(sigma) OVER (PARTITION BY symbol ORDER BY session) * o_ref AS delta FROM eps
), banded AS (SELECT symbol, session, direction, sigma, {_EDGES} FROM mu
), overlays AS (SELECT symbol, session, overlay, level FROM (UNPIVOT banded ON COLUMNS('band_.*') INTO NAME overlay VALUE level)
), opening AS (
  SELECT symbol, session, max(high) AS range_high, min(low) AS range_low, max(ts) AS range_end, (max(high) + min(low)) / 2 AS range_mid
  FROM tagged WHERE hour(ts) * 60 + minute(ts) >= 510 AND hour(ts) * 60 + minute(ts) < 570 GROUP BY symbol, session
), spans AS (
  SELECT *, {_lagged('session_range', 5)} AS atr_session FROM (SELECT symbol, session, max(high) - min(low) AS session_range FROM tagged GROUP BY symbol, session)
), tr AS (
  SELECT *, sum((high + low + close) / 3 * volume) OVER s / nullif(sum(volume) OVER s, 0) AS vwap,
    greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS true_range, row_number() OVER w - 1 AS k
  FROM tagged WINDOW s AS (PARTITION BY symbol, session ORDER BY ts ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY symbol ORDER BY ts)
), rma AS (
  SELECT a.symbol, a.ts, sum(CASE WHEN b.k = 0 THEN 1 ELSE 1 / 14.0 END * pow(13 / 14.0, a.k - b.k) * b.true_range) AS rma
  FROM tr a JOIN tr b ON a.symbol = b.symbol AND b.k <= a.k AND (a.k - b.k < 700) WHERE a.k >= 13 GROUP BY ALL
), rules AS (
  SELECT t.*, rma * 2 AS atr_stop, range_high, range_low, range_end,
    coalesce(max(t.ts) FILTER (hour(t.ts) * 60 + minute(t.ts) <= 990) OVER (PARTITION BY t.symbol, t.session), min(t.ts) OVER (PARTITION BY t.symbol, t.session)) AS force_exit,
    sum((t.ts > range_end)::INT) OVER (PARTITION BY t.symbol, t.session ORDER BY t.ts ROWS UNBOUNDED PRECEDING) AS idx
  FROM tr t LEFT JOIN rma ON rma.symbol = t.symbol AND rma.ts = t.ts LEFT JOIN opening o ON o.symbol = t.symbol AND o.session = t.session
), range_signals AS (
  SELECT symbol, session, ts, side, stop, target FROM (
    SELECT *, close + side * 1.5 * abs(close - stop) AS target FROM (
      SELECT *, CASE WHEN side > 0 THEN low - atr_stop ELSE high + atr_stop END AS stop FROM (
        SELECT *, CASE WHEN close > range_high THEN 1 WHEN close < range_low THEN -1 END AS side FROM rules WHERE ts > range_end AND idx <= 8 AND ts < force_exit) WHERE side IS NOT NULL)
    WHERE abs(close - stop) > 0)
), {_channel("ch", 10).strip()}, channel_signals AS (SELECT symbol, session, ts, side, stop, target, trig AS trigger_level FROM ch_s
), booked AS (
  SELECT *, lag(cash_after, 1, 100000.0) OVER (PARTITION BY symbol ORDER BY exit_ts) AS cash_before FROM (
    SELECT *, 1.0::DOUBLE AS units, 100000 + sum(net_points) OVER (PARTITION BY symbol ORDER BY exit_ts ROWS UNBOUNDED PRECEDING) AS cash_after FROM ch)
), compounded AS (
  SELECT symbol, session, exit_ts, 100000 * exp(sum(ln(1 + 0.01 * net_r)) OVER (PARTITION BY symbol ORDER BY exit_ts ROWS UNBOUNDED PRECEDING)) AS cash_after FROM ch
), curve AS (
  SELECT symbol, ts, session, coalesce(last_value(known IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 100000) AS cash, held AS in_position, floating FROM (
    SELECT b.symbol, b.ts, b.session, coalesce((b.ts >= t.entry_ts AND b.ts < t.exit_ts)::INT, 0) AS held,
      CASE WHEN b.ts >= t.exit_ts THEN cash_after WHEN b.ts >= t.entry_ts THEN cash_before END AS known, CASE WHEN b.ts >= t.entry_ts AND b.ts < t.exit_ts THEN t.side * (b.close - t.entry_price) ELSE 0 END AS floating
    FROM tagged b LEFT JOIN booked t ON t.symbol = b.symbol AND t.session = b.session)
), eq AS (SELECT symbol, ts, session, cash, cash + floating AS equity, in_position FROM curve
), eqr AS (
  SELECT *, equity / lag(equity, 1, 100000.0) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r, equity / greatest(100000, max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM eq
), bar_fig AS (
  SELECT symbol, last(equity ORDER BY ts) AS final_equity, greatest(epoch(max(ts) - min(ts)) / (365.25 * 86400), 1 / 365.25) AS years, count(r) AS n, avg(r) AS mean, stddev_pop(r) AS sd, stddev_pop(r) FILTER (r < 0) AS dn,
    min(dd) * 100 AS max_drawdown_pct, avg(in_position) * 100 AS exposure_pct FROM eqr GROUP BY symbol
), trade_fig AS (
  SELECT symbol, count(*) AS trades, coalesce(sum(net_points) FILTER (net_points > 0), 0) AS gross_profit, coalesce(-sum(net_points) FILTER (net_points < 0), 0) AS gross_loss, avg(net_points) AS expectancy, sum(net_points) AS net_pnl,
    100.0 * count(*) FILTER (net_points > 0) / count(*) AS win_rate_pct FROM ch GROUP BY symbol
), fig AS (
  SELECT symbol, coalesce(trades, 0) AS trades, final_equity, (final_equity / 100000 - 1) * 100 AS total_return_pct, (pow(final_equity / 100000, 1 / years) - 1) * 100 AS cagr_pct,
    mean / nullif(sd, 0) * sqrt(n / years) AS sharpe, mean / nullif(dn, 0) * sqrt(n / years) AS sortino, max_drawdown_pct, exposure_pct, gross_profit, gross_loss, expectancy, net_pnl, win_rate_pct,
    gross_profit / nullif(gross_loss, 0) AS profit_factor FROM bar_fig LEFT JOIN trade_fig USING (symbol)
), year_end AS (
  SELECT symbol, year, end_equity, lag(end_equity, 1, 100000.0) OVER (PARTITION BY symbol ORDER BY year) AS start_equity FROM (SELECT symbol, year(ts) AS year, last(equity ORDER BY ts) AS end_equity FROM eq GROUP BY ALL)
), year_fig AS (
  SELECT y.symbol, y.year::INT AS year, coalesce(t.trades, 0) AS trades, start_equity, end_equity, (end_equity / start_equity - 1) * 100 AS return_pct, d.dd AS max_drawdown_pct, coalesce(t.net_pnl, 0) AS net_pnl
  FROM year_end y JOIN (
    SELECT symbol, year, min(equity / greatest(start_equity, peak) - 1) * 100 AS dd FROM (
      SELECT e.symbol, y.year, e.equity, y.start_equity, max(e.equity) OVER (PARTITION BY e.symbol, y.year ORDER BY e.ts ROWS UNBOUNDED PRECEDING) AS peak FROM eq e JOIN year_end y ON y.symbol = e.symbol AND y.year = year(e.ts)) GROUP BY ALL
  ) d ON d.symbol = y.symbol AND d.year = y.year LEFT JOIN (SELECT symbol, year(exit_ts) AS year, count(*) AS trades, sum(net_points) AS net_pnl FROM ch GROUP BY ALL) t ON t.symbol = y.symbol AND t.year = y.year
), day_ret AS (
  SELECT symbol, session, e / lag(e, 1, 100000.0) OVER (PARTITION BY symbol ORDER BY session) - 1 AS ret FROM (SELECT symbol, session, last(equity ORDER BY ts) AS e FROM eq GROUP BY ALL)
), day_path AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY session ROWS UNBOUNDED PRECEDING)) AS path FROM day_ret
), day_fig AS (
  SELECT symbol, count(*) AS sessions, avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252) AS sharpe, avg(ret) / nullif(sqrt(avg(pow(least(ret, 0), 2))), 0) * sqrt(252) AS sortino, min(path / greatest(1, peak) - 1) AS max_drawdown, last(path ORDER BY session) AS growth
  FROM (SELECT *, max(path) OVER (PARTITION BY symbol ORDER BY session ROWS UNBOUNDED PRECEDING) AS peak FROM day_path) GROUP BY symbol
), hold AS (
  SELECT symbol, entry_price, exit_price, exit_price - entry_price - 0.2 AS net_pnl FROM (
    SELECT symbol, max(open) FILTER (k = 2) + 0.25 AS entry_price, last(close ORDER BY ts) - 0.25 AS exit_price, first(session ORDER BY ts) = max(session) FILTER (k = 2) AS same
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM tagged) GROUP BY symbol) WHERE same
), """
    + ", ".join(f"{_channel(f'sw{n}{mode}', n, mode).strip()}" for n in m.CHANNELS for mode in ("both", "long"))
    + """, swept AS ("""
    + " UNION ALL ".join(f"SELECT symbol, {n} AS channel_bars, '{mode}' AS side_mode, session, net_points, net_r, side, entry_ts, exit_ts, entry_price, risk FROM sw{n}{mode}" for n in m.CHANNELS for mode in ("both", "long"))
    + """), sweep AS (
  SELECT symbol, channel_bars, side_mode, count(*) AS trades, avg(net_points) AS expectancy, sum(net_points) AS net_pnl, 100.0 * count(*) FILTER (net_points > 0) / count(*) AS win_rate_pct FROM swept GROUP BY ALL
), fold_days AS (SELECT symbol, session, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS i FROM (SELECT DISTINCT symbol, session FROM tagged)
), session_folds AS (
  SELECT d.symbol, f.fold::INT AS fold, CASE WHEN i < f.fold * 4 + 8 THEN 'train' ELSE 'test' END AS role, session FROM fold_days d, range(200) f(fold)
  WHERE i >= f.fold * 4 AND i < f.fold * 4 + 12 AND f.fold * 4 + 12 <= (SELECT count(*) FROM fold_days x WHERE x.symbol = d.symbol)
), chosen AS (
  SELECT s.symbol, s.fold, s.role, p.params, coalesce(sum(net_r), 0) AS r FROM session_folds s CROSS JOIN (SELECT unnest([6, 10, 14])::VARCHAR AS params) p
  LEFT JOIN swept w ON w.symbol = s.symbol AND w.session = s.session AND w.side_mode = 'both' AND w.channel_bars::VARCHAR = p.params GROUP BY ALL
), best AS (SELECT symbol, fold, first(params ORDER BY r DESC, params) AS best FROM chosen WHERE role = 'train' GROUP BY ALL
), days AS (
  SELECT o_orderpriority AS symbol, o_orderdate::DATE AS session, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY ALL
), history AS (
  SELECT *, coalesce(least(greatest(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY session)), -1.0), 1.0) / 10, 0.0) AS ret FROM days
), month_folds AS (
  SELECT symbol, (row_number() OVER (PARTITION BY symbol, role, session ORDER BY k) + base - 1)::INT AS fold, role, session FROM (SELECT h.symbol, k, role, session, k AS base FROM (
    SELECT h.symbol, h.session, f.k, r.role, (min(session) OVER (PARTITION BY h.symbol) + INTERVAL 1 MONTH * (f.k * 12 + r.a))::DATE AS fa, (min(session) OVER (PARTITION BY h.symbol) + INTERVAL 1 MONTH * (f.k * 12 + r.z))::DATE AS fz,
      (min(session) OVER (PARTITION BY h.symbol) + INTERVAL 1 MONTH * (f.k * 12 + 30))::DATE AS whole, max(session) OVER (PARTITION BY h.symbol) AS latest
    FROM history h, range(12) f(k), (VALUES ('search', 0, 12), ('calibration', 12, 18), ('gate', 18, 24), ('test', 24, 30)) r(role, a, z)) h WHERE session >= fa AND session < fz AND whole <= latest + 1) QUALIFY TRUE
), vol20 AS (
  SELECT symbol, session, CASE WHEN count(r) OVER w = 20 THEN stddev_pop(r) OVER w END AS volatility FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY session)) AS r FROM history)
  WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
), limits AS (SELECT symbol, quantile_cont(volatility, 1 / 3.0) AS lower, quantile_cont(volatility, 2 / 3.0) AS upper FROM vol20 GROUP BY symbol
), labelled AS (
  SELECT v.symbol, session, volatility, CASE WHEN volatility <= lower THEN 'low' WHEN volatility <= upper THEN 'normal' WHEN volatility > upper THEN 'high' ELSE 'unknown' END AS regime FROM vol20 v JOIN limits USING (symbol)
), cands AS (
  SELECT symbol, session, 'as_is' AS candidate, ret FROM history UNION ALL SELECT symbol, session, 'turned', -ret FROM history UNION ALL SELECT symbol, session, 'no_monday', CASE WHEN isodow(session) = 1 THEN 0 ELSE ret END FROM history
), moments AS (SELECT symbol, candidate, avg(ret) AS gm, avg(ret * ret) AS gq FROM cands GROUP BY ALL
), per AS (
  SELECT c.symbol, c.candidate, regime, count(*) AS sessions, count(*) FILTER (ret <> 0) AS trades, avg(ret) AS rm, avg(ret * ret) AS rq FROM cands c JOIN labelled l ON l.symbol = c.symbol AND l.session = c.session WHERE regime <> 'unknown' GROUP BY ALL
), regime_scores AS (
  SELECT symbol, candidate, regime, sessions, trades, CASE WHEN sessions >= 20 AND trades >= 5 AND v > 0 THEN mm / sqrt(v) * sqrt(252) END AS score FROM (
    SELECT *, greatest(w * rq + (1 - w) * gq - mm * mm, 0) AS v FROM (SELECT *, sessions / (sessions + 10.0) AS w, sessions / (sessions + 10.0) * rm + (1 - sessions / (sessions + 10.0)) * gm AS mm FROM per JOIN moments USING (symbol, candidate)))
), library AS (
  SELECT symbol, regime, coalesce(first(candidate ORDER BY score DESC, candidate) FILTER (score IS NOT NULL), 'as_is') AS candidate FROM regime_scores GROUP BY ALL
), numbered AS (
  SELECT l.symbol, l.session, NULLIF(l.regime, 'unknown') AS regime, coalesce(b.candidate, 'as_is') AS goal, row_number() OVER (PARTITION BY l.symbol ORDER BY l.session) AS k FROM labelled l LEFT JOIN library b ON b.symbol = l.symbol AND b.regime = l.regime
), routes AS (
  SELECT symbol, session, k, CASE WHEN regime IS NULL OR goal = 'as_is' THEN 'as_is' ELSE 'as_is' END AS candidate, CASE WHEN regime IS NOT NULL AND goal <> 'as_is' THEN regime END AS pending, CASE WHEN regime IS NOT NULL AND goal <> 'as_is' THEN 1 ELSE 0 END AS n FROM numbered WHERE k = 1
  UNION ALL
  SELECT symbol, session, k, CASE WHEN regime IS NULL THEN 'as_is' WHEN goal <> active AND c >= 2 THEN goal ELSE active END, CASE WHEN regime IS NULL OR goal = active OR c >= 2 THEN NULL ELSE regime END, CASE WHEN regime IS NULL OR goal = active OR c >= 2 THEN 0 ELSE c END
  FROM (SELECT x.*, r.candidate AS active, CASE WHEN r.pending = x.regime THEN r.n + 1 ELSE 1 END AS c FROM routes r JOIN numbered x ON x.symbol = r.symbol AND x.k = r.k + 1)
), blocks AS (
  SELECT symbol || '|' || candidate AS key, year(session) - 1995 AS block, avg(ret) AS mean, stddev_pop(ret) AS sd, count(*) FILTER (ret <> 0) AS t FROM cands GROUP BY ALL
), cand_path AS (
  SELECT key, min(path / greatest(1, peak) - 1) AS dd FROM (SELECT key, path, max(path) OVER (PARTITION BY key ORDER BY session ROWS UNBOUNDED PRECEDING) AS peak FROM (
    SELECT symbol || '|' || candidate AS key, session, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol, candidate ORDER BY session ROWS UNBOUNDED PRECEDING)) AS path FROM cands)) GROUP BY key
), block_scores AS (
  SELECT key, 'eligible' AS reason, quantile_cont(sh, 0.5) - 0.5 * (quantile_cont(sh, 0.75) - quantile_cont(sh, 0.25)) - abs(any_value(dd)) AS score, any_value(dd) AS max_drawdown
  FROM (SELECT key, mean / sd * sqrt(252) AS sh FROM blocks) JOIN cand_path USING (key) GROUP BY key
), gaps AS (SELECT symbol, median(g) AS minutes FROM (SELECT symbol, epoch(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) / 60 AS g FROM bars30) GROUP BY symbol
), hours2 AS (
  SELECT symbol, date_trunc('day', ts) + INTERVAL 2 HOUR * (hour(ts) // 2) AS ts, first(open ORDER BY b.ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY b.ts) AS close, sum(volume) AS volume FROM bars30 b GROUP BY 1, 2
), line_days AS (
  SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, first(p ORDER BY l_shipdate, l_orderkey, l_linenumber) AS open, max(p) AS high, min(p) AS low,
    last(p ORDER BY l_shipdate, l_orderkey, l_linenumber) AS close, sum(l_quantity) AS volume FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1, 2
), policy_rows AS (
  SELECT d.symbol, d.policy, k.cost, d.session, d.candidate, CASE WHEN c.ret IS NULL OR c.ret = 0 THEN 0 ELSE c.ret - k.off END AS ret FROM (
    SELECT symbol, session, 'regime' AS policy, candidate FROM routes UNION ALL SELECT symbol, session, 'general', 'as_is' FROM routes) d
  CROSS JOIN (VALUES ('normal', 0.0), ('stress', 0.0005)) k(cost, off) LEFT JOIN cands c ON c.symbol = d.symbol AND c.session = d.session AND c.candidate = d.candidate
), policy_growth AS (SELECT symbol, policy, cost, exp(sum(ln(1 + ret))) AS growth FROM policy_rows GROUP BY ALL
), fold_cash AS (
  SELECT *, lag(end_cash, 1, 100000.0) OVER (PARTITION BY symbol, params ORDER BY fold) AS start_cash FROM (
    SELECT symbol, params, fold, 100000 * exp(sum(ln(1 + r * 0.01)) OVER (PARTITION BY symbol, params ORDER BY fold ROWS UNBOUNDED PRECEDING)) AS end_cash FROM chosen WHERE role = 'test')
), fold_sum AS (
  SELECT symbol, params, count(DISTINCT fold) AS folds, count(*) FILTER (r > 0) AS winning_folds, avg(r * 0.01) AS mean_return, median(r * 0.01) AS median_return, min(r * 0.01) AS worst_return FROM chosen WHERE role = 'test' GROUP BY ALL
), moves AS (
  SELECT symbol, fold, best, coalesce((best <> lag(best) OVER (PARTITION BY symbol ORDER BY fold))::INT, 0) AS moved FROM best
), stable AS (
  SELECT symbol, 'channel_bars' AS parameter, count(*) AS distinct_values, first(best ORDER BY n DESC, best) AS most_common, max(n) / sum(n) AS share, sum(moved)::BIGINT AS changes
  FROM (SELECT symbol, best, count(*) AS n, sum(moved) AS moved FROM moves GROUP BY ALL) GROUP BY symbol
), tests AS (SELECT symbol, fold, params, r FROM chosen WHERE role = 'test'
), walked AS (
  SELECT b.symbol, b.fold, b.best AS params, TRUE AS optimised, t.r AS result FROM best b JOIN tests t ON t.symbol = b.symbol AND t.fold = b.fold AND t.params = b.best WHERE b.fold = 0
  UNION ALL
  SELECT n.symbol, n.fold, n.p, n.renew, t.r FROM (
    SELECT b.symbol, b.fold, CASE WHEN w.result < 0 THEN b.best ELSE w.params END AS p, w.result < 0 AS renew FROM walked w JOIN best b ON b.symbol = w.symbol AND b.fold = w.fold + 1
  ) n JOIN tests t ON t.symbol = n.symbol AND t.fold = n.fold AND t.params = n.p
)"""
)

#: Relations that only some queries need, after those of the chain.
GAPS = """
gx AS (SELECT symbol, ts, CASE WHEN hour(ts) % 3 <> 0 THEN true_range END AS x FROM tr
), gk AS (SELECT *, count(x) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS k FROM gx
), gy AS (
  SELECT a.symbol, a.k, sum(CASE WHEN b.k = 0 THEN 1 ELSE 1 / 14.0 END * pow(13 / 14.0, a.k - b.k) * b.x) AS rma
  FROM (SELECT DISTINCT symbol, k FROM gk WHERE k >= 13) a JOIN gk b ON a.symbol = b.symbol AND b.x IS NOT NULL AND b.k <= a.k AND a.k - b.k < 700 GROUP BY ALL
), rma_gaps AS (SELECT gk.symbol, gk.ts, rma FROM gk JOIN gy ON gy.symbol = gk.symbol AND gy.k = gk.k
)"""
GATED = (
    """
gated AS (
  SELECT t.*, s.atr_session, v.vwap, """
    + ", ".join(f"b.{c}" for c in breakout.GATE)
    + """ FROM tagged t LEFT JOIN banded b ON b.symbol = t.symbol AND b.session = t.session
  LEFT JOIN spans s ON s.symbol = t.symbol AND s.session = t.session LEFT JOIN tr v ON v.symbol = t.symbol AND v.ts = t.ts
), """
    + ", ".join(_gated(*f) for f in _FLAGS)
    + """, gate_all AS ("""
    + " UNION ALL ".join(f"SELECT {a} AS use_bands, {b} AS use_vwap, {c} AS use_atr_buffer, * FROM g{a:d}{b:d}{c:d}" for a, b, c in _FLAGS)
    + """), gate_trades AS (
  SELECT symbol, session, use_bands, use_vwap, use_atr_buffer, k.factor, side, entry_ts, exit_ts, gross_points + 0.5 - 0.5 * k.factor - 0.2 * k.factor AS net_points FROM gate_all CROSS JOIN (VALUES (1.0), (2.0)) k(factor)
), gate_fig AS (
  SELECT symbol, factor::DOUBLE AS factor, coalesce(nullif(concat_ws('+', CASE WHEN use_bands THEN 'bands' END, CASE WHEN use_vwap THEN 'vwap' END, CASE WHEN use_atr_buffer THEN 'atr_buffer' END), ''), 'raw') AS variant,
    count(*) AS trades, sum(net_points) AS net_pnl FROM gate_trades GROUP BY ALL
), ablation AS (SELECT g.*, g.net_pnl - r.net_pnl AS net_pnl_difference FROM gate_fig g LEFT JOIN gate_fig r ON r.symbol = g.symbol AND r.factor = g.factor AND r.variant = 'raw'
)"""
)
AT_RISK = """
at_risk AS (
  SELECT *, lag(cash_after, 1, 100000.0) OVER (PARTITION BY symbol ORDER BY exit_ts) AS cash_before FROM (
    SELECT *, 1000 / risk AS units, 100000 + sum(1000 / risk * net_points) OVER (PARTITION BY symbol ORDER BY exit_ts ROWS UNBOUNDED PRECEDING) AS cash_after FROM ch)
)"""
SIMS = (
    """
sim_rows AS (SELECT symbol, cash_after - cash_before AS pnl, row_number() OVER (PARTITION BY symbol ORDER BY exit_ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM booked
), sim_steps AS (SELECT symbol, n, sim, unnest(range(n)) AS step FROM (SELECT DISTINCT symbol, n FROM sim_rows) CROSS JOIN range("""
    + str(m.SIMULATIONS)
    + """) r(sim)
), """
    + _paths("bootstrap", f"SELECT s.symbol, sim, step, pnl FROM sim_steps s JOIN sim_rows r ON r.symbol = s.symbol AND r.i = {_drawn(1, 's.symbol', 'sim', 'step')} % s.n")
    + ", "
    + ", ".join(
        _paths(
            name,
            f"SELECT * FROM (SELECT r.symbol, sim, r.n, row_number() OVER (PARTITION BY r.symbol, sim ORDER BY {_drawn(seed, 'r.symbol', 'sim', 'r.i')}, r.i) - 1 AS step, pnl FROM sim_rows r CROSS JOIN range({m.SIMULATIONS}) x(sim)) "
            f"WHERE step < greatest(1, round_even({keep} * n, 0))",
        )
        for name, seed, keep in (("reshuffle", 1, 1.0), ("dropout", 2, 0.9))
    )
    + """, sims AS (
  SELECT symbol, method, count(*) AS sims, min(pct) AS least, quantile_cont(pct, 0.05) AS p05, quantile_cont(pct, 0.5) AS median, quantile_cont(pct, 0.95) AS p95, max(pct) AS most
  FROM (SELECT * FROM bootstrap UNION ALL SELECT * FROM reshuffle UNION ALL SELECT * FROM dropout) GROUP BY symbol, method
)"""
)
GATE = (
    """
routed_ret AS (SELECT r.symbol, r.session, coalesce(c.ret, 0) AS ret FROM routes r LEFT JOIN cands c ON c.symbol = r.symbol AND c.session = r.session AND c.candidate = r.candidate
), diffs AS (
  SELECT a.symbol, a.session, a.ret - b.ret AS diff, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY a.symbol) AS n, sum(a.ret - b.ret) OVER (w ROWS UNBOUNDED PRECEDING) AS run
  FROM routed_ret a JOIN cands b ON b.symbol = a.symbol AND b.session = a.session AND b.candidate = 'as_is' WINDOW w AS (PARTITION BY a.symbol ORDER BY a.session)
), blocks_drawn AS (
  SELECT symbol, n, sim, least(b, n - k * b) AS len, """
    + _drawn(1, "symbol", "sim", "k")
    + """ % (n - b + 1) AS s FROM (
    SELECT symbol, n, b, sim, unnest(range(CAST(ceil(n / b) AS BIGINT))) AS k FROM (SELECT DISTINCT symbol, n, least(20, n) AS b FROM diffs) CROSS JOIN range("""
    + str(m.SIMULATIONS)
    + """) r(sim))
), sim_means AS (
  SELECT d.symbol, sim, sum(hi.run - coalesce(lo.run, 0)) / any_value(d.n) AS mean FROM blocks_drawn d JOIN diffs hi ON hi.symbol = d.symbol AND hi.i = d.s + d.len - 1 LEFT JOIN diffs lo ON lo.symbol = d.symbol AND lo.i = d.s - 1 GROUP BY d.symbol, sim
), falls AS (
  SELECT who, symbol, min(path / greatest(1, peak) - 1) AS dd FROM (SELECT who, symbol, path, max(path) OVER (PARTITION BY who, symbol ORDER BY session ROWS UNBOUNDED PRECEDING) AS peak FROM (
    SELECT who, symbol, session, exp(sum(ln(1 + ret)) OVER (PARTITION BY who, symbol ORDER BY session ROWS UNBOUNDED PRECEDING)) AS path FROM (
      SELECT 'r' AS who, symbol, session, ret FROM routed_ret UNION ALL SELECT 'g', symbol, session, ret FROM cands WHERE candidate = 'as_is'))) GROUP BY who, symbol
), router_gate AS (
  SELECT *, reason = 'accepted' AS accepted FROM (
    SELECT q.symbol, mean_diff, low, high, CASE WHEN NOT low > 0 THEN 'bootstrap_improvement_not_positive' WHEN r.dd < g.dd - 1e-12 THEN 'drawdown_not_improved' ELSE 'accepted' END AS reason
    FROM (SELECT symbol, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM sim_means GROUP BY symbol) q JOIN (SELECT symbol, avg(diff) AS mean_diff FROM diffs GROUP BY symbol) m ON m.symbol = q.symbol
    JOIN falls r ON r.symbol = q.symbol AND r.who = 'r' JOIN falls g ON g.symbol = q.symbol AND g.who = 'g')
)"""
)
WALK = """
walk_days AS (
  SELECT f.symbol, f.session, t.side, t.entry_ts, t.exit_ts, t.entry_price, t.risk, 1 + 0.01 * coalesce(t.net_r, 0) AS gain, t.net_r IS NOT NULL AS traded
  FROM session_folds f JOIN walked w ON w.symbol = f.symbol AND w.fold = f.fold AND f.role = 'test'
  LEFT JOIN swept t ON t.symbol = f.symbol AND t.session = f.session AND t.side_mode = 'both' AND t.channel_bars::VARCHAR = w.params
), walk_cash AS (
  SELECT *, 100000 * exp(coalesce(sum(ln(gain)) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM walk_days
), walk_bars AS (
  SELECT c.symbol, b.ts, before * CASE WHEN b.ts >= entry_ts AND b.ts < exit_ts THEN 1 + 0.01 * side * (b.close - entry_price) / risk WHEN b.ts >= exit_ts THEN gain ELSE 1 END AS equity,
    coalesce((b.ts >= entry_ts AND b.ts < exit_ts)::INT, 0) AS held FROM walk_cash c JOIN tagged b ON b.symbol = c.symbol AND b.session = c.session
), walk_fig AS (
  SELECT f.symbol, t.trades, final_equity, max_drawdown_pct, exposure_pct, net_pnl FROM (
    SELECT symbol, last(equity ORDER BY ts) AS final_equity, min(equity / greatest(100000, peak) - 1) * 100 AS max_drawdown_pct, avg(held) * 100 AS exposure_pct
    FROM (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM walk_bars) GROUP BY symbol) f
  JOIN (SELECT symbol, count(*) FILTER (traded) AS trades, sum(before * (gain - 1)) FILTER (traded) AS net_pnl FROM walk_cash GROUP BY symbol) t ON t.symbol = f.symbol
)"""
PLAIN = """
hold_curve AS (
  SELECT b.symbol, b.ts, 100000 + CASE WHEN h.entry_ts IS NULL OR b.ts < h.entry_ts THEN 0 WHEN b.ts >= h.exit_ts THEN h.net_pnl ELSE b.close - h.entry_price - 0.1 END AS equity
  FROM tagged b LEFT JOIN (
    SELECT symbol, max(open) FILTER (k = 2) + 0.25 AS entry_price, max(ts) FILTER (k = 2) AS entry_ts, max(ts) AS exit_ts, last(close ORDER BY ts) - 0.25 - max(open) FILTER (k = 2) - 0.25 - 0.2 AS net_pnl
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM tagged) GROUP BY symbol HAVING first(session ORDER BY ts) = max(session) FILTER (k = 2)
  ) h ON h.symbol = b.symbol
), last_day AS (SELECT * FROM tagged WHERE session = (SELECT max(session) FROM tagged)
), dated AS (SELECT * FROM tagged WHERE session BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'
), closes AS (SELECT symbol, session, last(close ORDER BY ts) AS close FROM tagged GROUP BY ALL
), look_back AS (
  SELECT h.symbol, t.fold, h.session FROM (SELECT DISTINCT symbol, session FROM history) h
  JOIN (SELECT symbol, fold, min(session) AS first FROM month_folds WHERE role = 'test' GROUP BY ALL) t ON t.symbol = h.symbol WHERE h.session < t.first AND h.session >= (t.first - INTERVAL 3 MONTH)::DATE)"""

_DIGITS = [(f"point // {r} % {n}", x) for r, n, x in zip(m.SPACE.radix, m.SPACE.sizes, m.SPACE.axes.values(), strict=True)]
_AXES = ", ".join(
    f"({d} = 1) AS {name}" if x["type"] == "categorical" else f"CAST({x['low']} + {x['step']} * ({d}) AS {'INTEGER' if x['type'] == 'int' else 'DOUBLE'}) AS {name}" for name, (d, x) in zip(m.SPACE.axes, _DIGITS, strict=True)
)
TRIALS = f"""
draws AS (
  SELECT symbol, fold, {_drawn(1, 'symbol', 'fold', 'draw')} % {m.SPACE.size} AS point, min(draw) AS draw FROM (SELECT DISTINCT symbol, fold FROM session_folds) CROSS JOIN range({4 * m.TRIALS}) d(draw) GROUP BY 1, 2, 3
), trials AS (SELECT symbol, fold, row_number() OVER (PARTITION BY symbol, fold ORDER BY draw) AS trial, point FROM draws QUALIFY trial <= {m.TRIALS}
), search_trials AS (SELECT *, {_AXES} FROM trials
), trial_moves AS ({' UNION ALL '.join(f"SELECT symbol, fold, trial, point AS origin, point {'+' if up else '-'} {r} AS point FROM trials WHERE {d} {'< ' + str(n - 1) if up else '> 0'}" for r, n, (d, x) in zip(m.SPACE.radix, m.SPACE.sizes, _DIGITS, strict=True) if x['type'] != 'categorical' for up in (0, 1))}
), trial_near AS (SELECT symbol, fold, trial, origin, point AS near, {_AXES} FROM trial_moves)"""
_KBAR = "close / nullif(lag(close, {k}) OVER w, 0) - 1"
FEATURES = f"""
feat_in AS (
  SELECT t.*, s.atr_session, rma * 2 AS atr_stop, close / lag(close) OVER (PARTITION BY t.symbol ORDER BY t.ts) - 1 AS r1
  FROM tr t LEFT JOIN rma ON rma.symbol = t.symbol AND rma.ts = t.ts LEFT JOIN spans s ON s.symbol = t.symbol AND s.session = t.session
), feats AS (
  SELECT symbol, ts, {', '.join(f'coalesce({_KBAR.format(k=k)}, 0) AS return_{k}' for k in (1, 3, 6))},
    coalesce(CASE WHEN count(r1) OVER v >= 3 THEN stddev_samp(r1) OVER v END, 0) AS volatility_12, coalesce(greatest(high - low, 1e-9) / nullif(atr_session, 0), 0) AS bar_range_atr,
    coalesce(abs(close - open) / greatest(high - low, 1e-9), 0) AS body_to_range, coalesce((close - vwap) / nullif(atr_session, 0), 0) AS close_vs_vwap_atr, coalesce(atr_stop / nullif(atr_session, 0), 0) AS atr_stop_atr_session
  FROM feat_in WINDOW w AS (PARTITION BY symbol ORDER BY ts), v AS (PARTITION BY symbol ORDER BY ts ROWS 11 PRECEDING)
), parts AS (
  SELECT c.symbol, c.ts, c.session, net_r, {', '.join(f'f.{x}' for x in breakout.FEATURES)},
    CASE WHEN row_number() OVER (PARTITION BY c.symbol ORDER BY c.ts) > count(*) OVER (PARTITION BY c.symbol) - greatest(3, CAST(round_even(0.3 * count(*) OVER (PARTITION BY c.symbol), 0) AS BIGINT)) THEN 'tail' ELSE 'head' END AS part
  FROM ch c JOIN feats f ON f.symbol = c.symbol AND f.ts = c.ts
), stated AS (SELECT *, CASE WHEN body_to_range < 0.4 THEN 0 WHEN bar_range_atr < 0.2 THEN 1 ELSE 2 END AS state FROM parts
), state_fig AS (
  SELECT symbol, state, count(*) AS n, sum(net_r) AS total, avg(net_r) AS expectancy, avg((net_r > 0)::INT) AS win FROM stated WHERE part = 'head' GROUP BY ALL
), best_state AS (
  -- of one state to trade: the first that qualifies, and the best of all whether it does or not
  SELECT symbol, state FROM (SELECT *, row_number() OVER w AS place, n >= 3 AND expectancy > 0 AS fits, sum((n >= 3 AND expectancy > 0)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS q
    FROM state_fig WINDOW w AS (PARTITION BY symbol ORDER BY expectancy DESC, total DESC, win DESC, n DESC, state DESC)) WHERE place = 1 OR (fits AND q = 1)
), tails AS (
  SELECT t.symbol, count(*) AS n, count(b.state) AS allowed, avg(net_r) AS baseline, avg(net_r) FILTER (b.state IS NOT NULL) AS filtered
  FROM stated t LEFT JOIN best_state b ON b.symbol = t.symbol AND b.state = t.state WHERE part = 'tail' GROUP BY t.symbol
), verdicts AS (
  SELECT *, allowed / n AS allow_rate, filtered - baseline AS improvement,
    CASE WHEN n < 5 THEN 'insufficient_validation_samples' WHEN allowed = 0 THEN 'no_allowed_candidates' WHEN allowed / n < 0.05 THEN 'allow_rate_too_low' WHEN filtered - baseline <= 0 THEN 'no_improvement' ELSE 'valid' END AS status FROM tails
), policy AS (
  SELECT t.*, v.status, CASE WHEN v.status = 'valid' THEN b.state IS NOT NULL ELSE TRUE END AS allowed FROM stated t LEFT JOIN verdicts v ON v.symbol = t.symbol LEFT JOIN best_state b ON b.symbol = t.symbol AND b.state = t.state
)"""
def _pid(n: int, reward: float) -> str:
    return hashlib.sha256(json.dumps({"channel_bars": n, "reward": reward}, separators=(",", ":")).encode()).hexdigest()


_SETS = [(f"rb{k}", n, r, _pid(n, r)) for k, (n, r) in enumerate((n, r) for n in m.ROBUST["channel_bars"] for r in m.ROBUST["reward"])]
_SEARCH, _CALIBRATION, _TESTED = (m.ROLES[0][1], m.ROLES[0][1] + m.ROLES[1][1], m.ROLES[-1][1])
_WHOLE = sum(n for _, n in m.ROLES)
_RSTEP = m.ROBUST_STEPS["channel_bars"][2], m.ROBUST_STEPS["reward"][2]


def _selected(sessions: int, trades: int, shrink: float) -> str:
    """From (sscores, near, rvol, rroles, cdays) to finals and rroutes."""
    return f"""), short_list AS (SELECT symbol, fold, pid FROM sscores QUALIFY row_number() OVER (PARTITION BY symbol, fold ORDER BY score DESC, pid) <= 4
), finals AS (
  SELECT symbol, fold, params_id, score, row_number() OVER (PARTITION BY symbol, fold ORDER BY score DESC, params_id) AS rank FROM (
    SELECT s.symbol, s.fold, s.pid AS params_id, quantile_cont(coalesce(c.score, -1e300), 0.5) AS score FROM short_list s JOIN near n ON n.origin = s.pid
    LEFT JOIN sscores c ON c.symbol = s.symbol AND c.fold = s.fold AND c.pid = n.pid GROUP BY s.symbol, s.fold, s.pid) WHERE score > -1e200 QUALIFY rank <= 4
), rgeneral AS (SELECT symbol, fold, params_id AS general FROM finals WHERE rank = 1
), rlimits AS (
  SELECT r.symbol, r.fold, quantile_cont(volatility, 1 / 3.0) AS lower, quantile_cont(volatility, 2 / 3.0) AS upper FROM rroles r JOIN rvol v ON v.symbol = r.symbol AND v.session = r.session WHERE role = 'search' GROUP BY ALL
), rtags AS (
  SELECT r.symbol, r.fold, r.role, r.session, g.general, CASE WHEN volatility <= lower THEN 'low' WHEN volatility <= upper THEN 'normal' WHEN volatility > upper THEN 'high' ELSE 'unknown' END AS regime
  FROM rroles r JOIN rvol v ON v.symbol = r.symbol AND v.session = r.session JOIN rgeneral g ON g.symbol = r.symbol AND g.fold = r.fold LEFT JOIN rlimits l ON l.symbol = r.symbol AND l.fold = r.fold
), rcal AS (
  SELECT c.symbol, c.fold, c.pid, c.session, c.ret, c.traded, t.regime FROM cdays c JOIN finals f ON f.symbol = c.symbol AND f.fold = c.fold AND f.params_id = c.pid
  LEFT JOIN rtags t ON t.symbol = c.symbol AND t.fold = c.fold AND t.session = c.session AND t.role = 'calibration' WHERE c.role = 'calibration'
), rper AS (SELECT symbol, fold, pid, regime, count(*) AS n, count(*) FILTER (traded) AS t, avg(ret) AS rm, avg(ret * ret) AS rq FROM rcal WHERE regime IN ('low', 'normal', 'high') GROUP BY ALL
), rscores AS (
  SELECT symbol, fold, pid, regime, mm / sqrt(v) * sqrt(252) AS score FROM (
    SELECT *, greatest(w * rq + (1 - w) * gq - mm * mm, 0) AS v FROM (
      SELECT p.*, g.gq, n / (n + {shrink}) AS w, n / (n + {shrink}) * rm + (1 - n / (n + {shrink})) * gm AS mm FROM rper p JOIN (SELECT symbol, fold, pid, avg(ret) AS gm, avg(ret * ret) AS gq FROM rcal GROUP BY ALL) g ON g.symbol = p.symbol AND g.fold = p.fold AND g.pid = p.pid))
  WHERE n >= {sessions} AND t >= {trades} AND v > 0
), rlibrary AS (SELECT symbol, fold, regime, first(pid ORDER BY score DESC, pid) AS candidate FROM rscores GROUP BY ALL
), rsteps AS (
  SELECT t.symbol, t.fold, t.role, t.session, t.general, nullif(t.regime, 'unknown') AS regime, coalesce(l.candidate, t.general) AS goal, row_number() OVER (PARTITION BY t.symbol, t.fold, t.role ORDER BY t.session) AS k
  FROM rtags t LEFT JOIN rlibrary l ON l.symbol = t.symbol AND l.fold = t.fold AND l.regime = t.regime WHERE t.role IN ('gate', 'test')
), rroutes AS (
  SELECT symbol, fold, role, session, k, general, general AS candidate, CASE WHEN regime IS NOT NULL AND goal <> general THEN regime END AS pending, CASE WHEN regime IS NOT NULL AND goal <> general THEN 1 ELSE 0 END AS n FROM rsteps WHERE k = 1
  UNION ALL
  SELECT symbol, fold, role, session, k, general, CASE WHEN regime IS NULL THEN general WHEN goal <> active AND c >= 2 THEN goal ELSE active END, CASE WHEN regime IS NULL OR goal = active OR c >= 2 THEN NULL ELSE regime END, CASE WHEN regime IS NULL OR goal = active OR c >= 2 THEN 0 ELSE c END
  FROM (SELECT x.*, r.candidate AS active, CASE WHEN r.pending = x.regime THEN r.n + 1 ELSE 1 END AS c FROM rroutes r JOIN rsteps x ON x.symbol = r.symbol AND x.fold = r.fold AND x.role = r.role AND x.k = r.k + 1)
"""


def _bootstrapped(block: int) -> str:
    """From gdays to the bootstrapped means of their differences and the falls of their paths."""
    return f"""), gdiffs AS (
  SELECT a.symbol, a.fold, a.ret - b.ret AS diff, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY a.symbol, a.fold) AS n, sum(a.ret - b.ret) OVER (w ROWS UNBOUNDED PRECEDING) AS run
  FROM gdays a JOIN gdays b ON a.policy = 'router' AND b.policy = 'general' AND b.symbol = a.symbol AND b.fold = a.fold AND b.session = a.session WINDOW w AS (PARTITION BY a.symbol, a.fold ORDER BY a.session)
), gdrawn AS (
  SELECT symbol, fold, n, sim, least(b, n - k * b) AS len, {_drawn(1, 'symbol', 'fold', 'sim', 'k')} % (n - b + 1) AS s FROM (
    SELECT symbol, fold, n, b, sim, unnest(range(CAST(ceil(n / b) AS BIGINT))) AS k FROM (SELECT DISTINCT symbol, fold, n, least({block}, n) AS b FROM gdiffs) CROSS JOIN range({m.SIMULATIONS}) r(sim))
), gmeans AS (
  SELECT d.symbol, d.fold, sim, sum(hi.run - coalesce(lo.run, 0)) / any_value(d.n) AS mean FROM gdrawn d JOIN gdiffs hi ON hi.symbol = d.symbol AND hi.fold = d.fold AND hi.i = d.s + d.len - 1
  LEFT JOIN gdiffs lo ON lo.symbol = d.symbol AND lo.fold = d.fold AND lo.i = d.s - 1 GROUP BY d.symbol, d.fold, sim
), gpaths AS (
  SELECT symbol, fold, policy, min(path / greatest(1, peak) - 1) AS dd FROM (SELECT *, max(path) OVER (PARTITION BY symbol, fold, policy ORDER BY session ROWS UNBOUNDED PRECEDING) AS peak FROM (
    SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol, fold, policy ORDER BY session ROWS UNBOUNDED PRECEDING)) AS path FROM gdays)) GROUP BY ALL
"""


#: The robust walk-forward from the trades of the whole grid to the cash out of sample.
ROBUST = (
    ", ".join(_channel(name, n, reward=r).strip() for name, n, r, _ in _SETS)
    + ", rb_all AS ("
    + " UNION ALL ".join(f"SELECT '{pid}' AS pid, * FROM {name}" for name, _, _, pid in _SETS)
    + f"""), rt AS (
  SELECT symbol, session, pid, 1 AS factor, side, entry_ts, exit_ts, entry_price, risk, net_r FROM rb_all
  UNION ALL SELECT symbol, session, pid, 2, side, entry_ts, exit_ts, e, abs(e - stop), (side * (x - e) - 0.4) / nullif(abs(e - stop), 0) FROM (SELECT *, entry_price + side * 0.25 AS e, exit_price - side * 0.25 AS x FROM rb_all)
), sets(pid, n, reward) AS (VALUES {', '.join(f"('{pid}', {n}, {r}::DOUBLE)" for _, n, r, pid in _SETS)}
), rroles AS (
  SELECT d.symbol, f.fold::INT AS fold, session, CASE WHEN i - f.fold * {_TESTED} < {_SEARCH} THEN 'search' WHEN i - f.fold * {_TESTED} < {_CALIBRATION} THEN 'calibration' WHEN i - f.fold * {_TESTED} < {_WHOLE - _TESTED} THEN 'gate' ELSE 'test' END AS role
  FROM fold_days d, range(200) f(fold) WHERE i >= f.fold * {_TESTED} AND i < f.fold * {_TESTED} + {_WHOLE} AND f.fold * {_TESTED} + {_WHOLE} <= (SELECT count(*) FROM fold_days x WHERE x.symbol = d.symbol)
), cdays AS (
  SELECT r.symbol, r.fold, r.role, p.pid, r.session, coalesce(0.01 * t.net_r, 0) AS ret, t.net_r IS NOT NULL AS traded
  FROM rroles r JOIN (SELECT DISTINCT symbol, pid FROM rt WHERE factor = 1) p ON p.symbol = r.symbol LEFT JOIN rt t ON t.factor = 1 AND t.symbol = r.symbol AND t.pid = p.pid AND t.session = r.session
), sdays AS (
  SELECT *, CASE WHEN k <= {_SEARCH // 2} THEN 1 ELSE 2 END AS block, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol, fold, pid ORDER BY k ROWS UNBOUNDED PRECEDING)) AS path
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, fold, pid ORDER BY session) AS k FROM cdays WHERE role = 'search')
), sblocks AS (SELECT symbol, fold, pid, block, avg(ret) AS mean, stddev_pop(ret) AS sd, count(*) FILTER (traded) AS t FROM sdays GROUP BY ALL
), sfalls AS (
  SELECT symbol, fold, pid, min(path / greatest(1, peak) - 1) AS dd, min(ret) AS least, count(*) FILTER (traded) AS total
  FROM (SELECT *, max(path) OVER (PARTITION BY symbol, fold, pid ORDER BY k ROWS UNBOUNDED PRECEDING) AS peak FROM sdays) GROUP BY ALL
), sscores AS (
  SELECT b.symbol, b.fold, b.pid, quantile_cont(mean / sd * sqrt(252), 0.5) - 0.5 * (quantile_cont(mean / sd * sqrt(252), 0.75) - quantile_cont(mean / sd * sqrt(252), 0.25)) - abs(any_value(dd)) AS score
  FROM sblocks b JOIN sfalls f ON f.symbol = b.symbol AND f.fold = b.fold AND f.pid = b.pid GROUP BY b.symbol, b.fold, b.pid HAVING any_value(least) > -1 AND any_value(total) >= 2 AND min(t) >= 1 AND min(sd) > 0
), near AS (SELECT a.pid AS origin, b.pid FROM sets a JOIN sets b ON a.pid = b.pid OR (a.reward = b.reward AND abs(a.n - b.n) = {_RSTEP[0]}) OR (a.n = b.n AND abs(a.reward - b.reward) = {_RSTEP[1]})
), rvol AS (
  SELECT symbol, session, CASE WHEN count(r) OVER w = 4 THEN stddev_pop(r) OVER w END AS volatility
  FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY session)) AS r FROM (SELECT symbol, session, last(close ORDER BY ts) AS close FROM tagged GROUP BY ALL))
  WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)
"""
    + _selected(1, 1, 5.0)
    + """), gdecided AS (
  SELECT symbol, fold, session, 'router' AS policy, candidate AS pid FROM rroutes WHERE role = 'gate' UNION ALL SELECT symbol, fold, session, 'general', general FROM rroutes WHERE role = 'gate'
), gdays AS (
  SELECT *, cash_before * gain AS cash_after, CASE WHEN cash_before > 0 THEN gain - 1 ELSE 0 END AS ret, (entry_ts IS NOT NULL)::INT AS trades FROM (
    SELECT *, 100000 * exp(coalesce(sum(ln(gain)) OVER (PARTITION BY symbol, fold, policy ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS cash_before FROM (
      SELECT d.*, t.side, t.entry_ts, t.exit_ts, t.entry_price, t.risk, greatest(1 + 0.01 * coalesce(t.net_r, 0), 0) AS gain FROM gdecided d LEFT JOIN rt t ON t.factor = 1 AND t.symbol = d.symbol AND t.pid = d.pid AND t.session = d.session))
), gcurve AS (
  SELECT d.symbol, d.fold, d.policy, b.ts, cash_before * CASE WHEN b.ts >= entry_ts AND b.ts < exit_ts THEN 1 + 0.01 * coalesce(side * (b.close - entry_price) / nullif(risk, 0), 0) WHEN b.ts >= exit_ts THEN gain ELSE 1 END AS equity
  FROM gdays d JOIN tagged b ON b.symbol = d.symbol AND b.session = d.session
), gfalls AS (
  SELECT symbol, fold, policy, min(equity / greatest(100000, peak) - 1) AS dd FROM (SELECT *, max(equity) OVER (PARTITION BY symbol, fold, policy ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM gcurve) GROUP BY ALL
"""
    + _bootstrapped(m.ROLES[2][1])
    + """), ggate AS (
  SELECT *, reason = 'accepted' AS accepted FROM (
    SELECT q.symbol, q.fold, mean_diff, low, high, r.dd AS router_drawdown, g.dd AS general_drawdown, t.trades,
      CASE WHEN t.trades < 1 THEN 'insufficient_gate_trades' WHEN NOT low > 0 THEN 'bootstrap_improvement_not_positive' WHEN pr.dd < pg.dd - 1e-12 THEN 'drawdown_not_improved' WHEN r.dd < g.dd - 1e-12 THEN 'worse_close_marked_drawdown' ELSE 'accepted' END AS reason
    FROM (SELECT symbol, fold, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM gmeans GROUP BY ALL) q JOIN (SELECT symbol, fold, avg(diff) AS mean_diff FROM gdiffs GROUP BY ALL) USING (symbol, fold)
    JOIN (SELECT symbol, fold, min(n) AS trades FROM (SELECT symbol, fold, policy, sum(trades)::BIGINT AS n FROM gdays GROUP BY ALL) GROUP BY ALL) t USING (symbol, fold)
    JOIN (SELECT * FROM gfalls WHERE policy = 'router') r USING (symbol, fold) JOIN (SELECT * FROM gfalls WHERE policy = 'general') g USING (symbol, fold)
    JOIN (SELECT * FROM gpaths WHERE policy = 'router') pr USING (symbol, fold) JOIN (SELECT * FROM gpaths WHERE policy = 'general') pg USING (symbol, fold))
), tdecided AS (
  SELECT r.symbol, r.fold, r.session, x.candidate, x.general, coalesce(g.accepted, FALSE) AS ok FROM rroles r LEFT JOIN rroutes x ON x.role = 'test' AND x.symbol = r.symbol AND x.fold = r.fold AND x.session = r.session
  LEFT JOIN ggate g ON g.symbol = r.symbol AND g.fold = r.fold WHERE r.role = 'test'
), tpolicies AS (
  SELECT symbol, fold, session, 'general' AS policy, coalesce(general, 'cash') AS candidate, FALSE AS routed FROM tdecided
  UNION ALL SELECT symbol, fold, session, 'regime', coalesce(CASE WHEN ok THEN candidate ELSE general END, 'cash'), ok FROM tdecided
), rwalk AS (
  SELECT *, 100000 * exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol, policy, cost ORDER BY session ROWS UNBOUNDED PRECEDING)) AS cash FROM (
    SELECT p.*, k.cost, coalesce(0.01 * t.net_r, 0) AS ret FROM tpolicies p CROSS JOIN (VALUES ('normal', 1), ('stress', 2)) k(cost, factor) LEFT JOIN rt t ON t.symbol = p.symbol AND t.pid = p.candidate AND t.session = p.session AND t.factor = k.factor)
)"""
)


def _month_id(length: int, width: float) -> str:
    return hashlib.sha256(json.dumps({"length": length, "width": width}, separators=(",", ":")).encode()).hexdigest()


_LENGTH, _WIDTH = months.STEPS["length"][2], months.STEPS["width"][2]
_ENDS = [sum(n for _, n in months.ROLES[: k + 1]) for k in range(len(months.ROLES))]
_SPANS = ", ".join(f"('{name}', {end - n}, {end})" for (name, n), end in zip(months.ROLES, _ENDS, strict=True))
#: The same protocol over calendar months of the orders' history, to six series out of sample.
MONTHS = (
    f"""sets(pid, n, width) AS (VALUES {', '.join(f"('{_month_id(n, x)}', {n}, {x}::DOUBLE)" for n in months.SETS['length'] for x in months.SETS['width'])}
), mmoves AS (
  """
    + " UNION ALL ".join(
        f"SELECT symbol, session, ret, {n} AS n, sum(ret) OVER w AS move, stddev_pop(ret) OVER w AS sd FROM history WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) QUALIFY count(*) OVER w = {n}"
        for n in months.SETS["length"]
    )
    + f"""
), mgains AS (
  SELECT symbol, session, pid, -{months.SHARE} * sign(round(move, 9)) * ret AS gain, round(move, 9) <> 0 AND round(abs(move) - width * sd, 9) > 0 AS banded, round(move, 9) <> 0 AS plain FROM mmoves m JOIN sets s ON s.n = m.n
), rroles AS (
  SELECT h.symbol, f.k::INT AS fold, r.role, session FROM (SELECT symbol, session, min(session) OVER (PARTITION BY symbol) AS earliest, max(session) OVER (PARTITION BY symbol) AS latest FROM history) h, range(100) f(k), (VALUES {_SPANS}) r(role, a, z)
  WHERE session >= (earliest + INTERVAL 1 MONTH * (f.k * {months.ROLES[-1][1]} + r.a))::DATE AND session < (earliest + INTERVAL 1 MONTH * (f.k * {months.ROLES[-1][1]} + r.z))::DATE
    AND (earliest + INTERVAL 1 MONTH * (f.k * {months.ROLES[-1][1]} + {_ENDS[-1]}))::DATE <= latest + 1
), cdays AS (
  SELECT r.symbol, r.fold, r.role, g.pid, r.session, CASE WHEN banded THEN gain - {months.COST} ELSE 0 END AS ret, banded AS traded FROM rroles r JOIN mgains g ON g.symbol = r.symbol AND g.session = r.session
), mstarts AS (SELECT symbol, fold, min(session) AS start FROM rroles WHERE role = 'search' GROUP BY ALL
), sdays AS (
  SELECT c.*, datesub('month', start, session) // {months.BLOCK_MONTHS} AS block, exp(sum(ln(1 + ret)) OVER (PARTITION BY c.symbol, c.fold, pid ORDER BY session ROWS UNBOUNDED PRECEDING)) AS path
  FROM cdays c JOIN mstarts m ON m.symbol = c.symbol AND m.fold = c.fold WHERE role = 'search'
), sblocks AS (SELECT symbol, fold, pid, block, avg(ret) AS mean, stddev_pop(ret) AS sd, count(*) FILTER (traded) AS t FROM sdays GROUP BY ALL
), sfalls AS (
  SELECT symbol, fold, pid, min(path / greatest(1, peak) - 1) AS dd, count(*) FILTER (traded) AS total
  FROM (SELECT *, max(path) OVER (PARTITION BY symbol, fold, pid ORDER BY session ROWS UNBOUNDED PRECEDING) AS peak FROM sdays) GROUP BY ALL
), sscores AS (
  SELECT b.symbol, b.fold, b.pid, quantile_cont(mean / sd * sqrt(252), 0.5) - 0.5 * (quantile_cont(mean / sd * sqrt(252), 0.75) - quantile_cont(mean / sd * sqrt(252), 0.25)) - abs(any_value(dd)) AS score
  FROM sblocks b JOIN sfalls f ON f.symbol = b.symbol AND f.fold = b.fold AND f.pid = b.pid GROUP BY b.symbol, b.fold, b.pid
  HAVING count(*) = {months.ROLES[0][1] // months.BLOCK_MONTHS} AND any_value(total) >= {months.LEAST_TRADES} AND min(t) >= {months.LEAST_BLOCK} AND min(sd) > 0
), near AS (SELECT a.pid AS origin, b.pid FROM sets a JOIN sets b ON a.pid = b.pid OR (a.width = b.width AND abs(a.n - b.n) = {_LENGTH}) OR (a.n = b.n AND abs(a.width - b.width) = {_WIDTH})
), rvol AS (SELECT * FROM vol20
"""
    + _selected(10, 3, 10.0)
    + """), gdays AS (
  SELECT d.symbol, d.fold, d.session, d.policy, c.ret FROM (
    SELECT symbol, fold, session, 'router' AS policy, candidate AS pid FROM rroutes WHERE role = 'gate' UNION ALL SELECT symbol, fold, session, 'general', general FROM rroutes WHERE role = 'gate') d
  JOIN cdays c ON c.role = 'gate' AND c.symbol = d.symbol AND c.fold = d.fold AND c.session = d.session AND c.pid = d.pid
"""
    + _bootstrapped(months.BOOTSTRAP_BLOCK)
    + f"""), ggate AS (
  SELECT *, reason = 'accepted' AS accepted FROM (
    SELECT symbol, fold, mean_diff, low, high, CASE WHEN NOT low > 0 THEN 'bootstrap_improvement_not_positive' WHEN pr.dd < pg.dd - 1e-12 THEN 'drawdown_not_improved' ELSE 'accepted' END AS reason
    FROM (SELECT symbol, fold, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM gmeans GROUP BY ALL) JOIN (SELECT symbol, fold, avg(diff) AS mean_diff FROM gdiffs GROUP BY ALL) USING (symbol, fold)
    JOIN (SELECT * FROM gpaths WHERE policy = 'router') pr USING (symbol, fold) JOIN (SELECT * FROM gpaths WHERE policy = 'general') pg USING (symbol, fold))
), tdecided AS (
  SELECT r.symbol, r.fold, r.session, x.candidate, x.general, coalesce(g.accepted, FALSE) AS ok FROM rroles r LEFT JOIN rroutes x ON x.role = 'test' AND x.symbol = r.symbol AND x.fold = r.fold AND x.session = r.session
  LEFT JOIN ggate g ON g.symbol = r.symbol AND g.fold = r.fold WHERE r.role = 'test'
), tpolicies AS (
  SELECT symbol, fold, session, 'general' AS policy, coalesce(general, 'cash') AS candidate, FALSE AS routed FROM tdecided
  UNION ALL SELECT symbol, fold, session, 'regime', coalesce(CASE WHEN ok THEN candidate ELSE general END, 'cash'), ok FROM tdecided
), mseries AS (
  SELECT p.*, k.cost, k.factor, g.gain, coalesce(CASE WHEN k.banded THEN g.banded ELSE g.plain END, FALSE) AS traded
  FROM tpolicies p CROSS JOIN (VALUES {', '.join(f"('{n}', {x}, {b})" for n, x, b in months.SERIES)}) k(cost, factor, banded) LEFT JOIN mgains g ON g.symbol = p.symbol AND g.pid = p.candidate AND g.session = p.session
), mwalk AS (
  SELECT *, 100000 * exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol, policy, cost ORDER BY session ROWS UNBOUNDED PRECEDING)) AS cash FROM (SELECT *, CASE WHEN traded THEN gain - {months.COST} * factor ELSE 0 END AS ret FROM mseries)
), mfigures AS (
  SELECT symbol, policy, cost, count(*) AS sessions, count(*) FILTER (traded) AS trades, last(cash ORDER BY session) AS final_cash, min(cash / greatest(100000, peak) - 1) AS max_drawdown
  FROM (SELECT *, max(cash) OVER (PARTITION BY symbol, policy, cost ORDER BY session ROWS UNBOUNDED PRECEDING) AS peak FROM mwalk) GROUP BY ALL
)"""
)
LOOKBACKS = (3, 5, 8)
_FRAME = "(SELECT avg(b.{0}) FROM {1} b WHERE b.symbol = r.symbol{2} AND b.i BETWEEN r.i - r.n AND r.i - 1 HAVING count(b.{0}) = r.n)"
BY_LOOKBACK = f"""
lb_rows AS (
  SELECT *, lag(sigma) OVER (PARTITION BY symbol ORDER BY session) AS last_sigma, row_number() OVER (PARTITION BY symbol ORDER BY session) AS i FROM vol
), lb_one AS (SELECT * FROM lb_rows CROSS JOIN (VALUES {', '.join(f'({n})' for n in LOOKBACKS)}) x(n)
), lb_tau AS (SELECT *, abs(ln(c_target_2 / o_ref)) / nullif(sigma, 0) AS z_body, sigma / nullif({_FRAME.format('sigma', 'lb_rows', '')}, 0) AS z_sigma FROM lb_one r
), lb_dir AS (
  SELECT *, CASE WHEN strong AND c_target_2 > o_ref THEN 'bullish' WHEN strong AND c_target_2 < o_ref THEN 'bearish' ELSE 'neutral' END AS direction FROM (
    SELECT *, CASE WHEN z_sigma IS NOT NULL THEN z_body > least(greatest(0.4 * pow(z_sigma, -0.5), 0.26), 1.75) END AS strong, greatest({_HIGH}) - o_ref AS up, o_ref - least({_LOW}) AS down FROM lb_tau)
), lb_eps AS (
  SELECT *, CASE direction WHEN 'bullish' THEN down WHEN 'bearish' THEN up ELSE greatest(up, down) END / nullif(sigma, 0) AS ae,
    CASE direction WHEN 'bullish' THEN up WHEN 'bearish' THEN down ELSE greatest(up, down) END / nullif(sigma, 0) AS fe FROM lb_dir
), lb_mu AS (
  SELECT *, {_FRAME.format('ae', 'lb_eps', ' AND b.n = r.n')} * last_sigma AS mu_ae, {_FRAME.format('fe', 'lb_eps', ' AND b.n = r.n')} * last_sigma AS mu_fe, 0.1 * last_sigma * o_ref AS delta FROM lb_eps r
), by_lookback AS (SELECT symbol, session, n AS lookback, direction, {_EDGES} FROM lb_mu)"""


def _tree_sums(name: str, source: str, keys: str, row: str, rows: str) -> str:
    return f"""{name} AS (
  SELECT *, md5(concat_ws('|', rows, a, b)) AS digest FROM (
    SELECT {keys}{', ' if keys else ''}CAST({rows} AS BIGINT) AS rows, sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR AS a, sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR AS b
    FROM (SELECT *, md5(concat_ws('|', {row})) AS h FROM {source}) GROUP BY ALL)
)"""


_NINE = "CAST(CAST({} AS DECIMAL(30, 9)) AS VARCHAR)"
CONTENT = ", ".join(
    x.strip()
    for x in (
        "tick_rows AS (SELECT *, CAST(CASE WHEN hour(local_ts) >= 17 THEN local_ts::DATE + 1 ELSE local_ts::DATE END AS DATE) AS session FROM (SELECT event_type AS symbol, ts, ts - INTERVAL 5 HOUR AS local_ts, value, event_id FROM events))",
        _tree_sums("content_2", "tick_rows", "session, symbol", f"'=' || symbol, '=' || epoch_us(ts), '=' || {_NINE.format('value')}, '=' || event_id", "count(*)"),
        _tree_sums("content_1", "content_2", "session", "'=' || session, '=' || symbol, '=' || digest", "sum(rows)"),
        _tree_sums("content_0", "content_1", "", "'=' || session, '=' || digest", "sum(rows)"),
        """content_tree AS (SELECT 2 AS level, session, symbol, rows, digest FROM content_2 UNION ALL SELECT 1, session, NULL, rows, digest FROM content_1 UNION ALL SELECT 0, NULL, NULL, rows, digest FROM content_0)""",
        _tree_sums("content_bars", "bars30", "", "'=' || symbol, '=' || epoch_us(ts), " + ", ".join(f"'=' || {_NINE.format(c)}" for c in OHLCV), "count(*)"),
        "content AS (SELECT rows, a AS hash_sum, digest FROM content_bars)",
    )
)

SHAPES = """
shapes AS (""" + " UNION ALL ".join(
    f"SELECT symbol, session, '{label}' AS label, '{kind}' AS kind, {low} AS low, {high} AS high FROM banded WHERE {low} IS NOT NULL AND {high} IS NOT NULL"
    for b in ("ae_neg", "ae_pos", "fe_neg", "fe_pos")
    for label, kind, low, high in ((f"band_{b}", "zone", f"band_{b}_lower", f"band_{b}_upper"), *((f"band_{b}_{e}", "line", f"band_{b}_{e}", f"band_{b}_{e}") for e in ("lower", "upper", "center")))
) + ")"
RETURNS = """
walk_ends AS (SELECT c.symbol, c.session, c.before * c.gain AS known, last(w.equity ORDER BY w.ts) AS e FROM walk_cash c LEFT JOIN tagged b ON b.symbol = c.symbol AND b.session = c.session LEFT JOIN walk_bars w ON w.symbol = b.symbol AND w.ts = b.ts GROUP BY ALL
), walk_ret AS (SELECT symbol, session, e / lag(e, 1, 100000.0) OVER (PARTITION BY symbol ORDER BY session) - 1 AS ret FROM walk_ends)"""
DECISIONS = """
walk_tags AS (SELECT symbol, fold, session, regime FROM rtags WHERE role = 'test'
), decisions AS (
  SELECT w.*, t.regime, g.reason AS gate_reason, lag(cash, 1, 100000.0) OVER (PARTITION BY w.symbol, policy, cost ORDER BY w.session) AS starting_cash, cash / lag(cash, 1, 100000.0) OVER (PARTITION BY w.symbol, policy, cost ORDER BY w.session) - 1 AS daily_return
  FROM rwalk w LEFT JOIN walk_tags t ON t.symbol = w.symbol AND t.fold = w.fold AND t.session = w.session LEFT JOIN ggate g ON g.symbol = w.symbol AND g.fold = w.fold
)"""
HIGHLIGHTS = """
sim_ranks AS (
  SELECT symbol, method, sim, row_number() OVER (PARTITION BY symbol, method ORDER BY round(pct, 6), sim) - 1 AS k, count(*) OVER (PARTITION BY symbol, method) AS n FROM (SELECT * FROM bootstrap UNION ALL SELECT * FROM reshuffle UNION ALL SELECT * FROM dropout)
), highlights AS (SELECT symbol, method, max(sim) FILTER (k = 0) AS worst, max(sim) FILTER (k = n // 2) AS median, max(sim) FILTER (k = n - 1) AS best FROM sim_ranks GROUP BY ALL
), drawn AS (SELECT * FROM bootstrap_e WHERE sim < 3)"""
SUMMARIES = """
walk_sum AS (
  SELECT w.symbol, count(*) AS folds, count(*) FILTER (result > 0) AS winning_folds, avg(result * 0.01) AS mean_return, median(result * 0.01) AS median_return, min(result * 0.01) AS worst_return,
    any_value(f.final_equity) AS final_equity, any_value(f.max_drawdown_pct) AS max_drawdown_pct FROM walked w LEFT JOIN walk_fig f ON f.symbol = w.symbol GROUP BY w.symbol
), stable_wide AS (SELECT parameter, """ + ", ".join(f"max(share) FILTER (symbol = '{x}') AS {x}" for x in m.SYMBOLS) + """ FROM stable GROUP BY parameter
), faults AS (
  SELECT symbol, candidate, CASE WHEN min(CASE WHEN candidate = 'turned' THEN 15 * ret ELSE ret END) <= -1 THEN 'bankrupt_return' END AS fault FROM cands GROUP BY ALL
), search_blocks AS (
  SELECT symbol, fold, session, (datesub('month', min(session) OVER (PARTITION BY symbol, fold), session) // 3)::INT AS block FROM month_folds WHERE role = 'search'
), trade_days AS (SELECT c.symbol, c.entry_ts, b.session FROM ch c LEFT JOIN tagged b ON b.symbol = c.symbol AND b.ts = c.entry_ts
), one_row AS (SELECT * FROM banded WHERE symbol = 'view' AND session = DATE '2024-01-20'
), held_days AS (SELECT * FROM tagged WHERE session IN (SELECT session FROM valid)
), fallbacks AS (
  SELECT symbol, session, ts, side, CASE WHEN hour(ts) % 2 = 1 THEN entry_open - side * 5 ELSE stop END AS stop, CASE WHEN hour(ts) % 2 = 1 THEN entry_open + side * 8 ELSE target END AS target FROM ch_e
)"""
LET = """
policy_sum AS (SELECT symbol, count(*) AS candidates, count(*) FILTER (allowed) AS allowed, max((status = 'valid')::INT) AS valid, count(*) FILTER (allowed) / count(*) AS allowed_rate FROM policy GROUP BY symbol
), let_signals AS (SELECT * FROM channel_signals s WHERE EXISTS (SELECT 1 FROM policy p WHERE p.symbol = s.symbol AND p.ts = s.ts AND p.allowed))"""

ALL: dict[str, Query] = {
    "bars_30m": Query(m.bars30, ("symbol", "ts"), OHLCV, "bars30"),
    "bars_2h_from_30m": Query(lambda s, d: bars.wider(m.bars30(s, d), "2 hours"), ("symbol", "ts"), OHLCV, "hours2"),
    "bar_spacing": Query(lambda s, d: bars.spacing(m.bars30(s, d)), ("symbol",), ("minutes",), "gaps"),
    "tagged_bars": Query(m.tagged, ("symbol", "ts", "session", "bucket"), OHLCV, "tagged"),
    "session_wide": Query(m.wide, ("symbol", "session"), (*WIDE, "o_ref"), "wide"),
    "calendar_sessions": Query(m.valid, ("symbol", "session"), ("o_ref",), "valid"),
    "target_rows": Query(lambda s, d: bars.target_rows(m.wide(s, d)), ("symbol", "session", "target_slot"), ("daily_close", "o_ref", *TARGET), "slots"),
    "volatility": Query(m.sigma_rows, ("symbol", "session"), ("sigma",), "vol"),
    "volatility_today": Query(lambda s, d: bands.with_volatility(m.wide(s, d), mode="today"), ("symbol", "session"), ("sigma_today",), "today"),
    "session_bands": Query(m.banded, ("symbol", "session", "direction"), ("sigma", *BANDS), "banded"),
    "band_overlays": Query(lambda s, d: bands.band_overlays(m.banded(s, d)), ("symbol", "session", "overlay"), ("level",), "overlays"),
    "opening_ranges": Query(lambda s, d: breakout.opening_range(m.tagged(s, d), 510, 570), ("symbol", "session", "range_end"), ("range_high", "range_low", "range_mid"), "opening"),
    "session_ranges": Query(lambda s, d: breakout.session_ranges(m.tagged(s, d), 5), ("symbol", "session"), ("session_range", "atr_session"), "spans"),
    "vwap_true_range": Query(lambda s, d: breakout.with_true_range(breakout.with_vwap(m.tagged(s, d))), ("symbol", "ts"), ("vwap", "true_range"), "tr", 8),
    "wilder_average": Query(
        lambda s, d: breakout.recurrence(breakout.with_true_range(m.tagged(s, d)), "true_range", "rma", ["symbol"], "ts", 14).filter("rma IS NOT NULL"), ("symbol", "ts"), ("rma",), "rma"
    ),
    "channel_signals": Query(lambda s, d: m.signals(s, d).withColumnRenamed("trigger", "trigger_level"), ("symbol", "session", "ts", "side"), ("stop", "target", "trigger_level"), "channel_signals"),
    "range_signals": Query(lambda s, d: m.signals(s, d, m.RANGE), ("symbol", "session", "ts", "side"), ("stop", "target"), "range_signals"),
    "channel_trades": Query(m.closed, ("symbol", "session", "ts", "side", "entry_ts", "exit_ts", "reason"), ("entry_price", "exit_price", "gross_points", "net_points", "risk", "gross_r", "net_r"), "ch"),
    "trade_ledger": Query(m.booked, ("symbol", "session", "exit_ts"), ("units", "cash_before", "cash_after"), "booked"),
    "compounded_ledger": Query(lambda s, d: m.booked(s, d, "current"), ("symbol", "session", "exit_ts"), ("cash_after",), "compounded"),
    "equity_curve": Query(m.curve, ("symbol", "ts", "session", "in_position"), ("cash", "equity"), "eq"),
    "performance": Query(
        m.all_figures,
        ("symbol", "trades"),
        ("final_equity", "total_return_pct", "cagr_pct", "sharpe", "sortino", "max_drawdown_pct", "exposure_pct", "gross_profit", "gross_loss", "expectancy", "net_pnl", "win_rate_pct", "profit_factor"),
        "fig",
    ),
    "yearly_performance": Query(
        lambda s, d: metrics.yearly(m.curve(s, d), m.booked(s, d), m.CASH, ["symbol"]), ("symbol", "year", "trades"), ("start_equity", "end_equity", "return_pct", "max_drawdown_pct", "net_pnl"), "year_fig"
    ),
    "session_returns": Query(m.daily_returns, ("symbol", "session"), ("ret",), "day_ret"),
    "daily_performance": Query(lambda s, d: metrics.daily_figures(m.daily_returns(s, d), ["symbol"]), ("symbol", "sessions"), ("sharpe", "sortino", "max_drawdown", "growth"), "day_fig"),
    "buy_and_hold": Query(lambda s, d: trades.buy_and_hold(m.tagged(s, d), costs=m.COSTS), ("symbol",), ("entry_price", "exit_price", "net_pnl"), "hold"),
    "parameter_sweep": Query(m.sweep, ("symbol", "channel_bars", "side_mode", "trades"), ("expectancy", "net_pnl", "win_rate_pct"), "sweep"),
    "session_folds": Query(lambda s, d: folds.session_folds(m.tagged(s, d), 8, 4, 4, ["symbol"]), ("symbol", "fold", "role", "session"), (), "session_folds"),
    "fold_choices": Query(m.chosen, ("symbol", "fold", "role", "params"), ("r",), "chosen"),
    "best_parameters": Query(
        lambda s, d: folds.best(m.chosen(s, d).filter("role = 'train'").withColumnRenamed("r", "score"), ["symbol", "fold"], "params").withColumnRenamed("params", "best"), ("symbol", "fold", "best"), (), "best"
    ),
    "month_folds": Query(m.month_folds, ("symbol", "fold", "role", "session"), (), "month_folds"),
    "regime_labels": Query(m.labelled, ("symbol", "session", "regime"), ("volatility",), "labelled"),
    "regime_scores": Query(m.regime_scores, ("symbol", "candidate", "regime", "sessions", "trades"), ("score",), "regime_scores"),
    "regime_library": Query(m.regime_library, ("symbol", "regime", "candidate"), (), "library"),
    "routing_schedule": Query(m.routing, ("symbol", "session", "candidate"), (), "routes"),
    "block_scores": Query(m.block_scores, ("key", "reason"), ("score", "max_drawdown"), "block_scores"),
    "lineitem_daily_bars": Query(m.order_months, ("symbol", "ts"), OHLCV, "line_days", 8),
    "out_of_sample_policies": Query(m.out_of_sample, ("symbol", "policy", "cost", "session", "candidate"), ("ret",), "policy_rows"),
    "policy_capital": Query(
        lambda s, d: m.out_of_sample(s, d).groupBy("symbol", "policy", "cost").agg(F.max_by("cash", "session").alias("growth")).withColumn("growth", F.col("growth") / m.CASH),
        ("symbol", "policy", "cost"), ("growth",), "policy_growth",
    ),
    "fold_capital": Query(m.holdings, ("symbol", "params", "fold"), ("start_cash", "end_cash"), "fold_cash"),
    "fold_summary": Query(lambda s, d: reports.fold_summary(m.fold_results(s, d), ["symbol", "params"]), ("symbol", "params", "folds", "winning_folds"), ("mean_return", "median_return", "worst_return"), "fold_sum"),
    "parameter_stability": Query(lambda s, d: folds.stability(m.best_lengths(s, d), ["symbol"], ["channel_bars"]), ("symbol", "parameter", "distinct_values", "most_common", "changes"), ("share",), "stable"),
    "walk_forward": Query(m.walk, ("symbol", "fold", "params", "optimised"), ("result",), "walked"),
    "router_gate": Query(m.gated, ("symbol", "accepted", "reason"), ("mean_diff", "low", "high"), "router_gate", more=GATE),
    "monte_carlo": Query(m.monte_carlo, ("symbol", "method", "sims"), ("least", "p05", "median", "p95", "most"), "sims", more=SIMS),
    "wilder_average_over_gaps": Query(
        lambda s, d: breakout.recurrence(breakout.with_true_range(m.tagged(s, d)).withColumn("x", F.when(F.hour("ts") % 3 != 0, F.col("true_range"))), "x", "rma", ["symbol"], "ts", 14).filter("rma IS NOT NULL"),
        ("symbol", "ts"), ("rma",), "rma_gaps", more=GAPS,
    ),
    "gated_trades": Query(m.gated_trades, ("symbol", "session", "use_bands", "use_vwap", "use_atr_buffer", "side", "entry_ts", "exit_ts"), ("factor", "net_points"), "gate_trades", more=GATED),
    "gate_ablation": Query(m.ablation, ("symbol", "variant", "trades"), ("factor", "net_pnl", "net_pnl_difference"), "ablation", more=GATED),
    "initial_risk_ledger": Query(lambda s, d: m.booked(s, d, "initial"), ("symbol", "session", "exit_ts"), ("units", "cash_before", "cash_after"), "at_risk", more=AT_RISK),
    "walk_forward_figures": Query(m.walk_figures, ("symbol", "trades"), ("final_equity", "max_drawdown_pct", "exposure_pct", "net_pnl"), "walk_fig", more=WALK),
    "benchmark_equity": Query(lambda s, d: trades.hold_equity(m.tagged(s, d), trades.buy_and_hold(m.tagged(s, d), costs=m.COSTS), m.CASH, costs=m.COSTS), ("symbol", "ts"), ("equity",), "hold_curve", more=PLAIN),
    "last_session": Query(lambda s, d: bars.one_session(bars.select_session(m.tagged(s, d))), ("symbol", "ts", "session", "bucket"), OHLCV, "last_day", more=PLAIN),
    "dated_bars": Query(lambda s, d: bars.between_dates(m.tagged(s, d), date(2024, 1, 10), date(2024, 1, 20)), ("symbol", "ts", "session", "bucket"), OHLCV, "dated", more=PLAIN),
    "session_closes": Query(lambda s, d: selection.last_closes(m.tagged(s, d)), ("symbol", "session"), ("close",), "closes", more=PLAIN),
    "lookback_sessions": Query(lambda s, d: folds.lookback_window(m.month_folds(s, d), m.history(s, d), 3), ("symbol", "fold", "session"), (), "look_back", more=PLAIN),
    "robust_finalists": Query(m.finalists, ("symbol", "fold", "params_id", "rank"), ("score",), "finals", more=ROBUST),
    "robust_routes": Query(m.robust_routes, ("symbol", "fold", "role", "session", "candidate", "general"), (), "rroutes", more=ROBUST),
    "gate_replay": Query(m.replayed, ("symbol", "fold", "policy", "session", "trades"), ("cash_before", "cash_after", "ret"), "gdays", more=ROBUST),
    "robust_gate": Query(m.robust_gate, ("symbol", "fold", "accepted", "reason", "trades"), ("mean_diff", "low", "high", "router_drawdown", "general_drawdown"), "ggate", more=ROBUST),
    "robust_walk_forward": Query(m.robust_walk, ("symbol", "fold", "policy", "cost", "session", "candidate", "routed"), ("ret", "cash"), "rwalk", more=ROBUST),
    "state_filter": Query(m.state_filter, ("symbol", "ts", "part", "state", "status", "allowed"), ("net_r",)),
    "bands_by_lookback": Query(lambda s, d: bands.bands_by_lookback(m.sigma_rows(s, d), LOOKBACKS), ("symbol", "session", "lookback", "direction"), BANDS, "by_lookback", more=BY_LOOKBACK),
    "search_trials": Query(m.search_trials, ("symbol", "fold", "trial", "point", "channel_bars", "band_sessions", "break_even"), ("atr_multiple", "reward"), "search_trials", more=TRIALS),
    "trial_neighbours": Query(
        lambda s, d: m.trial_neighbours(s, d).withColumnRenamed("point", "origin"), ("symbol", "fold", "trial", "origin", "near", "channel_bars", "band_sessions", "break_even"), ("atr_multiple", "reward"), "trial_near", more=TRIALS
    ),
    "bar_features": Query(m.bar_features, ("symbol", "ts"), breakout.FEATURES, "feats", 8, more=FEATURES),
    "candidate_parts": Query(m.candidate_parts, ("symbol", "ts", "session", "part"), ("net_r", *breakout.FEATURES), "parts", more=FEATURES),
    "state_policy": Query(m.state_policy, ("symbol", "ts", "part", "state", "status", "allowed"), ("net_r",), "policy", more=FEATURES),
    "state_verdicts": Query(m.state_verdicts, ("symbol", "n", "allowed", "status"), ("baseline", "filtered", "allow_rate", "improvement"), "verdicts", more=FEATURES),
    "path_highlights": Query(m.path_highlights, ("symbol", "method", "worst", "median", "best"), (), "highlights", more=f"{SIMS}, {HIGHLIGHTS}"),
    "drawn_paths": Query(m.drawn_paths, ("symbol", "sim", "step"), ("equity",), "drawn", more=f"{SIMS}, {HIGHLIGHTS}"),
    "path_bands": Query(m.path_bands, ("symbol", "step", "sims"), ("p05", "median", "p95")),
    "walk_summary": Query(m.walk_summary, ("symbol", "folds", "winning_folds"), ("mean_return", "median_return", "worst_return", "final_equity", "max_drawdown_pct"), "walk_sum", more=f"{WALK}, {SUMMARIES}"),
    "stability_by_symbol": Query(m.stability_by_symbol, ("parameter",), m.SYMBOLS, "stable_wide", more=f"{WALK}, {SUMMARIES}"),
    "return_faults": Query(m.return_faults, ("symbol", "candidate", "fault"), (), "faults", more=f"{WALK}, {SUMMARIES}"),
    "search_blocks": Query(lambda s, d: folds.with_blocks(m.month_folds(s, d), "search", 3), ("symbol", "fold", "session", "block"), (), "search_blocks", more=f"{WALK}, {SUMMARIES}"),
    "trade_sessions": Query(lambda s, d: reports.with_session(m.booked(s, d), m.tagged(s, d)), ("symbol", "entry_ts", "session"), (), "trade_days", more=f"{WALK}, {SUMMARIES}"),
    "one_band_row": Query(lambda s, d: bands.one_band_row(m.banded(s, d).filter("symbol = 'view'"), date(2024, 1, 20)), ("symbol", "session", "direction"), ("sigma", *BANDS), "one_row", more=f"{WALK}, {SUMMARIES}"),
    "bars_of_sessions": Query(lambda s, d: bars.in_sessions(m.tagged(s, d), bars.sessions_of(m.valid(s, d))), ("symbol", "ts", "session", "bucket"), OHLCV, "held_days", more=f"{WALK}, {SUMMARIES}"),
    "stop_fallbacks": Query(m.stop_fallbacks, ("symbol", "session", "ts", "side"), ("stop", "target"), "fallbacks", more=f"{WALK}, {SUMMARIES}"),
    "policy_summary": Query(lambda s, d: reports.state_summary(m.state_policy(s, d), ["symbol"]), ("symbol", "candidates", "allowed", "valid"), ("allowed_rate",), "policy_sum", more=f"{FEATURES}, {LET}"),
    "allowed_signals": Query(lambda s, d: m.allowed_signals(s, d).withColumnRenamed("trigger", "trigger_level"), ("symbol", "session", "ts", "side"), ("stop", "target", "trigger_level"), "let_signals", more=f"{FEATURES}, {LET}"),
    "band_shapes": Query(lambda s, d: bands.band_shapes(m.banded(s, d)), ("symbol", "session", "label", "kind"), ("low", "high"), "shapes", more=SHAPES),
    "stitched_returns": Query(m.stitched_returns, ("symbol", "session"), ("ret",), "walk_ret", more=f"{WALK}, {RETURNS}"),
    "decision_log": Query(m.decision_log, ("symbol", "fold", "policy", "cost", "session", "candidate", "routed", "regime", "gate_reason"), ("starting_cash", "cash", "daily_return"), "decisions", more=f"{ROBUST}, {DECISIONS}"),
    "month_finalists": Query(months.finalists, ("symbol", "fold", "params_id", "rank"), ("score",), "finals", more=MONTHS),
    "month_routes": Query(months.routes, ("symbol", "fold", "role", "session", "candidate", "general"), (), "rroutes", more=MONTHS),
    "month_gate": Query(months.gate, ("symbol", "fold", "accepted", "reason"), ("mean_diff", "low", "high"), "ggate", more=MONTHS),
    "month_walk_forward": Query(months.walk, ("symbol", "fold", "policy", "cost", "session", "candidate", "routed", "traded"), ("ret",), "mwalk", more=MONTHS),
    "month_series": Query(months.series_figures, ("symbol", "policy", "cost", "sessions", "trades"), ("final_cash", "max_drawdown"), "mfigures", 4, more=MONTHS),
    "filter_models": Query(m.filter_models, ("symbol", "fold", "channel_bars", "n", "status", "rounds"), ("log_evidence",)),
    "filtered_candidates": Query(m.filtered_candidates, ("symbol", "fold", "channel_bars", "session", "ts", "state", "status", "allowed")),
    "walk_forward_filtered": Query(m.walk_with_filter, ("symbol", "source", "trades"), ("final_equity", "max_drawdown_pct", "exposure_pct", "net_pnl")),
    "content_fingerprint": Query(m.content, ("rows", "hash_sum", "digest"), (), "content", more=CONTENT),
    "content_tree": Query(m.content_tree, ("level", "session", "symbol", "rows", "digest"), (), "content_tree", more=CONTENT),
    "appended_bands": Query(m.appended_bands, ("symbol", "session", "direction"), ("sigma", *BANDS), "banded"),
}
FLAGSHIP = "session_bands"


def _plan(q: Query) -> Callable[..., DataFrame]:
    # dates leave as text, which reads the same everywhere
    def run(spark, sf_dir: str) -> DataFrame:
        exact = [F.col(c).cast("string").alias(c) if c == "session" else F.col(c) for c in q.exact]
        with m.one_state():
            out = q.plan(spark, sf_dir)
            types = dict(out.dtypes)
            rounded = {c: F.round(c, q.digits) for c in q.rounded}
            rounded = {c: x + F.lit(0.0) if types[c] == "double" else x for c, x in rounded.items()}  # a rounded -0.0 is 0.0
            return out.select(*exact, *[x.alias(c) for c, x in rounded.items()])

    return run


def _sql(q: Query) -> str:
    exact = [f"CAST({c} AS VARCHAR) AS {c}" if c == "session" else c for c in q.exact]
    columns = ", ".join([*exact, *[f"round(CAST({c} AS DOUBLE), {q.digits}) + 0.0::DOUBLE AS {c}" for c in q.rounded]])
    chain = ", ".join(x.strip() for x in (CHAIN, q.more) if x)
    return f"WITH RECURSIVE {chain} SELECT {columns} FROM {q.source}"


QUERIES = {name: _plan(q) for name, q in ALL.items()}
ORACLES = {name: _sql(q) for name, q in ALL.items() if q.source}
