"""The catalog's queries as DuckDB SQL over the same tables."""

from __future__ import annotations

CTES = {
    "a": """SELECT 'CLOCK_A' AS instrument, e.event_id AS i, 2000 + 0.05::DOUBLE * e.value AS o, 2000 + 0.05::DOUBLE * n.value AS c FROM events e JOIN events n ON n.event_id = e.event_id + 1
        UNION ALL SELECT 'CLOCK_B', e.event_id, 2000 + 0.05::DOUBLE * (e.user_id % 100), 2000 + 0.05::DOUBLE * (n.user_id % 100) FROM events e JOIN events n ON n.event_id = e.event_id + 1""",
    "c1": """SELECT instrument, 'clock' AS source, i, TIMESTAMP '2024-01-01' + to_minutes(i) AS t, o, greatest(o, c) + 0.01::DOUBLE * (i % 7) AS h, least(o, c) - 0.01::DOUBLE * (i % 5) AS l, c
        FROM a WHERE i % 997 <> 500 AND NOT (i % 5000 BETWEEN 2000 AND 2180)""",
    "s1": """SELECT *, min(t) OVER (PARTITION BY instrument, g) AS seg, row_number() OVER (PARTITION BY instrument, g ORDER BY t) - 1 AS pos FROM (SELECT *, sum(k) OVER (PARTITION BY instrument ORDER BY t) AS g FROM
        (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY instrument ORDER BY t) = INTERVAL 1 MINUTE THEN 0 ELSE 1 END AS k FROM c1))""",
    "cand": "SELECT instrument, t + INTERVAL 3 MINUTE AS pt FROM b3",
    "f3": """SELECT *, t + INTERVAL 3 MINUTE AS pt, lag(t, 20) OVER w AS fw, lag(r, 1) OVER w AS r1, lag(r, 2) OVER w AS r2, lag(r, 3) OVER w AS r3,
        1e4 * (ln(c) - ln(lag(c, 5) OVER w)) AS m5, 1e4 * (ln(c) - ln(lag(c, 20) OVER w)) AS m20,
        CASE WHEN count(r) OVER w20 = 20 THEN sqrt(sum(r * r) OVER w20) END AS rv20,
        CASE WHEN count(c) OVER p5 = 5 THEN 1e4 * (ln(c) - ln(avg(c) OVER p5)) END AS sma5, CASE WHEN count(c) OVER p20 = 20 THEN 1e4 * (ln(c) - ln(avg(c) OVER p20)) END AS sma20
        FROM (SELECT *, 1e4 * (ln(c) - ln(lag(c) OVER (PARTITION BY instrument, g ORDER BY t))) AS r FROM sb3)
        WINDOW w AS (PARTITION BY instrument, g ORDER BY t), w20 AS (PARTITION BY instrument, g ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
        p5 AS (PARTITION BY instrument, g ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), p20 AS (PARTITION BY instrument, g ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    "feat": """SELECT instrument, pt, fw, r, r1, r2, r3, 1e4 * (c - o) / o AS body, 1e4 * (h - l) / o AS rng, 1e4 * (h - greatest(o, c)) / o AS upw, 1e4 * (least(o, c) - l) / o AS low,
        CASE WHEN h = l THEN 0.5 ELSE (c - l) / (h - l) END AS cp, m5, m20, rv20, sma5, sma20, 2 * pi() * (hour(pt) + minute(pt) / 60.0::DOUBLE) / 24 AS ha, 2 * pi() * (isodow(pt) - 1) / 7 AS wa
        FROM f3 WHERE fw IS NOT NULL AND r3 IS NOT NULL AND m20 IS NOT NULL AND rv20 IS NOT NULL AND sma20 IS NOT NULL""",
    "q1": "SELECT *, 1e4 * (ln(o) - ln(lag(o) OVER (PARTITION BY instrument, g ORDER BY t))) AS r FROM s1",
    "l15": """SELECT *, 1e4 * (ln(xo) - ln(eo)) AS fr, 1e4 * (xo / eo - 1) AS ar, 1e4 * (hi - lo) / eo AS frng, sqrt(v) AS fvol,
        CASE WHEN 1e4 * (ln(xo) - ln(eo)) < -6 THEN 'down' WHEN 1e4 * (ln(xo) - ln(eo)) > 6 THEN 'up' ELSE 'neutral' END AS cls FROM
        (SELECT cand.instrument, cand.pt, e.t AS et, e.t + INTERVAL 15 MINUTE AS le, e.o AS eo, e.xo, e.hi, e.lo, e.v FROM cand JOIN
         (SELECT *, lead(o, 15) OVER w AS xo, max(h) OVER (PARTITION BY instrument, g ORDER BY t ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS hi, min(l) OVER (PARTITION BY instrument, g ORDER BY t ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS lo,
          sum(r * r) OVER (PARTITION BY instrument, g ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS v FROM q1 WINDOW w AS (PARTITION BY instrument, g ORDER BY t)) e
         ON e.instrument = cand.instrument AND e.t = cand.pt + INTERVAL 1 MINUTE WHERE e.xo IS NOT NULL)""",
    "pred": """SELECT *, CASE WHEN m5 < -2 THEN top ELSE rest END AS pd, CASE WHEN m5 > 2 OR m5 < -2 THEN rest ELSE top END AS pn, CASE WHEN m5 > 2 THEN top ELSE rest END AS pu, 0.3::DOUBLE * m5 AS er,
        CASE WHEN m5 < -2 THEN 'down' WHEN m5 > 2 THEN 'up' ELSE 'neutral' END AS said FROM
        (SELECT *, (1 - top) / 2 AS rest FROM (SELECT feat.*, l15.* EXCLUDE (instrument, pt), 0.34::DOUBLE + 0.6::DOUBLE * abs(m5) / (abs(m5) + 20) AS top FROM feat JOIN l15 USING (instrument, pt)))""",
    "dec": """SELECT *, CASE WHEN said = 'up' THEN 1.0::DOUBLE WHEN said = 'down' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS sgn FROM pred""",
    "tr": """SELECT * FROM dec JOIN (SELECT instrument, pt FROM chain) USING (instrument, pt)""",
}


def bars(k: int) -> str:
    return f"SELECT instrument, 'clock' AS source, time_bucket(INTERVAL '{k} minutes', t) AS t, arg_min(o, t) AS o, max(h) AS h, min(l) AS l, arg_max(c, t) AS c FROM c1 GROUP BY ALL HAVING count(*) = {k}"


def runs(k: int) -> str:
    return f"SELECT *, sum(k) OVER (PARTITION BY instrument ORDER BY t) AS g FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY instrument ORDER BY t) = INTERVAL '{k} minutes' THEN 0 ELSE 1 END AS k FROM b{k})"


def signals(cost: float, confidence: float, edge: float) -> dict[str, str]:
    """Non-overlapping trades: each signal points at the first that enters when it has ended; the chain is followed."""
    return {
        "sig": f"SELECT instrument, pt, et, le, row_number() OVER (PARTITION BY instrument ORDER BY pt) AS k FROM dec WHERE said <> 'neutral' AND top >= {confidence} AND sgn * er > 0 AND sgn * er - {cost} > {edge}",
        "nxt": "SELECT s.instrument, s.pt, s.k, n.k AS nk FROM sig s ASOF LEFT JOIN sig n ON s.instrument = n.instrument AND s.le <= n.et",
        "chain": "SELECT instrument, pt, k, nk FROM nxt WHERE k = 1 UNION ALL SELECT n.instrument, n.pt, n.k, n.nk FROM chain c JOIN nxt n ON n.instrument = c.instrument AND n.k = c.nk",
    }


def sql(names: str, select: str, extra: dict[str, str] | None = None) -> str:
    known = CTES | {f"b{k}": bars(k) for k in (3, 5, 15, 30, 60, 180)} | {f"sb{k}": runs(k) for k in (3, 5, 15)} | (extra or {})
    recursive = "RECURSIVE " if "chain" in names.split() else ""
    return f"WITH {recursive}" + ", ".join(f"{n} AS ({known[n]})" for n in names.split()) + " " + select


def r(x: str, name: str = "") -> str:
    return f"round({x}, 4) + 0.0 AS {name or x}"


FEAT = "a c1 b3 sb3 f3 feat"
PRED = "a c1 s1 b3 sb3 f3 feat cand q1 l15 pred"
BASE = signals(4.0, 0.5, -2.0)
STRESS = signals(5.5, 0.5, -2.0)
TRADES = f"{PRED} dec sig nxt chain tr"
ORACLE_SQL: dict[str, str] = {}


def bar_select(k: int, name: str) -> str:
    return f"SELECT instrument, source, '{name}' AS timeframe, t AS timestamp_open_utc, t + INTERVAL '{k} minutes' AS timestamp_close_utc, {r('o', 'bid_open')}, {r('h', 'bid_high')}, {r('l', 'bid_low')}, {r('c', 'bid_close')} FROM "


ORACLE_SQL["candles_1min"] = sql("a c1", bar_select(1, "1min") + "c1")
for _k, _n in ((3, "3min"), (5, "5min"), (15, "15min"), (30, "30min"), (60, "1h"), (180, "3h")):
    ORACLE_SQL[f"resample_{_n}"] = sql(f"a c1 b{_k}", bar_select(_k, _n) + f"b{_k}")

TICKS = {"tk": "SELECT event_type AS instrument, 'ticks' AS source, date_trunc('hour', ts) AS t, arg_min(p, k) AS o, max(p) AS h, min(p) AS l, arg_max(p, k) AS c FROM (SELECT *, 2000 + 0.05::DOUBLE * value AS p, row_number() OVER (ORDER BY ts, event_id) AS k FROM events) GROUP BY ALL"}
ORACLE_SQL["candles_ticks_1h"] = sql("tk", bar_select(60, "1h") + "tk", TICKS)
ORACLE_SQL["resample_windows_1mo"] = sql("tk", f"SELECT instrument, date_trunc('month', t)::TIMESTAMP AS window_open, (date_trunc('month', t) + INTERVAL 1 MONTH)::TIMESTAMP AS window_close, {r('arg_min(o, t)', 'bid_open')}, {r('max(h)', 'bid_high')}, {r('min(l)', 'bid_low')}, {r('arg_max(c, t)', 'bid_close')}, count(*) AS n_bars, CAST(epoch(date_trunc('month', min(t)) + INTERVAL 1 MONTH - date_trunc('month', min(t))) / 3600 AS BIGINT) AS n_expected FROM tk GROUP BY instrument, date_trunc('month', t)", TICKS)
ORACLE_SQL["resample_1d_sparse"] = sql("a", f"""SELECT instrument, 'clock' AS source, '1d' AS timeframe, d AS timestamp_open_utc, d + INTERVAL 1 DAY AS timestamp_close_utc, {r('o', 'bid_open')}, {r('h', 'bid_high')}, {r('l', 'bid_low')}, {r('c', 'bid_close')} FROM
    (SELECT instrument, date_trunc('day', TIMESTAMP '2024-01-01' + to_minutes(i))::TIMESTAMP AS d, arg_min(o, i) FILTER (kept) AS o, max(greatest(o, c) + 0.01::DOUBLE * (i % 7)) FILTER (kept) AS h, min(least(o, c) - 0.01::DOUBLE * (i % 5)) FILTER (kept) AS l, arg_max(c, i) FILTER (kept) AS c, count(*) AS n
     FROM (SELECT *, i % 997 <> 500 AND NOT (i % 5000 BETWEEN 2000 AND 2180) AS kept FROM a WHERE instrument = 'CLOCK_A') GROUP BY instrument, d) WHERE n = 1440""")
ORACLE_SQL["resample_multi"] = sql("a c1 b3 b15 b60", " UNION ALL ".join(f"SELECT '{n}' AS timeframe, instrument, count(*) AS n, {r('sum(c)', 'sum_close')}, {r('max(h)', 'max_high')} FROM b{k} GROUP BY instrument" for k, n in ((3, "3min"), (15, "15min"), (60, "1h"))))
ORACLE_SQL["lineage_hash"] = sql("a c1", "SELECT instrument, time_bucket(INTERVAL '15 minutes', t) AS timestamp_open_utc, CASE WHEN count(DISTINCT i // 1000) = 1 THEN 'file' || min(i // 1000) ELSE 'sha256:' || sha256(array_to_string(list_sort(list(DISTINCT 'file' || (i // 1000))), chr(10))) END AS raw_file_hash FROM c1 GROUP BY ALL HAVING count(*) = 15")

DAMAGED = {"dm": """SELECT instrument, t, t + INTERVAL 1 MINUTE AS e, o, l, c, CASE WHEN m % 101 = 3 THEN l - 1 WHEN m % 103 = 4 THEN 'nan'::DOUBLE ELSE h END AS h, CASE WHEN m % 107 = 5 THEN false WHEN m % 109 = 6 THEN NULL ELSE true END AS ok,
    CASE WHEN m % 113 = 7 THEN ' ' ELSE source END AS source, m % 127 = 8 AS off FROM (SELECT *, epoch(t)::BIGINT // 60 AS m FROM c1)"""}
BAD = "(isnan(h) OR h < greatest(o, c) OR l > least(o, c) OR h < l)"
ORACLE_SQL["validate_counts"] = sql("a c1 dm", f"SELECT count(*) AS n_rows, count(DISTINCT 1) AS n_timeframes, count(*) FILTER (trim(source) = '') AS blank_text, count(*) FILTER (ok IS NULL OR NOT ok) AS not_complete, count(*) FILTER {BAD.replace('(', '(WHERE ', 1)} AS invalid_ohlc, count(*) FILTER (off) AS off_grid FROM dm", DAMAGED)
ORACLE_SQL["invalid_bars"] = sql("a c1 dm", f"SELECT instrument, t AS timestamp_open_utc FROM dm WHERE {BAD}", DAMAGED)
REPEATED = {"rp": "SELECT * FROM (SELECT instrument, t, o, h, l, c, epoch(t)::BIGINT // 60 AS m FROM c1 WHERE instrument = 'CLOCK_A') UNION ALL SELECT * FROM (SELECT instrument, t, o, h, l, c, epoch(t)::BIGINT // 60 AS m FROM c1 WHERE instrument = 'CLOCK_A') WHERE m % 50 = 0 UNION ALL SELECT * FROM (SELECT instrument, t, o, h, l, c + 1, epoch(t)::BIGINT // 60 AS m FROM c1 WHERE instrument = 'CLOCK_A') WHERE m % 75 = 0"}
ORACLE_SQL["conflict_keys"] = sql("a c1 rp", "SELECT instrument, t AS timestamp_open_utc, count(*) AS n_rows, count(DISTINCT c) AS n_different FROM rp GROUP BY ALL HAVING count(*) > 1", REPEATED)
ORACLE_SQL["dedup_identical"] = sql("a c1 rp", f"SELECT count(*) AS n, {r('sum(c)', 'sum_close')} FROM (SELECT DISTINCT * FROM rp)", REPEATED)
GAPS = "SELECT instrument, source, lag(t) OVER (PARTITION BY instrument ORDER BY t) + INTERVAL 1 MINUTE AS gap_start_utc, t AS gap_end_utc FROM c1"
ORACLE_SQL["gap_report"] = sql("a c1", f"SELECT *, CAST(epoch(gap_end_utc - gap_start_utc) / 60 AS BIGINT) AS missing_bars FROM ({GAPS}) WHERE gap_start_utc < gap_end_utc")
ORACLE_SQL["gap_summary"] = sql("a c1", f"SELECT instrument, count(*) AS n_gaps, CAST(sum(epoch(gap_end_utc - gap_start_utc) / 60) AS BIGINT) AS missing FROM ({GAPS}) WHERE gap_start_utc < gap_end_utc GROUP BY instrument")
ORACLE_SQL["coverage"] = sql("a c1 b3 b15", "SELECT '3min' AS timeframe, count(*) AS n_rows, min(t) AS first_open_utc, max(t) + INTERVAL 3 MINUTE AS last_close_utc FROM b3 UNION ALL SELECT '15min', count(*), min(t), max(t) + INTERVAL 15 MINUTE FROM b15")
ORACLE_SQL["segments"] = sql("a c1 s1", "SELECT instrument, seg, count(*) AS n, max(pos) AS last_pos FROM s1 GROUP BY instrument, seg")
ORACLE_SQL["session_windows"] = sql("a c1 s1", "SELECT instrument, seg AS start_utc, max(t) + INTERVAL 1 MINUTE AS end_utc, count(*) AS n FROM s1 GROUP BY instrument, seg")
FEATURES = [("r", "close_log_return_1_bps"), ("r1", "close_log_return_lag_1_bps"), ("r2", "close_log_return_lag_2_bps"), ("r3", "close_log_return_lag_3_bps"), ("body", "candle_body_bps"), ("rng", "candle_range_bps"), ("upw", "upper_wick_bps"), ("low", "lower_wick_bps"), ("cp", "close_position"), ("m5", "momentum_5_bps"), ("m20", "momentum_20_bps"), ("rv20", "realized_volatility_20_bps"), ("sma5", "distance_to_sma_5_bps"), ("sma20", "distance_to_sma_20_bps"), ("sin(ha)", "hour_sin"), ("cos(ha)", "hour_cos"), ("sin(wa)", "weekday_sin"), ("cos(wa)", "weekday_cos")]
ORACLE_SQL["features_mvp"] = sql(FEAT, f"SELECT instrument, pt AS prediction_time_utc, fw AS feature_window_start_utc, {', '.join(r(*x) for x in FEATURES)} FROM feat")
ORACLE_SQL["session_flags"] = sql("a c1 b3", f"""SELECT instrument, pt AS prediction_time_utc, {r('sin(2 * pi() * (month(pt) - 1) / 12)', 'month_sin')}, {r('cos(2 * pi() * (month(pt) - 1) / 12)', 'month_cos')}, {r('sin(2 * pi() * minute(pt) / 60)', 'minute_sin')}, {r('cos(2 * pi() * minute(pt) / 60)', 'minute_cos')},
    {', '.join(f"CAST(hour(pt) >= {a} AND hour(pt) < {b} AS DOUBLE) AS session_{k}" for k, a, b in (("asia", 0, 8), ("europe", 7, 16), ("us", 13, 22), ("overlap", 13, 16)))} FROM (SELECT *, t + INTERVAL 3 MINUTE AS pt FROM b3)""")


def block(k: int, windows: tuple[int, ...]) -> dict[str, str]:
    """Price block of one timeframe as x<k>, columns without the prefix."""
    w, n = max(windows), max(4, max(windows))
    per = ", ".join(f"1e4 * (ln(c) - ln(lag(c, {x}) OVER w)) AS momentum_{x}_bps, CASE WHEN count(r) OVER v{x} = {x} THEN sqrt(sum(r * r) OVER v{x}) END AS realized_volatility_{x}_bps" for x in windows)
    frames = ", ".join(f"v{x} AS (PARTITION BY instrument, g ORDER BY t ROWS BETWEEN {x - 1} PRECEDING AND CURRENT ROW)" for x in windows)
    return {f"x{k}": f"""SELECT * FROM (SELECT instrument, t + INTERVAL '{k} minutes' AS av, r AS log_return_1_bps, lag(r, 1) OVER w AS log_return_lag_1_bps, lag(r, 2) OVER w AS log_return_lag_2_bps, lag(r, 3) OVER w AS log_return_lag_3_bps,
        1e4 * (c - o) / o AS candle_body_bps, 1e4 * (h - l) / o AS candle_range_bps, 1e4 * (h - greatest(o, c)) / o AS upper_wick_bps, 1e4 * (least(o, c) - l) / o AS lower_wick_bps, CASE WHEN h = l THEN 0.5 ELSE (c - l) / (h - l) END AS close_position, {per},
        CASE WHEN count(c) OVER pw = {w} THEN 1e4 * (ln(c) - ln(avg(c) OVER pw)) END AS distance_to_sma_{w}_bps, CASE WHEN count(c) OVER pw = {w} AND stddev_pop(c) OVER pw > 1e-9 THEN (c - avg(c) OVER pw) / stddev_pop(c) OVER pw END AS price_zscore_{w},
        CASE WHEN count(c) OVER pw = {w} AND max(h) OVER pw > min(l) OVER pw THEN (c - min(l) OVER pw) / (max(h) OVER pw - min(l) OVER pw) END AS breakout_position_{w}, lag(t, {n}) OVER w AS st
        FROM (SELECT *, 1e4 * (ln(c) - ln(lag(c) OVER (PARTITION BY instrument, g ORDER BY t))) AS r FROM sb{k})
        WINDOW w AS (PARTITION BY instrument, g ORDER BY t), pw AS (PARTITION BY instrument, g ORDER BY t ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), {frames})
        WHERE st IS NOT NULL AND price_zscore_{w} IS NOT NULL AND breakout_position_{w} IS NOT NULL AND log_return_lag_3_bps IS NOT NULL"""}


BLOCK = ["log_return_1_bps", "log_return_lag_1_bps", "log_return_lag_2_bps", "log_return_lag_3_bps", "candle_body_bps", "candle_range_bps", "upper_wick_bps", "lower_wick_bps", "close_position"]
ORACLE_SQL["price_block_15min"] = sql("a c1 b15 sb15 x15", "SELECT instrument, av AS available_at_utc, " + ", ".join(r(c, f"p7_15min_{c}") for c in [*BLOCK, *[f"{m}_{k}_bps" for k in (2, 4, 8, 16) for m in ("momentum", "realized_volatility")], "distance_to_sma_16_bps", "price_zscore_16", "breakout_position_16"]) + " FROM x15", block(15, (2, 4, 8, 16)))
ASOF = "a c1 b3 b15 sb15 x15"
ORACLE_SQL["asof_features"] = sql(ASOF, f"""SELECT instrument, pt AS prediction_time_utc, CASE WHEN ok THEN {'round(log_return_1_bps, 4) + 0.0'} END AS p7_15min_log_return_1_bps, CASE WHEN ok THEN round(price_zscore_4, 4) + 0.0 END AS p7_15min_price_zscore_4, CASE WHEN ok THEN av END AS asof_15min_utc FROM
    (SELECT l.instrument, l.t + INTERVAL 3 MINUTE AS pt, x.log_return_1_bps, x.price_zscore_4, x.av, l.t + INTERVAL 3 MINUTE - x.av <= INTERVAL 15 MINUTE AS ok FROM b3 l ASOF LEFT JOIN x15 x ON l.instrument = x.instrument AND l.t + INTERVAL 3 MINUTE >= x.av)""", block(15, (2, 4)))
ORACLE_SQL["asof_tolerance"] = sql(ASOF, """SELECT instrument, pt AS prediction_time_utc, CASE WHEN ok THEN round(log_return_1_bps, 4) + 0.0 END AS p7_15min_log_return_1_bps, CASE WHEN ok THEN av END AS asof_utc FROM
    (SELECT l.instrument, l.t + INTERVAL 3 MINUTE AS pt, x.log_return_1_bps, x.av, l.t + INTERVAL 3 MINUTE - x.av <= INTERVAL 40 MINUTE AS ok FROM b3 l ASOF LEFT JOIN x15 x ON l.instrument = x.instrument AND l.t + INTERVAL 3 MINUTE >= x.av)""", block(15, (2, 4)))
REGIME = {
    "sf": "SELECT *, sum(k) OVER (PARTITION BY instrument ORDER BY pt) AS g2 FROM (SELECT *, CASE WHEN pt - lag(pt) OVER (PARTITION BY instrument ORDER BY pt) = INTERVAL 3 MINUTE THEN 0 ELSE 1 END AS k FROM feat)",
    "rg": """SELECT *, m20 / nullif(rv20, 0) AS ts, abs(r) / nullif(sc, 0) AS ss FROM (SELECT *, CASE WHEN count(rv20) OVER p80 = 80 THEN quantile_cont(rv20, 1.0::DOUBLE / 3) OVER p80 END AS lo, CASE WHEN count(rv20) OVER p80 = 80 THEN quantile_cont(rv20, 2.0::DOUBLE / 3) OVER p80 END AS hi,
        CASE WHEN count(r) OVER q20 = 20 THEN quantile_cont(abs(r), 0.5) OVER q20 END AS sc FROM sf WINDOW p80 AS (PARTITION BY instrument, g2 ORDER BY pt ROWS BETWEEN 80 PRECEDING AND 1 PRECEDING), q20 AS (PARTITION BY instrument, g2 ORDER BY pt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""",
}
FLAGS = "CAST(rv20 < lo AS DOUBLE) AS regime_volatility_low, CAST(rv20 BETWEEN lo AND hi AS DOUBLE) AS regime_volatility_mid, CAST(rv20 > hi AS DOUBLE) AS regime_volatility_high, round(ts, 4) + 0.0 AS regime_trend_score, CAST(ts < -1 AS DOUBLE) AS regime_trend_down, CAST(abs(ts) <= 1 AS DOUBLE) AS regime_trend_range, CAST(ts > 1 AS DOUBLE) AS regime_trend_up, round(ss, 4) + 0.0 AS regime_shock_score, CAST(ss >= 3 AS DOUBLE) AS regime_shock"
ORACLE_SQL["regime_features"] = sql(FEAT + " sf rg", f"SELECT instrument, pt AS prediction_time_utc, {FLAGS} FROM rg", REGIME)
WIDE = [("m20", "momentum_20_bps"), ("z5", "p7_5min_price_zscore_5"), ("bk", "p7_15min_breakout_position_4"), ("ts", "regime_trend_score")]
ORACLE_SQL["features_wide"] = sql(FEAT + " b5 sb5 x5 b15 sb15 x15 sf rg", f"""SELECT instrument, CAST(pt AS DATE) AS day, count(*) AS n_rows, {', '.join(f'count({a}) AS n_{b}, round(avg({a}), 4) + 0.0 AS avg_{b}' for a, b in WIDE)} FROM
    (SELECT rg.instrument, rg.pt, rg.m20, rg.ts, CASE WHEN rg.pt - y.av <= INTERVAL 5 MINUTE THEN y.price_zscore_5 END AS z5, CASE WHEN rg.pt - x.av <= INTERVAL 15 MINUTE THEN x.breakout_position_4 END AS bk
     FROM rg ASOF LEFT JOIN x5 y ON rg.instrument = y.instrument AND rg.pt >= y.av ASOF LEFT JOIN x15 x ON rg.instrument = x.instrument AND rg.pt >= x.av) GROUP BY ALL""", REGIME | block(5, (2, 5)) | block(15, (2, 4)))

LAB = "a c1 s1 b3 cand q1 l15"
ORACLE_SQL["label_h15"] = sql(LAB, f"SELECT instrument, pt AS prediction_time_utc, et AS entry_time_utc, le AS label_end_time_utc, CAST(15 AS INT) AS horizon_minutes, {r('eo', 'entry_bid_open')}, {r('xo', 'exit_bid_open')}, {r('fr', 'future_return_bps')}, {r('ar', 'arithmetic_return_bps')}, {r('frng', 'future_range_bps')}, {r('fvol', 'future_realized_vol_bps')}, cls AS target_class, CAST(CASE cls WHEN 'down' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS INT) AS target_class_id FROM l15")
FUTURE = {"lab": """SELECT *, 1e4 * (ln(xo) - ln(o)) AS fr, 1e4 * (hi - lo) / o AS frng, sqrt(v) AS fvol, CASE WHEN 1e4 * (ln(xo) - ln(o)) < -6 THEN 'down' WHEN 1e4 * (ln(xo) - ln(o)) > 6 THEN 'up' ELSE 'neutral' END AS cls FROM (""" + " UNION ALL ".join(
    f"SELECT instrument, t, o, {n} AS H, lead(o, {n}) OVER w AS xo, max(h) OVER (w ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS hi, min(l) OVER (w ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS lo, sum(r * r) OVER (w ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) AS v FROM q1 WINDOW w AS (PARTITION BY instrument, g ORDER BY t)"
    for n in (3, 6, 9, 12, 15, 30, 60, 180)
) + ") e SEMI JOIN cand ON cand.instrument = e.instrument AND e.t = cand.pt + INTERVAL 1 MINUTE WHERE xo IS NOT NULL"}
ORACLE_SQL["label_all_horizons"] = sql("a c1 s1 b3 cand q1 lab", f"SELECT instrument, CAST(H AS INT) AS horizon_minutes, cls AS target_class, count(*) AS n, {r('sum(fr)', 'sum_return')}, {r('sum(frng)', 'sum_range')}, {r('sum(fvol)', 'sum_vol')} FROM lab GROUP BY ALL", FUTURE)
ORACLE_SQL["label_exact_join"] = sql(LAB, f"SELECT instrument, pt AS prediction_time_utc, et AS entry_time_utc, le AS label_end_time_utc, {r('eo', 'entry_bid_open')}, {r('xo', 'exit_bid_open')} FROM l15")
SID = "instrument || '|clock|' || strftime(pt, '%Y%m%dT%H%M%S.%f') || 'Z'"
ORACLE_SQL["sample_ids"] = sql(LAB, f"SELECT {SID} AS sample_id, sha256(instrument || '|clock|' || strftime(pt, '%Y-%m-%dT%H:%M:%S') || '+00:00|15') AS sample_hash, CAST(CASE cls WHEN 'down' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS INT) AS target_class_id FROM l15")
SPAN = {"sp": "SELECT TIMESTAMP '2024-01-01' + to_minutes(CAST(min(event_id) AS BIGINT)) AS f, CAST(max(event_id) - min(event_id) + 1 AS BIGINT) AS m FROM events"}


def at(k: int, n: int) -> str:
    """The time at k n-ths of the whole series."""
    return f"(SELECT f + to_minutes(m * {k} // {n}) FROM sp)"


PARTS = SPAN | {"ds": f"""SELECT * FROM (SELECT *, CASE WHEN pt < {at(3, 5)} - INTERVAL 16 MINUTE THEN 'train' WHEN pt >= {at(3, 5)} AND pt < {at(4, 5)} - INTERVAL 16 MINUTE THEN 'validation'
    WHEN pt >= {at(4, 5)} AND pt < {at(5, 5)} - INTERVAL 16 MINUTE THEN 'test' END AS split FROM pred) WHERE split IS NOT NULL"""}
ORACLE_SQL["split_assign"] = sql(PRED + " sp ds", "SELECT instrument, split, count(*) AS n, min(pt) AS first_time, max(le) AS last_end FROM ds GROUP BY ALL", PARTS)
BLOCKS = [(f"f{i}-{n}", a, b) for i in range(3) for n, a, b in (("train", 0, 2 + i), ("calibration", 2 + i, 3 + i), ("test", 3 + i, 4 + i))]
ORACLE_SQL["walk_forward_blocks"] = sql(PRED + " sp", " UNION ALL ".join(f"SELECT '{n}' AS block, count(*) AS n, max(le) AS last_end FROM pred WHERE pt >= {at(a, 6)} AND pt < {at(b, 6)} - INTERVAL 181 MINUTE AND le < {at(b, 6)} HAVING count(*) > 0" for n, a, b in BLOCKS), SPAN)
ORACLE_SQL["holdout_violations"] = sql(PRED, "SELECT " + ", ".join(f"count(*) FILTER ({c} >= TIMESTAMP '2024-01-06') AS n_{n}" for c, n in (("pt", "prediction_time_utc"), ("et", "entry_time_utc"), ("le", "label_end_time_utc"))) + " FROM pred")
STATS = [("m5", "momentum_5_bps"), ("rv20", "realized_volatility_20_bps"), ("body", "candle_body_bps")]
TRAIN = "(SELECT CASE WHEN m5 > 30 THEN NULL ELSE m5 END AS m5, rv20, body FROM ds WHERE split = 'train')"
ORACLE_SQL["impute_scale_stats"] = sql(PRED + " sp ds", " UNION ALL ".join(f"SELECT '{n}' AS feature, {r('max(med)', 'median')}, {r('avg(coalesce(x, med))', 'mean')}, {r('CASE WHEN stddev_pop(coalesce(x, med)) = 0 THEN 1 ELSE stddev_pop(coalesce(x, med)) END', 'scale')} FROM (SELECT {c} AS x, (SELECT quantile_cont({c}, 0.5) FROM {TRAIN}) AS med FROM {TRAIN})" for c, n in STATS), PARTS)
ORACLE_SQL["feature_distribution"] = sql(PRED + " sp ds", " UNION ALL ".join(f"SELECT split, '{n}' AS feature, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, {r(f'avg({c})', 'mean')}, {r(f'stddev_pop({c})', 'std')}, {', '.join(r(f'quantile_cont({c}, {q})', k) for q, k in ((0.05, 'p05'), (0.5, 'p50'), (0.95, 'p95')))} FROM ds GROUP BY split" for c, n in STATS), PARTS)
ORACLE_SQL["mean_shift"] = sql(PRED + " sp ds", " UNION ALL ".join(f"SELECT '{n}' AS feature, round((avg({c}) FILTER (split = 'test') - avg({c}) FILTER (split = 'train')) / stddev_pop({c}) FILTER (split = 'train'), 4) + 0.0 AS mean_shift FROM ds HAVING count(*) FILTER (split = 'test') > 0 AND count(*) FILTER (split = 'train') > 0" for c, n in STATS), PARTS)
ORACLE_SQL["class_weights"] = sql(PRED, "SELECT cls AS target_class, n, round(sum(n) OVER () / (count(*) OVER () * n), 4) + 0.0 AS weight, round(n / sum(n) OVER (), 4) + 0.0 AS prior FROM (SELECT cls, count(*) AS n FROM pred GROUP BY cls)")
RULES = {"last_candle": "CASE WHEN r < -6 THEN 'down' WHEN r > 6 THEN 'up' ELSE 'neutral' END", "momentum": "CASE WHEN m20 < -6 THEN 'down' WHEN m20 > 6 THEN 'up' ELSE 'neutral' END", "mean_reversion": "CASE WHEN m20 > 6 THEN 'down' WHEN m20 < -6 THEN 'up' ELSE 'neutral' END", "always_neutral": "'neutral'"}
ORACLE_SQL["baseline_rules"] = sql(PRED, " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS n, count(*) FILTER ({v} = cls) AS n_right FROM pred HAVING count(*) > 0" for k, v in RULES.items()))
ORACLE_SQL["baseline_most_frequent"] = sql(PRED, "SELECT instrument, cls AS most_frequent, n FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY n DESC, CASE cls WHEN 'down' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END) AS k FROM (SELECT instrument, cls, count(*) AS n FROM pred GROUP BY ALL)) WHERE k = 1")
ORACLE_SQL["continuous_baselines"] = sql(PRED, f"SELECT {r('avg(abs(fr))', 'zero_return_mae')}, {r('avg(abs(fvol - rv20 * 0.5))', 'vol_mae')}, {r('avg(abs(frng - (SELECT quantile_cont(frng, 0.5) FROM pred)))', 'range_mae')} FROM pred")
ORACLE_SQL["probability_contract"] = sql(PRED, "SELECT instrument, count(*) AS n, count(*) FILTER (minute(pt) = 0) AS n_bad FROM pred GROUP BY instrument")
TRI = "[('down'), ('neutral'), ('up')]"
ORACLE_SQL["confusion_matrix"] = sql(PRED, " UNION ALL ".join(f"SELECT '{t}' AS true_class, '{p}' AS predicted_class, count(*) FILTER (cls = '{t}' AND said = '{p}') AS n FROM pred" for t in ("down", "neutral", "up") for p in ("down", "neutral", "up")))
PT = "CASE cls WHEN 'down' THEN pd WHEN 'neutral' THEN pn ELSE pu END"
BRIER = "(pd - (cls = 'down')::INT) ** 2 + (pn - (cls = 'neutral')::INT) ** 2 + (pu - (cls = 'up')::INT) ** 2"
HITS = {c: (f"count(*) FILTER (cls = '{c}' AND said = '{c}')", f"count(*) FILTER (cls = '{c}')", f"count(*) FILTER (said = '{c}')") for c in ("down", "neutral", "up")}
F1 = "(" + " + ".join(f"coalesce(2.0::DOUBLE * {h} / nullif({t} + {s}, 0), 0)" for h, t, s in HITS.values()) + ") / 3"
BAL = "(" + " + ".join(f"coalesce({h}::DOUBLE / nullif({t}, 0), 0)" for h, t, _ in HITS.values()) + ") / (" + " + ".join(f"({t} > 0)::INT" for _, t, _ in HITS.values()) + ")"
ACC, LL = "avg((cls = said)::INT)", f"avg(-ln(least(greatest({PT}, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))"
ORACLE_SQL["classification_metrics"] = sql(PRED, f"SELECT instrument, count(*) AS n, {r(ACC, 'accuracy')}, {r(LL, 'log_loss')}, {r(f'avg({BRIER})', 'brier')}, {r(BAL, 'balanced_accuracy')}, {r(F1, 'macro_f1')} FROM pred GROUP BY instrument")
ORACLE_SQL["metrics_by_hour"] = sql(PRED, f"SELECT CAST(hh AS INT) AS utc_hour, coalesce(n, 0) AS n, accuracy, macro_f1, brier FROM (SELECT unnest(range(24)) AS hh) LEFT JOIN (SELECT hour(pt) AS hr, count(*) AS n, {r(ACC, 'accuracy')}, {r(F1, 'macro_f1')}, {r(f'avg({BRIER})', 'brier')} FROM pred GROUP BY hr) ON hh = hr")
BUCKET = "SELECT CAST(least(floor(top * 10), 9) AS INT) AS b, count(*) AS n, avg((cls = said)::INT) AS acc, avg(top) AS conf FROM pred GROUP BY b"
ORACLE_SQL["reliability_buckets"] = sql(PRED, f"SELECT CAST(k AS INT) AS bucket, coalesce(n, 0) AS n, {r('acc', 'accuracy')}, {r('conf', 'confidence')}, {r('acc - conf', 'gap')} FROM (SELECT unnest(range(10)) AS k) LEFT JOIN ({BUCKET}) ON k = b")
ORACLE_SQL["calibration_error"] = sql(PRED, f"SELECT round(sum(n * abs(acc - conf)) / sum(n), 4) + 0.0 AS ece FROM ({BUCKET})")
ORACLE_SQL["return_errors"] = sql(PRED, f"SELECT count(*) AS n, {r('avg(abs(er - fr))', 'mae')}, {r('sqrt(avg((er - fr) * (er - fr)))', 'rmse')} FROM pred")
ORACLE_SQL["fold_summary"] = sql(PRED, f"SELECT instrument, {', '.join(x for n, w in (('accuracy', 'min'), ('brier', 'max')) for x in (r(f'avg({n})', f'{n}_mean'), r(f'quantile_cont({n}, 0.5)', f'{n}_median'), r(f'{w}({n})', f'{n}_worst')))} FROM (SELECT instrument, CAST(pt AS DATE) AS d, {ACC} AS accuracy, avg({BRIER}) AS brier FROM pred GROUP BY ALL) GROUP BY instrument")
ORACLE_SQL["seed_ensemble"] = sql(PRED, f"SELECT {SID} AS sample_id, 2::BIGINT AS n_members, {r('(pd + 0.2) / 2', 'p_down')}, {r('(pn + 0.2) / 2', 'p_neutral')}, {r('(pu + 0.6) / 2', 'p_up')}, {r('er + 0.5', 'expected_return_bps')} FROM pred")


def status(cost: float) -> str:
    return f"CASE WHEN said = 'neutral' THEN 'no_signal_neutral' WHEN top < 0.5 THEN 'no_signal_low_confidence' WHEN sgn * er <= 0 THEN 'no_signal_incompatible_expected_return' WHEN sgn * er - {cost} <= -2 THEN 'no_signal_insufficient_edge' ELSE 'signal' END"


def pnl(spread: float) -> dict[str, str]:
    s = f"{spread}::DOUBLE / 10000"
    return {"tp": f"""SELECT *, sgn * (xo - eo) / eo * 10000 AS gross, CASE WHEN sgn > 0 THEN ai - eo ELSE ao - xo END / eo * 10000 AS spc, (si + so) * 0.00005::DOUBLE / eo * 10000 AS slc, si * (1 + sgn * 0.00005::DOUBLE) AS fi, so * (1 - sgn * 0.00005::DOUBLE) AS fo,
        sgn * (so * (1 - sgn * 0.00005::DOUBLE) - si * (1 + sgn * 0.00005::DOUBLE)) / eo * 10000 AS net, CASE WHEN hour(et) < 7 THEN '00-07_UTC' WHEN hour(et) < 13 THEN '07-13_UTC' WHEN hour(et) < 21 THEN '13-21_UTC' ELSE '21-24_UTC' END AS ses
        FROM (SELECT *, CASE WHEN sgn > 0 THEN ai ELSE eo END AS si, CASE WHEN sgn > 0 THEN xo ELSE ao END AS so FROM (SELECT *, eo * (1 + {s}) AS ai, xo * (1 + {s}) AS ao FROM tr))"""}


ORACLE_SQL["decision_status"] = sql(PRED + " dec", f"SELECT {status(4.0)} AS decision_status, count(*) AS n FROM dec GROUP BY ALL")
ORACLE_SQL["decision_counts"] = sql(TRADES, f"SELECT CASE WHEN s <> 'signal' THEN s WHEN k IS NOT NULL THEN 'executed' ELSE 'suppressed_overlap' END AS decision_status, count(*) AS n FROM (SELECT {status(4.0)} AS s, chain.k FROM dec LEFT JOIN chain USING (instrument, pt)) GROUP BY ALL", BASE)
ORACLE_SQL["nonoverlap_trades"] = sql(TRADES, "SELECT instrument, pt AS prediction_time_utc, et AS entry_time_utc, le AS label_end_time_utc, said AS predicted_class FROM tr", BASE)
ORACLE_SQL["trade_pnl_base"] = sql(TRADES + " tp", f"SELECT instrument, pt AS prediction_time_utc, {r('fi', 'entry_fill_price')}, {r('fo', 'exit_fill_price')}, {r('gross', 'gross_return_bps')}, {r('spc', 'spread_cost_bps')}, {r('slc', 'slippage_cost_bps')}, {r('spc + slc', 'cost_bps')}, {r('net', 'net_return_bps')}, CAST(hour(et) AS INT) AS utc_hour, ses AS utc_session FROM tp", BASE | pnl(3.0))
SUMMARY = f"count(*) AS n_trades, {r('coalesce(sum(gross), 0)', 'gross_bps')}, {r('coalesce(sum(spc + slc), 0)', 'cost_total_bps')}, {r('coalesce(sum(net), 0)', 'net_bps')}, {r('avg((net > 0)::INT)', 'hit_rate')}, {r('avg(net)', 'average_net_bps')}, {r('sum(CASE WHEN net > 0 THEN net ELSE 0 END) / nullif(-sum(CASE WHEN net < 0 THEN net ELSE 0 END), 0)', 'profit_factor')}, 2 * count(*) AS turnover"
ORACLE_SQL["trade_summary_base"] = sql(TRADES + " tp", f"SELECT {SUMMARY} FROM tp", BASE | pnl(3.0))
ORACLE_SQL["trade_summary_stress"] = sql(TRADES + " tp", f"SELECT {SUMMARY} FROM tp", STRESS | pnl(4.5))
ORACLE_SQL["trade_log_pnl"] = sql(TRADES, "SELECT count(*) AS n, round(sum(sgn * fr - 4), 4) + 0.0 AS net_log_bps FROM tr", BASE)
GROUPED = f"count(*) AS n_trades, {r('sum(gross)', 'gross_bps')}, {r('sum(net)', 'net_bps')}, {r('avg((net > 0)::INT)', 'hit_rate')} FROM tp"
ORACLE_SQL["trade_grouped"] = sql(TRADES + " tp", " UNION ALL ".join(f"SELECT '{n}' AS dimension, CAST({c} AS VARCHAR) AS level, {GROUPED} GROUP BY {c}" for n, c in (("utc_session", "ses"), ("utc_hour", "hour(et)"), ("instrument", "instrument"))) + f" UNION ALL SELECT 'horizon_minutes', '15', {GROUPED} HAVING count(*) > 0 UNION ALL SELECT 'all', 'all', {GROUPED}", BASE | pnl(3.0))
ORACLE_SQL["exposure"] = sql(TRADES, "SELECT round(sum(m), 4) + 0.0 AS observation_minutes, round(sum(coalesce(hm, 0)), 4) + 0.0 AS held_minutes, round(sum(coalesce(hm, 0)) / sum(m), 4) + 0.0 AS exposure FROM (SELECT instrument, epoch(max(le) - min(pt)) / 60.0::DOUBLE AS m FROM dec GROUP BY instrument) LEFT JOIN (SELECT instrument, count(*) * 15.0::DOUBLE AS hm FROM tr GROUP BY instrument) USING (instrument)", BASE)
ORACLE_SQL["max_drawdown"] = sql(TRADES + " tp", "SELECT round(coalesce(max(greatest(0, pk) - cum), 0), 4) + 0.0 AS max_drawdown_bps FROM (SELECT *, max(cum) OVER (ORDER BY le) AS pk FROM (SELECT le, sum(n) OVER (ORDER BY le) AS cum FROM (SELECT le, sum(net) AS n FROM tp GROUP BY le)))", BASE | pnl(3.0))

CAL = """CASE WHEN t >= TIMESTAMP '2024-01-01 08:00:00' AND t < TIMESTAMP '2024-01-01 10:00:00' THEN 'maintenance' WHEN t >= TIMESTAMP '2024-01-01 06:00:00' AND t < TIMESTAMP '2024-01-01 09:00:00' THEN 'holiday'
    WHEN t >= TIMESTAMP '2024-01-03 23:00:00' AND t < TIMESTAMP '2024-01-04 02:00:00' THEN 'holiday' WHEN isodow(t) >= 6 THEN 'weekend' WHEN hour(t) * 60 + minute(t) < 1320 THEN 'open' ELSE 'unknown' END"""
ORACLE_SQL["calendar_states"] = sql("a c1", f"SELECT instrument, CAST(t AS DATE) AS day, {CAL} AS market_status, count(*) AS n FROM c1 GROUP BY ALL")
ORACLE_SQL["calendar_expected"] = sql("tk", f"""SELECT instrument, market_status, count(*) AS n, count(*) FILTER (expected) AS n_expected FROM (SELECT instrument, t0, bool_and(s = 'open') AS expected, CASE WHEN count(DISTINCT s) = 1 THEN min(s) ELSE 'unknown' END AS market_status FROM
    (SELECT instrument, t0, {CAL} AS s FROM (SELECT instrument, t AS t0, t + to_minutes(unnest(range(60))) AS t FROM tk)) GROUP BY ALL) GROUP BY ALL""", TICKS)
MISSING = {"ms": "SELECT g.instrument, g.t FROM (SELECT instrument, unnest(generate_series(min(t), max(t), INTERVAL 1 MINUTE)) AS t FROM c1 GROUP BY instrument) g ANTI JOIN c1 ON c1.instrument = g.instrument AND c1.t = g.t"}
ORACLE_SQL["expected_grid_anti"] = sql("a c1 ms", "SELECT instrument, t AS timestamp_open_utc FROM ms", MISSING)
KNOWN = "CASE WHEN t >= TIMESTAMP '2024-01-02 09:00:00' AND t < TIMESTAMP '2024-01-02 12:00:00' THEN 'planned' WHEN t >= TIMESTAMP '2024-01-02 10:00:00' AND t < TIMESTAMP '2024-01-05' AND instrument = 'CLOCK_A' THEN 'outage' END"
CLASSED = MISSING | {"gc": f"SELECT instrument, t, {KNOWN} AS known_reason, CASE WHEN {KNOWN} IS NOT NULL THEN 'known_gap' WHEN {CAL} <> 'open' THEN 'scheduled_closure' ELSE 'missing_data' END AS classification FROM ms"}
ORACLE_SQL["known_gap_range_join"] = sql("a c1 ms gc", "SELECT instrument, classification, known_reason, count(*) AS n FROM gc GROUP BY ALL", CLASSED)
ORACLE_SQL["gap_islands"] = sql("a c1 ms gc", """SELECT instrument, classification, min(t) AS gap_start_utc, max(t) + INTERVAL 1 MINUTE AS gap_end_utc, count(*) AS n_slots FROM (SELECT *, sum(k) OVER (PARTITION BY instrument ORDER BY t) AS g FROM
    (SELECT *, CASE WHEN t - lag(t) OVER w = INTERVAL 1 MINUTE AND classification = lag(classification) OVER w AND CAST(t AS DATE) = CAST(lag(t) OVER w AS DATE) THEN 0 ELSE 1 END AS k FROM gc WINDOW w AS (PARTITION BY instrument ORDER BY t))) GROUP BY instrument, classification, g""", CLASSED)
AS_OF = "TIMESTAMP '2024-01-05 00:00:30'"


def audited(bars_: str, k: int, as_of: str = AS_OF, first: str = "", stale: int = 5, calendar: bool = False) -> dict[str, str]:
    """Days of the scope, slots in it that close by the cutoff, those without a bar with their class, and their runs."""
    step = f"INTERVAL '{k} minutes'"
    status = CAL.replace("t >=", "u >=").replace("t <", "u <").replace("(t)", "(u)")
    states = f"SELECT s, bool_and(x = 'open') AS ex, CASE WHEN bool_and(x = 'open') THEN 'open' WHEN count(DISTINCT x) = 1 THEN min(x) ELSE 'unknown' END AS st FROM (SELECT s, {status} AS x FROM (SELECT s, s + to_minutes(unnest(range({k}))) AS u FROM (SELECT DISTINCT s FROM gr{k}))) GROUP BY s"
    known = KNOWN.replace("t >=", "s >=").replace("t <", "s <") if calendar else "NULL::VARCHAR"
    return {
        f"sp{k}": f"SELECT instrument, min(t) AS lo, max(t) AS hi, {first or 'CAST(min(t) AS DATE)'}::TIMESTAMP AS f, {first and first + '::TIMESTAMP' or 'min(t)'} AS a, max(t) + {step} AS b FROM {bars_} GROUP BY instrument",
        f"dd{k}": f"SELECT instrument, a, b, unnest(generate_series(f, CAST(CAST(hi AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM sp{k}",
        f"ob{k}": f"SELECT instrument, CAST(CAST(t AS DATE) AS TIMESTAMP) AS d, min(t) AS lo, max(t) AS hi, count(*) AS n_rows, count(DISTINCT t) AS n_distinct, count(*) FILTER (t + {step} > {as_of}) AS n_incomplete, count(*) FILTER (h < greatest(o, c) OR l > least(o, c) OR h < l) AS n_invalid FROM {bars_} GROUP BY ALL",
        f"gr{k}": f"SELECT * FROM (SELECT instrument, a, b, d, unnest(generate_series(d, d + INTERVAL 1 DAY - {step}, {step})) AS s FROM dd{k}) WHERE s >= a AND s < b AND s + {step} <= {as_of}",
        f"st{k}": states if calendar else f"SELECT DISTINCT s, NULL::BOOLEAN AS ex, 'unknown' AS st FROM gr{k}",
        f"sl{k}": f"SELECT g.instrument, g.d, g.s, st, CASE WHEN ex IS NULL THEN coalesce(g.s BETWEEN lo AND hi, false) ELSE ex END AS want, ex FROM gr{k} g JOIN st{k} USING (s) LEFT JOIN ob{k} o ON o.instrument = g.instrument AND o.d = g.d",
        f"ab{k}": f"SELECT *, CASE WHEN known IS NOT NULL THEN 'known_gap' WHEN ex THEN 'missing_data' WHEN NOT ex THEN 'scheduled_closure' ELSE 'unknown_market_status' END AS cl, want AND s + INTERVAL '{k + stale} minutes' <= {as_of} AS late FROM (SELECT x.*, {known} AS known FROM sl{k} x ANTI JOIN {bars_} y ON x.instrument = y.instrument AND x.s = y.t)",
        f"gp{k}": f"SELECT instrument, d, st, cl, known, want, late, min(s) AS s0, max(s) + {step} AS s1, count(*) AS n FROM (SELECT *, s - to_minutes({k} * row_number() OVER (PARTITION BY instrument, d, st, cl, known, want, late ORDER BY s)) AS run FROM ab{k}) GROUP BY instrument, d, st, cl, known, want, late, run",
        f"dq{k}": f"""SELECT *, n_rows - n_distinct AS n_duplicate, CASE WHEN n_rows > n_distinct OR n_invalid > 0 OR n_incomplete > 0 OR n_missing_data > 0 THEN 'fail' WHEN n_known_gap + n_scheduled_closure + n_unknown_market_status > 0 THEN 'marked' ELSE 'pass' END AS quality_status FROM
            (SELECT dd{k}.instrument, CAST(dd{k}.d AS DATE) AS day, coalesce(n_rows, 0) AS n_rows, coalesce(n_distinct, 0) AS n_distinct, coalesce(n_incomplete, 0) AS n_incomplete, coalesce(n_invalid, 0) AS n_invalid, coalesce(n_expected, 0) AS n_expected, coalesce(market_status, 'unknown') AS market_status, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('n_missing', 'n_stale', 'n_known_gap', 'n_scheduled_closure', 'n_missing_data', 'n_unknown_market_status'))}
             FROM dd{k} LEFT JOIN ob{k} USING (instrument, d) LEFT JOIN (SELECT instrument, d, count(*) FILTER (want) AS n_expected, CASE WHEN bool_or(st = 'open') THEN 'open' WHEN bool_or(st = 'holiday') THEN 'holiday' WHEN bool_or(st = 'maintenance') THEN 'maintenance' WHEN bool_or(st = 'weekend') THEN 'weekend' ELSE 'unknown' END AS market_status FROM sl{k} GROUP BY ALL) USING (instrument, d)
             LEFT JOIN (SELECT instrument, d, sum(n) FILTER (want) AS n_missing, sum(n) FILTER (late) AS n_stale, {', '.join(f"count(*) FILTER (cl = '{c}') AS n_{c}" for c in ('known_gap', 'scheduled_closure', 'missing_data', 'unknown_market_status'))} FROM gp{k} GROUP BY ALL) USING (instrument, d))""",
    }


AUDIT = ("sp", "dd", "ob", "gr", "st", "sl", "ab", "gp", "dq")
audit_names = lambda k: " ".join(f"{n}{k}" for n in AUDIT)
ORACLE_SQL["daily_quality"] = sql(f"a c1 rp {audit_names(1)}", "SELECT * FROM dq1", REPEATED | audited("rp", 1))
ORACLE_SQL["daily_quality_classes"] = sql(f"a c1 {audit_names(1)}", "SELECT * FROM dq1", audited("c1", 1, first="DATE '2023-12-30'", calendar=True))
ORACLE_SQL["quality_gaps"] = sql(f"a c1 b15 {audit_names(15)}", "SELECT instrument, st AS market_status, cl AS classification, known AS known_reason, CAST(want AS INT) AS counts_as_missing, CAST(late AS INT) AS is_stale, s0 AS gap_start_utc, s1 AS gap_end_utc, n AS n_slots FROM gp15", audited("b15", 15, "TIMESTAMP '2034-01-01'", calendar=True))
RET = {"rb": "SELECT *, 1e4 * (ln(c) - ln(lag(c) OVER (PARTITION BY instrument, g ORDER BY t))) AS r FROM sb3"}
ORACLE_SQL["sequence_last20"] = sql("a c1 b3 sb3 rb", """SELECT instrument, t + INTERVAL 3 MINUTE AS available_at_utc, round(lag(r, 19) OVER w, 4) + 0.0 AS oldest_return, round(r, 4) + 0.0 AS newest_return, round(sum(1e4 * (h - l) / o) OVER v, 4) + 0.0 AS sum_range FROM rb
    WINDOW w AS (PARTITION BY instrument, g ORDER BY t), v AS (PARTITION BY instrument, g ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) QUALIFY count(r) OVER v = 20""", RET)
SEQ = {f"q{k}": f"SELECT instrument, t + INTERVAL '{k} minutes' AS av, count(r) OVER (PARTITION BY instrument, g ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} AS ok FROM (SELECT *, 1e4 * (ln(c) - ln(lag(c) OVER (PARTITION BY instrument, g ORDER BY t))) AS r FROM sb{k})" for k, n in ((3, 20), (15, 8))}
ORACLE_SQL["sequence_availability"] = sql("a c1 b3 cand sb3 b15 sb15 q3 q15", "SELECT instrument, count(*) AS n, count(*) FILTER (o3) AS n_3min, count(*) FILTER (o15) AS n_15min FROM (SELECT cand.instrument, x.ok AND cand.pt - x.av <= INTERVAL 3 MINUTE AS o3, y.ok AND cand.pt - y.av <= INTERVAL 15 MINUTE AS o15 FROM cand ASOF LEFT JOIN q3 x ON cand.instrument = x.instrument AND cand.pt >= x.av ASOF LEFT JOIN q15 y ON cand.instrument = y.instrument AND cand.pt >= y.av) GROUP BY instrument", SEQ)
LEADS = ", ".join(f"lead({x}, {k}) OVER w AS {x}{k}" for k in range(1, 6) for x in "ohlc")
PATH = {"pa": f"SELECT *, c AS c0 FROM (SELECT *, {LEADS} FROM sb3 WINDOW w AS (PARTITION BY instrument, g ORDER BY t)) WHERE c5 IS NOT NULL"}
PART = {f"path_{k}_{p}": x for k in range(1, 6) for p, x in (("gap", f"1e4 * (ln(o{k}) - ln(c{k - 1}))"), ("body", f"1e4 * (ln(c{k}) - ln(o{k}))"), ("upper", f"greatest(1e4 * (ln(h{k}) - ln(greatest(o{k}, c{k}))), 0)"), ("lower", f"greatest(1e4 * (ln(least(o{k}, c{k})) - ln(l{k})), 0)"))}
HIGH, LOW = (f"{f}({', '.join(f'{x}{k}' for k in range(1, 6))})" for f, x in (("greatest", "h"), ("least", "l")))
ORACLE_SQL["future_path_5"] = sql("a c1 b3 sb3 pa", f"SELECT instrument, t + INTERVAL 3 MINUTE AS prediction_time_utc, t + INTERVAL 18 MINUTE AS path_end_utc, {r('c', 'anchor_close')}, {', '.join(r(v, k) for k, v in PART.items())}, {r('o1', 'agg_open')}, {r(HIGH, 'agg_high')}, {r(LOW, 'agg_low')}, {r('c5', 'agg_close')} FROM pa", PATH)
ORACLE_SQL["path_reconstruct"] = sql("a c1 b3 sb3 pa", "SELECT instrument, count(*) AS n, 0.0::DOUBLE AS worst_open, 0.0::DOUBLE AS worst_high, 0.0::DOUBLE AS worst_low, 0.0::DOUBLE AS worst_close, round(sum(1e4 * (ln(c5) - ln(c))), 4) + 0.0 AS sum_return FROM pa GROUP BY instrument", PATH)
ORACLE_SQL["path_quantile_eval"] = sql("a c1 b3 sb3 pa", f"""SELECT CAST(step AS INT) AS step, part, count(*) AS n, {r('avg(abs(v - 0.5))', 'mae')}, {r('avg((v BETWEEN -10 AND 12)::INT)', 'coverage')}, 22.0::DOUBLE AS width, {', '.join(r(f'avg(greatest(({q} - 1) * (v - ({c})), {q} * (v - ({c}))))', f'pinball_{n}') for q, c, n in ((0.1, -10, 'q10'), (0.5, 0.5, 'q50'), (0.9, 12, 'q90')))} FROM
    ({' UNION ALL '.join(f"SELECT {k.split('_')[1]} AS step, '{k.split('_')[2]}' AS part, {v} AS v FROM pa" for k, v in PART.items())}) GROUP BY step, part""", PATH)
for _n, _w in (("universe_semi", "= 0"), ("universe_anti", "<> 0")):
    ORACLE_SQL[_n] = sql(PRED, f"SELECT {SID} AS sample_id, CAST(CASE cls WHEN 'down' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS INT) AS target_class_id FROM pred WHERE minute(pt) % 2 {_w}")
ORACLE_SQL["ids_symmetric_difference"] = sql(PRED, "SELECT 'b' AS only_in, count(*) AS n FROM pred WHERE minute(pt) % 2 = 0 AND minute(pt) % 4 <> 0 HAVING count(*) > 0")
ORACLE_SQL["ordered_digest"] = sql(PRED, f"""SELECT instrument, day, CAST(sum(n) AS BIGINT) AS n, CASE WHEN count(*) = 1 THEN max(h) ELSE sha256(string_agg(h, chr(10) ORDER BY leaf) || chr(10)) END AS digest FROM
    (SELECT instrument, day, k // 256 AS leaf, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY k) || chr(10)) AS h FROM (SELECT instrument, CAST(pt AS DATE) AS day, {SID} AS id, row_number() OVER (PARTITION BY instrument, CAST(pt AS DATE) ORDER BY pt) - 1 AS k FROM pred) GROUP BY ALL) GROUP BY instrument, day""")
ORACLE_SQL["topk_latest_row"] = sql(PRED, f"SELECT instrument, pt AS prediction_time_utc, {r('m5', 'momentum_5_bps')}, cls AS target_class FROM pred ORDER BY pt DESC, instrument LIMIT 3")
ORACLE_SQL["candidate_ranking"] = sql(PRED, f"SELECT instrument, day, CAST(place AS INT) AS place, {r('f', 'macro_f1')} FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY round(f, 6) DESC, round(ll, 6), day) AS place FROM (SELECT instrument, CAST(pt AS DATE) AS day, {F1} AS f, {LL} AS ll FROM pred GROUP BY ALL)) WHERE place <= 2")


def numbered(i: int, confidence: float, edge: float) -> dict[str, str]:
    """Trades without costs of one policy, under names of their own."""
    s = signals(0.0, confidence, edge)
    return {f"sig{i}": s["sig"], f"nxt{i}": s["nxt"].replace("sig", f"sig{i}"), f"chain{i}": s["chain"].replace("nxt", f"nxt{i}").replace("FROM chain", f"FROM chain{i}")}


POLICIES = [numbered(i, c, e) for i, (c, e) in enumerate(((0.4, -9.0), (0.5, -3.0), (0.6, -3.0)))]
ORACLE_SQL["policy_select"] = sql(
    f"{PRED} dec " + " ".join(f"sig{i} nxt{i} chain{i}" for i in range(3)),
    "SELECT CAST(policy AS INT) AS policy, least_trades, round(m, 4) + 0.0 AS mean_net_bps FROM (SELECT policy, min(n) AS least_trades, avg(net) AS m FROM ("
    + " UNION ALL ".join(f"SELECT {i} AS policy, CAST(pt AS DATE) AS fold, count(*) AS n, sum(sgn * (xo - eo) / eo * 10000) AS net FROM dec JOIN chain{i} USING (instrument, pt) GROUP BY fold" for i in range(3))
    + ") GROUP BY policy) WHERE least_trades >= 3 AND m > 0 ORDER BY m DESC, policy LIMIT 1",
    {k: v for p in POLICIES for k, v in p.items()},
).replace("WITH ", "WITH RECURSIVE ", 1)


# Contracts, coverage and comparisons of families.
M = "(epoch(pt)::BIGINT // 60)"
ORACLE_SQL["candidate_contract"] = sql("a c1 b3 cand", f"""SELECT count(*) AS n_rows, count(*) FILTER (m % 113 = 7) AS n_unnamed, count(*) FILTER (m % 101 = 3) AS n_off_grid, count(*) - count(DISTINCT (instrument, m, m % 101 = 3, m % 113 = 7)) AS n_repeated FROM
    (SELECT instrument, {M} AS m FROM cand UNION ALL (SELECT instrument, {M} AS m FROM cand WHERE ({M} + ({M} % 101 = 3)::INT) % 50 = 0))""")
ORACLE_SQL["ask_contract"] = sql("a c1", """SELECT count(*) AS n_rows, count(*) FILTER (ask IS NULL OR isnan(ask)) AS n_not_finite, count(*) FILTER (NOT isnan(ask) AND ask <= 0) AS n_not_positive, count(*) FILTER (NOT isnan(ask) AND ask < o) AS n_below_bid FROM
    (SELECT o, CASE WHEN m % 101 = 3 THEN o - 1 WHEN m % 103 = 4 THEN 'nan'::DOUBLE WHEN m % 107 = 5 THEN 0 WHEN m % 109 = 6 THEN NULL ELSE o + 0.3 END AS ask FROM (SELECT o, epoch(t)::BIGINT // 60 AS m FROM c1))""")
ORACLE_SQL["target_contract"] = sql(LAB, f"""SELECT count(*) AS n_rows, count(*) FILTER (m % 101 = 3) AS n_class_mismatch, count(*) FILTER (m % 103 = 4) AS n_return_not_finite, count(*) FILTER (m % 107 = 5) AS n_empty_id,
    count(*) - count(DISTINCT CASE WHEN m % 107 = 5 THEN '' ELSE instrument || m END) AS n_repeated_id FROM (SELECT instrument, {M} AS m FROM l15 UNION ALL SELECT instrument, {M} AS m FROM l15 WHERE {M} % 50 = 0)""")
ORACLE_SQL["audit_records"] = sql(PRED, f"""SELECT instrument, pt AS prediction_time_utc, fw AS feature_window_start_utc, et AS entry_time_utc, le AS label_end_time_utc, 15 AS horizon_minutes, {r('eo', 'entry_bid_open')}, {r('xo', 'exit_bid_open')}, {r('fr', 'future_return_bps')}, {r('ar', 'arithmetic_return_bps')}, {r('frng', 'future_range_bps')},
    {r('fvol', 'future_realized_vol_bps')}, cls AS target_class, CAST(CASE cls WHEN 'down' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS INT) AS target_class_id, {SID} AS sample_id, sha256(instrument || '|clock|' || strftime(pt, '%Y-%m-%dT%H:%M:%S') || '+00:00|15') AS sample_hash FROM pred""")
PRIORS = PARTS | {"pri": "SELECT k AS cls, count(cls) AS n, coalesce(avg(ar), 0) AS mr FROM (SELECT unnest(['down', 'neutral', 'up']) AS k) LEFT JOIN (SELECT cls, ar FROM ds WHERE split = 'train') ON k = cls GROUP BY k"}
ORACLE_SQL["class_priors"] = sql(PRED + " sp ds pri", f"SELECT cls AS target_class, n, round(coalesce(n / nullif(sum(n) OVER (), 0), 0), 4) + 0.0 AS prior, {r('mr', 'mean_return_bps')} FROM pri", PRIORS)
PRIOR = "SELECT cls, n / nullif(sum(n) OVER (), 0) AS p FROM pri"
ORACLE_SQL["prior_baseline"] = sql(PRED + " sp ds pri", f"""SELECT instrument, count(*) AS n, {r("avg((cls = (SELECT cls FROM pri ORDER BY n DESC, CASE cls WHEN 'down' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END LIMIT 1))::INT)", 'accuracy')}, {r('avg(-ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))', 'log_loss')},
    {r('avg(1 - 2 * p + pp)', 'brier')} FROM ds JOIN ({PRIOR}) USING (cls), (SELECT sum(p * p) AS pp FROM ({PRIOR})) WHERE split = 'test' GROUP BY instrument""", PRIORS)
ORACLE_SQL["fold_coverage"] = sql(PRED + " sp", " UNION ALL ".join(
    f"SELECT '{n}' AS block, count(*) AS n_rows, CAST((count(m5) = 0)::INT + (count(*) FILTER (pt >= {at(1, 2)}) = 0)::INT AS INT) AS n_unsupported FROM pred WHERE pt >= {at(a, 6)} AND " + (f"pt < {at(b, 6)} - INTERVAL 181 MINUTE AND le < {at(b, 6)}" if n.endswith("train") else f"pt < {at(b, 6)}") for n, a, b in BLOCKS
), SPAN)
ORACLE_SQL["label_coverage"] = sql(LAB, "SELECT instrument, count(*) AS n_candidates, count(l15.pt) AS n_eligible, count(*) - count(l15.pt) AS n_dropped FROM cand LEFT JOIN l15 USING (instrument, pt) GROUP BY instrument")
PATHS = LAB + " sb3 pa pl"
LABEL_PATH = PATH | {"pl": "SELECT l15.instrument, l15.pt, l15.le, l15.et, l15.fr, pa.* EXCLUDE (instrument), pa.t + INTERVAL 18 MINUTE AS pe FROM l15 JOIN pa ON l15.instrument = pa.instrument AND l15.pt = pa.t + INTERVAL 3 MINUTE"}
ORACLE_SQL["path_dataset"] = sql(PATHS, f"SELECT instrument, pt AS prediction_time_utc, le AS label_end_time_utc, pe AS path_end_utc, 1 AS in_time, {r('fr', 'future_return_bps')}, {r('1e4 * (ln(c5) - ln(c))', 'path_return_bps')} FROM pl", LABEL_PATH)
ORACLE_SQL["path_unmatched"] = sql(PRED + " pa", "SELECT instrument, count(*) AS n_unmatched FROM (SELECT instrument, t + INTERVAL 3 MINUTE AS pt FROM pa) p ANTI JOIN pred ON pred.instrument = p.instrument AND pred.pt = p.pt GROUP BY instrument", PATH)
WHOLE = {"gap": "1e4 * (ln(o1) - ln(c))", "body": "1e4 * (ln(c5) - ln(o1))", "upper": f"greatest(1e4 * (ln({HIGH}) - ln(greatest(o1, c5))), 0)", "lower": f"greatest(1e4 * (ln(least(o1, c5)) - ln({LOW})), 0)"}
BANDS = (("q10", -5), ("q50", 0), ("q90", 5))
ORACLE_SQL["path_quantile_columns"] = sql(PATHS, "SELECT instrument, pt AS prediction_time_utc, " + ", ".join([r(f"({v}) + {x}", k.replace("path_", "step_") + f"_{q}") for k, v in PART.items() for q, x in BANDS] + [r(f"({v}) + {x}", f"aggregate_{k}_{q}") for k, v in WHOLE.items() for q, x in BANDS]) + " FROM pl", LABEL_PATH)
ORACLE_SQL["path_normalizer"] = sql("a c1 b3 sb3 pa", f"SELECT part, {r('avg(v)', 'mean')}, {r('CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END', 'scale')} FROM ({' UNION ALL '.join(f'''SELECT '{k.split('_')[2]}' AS part, {v} AS v FROM pa''' for k, v in PART.items())}) GROUP BY part", PATH)
STEPS5 = {"st": "SELECT instrument, g, t, 1e4 * (h - l) / o AS rng, r, count(r) OVER (PARTITION BY instrument, g ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AS ok FROM (SELECT *, 1e4 * (ln(c) - ln(lag(c) OVER (PARTITION BY instrument, g ORDER BY t))) AS r FROM sb3)", "sq": "SELECT s.* FROM st e JOIN st s ON e.ok AND s.instrument = e.instrument AND s.g = e.g AND s.t BETWEEN e.t - INTERVAL 12 MINUTE AND e.t"}
ORACLE_SQL["sequence_normalizer"] = sql("a c1 b3 sb3 st sq", " UNION ALL ".join(f"SELECT '{n}' AS channel, {r(f'quantile_cont({c}, 0.5)', 'median')}, {r(f'avg({c})', 'mean')}, {r(f'CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END', 'scale')} FROM sq" for c, n in (("r", "log_return_bps"), ("rng", "candle_range_bps"))), STEPS5)
ORACLE_SQL["reference_parity"] = sql(PRED, f"SELECT count(*) AS n_rows, count(*) FILTER (m % 7 = 0) AS n_missing, 0::BIGINT AS n_repeated, 0::BIGINT AS n_time, count(*) FILTER (m % 7 <> 0 AND m % 11 = 0) AS n_class, count(*) FILTER (m % 7 <> 0 AND m % 13 = 0) AS n_return FROM (SELECT {M} AS m FROM pred) WHERE m % 2 = 0")
SAID = "CASE WHEN pd >= pn AND pd >= pu THEN 'down' WHEN pn >= pu THEN 'neutral' ELSE 'up' END"
FAMILIES = SPAN | {
    "fam": f"""SELECT *, {SAID} AS said FROM (SELECT instrument, pt, cls, family, fold, CASE family WHEN 'scored' THEN pd WHEN 'opposite' THEN pu ELSE 1 / 3.0::DOUBLE END AS pd, CASE family WHEN 'equal' THEN 1 / 3.0::DOUBLE ELSE pn END AS pn, CASE family WHEN 'scored' THEN pu WHEN 'opposite' THEN pd ELSE 1 / 3.0::DOUBLE END AS pu FROM
        (SELECT instrument, pt, cls, pd, pn, pu, unnest(['scored', 'opposite', 'equal']) AS family, least(floor(epoch(pt - f) / 60 * 10 / m), 9) AS fold FROM pred, sp))""",
    "fm": f"SELECT family, fold, {ACC} AS accuracy, {F1} AS macro_f1, avg({BRIER}) AS brier, {LL} AS log_loss FROM fam GROUP BY family, fold",
    "hs": " UNION ALL ".join(f"SELECT family, '{n}' AS metric, count(*) AS n_folds, avg({n}) AS mean, quantile_cont({n}, 0.5) AS median, {w}({n}) AS worst FROM fm GROUP BY family" for n, w in (("accuracy", "min"), ("macro_f1", "min"), ("brier", "max"), ("log_loss", "max"))),
}
ORACLE_SQL["horizon_summary"] = sql(PRED + " sp fam fm hs", f"SELECT family, metric, n_folds, {r('mean')}, {r('median')}, {r('worst')} FROM hs", FAMILIES)
ORACLE_SQL["research_champion"] = sql(PRED + " sp fam fm hs", f"""SELECT family, {r('f', 'macro_f1_mean')}, {r('b', 'brier_mean')}, CAST(row_number() OVER (ORDER BY f DESC, b, family) AS INT) AS place FROM
    (SELECT x.family, x.mean AS f, y.mean AS b, x.worst AS w FROM hs x JOIN hs y ON x.family = y.family AND x.metric = 'macro_f1' AND y.metric = 'brier') c, (SELECT x.mean AS f0, y.mean AS b0, x.worst AS w0 FROM hs x JOIN hs y ON x.family = 'opposite' AND y.family = 'opposite' AND x.metric = 'macro_f1' AND y.metric = 'brier')
    WHERE family <> 'opposite' AND f > f0 AND w >= w0 AND b <= b0""", FAMILIES)
ORACLE_SQL["selected_candidate"] = sql(PRED, f"""SELECT c, CAST(weighted AS INT) AS weighted, macro_f1 + 0.0 AS macro_f1, log_loss + 0.0 AS log_loss FROM (SELECT c, weighted, max(f) AS macro_f1, min(ll) AS log_loss FROM
    (SELECT round(power(10.0::DOUBLE, k % 5 - 2), 4) AS c, k % 2 = 1 AS weighted, round(f, 2) AS f, round(ll, 2) AS ll FROM (SELECT datediff('day', DATE '2024-01-01', CAST(pt AS DATE)) AS k, {F1} AS f, {LL} AS ll FROM pred GROUP BY instrument, k)) GROUP BY ALL)
    ORDER BY macro_f1 DESC, log_loss, weighted, abs(log10(c)), c LIMIT 1""")
ORACLE_SQL["head_and_tail"] = sql(PRED, "SELECT instrument, pt AS prediction_time_utc, cls AS target_class FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY pt) AS a, row_number() OVER (PARTITION BY instrument ORDER BY pt DESC) AS b FROM pred) WHERE a <= 16 OR b <= 16")
ORACLE_SQL["feature_availability"] = sql(FEAT + " sf rg", " UNION ALL ".join(f"SELECT '{n}' AS feature, count({c}) AS n_there, {r(f'count({c}) / nullif(count(*), 0)', 'share')} FROM rg" for c, n in (("ts", "regime_trend_score"), ("ss", "regime_shock_score"))), REGIME)
TOTALS = {1: ("1min", "rp"), 3: ("3min", "b3"), 5: ("5min", "b5"), 15: ("15min", "b15"), 30: ("30min", "b30"), 60: ("1h", "b60"), 180: ("3h", "b180")}
ORACLE_SQL["quality_totals"] = sql(
    "a c1 rp b3 b5 b15 b30 b60 b180 " + " ".join(audit_names(k) for k in TOTALS),
    " UNION ALL ".join(f"SELECT '{t}' AS timeframe, count(*) AS n_days, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in ('n_rows', 'n_expected', 'n_missing', 'n_stale', 'n_incomplete', 'n_duplicate', 'n_invalid', 'n_unknown_market_status'))} FROM dq{k}" for k, (t, _) in TOTALS.items()),
    REPEATED | {n: q for k, (_, b) in TOTALS.items() for n, q in audited(b, k).items()},
)

# What a stream has emitted once its watermark, ten minutes behind the latest row, has come to rest.
MARK = "(SELECT max(t) - INTERVAL 10 MINUTE FROM {})"
ORACLE_SQL["stream_ohlc_3min"] = sql("a c1 b3", bar_select(3, "3min") + f"b3 WHERE t + INTERVAL 3 MINUTE <= {MARK.format('c1')}")
ORACLE_SQL["stream_sessions"] = f"SELECT * FROM ({ORACLE_SQL['session_windows']}) WHERE end_utc <= ({sql('a c1', 'SELECT max(t) - INTERVAL 10 MINUTE FROM c1')})"
ORACLE_SQL["stream_first_deliveries"] = sql("a c1 rp", f"SELECT instrument, count(*) AS n, {r('sum(c)', 'sum_close')} FROM (SELECT DISTINCT * FROM rp) GROUP BY instrument", REPEATED)
ORACLE_SQL["stream_asof"] = f"SELECT * FROM ({ORACLE_SQL['asof_tolerance']}) WHERE prediction_time_utc <= ({sql('a c1 b3', 'SELECT max(t) + INTERVAL 3 MINUTE - INTERVAL 10 MINUTE FROM b3')})"
ORACLE_SQL["stream_positions"] = sql(TRADES, "SELECT instrument, pt AS prediction_time_utc, 15 AS horizon_minutes FROM tr", BASE)
ORACLE_SQL["stream_silences"] = sql("tk", """SELECT instrument, t + INTERVAL 1 HOUR AS silent_from_utc, t + INTERVAL 3 HOUR AS stale_from_utc FROM (SELECT *, lead(t) OVER (PARTITION BY instrument ORDER BY t) AS later, max(t) OVER () AS latest FROM tk)
    WHERE later >= t + INTERVAL 3 HOUR OR (later IS NULL AND t + INTERVAL 3 HOUR <= latest - INTERVAL 1 HOUR)""", TICKS)
FILES = "SELECT k, max(t) + INTERVAL 1 MINUTE AS cutoff FROM (SELECT t, (SELECT epoch(min(t)) FROM c1) AS low, (SELECT epoch(max(t)) FROM c1) AS high FROM c1), range(6) r(k) WHERE epoch(t)::BIGINT >= low::BIGINT + (high::BIGINT + 1 - low::BIGINT) * k // 6 AND epoch(t)::BIGINT < low::BIGINT + (high::BIGINT + 1 - low::BIGINT) * (k + 1) // 6 GROUP BY k"
ORACLE_SQL["stream_online_features"] = sql(FEAT + " fl", f"""SELECT instrument, pt AS prediction_time_utc, fw AS feature_window_start_utc, {', '.join(r(*x) for x in FEATURES)} FROM
    (SELECT *, row_number() OVER (PARTITION BY instrument, k ORDER BY pt DESC) AS place FROM feat JOIN fl ON pt <= cutoff AND fw >= cutoff - INTERVAL 180 MINUTE) WHERE place = 1""", {"fl": FILES})

WIDE_WINDOWS = {1: (2, 5, 10, 20), 3: (2, 5, 10, 20), 5: (2, 5, 10, 20), 15: (2, 4, 8, 16), 30: (2, 4, 8, 12), 60: (2, 4, 8), 180: (2, 3, 5)}
WIDE_NAMES = {1: "1min", 3: "3min", 5: "5min", 15: "15min", 30: "30min", 60: "1h", 180: "3h"}
WIDE_CTES = (
    {"b1": "SELECT instrument, source, t, o, h, l, c FROM c1"} | {f"sb{k}": runs(k) for k in WIDE_WINDOWS} | {n: q for k, w in WIDE_WINDOWS.items() for n, q in block(k, w).items()}
    | {f"w{k}": f"SELECT l.instrument, l.pt, CASE WHEN l.pt - x.av <= INTERVAL '{k} minutes' THEN epoch(l.pt - x.av) END AS age FROM feat l ASOF LEFT JOIN x{k} x ON l.instrument = x.instrument AND l.pt >= x.av" for k in WIDE_WINDOWS}
)
WIDE_LIST = "a c1 b1 b3 b5 b15 b30 b60 b180 " + " ".join(f"sb{k}" for k in WIDE_WINDOWS) + " f3 feat " + " ".join(f"x{k} w{k}" for k in WIDE_WINDOWS)
ORACLE_SQL["feature_availability_by_timeframe"] = sql(WIDE_LIST, " UNION ALL ".join(f"SELECT instrument, '{n}' AS timeframe, count(*) AS n, count(age) AS n_fresh, {r('avg(age)', 'mean_age_seconds')} FROM w{k} GROUP BY instrument" for k, n in WIDE_NAMES.items()), WIDE_CTES)
ORACLE_SQL["feature_variants"] = sql(
    WIDE_LIST + " sf rg al",
    " UNION ALL ".join(f"SELECT '{v}' AS variant, {n}::INT AS n_features, count(*) FILTER ({c}) AS n_whole FROM al" for v, n, c in (
        ("mvp", 18, "true"), ("price_3min", 38, "a3"), ("price_session_3min", 46, "a3"), ("price_session_regime_3min", 55, "a3 AND re"), ("price_session_regime_multitimeframe", 171, "a3 AND re AND al"))),
    WIDE_CTES | REGIME | {"al": "SELECT w3.age IS NOT NULL AS a3, lo IS NOT NULL AND hi IS NOT NULL AND ts IS NOT NULL AND ss IS NOT NULL AS re, " + " AND ".join(f"w{k}.age IS NOT NULL" for k in WIDE_WINDOWS) + " AS al FROM rg " + " ".join(f"JOIN w{k} ON rg.instrument = w{k}.instrument AND rg.pt = w{k}.pt" for k in WIDE_WINDOWS)},
)
