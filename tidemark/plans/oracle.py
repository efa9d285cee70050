"""DuckDB SQL with the same columns and values as ``queries``."""

from __future__ import annotations

EVENT_BARS = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS date,
 round(first(value ORDER BY ts, event_id), 2) AS open, round(max(value), 2) AS high, round(min(value), 2) AS low,
 round(last(value ORDER BY ts, event_id), 2) AS close, count(*)::BIGINT AS volume FROM events GROUP BY ALL)"""
ORDER_BARS = """bars AS (SELECT o_orderpriority AS symbol, o_orderdate::DATE AS date,
 round(first(o_totalprice ORDER BY o_orderkey), 2) AS open, round(max(o_totalprice), 2) AS high, round(min(o_totalprice), 2) AS low,
 round(last(o_totalprice ORDER BY o_orderkey), 2) AS close, count(*)::BIGINT AS volume FROM orders GROUP BY ALL)"""
INDEX = """daily AS (SELECT o_orderpriority AS symbol, o_orderdate::DATE AS date, sum(o_totalprice) AS total, count(*)::BIGINT AS volume FROM orders GROUP BY ALL),
z AS (SELECT symbol, date, volume, (total - avg(total) OVER (PARTITION BY symbol)) / stddev_samp(total) OVER (PARTITION BY symbol) AS z FROM daily),
index AS (SELECT symbol, date, round(100 + sum(z) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 2) AS close, volume FROM z)"""
WALK = """daily AS (SELECT o_orderpriority AS symbol, o_orderdate::DATE AS date, sum(o_totalprice) AS total, count(*)::BIGINT AS volume FROM orders GROUP BY ALL),
early AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY date) <= 250 THEN total END AS t FROM daily),
z AS (SELECT symbol, date, volume, (total - avg(t) OVER (PARTITION BY symbol)) / stddev_samp(t) OVER (PARTITION BY symbol) AS z FROM early),
index AS (SELECT symbol, date, round(100 + sum(z) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) / 2, 2) AS close, volume FROM z)"""
RSI = """pos AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, close - lag(close) OVER w AS d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
wt AS (SELECT *, CASE WHEN i <= 14 THEN 1.0::DOUBLE / 14 ELSE 1.0::DOUBLE / 14 * pow(14.0::DOUBLE / 13, i - 14) END AS w FROM pos),
gl AS (SELECT *, sum(w * greatest(coalesce(d, 0), 0)) OVER r AS g, sum(w * greatest(-coalesce(d, 0), 0)) OVER r AS l FROM wt WINDOW r AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
rsi AS (SELECT symbol, date, open, high, low, close, volume, i, n, CASE WHEN i >= 14 THEN CASE WHEN l = 0 THEN 100.0 ELSE round(100 * g / (g + l), 2) END END AS rsi FROM gl)"""

TOP1_ALL = """WITH p AS (SELECT q.vec_id AS vec_id, e.vec_id AS match_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS similarity
 FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT vec_id, match_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, match_id) AS r FROM p) WHERE r = 1"""


def extremes(width: int) -> str:
    return f"""ext AS (SELECT *, i BETWEEN {width} AND n - {width + 1} AND close > max(close) OVER b AND close > max(close) OVER a AS is_peak,
 i BETWEEN {width} AND n - {width + 1} AND close < min(close) OVER b AND close < min(close) OVER a AS is_trough FROM rsi
 WINDOW b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {width} PRECEDING AND 1 PRECEDING), a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {width} FOLLOWING)),
cand AS (SELECT *, CASE WHEN is_peak THEN -1 ELSE 1 END AS kind FROM ext WHERE is_peak OR is_trough)"""


SIGNALS = """lagged AS (SELECT *, lag(close) OVER k AS pc, lag(rsi) OVER k AS pr FROM cand WINDOW k AS (PARTITION BY symbol, kind ORDER BY date)),
sig AS (SELECT symbol, date, CASE WHEN kind = 1 AND close < pc AND rsi > pr THEN 1 WHEN kind = -1 AND close > pc AND rsi < pr THEN -1 ELSE 0 END AS signal FROM lagged WHERE i >= 20)"""
PAIRED = """paired AS (SELECT c.symbol, c.date, c.close, c.rsi, c.kind, c.i, arg_max(p.close, p.i) AS pc, max(p.i) AS pi FROM cand c JOIN cand p
 ON c.symbol = p.symbol AND c.kind = p.kind AND p.i BETWEEN c.i - 60 AND c.i - 5 GROUP BY ALL),
lagged AS (SELECT q.*, p.rsi AS pr FROM paired q JOIN cand p ON q.symbol = p.symbol AND q.pi = p.i),
sig AS (SELECT symbol, date, CASE WHEN kind = 1 AND close < pc AND rsi > pr THEN 1 WHEN kind = -1 AND close > pc AND rsi < pr THEN -1 ELSE 0 END AS signal FROM lagged WHERE i >= 20)"""
_AHEAD = ", ".join(f"max(high) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {d} FOLLOWING) AS h{d}, min(low) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {d} FOLLOWING) AS l{d}" for d in (1, 3, 5, 10, 20, 60))
_EACH = " UNION ALL ".join(
    f"""SELECT symbol, date, close, CASE WHEN rsi <> 0 THEN round(rsi, 1) END AS rsi, signal, {d} AS horizon,
 round(CASE WHEN signal = 1 THEN (h{d} - close) / close * 100 ELSE -((l{d} - close) / close * 100) END, 3) AS max_profit,
 round(CASE WHEN signal = 1 THEN (l{d} - close) / close * 100 ELSE -((h{d} - close) / close * 100) END, 3) AS max_drawdown FROM ahead JOIN sig USING (symbol, date) WHERE signal <> 0"""
    for d in (1, 3, 5, 10, 20, 60)
)
LONG = f"ahead AS (SELECT *, {_AHEAD} FROM rsi), long AS ({_EACH})"
FULL = f"WITH {ORDER_BARS}, {RSI}, {extremes(3)}, {SIGNALS}, {LONG} "


def histogram(metric: str) -> str:
    return FULL + f""", span AS (SELECT horizon, max({metric}) - min({metric}) AS r FROM long GROUP BY 1), wd AS (SELECT horizon, CASE WHEN r <= 0 THEN 1.0 ELSE greatest(0.2, r / 15) END AS w FROM span)
SELECT horizon, round(floor({metric} / w) * w, 1) AS bin, floor({metric} / w) * w >= 0 AS positive, count(*) AS n FROM long JOIN wd USING (horizon) WHERE {metric} IS NOT NULL GROUP BY ALL"""


RUNS = f"""{INDEX}, st AS (SELECT symbol, date, volume, close, lag(date) OVER w AS pd, lag(close) OVER w AS pc, sign(close - lag(close) OVER w) AS way FROM index WINDOW w AS (PARTITION BY symbol ORDER BY date)),
tn AS (SELECT *, CASE WHEN way <> lag(way) OVER (PARTITION BY symbol ORDER BY date) THEN 1 ELSE 0 END AS turn FROM st WHERE pc IS NOT NULL),
sq AS (SELECT *, (sum(turn) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))::INT AS seq FROM tn),
rn AS (SELECT symbol, seq, CASE WHEN min(way) > 0 THEN 'up' WHEN min(way) < 0 THEN 'down' ELSE 'range' END AS type, min(pd) AS start_date, max(date) AS end_date, arg_min(pc, date) AS start_val, arg_max(close, date) AS end_val, count(*)::INT AS days, sum(volume)::BIGINT AS total_vol FROM sq GROUP BY symbol, seq),
waves AS (SELECT *, round((end_val / start_val - 1) * 100, 2) AS pct, abs(end_val - start_val) AS point_change, CASE WHEN abs(end_val - start_val) > 0 THEN total_vol / abs(end_val - start_val) END AS vpp, seq = max(seq) OVER (PARTITION BY symbol) AS is_open FROM rn),
ratios AS (SELECT *, abs(lag(pct) OVER (PARTITION BY symbol, type ORDER BY seq)) AS prev_pct, CASE WHEN abs(lag(pct) OVER (PARTITION BY symbol, type ORDER BY seq)) > 0 THEN abs(pct) / abs(lag(pct) OVER (PARTITION BY symbol, type ORDER BY seq)) END AS ratio FROM waves)"""
_LEVELS = ", ".join(f"({w / 10!r}::DOUBLE, {1 - w / 10!r}::DOUBLE)" for w in range(10, 0, -1))


def zigzag(pct: float, range_days: int = 22, range_pct: float = 3.5, index: str = INDEX) -> str:
    """Waves of the index: the turning points by a recursion over the bars, the
    range waves by a recursion over the legs."""
    return f"""RECURSIVE {index}, b AS MATERIALIZED (SELECT symbol, date, close, (row_number() OVER w - 1)::INT AS i, (count(*) OVER (PARTITION BY symbol))::INT AS n, sum(volume) OVER (w ROWS UNBOUNDED PRECEDING) AS cv FROM index WINDOW w AS (PARTITION BY symbol ORDER BY date)),
zz AS (SELECT symbol, 0 AS i, 0 AS hi, close AS hic, 0 AS lo, close AS loc, 0 AS way, 0 AS last, NULL::INT AS turn FROM b WHERE i = 0 UNION ALL
 SELECT symbol, i, CASE WHEN up THEN i ELSE hi END, CASE WHEN up THEN c ELSE hic END, CASE WHEN down THEN i ELSE lo END, CASE WHEN down THEN c ELSE loc END, CASE WHEN down THEN -1 WHEN up THEN 1 ELSE way END, coalesce(turned, last), turned
 FROM (SELECT *, CASE WHEN down AND hi <> last THEN hi WHEN up AND lo <> last THEN lo END AS turned
 FROM (SELECT *, way >= 0 AND c <= hic * {1 - pct / 100!r}::DOUBLE AS down, NOT (way >= 0 AND c <= hic * {1 - pct / 100!r}::DOUBLE) AND way <= 0 AND c >= loc * {1 + pct / 100!r}::DOUBLE AS up
 FROM (SELECT zz.symbol, b.i, b.close AS c, way, last, CASE WHEN way >= 0 AND b.close > hic THEN b.i ELSE hi END AS hi, CASE WHEN way >= 0 THEN greatest(b.close, hic) ELSE hic END AS hic,
 CASE WHEN way <= 0 AND b.close < loc THEN b.i ELSE lo END AS lo, CASE WHEN way <= 0 THEN least(b.close, loc) ELSE loc END AS loc FROM zz JOIN b ON b.symbol = zz.symbol AND b.i = zz.i + 1) AS moved) AS tested) AS turns),
pv AS (SELECT symbol, 0 AS p FROM b WHERE i = 0 UNION SELECT symbol, turn FROM zz WHERE turn IS NOT NULL UNION SELECT symbol, n - 1 FROM b WHERE i = 0),
lg AS MATERIALIZED (SELECT * FROM (SELECT symbol, p AS a, lead(p) OVER w AS z, row_number() OVER w - 1 AS k FROM pv WINDOW w AS (PARTITION BY symbol ORDER BY p)) WHERE z IS NOT NULL),
best AS (SELECT x.symbol, x.k, max(y.k) AS j FROM lg x JOIN lg y ON x.symbol = y.symbol AND y.k > x.k AND y.z - x.a >= {range_days} JOIN b p ON p.symbol = x.symbol AND p.i = x.a JOIN b q ON q.symbol = y.symbol AND q.i = y.z WHERE abs(q.close / p.close - 1) * 100 <= {range_pct}::DOUBLE GROUP BY ALL),
step AS MATERIALIZED (SELECT lg.symbol, lg.k, lg.a, coalesce(e.z, lg.z) AS z, j, coalesce(j, lg.k) + 1 AS nk FROM lg LEFT JOIN best ON best.symbol = lg.symbol AND best.k = lg.k LEFT JOIN lg e ON e.symbol = lg.symbol AND e.k = best.j),
mg AS (SELECT symbol, a, z, j, nk, 0 AS seq FROM step WHERE k = 0 UNION ALL SELECT s.symbol, s.a, s.z, s.j, s.nk, mg.seq + 1 FROM mg JOIN step s ON s.symbol = mg.symbol AND s.k = mg.nk),
waves AS (SELECT mg.symbol, mg.seq, CASE WHEN j IS NOT NULL THEN 'range' WHEN q.close >= p.close THEN 'up' ELSE 'down' END AS type, p.date AS start_date, q.date AS end_date, p.close AS start_val, q.close AS end_val, (z - a)::INT AS days, (q.cv - p.cv)::BIGINT AS total_vol, z = q.n - 1 AS is_open,
 round((q.close / p.close - 1) * 100, 2) AS pct, abs(q.close - p.close) AS point_change, CASE WHEN abs(q.close - p.close) > 0 THEN (q.cv - p.cv) / abs(q.close - p.close) END AS vpp FROM mg JOIN b p ON p.symbol = mg.symbol AND p.i = a JOIN b q ON q.symbol = mg.symbol AND q.i = z)"""


ALL_DAYS = 2**31 - 1
OPEN_WAVE = """, inside AS (SELECT w.symbol, max(b.close) AS peak, min(b.close) AS trough, sum(x.volume)::BIGINT AS flow FROM waves w JOIN b ON b.symbol = w.symbol AND b.date >= w.start_date JOIN index x ON x.symbol = b.symbol AND x.date = b.date WHERE w.is_open GROUP BY 1),
ups AS (SELECT symbol, avg(pct) AS mean_up, median(pct) AS median_up, max(pct) AS max_up, max(days) AS max_days FROM waves WHERE type = 'up' AND NOT is_open GROUP BY 1)
SELECT w.symbol, type, start_date, days, peak, trough, flow, round((end_val / start_val - 1) * 100, 2) AS cumulative_pct, round((peak / trough - 1) * 100, 2) AS peak_pct, round(trough * (1 + mean_up / 100), 3) AS mean_target, end_val >= round(trough * (1 + mean_up / 100), 3) AS mean_passed,
 round(trough * (1 + median_up / 100), 3) AS median_target, end_val >= round(trough * (1 + median_up / 100), 3) AS median_passed, round(start_val * (1 + max_up / 100), 2) AS ceiling, max_days - days AS days_left,
 CASE WHEN type = 'up' AND peak >= trough * (1 + mean_up / 100) THEN 'take profit: the mean target has passed' WHEN type = 'up' THEN 'hold: below the mean target' WHEN type = 'down' THEN 'defend: wait for a turn' ELSE 'accumulate within the range' END AS advice
FROM waves w JOIN inside USING (symbol) LEFT JOIN ups USING (symbol) WHERE w.is_open"""
WINRATE = """SELECT horizon, signal, count(*) AS n_signals, round(avg(CASE WHEN max_profit > 0 THEN 100.0::DOUBLE ELSE 0 END), 4) AS win_rate, round(avg(max_profit), 4) AS mean_profit, round(avg(max_drawdown), 4) AS mean_drawdown,
 max(max_profit) AS best_profit, min(max_drawdown) AS worst_drawdown, list_sort(list(max_profit))[count(*) // 2 + 1] AS median_profit FROM long WHERE max_profit IS NOT NULL GROUP BY 1, 2"""
ENVELOPE = """, ret AS (SELECT symbol, date, close, rsi, signal, '{' || string_agg('"' || horizon || '":' || CASE WHEN max_profit IS NULL AND max_drawdown IS NULL THEN 'null' ELSE '{"max_profit":' || coalesce(to_json(max_profit)::VARCHAR, 'null') || ',"max_drawdown":' || coalesce(to_json(max_drawdown)::VARCHAR, 'null') || '}' END, ',' ORDER BY horizon) || '}' AS r FROM long GROUP BY ALL),
sg AS (SELECT symbol, string_agg('{"date":"' || date || '","close":' || to_json(close)::VARCHAR || ',"rsi":' || coalesce(to_json(rsi)::VARCHAR, 'null') || ',"signal":' || signal || ',"returns":' || r || '}', ',' ORDER BY date, signal) AS s FROM ret GROUP BY 1),
sm AS (SELECT symbol, min(date) AS a, max(date) AS z, count(*) AS n FROM bars GROUP BY 1)
SELECT symbol, '{"symbol":"' || symbol || '","data_range":"' || a || ' ~ ' || z || '","total_days":' || n || ',"last_update":"' || z || ' 00:00:00","future_days":[1,3,5,10,20,60],"signals":[' || coalesce(s, '') || ']}' AS json FROM sm LEFT JOIN sg USING (symbol)"""
FLOW = "flow AS (SELECT l_shipdate::DATE AS date, round(sum(l_quantity), 2) AS flow FROM lineitem GROUP BY 1)"


def oracle_sql() -> dict[str, str]:
    events_rsi = f"WITH {EVENT_BARS}, {RSI} SELECT symbol, date, close, rsi FROM rsi"
    return {
        "bars_events": f"WITH {EVENT_BARS} SELECT * FROM bars",
        "bars_orders": f"WITH {ORDER_BARS} SELECT * FROM bars",
        "index_orders": f"WITH {INDEX} SELECT * FROM index",
        "rsi_wilder": events_rsi,
        "rsi_recursive": events_rsi,
        "local_extremes": f"WITH {ORDER_BARS}, {RSI}, {extremes(3)} SELECT symbol, date, close, is_peak, is_trough FROM cand",
        "divergence_v1": f"WITH {ORDER_BARS}, {RSI}, {extremes(3)}, {SIGNALS} SELECT symbol, date, close, rsi, signal FROM rsi JOIN sig USING (symbol, date) WHERE signal <> 0",
        "divergence_v2": f"WITH {ORDER_BARS}, {RSI}, {extremes(5)}, {PAIRED} SELECT r.symbol, r.date, r.close, r.rsi, s.signal FROM rsi r JOIN sig s USING (symbol, date) WHERE s.signal <> 0",
        "forward_excursion": FULL + "SELECT * FROM long",
        "side_filter": FULL + "SELECT symbol, date, signal, max_profit FROM long WHERE signal = 1 AND horizon = 20 AND max_profit IS NOT NULL",
        "winrate": FULL + WINRATE,
        "histogram": histogram("max_profit"),
        "histogram_drawdown": histogram("max_drawdown"),
        "series_summary": f"WITH {ORDER_BARS} SELECT symbol, min(date)::VARCHAR || ' ~ ' || max(date)::VARCHAR AS data_range, count(*) AS total_days, arg_max(close, date) AS last_close FROM bars GROUP BY 1",
        "factor_join": f"""WITH {ORDER_BARS}, flow AS (SELECT l_shipdate::DATE AS date, round(sum(l_quantity), 2) AS flow FROM lineitem GROUP BY 1), j AS (SELECT bars.*, coalesce(flow, 0.0) AS flow FROM bars LEFT JOIN flow USING (date))
SELECT symbol, date, flow, round(sum(flow) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 2) AS flow_5, round(sum(flow) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 2) AS flow_20,
 round(close - lag(close, 5) OVER w, 2) AS change_5, round(avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) AS ma_20 FROM j WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
        "upsert_latest": f"WITH {ORDER_BARS} SELECT symbol, date, CASE WHEN date >= DATE '1998-06-01' THEN round(close + 1, 2) ELSE close END AS close FROM bars",
        "json_unnest": f"WITH {ORDER_BARS} SELECT symbol, date, open, high, low, close FROM bars WHERE dayofyear(date) % 7 <> 0",
        "chart_read": f"WITH {ORDER_BARS} SELECT symbol, date, open, high, low, close FROM bars WHERE dayofyear(date) % 7 <> 0 AND date >= DATE '1993-03-01' AND date < DATE '1998-03-01'",
        "gap_drop": f"WITH {ORDER_BARS} SELECT symbol, date, open, close FROM bars WHERE day(date) <> 13",
        "freshness": f"WITH {ORDER_BARS} SELECT symbol, max(date) AS last_date, DATE '2001-08-02' - max(date) <= 1 AS is_fresh FROM bars GROUP BY 1",
        "wave_runs": f"WITH {RUNS} SELECT symbol, seq, type, start_date, end_date, start_val, end_val, pct, round(point_change, 2) AS point_change, days, total_vol, round(vpp, 4) AS vpp FROM waves",
        "vpp_by_type": f"WITH {RUNS}, m AS (SELECT symbol, type, count(*) AS n_waves, avg(vpp) AS v FROM waves GROUP BY 1, 2) SELECT m.symbol, m.type, m.n_waves, round(m.v, 4) AS mean_vpp, round(r.v / m.v, 4) AS range_ratio FROM m LEFT JOIN m r ON r.symbol = m.symbol AND r.type = 'range'",
        "wave_statistics": f"WITH {RUNS} SELECT symbol, type, count(*) AS n_waves, round(avg(pct), 4) AS mean_pct, round(median(pct), 4) AS median_pct, min(pct) AS min_pct, max(pct) AS max_pct, round(avg(days), 4) AS mean_days, round(median(days), 4) AS median_days FROM waves GROUP BY 1, 2",
        "wave_symmetry": f"WITH {RUNS} SELECT symbol, type, count(*) AS n_pairs, round(100 * avg(ratio), 2) AS mean_ratio_pct, round(100 * avg(CASE WHEN ratio BETWEEN 0.8::DOUBLE AND 1.25::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 2) AS near_pct FROM ratios WHERE ratio IS NOT NULL GROUP BY 1, 2",
        "exhaustion": f"""WITH {RUNS}, x AS (SELECT symbol, type, total_vol, lag(total_vol) OVER (PARTITION BY symbol, type ORDER BY seq) AS pv, lead(type) OVER (PARTITION BY symbol ORDER BY seq) AS nt FROM waves)
SELECT symbol, count(*) AS n_waves, sum((total_vol < pv AND nt <> type)::INT)::BIGINT AS n_hits, round(100 * avg((total_vol < pv AND nt <> type)::INT), 2) AS accuracy FROM x WHERE pv IS NOT NULL AND nt IS NOT NULL GROUP BY 1""",
        "winrate_levels": f"""WITH {RUNS}, o AS (SELECT symbol, type, ratio, row_number() OVER (PARTITION BY symbol, type ORDER BY ratio, seq) - 1 AS at, count(*) OVER (PARTITION BY symbol, type) AS n FROM ratios WHERE ratio IS NOT NULL),
lv(win_rate, rest) AS (VALUES {_LEVELS}), now AS (SELECT * FROM ratios WHERE is_open AND prev_pct IS NOT NULL),
p AS (SELECT now.symbol, now.type, win_rate, o.ratio, o.ratio * now.prev_pct AS t, now.start_val, now.end_val, CASE WHEN now.type = 'down' THEN -1.0 ELSE 1.0 END AS s FROM now JOIN o ON o.symbol = now.symbol AND o.type = now.type JOIN lv ON o.at = floor(o.n * rest)::BIGINT)
SELECT symbol, type, round(win_rate, 1) AS win_rate, round(ratio, 4) AS ratio, round(t, 2) AS target_pct, round(start_val * (1 + s * t / 100), 2) AS price, CASE WHEN type = 'down' THEN end_val <= round(start_val * (1 + s * t / 100), 2) ELSE end_val >= round(start_val * (1 + s * t / 100), 2) END AS reached FROM p""",
        "waves_zigzag": f"WITH {zigzag(5.0)} SELECT * FROM waves",
        "waves_long": f"WITH {zigzag(10.0)} SELECT * FROM waves",
        "zigzag_legs": f"WITH {zigzag(5.0, ALL_DAYS)} SELECT * FROM waves",
        "early_warning": f"WITH {zigzag(3.0, ALL_DAYS)} SELECT symbol, type AS state, start_date AS turn_date, start_val AS base_price, pct AS cumulative_pct, days FROM waves WHERE is_open",
        "open_wave": f"WITH {zigzag(5.0)}{OPEN_WAVE}",
        "open_leg": f"WITH {zigzag(5.0, ALL_DAYS)}{OPEN_WAVE}",
        "walk_index": f"WITH {WALK} SELECT * FROM index",
        "walk_waves": f"WITH {zigzag(5.0, index=WALK)} SELECT * FROM waves",
        "walk_waves_long": f"WITH {zigzag(10.0, index=WALK)} SELECT * FROM waves",
        "walk_legs": f"WITH {zigzag(5.0, ALL_DAYS, index=WALK)} SELECT * FROM waves",
        "walk_open_wave": f"WITH {zigzag(5.0, index=WALK)}{OPEN_WAVE}",
        "rsi_blocks": events_rsi,
        "signals_blocks": FULL + "SELECT * FROM long",
        "signals_v2_blocks": f"WITH {ORDER_BARS}, {RSI}, {extremes(5)}, {PAIRED}, {LONG} SELECT * FROM long",
        "winrate_blocks": FULL + WINRATE,
        "upsert_store": f"WITH {ORDER_BARS} SELECT symbol, date, CASE WHEN date >= DATE '1998-06-01' THEN round(close + 2, 2) WHEN date >= DATE '1998-03-01' THEN round(close + 1, 2) ELSE close END AS close FROM bars",
        "factor_asof": f"""WITH {ORDER_BARS}, f AS (SELECT o_orderpriority AS symbol, l_shipdate::DATE AS date, count(*)::BIGINT AS n_trades, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 49 GROUP BY ALL)
SELECT b.symbol, b.date, b.close, CASE WHEN b.date - f.date <= 5 THEN n_trades END AS n_trades, CASE WHEN b.date - f.date <= 5 THEN value END AS value FROM bars b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.date >= f.date""",
        "wave_flow": f"""WITH {RUNS}, {FLOW}, f AS (SELECT w.symbol, w.type, w.seq, sum(coalesce(flow, 0.0)) AS flow FROM waves w JOIN index x ON x.symbol = w.symbol AND x.date > w.start_date AND x.date <= w.end_date LEFT JOIN flow ON flow.date = x.date GROUP BY ALL)
SELECT symbol, type, count(*) AS n_waves, round(avg(flow), 2) AS mean_flow FROM f GROUP BY 1, 2""",
        "wave_segments": f"WITH {RUNS} SELECT symbol, type, start_date, end_date, start_val, end_val, pct, round(point_change, 2) AS point_change, days, total_vol, vpp FROM waves",
        "segments_csv": f"WITH {RUNS} SELECT symbol, type, start_date, end_date, start_val, end_val, pct, round(point_change, 2) AS point_change, days, total_vol, vpp FROM waves",
        "wave_report": f"""WITH {RUNS}, s AS (SELECT symbol, type, count(*) AS n, round(avg(abs(pct)), 2) AS m, round(median(abs(pct)), 2) AS d, round(avg(days), 1) AS t FROM waves GROUP BY 1, 2)
SELECT symbol, 1 AS section, printf('open wave: %-5s since %s (%.2f), now %.2f, %.2f%%, %d days', type, start_date::VARCHAR, start_val, end_val, pct, days) AS value FROM waves WHERE is_open
UNION ALL SELECT symbol, 2, printf('%-5s waves: %5d, mean %6.2f%% (median %6.2f%%), %5.1f days', type, n, m, d, t) FROM s""",
        "api_envelope": FULL + ENVELOPE,
        "text_report": FULL + f", t AS ({WINRATE}) SELECT printf('%4d | %3d | %8d | %8.2f | %8.3f', horizon, signal, n_signals, round(win_rate, 2), round(median_profit, 3)) AS value FROM t",
        "window_shape": f"""WITH {ORDER_BARS}, s AS (SELECT symbol, date, close, count(*) OVER w AS n, avg(close) OVER w AS m, stddev_pop(close) OVER w AS sd, first(close) OVER w AS f FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT symbol, date, round((f - m) / sd, 4) AS first, round((close - m) / sd, 4) AS last FROM s WHERE n = 30 AND sd > 0""",
        "embedding_top1": """WITH p AS (SELECT q.vec_id AS vec_id, e.vec_id AS match_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS similarity
 FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT vec_id, match_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, match_id) AS r FROM p) WHERE r = 1""",
        "embedding_top1_all": TOP1_ALL,
        "embedding_top1_pruned": TOP1_ALL,
    }
