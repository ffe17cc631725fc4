"""DuckDB statements of indicators that carry a state from bar to bar: recursions over the numbered bars of a series."""

from __future__ import annotations

from tickloom.sources import derived as d

W = "(PARTITION BY symbol, timeframe ORDER BY time)"


def numbered(source: str) -> str:
    """Bars with their number, the true range, and the move, gain and loss since the bar before (0 on the first)."""
    return f"""num AS (SELECT symbol, timeframe, time, row_number() OVER {W} AS n, high, low, close, (high + low) / 2 AS src,
  greatest(high - low, coalesce(abs(high - lag(close) OVER {W}), 0), coalesce(abs(low - lag(close) OVER {W}), 0)) AS tr,
  coalesce(abs(close - lag(close) OVER {W}), 0) AS mv, greatest(coalesce(close - lag(close) OVER {W}, 0), 0) AS g, greatest(coalesce(lag(close) OVER {W} - close, 0), 0) AS l FROM {source})"""


KEEP = "(1 - 1 / 14.0::DOUBLE)"
WILDER = f"""WITH RECURSIVE {d.BARS_SQL}, {numbered('bars')},
r AS (
  SELECT symbol, 14::BIGINT AS n, avg(g) AS u, avg(l) AS d, avg(tr) AS a FROM num WHERE n <= 14 GROUP BY symbol HAVING count(*) = 14
  UNION ALL SELECT r.symbol, r.n + 1, {KEEP} * r.u + s.g / 14, {KEEP} * r.d + s.l / 14, {KEEP} * r.a + s.tr / 14 FROM r JOIN num s ON s.symbol = r.symbol AND s.n = r.n + 1)
SELECT symbol, timeframe, time, round(CASE WHEN u IS NULL THEN 50 WHEN d = 0 THEN 100 WHEN u = 0 THEN 0 ELSE 100 - 100 / (1 + u / d) END, 6) AS wilder_rsi, round(a, 6) AS wilder_atr FROM num LEFT JOIN r USING (symbol, n)"""

A1, A2 = "(2 / 21.0::DOUBLE)", "(2 / 40.0::DOUBLE)"
STATES = f"""{numbered('walk')}, m10 AS (SELECT symbol, avg(tr) AS m FROM num WHERE n <= 10 GROUP BY symbol),
st AS (
  SELECT symbol, n, close, mv AS e1, mv AS e2, NULL::DOUBLE AS atr, src AS up, src AS dn, 1 AS trend, 1 AS was_trend, close AS f, 0.0::DOUBLE AS rng, 0 AS state, 0 AS was_state FROM num WHERE n = 1
  UNION ALL
  SELECT symbol, n, close, e1, e2, atr, up, dn, CASE WHEN pt = -1 AND close > pd THEN 1 WHEN pt = 1 AND close < pu THEN -1 ELSE pt END, pt, f, 2.5::DOUBLE * e2,
    CASE WHEN close > f AND f > pf THEN 1 WHEN close < f AND f < pf THEN -1 ELSE ps END, ps
  FROM (
    SELECT *, CASE WHEN pc > pu THEN greatest(src - 3 * coalesce(atr, 0), pu) ELSE src - 3 * coalesce(atr, 0) END AS up, CASE WHEN pc < pd THEN least(src + 3 * coalesce(atr, 0), pd) ELSE src + 3 * coalesce(atr, 0) END AS dn,
      CASE WHEN close > pf THEN greatest(close - 2.5::DOUBLE * e2, pf) ELSE least(close + 2.5::DOUBLE * e2, pf) END AS f
    FROM (
      SELECT *, {A2} * e1 + (1 - {A2}) * pe2 AS e2
      FROM (
        SELECT s.symbol, s.n, s.close, s.src, p.close AS pc, p.up AS pu, p.dn AS pd, p.trend AS pt, p.f AS pf, p.state AS ps, p.e2 AS pe2, {A1} * s.mv + (1 - {A1}) * p.e1 AS e1,
          CASE WHEN s.n < 10 THEN NULL WHEN s.n = 10 THEN m.m ELSE 0.1::DOUBLE * s.tr + (1 - 0.1::DOUBLE) * p.atr END AS atr
        FROM st p JOIN num s ON s.symbol = p.symbol AND s.n = p.n + 1 JOIN m10 m ON m.symbol = s.symbol)))),
ts AS (SELECT num.symbol, num.timeframe, num.time, num.close, up, dn, trend, trend = 1 AND was_trend = -1 AS buy, trend = -1 AND was_trend = 1 AS sell, f, rng, state, state = 1 AND was_state = -1 AS flip_buy, state = -1 AND was_state = 1 AS flip_sell
  FROM num JOIN st USING (symbol, n))"""
TREND_STATES = f"""WITH RECURSIVE {d.WALK_SQL}, {STATES}
SELECT symbol, timeframe, time, round(up, 6) AS up, round(dn, 6) AS dn, trend, buy, sell, round(f, 6) AS filter, state, flip_buy, flip_sell FROM ts"""
TREND_LINES = f"""WITH RECURSIVE {d.WALK_SQL}, {STATES} SELECT symbol, timeframe, time, CASE WHEN trend = 1 THEN round(up, 6) END AS up_line, CASE WHEN trend = -1 THEN round(dn, 6) END AS down_line FROM ts"""
BANDS = f"""WITH RECURSIVE {d.WALK_SQL}, {STATES} SELECT symbol, timeframe, time, round(f, 6) AS filter, round(f + rng, 6) AS high_band, round(f - rng, 6) AS low_band FROM ts"""
FLIP_EVENTS = f"""WITH RECURSIVE {d.WALK_SQL}, {STATES},
ev AS (SELECT symbol, timeframe, time, 'ST' AS source, 'BUY' AS kind, close AS price FROM ts WHERE buy UNION ALL SELECT symbol, timeframe, time, 'ST', 'SELL', close FROM ts WHERE sell
  UNION ALL SELECT symbol, timeframe, time, 'RF', 'BUY', close FROM ts WHERE flip_buy UNION ALL SELECT symbol, timeframe, time, 'RF', 'SELL', close FROM ts WHERE flip_sell),
c AS (SELECT *, lag(kind) OVER (PARTITION BY symbol, timeframe, source ORDER BY time) AS b FROM ev),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe, source ORDER BY time) AS n FROM c WHERE b IS NULL OR b <> kind)
SELECT symbol, timeframe, time, source, kind, price FROM n WHERE n > 1 OR kind = 'BUY'"""


def ewm(column: str, alpha: str, start: int = 1) -> str:
    """An exponential mean over the tail's bars from number `start` on, in closed form: a sum of weighted values."""
    return f"""SELECT a.symbol, a.timeframe, a.i, sum(b.{column} * CASE WHEN b.i = {start} THEN 1 ELSE {alpha} END * pow(1 - {alpha}, a.i - b.i)) AS v
  FROM x a JOIN x b ON a.symbol = b.symbol AND a.timeframe = b.timeframe AND b.i BETWEEN {start} AND a.i GROUP BY 1, 2, 3"""


A14, A12, A26, A9 = (f"(2 / {n + 1}.0::DOUBLE)" for n in (14, 12, 26, 9))
#: Over `t`, the numbered tail: RSI and MACD by exponential means that begin in it.
MOMENTUM = f"""x AS (SELECT *, greatest(coalesce(close - lag(close) OVER {W}, 0), 0) AS g, greatest(coalesce(lag(close) OVER {W} - close, 0), 0) AS l, (101 - n_back - (100 - n))::BIGINT AS i FROM t),
gu AS ({ewm('g', A14)}), ld AS ({ewm('l', A14)}), ef AS ({ewm('close', A12)}), es AS ({ewm('close', A26)}),
mo AS (SELECT x.symbol, x.timeframe, x.i, x.n_back, 100 - 100 / (1 + gu.v / (ld.v + 1e-10)) AS rsi, ef.v - es.v AS line FROM x JOIN gu USING (symbol, timeframe, i) JOIN ld USING (symbol, timeframe, i) JOIN ef USING (symbol, timeframe, i) JOIN es USING (symbol, timeframe, i)),
sg AS ({ewm('line', A9).replace('FROM x a JOIN x b', 'FROM mo a JOIN mo b')}),
hi AS (SELECT mo.*, mo.line - sg.v AS hist FROM mo JOIN sg USING (symbol, timeframe, i)),
mm AS (SELECT symbol, timeframe, arg_max(rsi, i) AS rsi_current, avg(rsi) AS rsi_mean, stddev_samp(rsi) AS rsi_std, regr_slope(rsi, i) FILTER (n_back <= 10) AS rsi_slope, avg((rsi > 70)::INT) * 100 AS ob, avg((rsi < 30)::INT) * 100 AS os,
  arg_max(hist, i) AS hist, avg(hist) FILTER (n_back <= 5) AS now, avg(hist) FILTER (n_back BETWEEN 6 AND 15) AS before FROM hi GROUP BY 1, 2),
momentum AS (SELECT symbol, timeframe, round(rsi_current, 2) AS rsi_current, round(rsi_mean, 2) AS rsi_mean, round(rsi_std, 2) AS rsi_std, round(rsi_slope, 4) AS rsi_slope, round(ob, 2) AS overbought_pct, round(os, 2) AS oversold_pct, round(hist, 6) AS macd_histogram,
  CASE WHEN now > before * 1.1::DOUBLE THEN 1 WHEN now < before * 0.9::DOUBLE THEN -1 ELSE 0 END AS macd_trend FROM mm)"""

ROWS14 = "OVER (PARTITION BY symbol, timeframe ORDER BY time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
#: Over `x` of MOMENTUM: directional movement, its index and strength by exponential means.
DIRECTIONAL = f"""dm AS (SELECT *, high - lag(high) OVER {W} AS up, lag(low) OVER {W} - low AS dn, CASE WHEN count(tr) {ROWS14} = 14 THEN avg(tr) {ROWS14} END AS atr FROM (SELECT * REPLACE (CASE WHEN i = 1 THEN high - low ELSE tr END AS tr) FROM x)),
dp AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm FROM dm), dq AS (SELECT *, CASE WHEN dn > pdm AND dn > 0 THEN dn ELSE 0 END AS mdm FROM dp),
pe AS ({ewm('pdm', A14).replace('FROM x a JOIN x b', 'FROM dq a JOIN dq b')}), me AS ({ewm('mdm', A14).replace('FROM x a JOIN x b', 'FROM dq a JOIN dq b')}), ae AS ({ewm('atr', A14, 14).replace('FROM x a JOIN x b', 'FROM dq a JOIN dq b')}),
di AS (SELECT symbol, timeframe, i, 100 * (pe.v / ae.v) AS pdi, 100 * (me.v / ae.v) AS mdi FROM pe JOIN me USING (symbol, timeframe, i) JOIN ae USING (symbol, timeframe, i)),
dx AS (SELECT *, 100 * abs(pdi - mdi) / (pdi + mdi + 1e-10) AS dx FROM di), ax AS ({ewm('dx', A14, 14).replace('FROM x a JOIN x b', 'FROM dx a JOIN dx b')}),
dd AS (SELECT symbol, timeframe, arg_max(ax.v, i) AS adx, arg_max(pdi, i) AS p, arg_max(mdi, i) AS m FROM dx JOIN ax USING (symbol, timeframe, i) GROUP BY 1, 2),
directional AS (SELECT symbol, timeframe, round(adx, 2) AS adx, round(p, 2) AS plus_di, round(m, 2) AS minus_di, round(CASE WHEN p + m > 0 THEN abs(p - m) / (p + m) * 100 ELSE 0 END, 2) AS trend_strength_pct FROM dd)"""
