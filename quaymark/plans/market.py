"""Queries: sources, bars, as-of joins, indicators, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaymark.operators import asof, bars, indicators as ind, signals, traffic
from quaymark.plans.ctes import define
from quaymark.plans.registry import query
from quaymark.sources import files
from quaymark.sources.tables import SYMBOLS, Tables

ALL_FRAMES = ("1h", "4h", "8h", "1d", "3d", "1w")

define("specs", """SELECT 'base' AS spec, tf, 10 AS atr_n, 3.0::DOUBLE AS mult FROM frames
    UNION ALL SELECT 'signal', '1w', 7, 4.0 UNION ALL SELECT 'signal', '1d', 21, 4.0
    UNION ALL SELECT 'signal', '4h', 7, 4.0""")
define("ranges", """SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr
    FROM candle_rows""")
define("atrs", """SELECT *, CASE WHEN i >= 7 THEN avg(tr) OVER (w ROWS 6 PRECEDING) END AS atr_7,
        CASE WHEN i >= 10 THEN avg(tr) OVER (w ROWS 9 PRECEDING) END AS atr_10,
        CASE WHEN i >= 21 THEN avg(tr) OVER (w ROWS 20 PRECEDING) END AS atr_21
    FROM ranges WINDOW w AS (PARTITION BY symbol, tf ORDER BY label)""")
define("st_in", """SELECT a.symbol, a.tf, s.spec, a.i, a.n, a.label, a.close, s.atr_n,
        (high + low) / 2 + mult * CASE atr_n WHEN 7 THEN atr_7 WHEN 10 THEN atr_10 ELSE atr_21 END AS raw_up,
        (high + low) / 2 - mult * CASE atr_n WHEN 7 THEN atr_7 WHEN 10 THEN atr_10 ELSE atr_21 END AS raw_lo
    FROM atrs a JOIN specs s ON a.tf = s.tf""")
define("st", """/* RECURSIVE */ SELECT symbol, tf, spec, i, n, label, atr_n, close, raw_up AS up, raw_lo AS lo, TRUE AS bull
        FROM st_in WHERE i = 1
    UNION ALL
    SELECT x.symbol, x.tf, x.spec, x.i, x.n, x.label, x.atr_n, x.close,
        CASE WHEN st.up IS NULL OR x.raw_up < st.up OR st.close > st.up THEN x.raw_up ELSE st.up END AS nu,
        CASE WHEN st.lo IS NULL OR x.raw_lo > st.lo OR st.close < st.lo THEN x.raw_lo ELSE st.lo END AS nl,
        CASE WHEN st.up IS NULL OR x.raw_up IS NULL THEN TRUE
            WHEN st.bull THEN x.close >= CASE WHEN x.raw_lo > st.lo OR st.close < st.lo THEN x.raw_lo ELSE st.lo END
            ELSE x.close > CASE WHEN x.raw_up < st.up OR st.close > st.up THEN x.raw_up ELSE st.up END END
    FROM st JOIN st_in x ON x.symbol = st.symbol AND x.tf = st.tf AND x.spec = st.spec AND x.i = st.i + 1""")
# Closed-candle direction on base bars by a true as-of join on the availability time.
define("closed_st", """SELECT symbol, tf, spec, bull, n, atr_n,
        lead(label) OVER (PARTITION BY symbol, tf, spec ORDER BY label) AS seen_from FROM st""")
define("dirs", """SELECT a.symbol, a.ts, a.tf, coalesce(c.bull, TRUE) AS bull
    FROM (SELECT symbol, ts, tf FROM aligned, frames) a
    ASOF LEFT JOIN (SELECT * FROM closed_st WHERE spec = 'base' AND seen_from IS NOT NULL) c
        ON a.symbol = c.symbol AND a.tf = c.tf AND a.ts >= c.seen_from""")
define("greens", """SELECT symbol, ts, sum(bull::INT)::BIGINT AS green FROM dirs
    WHERE tf IN ('1h', '4h', '8h', '1d') GROUP BY ALL""")
define("votes", """SELECT symbol, ts, sum(CASE WHEN tf IN ('1h', '4h', '8h', '1d') THEN bull::INT END)::BIGINT AS green,
        bool_or(tf = '1d' AND NOT bull) AS bearish_1d, bool_or(tf = '3d' AND NOT bull) AS bearish_3d,
        bool_or(tf = '1w' AND NOT bull) AS bearish_1w
    FROM dirs GROUP BY ALL""")
define("ranked", """SELECT ts, arg_max(symbol, (green, -ord)) AS strongest, max(green) AS strongest_green,
        arg_min(symbol, (green, ord)) AS weakest, min(green) AS weakest_green
    FROM (SELECT *, list_position(['click', 'error', 'purchase', 'signup', 'view'], symbol) AS ord FROM greens)
    GROUP BY ts""")
define("rets", """SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r,
        row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM aligned""")


@query("candles_latest", "O-S1 D2", """
    SELECT symbol, date_trunc('hour', ts) AS ts, value AS open, value * 1.01::DOUBLE AS high, value * 0.99::DOUBLE AS low,
        value AS close, CAST(user_id AS DOUBLE) AS volume
    FROM events WHERE date_trunc('hour', ts) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'
    QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id DESC) = 1
    """.replace("SELECT symbol", "SELECT event_type AS symbol"), doubles="open high low close volume")
def _candles(t: Tables):
    return bars.latest_candles(t.candles_raw, "2024-01-05", "2024-01-20")


@query("funding_attached", "O-S4", """
    SELECT b.symbol, b.ts, b.close, coalesce(f.rate, 0) AS funding_rate
    FROM bars b LEFT JOIN (SELECT ts, (close - 50) / 100000 AS rate FROM bars WHERE symbol = 'signup' AND hour(ts) % 8 = 0) f
    ON b.ts = f.ts""", doubles="close funding_rate", digits=8)
def _funding(t: Tables):
    rates = t.bars.filter((F.col("symbol") == "signup") & (F.hour("ts") % 8 == 0)).select(
        "ts", ((F.col("close") - 50.0) / 100000.0).alias("funding_rate")
    )
    return files.attach_funding(t.bars, rates).select("symbol", "ts", "close", "funding_rate")


@query("mark_price_asof", "O-J2 O-S5", """
    SELECT l.event_id, l.user_id, l.ts, r.mark, r.mark_ts
    FROM (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase') l
    ASOF LEFT JOIN (SELECT user_id, ts AS mark_ts, CASE WHEN value >= 10 THEN value END AS mark
                    FROM events WHERE event_type = 'purchase') r
    ON l.user_id = r.user_id AND l.ts >= r.mark_ts""", doubles="mark")
def _marks(t: Tables):
    marks = t.events.filter("event_type = 'purchase'").select(
        "user_id", "ts", F.col("ts").alias("mark_ts"), F.when(F.col("value") >= 10, F.col("value")).alias("mark")
    )
    left = t.events.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return asof.backward_asof(left, marks, ["user_id"], ["mark", "mark_ts"])


@query("tick_bars_1h", "O-B6 O-B1 D1", "SELECT * FROM bars", doubles="open high low close volume")
def _tick_bars(t: Tables):
    return t.bars


@query("bars_aligned", "O-J1", "SELECT * FROM aligned", doubles="open high low close volume")
def _aligned(t: Tables):
    return t.aligned


@query("candles_multi", "O-B1 O-B2", "SELECT * FROM candles", doubles="open high low close volume")
def _candles_multi(t: Tables):
    return bars.resample(t.aligned, ALL_FRAMES)


@query("candles_closed", "O-B3 O-B4", """SELECT symbol, tf, label, close, next_label AS available_at
    FROM candle_rows WHERE i < n""", doubles="close")
def _closed(t: Tables):
    return bars.closed_candles(bars.resample(t.aligned, ALL_FRAMES)).select(
        "symbol", "tf", "label", "close", "available_at"
    )


@query("period_12h_last", "O-B5 O-M12", """
    SELECT run_id, time_bucket(INTERVAL 12 HOURS, ts) AS period, arg_max(portfolio_value, ts) AS portfolio_value,
        arg_max(price, ts) AS price
    FROM history JOIN (SELECT run_id, arg_min(ts, (dd, ts)) AS worst FROM (
            SELECT run_id, ts, portfolio_value / max(portfolio_value) OVER (PARTITION BY run_id ORDER BY ts) - 1 AS dd
            FROM history) GROUP BY 1) c USING (run_id)
    WHERE ts BETWEEN worst - INTERVAL 5 DAYS AND worst + INTERVAL 5 DAYS
    GROUP BY 1, 2""", doubles="portfolio_value price")
def _period_last(t: Tables):
    from quaymark.operators.metrics import worst_drawdown

    centre = worst_drawdown(t.history).select("run_id", "worst_ts")
    near = t.history.join(centre, "run_id").filter(
        F.col("ts").between(
            F.col("worst_ts") - F.expr("INTERVAL 5 DAYS"), F.col("worst_ts") + F.expr("INTERVAL 5 DAYS")
        )
    )
    return bars.period_last(near, ["run_id"], 12, ["portfolio_value", "price"])


@query("true_range_atr", "O-I1 O-I2", "SELECT symbol, tf, label, tr AS true_range, atr_7, atr_10 FROM atrs",
       doubles="true_range atr_7 atr_10")
def _atr(t: Tables):
    return ind.with_atr(bars.resample(t.aligned, ALL_FRAMES), [7, 10]).select(
        "symbol", "tf", "label", "true_range", "atr_7", "atr_10"
    )


@query("supertrend_states", "O-I3 O-G1", "SELECT symbol, tf, label, spec, bull FROM st")
def _supertrend(t: Tables):
    candles = bars.resample(t.aligned, ALL_FRAMES)
    specs = [ind.TrendSpec("base", 10, 3.0)] + [
        ind.TrendSpec("signal", n, m, tf) for tf, (n, m) in signals.SignalConfig().trend.items()
    ]
    return ind.trend_states(candles, specs).select("symbol", "tf", "label", "spec", "bull")


define("emas", """/* RECURSIVE */ SELECT symbol, tf, i, label, close AS ema_5, close AS ema_12 FROM candle_rows WHERE i = 1
    UNION ALL SELECT c.symbol, c.tf, c.i, c.label, c.close * (2.0::DOUBLE / 6) + e.ema_5 * (1 - 2.0::DOUBLE / 6),
        c.close * (2.0::DOUBLE / 13) + e.ema_12 * (1 - 2.0::DOUBLE / 13)
    FROM emas e JOIN candle_rows c ON c.symbol = e.symbol AND c.tf = e.tf AND c.i = e.i + 1""")
define("rsis", """SELECT symbol, tf, label, CASE WHEN al > 0 THEN 100 - 100 / (1 + ag / al) ELSE 100 END AS rsi_14
    FROM (SELECT symbol, tf, label,
            avg(CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0 END) OVER w AS ag,
            avg(CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0 END) OVER w AS al
        FROM (SELECT *, close - pc AS d FROM candle_rows)
        WINDOW w AS (PARTITION BY symbol, tf ORDER BY label ROWS 13 PRECEDING))""")


@query("ema_votes", "O-I4 O-I5", """SELECT symbol, tf, label, ema_5, ema_12,
    CASE WHEN ema_5 < ema_12 THEN -1.0 ELSE 1.0 END::DOUBLE AS vote FROM emas""", doubles="ema_5 ema_12")
def _ema(t: Tables):
    states = ind.trend_states(bars.resample(t.aligned, ALL_FRAMES), [ind.TrendSpec("base", 10, 3.0)], (5, 12))
    return states.select(
        "symbol", "tf", "label", "ema_5", "ema_12", ind.ema_vote(F.col("ema_5"), F.col("ema_12")).alias("vote")
    )


@query("rsi_votes", "O-I6 O-I7", """SELECT symbol, tf, label, rsi_14,
    CASE WHEN rsi_14 >= 60 THEN -1.0 WHEN rsi_14 <= 40 THEN 1.0 ELSE 0.0 END::DOUBLE AS vote FROM rsis""",
       doubles="rsi_14")
def _rsi(t: Tables):
    return ind.with_rsi(bars.resample(t.aligned, ALL_FRAMES), [14]).select(
        "symbol", "tf", "label", "rsi_14", ind.rsi_vote(F.col("rsi_14"), 40.0, 60.0).alias("vote")
    )


@query("realized_vol", "O-I8 O-I16", """
    SELECT symbol, ts, CASE WHEN count(r) OVER w48 >= 12 THEN stddev_samp(r) OVER w48 * sqrt(8760) END AS annual_vol,
        CASE WHEN count(r) OVER w24 = 24 THEN stddev_pop(r) OVER w24 END AS window_vol
    FROM rets WINDOW w48 AS (PARTITION BY symbol ORDER BY ts ROWS 47 PRECEDING),
        w24 AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING)""", doubles="annual_vol window_vol")
def _vol(t: Tables):
    r = t.aligned.withColumn("r", ind.returns())
    return r.select(
        "symbol", "ts", ind.annual_vol(F.col("r"), 48).alias("annual_vol"),
        ind.population_vol(F.col("r"), 24).alias("window_vol"),
    )


define("flat", """
    SELECT symbol, ts, vol_percentile,
        coalesce(top >= 0.8 AND vol_percentile <= top - 0.25
            AND vol_percentile - lag(vol_percentile, 24) OVER (PARTITION BY symbol ORDER BY ts) <= 0, FALSE) AS flattening
    FROM (SELECT *, max(vol_percentile) OVER (PARTITION BY symbol ORDER BY ts ROWS 71 PRECEDING) AS top FROM (
        SELECT a.symbol, a.ts, CASE WHEN any_value(a.v) IS NOT NULL AND count(b.v) >= 48 THEN
            (count(*) FILTER (b.v < a.v) + (count(*) FILTER (b.v = a.v) + 1) / 2.0::DOUBLE) / count(b.v) END AS vol_percentile
        FROM vols a JOIN vols b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 191 AND a.i
        GROUP BY a.symbol, a.ts))""")
define("vols", """SELECT symbol, ts, i, CASE WHEN s = 0 THEN 0 ELSE round(s * pow(10, 11 - floor(log10(s)))) / pow(10, 11 - floor(log10(s))) END AS v
    FROM (SELECT symbol, ts, i, CASE WHEN count(r) OVER w >= 8 THEN stddev_samp(r) OVER w END AS s
        FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING))""")


@query("vol_flattening", "O-I9 O-I10", "SELECT * FROM flat", doubles="vol_percentile", digits=6)
def _flat(t: Tables):
    return ind.vol_flattening(t.aligned, 24, 192, 0.8, 0.25, 72, 24).select(
        "symbol", "ts", "vol_percentile", "flattening"
    )


@query("breakouts", "O-I11 O-I12 O-I14", """
    SELECT symbol, ts, close / lag(close, 24) OVER w - 1 AS return_24,
        coalesce(i > 48 AND close < min(close) OVER (w ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING), FALSE) AS donchian,
        coalesce(close > max(high) OVER (w ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING), FALSE) AS above_high,
        greatest(0, (max(high) OVER (w ROWS 47 PRECEDING) - close) / max(high) OVER (w ROWS 47 PRECEDING)) AS high_drawdown
    FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts)""", doubles="return_24 high_drawdown")
def _breakouts(t: Tables):
    key = ("symbol",)
    never = F.lit(0.0)
    return t.aligned.select(
        "symbol", "ts",
        ind.n_bar_return(24).alias("return_24"),
        ind.donchian_break(48).alias("donchian"),
        ind.breakout(48, never, never, key, "ts").alias("above_high"),
        ind.drawdown_from_high(48).alias("high_drawdown"),
    )


@query("vol_expansion", "O-I13", """
    SELECT symbol, ts, vol_now, vol_median, coalesce(i - 1 >= 48 AND vol_median > 0 AND vol_now >= 1.2 * vol_median, FALSE) AS vol_expanded
    FROM (SELECT *, median(vol_now) OVER (PARTITION BY symbol ORDER BY ts ROWS 167 PRECEDING) AS vol_median
        FROM (SELECT *, CASE WHEN count(r) OVER w >= 24 THEN stddev_samp(r) OVER w END AS vol_now FROM rets
              WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING)))""", doubles="vol_now vol_median", digits=6)
def _expansion(t: Tables):
    return ind.vol_expansion(t.aligned, 24, 168, 1.2).select("symbol", "ts", "vol_now", "vol_median", "vol_expanded")


@query("relative_strength", "O-I15", """
    WITH r AS (SELECT symbol, ts, close / lag(close, 24) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM aligned)
    SELECT a.ts, a.r AS basis_return, b.r AS other_return, coalesce(a.r - b.r, 0) AS underperformance
    FROM r a JOIN r b ON a.ts = b.ts WHERE a.symbol = 'click' AND b.symbol = 'view'""",
       doubles="basis_return other_return underperformance")
def _strength(t: Tables):
    return ind.relative_strength(t.aligned, "click", "view", 24)


@query("green_counts", "O-G2 O-G10", "SELECT * FROM greens")
def _greens(t: Tables):
    return traffic.green_counts(traffic.directions(t.aligned, traffic.VOTE_FRAMES))


@query("strongest_weakest", "O-G12 (flagship: O-B6 O-J1 O-B1 O-I3 O-B3 O-J2 O-G10 O-G12)", "SELECT * FROM ranked")
def _ranked(t: Tables):
    return traffic.rank_symbols(
        traffic.green_counts(traffic.directions(t.aligned, traffic.VOTE_FRAMES)), SYMBOLS
    )


@query("trend_votes", "O-G11", "SELECT * FROM votes")
def _votes(t: Tables):
    return traffic.vote_rows(traffic.directions(t.aligned, ALL_FRAMES))
