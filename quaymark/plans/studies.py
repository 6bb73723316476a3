"""Queries: exposure signals, traffic-light targets, sweeps and report marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.operators import asof, indicators as ind, metrics, reports, signals, sweep, traffic
from quaymark.plans.ctes import define
from quaymark.plans.market import ALL_FRAMES
from quaymark.plans.performance import with_debt
from quaymark.plans.registry import query
from quaymark.sources.tables import SYMBOLS, Tables

CFG = signals.SignalConfig(
    ema=(5, 12), rsi_period=14, rsi_bounds=(40.0, 60.0), weights=(1.0, 0.5, 0.25), filter_period=14,
    filter_bounds=(35.0, 65.0), breakout_lookback=10, breakout_ema=(5, 12), vol_window=48, vol_target=40.0,
    confidence=True, bull_floor=0.5, bull_floor_needs_4h=True,
)

define("sig_candles", """SELECT c.symbol, c.tf, c.next_label AS seen_from,
        CASE WHEN c.n - 1 < greatest(s.atr_n, 2) THEN 0 WHEN s.bull THEN 1 ELSE -1 END::DOUBLE AS st_vote,
        CASE WHEN ema_5 < ema_12 THEN -1 ELSE 1 END::DOUBLE AS ema_v,
        CASE WHEN rsi_14 >= 60 THEN -1 WHEN rsi_14 <= 40 THEN 1 ELSE 0 END::DOUBLE AS rsi_v,
        CASE WHEN rsi_14 >= 65 THEN -1 WHEN rsi_14 <= 35 THEN 1 ELSE 0 END::DOUBLE AS filter_v,
        (coalesce(c.close > max(c.high) OVER (PARTITION BY c.symbol, c.tf ORDER BY c.label ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), FALSE)
            OR (c.close > ema_5 AND ema_5 > ema_12))::INT::DOUBLE AS brk
    FROM candle_rows c JOIN st s ON s.symbol = c.symbol AND s.tf = c.tf AND s.label = c.label AND s.spec = 'signal'
    JOIN emas e ON e.symbol = c.symbol AND e.tf = c.tf AND e.label = c.label
    JOIN rsis r ON r.symbol = c.symbol AND r.tf = c.tf AND r.label = c.label""")
define("sig_rows", """SELECT a.symbol, a.ts, a.close, a.tf, coalesce(st_vote, 0) AS st_vote, coalesce(ema_v, 0) AS ema_v, coalesce(rsi_v, 0) AS rsi_v,
        coalesce(filter_v, 0) AS filter_v, coalesce(brk, 0) AS brk
    FROM (SELECT symbol, ts, close, tf FROM aligned, frames WHERE tf IN ('1w', '1d', '4h')) a
    ASOF LEFT JOIN (SELECT * FROM sig_candles WHERE seen_from IS NOT NULL) c ON a.symbol = c.symbol AND a.tf = c.tf AND a.ts >= c.seen_from""")
define("sig", """SELECT *, CASE WHEN abs(filtered_score) < 0.15 THEN 0 ELSE filtered_score END AS signal FROM (
        SELECT *, CASE WHEN b > 0 AND f < 0 THEN greatest(b + 0.5 * f, 0) WHEN b < 0 AND f > 0 THEN least(b + 0.5 * f, 0) ELSE b END AS filtered_score
        FROM (SELECT *, st_score + 0.5 * ema_score + 0.25 * rsi_score AS raw_score,
                least(1, greatest(-1, st_score + 0.5 * ema_score + 0.25 * rsi_score)) AS b
            FROM (SELECT symbol, ts, any_value(close) AS close, avg(st_vote) AS st_score, avg(ema_v) AS ema_score, avg(rsi_v) AS rsi_score,
                max(filter_v) FILTER (tf = '1d') AS f, max(brk) FILTER (tf = '1d') AS brk, max(st_vote) FILTER (tf = '1w') AS w1,
                max(st_vote) FILTER (tf = '1d') AS d1, max(st_vote) FILTER (tf = '4h') AS h4 FROM sig_rows GROUP BY ALL)))""")


@query("trend_signal", "O-G1 O-G2 O-G3 O-G4 O-G5 D12", """
    SELECT symbol, ts, close, w1 AS supertrend_1w, d1 AS supertrend_1d, h4 AS supertrend_4h, raw_score, f AS rsi_filter_signal,
        filtered_score, signal FROM sig""", doubles="close supertrend_1w supertrend_1d supertrend_4h raw_score rsi_filter_signal filtered_score signal")
def _signal(t: Tables):
    return signals.trend_signal(t.aligned, CFG).select(
        "symbol", "ts", "close", "supertrend_1w", "supertrend_1d", "supertrend_4h", "raw_score", "rsi_filter_signal",
        "filtered_score", "signal",
    )


@query("trend_overlays", "O-G6 O-G7", """
    WITH o AS (SELECT sig.*, flattening, signal > 0 AND w1 > 0 AND d1 > 0 AS agree FROM sig JOIN flat USING (symbol, ts)),
    p AS (SELECT *, agree AND h4 > 0 AND brk <> 0 AS broke FROM o),
    q AS (SELECT *, least(5, greatest(-1, CASE WHEN broke THEN greatest(signal, 3) WHEN agree THEN greatest(signal, 2) ELSE signal END)) AS t FROM p)
    SELECT symbol, ts, agree AS trend_overlay_active, CASE WHEN broke THEN 'breakout' WHEN agree THEN 'agreement' ELSE '' END AS trend_overlay_reason,
        flattening AND agree AS vol_flattening_overlay_active,
        least(10, greatest(-10, CASE WHEN flattening AND agree THEN greatest(t, 1.05) ELSE t END)) AS target_exposure FROM q""", doubles="target_exposure")
def _overlays(t: Tables):
    sig = signals.trend_overlay(signals.trend_signal(t.aligned, CFG), CFG)
    flat = ind.vol_flattening(t.aligned, 24, 192, 0.8, 0.25, 72, 24).select("symbol", "ts", "flattening")
    out = signals.flattening_overlay(sig.join(flat, ["symbol", "ts"]), F.col("flattening"), CFG)
    return out.select(
        "symbol", "ts", "trend_overlay_active", "trend_overlay_reason", "vol_flattening_overlay_active", "target_exposure"
    )


@query("vol_target_overlay", "O-G8 O-G9", """
    WITH v AS (SELECT s.*, CASE WHEN count(r) OVER w >= 12 THEN stddev_samp(r) OVER w * sqrt(8760) END AS vol, st_score * sign(signal) AS conf
            FROM sig s JOIN rets USING (symbol, ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 47 PRECEDING)),
    c AS (SELECT *, CASE WHEN conf >= 0.99 THEN 1.2 WHEN conf >= 0.33 THEN 1.0 ELSE 0.7 END::DOUBLE AS cm FROM v),
    m AS (SELECT *, coalesce(last_value(CASE WHEN vol > 0 THEN 40 * cm / vol END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts), 1) AS mult FROM c),
    f AS (SELECT *, signal > 0 AND w1 > 0 AND d1 > 0 AND h4 > 0 AS floor_on, least(2, greatest(-1, signal * mult)) AS t FROM m)
    SELECT symbol, ts, coalesce(vol, 0) AS vol_target_realized_vol, conf AS vol_target_confidence, cm AS vol_target_confidence_multiplier,
        mult AS vol_target_multiplier, floor_on AS vol_target_bull_floor_active, CASE WHEN floor_on THEN greatest(t, 0.5) ELSE t END AS target_exposure FROM f""",
       doubles="vol_target_realized_vol vol_target_confidence vol_target_confidence_multiplier vol_target_multiplier target_exposure")
def _vol_target(t: Tables):
    return signals.vol_target_overlay(signals.trend_signal(t.aligned, CFG), CFG).select(
        "symbol", "ts", "vol_target_realized_vol", "vol_target_confidence", "vol_target_confidence_multiplier",
        "vol_target_multiplier", "vol_target_bull_floor_active", "target_exposure",
    )


@query("leg_selection", "O-G13 O-G14", """
    WITH l AS (SELECT ts, CASE WHEN strongest_green >= 3 THEN strongest ELSE '' END AS selected_long, weakest, weakest_green FROM ranked),
    s AS (SELECT ts, selected_long, CASE WHEN weakest_green <= 1 AND weakest <> selected_long THEN weakest ELSE '' END AS selected_short FROM l)
    SELECT s.*, coalesce((SELECT arg_min(symbol, (green, symbol)) FROM greens g WHERE g.ts = s.ts AND symbol IN ('click', 'view', 'signup')
        AND symbol <> s.selected_long), '') AS protective_short FROM s""")
def _legs(t: Tables):
    greens = traffic.green_counts(traffic.directions(t.aligned, traffic.VOTE_FRAMES))
    legs = traffic.select_legs(traffic.rank_symbols(greens, SYMBOLS, keep_greens=True), 3, 1)
    return traffic.protective_short(legs, ["click", "view", "signup"]).select(
        "ts", "selected_long", "selected_short", "protective_short"
    )


@query("hedge_targets", "O-G15 O-G16 O-G17 O-G20", """
    SELECT symbol, ts, green, CASE green WHEN 4 THEN 0 WHEN 3 THEN 0.25 WHEN 2 THEN 0.5 ELSE 0.75 END::DOUBLE AS hedge_ratio,
        CASE green WHEN 4 THEN 0 WHEN 3 THEN 0.35 WHEN 2 THEN 0.75 ELSE 1 END::DOUBLE AS cover_ratio,
        CASE green WHEN 4 THEN 'green' WHEN 3 THEN 'lime' WHEN 2 THEN 'yellow' WHEN 1 THEN 'orange' WHEN 0 THEN 'red' ELSE 'unknown' END AS colour,
        CASE WHEN bearish_3d AND bearish_1w THEN 1.25 WHEN bearish_3d THEN 1.0 ELSE 0.75 END::DOUBLE AS crisis_floor,
        greatest(0.05, CASE green WHEN 3 THEN 0.05 WHEN 2 THEN 0.1 ELSE 0 END)::DOUBLE AS protective_floor FROM votes""",
       doubles="hedge_ratio cover_ratio crisis_floor protective_floor")
def _hedge(t: Tables):
    votes = traffic.vote_rows(traffic.directions(t.aligned, ALL_FRAMES))
    g = F.col("green")
    return votes.select(
        "symbol", "ts", "green", traffic.ladder(g, traffic.HEDGE_LADDER).alias("hedge_ratio"),
        traffic.ladder(g, traffic.COVER_LADDER).alias("cover_ratio"), traffic.colour(g).alias("colour"),
        traffic.crisis_floor(F.col("bearish_3d"), F.col("bearish_1w")).alias("crisis_floor"),
        F.greatest(F.lit(0.05), traffic.ladder(g, {3: 0.05, 2: 0.1})).alias("protective_floor"),
    )


def _equity(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    rows = metrics.with_drawdown(t.history).withColumn("dd", -F.col("drawdown"))
    change = F.col("dd") - F.lag("dd").over(W.partitionBy("run_id").orderBy("ts"))
    return rows.withColumn("worsening", F.coalesce(change, F.lit(0.0)))


define("eq", """SELECT *, coalesce(dd - lag(dd) OVER (PARTITION BY run_id ORDER BY ts), 0) AS worsening
    FROM (SELECT *, (peak - portfolio_value) / peak AS dd FROM hist)""")


@query("exposure_caps", "O-G18 O-G19", """
    WITH a AS (SELECT run_id, ts, realized_vol_pct, least(target_long_fraction, CASE WHEN long_green >= 4 THEN 1.075 WHEN long_green >= 3 THEN 1.025 ELSE 0 END::DOUBLE) AS by_signal,
        least(target_long_fraction, CASE WHEN dd >= 0.04 THEN 0.25 WHEN dd >= 0.02 THEN 0.5 ELSE target_long_fraction END::DOUBLE) AS by_drawdown FROM eq)
    SELECT run_id, ts, by_signal, by_drawdown, CASE WHEN realized_vol_pct > 2 THEN
        least(by_drawdown, greatest(0.1, by_drawdown * 2 / realized_vol_pct)) ELSE by_drawdown END AS by_vol FROM a""",
       doubles="by_signal by_drawdown by_vol")
def _caps(t: Tables):
    rows = _equity(t)
    base = F.col("target_long_fraction")
    rows = rows.withColumns(
        {
            "by_signal": traffic.signal_cap(base, F.col("long_green"), [(3, 1.025), (4, 1.075)]),
            "by_drawdown": traffic.drawdown_cap(base, F.col("dd"), [(0.02, 0.5), (0.04, 0.25)]),
        }
    )
    return rows.select(
        "run_id", "ts", "by_signal", "by_drawdown",
        traffic.vol_governor(F.col("by_drawdown"), F.col("realized_vol_pct"), 2.0, 0.1).alias("by_vol"),
    )


@query("traffic_states", "O-G21 O-G22", """
    WITH s AS (SELECT *, CASE WHEN dd >= 0.02 AND worsening <= -0.001 AND long_green >= 4 THEN 'recovery'
            WHEN dd >= 0.02 AND worsening >= 0.003 THEN 'orange' WHEN long_green <= 1 THEN 'red' WHEN long_green >= 4 THEN 'green'
            WHEN long_green >= 3 THEN 'yellow' ELSE 'red' END AS state FROM eq)
    SELECT run_id, ts, state, CASE state WHEN 'red' THEN 0 WHEN 'orange' THEN 0.5 ELSE target_long_fraction END AS long_target,
        CASE WHEN state IN ('red', 'orange') THEN greatest(target_short_fraction, 0.07) ELSE target_short_fraction END AS short_target,
        dd >= 0.02 AND worsening <= -0.001 AND long_green >= 3 AND realized_vol_pct <= 3 AS boost_active,
        CASE WHEN dd >= 0.02 AND worsening <= -0.001 AND long_green >= 3 AND realized_vol_pct <= 3 THEN greatest(target_long_fraction, 1.2) ELSE target_long_fraction END AS boosted,
        dd >= 0.01 AND worsening >= 0.001 AS slope_gate FROM s""", doubles="long_target short_target boosted")
def _states(t: Tables):
    rows = _equity(t)
    g, dd, up = F.col("long_green"), F.col("dd"), F.col("worsening")
    state = traffic.traffic_state(g, dd, up, recovery=(0.02, -0.001, 4), orange=(0.02, 0.003))
    rows = rows.withColumn("state", state)
    lng, sht = traffic.state_targets(
        F.col("state"), F.col("target_long_fraction"), F.col("target_short_fraction"),
        {"red": (0.0, 0.07), "orange": (0.5, 0.07)},
    )
    boosted, active = traffic.recovery_boost(
        F.col("target_long_fraction"), g, dd, up, F.col("realized_vol_pct"), 1.2, 0.02, -0.001, 3, 3.0
    )
    return rows.select(
        "run_id", "ts", "state", lng.alias("long_target"), sht.alias("short_target"), active.alias("boost_active"),
        boosted.alias("boosted"), traffic.slope_gate(dd, up, 0.01, 0.001).alias("slope_gate"),
    )


@query("overlay_resolution", "O-G23 O-G24", """
    WITH h AS (SELECT run_id, ts, target_short_fraction AS normal, CASE long_green WHEN 0 THEN 0.2 WHEN 1 THEN 0.08 ELSE 0 END::DOUBLE AS fl, idx * 7 % 10 * 0.03::DOUBLE AS cur,
        portfolio_value, cash_reserve FROM hist)
    SELECT run_id, ts, greatest(normal, fl) AS effective_target, CASE WHEN greatest(normal, fl) <= normal THEN 'hedge_up'
        WHEN greatest(normal, fl) < cur THEN 'traffic_light_hedge_down' ELSE 'traffic_light_hedge_up' END AS reason,
        greatest(normal, fl) > cur AND cash_reserve + 1e-9 < portfolio_value * (greatest(normal, fl) - cur) AS under_hedged FROM h""", doubles="effective_target")
def _resolution(t: Tables):
    from pyspark.sql import Window as W

    idx = F.row_number().over(W.partitionBy("run_id").orderBy("ts")) - 1
    rows = t.history.withColumn("current", (idx * 7) % 10 * 0.03)
    target, why = traffic.resolve_overlay(
        F.col("target_short_fraction"), F.lit("hedge_up"), traffic.ladder(F.col("long_green"), {0: 0.2, 1: 0.08}),
        F.col("current"), "traffic_light_hedge_up", "traffic_light_hedge_down",
    )
    return rows.withColumns({"effective_target": target, "reason": why}).select(
        "run_id", "ts", "effective_target", "reason",
        traffic.under_hedged(F.col("effective_target"), F.col("current"), F.col("portfolio_value"), F.col("cash_reserve")).alias("under_hedged"),
    )


@query("fast_break_flags", "O-G24", """
    WITH m AS (SELECT *, median(vol_now) OVER (PARTITION BY symbol ORDER BY ts ROWS 167 PRECEDING) AS vol_median
        FROM (SELECT *, CASE WHEN count(r) OVER w >= 24 THEN stddev_samp(r) OVER w END AS vol_now,
                close / lag(close, 24) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r24,
                coalesce(i > 48 AND close < min(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING), FALSE) AS donchian
            FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 23 PRECEDING)))
    SELECT m.symbol, m.ts, (v.green <= 3 OR v.bearish_1d) AND (coalesce(r24 <= -0.5, FALSE) OR donchian)
        AND coalesce(i - 1 >= 48 AND vol_median > 0 AND vol_now >= 1.05 * vol_median, FALSE) AS fast_break
    FROM m JOIN votes v USING (symbol, ts)""")
def _fast_break(t: Tables):
    rows = ind.vol_expansion(t.aligned, 24, 168, 1.05)
    rows = rows.withColumn(
        "broke", F.coalesce(ind.n_bar_return(24) <= -0.5, F.lit(False)) | ind.donchian_break(48)
    ).select("symbol", "ts", "vol_expanded", "broke")
    votes = traffic.vote_rows(traffic.directions(t.aligned, ALL_FRAMES))
    weak = (F.col("green") <= 3) | F.col("bearish_1d")
    return votes.join(rows, ["symbol", "ts"]).select(
        "symbol", "ts", (weak & F.col("broke") & F.col("vol_expanded")).alias("fast_break")
    )


# --- sweeps ---------------------------------------------------------------------------

ATRS, MULTS = (5, 10, 14), (1.5, 2.0, 3.0, 4.0)
define("shifted", """SELECT symbol, ts, tf, label, open + 500 AS open, high + 500 AS high, low + 500 AS low, close + 500 AS close FROM slotted WHERE tf IN ('4h', '1d')""")
define("shifted_candles", """SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM (
        SELECT *, row_number() OVER w AS i, lag(close) OVER w AS pc, lead(label) OVER w AS next_label FROM (
            SELECT symbol, tf, label, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM shifted GROUP BY ALL)
        WINDOW w AS (PARTITION BY symbol, tf ORDER BY label))""")
define("sweep_in", """SELECT a.symbol, a.tf, s.spec, a.i, a.label, a.next_label, a.close,
        (high + low) / 2 + mult * CASE an WHEN 5 THEN a5 WHEN 10 THEN a10 ELSE a14 END AS raw_up,
        (high + low) / 2 - mult * CASE an WHEN 5 THEN a5 WHEN 10 THEN a10 ELSE a14 END AS raw_lo
    FROM (SELECT *, CASE WHEN i >= 5 THEN avg(tr) OVER (w ROWS 4 PRECEDING) END AS a5, CASE WHEN i >= 10 THEN avg(tr) OVER (w ROWS 9 PRECEDING) END AS a10,
            CASE WHEN i >= 14 THEN avg(tr) OVER (w ROWS 13 PRECEDING) END AS a14 FROM shifted_candles WINDOW w AS (PARTITION BY symbol, tf ORDER BY label)) a,
        (SELECT 'a' || an || '_m' || m AS spec, an, mult FROM (VALUES (5), (10), (14)) x(an), (VALUES ('1.5', 1.5::DOUBLE), ('2', 2), ('3', 3), ('4', 4)) y(m, mult)) s""")
define("sweep_st", """/* RECURSIVE */ SELECT symbol, tf, spec, i, label, next_label, close, raw_up AS up, raw_lo AS lo, TRUE AS bull FROM sweep_in WHERE i = 1
    UNION ALL SELECT x.symbol, x.tf, x.spec, x.i, x.label, x.next_label, x.close,
        CASE WHEN s.up IS NULL OR x.raw_up < s.up OR s.close > s.up THEN x.raw_up ELSE s.up END,
        CASE WHEN s.lo IS NULL OR x.raw_lo > s.lo OR s.close < s.lo THEN x.raw_lo ELSE s.lo END,
        CASE WHEN s.up IS NULL OR x.raw_up IS NULL THEN TRUE
            WHEN s.bull THEN x.close >= CASE WHEN x.raw_lo > s.lo OR s.close < s.lo THEN x.raw_lo ELSE s.lo END
            ELSE x.close > CASE WHEN x.raw_up < s.up OR s.close > s.up THEN x.raw_up ELSE s.up END END
    FROM sweep_st s JOIN sweep_in x ON x.symbol = s.symbol AND x.tf = s.tf AND x.spec = s.spec AND x.i = s.i + 1""")
define("sweep_rows", """SELECT symbol, spec, ts, close, avg(CASE WHEN bull THEN 1.0 ELSE -1.0 END::DOUBLE) AS exposure FROM (
        SELECT a.symbol, a.ts, a.close, a.spec, coalesce(c.bull, TRUE) AS bull
        FROM (SELECT symbol, ts, close + 500 AS close, spec, tf FROM aligned, (SELECT DISTINCT spec, tf FROM sweep_in)) a
        ASOF LEFT JOIN (SELECT * FROM sweep_st WHERE next_label IS NOT NULL) c
            ON a.symbol = c.symbol AND a.spec = c.spec AND a.tf = c.tf AND a.ts >= c.next_label) GROUP BY ALL""")
define("sweep_curve", """SELECT *, 10000 * product(step) OVER (PARTITION BY symbol, spec ORDER BY ts) AS equity FROM (
        SELECT *, coalesce(1 + lag(exposure) OVER w * (close / lag(close) OVER w - 1), 1) AS step FROM sweep_rows
        WINDOW w AS (PARTITION BY symbol, spec ORDER BY ts))""")
define("sweep_result", """SELECT symbol, spec, arg_max(equity, ts) AS final_equity, arg_max(equity, ts) / 100 - 100 AS total_return_pct,
        max(1 - equity / peak) * 100 AS max_drawdown_pct,
        CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(8760) ELSE 0 END AS sharpe_ratio,
        CASE WHEN stddev_samp(ret) FILTER (ret < 0) > 0 THEN avg(ret) / (stddev_samp(ret) FILTER (ret < 0)) * sqrt(8760) ELSE 0 END AS sortino_ratio
    FROM (SELECT *, max(equity) OVER w AS peak, round(coalesce(equity / lag(equity) OVER w - 1, 0), 13) AS ret FROM sweep_curve
          WINDOW w AS (PARTITION BY symbol, spec ORDER BY ts)) GROUP BY ALL""")
SWEEP = "final_equity total_return_pct max_drawdown_pct sharpe_ratio sortino_ratio"


def price_like(t: Tables) -> DataFrame:
    """Aligned bars lifted by a constant, so that returns stay in a market's range."""
    return t.aligned.select("symbol", "ts", *[(F.col(c) + 500.0).alias(c) for c in ("open", "high", "low", "close")], "volume")


def _sweep(t: Tables) -> DataFrame:
    return sweep.signal_sweep(price_like(t), sweep.trend_specs(ATRS, MULTS), ["4h", "1d"])


GRID = {"scale": [0.5, 1.0, 1.5], "floor": [0.0, 0.2]}


@query("strategy_grid", "O-J8 D15", """
    WITH g AS (SELECT si * 4 + fi * 2 + ci AS combination, scale, floor, crisis FROM
            (VALUES (0, 0.5::DOUBLE), (1, 1.0), (2, 1.5)) s(si, scale), (VALUES (0, 0.0::DOUBLE), (1, 0.2)) f(fi, floor), (VALUES (0, TRUE), (1, FALSE)) c(ci, crisis)),
    r AS (SELECT run_id, avg(target_long_fraction) AS l, avg((long_green = 0)::INT) AS weak FROM history GROUP BY 1)
    SELECT run_id, combination::BIGINT AS combination, scale, floor, crisis AS enable_crisis_mode,
        greatest(floor, l * scale * CASE WHEN crisis THEN 1 - weak ELSE 1 END) AS mean_target FROM r, g""", doubles="scale floor mean_target")
def _strategy_grid(t: Tables):
    runs = t.history.groupBy("run_id").agg(F.avg("target_long_fraction").alias("l"), F.avg((F.col("long_green") == 0).cast("double")).alias("weak"))
    calm = F.when(F.col("enable_crisis_mode"), 1.0 - F.col("weak")).otherwise(1.0)
    return sweep.with_params(runs, sweep.strategy_grid(GRID)).select(
        "run_id", "combination", "scale", "floor", "enable_crisis_mode", F.greatest("floor", F.col("l") * F.col("scale") * calm).alias("mean_target")
    )


@query("signal_sweep", "O-K1 O-J8 D15", "SELECT * FROM sweep_result", doubles=SWEEP)
def _signal_sweep(t: Tables):
    return _sweep(t)


@query("sweep_best", "O-K2", "SELECT * FROM sweep_result ORDER BY round(sortino_ratio, 6) DESC, symbol, spec LIMIT 1", doubles=SWEEP)
def _sweep_best(t: Tables):
    rows = _sweep(t).withColumn("__m", F.round("sortino_ratio", 6))
    return sweep.best_row(rows, "__m", ties=["symbol", "spec"]).drop("__m")


define("hold", """SELECT symbol, (arg_max(close, ts) / arg_min(close, ts) - 1) * 100 AS benchmark_return_pct,
        max(1 - close / peak) * 100 AS benchmark_max_drawdown_pct, arg_max(close, ts) AS final_price
    FROM (SELECT symbol, ts, close + 500 AS close, max(close + 500) OVER (PARTITION BY symbol ORDER BY ts) AS peak FROM aligned) GROUP BY 1""")


@query("benchmark_tiers", "O-K3 O-K4 O-K5 O-K6", """
    SELECT symbol, spec, total_return_pct - benchmark_return_pct AS tracking_gap_pct, benchmark_max_drawdown_pct - max_drawdown_pct AS drawdown_improvement_pct,
        final_price, tier AS benchmark_tier, CASE tier WHEN 'pass' THEN 0 WHEN 'acceptable' THEN 1 WHEN 'capital_preservation' THEN 2 ELSE 3 END AS tier_rank,
        CASE WHEN spec LIKE 'a5%' AND sharpe_ratio > 0 THEN 'usdc_releverage' WHEN spec LIKE '%m2' THEN 'core_full_short' ELSE 'core_hedge' END AS experiment_group
    FROM (SELECT *, CASE WHEN round(benchmark_max_drawdown_pct - max_drawdown_pct, 9) <= 0 THEN 'reject' WHEN round(total_return_pct - benchmark_return_pct, 9) >= 0 THEN 'pass'
        WHEN total_return_pct - benchmark_return_pct >= -2 THEN 'acceptable' ELSE 'capital_preservation' END AS tier FROM sweep_result JOIN hold USING (symbol))""",
       doubles="tracking_gap_pct drawdown_improvement_pct final_price", ints="tier_rank")
def _tiers(t: Tables):
    rows = sweep.against_benchmark(_sweep(t), sweep.buy_and_hold(price_like(t)), 2.0)
    group = sweep.experiment_group(
        F.col("spec").startswith("a5"), F.col("sharpe_ratio"), F.col("spec").endswith("m2")
    ).alias("experiment_group")
    return sweep.ranked(rows, "sortino_ratio").select(
        "symbol", "spec", "tracking_gap_pct", "drawdown_improvement_pct", "final_price", "benchmark_tier", "tier_rank", group
    )


@query("final_positions", "O-K7", """
    SELECT h.run_id, h.portfolio_value AS final_portfolio_value_usd, h.portfolio_value / h.price AS final_sol_equiv,
        max(p.amount) FILTER (side = 'collateral' AND symbol = 'SOL') AS final_collateral_sol, max(p.amount) FILTER (side = 'debt' AND symbol = 'ETH') AS final_debt_eth,
        coalesce(max(p.amount) FILTER (symbol = 'BTC'), 0) AS final_debt_btc,
        max(p.value) FILTER (side = 'collateral' AND symbol = 'SOL') AS final_collateral_sol_value_usd, max(p.value) FILTER (side = 'debt' AND symbol = 'ETH') AS final_debt_eth_value_usd,
        coalesce(max(p.value) FILTER (symbol = 'BTC'), 0) AS final_debt_btc_value_usd
    FROM (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC) = 1) h
    JOIN history_positions p ON p.run_id = h.run_id AND p.ts = h.ts GROUP BY ALL""",
       doubles="final_portfolio_value_usd final_sol_equiv final_collateral_sol final_debt_eth final_debt_btc final_collateral_sol_value_usd "
               "final_debt_eth_value_usd final_debt_btc_value_usd")
def _final(t: Tables):
    return sweep.final_positions(t.history, t.history_positions, [("collateral", "SOL"), ("debt", "ETH"), ("debt", "BTC")])


define("summary", """SELECT period AS win, run_id AS name, end_value AS final_portfolio_value_usd, end_sol_equiv AS final_sol_equiv,
        -dd_pct AS max_drawdown_pct, min_health_factor, CASE WHEN run_id IN ('click', 'view') THEN 'page' ELSE 'flow' END AS family FROM weekly""")


def summary(t: Tables) -> DataFrame:
    """Sweep summary bound to weekly results: window = week, name = run."""
    return metrics.period_decomposition(with_debt(t), "week").select(
        F.col("period").alias("window"), F.col("run_id").alias("name"), F.col("end_value").alias("final_portfolio_value_usd"),
        F.col("end_sol_equiv").alias("final_sol_equiv"), (-F.col("dd_pct")).alias("max_drawdown_pct"), "min_health_factor",
        F.when(F.col("run_id").isin("click", "view"), "page").otherwise("flow").alias("family"),
    )


GATES = """final_sol_equiv > 100 AS sol_gate_pass, final_sol_equiv >= 95 AS near_sol_gate_pass, min_health_factor >= 0.82 AS hf_gate_pass,
        final_sol_equiv > 100 AND min_health_factor >= 0.82 AS valid, final_sol_equiv >= 95 AND min_health_factor >= 0.82 AS near_valid"""
define("gated", f"SELECT *, {GATES} FROM summary")


@query("sweep_gates", "O-K8 O-K10 O-S7", """
    SELECT win AS window_name, name, final_portfolio_value_usd - 10000 AS usd_gap_vs_reference, final_sol_equiv - 100 AS sol_gap_vs_reference,
        max_drawdown_pct - 5 AS dd_gap_vs_reference, final_portfolio_value_usd >= 10000 AND max_drawdown_pct <= 5 AS strict_improvement,
        sol_gate_pass, near_sol_gate_pass, hf_gate_pass, valid, near_valid FROM gated""",
       doubles="usd_gap_vs_reference sol_gap_vs_reference dd_gap_vs_reference")
def _gates(t: Tables):
    rows = sweep.gates(sweep.reference_deltas(summary(t), 10000.0, 100.0, 5.0), 100.0, 95.0, 0.82, strict=True)
    return rows.withColumnRenamed("window", "window_name").select(
        "window_name", "name", "usd_gap_vs_reference", "sol_gap_vs_reference", "dd_gap_vs_reference", "strict_improvement",
        "sol_gate_pass", "near_sol_gate_pass", "hf_gate_pass", "valid", "near_valid",
    )


@query("selected_rows", "O-K9", """
    WITH s AS (SELECT *, final_portfolio_value_usd AS v, max_drawdown_pct AS d FROM summary)
    SELECT criterion, win AS window_name, name, v AS final_portfolio_value_usd, d AS max_drawdown_pct FROM (
        (SELECT 'Highest USD' AS criterion, * FROM s ORDER BY v DESC, d, name, win LIMIT 1)
        UNION ALL (SELECT 'Lowest DD', * FROM s ORDER BY d, v DESC, name, win LIMIT 1)
        UNION ALL (SELECT 'Strict reference improvement', * FROM s WHERE v >= 10000 AND d <= 2 ORDER BY v DESC, d, name, win LIMIT 1)
        UNION ALL (SELECT 'Best DD <=1%', * FROM s WHERE d <= 1 ORDER BY v DESC, d, name, win LIMIT 1))""",
       doubles="final_portfolio_value_usd max_drawdown_pct")
def _selected(t: Tables):
    return sweep.selected_rows(summary(t), 10000.0, 2.0, 1.0, ["name", "window"]).select(
        "criterion", F.col("window").alias("window_name"), "name", "final_portfolio_value_usd", "max_drawdown_pct"
    )


@query("family_best", "O-K11", """
    SELECT family, name, win AS window_name, valid, near_valid, max_drawdown_pct, final_sol_equiv FROM gated
    QUALIFY row_number() OVER (PARTITION BY family ORDER BY valid DESC, near_valid DESC, max_drawdown_pct, final_sol_equiv DESC, name, win) = 1""",
       doubles="max_drawdown_pct final_sol_equiv")
def _family(t: Tables):
    rows = sweep.gates(summary(t), 100.0, 95.0, 0.82, strict=True)
    return sweep.best_per_family(rows, ties=["name", "window"]).select(
        "family", "name", F.col("window").alias("window_name"), "valid", "near_valid", "max_drawdown_pct", "final_sol_equiv"
    )


@query("window_robustness", "O-J6 O-K12", """
    SELECT s.name, count(*) AS windows, count(*) FILTER (s.final_portfolio_value_usd >= b.final_portfolio_value_usd AND s.max_drawdown_pct <= b.max_drawdown_pct) AS strict_wins,
        avg(s.final_portfolio_value_usd - b.final_portfolio_value_usd) AS avg_usd_gap, min(s.final_portfolio_value_usd - b.final_portfolio_value_usd) AS min_usd_gap,
        avg(s.max_drawdown_pct - b.max_drawdown_pct) AS avg_dd_gap, max(s.max_drawdown_pct - b.max_drawdown_pct) AS max_dd_gap,
        avg(s.final_portfolio_value_usd) AS avg_final_usd, avg(s.final_sol_equiv) AS avg_final_sol
    FROM summary s JOIN summary b ON b.win = s.win AND b.name = 'view' WHERE s.name <> 'view' GROUP BY 1""",
       doubles="avg_usd_gap min_usd_gap avg_dd_gap max_dd_gap avg_final_usd avg_final_sol")
def _robust(t: Tables):
    rows = asof.relative_to_baseline(
        summary(t), "window", "name", "view", ["final_portfolio_value_usd", "max_drawdown_pct"], "gap"
    ).filter("name <> 'view'")
    rows = rows.withColumnsRenamed({"final_portfolio_value_usd_gap": "usd_gap", "max_drawdown_pct_gap": "dd_gap"})
    rows = rows.withColumn("strict_improvement", (F.col("usd_gap") >= 0) & (F.col("dd_gap") <= 0))
    return sweep.robustness(rows)


REGIMES = [
    ("first_week", "2024-01-01", "2024-01-07 23:59:59"), ("middle", "2024-01-08", "2024-01-20"),
    ("since_15", "2024-01-15", None), ("empty_2023", "2023-01-01", "2023-12-31"),
]


def regimes(t: Tables) -> DataFrame:
    """Bounds of the named regimes; a label without known bounds is open."""
    known = t.spark.createDataFrame(REGIMES, "regime string, start string, end string")
    return asof.named_intervals(known.select("regime").union(t.spark.range(1).select(F.lit("unknown"))), known, "regime")


define("regime_rows", """SELECT h.*, r.regime FROM history h JOIN (VALUES ('full', TIMESTAMP '1900-01-01', TIMESTAMP '2900-01-01'),
        ('first_week', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-07 23:59:59'), ('middle', TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-20'),
        ('since_15', TIMESTAMP '2024-01-15', TIMESTAMP '2900-01-01'), ('unknown', TIMESTAMP '1900-01-01', TIMESTAMP '2900-01-01'), ('empty_2023', TIMESTAMP '2023-01-01', TIMESTAMP '2023-12-31')) r(regime, a, b)
    ON h.ts BETWEEN r.a AND r.b""")


@query("regime_slices", "O-P1 O-P2 O-J3", "SELECT run_id, regime, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts FROM regime_rows GROUP BY ALL")
def _slices(t: Tables):
    return asof.interval_rows(t.history, "ts", regimes(t), "regime").groupBy("run_id", "regime").agg(
        F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query("regime_table", "O-K13", """
    SELECT run_id, regime, arg_min(portfolio_value, ts) AS start_value, arg_max(portfolio_value, ts) AS end_value,
        (arg_max(portfolio_value, ts) / arg_min(portfolio_value, ts) - 1) * 100 AS return_pct, max(1 - portfolio_value / p) * 100 AS drawdown_pct,
        avg(target_long_fraction) AS avg_target_long_fraction, avg(target_short_fraction) AS avg_target_short_fraction,
        min(health_factor) AS min_health_factor, avg((long_green = 4)::INT) AS boost_share
    FROM (SELECT *, max(portfolio_value) OVER (PARTITION BY run_id, regime ORDER BY ts) AS p FROM regime_rows) GROUP BY ALL""",
       doubles="start_value end_value return_pct drawdown_pct avg_target_long_fraction avg_target_short_fraction min_health_factor boost_share")
def _regimes(t: Tables):
    rows = asof.interval_rows(t.history, "ts", regimes(t), "regime").withColumn("boost", F.col("long_green") == 4)
    return sweep.regime_table(rows)


# --- report marts ---------------------------------------------------------------------

@query("position_value_frame", "O-P5 O-P6", """
    SELECT run_id, ts, CASE side WHEN 'debt' THEN 'Debt ' ELSE 'Collateral ' END || symbol AS series, CASE side WHEN 'debt' THEN -abs(value) ELSE value END AS value
    FROM history_positions UNION ALL SELECT run_id, ts, 'Net Portfolio', portfolio_value FROM history""", doubles="value")
def _position_frame(t: Tables):
    return reports.position_values(t.history_positions, t.history)


@query("composition_melted", "O-P7", """
    SELECT run_id, ts, symbol AS asset, greatest(value, 0) AS value_usd FROM history_positions WHERE side = 'debt'""", doubles="value_usd")
def _melted(t: Tables):
    wide = reports.composition(t.history_positions, "debt").groupBy("run_id", "ts").pivot("asset", ["ETH", "USDC"]).agg(F.first("value_usd"))
    return reports.melt(wide, ["run_id", "ts"])


define("numbered", "SELECT run_id, ts, portfolio_value, row_number() OVER (PARTITION BY run_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM history")


@query("chart_every_kth", "O-P8", "SELECT run_id, ts, portfolio_value FROM numbered WHERE i % greatest(1, n // 200) = 0", doubles="portfolio_value")
def _kth(t: Tables):
    return reports.every_kth(t.history.select("run_id", "ts", "portfolio_value"), 200)


@query("chart_evenly_spaced", "O-P8", """
    SELECT run_id, ts, portfolio_value FROM numbered JOIN (SELECT DISTINCT run_id, j * (n - 1) // 199 AS i FROM numbered, range(200) g(j)) USING (run_id, i)""",
       doubles="portfolio_value")
def _even(t: Tables):
    return reports.evenly_spaced(t.history.select("run_id", "ts", "portfolio_value"), 200)


_FRAME = "SELECT ts, " + ", ".join(f"max(m) FILTER (run_id = '{s}') AS {s}" for s in SYMBOLS) + " FROM ({}) GROUP BY ts"


@query("metric_frame_normalized", "O-E1", _FRAME.format(
    "SELECT run_id, ts, portfolio_value / first_value(portfolio_value) OVER (PARTITION BY run_id ORDER BY ts) * 100 AS m FROM history"),
       doubles=" ".join(SYMBOLS))
def _frame_norm(t: Tables):
    return reports.metric_frame(t.history, "normalized_portfolio_value", SYMBOLS)


@query("metric_frame_drawdown", "O-E1", _FRAME.format("SELECT run_id, ts, (peak - portfolio_value) / peak * 100 AS m FROM hist"), doubles=" ".join(SYMBOLS))
def _frame_dd(t: Tables):
    return reports.metric_frame(t.history, "drawdown_pct", SYMBOLS)


def _prices(t: Tables) -> DataFrame:
    return t.bars.select("symbol", "ts", F.col("close").alias("price"))


@query("price_signal_overlap", "O-J4", """SELECT h.run_id, h.ts, p.close AS price, h.target_long_fraction - h.target_short_fraction AS signal
    FROM history h JOIN bars p ON h.ts = p.ts WHERE p.symbol = 'view'""", doubles="price signal")
def _overlap(t: Tables):
    prices = _prices(t).filter("symbol = 'view'").select("ts", "price")
    signals = t.history.select("run_id", "ts", (F.col("target_long_fraction") - F.col("target_short_fraction")).alias("signal"))
    return asof.join_overlap(prices, signals).select("run_id", "ts", "price", "signal")


@query("buy_hold_values", "O-E2", """
    WITH b AS (SELECT h.ts, h.portfolio_value, s.symbol FROM history h, (SELECT DISTINCT symbol FROM bars) s WHERE run_id = 'error'),
    a AS (SELECT b.*, p.close AS price FROM b ASOF LEFT JOIN bars p ON b.symbol = p.symbol AND b.ts >= p.ts),
    f AS (SELECT *, first_value(price) OVER w AS p0, first_value(portfolio_value) OVER w AS v0 FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    SELECT symbol, ts, price * v0 / p0 AS value FROM f WHERE p0 > 0""", doubles="value")
def _hold(t: Tables):
    return reports.buy_and_hold_values(t.history, "error", _prices(t), SYMBOLS)


define("priced", """SELECT h.*, p.close AS sol_price, sum((h.liquidation_penalty > 0)::INT) OVER (PARTITION BY h.run_id ORDER BY h.ts) AS liquidation_count
    FROM history h ASOF LEFT JOIN (SELECT * FROM bars WHERE symbol = 'view') p ON h.ts >= p.ts""")


def priced(t: Tables) -> DataFrame:
    """History with its price and a running liquidation count."""
    from pyspark.sql import Window as W

    path = W.partitionBy("run_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    count = F.sum((F.col("liquidation_penalty") > 0).cast("bigint")).over(path)
    return reports.with_price(t.history.withColumn("liquidation_count", count), _prices(t), "view")


@query("temperature", "O-E3", "SELECT run_id, ts, sol_price, target_long_fraction - target_short_fraction AS net_temperature FROM priced WHERE sol_price IS NOT NULL",
       doubles="sol_price net_temperature")
def _temperature(t: Tables):
    return reports.temperature(priced(t))


@query("timeline_events", "O-E4", """
    WITH p AS (SELECT *, row_number() OVER w AS i, lag(target_long_fraction) OVER w AS l0, lag(target_short_fraction) OVER w AS s0, lag(selected_long) OVER w AS sel0,
            coalesce(last_value(CASE WHEN sol_price IS NOT NULL THEN liquidation_count END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q0
        FROM priced WINDOW w AS (PARTITION BY run_id ORDER BY ts)),
    v AS (SELECT *, target_long_fraction AS l, target_short_fraction AS s FROM p WHERE sol_price IS NOT NULL),
    m AS (SELECT run_id, ts, max(value) FILTER (side = 'collateral' AND symbol = 'SOL') AS cs, max(value) FILTER (side = 'collateral' AND symbol = 'USDC') AS cu,
        max(value) FILTER (side = 'debt' AND symbol = 'ETH') AS de, max(value) FILTER (side = 'debt' AND symbol = 'USDC') AS du
        FROM (SELECT * REPLACE (CASE WHEN value > 0 THEN value + 0.0000137 ELSE 0 END AS value) FROM history_positions) GROUP BY ALL),
    d AS (SELECT run_id, ts, portfolio_value, (peak - portfolio_value) / peak * 100 AS drawdown_pct FROM hist),
    e AS (SELECT run_id, ts, 'start' AS event_family, 'Started with ' || CASE selected_long WHEN '' THEN 'no' ELSE selected_long END || ' long target ' || printf('%.3f', l) AS event FROM v WHERE i = 1
    UNION ALL SELECT run_id, ts, 'rotation', 'Long asset changed from ' || CASE sel0 WHEN '' THEN 'none' ELSE sel0 END || ' to ' || CASE selected_long WHEN '' THEN 'none' ELSE selected_long END FROM v WHERE i > 1 AND selected_long <> sel0
    UNION ALL SELECT run_id, ts, CASE WHEN l > l0 THEN 'buy' ELSE 'sell' END, 'Long target ' || CASE WHEN l > l0 THEN 'raised' ELSE 'cut' END || printf(' from %.3f to %.3f', l0, l) FROM v WHERE i > 1 AND abs(l - l0) >= 0.05
    UNION ALL SELECT run_id, ts, CASE WHEN s > s0 THEN 'short' ELSE 'cover' END, 'Hedge/short target ' || CASE WHEN s > s0 THEN 'raised' ELSE 'cut' END || printf(' from %.3f to %.3f', s0, s) FROM v WHERE i > 1 AND abs(s - s0) >= 0.01
    UNION ALL SELECT run_id, ts, 'liquidation', 'Liquidations increased from ' || q0 || ' to ' || liquidation_count FROM v WHERE i > 1 AND liquidation_count > q0)
    SELECT e.*, sol_price, selected_long, l AS target_long_fraction, s AS target_short_fraction, health_factor, drawdown_pct,
        concat_ws(' | ', format('portfolio=${:,.2f}', pv), CASE WHEN cs > 0 THEN format('collateral SOL=${:,.2f}', cs) END, CASE WHEN cu > 0 THEN format('collateral USDC=${:,.2f}', cu) END,
            CASE WHEN de > 0 THEN format('debt ETH=${:,.2f}', de) END, CASE WHEN du > 0 THEN format('debt USDC=${:,.2f}', du) END) AS portfolio_snapshot,
        format('${:,.2f}', pv) AS snapshot_portfolio, CASE WHEN cs > 0 THEN format('${:,.2f}', cs) ELSE '' END AS snapshot_collateral_SOL,
        CASE WHEN du > 0 THEN format('${:,.2f}', du) ELSE '' END AS snapshot_debt_USDC
    FROM e JOIN v USING (run_id, ts) JOIN (SELECT run_id, ts, portfolio_value + 0.0000137 AS pv, drawdown_pct FROM d) USING (run_id, ts) JOIN m USING (run_id, ts)""",
       doubles="sol_price target_long_fraction target_short_fraction health_factor drawdown_pct", digits=6)
def _timeline(t: Tables):
    nudged = lambda df, c: df.withColumn(c, F.when(F.col(c) > 0, F.col(c) + 0.0000137).otherwise(0.0))
    falls = metrics.with_drawdown(t.history).select("run_id", "ts", (-F.col("drawdown") * 100.0).alias("drawdown_pct"))
    shots = reports.snapshots(nudged(t.history, "portfolio_value"), nudged(t.history_positions, "value"))
    return reports.timeline_frame(priced(t).join(falls, ["run_id", "ts"]), shots).select(
        "run_id", "ts", "event_family", "event", "sol_price", "selected_long", "target_long_fraction", "target_short_fraction", "health_factor", "drawdown_pct",
        "portfolio_snapshot", "snapshot_portfolio", "snapshot_collateral_SOL", "snapshot_debt_USDC",
    )


@query("portfolio_snapshots", "O-E5", """
    WITH w AS (SELECT h.run_id, h.ts, h.portfolio_value + 0.0000137 AS v, max(value) FILTER (side = 'collateral' AND symbol = 'SOL') AS cs, max(value) FILTER (side = 'collateral' AND symbol = 'USDC') AS cu,
        max(value) FILTER (side = 'debt' AND symbol = 'ETH') AS de, max(value) FILTER (side = 'debt' AND symbol = 'USDC') AS du
        FROM history h JOIN (SELECT * REPLACE (CASE WHEN value > 0 THEN value + 0.0000137 ELSE 0 END AS value) FROM history_positions) p
            ON p.run_id = h.run_id AND p.ts = h.ts GROUP BY ALL)
    SELECT run_id, ts, concat_ws(' | ', format('portfolio=${:,.2f}', v), format('collateral SOL=${:,.2f}', cs), format('collateral USDC=${:,.2f}', cu),
        CASE WHEN de > 0 THEN format('debt ETH=${:,.2f}', de) END, format('debt USDC=${:,.2f}', du)) AS portfolio_snapshot,
        format('${:,.2f}', v) AS snapshot_portfolio, CASE WHEN de > 0 THEN format('${:,.2f}', de) ELSE '' END AS snapshot_debt_eth, '' AS snapshot_debt_btc FROM w""")
def _snapshots(t: Tables):
    # Keeps exact half cents off the rounding edge, as in the SQL.
    nudged = lambda df, c: df.withColumn(c, F.when(F.col(c) > 0, F.col(c) + 0.0000137).otherwise(0.0))
    return reports.snapshots(nudged(t.history, "portfolio_value"), nudged(t.history_positions, "value")).select(
        "run_id", "ts", "portfolio_snapshot", "snapshot_portfolio", F.col("snapshot_debt_ETH").alias("snapshot_debt_eth"),
        F.col("snapshot_debt_BTC").alias("snapshot_debt_btc"),
    )


@query("final_composition", "O-E6", """
    SELECT run_id, symbol AS asset, value AS value_usd, value / sum(value) OVER (PARTITION BY run_id) * 100 AS share_pct FROM (
        SELECT * FROM history_positions WHERE side = 'collateral' QUALIFY ts = max(ts) OVER (PARTITION BY run_id)) WHERE value > 0""", doubles="value_usd share_pct")
def _composition(t: Tables):
    return reports.final_composition(t.history_positions, "collateral")


def _names(t: Tables) -> tuple[DataFrame, DataFrame]:
    part = t.raw("part")
    odd = F.col("p_partkey") % 7
    label = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    s = part.select(
        F.col("p_brand").alias("report_id"),
        F.when(odd == 0, F.concat(F.lit("static_"), label)).when(odd == 1, F.concat(F.lit("rv_"), label))
        .when(odd == 2, F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit(".")))).otherwise(label).alias("name"), F.col("p_partkey").alias("place"),
    )
    h = part.filter(odd > 1).select(
        F.col("p_brand").alias("report_id"),
        F.when(odd == 2, "highest_return").when(odd == 3, "high_sortino").otherwise(label).alias("name"), (-F.col("p_partkey")).alias("place"),
    )
    return s, h


define("name_rows", """SELECT p_brand AS report_id, p_partkey AS place, p_partkey % 7 AS odd, replace(p_name, ' ', '_') AS label, upper(replace(p_name, ' ', '.')) AS dotted FROM part""")
define("summary_names", """SELECT report_id, name, lower(name) AS low, replace(replace(lower(name), '_', ''), '.', '') AS compact, row_number() OVER (PARTITION BY report_id ORDER BY place, name) AS no
    FROM (SELECT report_id, place, CASE odd WHEN 0 THEN 'static_' || label WHEN 1 THEN 'rv_' || label WHEN 2 THEN dotted ELSE label END AS name FROM name_rows)""")
define("history_names", """SELECT report_id, name, replace(replace(lower(name), '_', ''), '.', '') AS compact, row_number() OVER (PARTITION BY report_id ORDER BY place, name) AS h
    FROM (SELECT report_id, min(-place) AS place, CASE odd WHEN 2 THEN 'highest_return' WHEN 3 THEN 'high_sortino' ELSE label END AS name FROM name_rows WHERE odd > 1 GROUP BY 1, 3)""")
define("wishes", """SELECT report_id, no, name, list(h ORDER BY kind, h) AS hs, row_number() OVER (PARTITION BY report_id ORDER BY no) AS i FROM (
    SELECT s.report_id, s.no, s.name, h.h, CASE WHEN s.name = h.name THEN 0
        WHEN (contains(low, 'static') OR contains(low, 'highest_return')) AND h.name = 'highest_return' THEN 1
        WHEN (contains(low, 'sortino') OR starts_with(low, 'rv')) AND h.name = 'high_sortino' THEN 2
        WHEN contains(s.compact, h.compact) OR contains(h.compact, s.compact) THEN 3 END AS kind
    FROM summary_names s JOIN history_names h USING (report_id)) WHERE kind IS NOT NULL GROUP BY 1, 2, 3""")
define("claims", """/* RECURSIVE */ SELECT report_id, no, name, i, hs[1] AS h, [hs[1]] AS taken FROM wishes WHERE i = 1
    UNION ALL SELECT report_id, no, name, i, h, list_append(taken, h) FROM (
        SELECT w.report_id, w.no, w.name, w.i, c.taken, coalesce((SELECT x.v FROM (SELECT unnest(w.hs) AS v, generate_subscripts(w.hs, 1) AS k) x
            WHERE NOT list_contains(c.taken, x.v) ORDER BY k LIMIT 1), w.hs[1]) AS h
        FROM claims c JOIN wishes w ON w.report_id = c.report_id AND w.i = c.i + 1)""")


@query("history_matching", "O-E7", """
    WITH got AS (SELECT c.report_id, c.name AS label, arg_max(h.name, c.no) AS history_name FROM claims c JOIN history_names h ON h.report_id = c.report_id AND h.h = c.h GROUP BY 1, 2)
    SELECT * FROM got UNION ALL SELECT report_id, name, name FROM history_names h WHERE NOT EXISTS (SELECT 1 FROM got WHERE got.report_id = h.report_id AND got.label = h.name)""")
def _matching(t: Tables):
    return reports.match_histories(*_names(t))


@query("hedge_levels", "O-E8", """
    WITH e AS (SELECT event_id, event_type AS run_id, ts, value / 100 AS target_ratio, user_id * 0.5 AS open_short_amount, value AS average_basis,
            CASE WHEN event_id % 3 > 0 THEN CAST(props->>'$.k' AS DOUBLE) / 100 END AS current_short_ratio, value - 40 AS lifetime_realized, greatest(0, value - 60) AS spendable FROM events),
    r AS (SELECT run_id, ts + INTERVAL 1 HOUR AS ts, portfolio_value * target_short_fraction AS d, CASE WHEN long_green = 0 THEN 0 ELSE portfolio_value END AS c FROM history)
    SELECT e.event_id, e.run_id, e.ts, e.target_ratio, current_short_ratio AS actual_ratio, CASE WHEN c IS NULL OR c = 0 THEN 0 ELSE d / c END AS marked_ratio,
        lifetime_realized AS lifetime_realized_pnl, spendable AS spendable_profit, open_short_amount * average_basis AS open_short_basis
    FROM e ASOF LEFT JOIN r ON e.run_id = r.run_id AND e.ts >= r.ts""",
       doubles="target_ratio actual_ratio marked_ratio lifetime_realized_pnl spendable_profit open_short_basis")
def _levels(t: Tables):
    events = t.events.select(
        "event_id", F.col("event_type").alias("run_id"), "ts", (F.col("value") / 100.0).alias("target_ratio"),
        (F.col("user_id") * 0.5).alias("open_short_amount"), F.col("value").alias("average_basis"),
        F.when(F.col("event_id") % 3 > 0, F.get_json_object("props", "$.k").cast("double") / 100.0).alias("current_short_ratio"),
        (F.col("value") - 40.0).alias("lifetime_realized"), F.greatest(F.lit(0.0), F.col("value") - 60.0).alias("spendable"),
    )
    pv = F.col("portfolio_value")
    ratios = t.history.select(
        "run_id", F.timestamp_add("HOUR", F.lit(1), F.col("ts")).alias("ts"), (pv * F.col("target_short_fraction")).alias("debt_value"),
        F.when(F.col("long_green") == 0, 0.0).otherwise(pv).alias("collateral_value"),
    )
    return reports.hedge_levels(events, ratios).select("event_id", "run_id", "ts", *reports.HEDGE_SERIES)


@query("kpi_deltas", "O-E9 O-P9", """
    WITH k AS (SELECT run_id, arg_max(portfolio_value, ts) AS final_value, max((peak - portfolio_value) / peak) * 100 AS max_drawdown_pct FROM hist GROUP BY 1)
    SELECT k.*, k.final_value - b.final_value AS delta_final_value, k.max_drawdown_pct - b.max_drawdown_pct AS delta_max_drawdown_pct
    FROM k, (SELECT * FROM k WHERE run_id = 'click') b""", doubles="final_value max_drawdown_pct delta_final_value delta_max_drawdown_pct")
def _kpis(t: Tables):
    table = reports.existing_columns(metrics.performance(t.history), ["run_id", "final_value", "post_2024_drawdown_pct", "max_drawdown_pct"])
    return reports.kpi_deltas(table, ["final_value", "max_drawdown_pct"], "click")


@query("reserve_flags", "O-G24", """
    WITH p AS (SELECT h.*, first_value(portfolio_value) OVER (PARTITION BY run_id ORDER BY ts) AS v0 FROM hist h),
    u AS (SELECT a.ts, b.r - a.r AS lag FROM (SELECT ts, close / lag(close, 24) OVER (ORDER BY ts) - 1 AS r FROM aligned WHERE symbol = 'click') a
        JOIN (SELECT ts, close / lag(close, 24) OVER (ORDER BY ts) - 1 AS r FROM aligned WHERE symbol = 'view') b USING (ts))
    SELECT run_id, ts, peak / v0 - 1 >= 0.01 AND (peak - portfolio_value) / peak <= 0.005 AS gain_near_high,
        long_green <= 1 AND coalesce(lag, 0) >= 0.1 AS hedge_failure FROM p JOIN u USING (ts)""")
def _reserve_flags(t: Tables):
    from pyspark.sql import Window as W

    upto = W.partitionBy("run_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    rows = metrics.with_drawdown(t.history).withColumn("__v0", F.first("portfolio_value").over(upto))
    lag = ind.relative_strength(t.aligned, "view", "click", 24).select("ts", "underperformance")
    return rows.join(lag, "ts").select(
        "run_id", "ts",
        traffic.gain_near_high(F.col("peak"), F.col("__v0"), F.col("portfolio_value"), 0.01, 0.005).alias("gain_near_high"),
        traffic.hedge_failure(F.col("long_green") <= 1, F.col("underperformance"), 0.1).alias("hedge_failure"),
    )


@query("hedge_gates", "O-G21", """
    WITH e AS (SELECT run_id, ts, target_short_fraction AS s, dd, worsening FROM eq),
    r AS (SELECT a.ts, a.r AS basis, b.r AS short FROM (SELECT ts, close / lag(close, 24) OVER (ORDER BY ts) - 1 AS r FROM aligned WHERE symbol = 'click') a
        JOIN (SELECT ts, close / lag(close, 24) OVER (ORDER BY ts) - 1 AS r FROM aligned WHERE symbol = 'view') b USING (ts)),
    g AS (SELECT e.*, s <= 0 OR (dd >= 0.005 AND worsening >= 0.0 AND coalesce(short <= basis - 0.02, FALSE)) AS active FROM e JOIN r USING (ts))
    SELECT run_id, ts, active AS gate_active, CASE WHEN active THEN s ELSE 0 END AS gated_short FROM g""", doubles="gated_short")
def _gates_on_hedge(t: Tables):
    strength = ind.relative_strength(t.aligned, "click", "view", 24).select("ts", "basis_return", "other_return")
    short = F.col("target_short_fraction")
    active = (short <= 0) | (
        traffic.slope_gate(F.col("dd"), F.col("worsening"), 0.005, 0.0)
        & traffic.strength_gate(F.col("basis_return"), F.col("other_return"), 0.02)
    )
    return _equity(t).join(strength, "ts").select(
        "run_id", "ts", active.alias("gate_active"), F.when(active, short).otherwise(0.0).alias("gated_short")
    )
