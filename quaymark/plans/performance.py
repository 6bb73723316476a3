"""Queries: performance metrics over run histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.operators import metrics as m
from quaymark.plans.ctes import define
from quaymark.plans.registry import query
from quaymark.sources.tables import Tables


def with_debt(t: Tables) -> DataFrame:
    return t.history.withColumn("debt_eth_value", F.col("portfolio_value") * F.col("target_short_fraction"))


define("hist", """SELECT *, portfolio_value * target_short_fraction AS debt_eth_value,
        row_number() OVER (PARTITION BY run_id ORDER BY ts) - 1 AS idx,
        max(portfolio_value) OVER (PARTITION BY run_id ORDER BY ts) AS peak,
        lag(portfolio_value) OVER (PARTITION BY run_id ORDER BY ts) AS prev
    FROM history""")


@query("run_history_rows", "D10 O-M1 O-M2", """
    SELECT run_id, ts, portfolio_value, coalesce(portfolio_value - prev, 0) AS pnl,
        coalesce(portfolio_value / prev - 1, 0) AS ret, (portfolio_value - peak) / peak AS drawdown FROM hist""",
       doubles="portfolio_value pnl ret drawdown")
def _rows(t: Tables):
    return m.with_drawdown(t.history).select("run_id", "ts", "portfolio_value", "pnl", "ret", "drawdown")


@query("performance_metrics", "O-M1 O-M2 O-M3 O-M4 O-M5 O-M6 O-M7", """
    WITH d AS (SELECT *, portfolio_value < peak AS below, coalesce(portfolio_value / prev - 1, 0) AS ret,
            cash_reserve - lag(cash_reserve) OVER (PARTITION BY run_id ORDER BY ts) AS cash_up,
            CASE WHEN isinf(health_factor) THEN NULL ELSE health_factor END AS hf FROM hist),
        g AS (SELECT *, sum((NOT below)::INT) OVER (PARTITION BY run_id ORDER BY ts) AS island FROM d),
        streak AS (SELECT run_id, max(len) AS longest FROM (
            SELECT run_id, island, sum(below::INT) AS len FROM g GROUP BY ALL) GROUP BY run_id)
    SELECT run_id, arg_min(portfolio_value, ts) AS initial_value, arg_max(portfolio_value, ts) AS final_value,
        max((peak - portfolio_value) / peak) * 100 AS max_drawdown_pct,
        any_value(longest)::BIGINT AS max_drawdown_duration_bars,
        coalesce(min(hf), 'Infinity'::DOUBLE) AS min_health_factor, coalesce(avg(hf), 'Infinity'::DOUBLE) AS avg_health_factor,
        count(*) FILTER (hf < 1) AS bars_below_hf_1_0, count(*) FILTER (hf < 1.5) AS bars_below_hf_1_5,
        sum(action_count)::BIGINT AS total_actions, count(*) FILTER (liquidation_penalty > 0) AS total_liquidations,
        sum(interest_accrued) AS total_interest_paid, sum(lst_yield) AS total_lst_yield_earned,
        sum(liquidation_penalty) AS total_liquidation_penalty_paid,
        sum(greatest(cash_up, 0)) FILTER (cash_up IS NOT NULL) AS total_cash_hedged, max(cash_reserve) AS max_cash_reserve,
        (arg_max(portfolio_value, ts) / arg_min(portfolio_value, ts) - 1) * 100 AS total_return_pct,
        avg(ret) / stddev_samp(ret) * sqrt(8760) AS sharpe_ratio,
        avg(ret) / stddev_samp(ret) FILTER (ret < 0) * sqrt(8760) AS sortino_ratio
    FROM g JOIN streak USING (run_id) GROUP BY run_id""",
       doubles="initial_value final_value max_drawdown_pct min_health_factor avg_health_factor total_interest_paid "
               "total_lst_yield_earned total_liquidation_penalty_paid total_cash_hedged max_cash_reserve total_return_pct "
               "sharpe_ratio sortino_ratio")
def _performance(t: Tables):
    return m.performance(t.history)


def perp_history(t: Tables) -> DataFrame:
    """Perp account history bound to the runs: exposure and fees follow the hour's targets."""
    exposure = F.col("target_long_fraction") - F.col("target_short_fraction") * 10.0
    return t.history.select(
        "run_id", "ts", F.col("price").alias("btc_close"), F.col("portfolio_value").alias("equity"),
        exposure.alias("exposure"),
        (F.col("cash_reserve") * F.col("target_long_fraction")).alias("traded_notional"),
        F.col("interest_accrued").alias("fees"), F.col("lst_yield").alias("funding"),
        F.col("liquidation_penalty").alias("liquidation_fee"),
        (F.col("cash_reserve") / 10.0).alias("maintenance_margin"),
        F.when(F.col("liquidation_penalty") > 0, "liquidation").when(F.col("long_green") == 0, "stop_loss")
        .when(F.col("long_green") == 4, "take_profit").otherwise("").alias("exit_reason"),
    )


define("perp", """SELECT run_id, ts, price AS btc_close, portfolio_value AS equity,
        target_long_fraction - target_short_fraction * 10 AS exposure,
        cash_reserve * target_long_fraction AS traded_notional, interest_accrued AS fees, lst_yield AS funding,
        liquidation_penalty AS liquidation_fee, cash_reserve / 10 AS maintenance_margin,
        CASE WHEN liquidation_penalty > 0 THEN 'liquidation' WHEN long_green = 0 THEN 'stop_loss'
            WHEN long_green = 4 THEN 'take_profit' ELSE '' END AS exit_reason FROM history""")


@query("perp_summary", "O-M8 D13", """
    WITH d AS (SELECT *, equity / lag(equity) OVER w - 1 AS r, epoch(ts) - epoch(lag(ts) OVER w) AS gap,
            equity / max(equity) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd
        FROM perp WINDOW w AS (PARTITION BY run_id ORDER BY ts)),
    a AS (SELECT run_id, arg_min(equity, ts) AS starting_equity, arg_max(equity, ts) AS final_equity,
        365.25 * 86400 / median(gap) AS ppy, count(*) AS n, avg(r) AS mean, stddev_pop(r) AS sd,
        stddev_pop(r) FILTER (r < 0) AS down, -min(dd) AS max_drawdown, sum(traded_notional) AS turnover,
        count(*) FILTER (abs(traded_notional) > 1e-8) AS trade_count, max(abs(exposure)) AS max_abs_exposure,
        avg(abs(exposure)) AS average_abs_exposure, sum(fees) AS fee_drag, sum(funding) AS funding_drag,
        count(*) FILTER (exit_reason = 'liquidation') AS liquidation_count, sum(liquidation_fee) AS liquidation_fee_drag,
        max(maintenance_margin) AS max_maintenance_margin, count(*) FILTER (exit_reason = 'stop_loss') AS stop_count,
        count(*) FILTER (exit_reason = 'take_profit') AS take_profit_count,
        avg((exposure > 0)::INT) AS percent_time_long, avg((exposure < 0)::INT) AS percent_time_short,
        avg((exposure = 0)::INT) AS percent_time_flat, arg_max(btc_close, ts) / arg_min(btc_close, ts) - 1 AS btc_buy_and_hold_return
        FROM d GROUP BY run_id)
    SELECT * EXCLUDE (ppy, n, mean, sd, down), final_equity / starting_equity - 1 AS total_return,
        pow(final_equity / starting_equity, ppy / n) - 1 AS annualized_return,
        mean / sd * sqrt(ppy) AS sharpe, mean / down * sqrt(ppy) AS sortino FROM a""",
       doubles="starting_equity final_equity max_drawdown turnover max_abs_exposure average_abs_exposure fee_drag funding_drag "
               "liquidation_fee_drag max_maintenance_margin percent_time_long percent_time_short percent_time_flat "
               "btc_buy_and_hold_return total_return annualized_return sharpe sortino")
def _perp(t: Tables):
    return m.perp_summary(perp_history(t))


define("episodes", """
    SELECT e.run_id, e.peak_index, e.trough_index, e.peak_value, e.trough_value,
        (e.peak_value - e.trough_value) / e.peak_value * 100 AS drawdown_pct,
        (SELECT min(h.idx) FROM hist h WHERE h.run_id = e.run_id AND h.idx > e.trough_index
            AND h.portfolio_value >= e.trough_value + (e.peak_value - e.trough_value) * 0.5) - e.trough_index AS half_recovery_bars,
        (SELECT min(h.idx) FROM hist h WHERE h.run_id = e.run_id AND h.idx > e.trough_index
            AND h.portfolio_value > e.peak_value) - e.trough_index AS new_high_bars
    FROM (SELECT run_id, peak AS peak_value, min(idx) AS peak_index, min(portfolio_value) AS trough_value,
            arg_min(idx, (portfolio_value, idx)) AS trough_index
          FROM hist GROUP BY run_id, peak) e
    WHERE e.trough_value < e.peak_value AND (e.peak_value - e.trough_value) / e.peak_value * 100 >= 2""")


@query("drawdown_episodes", "O-M9", "SELECT * FROM episodes",
       doubles="peak_value trough_value drawdown_pct half_recovery_bars new_high_bars")
def _episodes(t: Tables):
    # Nullable counts travel as doubles, which every client reads alike.
    number = lambda c: F.col(c).cast("double")
    return m.drawdown_episodes(m.indexed(t.history), 2.0).withColumns(
        {c: number(c) for c in ("half_recovery_bars", "new_high_bars")}
    )


@query("episode_summary", "O-M10", """
    SELECT r.run_id, count(e.run_id) AS major_drawdown_events, avg(half_recovery_bars) AS avg_half_recovery_bars,
        avg(new_high_bars) AS avg_new_high_bars
    FROM (SELECT DISTINCT run_id FROM history) r LEFT JOIN episodes e USING (run_id) GROUP BY 1""",
       doubles="avg_half_recovery_bars avg_new_high_bars")
def _episode_summary(t: Tables):
    return m.episode_summary(t.history, m.drawdown_episodes(m.indexed(t.history), 2.0))


@query("drawdown_since", "O-M11", """
    SELECT run_id, max(1 - portfolio_value / p) * 100 AS drawdown_since_pct FROM (
        SELECT *, max(portfolio_value) OVER (PARTITION BY run_id ORDER BY ts) AS p FROM history
        WHERE ts >= TIMESTAMP '2024-01-15') GROUP BY 1""", doubles="drawdown_since_pct")
def _since(t: Tables):
    return m.drawdown_since(t.history, "2024-01-15")


@query("worst_drawdown", "O-M12", """
    SELECT run_id, arg_min(ts, ((portfolio_value - peak) / peak, ts)) AS worst_ts, min((portfolio_value - peak) / peak) AS worst_dd
    FROM hist GROUP BY 1""", doubles="worst_dd")
def _worst(t: Tables):
    return m.worst_drawdown(t.history)


_PERIOD = """
    SELECT run_id, {label} AS period, arg_min(portfolio_value, ts) AS start_value, arg_max(portfolio_value, ts) AS end_value,
        min(portfolio_value) AS min_value, arg_max(portfolio_value / price, ts) AS end_sol_equiv,
        avg(target_long_fraction) AS avg_long_target, avg(target_short_fraction) AS avg_short_target,
        max(debt_eth_value) AS max_eth_debt, min(health_factor) AS min_health_factor, sum(action_count)::BIGINT AS actions,
        (arg_max(portfolio_value, ts) / arg_min(portfolio_value, ts) - 1) * 100 AS return_pct,
        (min(portfolio_value) / arg_min(portfolio_value, ts) - 1) * 100 AS dd_pct
    FROM hist GROUP BY 1, 2"""
define("weekly", _PERIOD.format(label="strftime(date_trunc('week', ts), '%Y-%m-%d')"))


@query("quarterly_decomposition", "O-M13", _PERIOD.format(label="year(ts) || 'Q' || quarter(ts)"),
       doubles="start_value end_value min_value end_sol_equiv avg_long_target avg_short_target max_eth_debt "
               "min_health_factor return_pct dd_pct")
def _quarters(t: Tables):
    return m.period_decomposition(with_debt(t))


@query("run_comparison", "O-J7", """
    SELECT h.period, h.end_value AS hedge_end_value, h.return_pct AS hedge_return_pct, h.dd_pct AS hedge_dd_pct,
        a.end_value AS anchor_end_value, a.return_pct AS anchor_return_pct, a.dd_pct AS anchor_dd_pct,
        h.end_value - a.end_value AS delta_end_value, h.return_pct - a.return_pct AS delta_return_pct,
        h.dd_pct - a.dd_pct AS delta_dd_pct
    FROM (SELECT * FROM weekly WHERE run_id = 'click') h LEFT JOIN (SELECT * FROM weekly WHERE run_id = 'view') a USING (period)""",
       doubles="hedge_end_value hedge_return_pct hedge_dd_pct anchor_end_value anchor_return_pct anchor_dd_pct "
               "delta_end_value delta_return_pct delta_dd_pct")
def _compare(t: Tables):
    return m.compare_runs(m.period_decomposition(with_debt(t), "week"), "click", "view")


@query("target_buckets", "O-M14", """
    SELECT run_id, bucket, count(*) AS bars, avg(step) AS mean_pnl, avg((portfolio_value - peak) / peak) * 100 AS avg_drawdown_pct,
        min((portfolio_value - peak) / peak) * 100 AS min_drawdown_pct, avg(debt_eth_value) AS avg_eth_debt_value,
        avg(least(health_factor, 10)) AS avg_health_factor
    FROM (SELECT *, portfolio_value - lag(portfolio_value) OVER (PARTITION BY run_id, bucket ORDER BY ts) AS step
          FROM (SELECT *, round(target_short_fraction, 3) AS bucket FROM hist)) GROUP BY 1, 2""",
       doubles="bucket mean_pnl avg_drawdown_pct min_drawdown_pct avg_eth_debt_value avg_health_factor")
def _buckets(t: Tables):
    return m.target_buckets(with_debt(t))


@query("hedge_activation", "O-M15", """
    SELECT run_id, count(*) AS bars, count(*) FILTER (target_short_fraction > 0) AS active_bars,
        100.0::DOUBLE * count(*) FILTER (target_short_fraction > 0) / count(*) AS active_share_pct,
        coalesce(avg(target_short_fraction) FILTER (target_short_fraction > 0), 0) AS avg_active_target,
        max(target_short_fraction) AS max_target, max(debt_eth_value) AS max_eth_debt, arg_max(debt_eth_value, ts) AS final_eth_debt
    FROM hist GROUP BY 1""", doubles="active_share_pct avg_active_target max_target max_eth_debt final_eth_debt")
def _activation(t: Tables):
    return m.hedge_activation(with_debt(t))


@query("state_shares", "O-M16", """
    SELECT run_id, avg((selected_long = 'SOL')::INT) AS sol_share, avg((selected_long = 'ETH')::INT) AS eth_share,
        avg((selected_long = '')::INT) AS cash_share FROM history GROUP BY 1""", doubles="sol_share eth_share cash_share")
def _shares(t: Tables):
    return m.state_shares(t.history, "selected_long", ["SOL", "ETH", ""])


@query("scenario_rows", "O-M17", """
    SELECT run_id, avg(target_long_fraction) AS avg_target_long_fraction, min(target_long_fraction) AS min_target_long_fraction,
        max(target_short_fraction) AS max_target_short_fraction, avg(realized_vol_pct) AS avg_realized_vol_pct,
        quantile_cont(realized_vol_pct, 0.95) AS p95_realized_vol_pct,
        avg((target_long_fraction < CASE long_green WHEN 3 THEN 1.025 WHEN 4 THEN 1.075 ELSE 0 END)::INT) AS vol_capped_share,
        max(debt_eth_value) AS max_debt, arg_max(debt_eth_value, ts) AS final_debt FROM hist GROUP BY 1""",
       doubles="avg_target_long_fraction min_target_long_fraction max_target_short_fraction avg_realized_vol_pct "
               "p95_realized_vol_pct vol_capped_share max_debt final_debt", digits=7)
def _scenario(t: Tables):
    return m.scenario_row(with_debt(t))


@query("event_counts", "O-M18 D11", """
    SELECT user_id, count(*) AS events, count(*) FILTER (k % 4 < 2) AS traffic_light_events,
        count(*) FILTER (k % 4 = 2) AS cppi_events
    FROM (SELECT user_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events) GROUP BY 1""")
def _event_counts(t: Tables):
    k = F.get_json_object("props", "$.k").cast("bigint") % 4
    reason = (
        F.when(k == 0, "traffic_light_hedge_up").when(k == 1, "traffic_light_hedge_down")
        .when(k == 2, "cppi_exposure_cap_sell").otherwise("hedge_up")
    )
    return m.event_counts(t.events.select("user_id", reason.alias("reason")), ["user_id"], ["traffic_light", "cppi"])


@query("run_activity", "O-M19", """
    SELECT run_id, 100.0::DOUBLE * avg((liquidation_penalty > 0)::INT) AS active_pct, max(cash_reserve) AS max_protected_book
    FROM history GROUP BY 1""", doubles="active_pct max_protected_book")
def _activity(t: Tables):
    return m.activity(t.history, F.col("liquidation_penalty") > 0, F.col("cash_reserve"))
