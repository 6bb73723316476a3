"""Queries: account risk, stress, what-if, recovery, liquidation, rebalancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaymark.operators import asof, liquidation, rebalance, risk
from quaymark.plans.ctes import define
from quaymark.plans.registry import query
from quaymark.sources.tables import Tables

REPORT = (
    "collateral_value debt_value borrow_limit liquidation_value risk_debt current_ltv borrow_ltv liquidation_ltv "
    "health_factor liquidation_health_factor liquidation_buffer"
)
RATIOS = """CASE WHEN collateral_value = 0 THEN 'Infinity'::DOUBLE ELSE debt_value / collateral_value END AS current_ltv,
        CASE WHEN collateral_value = 0 THEN 'Infinity'::DOUBLE ELSE risk_debt / collateral_value END AS borrow_ltv,
        CASE WHEN collateral_value = 0 THEN 0 ELSE liquidation_value / collateral_value END AS liquidation_ltv,
        CASE WHEN risk_debt = 0 THEN 'Infinity'::DOUBLE ELSE borrow_limit / risk_debt END AS health_factor,
        CASE WHEN risk_debt = 0 THEN 'Infinity'::DOUBLE ELSE liquidation_value / risk_debt END AS liquidation_health_factor,
        liquidation_value - debt_value AS liquidation_buffer"""
BAND = """CASE WHEN isinf({0}) THEN 'safe' WHEN {0} < 1 THEN 'liquidation' WHEN {0} < 1.1 THEN 'critical'
        WHEN {0} < 1.5 THEN 'moderate' ELSE 'healthy' END"""

define("report", f"SELECT *, {RATIOS} FROM accounts")
define("net", """SELECT account_id, side, symbol, min(pos_no) AS pos_no, sum(amount) AS amount,
        sum(amount * price) / sum(amount) AS price, sum(amount * price * ltv) / sum(amount * price) AS ltv,
        sum(amount * price * liq_threshold) / sum(amount * price) AS liq_threshold,
        sum(amount * price * borrow_factor) / sum(amount * price) AS borrow_factor
    FROM positions GROUP BY ALL""")
define("holdings", """SELECT r.*, n.* EXCLUDE (account_id) FROM report r JOIN (
        SELECT account_id, max(amount) FILTER (side = 'collateral' AND symbol = 'SOL') AS c_sol_amount,
            max(price) FILTER (side = 'collateral' AND symbol = 'SOL') AS c_sol_price,
            max(ltv) FILTER (side = 'collateral' AND symbol = 'SOL') AS c_sol_ltv,
            max(amount) FILTER (side = 'collateral' AND symbol = 'USDC') AS c_usdc_amount,
            max(ltv) FILTER (side = 'collateral' AND symbol = 'USDC') AS c_usdc_ltv,
            max(amount) FILTER (side = 'debt' AND symbol = 'USDC') AS d_usdc_amount,
            max(price) FILTER (side = 'debt' AND symbol = 'USDC') AS d_usdc_price,
            max(amount) FILTER (side = 'debt' AND symbol = 'ETH') AS d_eth_amount,
            max(price) FILTER (side = 'debt' AND symbol = 'ETH') AS d_eth_price
        FROM net GROUP BY 1) n USING (account_id)""")
define("market", """SELECT * FROM (VALUES ('SOL', 0.80::DOUBLE, 200, 1000, 1.0::DOUBLE), ('USDC', 0.93, 200, 500, 1.053),
        ('ETH', 0.83, 200, 1000, 1.0)) m(symbol, m_thr, lo, hi, m_bf)""")


@query("position_values", "O-R1 D6", """
    SELECT account_id, pos_no, side, symbol, amount * price AS value,
        CASE side WHEN 'collateral' THEN amount * price * liq_threshold ELSE 0 END AS liquidation_value,
        CASE side WHEN 'collateral' THEN amount * price * ltv ELSE 0 END AS limit_value,
        CASE side WHEN 'debt' THEN amount * price * borrow_factor ELSE 0 END AS risk_debt FROM positions""",
       doubles="value liquidation_value limit_value risk_debt", digits=6)
def _values(t: Tables):
    return risk.with_values(t.positions).select(
        "account_id", "pos_no", "side", "symbol", "value", "liquidation_value", "limit_value", "risk_debt"
    )


@query("account_risk", "O-R2 O-R16 D7", f"SELECT *, {BAND.format('health_factor')} AS band FROM report", doubles=REPORT, digits=6)
def _report(t: Tables):
    return risk.account_report(t.positions).withColumn("band", risk.health_band(F.col("health_factor")))


@query("liquidation_prices", "O-R3 O-R4", """
    SELECT p.account_id, p.side, p.symbol, CASE WHEN p.side = 'collateral' THEN
            CASE WHEN f.amount * f.liq_threshold = 0 THEN NULL ELSE
            greatest(0, (a.debt_value - (a.liquidation_value - p.liq)) / (f.amount * f.liq_threshold)) END
        ELSE CASE WHEN f.amount = 0 THEN NULL ELSE greatest(0, (a.liquidation_value - (a.debt_value - p.value)) / f.amount) END
        END AS liquidation_price
    FROM (SELECT account_id, side, symbol, sum(amount * price) AS value, sum(amount * price * liq_threshold) AS liq
          FROM positions GROUP BY ALL) p
    JOIN (SELECT * FROM positions QUALIFY row_number() OVER (PARTITION BY account_id, side, symbol ORDER BY pos_no) = 1) f
        USING (account_id, side, symbol)
    JOIN accounts a ON a.account_id = p.account_id""", doubles="liquidation_price")
def _liq_prices(t: Tables):
    return risk.liquidation_prices(t.positions)


MOVES = {"m50": -0.5, "m20": -0.2, "flat": 0.0, "p20": 0.2, "eth_800": -0.1}


@query("stress_grid", "O-R5", f"""
    WITH g AS (SELECT p.* EXCLUDE (price), s.scenario_id,
            CASE WHEN scenario_id = 'eth_800' AND symbol = 'ETH' THEN 800
                WHEN symbol IN ('USDC') THEN price ELSE price * (1 + move) END AS price
        FROM positions p, (VALUES ('m50', -0.5::DOUBLE), ('m20', -0.2), ('flat', 0.0), ('p20', 0.2), ('eth_800', -0.1)) s(scenario_id, move)),
    a AS (SELECT account_id, scenario_id,
            sum(CASE side WHEN 'collateral' THEN amount * price ELSE 0 END) AS collateral_value,
            sum(CASE side WHEN 'debt' THEN amount * price ELSE 0 END) AS debt_value,
            sum(CASE side WHEN 'collateral' THEN amount * price * ltv ELSE 0 END) AS borrow_limit,
            sum(CASE side WHEN 'collateral' THEN amount * price * liq_threshold ELSE 0 END) AS liquidation_value,
            sum(CASE side WHEN 'debt' THEN amount * price * borrow_factor ELSE 0 END) AS risk_debt FROM g GROUP BY ALL)
    SELECT *, {RATIOS} FROM a""", doubles=REPORT, digits=5)
def _stress(t: Tables):
    return risk.stress_grid(t.positions, MOVES, {("eth_800", "ETH"): 800.0})


define("after_actions", """
    SELECT n.account_id, n.side, n.symbol, n.pos_no, n.amount + coalesce(d.delta, 0) AS amount,
        coalesce(p.price, n.price) AS price, n.ltv, n.liq_threshold, n.borrow_factor
    FROM net n LEFT JOIN (
        SELECT account_id, symbol, CASE WHEN type LIKE '%collateral' THEN 'collateral' ELSE 'debt' END AS side,
            sum(CASE WHEN type IN ('deposit_collateral', 'borrow') THEN amount ELSE -amount END) AS delta
        FROM actions WHERE type <> 'set_price' GROUP BY ALL) d USING (account_id, side, symbol)
    LEFT JOIN (SELECT account_id, symbol, arg_max(price, action_no) AS price FROM actions WHERE type = 'set_price' GROUP BY ALL) p
        ON p.account_id = n.account_id AND p.symbol = n.symbol""")


@query("positions_after_actions", "O-R6", "SELECT account_id, side, symbol, amount, price FROM after_actions", doubles="amount price")
def _apply(t: Tables):
    return risk.apply_actions(risk.net_positions(t.positions), t.actions).select(
        "account_id", "side", "symbol", "amount", "price"
    )


@query("action_errors", "O-R6", """
    SELECT a.account_id, a.action_no, a.type, a.symbol,
        CASE WHEN type LIKE '%collateral' THEN 'collateral asset not found' WHEN type IN ('borrow', 'repay') THEN 'debt asset not found'
            ELSE 'asset not found' END AS error
    FROM actions a WHERE NOT EXISTS (SELECT 1 FROM positions p WHERE p.account_id = a.account_id AND p.symbol = a.symbol
        AND (type = 'set_price' OR p.side = CASE WHEN type LIKE '%collateral' THEN 'collateral' ELSE 'debt' END))""")
def _errors(t: Tables):
    return risk.action_errors(t.positions, t.actions).select("account_id", "action_no", "type", "symbol", "error")


@query("scenario_deltas", "O-R16", f"""
    WITH b AS (SELECT account_id, sum(CASE side WHEN 'collateral' THEN amount * price ELSE 0 END) AS collateral_value,
            sum(CASE side WHEN 'debt' THEN amount * price ELSE 0 END) AS debt_value,
            sum(CASE side WHEN 'collateral' THEN amount * price * ltv ELSE 0 END) AS borrow_limit,
            sum(CASE side WHEN 'collateral' THEN amount * price * liq_threshold ELSE 0 END) AS liquidation_value,
            sum(CASE side WHEN 'debt' THEN amount * price * borrow_factor ELSE 0 END) AS risk_debt
        FROM after_actions GROUP BY 1),
    s AS (SELECT *, {RATIOS} FROM b)
    SELECT account_id, s.health_factor AS scenario_hf, {BAND.format('s.health_factor')} AS band,
        CASE WHEN isfinite(s.health_factor) AND isfinite(r.health_factor) THEN s.health_factor - r.health_factor END AS delta_health_factor,
        s.borrow_limit - r.borrow_limit AS delta_borrow_limit, s.liquidation_buffer - r.liquidation_buffer AS delta_liquidation_buffer,
        CASE WHEN isfinite(s.current_ltv) AND isfinite(r.current_ltv) THEN s.current_ltv - r.current_ltv END AS delta_current_ltv,
        CASE WHEN isfinite(s.borrow_ltv) AND isfinite(r.borrow_ltv) THEN s.borrow_ltv - r.borrow_ltv END AS delta_borrow_ltv,
        s.liquidation_ltv - r.liquidation_ltv AS delta_liquidation_ltv
    FROM s JOIN report r USING (account_id)""",
       doubles="scenario_hf delta_health_factor delta_borrow_limit delta_liquidation_buffer delta_current_ltv delta_borrow_ltv delta_liquidation_ltv")
def _deltas(t: Tables):
    return risk.scenario_deltas(risk.apply_actions(risk.net_positions(t.positions), t.actions), t.positions)


@query("recovery_options", "O-R7", """
    WITH weak AS (SELECT account_id, 1.1 * risk_debt - borrow_limit AS gap, risk_debt - borrow_limit / 1.1 AS pay FROM report
            WHERE health_factor < 1.5 AND 1.1 * risk_debt - borrow_limit > 0),
        d AS (SELECT * FROM net JOIN weak USING (account_id) WHERE side = 'debt' AND price > 0 AND amount > 0),
        c AS (SELECT *, CASE WHEN ltv < 1.1 THEN least(gap / (price * (1.1 - ltv)), amount) ELSE 0 END AS w
            FROM net JOIN weak USING (account_id) WHERE side = 'collateral' AND price > 0 AND ltv > 0)
    SELECT account_id, 'A' AS option, NULL AS collateral_symbol, symbol AS debt_symbol, NULL::DOUBLE AS collateral_tokens,
        least(pay / price, amount) AS debt_tokens FROM d
    UNION ALL SELECT c.account_id, 'B', c.symbol, d.symbol, c.w, least(c.w * c.price / d.price, d.amount)
        FROM c JOIN d ON c.account_id = d.account_id WHERE c.w > 0
    UNION ALL SELECT account_id, 'C', symbol, NULL, gap / (price * ltv), NULL FROM c""", doubles="collateral_tokens debt_tokens")
def _recovery(t: Tables):
    return risk.recovery_options(risk.net_positions(t.positions))


@query("hedge_conversions", "O-R8", """
    SELECT account_id, CASE WHEN risk_debt > 0 AND c_sol_price * c_sol_ltv > 0 THEN
            greatest((borrow_limit - 1.3 * risk_debt) / (c_sol_price * c_sol_ltv), 0) ELSE 0 END AS withdraw_tokens,
        coalesce(1000 / c_sol_price, 0) AS deploy_tokens, coalesce(c_usdc_amount / c_sol_price, 0) AS swap_tokens,
        coalesce(d_usdc_amount * d_usdc_price / c_sol_price, 0) AS loop_tokens FROM holdings""",
       doubles="withdraw_tokens deploy_tokens swap_tokens loop_tokens")
def _conversions(t: Tables):
    acc = risk.account_assets(risk.net_positions(t.positions), ["SOL", "USDC"], ["USDC"], ("amount", "price", "ltv"))
    px = F.col("c_sol_price")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return acc.select(
        "account_id",
        zero(risk.hedge_withdraw(F.col("risk_debt"), F.col("borrow_limit"), 1.3, px, F.col("c_sol_ltv"))).alias("withdraw_tokens"),
        zero(risk.swap_tokens(F.lit(1000.0), F.lit(1.0), px)).alias("deploy_tokens"),
        zero(risk.swap_tokens(F.col("c_usdc_amount"), F.lit(1.0), px)).alias("swap_tokens"),
        zero(risk.swap_tokens(F.col("d_usdc_amount"), F.col("d_usdc_price"), px)).alias("loop_tokens"),
    )


@query("leverage_loops", "O-R9", """
    WITH RECURSIVE cfg AS (SELECT * FROM (VALUES ('three', 3, 0.85::DOUBLE), ('five', 5, 0.5)) c(config, rounds, u)),
    loops AS (SELECT account_id, pos_no, symbol, price, ltv, config, rounds, u, 0 AS k, amount AS tokens, 0.0::DOUBLE AS owed
            FROM positions, cfg WHERE side = 'collateral'
        UNION ALL SELECT account_id, pos_no, symbol, price, ltv, config, rounds, u, k + 1,
            tokens + (tokens * price * ltv - owed) * u / price, owed + (tokens * price * ltv - owed) * u FROM loops WHERE k < rounds)
    SELECT account_id, pos_no, symbol, config, owed AS borrowed_usd, tokens AS final_amount FROM loops WHERE k = rounds""",
       doubles="borrowed_usd final_amount")
def _loops(t: Tables):
    return risk.leverage_loops(t.positions, [("three", 3, 0.85), ("five", 5, 0.5)]).select(
        "account_id", "pos_no", "symbol", "config", "borrowed_usd", "final_amount"
    )


@query("rebalance_advice", "O-R10", """
    WITH h AS (SELECT *, risk_debt - borrow_limit / 1.3 AS pay, account_id % 3 * 1000.0::DOUBLE AS cash,
            least(CASE WHEN c_sol_price * c_sol_ltv > 0 AND risk_debt > 0 THEN greatest(0, (borrow_limit - 1.3 * risk_debt) / (c_sol_price * c_sol_ltv)) ELSE 0 END,
                c_sol_amount * 0.9) AS out FROM holdings WHERE isfinite(health_factor) AND debt_value <> 0),
    r AS (SELECT *, CASE
            WHEN health_factor < 1.15 AND pay > 0 AND d_usdc_price > 0 AND least(pay / d_usdc_price, d_usdc_amount) > 0 AND c_sol_price > 0 THEN 'delever'
            WHEN health_factor > 2.5 AND account_id IS NOT NULL AND c_sol_price > 0 AND out > 0 THEN 'hedge'
            WHEN cash > 0 AND health_factor <= 1.3 AND c_sol_price > 0 THEN 'redeploy'
            WHEN health_factor > 2.5 AND borrow_limit - debt_value > 0 AND d_usdc_price > 0 AND c_sol_price > 0 THEN 'relever' END AS advice FROM h)
    SELECT account_id, advice, 0 AS step, 'withdraw_collateral' AS type, 'SOL' AS symbol, least(pay / c_sol_price, c_sol_amount * 0.5) AS amount, 0 AS cash_delta
        FROM r WHERE advice = 'delever'
    UNION ALL SELECT account_id, advice, 1, 'repay', 'USDC', least(pay / d_usdc_price, d_usdc_amount), 0 FROM r WHERE advice = 'delever'
    UNION ALL SELECT account_id, advice, 0, 'withdraw_collateral', 'SOL', out, out * c_sol_price FROM r WHERE advice = 'hedge'
    UNION ALL SELECT account_id, advice, 0, 'deposit_collateral', 'SOL', cash / c_sol_price, -cash FROM r WHERE advice = 'redeploy'
    UNION ALL SELECT account_id, advice, 0, 'borrow', 'USDC', (borrow_limit - debt_value) * 0.85 / d_usdc_price, 0 FROM r WHERE advice = 'relever'
    UNION ALL SELECT account_id, advice, 1, 'deposit_collateral', 'SOL', (borrow_limit - debt_value) * 0.85 / c_sol_price, 0 FROM r WHERE advice = 'relever'""",
       doubles="amount cash_delta", ints="step")
def _advice(t: Tables):
    acc = risk.account_assets(risk.net_positions(t.positions), ["SOL"], ["USDC"], ("amount", "price", "ltv"))
    return risk.rebalance_advice(acc, "SOL", "USDC", cash=F.col("account_id") % 3 * 1000.0, hedge=True)


@query("safe_sizing", "O-R11", """
    WITH h AS (SELECT *, coalesce(c_sol_amount * c_sol_price, 0) AS sol_value, coalesce(c_usdc_amount, 0) AS cash,
            coalesce(c_usdc_ltv, 0) AS usdc_ltv, coalesce(c_sol_ltv, 0) AS sol_ltv, coalesce(d_usdc_amount, 0) AS usdc_debt,
            coalesce(d_usdc_amount * d_usdc_price, 0) AS usdc_debt_value, coalesce(d_eth_amount, 0) AS eth_debt,
            collateral_value - debt_value AS equity, 1.053 * 1.35 - coalesce(c_sol_ltv, 0) AS rd FROM holdings),
    s AS (SELECT *, CASE WHEN borrow_limit - 1.25 * risk_debt <= 0 THEN 0 WHEN 1.25 - usdc_ltv * 0.999 <= 0 THEN 'Infinity'::DOUBLE
            ELSE (borrow_limit - 1.25 * risk_debt) / (1.25 - usdc_ltv * 0.999) END AS max_short_usd,
        CASE WHEN sol_value > 0 AND account_id % 5 >= 3 THEN least(sol_value * 0.2 * CASE account_id % 5 WHEN 3 THEN 0.25 ELSE 0.5 END, sol_value * 0.05, cash) ELSE 0 END AS surplus FROM h)
    SELECT account_id, max_short_usd, least(sol_value * 0.25, max_short_usd) AS open_usd,
        coalesce(least(eth_debt, sol_value * 0.25 / d_eth_price, cash / (d_eth_price * 1.001)), 0) AS cover_tokens,
        CASE WHEN equity - usdc_debt_value > 0 AND rd > 0 THEN least(equity - usdc_debt_value, greatest(0, (borrow_limit - 1.35 * risk_debt) / rd)) ELSE 0 END AS relever_usd,
        CASE WHEN surplus <= 0 OR risk_debt <= 0 OR usdc_ltv - sol_ltv * 0.999 <= 0 THEN surplus WHEN borrow_limit - 2 * risk_debt <= 0 THEN 0
            ELSE least(surplus, (borrow_limit - 2 * risk_debt) / (usdc_ltv - sol_ltv * 0.999)) END AS surplus_usd,
        least(greatest(0, usdc_debt - greatest(0, equity) * CASE account_id % 5 WHEN 1 THEN 0.5 ELSE 0 END), cash, usdc_debt) AS defensive_repay,
        least(usdc_debt, cash) AS green_repay
    FROM s""", doubles="max_short_usd open_usd cover_tokens relever_usd surplus_usd defensive_repay green_repay")
def _sizing(t: Tables):
    acc = risk.account_assets(risk.net_positions(t.positions), ["SOL", "USDC"], ["USDC", "ETH"], ("amount", "price", "ltv"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    green = F.col("account_id") % 5
    sol_value, cash = F.col("sol_value"), F.col("cash")
    limit, debt_w = F.col("borrow_limit"), F.col("risk_debt")
    acc = acc.withColumns(
        {
            "sol_value": zero(F.col("c_sol_amount") * F.col("c_sol_price")), "cash": zero(F.col("c_usdc_amount")),
            "usdc_ltv": zero(F.col("c_usdc_ltv")), "sol_ltv": zero(F.col("c_sol_ltv")),
            "usdc_debt": zero(F.col("d_usdc_amount")), "usdc_owed": zero(F.col("d_usdc_amount") * F.col("d_usdc_price")),
            "equity": F.col("collateral_value") - F.col("debt_value"),
        }
    )
    acc = acc.withColumn("max_short_usd", risk.max_short_usd(limit, debt_w, F.col("usdc_ltv"), 0.001))
    reinvest = F.when(green == 3, 0.25).when(green == 4, 0.5).otherwise(0.0)
    surplus = risk.surplus_spend(sol_value * 0.2, sol_value, cash, reinvest)
    return acc.select(
        "account_id", "max_short_usd", F.least(sol_value * 0.25, F.col("max_short_usd")).alias("open_usd"),
        zero(risk.cover_tokens(sol_value * 0.25, F.col("d_eth_price"), F.col("d_eth_amount"), cash, 0.001)).alias("cover_tokens"),
        risk.relever_usd(F.col("equity"), F.col("usdc_owed"), limit, debt_w, F.col("sol_ltv")).alias("relever_usd"),
        risk.capped_spend(surplus, limit, debt_w, F.col("usdc_ltv"), F.col("sol_ltv"), 0.001).alias("surplus_usd"),
        risk.defensive_repay(F.col("equity"), F.when(green == 1, 0.5).otherwise(0.0), F.col("usdc_debt"), cash).alias("defensive_repay"),
        F.least("usdc_debt", "cash").alias("green_repay"),
    )


# Waves replayed position by position: each step recomputes every total from the rows.
define("liq", """/* RECURSIVE */
    SELECT 0 AS wave, account_id, side, p.symbol, pos_no, amount, price, ltv, liq_threshold, borrow_factor, m_thr, lo, hi, m_bf,
        NULL::VARCHAR AS debt_symbol, NULL::DOUBLE AS debt_repaid, NULL::DOUBLE AS debt_repaid_usd, NULL::VARCHAR AS collateral_symbol,
        NULL::DOUBLE AS collateral_seized, NULL::DOUBLE AS collateral_seized_usd, NULL::DOUBLE AS bonus_pct
    FROM positions p LEFT JOIN market USING (symbol)
    UNION ALL
    SELECT wave + 1, account_id, side, symbol, pos_no,
        amount - CASE WHEN pick = 1 THEN CASE side WHEN 'debt' THEN repaid ELSE seized END ELSE 0 END,
        price, ltv, liq_threshold, borrow_factor, m_thr, lo, hi, m_bf, d_sym, repaid, repaid * d_price, c_sym, seized, seized * c_price, rate
    FROM (SELECT *, least(repaid * d_price * (1 + rate) / c_price, c_amount) AS seized FROM (
        SELECT *, least(debt * 0.2 / d_price, d_amount) AS repaid,
            CASE WHEN debt / coll <= c_thr THEN c_lo / 10000.0::DOUBLE
                ELSE (c_lo + least((debt / coll - c_thr) / (1 - c_thr), 1) * (c_hi - c_lo)) / 10000 END AS rate
        FROM (SELECT *, max(CASE WHEN pick = 1 AND side = 'debt' THEN symbol END) OVER a AS d_sym,
                max(CASE WHEN pick = 1 AND side = 'debt' THEN price END) OVER a AS d_price,
                max(CASE WHEN pick = 1 AND side = 'debt' THEN amount END) OVER a AS d_amount,
                max(CASE WHEN pick = 1 AND side = 'collateral' THEN symbol END) OVER a AS c_sym,
                max(CASE WHEN pick = 1 AND side = 'collateral' THEN price END) OVER a AS c_price,
                max(CASE WHEN pick = 1 AND side = 'collateral' THEN amount END) OVER a AS c_amount,
                max(CASE WHEN pick = 1 AND side = 'collateral' THEN m_thr END) OVER a AS c_thr,
                max(CASE WHEN pick = 1 AND side = 'collateral' THEN lo END) OVER a AS c_lo,
                max(CASE WHEN pick = 1 AND side = 'collateral' THEN hi END) OVER a AS c_hi
            FROM (SELECT *, CASE WHEN amount > 0 THEN row_number() OVER (PARTITION BY account_id, side, amount > 0
                        ORDER BY CASE side WHEN 'debt' THEN -m_bf ELSE m_thr END, pos_no) END AS pick,
                    sum(CASE side WHEN 'collateral' THEN amount * price * liq_threshold ELSE 0 END) OVER (PARTITION BY account_id) AS liq_value,
                    sum(CASE side WHEN 'debt' THEN amount * price * borrow_factor ELSE 0 END) OVER (PARTITION BY account_id) AS risk,
                    sum(CASE side WHEN 'collateral' THEN amount * price ELSE 0 END) OVER (PARTITION BY account_id) AS coll,
                    sum(CASE side WHEN 'debt' THEN amount * price ELSE 0 END) OVER (PARTITION BY account_id) AS debt
                FROM liq WHERE wave < 5)
            WHERE risk > 0 AND liq_value / risk < 1 AND coll > 0
            WINDOW a AS (PARTITION BY account_id))
        WHERE d_sym IS NOT NULL AND c_sym IS NOT NULL))""")
define("liq_events", """SELECT account_id, wave, any_value(debt_symbol) AS debt_symbol, max(debt_repaid) AS debt_repaid,
        max(debt_repaid_usd) AS debt_repaid_usd, any_value(collateral_symbol) AS collateral_symbol,
        max(collateral_seized) AS collateral_seized, max(collateral_seized_usd) AS collateral_seized_usd, max(bonus_pct) AS bonus_pct,
        sum(CASE side WHEN 'collateral' THEN amount * price * ltv ELSE 0 END)
            / sum(CASE side WHEN 'debt' THEN amount * price * borrow_factor ELSE 0 END) AS resulting_hf
    FROM liq WHERE wave > 0 GROUP BY 1, 2""")
EVENT = "debt_repaid debt_repaid_usd collateral_seized collateral_seized_usd bonus_pct resulting_hf"


@query("liquidation_pass", "O-R12 D9", "SELECT * EXCLUDE (wave) FROM liq_events WHERE wave = 1", doubles=EVENT)
def _pass(t: Tables):
    return liquidation.liquidation_pass(t.positions, liquidation.market_assets(t.spark))


@query("liquidation_waves", "O-R13", "SELECT * FROM liq_events", doubles=EVENT, ints="wave")
def _waves(t: Tables):
    return liquidation.liquidation_waves(t.positions, liquidation.market_assets(t.spark))


define("plan_legs", """SELECT account_id, collateral_value - debt_value AS equity,
        CASE account_id % 3 WHEN 0 THEN 'SOL' WHEN 1 THEN 'ETH' ELSE '' END AS selected_long,
        CASE account_id % 3 WHEN 0 THEN 'ETH' ELSE 'SOL' END AS selected_short
    FROM accounts WHERE collateral_value > debt_value""")
define("plan_rows", """SELECT n.*, l.equity, l.selected_long, l.selected_short, n.amount * n.price AS value,
        max(n.amount) FILTER (side = 'collateral' AND symbol = 'USDC') OVER (PARTITION BY account_id) AS cash,
        max(n.amount) FILTER (side = 'debt' AND symbol = 'USDC') OVER (PARTITION BY account_id) AS owed,
        coalesce(max(n.amount) FILTER (side = 'debt') OVER (PARTITION BY account_id, symbol), 0) AS own_debt,
        coalesce(max(n.amount) FILTER (side = 'collateral') OVER (PARTITION BY account_id, symbol), 0) AS own_coll
    FROM net n JOIN plan_legs l USING (account_id)""")


def _legs(t: Tables):
    equity = F.col("collateral_value") - F.col("debt_value")
    pick = F.col("account_id") % 3
    return risk.account_report(t.positions).filter(equity > 0).select(
        "account_id",
        F.when(pick == 0, "SOL").when(pick == 1, "ETH").otherwise("").alias("selected_long"),
        F.when(pick == 0, "ETH").otherwise("SOL").alias("selected_short"),
        (equity * F.when(pick == 2, 0.0).otherwise(0.8)).alias("target_usd"),
        (equity * 0.3).alias("target_short_usd"),
        (equity * 0.05).alias("threshold_usd"),
    )


@query("long_rebalance_plan", "O-R14", """
    WITH p AS (SELECT *, CASE WHEN symbol = selected_long THEN equity * 0.8 ELSE 0 END - value AS diff FROM plan_rows
            WHERE side = 'collateral' AND symbol IN ('SOL', 'ETH') AND cash IS NOT NULL),
        b AS (SELECT *, least(diff / 0.999, cash) AS spend FROM p WHERE diff >= equity * 0.05 AND own_debt <= 1e-9),
        s AS (SELECT *, least(-diff, value) AS usd, least(-diff, value) * 0.999 AS got FROM p WHERE -diff >= equity * 0.05),
        x AS (SELECT *, CASE WHEN owed > 0 THEN least(got, owed) ELSE 0 END AS repay FROM s)
    SELECT account_id, symbol AS position, 0 AS step, 'withdraw_collateral' AS type, 'USDC' AS symbol, spend AS amount FROM b
    UNION ALL SELECT account_id, symbol, 1, 'deposit_collateral', symbol, spend * 0.999 / price FROM b
    UNION ALL SELECT account_id, symbol, 2, 'borrow', 'USDC', (diff - spend * 0.999) / 0.999 FROM b
        WHERE owed IS NOT NULL AND diff - spend * 0.999 > equity * 0.05
    UNION ALL SELECT account_id, symbol, 3, 'deposit_collateral', symbol, (diff - spend * 0.999) / price FROM b
        WHERE owed IS NOT NULL AND diff - spend * 0.999 > equity * 0.05
    UNION ALL SELECT account_id, symbol, 0, 'withdraw_collateral', symbol, usd / price FROM x
    UNION ALL SELECT account_id, symbol, 1, 'repay', 'USDC', repay FROM x WHERE repay > 0
    UNION ALL SELECT account_id, symbol, CASE WHEN repay > 0 THEN 2 ELSE 1 END, 'deposit_collateral', 'USDC', got - repay FROM x WHERE got - repay > 0""",
       doubles="amount", ints="step")
def _long_plan(t: Tables):
    return rebalance.long_plan(risk.net_positions(t.positions), _legs(t), ["SOL", "ETH"], 0.001)


@query("short_rebalance_plan", "O-R15", """
    WITH p AS (SELECT *, CASE WHEN symbol = selected_short THEN equity * 0.3 ELSE 0 END - value AS diff FROM plan_rows
            WHERE side = 'debt' AND symbol IN ('SOL', 'ETH') AND cash IS NOT NULL),
        c AS (SELECT *, least(least(least(-diff, value) * 1.001, cash) / 1.001 / price, amount) AS tokens FROM p WHERE -diff >= equity * 0.05 AND cash > 0)
    SELECT account_id, symbol AS position, 0 AS step, 'borrow' AS type, symbol, diff / price AS amount FROM p WHERE diff >= equity * 0.05
    UNION ALL SELECT account_id, symbol, 1, 'deposit_collateral', 'USDC', diff * 0.999 FROM p WHERE diff >= equity * 0.05
    UNION ALL SELECT account_id, symbol, 0, 'withdraw_collateral', 'USDC', tokens * price * 1.001 FROM c
    UNION ALL SELECT account_id, symbol, 1, 'repay', symbol, tokens FROM c""", doubles="amount", ints="step")
def _short_plan(t: Tables):
    return rebalance.short_plan(risk.net_positions(t.positions), _legs(t), ["SOL", "ETH"], 0.001)


@query("excess_short_cover", "O-R15", """
    WITH p AS (SELECT *, max(value) FILTER (side = 'collateral' AND symbol = 'SOL') OVER (PARTITION BY account_id) AS basis FROM plan_rows),
        c AS (SELECT *, least(least((value - basis * 0.1) * 1.001, cash) / 1.001 / price, amount) AS tokens FROM p
            WHERE side = 'debt' AND symbol = 'ETH' AND cash > 0 AND value - basis * 0.1 >= equity * 0.05)
    SELECT account_id, symbol AS position, 0 AS step, 'withdraw_collateral' AS type, 'USDC' AS symbol, tokens * price * 1.001 AS amount FROM c
    UNION ALL SELECT account_id, symbol, 1, 'repay', symbol, tokens FROM c""", doubles="amount", ints="step")
def _excess(t: Tables):
    legs = _legs(t).select(
        "account_id", F.lit("SOL").alias("basis"), F.lit("ETH").alias("protective_short"),
        F.lit(0.1).alias("target_short_fraction"), "threshold_usd",
    )
    return rebalance.excess_short_cover(risk.net_positions(t.positions), legs, 0.001)


@query("conflict_cover", "O-R15 O-L5", """
    WITH p AS (SELECT *, least(own_coll, amount) AS direct FROM plan_rows
            WHERE side = 'debt' AND symbol IN ('SOL', 'ETH') AND (symbol = selected_long OR symbol <> selected_short)),
        q AS (SELECT *, (amount - direct) * price * 1.001 AS need, row_number() OVER (PARTITION BY account_id ORDER BY pos_no) AS k FROM p),
        c AS (SELECT q.*, least(need, greatest(0, coalesce(cash, 0) - coalesce((SELECT sum(b.need) FROM q b WHERE b.account_id = q.account_id AND b.k < q.k), 0))) AS cost FROM q)
    SELECT account_id, symbol AS position, 0 AS step, 'withdraw_collateral' AS type, symbol, direct AS amount FROM c WHERE direct > 0
    UNION ALL SELECT account_id, symbol, 1, 'repay', symbol, direct FROM c WHERE direct > 0
    UNION ALL SELECT account_id, symbol, CASE WHEN direct > 0 THEN 2 ELSE 0 END, 'withdraw_collateral', 'USDC', cost FROM c WHERE cost > 0
    UNION ALL SELECT account_id, symbol, CASE WHEN direct > 0 THEN 3 ELSE 1 END, 'repay', symbol, cost / (price * 1.001) FROM c WHERE cost > 0""",
       doubles="amount", ints="step")
def _conflict(t: Tables):
    legs = _legs(t).select("account_id", "selected_long", F.col("selected_short").alias("desired_short"))
    return rebalance.conflict_cover(risk.net_positions(t.positions), legs, ["SOL", "ETH"], 0.001)


@query("actions_with_market", "O-J5", """
    SELECT a.account_id, a.action_no, a.symbol, coalesce(m_thr, 0.80) AS m_threshold, coalesce(lo, 200) AS min_bonus_bps,
        coalesce(hi, 1000) AS max_bonus_bps, coalesce(m_bf, 1.0) AS m_borrow_factor FROM actions a LEFT JOIN market m USING (symbol)""",
       doubles="m_threshold m_borrow_factor", ints="min_bonus_bps max_bonus_bps")
def _with_market(t: Tables):
    rows = asof.enrich(
        t.actions, liquidation.market_assets(t.spark), "symbol", {**liquidation.UNKNOWN, "m_borrow_factor": 1.0}
    )
    return rows.select("account_id", "action_no", "symbol", "m_threshold", "min_bonus_bps", "max_bonus_bps", "m_borrow_factor")
