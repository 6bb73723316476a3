"""Queries: ledgers, latches, triggers and perp position analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.operators import ledger, liquidation, perp
from quaymark.plans.ctes import define
from quaymark.plans.registry import query
from quaymark.sources.tables import Tables


define("bal", """SELECT *, sum(delta) OVER (PARTITION BY account_id, side, symbol ORDER BY ts, action_no) AS balance FROM (
        SELECT *, CASE WHEN type LIKE '%collateral' THEN 'collateral' ELSE 'debt' END AS side,
            CASE WHEN type IN ('deposit_collateral', 'borrow') THEN amount ELSE -amount END AS delta
        FROM actions WHERE type <> 'set_price')""")


@query("balance_replay", "O-L1 D8", "SELECT account_id, side, symbol, ts, action_no, delta, balance FROM bal", doubles="delta balance")
def _balances(t: Tables):
    return ledger.balances(t.actions).select("account_id", "side", "symbol", "ts", "action_no", "delta", "balance")


define("debt_rows", """SELECT *, row_number() OVER (PARTITION BY account_id, symbol ORDER BY ts) AS i FROM (
    SELECT account_id, symbol, date_trunc('hour', ts) AS ts,
        CAST(epoch(date_trunc('hour', ts)) / 3600 AS BIGINT) - 473352 AS bar,
        sum(CASE type WHEN 'borrow' THEN amount ELSE -amount END) AS delta, avg(price) AS price,
        any_value(CASE symbol WHEN 'USDC' THEN 0.08 WHEN 'ETH' THEN 0.04 ELSE 0 END::DOUBLE) / 8760 AS r
    FROM actions WHERE type IN ('borrow', 'repay') GROUP BY ALL)""")
define("debts", """/* RECURSIVE */ SELECT account_id, symbol, ts, bar, delta, i, delta AS balance, 0.0::DOUBLE AS interest FROM debt_rows WHERE i = 1
    UNION ALL SELECT d.account_id, d.symbol, d.ts, d.bar, d.delta, d.i, b.balance * pow(1 + d.r, d.bar - b.bar) + d.delta,
        b.balance * pow(1 + d.r, d.bar - b.bar - 1) * d.r * d.price
    FROM debts b JOIN debt_rows d ON d.account_id = b.account_id AND d.symbol = b.symbol AND d.i = b.i + 1""")


@query("debt_interest", "O-L2", "SELECT account_id, symbol, ts, delta, balance, interest FROM debts",
       doubles="delta balance interest", digits=6)
def _interest(t: Tables):
    hour = F.date_trunc("hour", "ts")
    deltas = (
        t.actions.filter(F.col("type").isin("borrow", "repay"))
        .groupBy("account_id", "symbol", hour.alias("hour"))
        .agg(
            F.sum(F.when(F.col("type") == "borrow", F.col("amount")).otherwise(-F.col("amount"))).alias("delta"),
            F.avg("price").alias("price"),
        )
        .withColumnRenamed("hour", "ts")
        .withColumn("bar", F.floor(F.unix_seconds("ts") / 3600) - 473352)
    )
    apy = F.when(F.col("symbol") == "USDC", 0.08).when(F.col("symbol") == "ETH", 0.04).otherwise(0.0)
    return ledger.interest_balances(deltas, apy).select("account_id", "symbol", "ts", "delta", "balance", "interest")


@query("staking_yield", "O-L3", """
    SELECT run_id, ts, symbol, coalesce(amount * lag(value / amount) OVER (PARTITION BY run_id ORDER BY ts) * 0.07 / 8760, 0) AS lst_yield
    FROM history_positions WHERE side = 'collateral' AND symbol = 'SOL'""", doubles="lst_yield", digits=6)
def _yield(t: Tables):
    rows = t.history_positions.filter("side = 'collateral' AND symbol = 'SOL'").withColumn("price", F.col("value") / F.col("amount"))
    return ledger.staking_yield(rows, ["run_id", "symbol"], F.lit(0.07)).select("run_id", "ts", "symbol", "lst_yield")


def cash_flows(t: Tables) -> DataFrame:
    flow = F.when(F.col("type") == "withdraw_collateral", F.col("amount")).when(
        F.col("type") == "deposit_collateral", -F.col("amount")
    )
    return t.actions.withColumn("flow", flow).filter("flow IS NOT NULL").select("account_id", "ts", "action_no", "flow")


define("cash_rows", """SELECT account_id, ts, action_no, CASE type WHEN 'withdraw_collateral' THEN amount ELSE -amount END AS flow,
        row_number() OVER (PARTITION BY account_id ORDER BY ts, action_no) AS i
    FROM actions WHERE type IN ('withdraw_collateral', 'deposit_collateral')""")
define("cash_path", """/* RECURSIVE */ SELECT account_id, ts, action_no, flow, i, greatest(flow, 0) AS cash_reserve FROM cash_rows WHERE i = 1
    UNION ALL SELECT c.account_id, c.ts, c.action_no, c.flow, c.i, greatest(p.cash_reserve + c.flow, 0)
    FROM cash_path p JOIN cash_rows c ON c.account_id = p.account_id AND c.i = p.i + 1""")


@query("cash_reserve", "O-L4", "SELECT account_id, ts, action_no, flow, cash_reserve FROM cash_path", doubles="flow cash_reserve")
def _cash(t: Tables):
    return ledger.floored_cash(cash_flows(t), ["account_id"], "flow")


define("need_rows", """SELECT account_id, ts, action_no, amount AS need, row_number() OVER (PARTITION BY account_id ORDER BY ts, action_no) AS i
    FROM actions WHERE type = 'borrow'""")
define("fills", """/* RECURSIVE */ SELECT account_id, ts, action_no, need, i, least(need, 40.0::DOUBLE) AS taken, 40.0::DOUBLE - least(need, 40.0::DOUBLE) AS rest
        FROM need_rows WHERE i = 1
    UNION ALL SELECT n.account_id, n.ts, n.action_no, n.need, n.i, least(n.need, f.rest), f.rest - least(n.need, f.rest)
    FROM fills f JOIN need_rows n ON n.account_id = f.account_id AND n.i = f.i + 1""")


@query("budget_waterfall", "O-L5", "SELECT account_id, ts, action_no, need, taken FROM fills", doubles="need taken")
def _waterfall(t: Tables):
    needs = t.actions.filter("type = 'borrow'").select("account_id", "ts", "action_no", F.col("amount").alias("need"))
    return ledger.waterfall(needs, ["account_id"], ledger.ORDER, "need", F.lit(40.0), long=True)


def short_trades(t: Tables) -> DataFrame:
    is_open = F.col("type") == "borrow"
    usdc = F.col("amount") * F.col("price") * F.when(is_open, 0.999).otherwise(1.001)
    return t.actions.filter(F.col("type").isin("borrow", "repay")).select(
        "account_id", "symbol", "ts", "action_no", is_open.alias("is_open"), "amount", usdc.alias("usdc"),
        (F.col("action_no") % 5).alias("green"), F.when(F.col("action_no") % 3 == 0, F.col("amount") * 3.0).alias("wanted"),
    )


#: Protected share of profit by green votes; no vote is not in the table.
PROTECTED = {4: 0.1, 3: 0.2, 2: 0.35, 1: 0.5}


define("short_rows", """SELECT account_id, symbol, ts, action_no, type = 'borrow' AS is_open, amount,
        amount * price * CASE type WHEN 'borrow' THEN 0.999 ELSE 1.001 END::DOUBLE AS usdc,
        CASE action_no % 5 WHEN 4 THEN 0.1 WHEN 3 THEN 0.2 WHEN 2 THEN 0.35 WHEN 1 THEN 0.5 ELSE 0 END::DOUBLE AS fraction,
        CASE WHEN action_no % 3 = 0 THEN amount * 3 ELSE 0 END AS wanted,
        row_number() OVER (PARTITION BY account_id, symbol ORDER BY ts, action_no) AS i
    FROM actions WHERE type IN ('borrow', 'repay')""")
define("shorts", """/* RECURSIVE */ SELECT account_id, symbol, ts, action_no, i, is_open,
        CASE WHEN is_open THEN amount ELSE 0 END AS open_amount, CASE WHEN is_open THEN usdc / amount ELSE 0 END AS average_basis,
        0.0::DOUBLE AS realized_pnl, 0.0::DOUBLE AS lifetime_realized, 0.0::DOUBLE AS protected_book, 0.0::DOUBLE AS consumed FROM short_rows WHERE i = 1
    UNION ALL SELECT account_id, symbol, ts, action_no, i, is_open,
        CASE WHEN is_open THEN o0 + amount ELSE o0 - cov END,
        CASE WHEN is_open THEN (o0 * b0 + usdc) / (o0 + amount) WHEN o0 - cov > 0 THEN b0 ELSE 0 END,
        pnl, life0 + pnl, book0 + greatest(pnl, 0) * fraction,
        used0 + least(wanted, greatest(0, life0 + pnl - (book0 + greatest(pnl, 0) * fraction) - used0))
    FROM (SELECT *, CASE WHEN NOT is_open AND o0 > 0 THEN cov * b0 - usdc * cov / amount ELSE 0 END AS pnl FROM (
        SELECT r.*, s.open_amount AS o0, s.average_basis AS b0, s.lifetime_realized AS life0, s.protected_book AS book0, s.consumed AS used0,
            CASE WHEN r.is_open THEN 0 ELSE least(r.amount, s.open_amount) END AS cov
        FROM shorts s JOIN short_rows r ON r.account_id = s.account_id AND r.symbol = s.symbol AND r.i = s.i + 1))""")


@query("short_ledger", "O-L6 O-L7", """
    SELECT account_id, symbol, action_no, open_amount, average_basis, realized_pnl, lifetime_realized, protected_book, consumed,
        greatest(0, lifetime_realized - consumed - protected_book) AS spendable FROM shorts""",
       doubles="open_amount average_basis realized_pnl lifetime_realized protected_book consumed spendable")
def _shorts(t: Tables):
    rows = ledger.short_ledger(short_trades(t), ledger.protected_fraction(F.col("green"), PROTECTED), F.col("wanted"))
    return rows.select(
        "account_id", "symbol", "action_no", "open_amount", "average_basis", "realized_pnl", "lifetime_realized", "protected_book", "consumed", "spendable",
    )


def perp_trades(t: Tables) -> DataFrame:
    up = F.col("action_no") % 2 == 0
    return t.actions.filter("type <> 'set_price'").select(
        "account_id", "symbol", "ts", "action_no",
        F.when(up, F.col("amount")).otherwise(-F.col("amount")).alias("delta_quantity"), "price",
    )


def perp_ledger(t: Tables) -> DataFrame:
    return ledger.perp_entries(perp_trades(t))


define("trade_rows", """SELECT account_id, symbol, ts, action_no, CASE action_no % 2 WHEN 0 THEN amount ELSE -amount END AS dq, price,
        row_number() OVER (PARTITION BY account_id, symbol ORDER BY ts, action_no) AS i
    FROM actions WHERE type <> 'set_price'""")
define("entries", """/* RECURSIVE */ SELECT account_id, symbol, ts, action_no, i, price, dq AS quantity, 0.0::DOUBLE AS previous_quantity,
        price AS average_entry, 0.0::DOUBLE AS pnl FROM trade_rows WHERE i = 1
    UNION ALL SELECT r.account_id, r.symbol, r.ts, r.action_no, r.i, r.price, e.quantity + r.dq, e.quantity,
        CASE WHEN sign(e.quantity) <> sign(e.quantity + r.dq) THEN r.price
            WHEN sign(e.quantity) = sign(r.dq) THEN (abs(e.quantity) * e.average_entry + abs(r.dq) * r.price) / (abs(e.quantity) + abs(r.dq))
            ELSE e.average_entry END,
        e.quantity * (r.price - e.price)
    FROM entries e JOIN trade_rows r ON r.account_id = e.account_id AND r.symbol = e.symbol AND r.i = e.i + 1""")
define("entry_rows", """SELECT account_id, symbol, ts, action_no, price, CASE WHEN abs(quantity) < 1e-9 THEN 0 ELSE quantity END AS quantity,
        previous_quantity, CASE WHEN abs(quantity) < 1e-9 THEN 0 ELSE average_entry END AS average_entry, pnl,
        CASE action_no % 3 WHEN 0 THEN 'generic_linear_usdt' ELSE 'binance_usdm_like' END AS venue FROM entries""")


@query("perp_entries", "O-L8 O-V1", "SELECT account_id, symbol, action_no, quantity, average_entry, pnl FROM entry_rows",
       doubles="quantity average_entry pnl")
def _entries(t: Tables):
    return perp_ledger(t).select("account_id", "symbol", "action_no", "quantity", "average_entry", "pnl")


def _with_venue(t: Tables) -> DataFrame:
    venue = F.when(F.col("action_no") % 3 == 0, "generic_linear_usdt").otherwise("binance_usdm_like")
    return perp.with_venue(perp_ledger(t).withColumn("venue", venue), perp.venues(t.spark))


@query("perp_cashflows", "O-V2 O-V7 D14", """
    SELECT account_id, symbol, action_no, CASE WHEN quantity <> 0 THEN quantity * price * 1.01 * coalesce(rate, 0.0001) ELSE 0 END AS funding,
        CASE WHEN quantity <> 0 THEN abs(quantity * price * 1.01) * coalesce(rate, 0.0001) ELSE 0 END AS funding_unsigned,
        abs((quantity - previous_quantity) * price) * CASE WHEN action_no % 2 = 0 AND venue = 'binance_usdm_like' THEN 0.0002 ELSE 0.0006 END AS fee
    FROM (SELECT *, CASE WHEN action_no % 4 < 2 THEN price / 1000000 END AS rate FROM entry_rows)""", doubles="funding funding_unsigned fee", digits=6)
def _cashflows(t: Tables):
    rows = _with_venue(t)
    close = F.col("quantity") * F.col("price")
    rate = F.when(F.col("action_no") % 4 < 2, F.col("price") / 1e6)
    liquidity = F.when(F.col("action_no") % 2 == 0, "maker").otherwise("taker")
    return rows.select(
        "account_id", "symbol", "action_no",
        perp.funding_flow(close, close * 1.01, rate, 0.0001).alias("funding"),
        perp.funding_flow(close, close * 1.01, rate, 0.0001, signed=False).alias("funding_unsigned"),
        (F.abs((F.col("quantity") - F.col("previous_quantity")) * F.col("price"))
         * perp.fee_rate(liquidity, F.col("maker"), F.col("taker"))).alias("fee"),
    )


@query("margin_requirements", "O-V3 O-J3", """
    WITH n AS (SELECT *, quantity * price * 1000 AS notional, 20.0::DOUBLE * (action_no % 100) AS equity FROM entry_rows),
    m AS (SELECT *, abs(notional) * CASE WHEN venue = 'generic_linear_usdt' THEN 0.10 WHEN abs(notional) <= 50000 THEN 0.008
            WHEN abs(notional) <= 250000 THEN 0.01 ELSE 0.02 END::DOUBLE AS initial_margin,
        abs(notional) * CASE WHEN venue = 'generic_linear_usdt' THEN 0.05 WHEN abs(notional) <= 50000 THEN 0.004
            WHEN abs(notional) <= 250000 THEN 0.005 ELSE 0.01 END::DOUBLE AS maintenance_margin FROM n)
    SELECT account_id, symbol, action_no, initial_margin, maintenance_margin, notional <> 0 AND equity <= maintenance_margin AS liquidated,
        CASE WHEN notional <> 0 AND equity <= maintenance_margin AND venue = 'binance_usdm_like' THEN abs(notional) * 0.01 ELSE 0 END AS liquidation_fee
    FROM m""", doubles="initial_margin maintenance_margin liquidation_fee")
def _margins(t: Tables):
    notional = F.col("quantity") * F.col("price") * 1000.0
    equity = 20.0 * (F.col("action_no") % 100)
    return perp.margins(_with_venue(t), notional, equity).select(
        "account_id", "symbol", "action_no", "initial_margin", "maintenance_margin", "liquidated", "liquidation_fee"
    )


@query("exit_reasons", "O-V4", """
    SELECT account_id, symbol, action_no, CASE WHEN quantity = 0 OR average_entry = 0 THEN ''
        WHEN quantity > 0 AND price <= average_entry * 0.9 THEN 'stop_loss' WHEN quantity > 0 AND price >= average_entry * 1.2 THEN 'take_profit'
        WHEN quantity < 0 AND price >= average_entry * 1.1 THEN 'stop_loss' WHEN quantity < 0 AND price <= average_entry * 0.8 THEN 'take_profit'
        ELSE '' END AS reason FROM (SELECT * REPLACE (round(average_entry, 6) AS average_entry) FROM entry_rows)""")
def _exits(t: Tables):
    return perp_ledger(t).select(
        "account_id", "symbol", "action_no",
        perp.exit_reason(F.col("price"), F.col("quantity"), F.round("average_entry", 6), 0.1, 0.2).alias("reason"),
    )


@query("order_sizing", "O-V5 O-V6", """
    WITH s AS (SELECT *, least(5, greatest(-5, coalesce(CASE WHEN action_no % 3 > 0 THEN amount / 4 - 1 END,
            least(1, greatest(-1, amount / 10)) * 5))) AS exposure, 50.0::DOUBLE * (action_no % 20) AS equity,
            CASE action_no % 3 WHEN 0 THEN 10 ELSE 125 END AS lev, CASE action_no % 3 WHEN 0 THEN 0 ELSE 0.001 END::DOUBLE AS step,
            CASE action_no % 3 WHEN 0 THEN 0 ELSE 5 END AS dust FROM actions),
        c AS (SELECT *, greatest(-least(equity * lev, 2000), least(least(equity * lev, 2000), exposure * equity)) AS notional FROM s),
        r AS (SELECT *, CASE WHEN step > 0 THEN sign(notional) * floor(abs(notional / price) / step) * step * price ELSE notional / price * price END AS cut FROM c)
    SELECT account_id, action_no, exposure, notional, CASE WHEN abs(cut) < dust THEN 0 ELSE cut END AS order_notional FROM r""",
       doubles="exposure notional order_notional")
def _sizing(t: Tables):
    venue = F.when(F.col("action_no") % 3 == 0, "generic_linear_usdt").otherwise("binance_usdm_like")
    rows = perp.with_venue(t.actions.withColumn("venue", venue), perp.venues(t.spark))
    explicit = F.when(F.col("action_no") % 3 > 0, F.col("amount") / 4.0 - 1.0)
    rows = rows.withColumn("exposure", perp.target_exposure(explicit, F.col("amount") / 10.0, 5.0))
    rows = rows.withColumn("equity", 50.0 * (F.col("action_no") % 20))
    rows = rows.withColumn(
        "notional", perp.notional_cap(F.col("exposure") * F.col("equity"), F.col("equity"), F.col("max_leverage"), order_max=F.lit(2000.0))
    )
    return rows.select(
        "account_id", "action_no", "exposure", "notional",
        perp.round_order(F.col("notional"), F.col("price"), F.col("quantity_step"), F.col("min_notional")).alias("order_notional"),
    )


define("curve_rows", """SELECT run_id, ts, price, target_long_fraction - 1 AS exposure,
        lag(price) OVER w AS p0, lag(target_long_fraction - 1) OVER w AS s0, row_number() OVER w AS i FROM history
    WINDOW w AS (PARTITION BY run_id ORDER BY ts)""")
define("curve", """/* RECURSIVE */ SELECT run_id, ts, i, 10000.0::DOUBLE AS equity FROM curve_rows WHERE i = 1
    UNION ALL SELECT r.run_id, r.ts, r.i, c.equity * (1 + r.s0 * (r.price / r.p0 - 1)) FROM curve c
    JOIN curve_rows r ON r.run_id = c.run_id AND r.i = c.i + 1""")


@query("exposure_curve", "O-V8", "SELECT run_id, ts, equity FROM curve", doubles="equity")
def _curve(t: Tables):
    rows = t.history.withColumn("exposure", F.col("target_long_fraction") - 1.0)
    return perp.exposure_curve(rows).select("run_id", "ts", "equity")


define("marks", "SELECT DISTINCT account_id, date_trunc('day', ts) + INTERVAL 23 HOURS AS ts FROM actions")
define("mark_prices", """SELECT CASE symbol WHEN 'click' THEN 'SOL' WHEN 'view' THEN 'ETH' WHEN 'signup' THEN 'XYZ' WHEN 'purchase' THEN 'USDC' ELSE symbol END AS symbol,
        ts, close AS price FROM bars""")


@query("mark_to_market", "O-L9", """
    WITH g AS (SELECT m.account_id, m.ts, s.side, s.symbol FROM marks m JOIN (SELECT DISTINCT account_id, side, symbol FROM bal) s USING (account_id)),
        h AS (SELECT g.*, b.balance FROM g ASOF JOIN (SELECT account_id, side, symbol, ts, balance FROM bal) b
            ON g.account_id = b.account_id AND g.side = b.side AND g.symbol = b.symbol AND g.ts >= b.ts),
        p AS (SELECT h.*, coalesce(h.balance * p.price, 0) AS v FROM h ASOF LEFT JOIN mark_prices p ON h.symbol = p.symbol AND h.ts >= p.ts),
        a AS (SELECT account_id, ts, sum(CASE side WHEN 'collateral' THEN v ELSE 0 END) AS collateral_value,
            sum(CASE side WHEN 'debt' THEN v ELSE 0 END) AS debt_value,
            sum(CASE side WHEN 'collateral' THEN v * CASE symbol WHEN 'SOL' THEN 0.75 WHEN 'USDC' THEN 0.9 WHEN 'ETH' THEN 0.8 ELSE 0 END::DOUBLE ELSE 0 END) AS borrow_limit,
            sum(CASE side WHEN 'debt' THEN v * coalesce(m_bf, 1) ELSE 0 END) AS risk_debt
            FROM p LEFT JOIN market USING (symbol) GROUP BY ALL)
    SELECT account_id, ts, collateral_value, debt_value, collateral_value - debt_value AS portfolio_value,
        CASE WHEN abs(risk_debt) < 1e-9 THEN 'Infinity'::DOUBLE ELSE borrow_limit / risk_debt END AS health_factor FROM a""",
       doubles="collateral_value debt_value portfolio_value health_factor")
def _mtm(t: Tables):
    marks = t.actions.select(
        "account_id", F.timestamp_add("HOUR", F.lit(23), F.date_trunc("day", "ts")).alias("ts")
    ).distinct()
    names = {"click": "SOL", "view": "ETH", "signup": "XYZ", "purchase": "USDC"}
    asset = F.coalesce(*[F.when(F.col("symbol") == k, v) for k, v in names.items()], "symbol")
    prices = t.bars.select(asset.alias("symbol"), "ts", F.col("close").alias("price"))
    return ledger.mark_to_market(
        ledger.signed_deltas(t.actions), marks, prices, liquidation.market_assets(t.spark)
    ).select("account_id", "ts", "collateral_value", "debt_value", "portfolio_value", "health_factor")


define("latch_rows", """SELECT *, max(portfolio_value) OVER (PARTITION BY run_id ORDER BY ts) AS peak,
        row_number() OVER (PARTITION BY run_id ORDER BY ts) AS i FROM history""")
define("latched", """/* RECURSIVE */ SELECT run_id, ts, i, portfolio_value <= peak * 0.97 AS active FROM latch_rows WHERE i = 1
    UNION ALL SELECT r.run_id, r.ts, r.i, CASE WHEN r.portfolio_value <= r.peak * 0.97 THEN TRUE
        WHEN r.portfolio_value >= r.peak * 0.99 THEN FALSE ELSE l.active END
    FROM latched l JOIN latch_rows r ON r.run_id = l.run_id AND r.i = l.i + 1""")


@query("hysteresis_latch", "O-L10", "SELECT run_id, ts, active FROM latched")
def _latch(t: Tables):
    from quaymark.operators.metrics import with_drawdown

    rows = with_drawdown(t.history)
    v, peak = F.col("portfolio_value"), F.col("peak")
    return ledger.latch(rows, ["run_id"], ["ts"], v <= peak * 0.97, v >= peak * 0.99).select("run_id", "ts", "active")


@query("equity_triggers", "O-L11", """
    WITH h AS (SELECT *, portfolio_value / price AS sol, long_green AS green, long_green <= 1 AS b1, long_green = 0 AS b3,
            long_green IN (0, 2) AS bw, row_number() OVER (PARTITION BY run_id ORDER BY ts) AS i FROM history),
    w AS (SELECT *, max(portfolio_value) OVER t AS peak, max(sol) OVER t AS sol_peak, max(price) OVER t AS price_peak,
            max(portfolio_value) OVER (r ROWS 71 PRECEDING) AS lock_peak, first_value(portfolio_value) OVER r AS v0,
            max(portfolio_value) OVER r AS hwm FROM h
        WINDOW r AS (PARTITION BY run_id ORDER BY ts), t AS (PARTITION BY run_id ORDER BY ts ROWS 119 PRECEDING)),
    d AS (SELECT *, (peak - portfolio_value) / peak AS pdd, (sol_peak - sol) / sol_peak AS sdd, (price_peak - price) / price_peak AS xdd,
            (lock_peak - portfolio_value) / lock_peak AS ldd FROM w)
    SELECT run_id, ts, pdd AS portfolio_drawdown, sdd AS sol_drawdown,
        (green <= 2 OR b1) AND lock_peak / v0 - 1 >= 0.005 AND ldd >= 0.01 AS lock_triggered,
        NOT (green <= 2 OR b1) AND portfolio_value >= lock_peak * 0.98 AS lock_recovered,
        pdd >= 0.03 AS contain_enter, green >= 4 AND NOT b1 AND portfolio_value >= peak * 0.99 AS contain_exit,
        CASE WHEN i < 120 THEN NULL WHEN (b3 OR bw) AND sdd >= 0.4 THEN 'sol_equivalent_drawdown'
            WHEN b1 AND xdd >= 0.3 AND b3 THEN 'sol_drawdown_with_bearish_trend'
            WHEN b1 AND xdd >= 0.3 AND pdd >= 0.02 THEN 'sol_drawdown_with_portfolio_damage' END AS crisis_reason,
        CASE WHEN hwm >= v0 * 1.01 THEN greatest(0, portfolio_value - hwm * 0.65) * 2 ELSE -1 END AS cppi_cap,
        CASE WHEN hwm >= v0 * 1.01 THEN hwm * 0.65 ELSE 0 END AS cppi_floor FROM d""",
       doubles="portfolio_drawdown sol_drawdown cppi_cap cppi_floor")
def _triggers(t: Tables):
    g = F.col("long_green")
    rows = t.history.select(
        "run_id", "ts", "portfolio_value", "price", g.alias("green"), (g <= 1).alias("bearish_1d"),
        (g == 0).alias("bearish_3d"), g.isin(0, 2).alias("bearish_1w"),
    )
    out = ledger.equity_triggers(
        rows, window=120, lock_lookback=72, lock_gain=0.005, lock_drawdown=0.01, containment=(0.03, 0.01),
        crisis=(0.3, 0.02, 0.4), crisis_ready=120, cppi=(1.01, 0.65, 2.0),
    )
    return out.select(
        "run_id", "ts", "portfolio_drawdown", "sol_drawdown", "lock_triggered", "lock_recovered", "contain_enter",
        "contain_exit", "crisis_reason", "cppi_cap", "cppi_floor",
    )
