"""Shared SQL of the table bindings, written independently of the Spark code."""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "ticks": """SELECT event_type AS symbol, ts, value AS price, CAST(1 AS DOUBLE) AS size, event_id AS seq
        FROM events WHERE value > 0""",
    "bars": """SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high,
            min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(size) AS volume
        FROM ticks GROUP BY ALL""",
    "aligned": """SELECT * FROM (
            SELECT g.symbol, g.ts,
                last_value(b.open IGNORE NULLS) OVER w AS open, last_value(b.high IGNORE NULLS) OVER w AS high,
                last_value(b.low IGNORE NULLS) OVER w AS low, last_value(b.close IGNORE NULLS) OVER w AS close,
                last_value(b.volume IGNORE NULLS) OVER w AS volume
            FROM (SELECT s.symbol, t.ts FROM (SELECT DISTINCT ts FROM bars) t, (SELECT DISTINCT symbol FROM bars) s) g
            LEFT JOIN bars b ON b.symbol = g.symbol AND b.ts = g.ts
            WINDOW w AS (PARTITION BY g.symbol ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        QUALIFY count(close) OVER (PARTITION BY ts) = count(*) OVER (PARTITION BY ts)""",
    "frames": """SELECT * FROM (VALUES ('1h'), ('4h'), ('8h'), ('1d'), ('3d'), ('1w')) f(tf)""",
    "slotted": """SELECT a.*, f.tf,
            CASE f.tf WHEN '1h' THEN a.ts
                WHEN '4h' THEN date_trunc('day', a.ts) + to_hours(CAST(hour(a.ts) // 4 * 4 AS BIGINT))
                WHEN '8h' THEN date_trunc('day', a.ts) + to_hours(CAST(hour(a.ts) // 8 * 8 AS BIGINT))
                WHEN '1d' THEN date_trunc('day', a.ts)
                WHEN '3d' THEN time_bucket(INTERVAL 3 DAYS, a.ts, (SELECT date_trunc('day', min(ts)) FROM aligned))
                WHEN '1w' THEN date_trunc('week', a.ts) + INTERVAL 6 DAYS END AS label
        FROM aligned a, frames f""",
    "candles": """SELECT symbol, tf, label, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
            arg_max(close, ts) AS close, sum(volume) AS volume
        FROM slotted GROUP BY ALL""",
    "candle_rows": """SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol, tf) AS n,
            lag(close) OVER w AS pc, lead(label) OVER w AS next_label
        FROM candles WINDOW w AS (PARTITION BY symbol, tf ORDER BY label)""",
    "history": """SELECT run_id, hour AS ts,
            10000.0::DOUBLE + 4 * sum(mean_v - 50) OVER (PARTITION BY run_id ORDER BY hour
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS portfolio_value,
            CASE WHEN n % 7 = 0 THEN 'Infinity'::DOUBLE ELSE 0.8 + mean_v / 50 END AS health_factor,
            n AS action_count, min_v / 100 AS interest_accrued, max_v / 1000 AS lst_yield,
            CASE WHEN max_v > 200 THEN max_v / 10 ELSE 0 END AS liquidation_penalty,
            mean_v * 10 AS cash_reserve, (n % 4) / 2.0::DOUBLE AS target_long_fraction,
            (n % 3) * 0.05::DOUBLE AS target_short_fraction, n % 5 AS long_green,
            CASE n % 3 WHEN 0 THEN 'SOL' WHEN 1 THEN 'ETH' ELSE '' END AS selected_long,
            mean_k + 50 AS price, mean_k / 20 AS realized_vol_pct
        FROM (SELECT event_type AS run_id, date_trunc('hour', ts) AS hour, count(*) AS n, avg(value) AS mean_v,
                min(value) AS min_v, max(value) AS max_v, avg(CAST(props->>'$.k' AS DOUBLE)) AS mean_k
              FROM events GROUP BY ALL)""",
    "history_positions": """SELECT run_id, ts, 'collateral' AS side, 'SOL' AS symbol, portfolio_value / price AS amount,
            portfolio_value AS value FROM history
        UNION ALL SELECT run_id, ts, 'collateral', 'USDC', portfolio_value * 0.2::DOUBLE, portfolio_value * 0.2::DOUBLE FROM history
        UNION ALL SELECT run_id, ts, 'debt', 'ETH', portfolio_value * target_short_fraction / price,
            portfolio_value * target_short_fraction FROM history
        UNION ALL SELECT run_id, ts, 'debt', 'USDC', portfolio_value * 0.1::DOUBLE, portfolio_value * 0.1::DOUBLE FROM history""",
    "positions": """SELECT l_orderkey AS account_id,
            CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS pos_no,
            CASE l_linestatus WHEN 'O' THEN 'collateral' ELSE 'debt' END AS side,
            CASE l_returnflag WHEN 'A' THEN 'SOL' WHEN 'N' THEN 'USDC' ELSE 'ETH' END AS symbol,
            l_quantity * CASE l_linestatus WHEN 'O' THEN 1.0 ELSE 0.5 END::DOUBLE AS amount,
            l_extendedprice / l_quantity AS price, 0.6::DOUBLE + l_discount AS ltv,
            0.6::DOUBLE + l_discount + 0.05::DOUBLE + l_tax AS liq_threshold, 1.0::DOUBLE + l_tax AS borrow_factor
        FROM lineitem""",
    "accounts": """SELECT account_id,
            sum(CASE side WHEN 'collateral' THEN amount * price ELSE 0 END) AS collateral_value,
            sum(CASE side WHEN 'debt' THEN amount * price ELSE 0 END) AS debt_value,
            sum(CASE side WHEN 'collateral' THEN amount * price * ltv ELSE 0 END) AS borrow_limit,
            sum(CASE side WHEN 'collateral' THEN amount * price * liq_threshold ELSE 0 END) AS liquidation_value,
            sum(CASE side WHEN 'debt' THEN amount * price * borrow_factor ELSE 0 END) AS risk_debt
        FROM positions GROUP BY 1""",
    "actions": """SELECT user_id AS account_id, ts, event_id AS action_no,
            CASE event_id % 5 WHEN 0 THEN 'deposit_collateral' WHEN 1 THEN 'withdraw_collateral'
                WHEN 2 THEN 'borrow' WHEN 3 THEN 'repay' ELSE 'set_price' END AS type,
            CASE WHEN k % 8 < 3 THEN 'SOL' WHEN k % 8 < 5 THEN 'USDC' WHEN k % 8 < 7 THEN 'ETH' ELSE 'XYZ' END AS symbol,
            value / 10 AS amount, CAST(k + 1 AS DOUBLE) AS price
        FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events)""",
    "levels": """SELECT l_partkey AS pair, l_suppkey % 8 AS exchange,
            CASE l_linestatus WHEN 'O' THEN 'bid' ELSE 'ask' END AS side,
            floor(l_extendedprice / l_quantity * 100) / 100 AS price, l_quantity AS vol
        FROM lineitem""",
    "exchange_fees": """SELECT s_suppkey % 8 AS exchange, count(*) % 3 * 0.001::DOUBLE + 0.001::DOUBLE AS maker,
            count(*) % 3 * 0.001::DOUBLE + 0.002::DOUBLE AS taker FROM supplier GROUP BY 1""",
}


def define(name: str, sql: str) -> None:
    """Add a CTE that several queries of one module share."""
    CTES[name] = sql


def _mentions(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_]\w*", sql))
    return [n for n in CTES if n in words]


def compose(sql: str) -> str:
    """Put the CTEs a text mentions (and theirs) in front of it."""
    ordered: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for n in _mentions(text):
            if n != own and n not in ordered:
                visit(CTES[n], n)
                ordered.append(n)

    visit(sql)
    if not ordered:
        return sql
    heads = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" if "RECURSIVE" not in CTES[n] else f"{n} AS ({CTES[n]})" for n in ordered)
    return f"WITH RECURSIVE {heads}\n{sql.strip()}" if not sql.lstrip().upper().startswith("WITH") else (
        f"WITH RECURSIVE {heads},\n{re.sub(r'^WITH (RECURSIVE )?', '', sql.strip(), flags=re.I)}"
    )
