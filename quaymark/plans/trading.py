"""Queries: order-book arbitrage and decoded protocol tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.operators import onchain, orderbook, universe
from quaymark.plans.ctes import define
from quaymark.plans.registry import query
from quaymark.sources import files
from quaymark.sources.tables import Tables

define("tops", """SELECT pair, exchange, bid, ask, bid * (1 - taker) AS net_bid, ask * (1 + maker) AS net_ask FROM (
        SELECT pair, exchange, max(price) FILTER (side = 'bid') AS bid, min(price) FILTER (side = 'ask') AS ask FROM levels GROUP BY ALL)
    JOIN exchange_fees USING (exchange)""")
define("opps", """SELECT b.pair, b.exchange AS bid_ex, a.exchange AS ask_ex, b.net_bid, a.net_ask, b.net_bid / a.net_ask - 1 AS edge
    FROM tops b JOIN tops a ON a.pair = b.pair AND b.net_bid > a.net_ask""")
define("book", """SELECT l.*, CASE side WHEN 'ask' THEN price * (1 + maker) ELSE price * (1 - taker) END AS price_inc_fee
    FROM levels l JOIN exchange_fees USING (exchange)""")


def balances(t: Tables) -> DataFrame:
    """Account balances per exchange; one exchange in four has no limit."""
    x = F.col("exchange")
    limited = x % 4 != 3
    return t.exchange_fees.select(
        "exchange", F.when(limited, x * 3.0 + 5.0).alias("base_balance"), F.when(limited, x * 10.0 + 20.0).alias("quote_balance")
    )


@query("fee_adjusted_quotes", "O-X1", "SELECT * FROM tops", doubles="bid ask net_bid net_ask", digits=6)
def _quotes(t: Tables):
    return orderbook.quotes(t.levels, t.exchange_fees)


@query("opportunity_matrix", "O-X2 O-J9", "SELECT pair, bid_ex, ask_ex, edge FROM opps", doubles="edge", digits=6)
def _matrix(t: Tables):
    return orderbook.opportunities(orderbook.quotes(t.levels, t.exchange_fees)).select("pair", "bid_ex", "ask_ex", "edge")


@query("book_with_fees", "O-X3 D16", "SELECT pair, exchange, side, price, vol, price_inc_fee FROM book",
       doubles="price vol price_inc_fee", digits=6)
def _book(t: Tables):
    return orderbook.with_fees(t.levels, t.exchange_fees).select("pair", "exchange", "side", "price", "vol", "price_inc_fee")


# The walk replayed level by level inside each opportunity.
define("hits", """SELECT o.pair, o.bid_ex, o.ask_ex, b.side, b.price_inc_fee, b.vol,
        coalesce(sum(b.vol) OVER (PARTITION BY o.pair, o.bid_ex, o.ask_ex, b.side
            ORDER BY CASE b.side WHEN 'ask' THEN b.price ELSE -b.price END, b.vol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
    FROM opps o JOIN book b ON b.pair = o.pair AND (b.side = 'bid' AND b.exchange = o.bid_ex AND b.price >= o.net_ask
        OR b.side = 'ask' AND b.exchange = o.ask_ex AND b.price <= o.net_bid)""")
define("depths", """SELECT h.*, least(maximum_bid_depth, maximum_ask_depth,
        CASE WHEN bid_ex % 4 <> 3 THEN bid_ex * 10 + 20 ELSE 'Infinity'::DOUBLE END, coalesce(opposing_value, 'Infinity'::DOUBLE)) AS amount FROM (
        SELECT pair, bid_ex, ask_ex, sum(vol) FILTER (side = 'bid') AS maximum_bid_depth, sum(vol) FILTER (side = 'ask') AS maximum_ask_depth,
            CASE WHEN ask_ex % 4 <> 3 THEN sum(price_inc_fee * least(vol, greatest(0, ask_ex * 3 + 5 - used))) FILTER (side = 'ask') END AS opposing_value
        FROM hits GROUP BY pair, bid_ex, ask_ex) h""")


@query("executable_arbitrage", "O-X4 O-X5 O-X6", """
    WITH w AS (SELECT pair, bid_ex, ask_ex, sum(price_inc_fee * least(vol, greatest(0, amount - used))) FILTER (side = 'bid') / any_value(amount) AS avg_bid,
            sum(price_inc_fee * least(vol, greatest(0, amount - used))) FILTER (side = 'ask') / any_value(amount) AS avg_ask
        FROM hits JOIN depths USING (pair, bid_ex, ask_ex) GROUP BY ALL)
    SELECT pair, bid_ex, ask_ex, maximum_bid_depth, maximum_ask_depth, amount AS executable_amount, avg_bid, avg_ask,
        (avg_bid - avg_ask) * amount AS nominal_return, ln(avg_bid / avg_ask) AS pct_return FROM depths JOIN w USING (pair, bid_ex, ask_ex)""",
       doubles="maximum_bid_depth maximum_ask_depth executable_amount avg_bid avg_ask nominal_return pct_return")
def _executable(t: Tables):
    return orderbook.executable(t.levels, t.exchange_fees, balances(t)).select(
        "pair", "bid_ex", "ask_ex", "maximum_bid_depth", "maximum_ask_depth", "executable_amount", "avg_bid", "avg_ask",
        "nominal_return", "pct_return",
    )


@query("opposing_leg_value", "O-X7", """
    SELECT pair, exchange, CASE WHEN exchange % 4 = 3 THEN 'Infinity'::DOUBLE
        ELSE sum(price_inc_fee * least(vol, greatest(0, exchange * 3 + 5 - used))) END AS opposing_value
    FROM (SELECT *, coalesce(sum(vol) OVER (PARTITION BY pair, exchange ORDER BY price, vol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
          FROM book WHERE side = 'ask') GROUP BY pair, exchange""", doubles="opposing_value")
def _opposing(t: Tables):
    return orderbook.opposing_leg(t.levels, t.exchange_fees, balances(t))


def decoded_reserves(t: Tables) -> DataFrame:
    """Reserve facts bound to parts: one reserve per part."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    sf = lambda c: (c.cast("decimal(18,0)") * F.lit(2**60).cast("decimal(19,0)")).cast("decimal(38,0)")
    return t.raw("part").select(
        k.alias("reserve"),
        F.when(k % 50 == 0, "So11111111111111111111111111111111111111112")
        .when(k % 50 == 1, "EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v")
        .otherwise(F.concat(F.lit("Mint"), F.lpad(k.cast("string"), 12, "0"))).alias("mint"),
        (size * 1000).alias("available"), sf(size * 500).alias("borrowed_sf"), sf(size).alias("protocol_fees_sf"),
        sf(size % 3).alias("referrer_fees_sf"), sf(size % 2).alias("pending_fees_sf"),
        F.when(k % 17 == 0, 0).otherwise(size * 700).cast("bigint").alias("mint_supply"),
        sf(F.when(k % 11 == 0, 0).otherwise(F.floor("p_retailprice"))).alias("market_price_sf"),
        (50 + size % 40).alias("ltv_pct"), (55 + size % 40).alias("liq_threshold_pct"),
        F.when(k % 4 == 0, 100 + size).alias("borrow_factor_pct"), F.when(k % 4 == 1, 120 + size).alias("debt_weight_pct"),
        F.when(k % 4 == 2, 10000 + size * 10).alias("added_borrow_weight_bps"), (k % 4 + 6).alias("decimals"),
    )


def token_list(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.raw("part").filter(k % 3 == 0).select(
        F.concat(F.lit("Mint"), F.lpad(k.cast("string"), 12, "0")).alias("mint"),
        F.concat(F.lit("T"), k.cast("string")).alias("listed_symbol"),
    )


define("reserve_rows", """SELECT p_partkey AS reserve, CASE WHEN p_partkey % 50 = 0 THEN 'SOL' WHEN p_partkey % 50 = 1 THEN 'USDC'
        WHEN p_partkey % 3 = 0 THEN 'T' || p_partkey ELSE 'Mint' || lpad(CAST(p_partkey AS VARCHAR), 12, '0')[1:4] END AS symbol,
        CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE floor(p_retailprice) END::DOUBLE AS price, (50 + p_size % 40) / 100.0::DOUBLE AS ltv,
        (55 + p_size % 40) / 100.0::DOUBLE AS liq_threshold, CASE p_partkey % 4 WHEN 0 THEN (100 + p_size) / 100.0::DOUBLE
            WHEN 1 THEN (120 + p_size) / 100.0::DOUBLE WHEN 2 THEN (10000 + p_size * 10) / 10000.0::DOUBLE ELSE 1 END AS borrow_factor,
        p_partkey % 4 + 6 AS decimals, CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE
            (p_size * 1000 + p_size * 500 - p_size - p_size % 3 - p_size % 2) / (p_size * 700.0::DOUBLE) END AS exchange_rate FROM part""")


@query("reserve_table", "O-C1 O-C2 O-C3 O-J10 D17", "SELECT * FROM reserve_rows",
       doubles="price ltv liq_threshold borrow_factor exchange_rate", ints="decimals", digits=6)
def _reserves(t: Tables):
    return onchain.reserves(decoded_reserves(t), token_list(t))


@query("active_reserves", "O-C5", "SELECT reserve, symbol, price FROM reserve_rows WHERE price > 0", doubles="price")
def _active(t: Tables):
    return onchain.active_reserves(onchain.reserves(decoded_reserves(t), token_list(t))).select("reserve", "symbol", "price")


@query("obligation_positions", "O-C4", """
    SELECT account_id, pos_no, side, r.symbol, CASE side WHEN 'collateral' THEN raw * exchange_rate ELSE raw END / pow(10, decimals) AS amount, r.price
    FROM (SELECT l_orderkey AS account_id, l_linenumber AS pos_no, CASE l_linestatus WHEN 'O' THEN 'collateral' ELSE 'debt' END AS side,
            l_partkey AS reserve, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 1000000 END AS raw FROM lineitem)
    JOIN reserve_rows r USING (reserve) WHERE raw > 0""", doubles="amount price", ints="pos_no", digits=6)
def _obligations(t: Tables):
    coll = F.col("l_linestatus") == "O"
    units = F.when(F.col("l_linenumber") % 5 == 0, 0).otherwise(F.col("l_quantity").cast("bigint") * 1_000_000).cast("decimal(18,0)")
    slots = t.raw("lineitem").select(
        F.col("l_orderkey").alias("obligation"), F.col("l_linenumber").alias("pos_no"),
        F.when(coll, "collateral").otherwise("debt").alias("side"), F.col("l_partkey").alias("reserve"),
        F.when(coll, units.cast("decimal(38,0)"))
        .otherwise((units * F.lit(2**60).cast("decimal(19,0)")).cast("decimal(38,0)")).alias("raw"),
    )
    table = onchain.reserves(decoded_reserves(t), token_list(t))
    return onchain.slot_positions(slots, table).select("account_id", "pos_no", "side", "symbol", "amount", "price")


def _universe(t: Tables) -> DataFrame:
    """Asset universe bound to parts: kinds, flags and references follow the key."""
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "exchange").when(k % 3 == 1, "pegged").otherwise("derived")
    name = F.concat(F.lit("P"), k.cast("string"))
    return t.raw("part").select(
        k.alias("ordinal"), F.when(k % 40 == 0, F.lit("X")).otherwise(name).alias("key"), name.alias("symbol"), kind.alias("price_kind"),
        (F.col("p_size") > 5).alias("can_be_collateral"), (F.col("p_size") < 45).alias("can_be_borrowed"),
        (k % 2 == 0).alias("include_in_long_short_research"), F.when(k % 6 == 0, F.col("p_name")).alias("exchange_symbol"),
        F.when(k % 9 == 1, "USD").alias("peg_target"), F.when(k % 4 == 0, F.col("p_brand")).alias("derived_from"),
    )


define("universe", """SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 40 = 0 THEN 'X' ELSE 'P' || p_partkey END AS key, 'P' || p_partkey AS symbol,
        CASE p_partkey % 3 WHEN 0 THEN 'exchange' WHEN 1 THEN 'pegged' ELSE 'derived' END AS kind, p_size > 5 AS coll, p_size < 45 AS borrow,
        p_partkey % 2 = 0 AS research, CASE WHEN p_partkey % 6 = 0 THEN p_name END AS exchange_symbol,
        CASE WHEN p_partkey % 9 = 1 THEN 'USD' END AS peg, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS derived FROM part""")


@query("research_universe", "O-P3 D3 D4", """
    SELECT r.ordinal, r.symbol, r.kind = 'exchange' AS needs_candles, CASE WHEN r.kind = 'exchange' THEN coalesce(r.exchange_symbol, '') END AS exchange_symbol
    FROM universe r WHERE research""")
def _research(t: Tables):
    table = _universe(t)
    priced = universe.exchange_priced(table).select("ordinal", "exchange_symbol")
    return universe.research_symbols(table).join(priced, "ordinal", "left").select(
        "ordinal", "symbol", F.col("exchange_symbol").isNotNull().alias("needs_candles"), "exchange_symbol"
    )


@query("universe_violations", "O-P4 D5", """
    WITH m AS (SELECT u.*, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = u.ordinal) AS listed FROM universe u)
    SELECT symbol, 'symbol mismatch' AS rule FROM m WHERE key <> symbol
    UNION ALL SELECT symbol, 'not in market' FROM m WHERE NOT listed
    UNION ALL SELECT symbol, 'missing exchange_symbol' FROM m WHERE kind = 'exchange' AND exchange_symbol IS NULL
    UNION ALL SELECT symbol, 'missing peg_target' FROM m WHERE kind = 'pegged' AND peg IS NULL
    UNION ALL SELECT symbol, 'missing derived_from' FROM m WHERE kind = 'derived' AND derived IS NULL
    UNION ALL SELECT symbol, 'not tradable both ways' FROM m WHERE research AND NOT (coll AND borrow)""")
def _violations(t: Tables):
    market = t.raw("lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"))
    return universe.violations(_universe(t), market)


def account_json(t: Tables) -> DataFrame:
    """One JSON document per account, positions in order."""
    coll = F.col("side") == "collateral"
    item = F.struct("pos_no", "symbol", "amount", "price", F.when(coll, F.col("ltv")).alias("ltv"), F.when(coll, F.col("liq_threshold")).alias("liquidation_threshold"))
    of = lambda test, name: F.sort_array(F.collect_list(F.when(test, item))).alias(name)
    docs = t.positions.groupBy("account_id").agg(of(coll, "collateral"), of(~coll, "debt"))
    return docs.select(F.to_json(F.struct(F.col("account_id").cast("string").alias("account_id"), "collateral", "debt")).alias("json"))


@query("json_accounts", "O-S3 D9", """
    SELECT account_id::VARCHAR AS account_id, side, row_number() OVER (PARTITION BY account_id, side ORDER BY pos_no, symbol, amount, price) - 1 AS pos_no,
        symbol, amount, price, CASE side WHEN 'collateral' THEN ltv END AS ltv, CASE side WHEN 'collateral' THEN liq_threshold END AS liq_threshold,
        1.0::DOUBLE AS borrow_factor FROM positions""", doubles="amount price ltv liq_threshold borrow_factor")
def _json_accounts(t: Tables):
    positions, _ = files.parsed_accounts(account_json(t), "json")
    return positions.select(
        "account_id", "side", F.col("pos_no").cast("bigint").alias("pos_no"), "symbol", "amount", "price", "ltv", "liq_threshold", "borrow_factor"
    )


@query("json_actions", "O-S3", """
    SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CASE WHEN CAST(props->>'$.k' AS BIGINT) % 2 = 0 THEN 'borrow' ELSE 'repay' END AS type FROM events""")
def _json(t: Tables):
    parsed = F.from_json("props", "struct<k:bigint>")
    return t.events.select("event_id", parsed["k"].alias("k")).withColumn(
        "type", F.when(F.col("k") % 2 == 0, "borrow").otherwise("repay")
    )
