"""Liquidation passes and waves over every unhealthy account at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.functions.numeric import INF, ratio
from quaymark.operators.risk import account_report

# Lending parameters per asset
# (symbol, ltv, liquidation threshold, bonus bps min, bonus bps max, borrow apy, take rate, borrow factor, LST, LST apy)
MARKET_ASSETS = (
    ("SOL", 0.75, 0.80, 200, 1000, 0.0, 0.15, 1.0, False, 0.0),
    ("JitoSOL", 0.60, 0.65, 200, 1000, 0.0, 0.15, 1.0, True, 0.07),
    ("mSOL", 0.60, 0.65, 200, 1000, 0.0, 0.15, 1.0, True, 0.07),
    ("USDC", 0.90, 0.93, 200, 500, 0.08, 0.15, 1.053, False, 0.0),
    ("USDT", 0.90, 0.93, 200, 500, 0.08, 0.15, 1.053, False, 0.0),
    ("ETH", 0.80, 0.83, 200, 1000, 0.0, 0.15, 1.0, False, 0.0),
    ("BTC", 0.75, 0.80, 200, 1000, 0.0, 0.15, 1.0, False, 0.0),
)
MARKET_SCHEMA = (
    "symbol string, m_ltv double, m_threshold double, min_bonus_bps int, max_bonus_bps int, "
    "borrow_apy double, take_rate double, m_borrow_factor double, is_lst boolean, lst_apy double"
)
CLOSE_FACTOR = 0.20
#: Parts of an account's side that are ranked apart.
SHARES = 16
UNKNOWN = {"m_threshold": 0.80, "min_bonus_bps": 200, "max_bonus_bps": 1000}


def market_assets(spark) -> DataFrame:
    """The default lending parameters as a small dimension."""
    return spark.createDataFrame(list(MARKET_ASSETS), MARKET_SCHEMA)


def with_market(rows: DataFrame, market: DataFrame) -> DataFrame:
    """Attach asset parameters; assets the market does not know stay null."""
    return rows.join(market, "symbol", "left")


def bonus_rate(ltv: Column, threshold: Column, low: Column, high: Column) -> Column:
    """Liquidation bonus, linear from the threshold to an LTV of one."""
    span = 1.0 - threshold
    t = F.least(ratio(ltv - threshold, span, 1.0), F.lit(1.0))
    bps = F.when(ltv <= threshold, low).when(span <= 0, high).otherwise(low + t * (high - low))
    return bps / 10000.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value inside a column expression, so that it is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _queues(rows: DataFrame, waves: int) -> DataFrame:
    """The first positions of each account and side in liquidation order.

    Debts go by highest borrow factor, collateral by lowest threshold.  A pass
    takes the first position with a positive amount and a wave can empty at most
    one, so `waves` positions per side are all that can ever be touched: an exact
    bound, not a cut.  They are ranked after the shuffle, where tasks are of a set number, not in the
    scan, whose tasks hold as many rows as a file split does; first within shares of a side, so that
    an account of any size is ranked by several tasks.
    """
    debt = F.col("side") == "debt"
    priority = F.when(debt, -F.coalesce("m_borrow_factor", F.lit(0.0))).otherwise(F.coalesce("m_threshold", F.lit(1.0)))
    live = rows.filter(F.col("amount") > 0).withColumn("__priority", priority)
    side = ["account_id", "side"]
    first = lambda df, keys: df.withColumn(
        "__r", F.row_number().over(W.partitionBy(*keys).orderBy("__priority", "pos_no"))
    ).filter(F.col("__r") <= waves)
    share = [*side, "__share"]
    dealt = live.withColumn("__share", F.pmod(F.hash("pos_no"), F.lit(SHARES))).repartition(*share)
    ranked = first(first(dealt, share).drop("__r", "__share").repartition("account_id"), side)
    item = F.struct(
        "__r", "symbol", "amount", "price", "ltv", "liq_threshold", "borrow_factor",
        F.coalesce("m_threshold", F.lit(UNKNOWN["m_threshold"])).alias("threshold"),
        F.coalesce("min_bonus_bps", F.lit(UNKNOWN["min_bonus_bps"])).cast("double").alias("low"),
        F.coalesce("max_bonus_bps", F.lit(UNKNOWN["max_bonus_bps"])).cast("double").alias("high"),
    )
    of = lambda test: F.sort_array(F.collect_list(F.when(test, item)))
    queues = ranked.groupBy("account_id").agg(of(debt).alias("__debt"), of(~debt).alias("__collateral"))
    return queues.filter((F.size("__debt") > 0) & (F.size("__collateral") > 0))


_EVENT = (
    "array<struct<wave:int,debt_symbol:string,debt_repaid:double,debt_repaid_usd:double,"
    "collateral_symbol:string,collateral_seized:double,collateral_seized_usd:double,"
    "bonus_pct:double,resulting_hf:double>>"
)


def liquidation_waves(positions: DataFrame, market: DataFrame, waves: int = 5,
                      close_factor: float = CLOSE_FACTOR) -> DataFrame:
    """Repeat partial liquidations until the account is healthy or empty.

    Each account becomes one row (totals and two short queues) and the waves run
    as a fold over that row: one shuffle for all waves, no lineage to cut.
    Returns one row per event.
    """
    unhealthy = account_report(positions).filter(F.col("liquidation_health_factor") < 1)
    rows = unhealthy.select(
        "account_id", "collateral_value", "debt_value", "borrow_limit", "liquidation_value", "risk_debt"
    ).join(_queues(with_market(positions, market), waves), "account_id")
    start = F.struct(
        F.col("collateral_value").alias("coll"), F.col("debt_value").alias("debt"),
        F.col("borrow_limit").alias("limit"), F.col("liquidation_value").alias("liq"),
        F.col("risk_debt").alias("risk"), F.col("__debt").alias("debts"), F.col("__collateral").alias("colls"),
        F.array().cast(_EVENT).alias("events"),
    )

    def spend(queue: Column, head: Column, tokens: Column) -> Column:
        return F.transform(
            queue,
            lambda p: F.when(
                p["__r"] == head["__r"], p.withField("amount", p["amount"] - tokens)
            ).otherwise(p),
        )

    def wave(state: Column, number: Column) -> Column:
        live = lambda q: F.filter(q, lambda p: p["amount"] > 0)
        stop = (
            (ratio(state["liq"], state["risk"], INF) >= 1)
            | (state["coll"] <= 0)
            | (F.size(live(state["colls"])) == 0)
            | (F.size(live(state["debts"])) == 0)
        )

        def step(pick: Column) -> Column:
            d, c = pick["d"], pick["c"]
            wanted = ratio(state["debt"] * close_factor, d["price"], 0.0)
            repaid = F.least(wanted, d["amount"])
            rate = bonus_rate(ratio(state["debt"], state["coll"], INF), c["threshold"], c["low"], c["high"])
            seized = lambda usd: F.least(ratio(usd, c["price"], 0.0), c["amount"])
            sized = _let(
                F.struct(repaid.alias("tokens"), (repaid * d["price"]).alias("usd"), rate.alias("rate")),
                lambda r: F.struct(r.alias("r"), seized(r["usd"] * (1.0 + r["rate"])).alias("out")),
            )

            def book(s: Column) -> Column:
                r, out = s["r"], s["out"]
                out_usd = out * c["price"]
                limit = state["limit"] - out_usd * c["ltv"]
                risk = state["risk"] - r["usd"] * d["borrow_factor"]
                event = F.struct(
                    number.cast("int").alias("wave"), d["symbol"].alias("debt_symbol"),
                    r["tokens"].alias("debt_repaid"), r["usd"].alias("debt_repaid_usd"),
                    c["symbol"].alias("collateral_symbol"), out.alias("collateral_seized"),
                    out_usd.alias("collateral_seized_usd"), r["rate"].alias("bonus_pct"),
                    ratio(limit, risk, INF).alias("resulting_hf"),
                )
                return F.struct(
                    (state["coll"] - out_usd).alias("coll"), (state["debt"] - r["usd"]).alias("debt"),
                    limit.alias("limit"), (state["liq"] - out_usd * c["liq_threshold"]).alias("liq"),
                    risk.alias("risk"), spend(state["debts"], d, r["tokens"]).alias("debts"),
                    spend(state["colls"], c, out).alias("colls"),
                    F.concat(state["events"], F.array(event)).alias("events"),
                )

            return _let(sized, book)

        heads = F.struct(
            F.get(live(state["debts"]), F.lit(0)).alias("d"), F.get(live(state["colls"]), F.lit(0)).alias("c")
        )
        return F.when(stop, state).otherwise(_let(heads, step))

    numbers = F.array(*[F.lit(i) for i in range(1, waves + 1)])
    return rows.select("account_id", F.aggregate(numbers, start, wave)["events"].alias("__e")).select(
        "account_id", F.inline("__e")
    )


def liquidation_pass(positions: DataFrame, market: DataFrame, close_factor: float = CLOSE_FACTOR) -> DataFrame:
    """A single partial liquidation of every unhealthy account."""
    return liquidation_waves(positions, market, 1, close_factor).drop("wave")
