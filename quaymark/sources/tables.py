"""Bindings of the generic test tables to this library's schemas.

The tables are not market data; each binding is a fixed rule, written here once
and used by every registered query.  Bindings that a whole-table window would
make serial (bars, run histories) are aggregates per hour, so what follows them
is bounded by the time span while the scan grows with the table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.functions.numeric import INF
from quaymark.operators.asof import align_symbols
from quaymark.operators.bars import bars_from_ticks
from quaymark.session import prepare

SYMBOLS = ("click", "error", "purchase", "signup", "view")
ASSETS = {"A": "SOL", "N": "USDC", "R": "ETH"}
EXCHANGES = 8


# Column types of the tables in use; stating them spares a schema job per read.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
}


class Tables:
    """Lazily opened tables of one directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = prepare(spark)
        self.root = root.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in SCHEMAS:
            reader = reader.schema(SCHEMAS[name])
        return reader.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def ticks(self) -> DataFrame:
        """(symbol, ts, price, size, seq); a price of zero is no quote."""
        return self.events.filter("value > 0").select(
            F.col("event_type").alias("symbol"),
            "ts",
            F.col("value").alias("price"),
            F.lit(1.0).alias("size"),
            F.col("event_id").alias("seq"),
        )

    @cached_property
    def bars(self) -> DataFrame:
        return bars_from_ticks(self.ticks, "1h")

    @cached_property
    def aligned(self) -> DataFrame:
        return align_symbols(self.bars, SYMBOLS)

    @cached_property
    def candles_raw(self) -> DataFrame:
        """Exchange candles with duplicates per (symbol, ms); `arrival` orders them."""
        return self.events.select(
            F.col("event_type").alias("symbol"),
            F.unix_millis(F.date_trunc("hour", "ts")).alias("ms"),
            F.col("value").alias("open"),
            (F.col("value") * 1.01).alias("high"),
            (F.col("value") * 0.99).alias("low"),
            F.col("value").alias("close"),
            F.col("user_id").cast("double").alias("volume"),
            F.col("event_id").alias("arrival"),
        )

    @cached_property
    def history(self) -> DataFrame:
        """One row per run and hour, all from the events of that hour."""
        k = F.get_json_object("props", "$.k").cast("double")
        hourly = self.events.groupBy(
            F.col("event_type").alias("run_id"), F.date_trunc("hour", "ts").alias("hour")
        ).agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("mean_v"),
            F.min("value").alias("min_v"),
            F.max("value").alias("max_v"),
            F.avg(k).alias("mean_k"),
        )
        path = W.partitionBy("run_id").orderBy("hour")
        n, mean = F.col("n"), F.col("mean_v")
        return hourly.select(
            "run_id",
            F.col("hour").alias("ts"),
            (10000.0 + 4.0 * F.sum(mean - 50.0).over(path)).alias("portfolio_value"),
            F.when(n % 7 == 0, F.lit(INF)).otherwise(0.8 + mean / 50.0).alias("health_factor"),
            n.alias("action_count"),
            (F.col("min_v") / 100.0).alias("interest_accrued"),
            (F.col("max_v") / 1000.0).alias("lst_yield"),
            F.when(F.col("max_v") > 200.0, F.col("max_v") / 10.0).otherwise(0.0).alias("liquidation_penalty"),
            (mean * 10.0).alias("cash_reserve"),
            ((n % 4) / 2.0).alias("target_long_fraction"),
            ((n % 3) * 0.05).alias("target_short_fraction"),
            (n % 5).alias("long_green"),
            F.element_at(F.array(F.lit("SOL"), F.lit("ETH"), F.lit("")), (n % 3 + 1).cast("int")).alias("selected_long"),
            (F.col("mean_k") + 50.0).alias("price"),
            (F.col("mean_k") / 20.0).alias("realized_vol_pct"),
        )

    @cached_property
    def history_positions(self) -> DataFrame:
        """Long position values of the run histories: 2 collateral legs, 2 debt legs."""
        pv, k = F.col("portfolio_value"), F.col("price")
        legs = F.array(
            F.struct(F.lit("collateral").alias("side"), F.lit("SOL").alias("symbol"),
                     (pv / k).alias("amount"), pv.alias("value")),
            F.struct(F.lit("collateral").alias("side"), F.lit("USDC").alias("symbol"),
                     (pv * 0.2).alias("amount"), (pv * 0.2).alias("value")),
            F.struct(F.lit("debt").alias("side"), F.lit("ETH").alias("symbol"),
                     (pv * F.col("target_short_fraction") / k).alias("amount"),
                     (pv * F.col("target_short_fraction")).alias("value")),
            F.struct(F.lit("debt").alias("side"), F.lit("USDC").alias("symbol"),
                     (pv * 0.1).alias("amount"), (pv * 0.1).alias("value")),
        )
        return self.history.select("run_id", "ts", F.inline(legs))

    @cached_property
    def positions(self) -> DataFrame:
        """Account positions; `pos_no` keeps a total order inside an account."""
        side = F.when(F.col("l_linestatus") == "O", "collateral").otherwise("debt")
        flag = F.col("l_returnflag")
        ltv = 0.6 + F.col("l_discount")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("account_id"),
            (
                F.col("l_linenumber").cast("bigint") * 1_000_000_000_000
                + F.col("l_partkey") * 1_000_000
                + F.col("l_suppkey")
            ).alias("pos_no"),
            side.alias("side"),
            F.when(flag == "A", "SOL").when(flag == "N", "USDC").otherwise("ETH").alias("symbol"),
            (F.col("l_quantity") * F.when(side == "debt", 0.5).otherwise(1.0)).alias("amount"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            ltv.alias("ltv"),
            (ltv + 0.05 + F.col("l_tax")).alias("liq_threshold"),
            (1.0 + F.col("l_tax")).alias("borrow_factor"),
        )

    @cached_property
    def actions(self) -> DataFrame:
        """Account actions; the verb follows the event id, the asset and price `k`."""
        k = F.get_json_object("props", "$.k").cast("bigint")
        verb = F.col("event_id") % 5
        return self.events.select(
            F.col("user_id").alias("account_id"),
            "ts",
            F.col("event_id").alias("action_no"),
            F.when(verb == 0, "deposit_collateral").when(verb == 1, "withdraw_collateral")
            .when(verb == 2, "borrow").when(verb == 3, "repay").otherwise("set_price").alias("type"),
            F.when(k % 8 < 3, "SOL").when(k % 8 < 5, "USDC").when(k % 8 < 7, "ETH").otherwise("XYZ").alias("symbol"),
            (F.col("value") / 10.0).alias("amount"),
            (k + 1).cast("double").alias("price"),
        )

    @cached_property
    def levels(self) -> DataFrame:
        """Order-book levels at whole-cent prices on a fixed number of exchanges."""
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("pair"),
            (F.col("l_suppkey") % EXCHANGES).alias("exchange"),
            F.when(F.col("l_linestatus") == "O", "bid").otherwise("ask").alias("side"),
            (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100.0) / 100.0).alias("price"),
            F.col("l_quantity").alias("vol"),
        )

    @cached_property
    def exchange_fees(self) -> DataFrame:
        """Maker and taker rates per exchange, from the suppliers mapped to it."""
        return self.raw("supplier").groupBy((F.col("s_suppkey") % EXCHANGES).alias("exchange")).agg(
            (F.count(F.lit(1)) % 3 * 0.001 + 0.001).alias("maker"),
            (F.count(F.lit(1)) % 3 * 0.001 + 0.002).alias("taker"),
        )
