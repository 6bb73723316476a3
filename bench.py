"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default sf0.1) and BENCH_CPUS (default all) choose data and cores.
Each query runs once to warm up and then three times; the median counts.  Every
row and column of the result is produced and written to a sink that drops it.
"""

from __future__ import annotations

import json
import os
import pathlib
import statistics
import time

from pyspark.sql import functions as F

from quaymark.operators import sweep
from quaymark.plans import QUERIES
from quaymark.plans.studies import price_like
from quaymark.session import local_session
from quaymark.sources.tables import Tables

HEADLINE = (
    "tick_bars_1h", "candles_multi", "supertrend_states", "strongest_weakest", "trend_signal", "mark_price_asof",
    "performance_metrics", "drawdown_episodes", "regime_table", "account_risk", "liquidation_prices", "stress_grid",
    "recovery_options", "liquidation_waves", "long_rebalance_plan", "balance_replay", "short_ledger", "perp_entries",
    "signal_sweep", "timeline_events", "opportunity_matrix", "executable_arbitrage", "obligation_positions",
)


def sweep_of_50(spark, root: str):
    """50 Supertrend settings over every symbol: the size comparison of the baseline."""
    specs = sweep.trend_specs((5, 7, 10, 14, 21), [1.0 + 0.5 * i for i in range(10)])
    return sweep.signal_sweep(price_like(Tables(spark, root)), specs, ["4h", "1d"])


def long_bars(spark, root: str):
    """Three years of hourly bars of two symbols, as line items give them."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    slot = F.col("l_orderkey") % 26_305
    bars = spark.read.parquet(f"{root}/lineitem.parquet").groupBy(F.col("l_linestatus").alias("symbol"), slot.alias("slot")).agg(
        F.min(price).alias("low"), F.max(price).alias("high"), F.avg(price).alias("close"), F.sum("l_quantity").alias("volume")
    )
    ts = F.timestamp_seconds(F.lit(1_685_232_000) + F.col("slot") * 3600)
    return bars.select("symbol", ts.alias("ts"), F.col("close").alias("open"), "high", "low", "close", "volume")


def sweep_of_50_long(spark, root: str):
    """50 settings over 26,305 bars of two symbols: 2.6 million signals."""
    specs = sweep.trend_specs((5, 7, 10, 14, 21), [1.0 + 0.5 * i for i in range(10)])
    return sweep.signal_sweep(long_bars(spark, root), specs, ["4h", "1d"])


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "*"), int(os.environ.get("BENCH_CPUS") or os.cpu_count() or 8))
    jobs = {name: QUERIES[name].run for name in HEADLINE}
    jobs["sweep_50"] = sweep_of_50
    jobs["sweep_50_long"] = sweep_of_50_long
    seconds = {}
    for name, build in jobs.items():
        times = []
        for _ in range(4):
            start = time.perf_counter()
            build(spark, root).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds over headline queries (median of 3 after a warm-up)",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": pathlib.Path(root).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
