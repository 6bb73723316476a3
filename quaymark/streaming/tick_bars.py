"""The tick-to-bar aggregation on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.operators.bars import arrival


def stream_bars(ticks: DataFrame, bar: str = "1 hour", late: str = "2 hours", tie: str | None = "seq") -> DataFrame:
    """Bars from a tick stream (symbol, ts, price, size); `tie` orders ticks of one instant, as in the batch form.

    A bar is emitted once, in append mode, when the watermark has passed its end;
    ticks later than `late` are dropped by then.  State is one row per open
    (symbol, bar).
    """
    at = arrival("ts", tie)
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", bar).alias("bar"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("size").alias("volume"),
        )
        .select("symbol", F.col("bar.start").alias("ts"), "open", "high", "low", "close", "volume")
    )
