"""OHLCV bars: tick aggregation, resampling, closed-candle visibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.functions import timeframes as tf

FIELDS = ("open", "high", "low", "close", "volume")


def arrival(ts: str, tie: str | None) -> Column:
    """Ordering key as one number.

    A struct key would turn the partial aggregate over all ticks into a sort; a
    decimal is a fixed-width buffer and keeps it hash-based (measured at the same
    cost per row, without the sort).
    """
    if tie is None:
        return F.col(ts)
    micros = F.unix_micros(F.col(ts)).cast("decimal(19,0)")
    shift = F.lit(10**18).cast("decimal(19,0)")
    return (micros * shift + F.col(tie).cast("decimal(19,0)")).cast("decimal(38,0)")


def bars_from_ticks(ticks: DataFrame, timeframe: str = "1h", tie: str | None = "seq") -> DataFrame:
    """Aggregate (symbol, ts, price, size) into bars; partial sums before the shuffle.

    `tie` orders ticks of one instant (a number below 10^18); None is cheaper, for
    sources without equal instants.
    """
    at = arrival("ts", tie)
    return (
        ticks.groupBy("symbol", tf.label(F.col("ts"), timeframe).alias("bucket"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("size").alias("volume"),
        )
        .withColumnRenamed("bucket", "ts")
    )


def latest_candles(candles: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Exchange candles (epoch ms) to bars: last arrival wins, range is inclusive."""
    ts = F.timestamp_millis(F.col("ms"))
    rows = candles
    if start is not None:
        rows = rows.filter(ts >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(ts <= F.lit(end).cast("timestamp"))
    return (
        rows.groupBy("symbol", "ms")
        .agg(*[F.max_by(f, "arrival").alias(f) for f in FIELDS])
        .select("symbol", ts.alias("ts"), *FIELDS)
    )


def _slotted(bars: DataFrame, frames: Sequence[str]) -> DataFrame:
    """Repeat each bar per timeframe with the label of its candle.

    Multi-day frames start at the first day of the symbol's bars; aligned bars
    share it.
    """
    origin = None
    if any(tf.needs_origin(f) for f in frames):
        bars = bars.withColumn("__first", F.min("ts").over(W.partitionBy("symbol")))
        origin = F.col("__first")
    slots = F.array(
        *[
            F.struct(F.lit(f).alias("tf"), tf.label(F.col("ts"), f, origin).alias("label"))
            for f in frames
        ]
    )
    return bars.select("*", F.inline(slots)).drop("__first")


def resample(bars: DataFrame, frames: Sequence[str]) -> DataFrame:
    """Bars to candles of several timeframes in one shuffle: (symbol, tf, label, ...)."""
    ts = F.col("ts")
    return (
        _slotted(bars, frames)
        .groupBy("symbol", "tf", "label")
        .agg(
            F.min_by("open", F.when(F.col("open").isNotNull(), ts)).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", F.when(F.col("close").isNotNull(), ts)).alias("close"),
            F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        )
        .dropna(subset=["open", "high", "low", "close"])
    )


def closed_candles(candles: DataFrame) -> DataFrame:
    """Drop the candle in progress; `available_at` is the label of the next one."""
    w = W.partitionBy("symbol", "tf").orderBy("label")
    return candles.withColumn("available_at", F.lead("label").over(w)).filter(
        F.col("available_at").isNotNull()
    )


def on_base_bars(
    bars: DataFrame,
    candles: DataFrame,
    frames: Sequence[str],
    values: dict[str, Column],
    carry: Sequence[str] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """Show each base bar the newest candle that was closed at its time.

    `candles` holds the candles of the same bars with their computed columns and
    `values` maps a column to the default used before any candle is closed.  A
    candle closes at the label of the next one, so what a bar sees is the candle before the latest
    one whose label it has reached; a candle that was dropped as incomplete counts for neither.
    Candles carry their predecessor, and one window fills it forward to the bars; rows per series are
    bounded by span / bar length.  `by` names further series keys of the candles (a parameter set);
    each base bar then repeats per key.
    """
    series = ["symbol", "tf", *by]
    w = W.partitionBy(*series).orderBy("label")
    before = F.struct(F.lag(F.struct(*values)).over(w).alias("v"))  # the first candle has none, which is not no candle
    shown = candles.select(*series, F.col("label").alias("ts"), before.alias("__before"), F.lit(0).alias("__side"))
    frames_of = F.explode(F.array(*[F.lit(f) for f in frames])).alias("tf")
    base = bars.select("symbol", "ts", *carry, frames_of, F.lit(1).alias("__side"))
    if by:
        base = base.join(candles.select(*series).distinct(), ["symbol", "tf"])
    upto = W.partitionBy(*series).orderBy("ts", "__side").rowsBetween(W.unboundedPreceding, 0)
    filled = shown.unionByName(base, allowMissingColumns=True).withColumn("__seen", F.last("__before", ignorenulls=True).over(upto))
    return filled.filter("__side = 1").select(
        "symbol", "ts", "tf", *by, *carry, *[F.coalesce(F.col(f"__seen.v.{c}"), d).alias(c) for c, d in values.items()]
    )


def period_last(history: DataFrame, keys: Sequence[str], hours: int, values: Sequence[str]) -> DataFrame:
    """Last row of every `hours` period per key."""
    slot = tf.label(F.col("ts"), f"{hours}h")
    return (
        history.groupBy(*keys, slot.alias("period"))
        .agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("ts"))).alias(v) for v in values])
        .dropna(how="all", subset=list(values))
    )
