"""Perpetual-futures cash flows, margins, exits and order sizing as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.functions.numeric import clip, num
from quaymark.operators.asof import tier_array, tier_of

# Research venue presets
# (venue, taker, maker, liquidation fee, max leverage, min notional, quantity step)
VENUES = (
    ("generic_linear_usdt", 0.0006, None, 0.0, 10.0, 0.0, 0.0),
    ("binance_usdm_like", 0.0006, 0.0002, 0.01, 125.0, 5.0, 0.001),
)
VENUE_SCHEMA = (
    "venue string, taker double, maker double, liquidation_fee_rate double, max_leverage double, "
    "min_notional double, quantity_step double"
)
# Margin tiers (venue, floor, cap, initial rate, maintenance rate)
TIERS = (
    ("generic_linear_usdt", 0.0, None, 0.10, 0.05),
    ("binance_usdm_like", 0.0, 50_000.0, 0.008, 0.004),
    ("binance_usdm_like", 50_000.0, 250_000.0, 0.01, 0.005),
    ("binance_usdm_like", 250_000.0, None, 0.02, 0.01),
)
TIER_SCHEMA = "venue string, floor double, cap double, im_rate double, mm_rate double"


def venues(spark) -> DataFrame:
    """Venue dimension with its tiers folded into one array."""
    base = spark.createDataFrame(list(VENUES), VENUE_SCHEMA)
    return base.join(tier_array(spark.createDataFrame(list(TIERS), TIER_SCHEMA), "venue"), "venue")


def with_venue(rows: DataFrame, venue_dim: DataFrame) -> DataFrame:
    """Attach the venue; one that isn't listed leaves its columns, and so the margins, null."""
    return rows.join(venue_dim, "venue", "left")


def funding_flow(close_notional: Column, mark_notional: Column, rate: Column, default: float = 0.0,
                 signed: bool = True) -> Column:
    """Funding on the mark notional while a position is open; unsigned without a venue."""
    base = mark_notional if signed else F.abs(mark_notional)
    return F.when(close_notional != 0, base * F.coalesce(rate, F.lit(default))).otherwise(0.0)


def fee_rate(liquidity: Column, maker: Column, taker: Column) -> Column:
    return F.when(liquidity == "maker", F.coalesce(maker, taker)).otherwise(taker)


def margins(rows: DataFrame, notional: Column, equity: Column) -> DataFrame:
    """Margin requirement by tier, liquidation flag and fee; rows carry `tiers`."""
    size = F.abs(notional)
    tier = tier_of(notional, F.col("tiers"))
    held = notional != 0
    out = rows.withColumn("__tier", tier).withColumns(
        {
            "initial_margin": F.when(held, size * F.col("__tier.im_rate")).otherwise(0.0),
            "maintenance_margin": F.when(held, size * F.col("__tier.mm_rate")).otherwise(0.0),
        }
    )
    hit = held & (equity <= F.col("maintenance_margin"))
    return out.withColumns(
        {
            "liquidated": hit,
            "liquidation_fee": F.when(hit, size * F.col("liquidation_fee_rate")).otherwise(0.0),
        }
    ).drop("__tier")


def exit_reason(price: Column, quantity: Column, entry: Column, stop: float | None, take: float | None) -> Column:
    """Stop-loss or take-profit against the average entry; the stop is tested first."""
    long, short = quantity > 0, quantity < 0
    open_ = (quantity != 0) & entry.isNotNull() & (entry != 0)
    out = F.when(~open_, "")
    if stop is not None:
        out = out.when((long & (price <= entry * (1.0 - stop))) | (short & (price >= entry * (1.0 + stop))), "stop_loss")
    if take is not None:
        out = out.when((long & (price >= entry * (1.0 + take))) | (short & (price <= entry * (1.0 - take))), "take_profit")
    return out.otherwise("")


def target_exposure(target: Column, signal: Column, most: float) -> Column:
    """Explicit target, else the clipped signal scaled, both within the gross limit."""
    fallback = clip(signal, -1.0, 1.0) * most
    return clip(F.coalesce(target, fallback), -most, most)


def notional_cap(target: Column, equity: Column, leverage: Column, contract_max: Column | None = None,
                 order_max: Column | None = None) -> Column:
    """Clamp by the smallest known limit (least ignores nulls)."""
    none = F.lit(None).cast("double")
    cap = F.least(
        F.greatest(F.lit(0.0), equity) * leverage,
        none if contract_max is None else contract_max,
        none if order_max is None else order_max,
    )
    return F.when(cap.isNull(), target).otherwise(F.greatest(-cap, F.least(cap, target)))


def round_order(notional: Column, price: Column, step: Column, min_notional: Column,
                max_notional: Column | None = None) -> Column:
    """Executable notional: capped, quantity cut to its step toward zero, dust dropped."""
    capped = notional if max_notional is None else F.greatest(-max_notional, F.least(max_notional, notional))
    quantity = capped / F.when(price > 0, price)
    steps = F.floor(F.abs(quantity) / F.when(step > 0, step)).cast("double")
    cut = F.when(step > 0, F.signum(quantity) * steps * step).otherwise(quantity)
    adjusted = F.coalesce(cut * price, F.lit(0.0))
    return F.when(F.abs(adjusted) < min_notional, 0.0).otherwise(adjusted)


def exposure_curve(rows: DataFrame, start: float = 10_000.0, keys: tuple[str, ...] = ("run_id",),
                   exposure: str = "exposure", price: str = "price") -> DataFrame:
    """Equity of holding the previous bar's exposure without costs.

    Rows are bars per key, so the running product is a bounded window.
    """
    path = W.partitionBy(*keys).orderBy("ts")
    before = F.lag(price).over(path)
    step = F.when(before > 0, 1.0 + F.lag(exposure).over(path) * (F.col(price) / before - 1.0))
    out = rows.withColumn("__step", F.coalesce(step, F.lit(1.0)))
    product = F.product("__step").over(path.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("equity", num(start) * product).drop("__step")
