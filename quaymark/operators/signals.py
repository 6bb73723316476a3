"""Stateless exposure signal from closed-candle votes, filters and overlays."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.functions.numeric import clip, ratio, sign
from quaymark.operators import indicators as ind
from quaymark.operators.bars import on_base_bars, resample


@dataclass(frozen=True)
class SignalConfig:
    """Signal settings.  The defaults are fixed values of the studied signal."""

    timeframes: tuple[str, ...] = ("1w", "1d", "4h")
    atr: int = 10
    mult: float = 3.0
    trend: Mapping[str, tuple[int, float]] = field(
        default_factory=lambda: {"1w": (7, 4.0), "1d": (21, 4.0), "4h": (7, 4.0)}
    )
    ema: tuple[int, int] = (50, 200)
    rsi_period: int = 14
    rsi_bounds: tuple[float, float] = (30.0, 70.0)
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)
    filter_frame: str = "1d"
    filter_period: int = 42
    filter_bounds: tuple[float, float] = (35.0, 80.0)
    filter_weight: float = 0.5
    no_trade_zone: float = 0.15
    agreement_exposure: float = 2.0
    breakout_exposure: float = 3.0
    max_long_exposure: float = 5.0
    breakout_frame: str = "1d"
    breakout_lookback: int = 50
    breakout_ema: tuple[int, int] = (50, 200)
    flattening_leverage: float = 1.05
    vol_target: float = 0.50
    vol_window: int = 336
    long_cap: float = 2.0
    short_cap: float = 1.0
    confidence: bool = False
    strong: tuple[float, float] = (0.99, 1.20)
    mixed: tuple[float, float] = (0.33, 1.00)
    weak: float = 0.70
    bull_floor: float | None = None
    bull_floor_needs_4h: bool = False

    def spec(self, frame: str) -> tuple[int, float]:
        return self.trend.get(frame, (self.atr, self.mult))


def trend_signal(bars: DataFrame, cfg: SignalConfig = SignalConfig()) -> DataFrame:
    """Votes per timeframe, scores, filtered score and signal per (symbol, ts).

    One resample, one recurrence pass and one lookup serve every timeframe and
    every vote; the final pivot is a conditional aggregate per (symbol, ts).
    """
    frames = tuple(dict.fromkeys([*cfg.timeframes, cfg.filter_frame, cfg.breakout_frame]))
    candles = ind.with_rsi(resample(bars, frames), {cfg.rsi_period, cfg.filter_period})
    specs = [ind.TrendSpec("signal", *cfg.spec(f), tf=f) for f in frames]
    states = ind.trend_states(candles, specs, {*cfg.ema, *cfg.breakout_ema})
    closed = F.count(F.lit(1)).over(W.partitionBy("symbol", "tf")) - 1
    enough = closed >= F.greatest(F.col("atr_n"), F.lit(2))
    e = lambda n: F.col(f"ema_{n}")
    states = states.withColumns(
        {
            "supertrend": F.when(~enough, 0.0).when(F.col("bull"), 1.0).otherwise(-1.0),
            "ema": ind.ema_vote(e(cfg.ema[0]), e(cfg.ema[1])),
            "rsi": ind.rsi_vote(F.col(f"rsi_{cfg.rsi_period}"), *cfg.rsi_bounds),
            "rsi_filter": ind.rsi_vote(F.col(f"rsi_{cfg.filter_period}"), *cfg.filter_bounds),
            "breakout": ind.breakout(
                cfg.breakout_lookback, e(cfg.breakout_ema[0]), e(cfg.breakout_ema[1])
            ).cast("double"),
        }
    )
    votes = ("supertrend", "ema", "rsi")
    zero = F.lit(0.0)
    mapped = on_base_bars(
        bars, states, frames, {v: zero for v in (*votes, "rsi_filter", "breakout")}, carry=("close",)
    )
    in_scope = F.col("tf").isin(*cfg.timeframes)
    wide = mapped.groupBy("symbol", "ts").agg(
        F.first("close").alias("close"),
        *[
            F.max(F.when(F.col("tf") == f, F.col(v))).alias(f"{v}_{f}")
            for f in cfg.timeframes
            for v in votes
        ],
        *[F.avg(F.when(in_scope, F.col(v))).alias(f"{v}_score") for v in votes],
        F.max(F.when(F.col("tf") == cfg.filter_frame, F.col("rsi_filter"))).alias("rsi_filter_signal"),
        F.max(F.when(F.col("tf") == cfg.breakout_frame, F.col("breakout"))).alias("breakout"),
    )
    raw = sum((F.col(f"{v}_score") * w for v, w in zip(votes, cfg.weights)), F.lit(0.0))
    out = wide.withColumn("raw_score", raw)
    base = clip(F.col("raw_score"), -1.0, 1.0)
    out = out.withColumn("filtered_score", contrarian_filter(base, F.col("rsi_filter_signal"), cfg.filter_weight))
    return out.withColumn("signal", no_trade(F.col("filtered_score"), cfg.no_trade_zone)).withColumn(
        "target_exposure", F.col("signal")
    )


def contrarian_filter(score: Column, stretch: Column, weight: float) -> Column:
    """Pull a stretched long or short toward zero, never across it."""
    pulled = score + F.lit(weight) * stretch
    return (
        F.when((score > 0) & (stretch < 0), F.greatest(pulled, F.lit(0.0)))
        .when((score < 0) & (stretch > 0), F.least(pulled, F.lit(0.0)))
        .otherwise(score)
    )


def no_trade(score: Column, zone: float) -> Column:
    bounded = clip(score, -1.0, 1.0)
    return F.when(F.abs(bounded) < zone, 0.0).otherwise(bounded)


def _green(frame: str, df: DataFrame) -> Column:
    name = f"supertrend_{frame}"
    return F.col(name) > 0 if name in df.columns else F.lit(False)


def trend_overlay(df: DataFrame, cfg: SignalConfig) -> DataFrame:
    """Lift the target when weekly and daily trends agree, more on a breakout."""
    agree = (F.col("signal") > 0) & _green("1w", df) & _green("1d", df)
    broke = agree & _green("4h", df) & (F.col("breakout") != 0)
    t = F.col("target_exposure")
    t = F.when(agree, F.greatest(t, F.lit(cfg.agreement_exposure))).otherwise(t)
    t = F.when(broke, F.greatest(t, F.lit(cfg.breakout_exposure))).otherwise(t)
    return df.withColumns(
        {
            "target_exposure": clip(t, -1.0, cfg.max_long_exposure),
            "trend_overlay_active": agree,
            "trend_overlay_reason": F.when(broke, "breakout").when(agree, "agreement").otherwise(""),
        }
    )


def flattening_overlay(df: DataFrame, setup: Column, cfg: SignalConfig) -> DataFrame:
    active = setup & _green("1w", df) & _green("1d", df) & (F.col("signal") > 0)
    t = F.col("target_exposure")
    lifted = F.when(active, F.greatest(t, F.lit(cfg.flattening_leverage))).otherwise(t)
    return df.withColumns(
        {"target_exposure": clip(lifted, -10.0, 10.0), "vol_flattening_overlay_active": active}
    )


def confidence_multiplier(confidence: Column, cfg: SignalConfig) -> Column:
    if not cfg.confidence:
        return F.lit(1.0)
    return (
        F.when(confidence >= cfg.strong[0], cfg.strong[1])
        .when(confidence >= cfg.mixed[0], cfg.mixed[1])
        .otherwise(cfg.weak)
    )


def vol_target_overlay(df: DataFrame, cfg: SignalConfig) -> DataFrame:
    """Scale exposure to a target volatility; last known multiplier fills gaps."""
    series = W.partitionBy("symbol").orderBy("ts")
    out = df.withColumn("__r", ind.returns())
    out = out.withColumn("vol_target_realized_vol", ind.annual_vol(F.col("__r"), cfg.vol_window))
    out = out.withColumn("vol_target_confidence", F.col("supertrend_score") * sign(F.col("signal")))
    out = out.withColumn("vol_target_confidence_multiplier", confidence_multiplier(F.col("vol_target_confidence"), cfg))
    vol = F.col("vol_target_realized_vol")
    raw = ratio(F.lit(cfg.vol_target) * F.col("vol_target_confidence_multiplier"), F.when(vol > 0, vol))
    out = out.withColumn("__m", raw)
    out = out.withColumn(
        "vol_target_multiplier", F.coalesce(F.last("__m", ignorenulls=True).over(series), F.lit(1.0))
    )
    t = clip(F.col("target_exposure") * F.col("vol_target_multiplier"), -cfg.short_cap, cfg.long_cap)
    floor_on = F.lit(False)
    if cfg.bull_floor is not None:
        floor_on = (F.col("signal") > 0) & _green("1w", df) & _green("1d", df)
        if cfg.bull_floor_needs_4h:
            floor_on = floor_on & _green("4h", df)
        lifted = F.when(floor_on, F.greatest(t, F.lit(min(cfg.bull_floor, cfg.long_cap)))).otherwise(t)
        t = clip(lifted, -cfg.short_cap, cfg.long_cap)
    return out.withColumns(
        {
            "target_exposure": t,
            "vol_target_overlay_active": F.col("signal") != 0,
            "vol_target_realized_vol": F.coalesce(vol, F.lit(0.0)),
            "vol_target_bull_floor_active": floor_on,
        }
    ).drop("__r", "__m")
