"""Technical indicators over bars or candles.

Windows here are keyed by series (symbol, or symbol and timeframe).  A series is
bounded by span / bar length, not by the number of ticks behind it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymark.functions.numeric import is_finite, ratio, significant
from quaymark.operators.ranged import Stage, Trailing, scanned
from quaymark.operators.scan import _extended, _starts

CANDLE_KEYS = ("symbol", "tf")
HOURS_PER_YEAR = 24 * 365


@dataclass(frozen=True)
class TrendSpec:
    """One Supertrend setting; `tf` None applies it to every timeframe."""

    spec: str
    atr: int
    mult: float
    tf: str | None = None


def _series(keys: Sequence[str], order: str):
    return W.partitionBy(*keys).orderBy(order)


def _tail(keys: Sequence[str], order: str, n: int):
    return _series(keys, order).rowsBetween(-(n - 1), 0)


def _prior(keys: Sequence[str], order: str, n: int):
    return _series(keys, order).rowsBetween(-n, -1)


def true_range(keys: Sequence[str] = CANDLE_KEYS, order: str = "label") -> Column:
    """max(h-l, |h-pc|, |l-pc|); the first row has only h-l (greatest skips nulls)."""
    before = F.lag("close").over(_series(keys, order))
    return F.greatest(
        F.col("high") - F.col("low"),
        F.abs(F.col("high") - before),
        F.abs(F.col("low") - before),
    )


def full_mean(c: Column, keys: Sequence[str], order: str, n: int) -> Column:
    """Simple mean over n rows, null until n rows exist."""
    w = _tail(keys, order, n)
    return F.when(F.count(c).over(w) == n, F.avg(c).over(w))


def with_atr(df: DataFrame, periods: Iterable[int], keys: Sequence[str] = CANDLE_KEYS,
             order: str = "label") -> DataFrame:
    """Add `true_range` and one `atr_<n>` per period."""
    out = df.withColumn("true_range", true_range(keys, order))
    return out.select(
        "*",
        *[full_mean(F.col("true_range"), keys, order, n).alias(f"atr_{n}") for n in sorted(set(periods))],
    )


def rsi(period: int, keys: Sequence[str] = CANDLE_KEYS, order: str = "label") -> Column:
    """RSI on simple rolling means (at least one change); no losses means 100."""
    delta = F.col("__delta")
    w = _tail(keys, order, period)
    gain = F.avg(F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0)))).over(w)
    loss = F.avg(F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0)))).over(w)
    return F.when(loss != 0, 100.0 - 100.0 / (1.0 + ratio(gain, loss))).otherwise(F.lit(100.0))


def with_rsi(df: DataFrame, periods: Iterable[int], keys: Sequence[str] = CANDLE_KEYS,
             order: str = "label") -> DataFrame:
    delta = F.col("close") - F.lag("close").over(_series(keys, order))
    out = df.withColumn("__delta", delta)
    return out.select(
        "*", *[rsi(p, keys, order).alias(f"rsi_{p}") for p in sorted(set(periods))]
    ).drop("__delta")


def rsi_vote(value: Column, oversold: float, overbought: float) -> Column:
    return F.when(value >= overbought, -1.0).when(value <= oversold, 1.0).otherwise(0.0)


def ema_vote(fast: Column, slow: Column) -> Column:
    return F.when(fast < slow, -1.0).otherwise(1.0)


def trend_states(candles: DataFrame, specs: Sequence[TrendSpec], spans: Sequence[int] = ()) -> DataFrame:
    """Supertrend direction per candle and spec, and EMAs of the close.

    Both recurrences are nonlinear or seeded, so they run in one streaming pass
    over co-located, sorted candles.  The pass carries one number per spec and
    band between Arrow batches, so memory does not grow with the series, and
    all specs of a candle step together: a candle travels once, and rows per
    spec are only made from its result.
    """
    spans = sorted(set(spans))
    with_ranges = with_atr(candles.repartition(*CANDLE_KEYS), [s.atr for s in specs])
    slots = []
    for s in specs:
        slot = F.struct(
            F.lit(s.spec).alias("spec"),
            F.col(f"atr_{s.atr}").alias("atr"),
            F.lit(float(s.mult)).alias("mult"),
            F.lit(s.atr).alias("atr_n"),
        )
        slots.append(slot if s.tf is None else F.when(F.col("tf") == s.tf, slot))
    rows = with_ranges.withColumn("__slots", F.filter(F.array(*slots), lambda x: x.isNotNull()))
    rows = rows.drop(*[f"atr_{n}" for n in {s.atr for s in specs}])
    reach = F.transform("__slots", lambda x: F.coalesce(x["mult"] * x["atr"], F.lit(float("nan"))))
    ordered = rows.withColumn("__reach", reach).sortWithinPartitions(*CANDLE_KEYS, "label")
    keys = list(CANDLE_KEYS)
    passed = ordered.drop("__slots").columns
    fields = [("__reach", T.ArrayType(T.DoubleType())), ("__bull", T.ArrayType(T.BooleanType())), *[(f"ema_{n}", "double") for n in spans]]

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = [2.0 / (n + 1.0) for n in spans]
        last, bull, upper, lower, before = None, None, None, None, math.nan
        means: list[float] = []
        for pdf in batches:
            if not len(pdf):
                continue
            flags, last = _starts(pdf, keys, last)
            mids = ((pdf["high"] + pdf["low"]) / 2.0).tolist()
            bulls, emas = [], []
            for new, m, r, close in zip(flags, mids, pdf["__reach"].tolist(), pdf["close"].tolist()):
                r = np.asarray(r, dtype=float)
                if new:
                    upper = lower = np.full(len(r), math.nan)
                    bull, before = np.ones(len(r), dtype=bool), math.nan
                # A band only tightens while the previous close stayed inside it.
                high, low = m + r, m - r
                fresh = np.isnan(upper) | np.isnan(r)
                upper = np.where((before <= upper) & (upper <= high), upper, high)
                lower = np.where((low <= lower) & (lower <= before), lower, low)
                bull = fresh | np.where(bull, close >= lower, close > upper)
                before = close
                bulls.append(bull)
                if spans:
                    means = (
                        [close] * len(spans)
                        if new
                        else [y + k * (close - y) for y, k in zip(means, weights)]
                    )
                    emas.append(means)
            extra = {f"ema_{n}": [e[i] for e in emas] for i, n in enumerate(spans)}
            yield pdf.assign(__bull=bulls, **extra)

    # The slots stay out of the pass: they follow from the candle's own columns.
    named = [F.struct(F.lit(s.spec).alias("spec"), F.lit(float(s.mult)).alias("mult"), F.lit(s.atr).alias("atr_n")) for s in specs]
    named = [n if s.tf is None else F.when(F.col("tf") == s.tf, n) for n, s in zip(named, specs)]
    candle = ordered.select(*passed)
    walked = candle.mapInPandas(walk, _extended(candle.drop("__reach"), *fields))
    per_spec = F.arrays_zip(F.filter(F.array(*named), lambda x: x.isNotNull()).alias("n"), F.col("__reach").alias("r"), F.col("__bull").alias("b"))
    kept = [c for c in walked.columns if not c.startswith("__")]
    out = walked.select(*kept, F.explode(per_spec).alias("__s"))
    return out.select(
        *kept, "__s.n.spec", (F.col("__s.r") / F.col("__s.n.mult")).alias("atr"), "__s.n.mult", "__s.n.atr_n", F.col("__s.b").alias("bull")
    )


def returns(keys: Sequence[str] = ("symbol",), order: str = "ts", value: str = "close") -> Column:
    before = F.lag(value).over(_series(keys, order))
    return ratio(F.col(value), before) - 1.0


def rolling_std(c: Column, n: int, least: int, keys: Sequence[str] = ("symbol",), order: str = "ts") -> Column:
    """Sample deviation over up to n rows once `least` values exist."""
    w = _tail(keys, order, n)
    return F.when(F.count(c).over(w) >= least, F.stddev_samp(c).over(w))


def annual_vol(c: Column, n: int, keys: Sequence[str] = ("symbol",), order: str = "ts") -> Column:
    return rolling_std(c, n, max(8, n // 4), keys, order) * math.sqrt(HOURS_PER_YEAR)


def population_vol(c: Column, n: int, keys: Sequence[str] = ("symbol",), order: str = "ts") -> Column:
    """Population deviation of the last n returns, null before n returns exist."""
    w = _tail(keys, order, n)
    return F.when(F.count(c).over(w) == n, F.stddev_pop(c).over(w))


def _trailing(df: DataFrame, value: Column, out: str, n: int, least: int, stat: str, keys: Sequence[str], order: str) -> DataFrame:
    rows = df.withColumn("__value", value)
    return scanned(rows, keys, [order], [Stage((Trailing("__value", out, n, least, stat),))], {out: "double"}).drop("__value")


def with_percentile_rank(df: DataFrame, value: str, out: str, n: int, least: int, keys: Sequence[str] = ("symbol",),
                         order: str = "ts") -> DataFrame:
    """Add the share of the last n values at or below this one, ties at their mean rank.

    Values are compared at 12 significant digits, so that equal windows tie
    whatever the order their deviations were summed in, and small values stay apart.
    A series is cut by range of time, and each part starts from the last n - 1 values before it.
    """
    return _trailing(df, significant(F.col(value), 12), out, n, least, "rank", keys, order)


def with_rolling_median(df: DataFrame, value: str, out: str, n: int, keys: Sequence[str] = ("symbol",), order: str = "ts") -> DataFrame:
    """Add the median of the last n values, nulls left out; cut like the rank."""
    return _trailing(df, F.col(value), out, n, 1, "median", keys, order)


def vol_flattening(
    bars: DataFrame,
    vol_window: int = 168,
    lookback: int = 2160,
    high: float = 0.80,
    drop: float = 0.25,
    recent: int = 336,
    slope: int = 24,
) -> DataFrame:
    """Volatility percentile that was high, has dropped and is no longer rising."""
    keys, order = ("symbol",), "ts"
    out = bars.withColumn("__r", returns())
    out = out.withColumn("__v", rolling_std(F.col("__r"), vol_window, max(8, vol_window // 4)))
    out = with_percentile_rank(out, "__v", "vol_percentile", lookback, max(48, lookback // 4))
    top = F.max("vol_percentile").over(_tail(keys, order, recent))
    change = F.col("vol_percentile") - F.lag("vol_percentile", slope).over(_series(keys, order))
    setup = (top >= high) & (F.col("vol_percentile") <= top - drop) & (change <= 0)
    return out.withColumn("flattening", F.coalesce(setup, F.lit(False))).drop("__r", "__v")


def breakout(lookback: int, fast: Column, slow: Column, keys: Sequence[str] = CANDLE_KEYS,
             order: str = "label") -> Column:
    """Close above the prior rolling high, or a stacked close > fast > slow trend."""
    prior = F.max("high").over(_prior(keys, order, lookback))
    close = F.col("close")
    return F.coalesce(close > prior, F.lit(False)) | ((close > fast) & (fast > slow))


def n_bar_return(n: int, keys: Sequence[str] = ("symbol",), order: str = "ts") -> Column:
    before = F.lag("close", n).over(_series(keys, order))
    return ratio(F.col("close"), before) - 1.0


def donchian_break(n: int, keys: Sequence[str] = ("symbol",), order: str = "ts") -> Column:
    w = _prior(keys, order, n)
    return F.when(F.count("close").over(w) == n, F.col("close") < F.min("close").over(w)).otherwise(False)


def vol_expansion(bars: DataFrame, n: int = 24, baseline: int = 720, factor: float = 1.5) -> DataFrame:
    """Short-term deviation at least `factor` times its own rolling median."""
    keys, order = ("symbol",), "ts"
    out = bars.withColumn("__r", returns())
    out = out.withColumn("vol_now", rolling_std(F.col("__r"), n, n))
    out = with_rolling_median(out, "vol_now", "vol_median", baseline)
    enough = F.count("__r").over(_series(keys, order)) >= 2 * n
    flag = enough & (F.col("vol_median") > 0) & (F.col("vol_now") >= factor * F.col("vol_median"))
    return out.withColumn("vol_expanded", F.coalesce(flag, F.lit(False))).drop("__r")


def drawdown_from_high(n: int, keys: Sequence[str] = ("symbol",), order: str = "ts") -> Column:
    """Fall of the close below the rolling maximum of `high`, never negative."""
    top = F.max("high").over(_tail(keys, order, n))
    return F.greatest(F.lit(0.0), ratio(top - F.col("close"), top, 0.0))


def relative_strength(bars: DataFrame, basis: str, other: str, n: int) -> DataFrame:
    """n-bar returns of two symbols side by side and how far `other` lags `basis`."""
    r = bars.filter(F.col("symbol").isin(basis, other)).select(
        "symbol", "ts", n_bar_return(n).alias("__r")
    )
    return (
        r.groupBy("ts")
        .agg(
            F.max(F.when(F.col("symbol") == basis, F.col("__r"))).alias("basis_return"),
            F.max(F.when(F.col("symbol") == other, F.col("__r"))).alias("other_return"),
        )
        .withColumn(
            "underperformance",
            F.coalesce(F.col("basis_return") - F.col("other_return"), F.lit(0.0)),
        )
    )


def finite_or(c: Column, default: float) -> Column:
    return F.when(is_finite(c), c).otherwise(F.lit(default))
