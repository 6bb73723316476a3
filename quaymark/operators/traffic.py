"""Multi-timeframe traffic lights: green counts, rankings, votes and targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.functions.numeric import num, ratio
from quaymark.operators.bars import on_base_bars, resample
from quaymark.operators.indicators import TrendSpec, trend_states

# Vote frames, colours and default ladders.
VOTE_FRAMES = ("1h", "4h", "8h", "1d")
BEAR_FRAMES = ("1d", "3d", "1w")
COLOURS = {4: "green", 3: "lime", 2: "yellow", 1: "orange", 0: "red"}
HEDGE_LADDER = {4: 0.0, 3: 0.25, 2: 0.50, 1: 0.75, 0: 0.75}
COVER_LADDER = {4: 0.0, 3: 0.35, 2: 0.75, 1: 1.0, 0: 1.0}


def directions(bars: DataFrame, frames: Sequence[str], atr: int = 10, mult: float = 3.0) -> DataFrame:
    """Closed-candle direction per (symbol, ts, timeframe); bullish before any candle."""
    states = trend_states(resample(bars, frames), [TrendSpec("base", atr, mult)])
    return on_base_bars(bars, states, frames, {"bull": F.lit(True)})


def green_counts(dirs: DataFrame, frames: Sequence[str] = VOTE_FRAMES) -> DataFrame:
    return (
        dirs.filter(F.col("tf").isin(*frames))
        .groupBy("symbol", "ts")
        .agg(F.sum(F.col("bull").cast("bigint")).alias("green"))
    )


def vote_rows(dirs: DataFrame, frames: Sequence[str] = VOTE_FRAMES) -> DataFrame:
    """Green count and the higher-timeframe bearish flags on one row."""
    def bearish(frame: str) -> Column:
        return F.max(F.when(F.col("tf") == frame, ~F.col("bull"))).alias(f"bearish_{frame}")

    return dirs.groupBy("symbol", "ts").agg(
        F.sum(F.when(F.col("tf").isin(*frames), F.col("bull").cast("bigint"))).alias("green"),
        *[bearish(f) for f in BEAR_FRAMES],
    )


def rank_symbols(greens: DataFrame, symbols: Sequence[str], keep_greens: bool = False) -> DataFrame:
    """Strongest and weakest symbol of every ts; ties go to the earlier symbol.

    `keep_greens` adds the counts of all symbols (a configured handful) as an
    array of (green, symbol).
    """
    n = len(symbols)
    names = F.array(*[F.lit(s) for s in symbols])
    place = F.array_position(names, F.col("symbol"))
    # Votes and place packed into one integer: extremes stay a hash aggregate.
    step = F.col("green") * (n + 1)
    extra = [F.collect_list(F.struct("green", "symbol")).alias("greens")] if keep_greens else []
    packed = greens.groupBy("ts").agg(
        F.max(step + (n - place)).alias("__top"), F.min(step + place).alias("__low"), *extra
    )
    rest = lambda c: F.pmod(F.col(c), F.lit(n + 1)).cast("int")
    votes = lambda c: F.floor(F.col(c) / (n + 1))
    return packed.withColumns(
        {
            "strongest": F.element_at(names, F.lit(n) - rest("__top")),
            "strongest_green": votes("__top"),
            "weakest": F.element_at(names, rest("__low")),
            "weakest_green": votes("__low"),
        }
    ).drop("__top", "__low")


def select_legs(ranked: DataFrame, min_long: int, max_short: int) -> DataFrame:
    """Long leg if strong enough; short leg if weak enough and not the long leg."""
    long_leg = F.when(F.col("strongest_green") >= min_long, F.col("strongest")).otherwise("")
    out = ranked.withColumn("selected_long", long_leg)
    weak = (F.col("weakest_green") <= max_short) & (F.col("weakest") != F.col("selected_long"))
    return out.withColumn("selected_short", F.when(weak, F.col("weakest")).otherwise(""))


def protective_short(
    legs: DataFrame, candidates: Sequence[str], fixed: str | None = None, symbols: Sequence[str] = (),
) -> DataFrame:
    """Hedge symbol per ts: weakest configured candidate, else a fixed one, else the first other.

    `legs` carries `greens`, so the choice is local to the row.
    """
    if candidates:
        able = F.filter(
            "greens", lambda g: g["symbol"].isin(*candidates) & (g["symbol"] != F.col("selected_long"))
        )
        choice = F.coalesce(F.array_min(able)["symbol"], F.lit(""))
    elif fixed:
        choice = F.lit(fixed)
    else:
        others = F.filter(F.array(*[F.lit(s) for s in symbols]), lambda s: s != F.col("selected_long"))
        choice = F.coalesce(F.get(others, F.lit(0)), F.lit(""))
    return legs.withColumn("protective_short", choice)


def ladder(key: Column, steps: Mapping[int, float], default: float = 0.0) -> Column:
    """Value of a small configured step table."""
    pairs = [x for k, v in steps.items() for x in (F.lit(int(k)), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key.cast("int")), F.lit(default))


def colour(green: Column) -> Column:
    pairs = [x for k, v in COLOURS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), green.cast("int")), F.lit("unknown"))


def crisis_floor(bear_3d: Column, bear_1w: Column, both: float = 1.25, one: float = 1.0,
                 base: float = 0.75) -> Column:
    return F.when(bear_3d & bear_1w, both).when(bear_3d, one).otherwise(base)


def highest_tier(x: Column, tiers: Sequence[tuple[float, float]], default: Column) -> Column:
    """Target of the highest tier whose threshold is reached."""
    out = default
    for threshold, target in sorted(tiers):
        out = F.when(x >= threshold, F.lit(float(target))).otherwise(out)
    return out


def signal_cap(target: Column, green: Column, tiers: Sequence[tuple[int, float]]) -> Column:
    """Cap by green tier; below the first tier nothing is allowed."""
    return F.least(target, highest_tier(green, tiers, F.lit(0.0)))


def drawdown_cap(target: Column, drawdown: Column, tiers: Sequence[tuple[float, float]]) -> Column:
    """Cap by drawdown tier; below the first tier the target stands."""
    return F.least(target, highest_tier(drawdown, tiers, target))


def vol_governor(target: Column, vol: Column, target_vol: float, floor: float = 0.0) -> Column:
    """Scale the target down to target_vol / vol; never up, never below the floor."""
    scaled = F.least(target, F.greatest(F.lit(floor), ratio(target * target_vol, vol)))
    return F.when(vol > target_vol, scaled).otherwise(target)


def recovery_boost(
    target: Column, green: Column, drawdown: Column, worsening: Column, vol: Column,
    boosted: float, min_drawdown: float = 0.0, max_worsening: float = -0.01, min_green: int = 4,
    max_vol: float | None = None,
) -> tuple[Column, Column]:
    """Raise the target while a drawdown is healing; returns (target, active)."""
    active = (drawdown >= min_drawdown) & (worsening <= max_worsening) & (green >= min_green)
    if max_vol is not None:
        active = active & (vol <= max_vol)
    return F.when(active, F.greatest(target, F.lit(boosted))).otherwise(target), active


def slope_gate(drawdown: Column, worsening: Column, min_drawdown: float, min_worsening: float) -> Column:
    return (drawdown >= min_drawdown) & (worsening >= min_worsening)


def strength_gate(basis_return: Column, short_return: Column, lag: float) -> Column:
    """The short leg lags the basis by at least `lag`; false on short history."""
    return F.coalesce(short_return <= basis_return - lag, F.lit(False))


def traffic_state(
    green: Column, drawdown: Column, worsening: Column,
    recovery: tuple[float, float, int] = (0.0, -0.01, 4),
    orange: tuple[float, float] = (0.10, 0.03),
    red_max: int = 1, green_min: int = 4, yellow_min: int = 3,
) -> Column:
    """Five-state light from votes, drawdown and its change; the first match wins."""
    return (
        F.when((drawdown >= recovery[0]) & (worsening <= recovery[1]) & (green >= recovery[2]), "recovery")
        .when((drawdown >= orange[0]) & (worsening >= orange[1]), "orange")
        .when(green <= red_max, "red")
        .when(green >= green_min, "green")
        .when(green >= yellow_min, "yellow")
        .otherwise("red")
    )


def state_targets(
    state: Column, long_target: Column, short_target: Column,
    targets: Mapping[str, tuple[float | None, float | None]],
) -> tuple[Column, Column]:
    """Per-state targets: the long one replaces, the short one is a floor."""
    new_long, floor = long_target, short_target
    for name, (lng, sht) in targets.items():
        if lng is not None:
            new_long = F.when(state == name, F.lit(lng)).otherwise(new_long)
        if sht is not None:
            floor = F.when(state == name, F.greatest(short_target, F.lit(sht))).otherwise(floor)
    return new_long, floor


def resolve_overlay(normal: Column, reason: Column, floor: Column, current: Column, up: str,
                    down: str | None) -> tuple[Column, Column]:
    """Effective target and its reason when a floor may lift the normal target."""
    effective = F.greatest(normal, floor)
    why = F.when(effective <= normal, reason)
    if down is not None:
        why = why.when(effective < current, F.lit(down))
    return effective, why.otherwise(F.lit(up))


def under_hedged(target: Column, current: Column, collateral_value: Column, capacity: Column) -> Column:
    """Safe short capacity is smaller than the short still wanted."""
    wanted = collateral_value * (target - current)
    return (target > current) & (wanted > 0) & (capacity + num(1e-9) < wanted)


def gain_near_high(peak: Column, initial: Column, current: Column, min_gain: float = 1.0, near: float = 0.10) -> Column:
    """The peak is a large enough gain and the value is still close to it."""
    gain = ratio(peak, initial, 0.0) - 1.0
    fall = ratio(peak - current, peak, 1.0)
    return (initial > 0) & (peak > 0) & (gain >= min_gain) & (fall <= near)


def hedge_failure(protected: Column, underperformance: Column, threshold: float = 0.10) -> Column:
    """A protective mode is on and the asset still lags its hedge leg."""
    return protected & (underperformance >= threshold)
