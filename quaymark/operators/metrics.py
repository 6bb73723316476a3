"""Performance metrics per run over equity histories.

A history holds one row per run and bar.  Running peaks, drawdowns and episodes go over a range
partitioning of (run, time), so a run of any length is spread over tasks.  Everything else is one
aggregate per run.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.functions.numeric import INF, bool_share, is_finite, ratio
from quaymark.operators.ranged import Extreme, FirstSince, Frame, Last, LowestSince, Peak, Stage, Sum, Values, scanned

RUN = ("run_id",)


def _path(keys: Sequence[str] = RUN):
    return W.partitionBy(*keys).orderBy("ts")


def _last(value: str, order: str = "ts") -> Column:
    return F.max_by(value, order)


def with_drawdown(history: DataFrame, value: str = "portfolio_value", keys: Sequence[str] = RUN, before: Sequence[str] = (), long: bool = True) -> DataFrame:
    """Add pnl, return (first row 0), peak, drawdown fraction and bars below peak; and `__before_<c>`, the last value of c.

    `long=False` takes each run in one task by plain windows: for many runs of bounded length.
    """
    if not long:
        return _short_drawdown(history, value, keys, before)
    held = [value, *[c for c in before if c != value]]
    rows = history.withColumns({"__v": F.col(value).cast("double"), "__all": F.lit(True)})
    stage = Stage((Peak("__v", "peak", "bars_below"), Last("__all", tuple(held), tuple(f"__before_{c}" for c in held), before=True)))
    kinds = dict(history.dtypes)
    out = scanned(rows, keys, ["ts"], [stage], {"peak": "double", "bars_below": "bigint"} | {f"__before_{c}": kinds[c] for c in held})
    v, last, peak = F.col(value), F.col(f"__before_{value}"), F.col("peak")
    out = out.withColumns(
        {
            "pnl": F.coalesce(v - last, F.lit(0.0)), "ret": F.coalesce(ratio(v, last) - 1.0, F.lit(0.0)), "first_row": last.isNull(),
            "drawdown": ratio(v - peak, peak, 0.0),
        }
    )
    return out.select(*history.columns, "pnl", "ret", "first_row", "peak", "drawdown", "bars_below", *[f"__before_{c}" for c in before])


def _short_drawdown(history: DataFrame, value: str, keys: Sequence[str], before: Sequence[str]) -> DataFrame:
    path = _path(keys)
    v, last = F.col(value), F.lag(value).over(path)
    # Same frame for every running column, so one sort and one pass serve all.
    upto = path.rowsBetween(W.unboundedPreceding, 0)
    out = history.withColumns(
        {
            "pnl": F.coalesce(v - last, F.lit(0.0)),
            "ret": F.coalesce(ratio(v, last) - 1.0, F.lit(0.0)),
            "first_row": last.isNull(),
            "peak": F.max(v).over(upto),
            "__rn": F.row_number().over(path),
            **{f"__before_{c}": F.lag(c).over(path) for c in before},
        }
    )
    at_peak = F.when(v >= F.col("peak"), F.col("__rn"))
    return out.withColumns(
        {
            "drawdown": ratio(v - F.col("peak"), F.col("peak"), 0.0),
            "bars_below": F.col("__rn") - F.max(at_peak).over(upto),
        }
    ).drop("__rn")


def performance(history: DataFrame, periods_per_year: float = 8760.0) -> DataFrame:
    """One row per run.  The zero return of the first bar counts; sample deviations."""
    rows = with_drawdown(history, before=("cash_reserve",)).withColumn("__cash_up", F.col("cash_reserve") - F.col("__before_cash_reserve"))
    hf = F.when(is_finite(F.col("health_factor")), F.col("health_factor"))
    agg = rows.groupBy("run_id").agg(
        F.min_by("portfolio_value", "ts").alias("initial_value"),
        _last("portfolio_value").alias("final_value"),
        (F.abs(F.min("drawdown")) * 100.0).alias("max_drawdown_pct"),
        F.max("bars_below").alias("max_drawdown_duration_bars"),
        F.avg("ret").alias("__mean"),
        F.stddev_samp("ret").alias("__std"),
        F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("__down"),
        F.coalesce(F.min(hf), F.lit(INF)).alias("min_health_factor"),
        F.coalesce(F.avg(hf), F.lit(INF)).alias("avg_health_factor"),
        F.count_if(hf < 1.0).alias("bars_below_hf_1_0"),
        F.count_if(hf < 1.5).alias("bars_below_hf_1_5"),
        F.sum("action_count").alias("total_actions"),
        F.count_if(F.col("liquidation_penalty") > 0).alias("total_liquidations"),
        F.sum("interest_accrued").alias("total_interest_paid"),
        F.sum("lst_yield").alias("total_lst_yield_earned"),
        F.sum("liquidation_penalty").alias("total_liquidation_penalty_paid"),
        F.coalesce(F.sum(F.greatest("__cash_up", F.lit(0.0))), F.lit(0.0)).alias("total_cash_hedged"),
        F.max("cash_reserve").alias("max_cash_reserve"),
    )
    scale = math.sqrt(periods_per_year)

    def risk_ratio(dev: str) -> Column:
        return F.when(F.col(dev) > 0, F.col("__mean") / F.col(dev) * scale).otherwise(0.0)

    return agg.withColumns(
        {
            "total_return_pct": ratio(F.col("final_value") - F.col("initial_value"), F.col("initial_value"), 0.0) * 100.0,
            "sharpe_ratio": risk_ratio("__std"),
            "sortino_ratio": risk_ratio("__down"),
        }
    ).drop("__mean", "__std", "__down")


def perp_summary(history: DataFrame, starting_equity: float | None = None) -> DataFrame:
    """Perp account summary: first return dropped, population deviations."""
    path = _path()
    before = F.lag("equity").over(path)
    rows = history.withColumns(
        {
            "__r": ratio(F.col("equity"), before) - 1.0,
            "__gap": (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(path))) / 1e6,
            "__peak": F.max("equity").over(path.rowsBetween(W.unboundedPreceding, 0)),
        }
    )
    exposure, down = F.col("exposure"), F.col("__r") < 0
    reason = lambda r: F.count_if(F.col("exit_reason") == r)
    agg = rows.groupBy("run_id").agg(
        (F.min_by("equity", "ts") if starting_equity is None else F.lit(float(starting_equity))).alias("starting_equity"),
        _last("equity").alias("final_equity"),
        F.count(F.lit(1)).alias("__n"),
        F.percentile("__gap", F.lit(0.5)).alias("__gap"),
        F.avg("__r").alias("__mean"),
        F.stddev_pop("__r").alias("__std"),
        F.stddev_pop(F.when(down, F.col("__r"))).alias("__down"),
        F.count_if(down).alias("__downs"),
        F.abs(F.min(ratio(F.col("equity"), F.col("__peak")) - 1.0)).alias("max_drawdown"),
        F.sum("traded_notional").alias("turnover"),
        F.count_if(F.abs("traded_notional") > 1e-8).alias("trade_count"),
        F.max(F.abs(exposure)).alias("max_abs_exposure"),
        F.avg(F.abs(exposure)).alias("average_abs_exposure"),
        F.sum("fees").alias("fee_drag"),
        F.sum("funding").alias("funding_drag"),
        reason("liquidation").alias("liquidation_count"),
        F.sum("liquidation_fee").alias("liquidation_fee_drag"),
        F.max("maintenance_margin").alias("max_maintenance_margin"),
        reason("stop_loss").alias("stop_count"),
        reason("take_profit").alias("take_profit_count"),
        bool_share(exposure > 0).alias("percent_time_long"),
        bool_share(exposure < 0).alias("percent_time_short"),
        bool_share(exposure == 0).alias("percent_time_flat"),
        (ratio(_last("btc_close"), F.min_by("btc_close", "ts")) - 1.0).alias("btc_buy_and_hold_return"),
    )
    year = 365.25 * 24 * 3600
    agg = agg.withColumns(
        {
            "__ppy": F.when(F.col("__gap") > 0, F.lit(year) / F.col("__gap")).otherwise(365.0),
            "total_return": ratio(F.col("final_equity"), F.col("starting_equity"), 1.0) - 1.0,
        }
    )
    ppy, total = F.col("__ppy"), F.col("total_return")
    scaled = lambda dev: F.col("__mean") / F.col(dev) * F.sqrt(ppy)
    return agg.withColumns(
        {
            "annualized_return": F.when(
                (F.col("__n") > 1) & (total > -1), F.pow(1.0 + total, ppy / F.col("__n")) - 1.0
            ).otherwise(0.0),
            "sharpe": F.when(F.col("__std") > 0, scaled("__std")).otherwise(0.0),
            # Without a single loss the downside deviation is undefined.
            "sortino": F.when(F.col("__n") < 2, 0.0)
            .when(F.col("__downs") == 0, F.lit(float("nan")))
            .when(F.col("__down") > 0, scaled("__down"))
            .otherwise(0.0),
        }
    ).drop("__n", "__gap", "__mean", "__std", "__down", "__downs", "__ppy")


def _highs(f: Frame) -> Values:
    """Where a strict new high starts an episode."""
    v, peak = f["__v"], f["__peak"].astype(float)
    start = np.isnan(peak) | (v > peak)
    return {"__start": start, "__new": start.astype(float), "peak_value": np.where(start, v, peak)}


def _halves(f: Frame) -> Values:
    """Where half of the fall so far is made up, and where a lower low begins it anew."""
    low, peak = f["trough_value"], f["peak_value"]
    return {"__half_way": f["__v"] >= low + (peak - low) * 0.5, "__lower": f["__trough"] == f["__i"]}


def drawdown_episodes(values: DataFrame, min_drawdown_pct: float = 30.0) -> DataFrame:
    """Peak, trough and recovery bars of each deep drawdown: (run_id, idx, value) in.

    A strict new high starts an episode and clears the half level of the one
    before, so both recoveries lie inside the episode or on the first row of the
    next: no forward search and no self-join.
    """
    rows = values.withColumns({"__v": F.col("value").cast("double"), "__i": F.col("idx").cast("double")})
    stages = [
        Stage((Extreme("__v", "__peak", True, before=True),)),
        Stage((Sum("__new", "episode"), LowestSince("__v", "__i", "__start", "trough_value", "__trough")), _highs),
        Stage((FirstSince("__i", "__half_way", "__lower", "__half"),), _halves),
    ]
    outs = dict.fromkeys(("episode", "peak_value", "trough_value", "__trough", "__half"), "double")
    rows = scanned(rows, ["run_id"], ["idx"], stages, outs)
    idx, before = F.col("idx"), F.col("episode") - 1.0
    # a row counts for its episode, and an episode's first row is also the new high of the one before
    own = F.struct("episode", idx.alias("i"), "peak_value", "trough_value", F.col("__trough").cast("bigint").alias("t"), F.col("__half").cast("bigint").alias("h"), F.lit(None).cast("bigint").alias("next"))
    none = F.lit(None).cast("double")
    ends = F.struct(before.alias("episode"), F.lit(None).cast("bigint").alias("i"), none.alias("peak_value"), none.alias("trough_value"), *[F.lit(None).cast("bigint").alias(c) for c in "th"], idx.cast("bigint").alias("next"))
    parts = rows.select("run_id", F.inline(F.array_compact(F.array(own, F.when(F.col("value") == F.col("peak_value"), F.when(idx == F.col("__trough"), ends))))))
    # troughs and what follows them only move on, so the last is the largest
    episodes = parts.groupBy("run_id", "episode").agg(
        F.min("i").alias("peak_index"), F.max("t").alias("trough_index"), F.max("peak_value").alias("peak_value"), F.min("trough_value").alias("trough_value"),
        F.max("h").alias("__half"), F.min("next").alias("__next"),
    ).filter("peak_index IS NOT NULL")
    out = episodes.withColumn("__half", F.when(F.col("__half") > F.col("trough_index"), F.col("__half")))
    depth = ratio(F.col("peak_value") - F.col("trough_value"), F.col("peak_value")) * 100.0
    return out.withColumns(
        {
            "drawdown_pct": depth,
            "half_recovery_bars": F.coalesce("__half", "__next") - F.col("trough_index"),
            "new_high_bars": F.col("__next") - F.col("trough_index"),
        }
    ).filter(
        (F.col("peak_value") > 0)
        & (F.col("trough_value") < F.col("peak_value"))
        & (F.col("drawdown_pct") >= min_drawdown_pct)
    ).drop("episode", "__half", "__next")


def episode_summary(runs: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episode count and mean recovery bars; runs without an episode stay."""
    stats = episodes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("major_drawdown_events"),
        F.avg("half_recovery_bars").alias("avg_half_recovery_bars"),
        F.avg("new_high_bars").alias("avg_new_high_bars"),
    )
    return runs.select("run_id").distinct().join(stats, "run_id", "left").fillna(0, ["major_drawdown_events"])


def indexed(history: DataFrame, value: str = "portfolio_value") -> DataFrame:
    """(run_id, idx, value) with bars counted from 0."""
    return history.select(
        "run_id", (F.row_number().over(_path()) - 1).alias("idx"), F.col(value).alias("value")
    )


def drawdown_since(history: DataFrame, start: str) -> DataFrame:
    """Largest drawdown since a date; the peak restarts inside the window."""
    recent = history.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    return with_drawdown(recent).groupBy("run_id").agg(
        (F.abs(F.min("drawdown")) * 100.0).alias("drawdown_since_pct")
    )


def worst_drawdown(history: DataFrame) -> DataFrame:
    """Timestamp and depth of the worst drawdown per run (earliest on ties)."""
    return with_drawdown(history).groupBy("run_id").agg(
        F.min_by("ts", F.struct("drawdown", "ts")).alias("worst_ts"),
        F.min("drawdown").alias("worst_dd"),
    )


def period_decomposition(history: DataFrame, unit: str = "quarter") -> DataFrame:
    """First/last/min value, means, maxima and returns per run and period."""
    start = F.date_trunc(unit, "ts")
    label = (
        F.concat(F.year(F.col("period")).cast("string"), F.lit("Q"), F.quarter("period").cast("string"))
        if unit == "quarter"
        else F.date_format("period", "yyyy-MM-dd")
    )
    agg = history.groupBy("run_id", start.alias("period")).agg(
        F.min_by("portfolio_value", "ts").alias("start_value"),
        _last("portfolio_value").alias("end_value"),
        F.min("portfolio_value").alias("min_value"),
        F.max_by(F.col("portfolio_value") / F.col("price"), "ts").alias("end_sol_equiv"),
        F.avg("target_long_fraction").alias("avg_long_target"),
        F.avg("target_short_fraction").alias("avg_short_target"),
        F.max("debt_eth_value").alias("max_eth_debt"),
        F.min("health_factor").alias("min_health_factor"),
        F.sum("action_count").alias("actions"),
    )
    pct = lambda c: (ratio(F.col(c), F.col("start_value")) - 1.0) * 100.0
    return agg.withColumns(
        {"return_pct": pct("end_value"), "dd_pct": pct("min_value"), "period": label}
    )


def compare_runs(periods: DataFrame, hedge: str, anchor: str) -> DataFrame:
    """Periods of one run with the anchor run on the right and the deltas."""
    measures = ["end_value", "return_pct", "dd_pct"]
    side = lambda run, tag: periods.filter(F.col("run_id") == run).select(
        "period", *[F.col(m).alias(f"{tag}_{m}") for m in measures]
    )
    joined = side(hedge, "hedge").join(side(anchor, "anchor"), "period", "left")
    return joined.select(
        "*", *[(F.col(f"hedge_{m}") - F.col(f"anchor_{m}")).alias(f"delta_{m}") for m in measures]
    )


def target_buckets(history: DataFrame) -> DataFrame:
    """Bars by rounded short target; the value change is taken inside the bucket."""
    rows = history.withColumn("bucket", F.round("target_short_fraction", 3))
    step = F.col("portfolio_value") - F.lag("portfolio_value").over(W.partitionBy("run_id", "bucket").orderBy("ts"))
    rows = with_drawdown(rows).withColumn("__step", step)
    return rows.groupBy("run_id", "bucket").agg(
        F.count(F.lit(1)).alias("bars"),
        F.avg("__step").alias("mean_pnl"),
        (F.avg("drawdown") * 100.0).alias("avg_drawdown_pct"),
        (F.min("drawdown") * 100.0).alias("min_drawdown_pct"),
        F.avg("debt_eth_value").alias("avg_eth_debt_value"),
        F.avg(F.least("health_factor", F.lit(10.0))).alias("avg_health_factor"),
    )


def hedge_activation(history: DataFrame) -> DataFrame:
    t = F.col("target_short_fraction")
    return history.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("bars"),
        F.count_if(t > 0).alias("active_bars"),
        (bool_share(t > 0) * 100.0).alias("active_share_pct"),
        F.coalesce(F.avg(F.when(t > 0, t)), F.lit(0.0)).alias("avg_active_target"),
        F.max(t).alias("max_target"),
        F.max("debt_eth_value").alias("max_eth_debt"),
        _last("debt_eth_value").alias("final_eth_debt"),
    )


def state_shares(history: DataFrame, column: str, states: Sequence[str], suffix: str = "share") -> DataFrame:
    """Share of bars per configured state, one column each."""
    name = lambda s: f"{s or 'cash'}_{suffix}".lower()
    return history.groupBy("run_id").agg(
        *[bool_share(F.col(column) == s).alias(name(s)) for s in states]
    )


def scenario_row(history: DataFrame, cap_by_green: Sequence[tuple[int, float]] = ((3, 1.025), (4, 1.075))) -> DataFrame:
    """Exposure and volatility aggregates of a run; exact interpolated percentile."""
    long, cap = F.col("target_long_fraction"), F.lit(0.0)
    for green, value in cap_by_green:
        cap = F.when(F.col("long_green") == green, value).otherwise(cap)
    return history.groupBy("run_id").agg(
        F.avg(long).alias("avg_target_long_fraction"),
        F.min(long).alias("min_target_long_fraction"),
        F.max("target_short_fraction").alias("max_target_short_fraction"),
        F.avg("realized_vol_pct").alias("avg_realized_vol_pct"),
        F.percentile("realized_vol_pct", F.lit(0.95)).alias("p95_realized_vol_pct"),
        bool_share(long < cap).alias("vol_capped_share"),
        F.max("debt_eth_value").alias("max_debt"),
        _last("debt_eth_value").alias("final_debt"),
    )


def event_counts(events: DataFrame, keys: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """Events per key: total, and by prefix of the reason."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        *[F.count_if(F.col("reason").startswith(p)).alias(f"{p}_events") for p in prefixes],
    )


def activity(history: DataFrame, active: Column, book: Column) -> DataFrame:
    return history.groupBy("run_id").agg(
        (bool_share(active) * 100.0).alias("active_pct"), F.max(book).alias("max_protected_book")
    )
