"""Parameter sweeps, benchmark tiers, gates and rankings over run tables."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.functions.numeric import ratio
from quaymark.operators.bars import resample
from quaymark.operators.indicators import TrendSpec, trend_states
from quaymark.operators.metrics import with_drawdown
from quaymark.operators.ranged import runs_of_keys


def param_grid(spark, grid: Mapping[str, Sequence]) -> DataFrame:
    """Cartesian product of parameter lists; run_id counts in mixed radix.

    Built by exploding literal arrays from one row, so nothing is joined.
    """
    return with_params(spark.range(1).select(), grid, "run_id")


def strategy_grid(grid: Mapping[str, Sequence]) -> dict[str, Sequence]:
    """The grid of a strategy search: crisis mode is tried on and off where the grid does not set it."""
    return dict(grid) if "enable_crisis_mode" in grid else {**grid, "enable_crisis_mode": [True, False]}


def with_params(rows: DataFrame, grid: Mapping[str, Sequence], number: str = "combination") -> DataFrame:
    """Each row once per combination of parameters, which `number` counts in mixed radix; first names change slowest."""
    df = rows.withColumn(number, F.lit(0).cast("bigint"))
    for name, values in grid.items():
        df = df.select(
            "*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias("__i", name)
        ).withColumn(number, F.col(number) * len(values) + F.col("__i")).drop("__i")
    return df


def trend_specs(atrs: Sequence[int], mults: Sequence[float]) -> list[TrendSpec]:
    """One spec per (atr, mult); the id names the setting."""
    return [TrendSpec(f"a{a}_m{m:g}", a, m) for a, m in itertools.product(atrs, mults)]


#: Settings of a symbol that one task takes.
SPECS_PER_TASK = 8


def _curves(bars: pa.RecordBatch, candles: pa.RecordBatch) -> Iterator[tuple]:
    """(spec, final equity, deepest fall, mean, deviation and downside deviation of returns) of a symbol's settings."""
    ts = bars.column("at").cast(pa.int64()).to_numpy()
    close = bars.column("close").to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(all="ignore"):
        change = close[1:] / close[:-1] - 1.0
    change = np.where(close[:-1] > 0, change, np.nan)
    at, bull = candles.column("at").cast(pa.int64()).to_numpy(), candles.column("bull").to_numpy(zero_copy_only=False).astype(bool)
    spec = runs_of_keys(candles, ("spec",))
    series = runs_of_keys(candles, ("spec", "tf"))
    edges = np.concatenate([[0], np.flatnonzero(np.diff(series)) + 1, [len(series)]])
    first = np.concatenate([[0], np.flatnonzero(np.diff(spec)) + 1])
    votes = np.zeros((len(first), len(ts)))
    frames = np.zeros(len(first))
    for lo, hi in itertools.pairwise(edges):
        # what a bar sees is the candle before the latest whose label it has reached; it changes with labels only
        start = np.concatenate([[0], np.searchsorted(ts, at[lo + 1 : hi], side="left"), [len(ts)]])
        votes[spec[lo]] += np.repeat(np.concatenate([[1.0], np.where(bull[lo : hi - 1], 1.0, -1.0)]), np.diff(start))
        frames[spec[lo]] += 1
    exposure = votes / frames[:, None]
    for k, name in enumerate(candles.column("spec").take(pa.array(first)).to_pylist()):
        step = np.concatenate([[1.0], 1.0 + exposure[k, :-1] * change])
        equity = 10_000.0 * np.cumprod(np.where(np.isnan(step), 1.0, step))
        ret = np.concatenate([[0.0], equity[1:] / equity[:-1] - 1.0])
        down = ret[ret < 0]
        deviation = lambda x: float(np.std(x, ddof=1)) if len(x) > 1 else None
        yield name, float(equity[-1]), float((1.0 - equity / np.maximum.accumulate(equity)).max()) * 100.0, float(ret.mean()), deviation(ret), deviation(down)


def signal_sweep(bars: DataFrame, specs: Sequence[TrendSpec], frames: Sequence[str]) -> DataFrame:
    """Return, drawdown and risk ratios of every (symbol, spec) in one plan.

    Candles are resampled once and every distinct (atr, mult) recurrence runs
    once per series.  Exposure is the mean vote of the timeframes, the curve has
    no costs.  Votes change with candles only: a task gets a symbol's bars, once, and the candles of
    a few settings, and makes each curve as one array; rows are bars and candles, not their product.
    Bars per symbol are bounded by span / bar length.
    """
    states = trend_states(resample(bars, frames), specs).select("symbol", "tf", "spec", F.col("label").alias("at"), "bull")
    parts = -(-len(specs) // SPECS_PER_TASK)
    place = F.create_map(*[F.lit(x) for k, s in enumerate(specs) for x in (s.spec, k % parts)])
    candles = states.withColumn("part", F.element_at(place, F.col("spec")))
    base = bars.select("symbol", F.col("ts").alias("at"), F.col("close").cast("double"), F.explode(F.array(*[F.lit(k) for k in range(parts)])).alias("part"))
    fed = base.unionByName(candles, allowMissingColumns=True).repartition("symbol", "part").sortWithinPartitions("symbol", "part", "spec", "tf", "at")
    keys = ["symbol", "part"]
    names = ["spec", "final_equity", "max_drawdown_pct", "__mean", "__std", "__down"]
    kind = dict(bars.dtypes)["symbol"]

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            n = group.column("spec").null_count  # bars come first
            if 0 < n < group.num_rows:
                rows = list(_curves(group.slice(0, n), group.slice(n)))
                columns = [pa.array(c, pa.string() if i == 0 else pa.float64()) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([group.column("symbol").slice(0, 1).take(pa.array([0] * len(rows))), *columns], ["symbol", *names])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            run = runs_of_keys(batch, keys)
            cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
            for lo, hi in itertools.pairwise(cuts):
                if held and [held[0].column(k)[0].as_py() for k in keys] != [batch.column(k)[lo].as_py() for k in keys]:
                    yield from out(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from out(held)

    agg = fed.mapInArrow(walked, f"symbol {kind}, spec string, " + ", ".join(f"{n} double" for n in names[1:]))
    scale = math.sqrt(8760.0)
    by = lambda d: F.when(F.col(d) > 0, F.col("__mean") / F.col(d) * scale).otherwise(0.0)
    return agg.select(
        "symbol", "spec", "final_equity", (F.col("final_equity") / 100.0 - 100.0).alias("total_return_pct"),
        "max_drawdown_pct", by("__std").alias("sharpe_ratio"), by("__down").alias("sortino_ratio"),
    )


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """Benchmark return, drawdown and final price per symbol."""
    rows = with_drawdown(bars, "close", ("symbol",))
    first, last = F.min_by("close", "ts"), F.max_by("close", "ts")
    return rows.groupBy("symbol").agg(
        (ratio(last - first, first, 0.0) * 100.0).alias("benchmark_return_pct"),
        (F.abs(F.min("drawdown")) * 100.0).alias("benchmark_max_drawdown_pct"),
        last.alias("final_price"),
    )


def benchmark_tier(gap: Column, improvement: Column, acceptable: float = 25.0) -> Column:
    return (
        F.when((gap >= 0) & (improvement > 0), "pass")
        .when((gap >= -acceptable) & (improvement > 0), "acceptable")
        .when(improvement > 0, "capital_preservation")
        .otherwise("reject")
    )


def tier_rank(tier: Column) -> Column:
    return (
        F.when(tier == "pass", 0).when(tier == "acceptable", 1)
        .when(tier == "capital_preservation", 2).when(tier == "reject", 3).otherwise(99)
    )


def against_benchmark(results: DataFrame, benchmark: DataFrame, acceptable: float = 25.0) -> DataFrame:
    """Tracking gap, drawdown improvement, tier and its rank.

    Gaps are taken to nine digits, so a run that equals the benchmark has none.
    """
    rows = results.join(benchmark, "symbol")
    rows = rows.withColumns(
        {
            "tracking_gap_pct": F.round(F.col("total_return_pct") - F.col("benchmark_return_pct"), 9),
            "drawdown_improvement_pct": F.round(F.col("benchmark_max_drawdown_pct") - F.col("max_drawdown_pct"), 9),
        }
    )
    tier = benchmark_tier(F.col("tracking_gap_pct"), F.col("drawdown_improvement_pct"), acceptable)
    return rows.withColumn("benchmark_tier", tier).withColumn("tier_rank", tier_rank(F.col("benchmark_tier")))


def ranked(rows: DataFrame, metric: str, ascending: bool = False) -> DataFrame:
    """Comparison table by tier, then metric."""
    return rows.orderBy(F.col("tier_rank"), F.col(metric).asc() if ascending else F.col(metric).desc())


def best_row(rows: DataFrame, metric: str, ascending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """The top-ranked row (a distributed top-1, no global sort)."""
    first = F.col(metric).asc() if ascending else F.col(metric).desc()
    return rows.orderBy(first, *ties).limit(1)


def experiment_group(relever: Column, max_debt: Column, full_short: Column) -> Column:
    return F.when(relever & (max_debt > 0), "usdc_releverage").when(full_short, "core_full_short").otherwise("core_hedge")


def final_positions(history: DataFrame, positions: DataFrame,
                    wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """Final value, SOL-equivalent and chosen legs per run; missing legs are 0."""
    last = history.groupBy("run_id").agg(
        F.max("ts").alias("ts"),
        F.max_by("portfolio_value", "ts").alias("final_portfolio_value_usd"),
        F.max_by("price", "ts").alias("__price"),
    )
    legs = positions.join(last.select("run_id", "ts"), ["run_id", "ts"]).groupBy("run_id")
    pick = lambda side, s, c: F.coalesce(
        F.max(F.when((F.col("side") == side) & (F.col("symbol") == s), F.col(c))), F.lit(0.0)
    )
    wide = legs.agg(
        *[pick(side, s, "amount").alias(f"final_{side}_{s}".lower()) for side, s in wanted],
        *[pick(side, s, "value").alias(f"final_{side}_{s}_value_usd".lower()) for side, s in wanted],
    )
    return last.join(wide, "run_id", "left").fillna(0.0).withColumn(
        "final_sol_equiv", ratio(F.col("final_portfolio_value_usd"), F.col("__price"), 0.0)
    ).drop("ts", "__price")


def reference_deltas(rows: DataFrame, usd: float, sol: float, drawdown: float) -> DataFrame:
    """Gaps to fixed reference results and the strict-improvement flag."""
    v, s, d = (F.col(c) for c in ("final_portfolio_value_usd", "final_sol_equiv", "max_drawdown_pct"))
    return rows.withColumns(
        {
            "usd_gap_vs_reference": v - usd,
            "sol_gap_vs_reference": s - sol,
            "dd_gap_vs_reference": d - drawdown,
            "strict_improvement": (v >= usd) & (d <= drawdown),
        }
    )


def gates(rows: DataFrame, sol_gate: float, near_gate: float, hf_gate: float, strict: bool) -> DataFrame:
    """SOL, near-SOL and health gates; `strict` makes the SOL gate exclusive."""
    s, hf = F.col("final_sol_equiv"), F.col("min_health_factor")
    sol_ok = s > sol_gate if strict else s >= sol_gate
    near, hf_ok = s >= near_gate, hf >= hf_gate
    return rows.withColumns(
        {
            "sol_gate_pass": sol_ok, "near_sol_gate_pass": near, "hf_gate_pass": hf_ok,
            "valid": sol_ok & hf_ok, "near_valid": near & hf_ok,
        }
    )


def selected_rows(rows: DataFrame, usd: float, drawdown: float, dd_limit: float = 55.0,
                  ties: Sequence[str] = ()) -> DataFrame:
    """One row per criterion: most USD, least drawdown, best strict, best below a limit.

    All criteria are one aggregate: each partition sends one candidate per rule.
    """
    v, d = F.col("final_portfolio_value_usd"), F.col("max_drawdown_pct")
    names = [F.col(t) for t in ties]
    most_usd, least_dd = F.struct(-v, d, *names), F.struct(d, -v, *names)
    rules = [
        ("Highest USD", F.lit(True), most_usd),
        ("Lowest DD", F.lit(True), least_dd),
        ("Strict reference improvement", (v >= usd) & (d <= drawdown), most_usd),
        (f"Best DD <={dd_limit:g}%", d <= dd_limit, most_usd),
    ]
    row = F.struct(*rows.columns)
    best = rows.agg(*[F.min_by(row, F.when(keep, order)).alias(f"r{i}") for i, (_, keep, order) in enumerate(rules)])
    picks = F.array(*[F.struct(F.lit(name).alias("criterion"), F.col(f"r{i}").alias("row")) for i, (name, _, _) in enumerate(rules)])
    return best.select(F.inline(picks)).filter("row IS NOT NULL").select("criterion", "row.*")


def best_per_family(rows: DataFrame, family: str = "family", ties: Sequence[str] = ()) -> DataFrame:
    """Best row per family by validity, drawdown and SOL; the rank filter runs map-side."""
    order = [F.col("valid").desc(), F.col("near_valid").desc(), F.col("max_drawdown_pct").asc(), F.col("final_sol_equiv").desc(), *ties]
    w = W.partitionBy(family).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def robustness(rows: DataFrame) -> DataFrame:
    """Wins and gaps of each name across windows, ranked by three keys."""
    return (
        rows.groupBy("name")
        .agg(
            F.count("window").alias("windows"),
            F.count_if("strict_improvement").alias("strict_wins"),
            F.avg("usd_gap").alias("avg_usd_gap"),
            F.min("usd_gap").alias("min_usd_gap"),
            F.avg("dd_gap").alias("avg_dd_gap"),
            F.max("dd_gap").alias("max_dd_gap"),
            F.avg("final_portfolio_value_usd").alias("avg_final_usd"),
            F.avg("final_sol_equiv").alias("avg_final_sol"),
        )
        .orderBy(F.desc("strict_wins"), F.desc("avg_usd_gap"), F.asc("avg_dd_gap"))
    )


def regime_table(rows: DataFrame) -> DataFrame:
    """Start, end, return, drawdown and averages per run and regime.

    `rows` is a history repeated per regime that holds it, so the peak restarts
    in each regime; empty regimes do not appear.
    """
    cut = with_drawdown(rows, "portfolio_value", ("run_id", "regime"))
    agg = cut.groupBy("run_id", "regime").agg(
        F.min_by("portfolio_value", "ts").alias("start_value"),
        F.max_by("portfolio_value", "ts").alias("end_value"),
        (F.abs(F.min("drawdown")) * 100.0).alias("drawdown_pct"),
        F.avg("target_long_fraction").alias("avg_target_long_fraction"),
        F.avg("target_short_fraction").alias("avg_target_short_fraction"),
        F.min("health_factor").alias("min_health_factor"),
        F.avg(F.col("boost").cast("double")).alias("boost_share"),
    )
    return agg.withColumn("return_pct", (ratio(F.col("end_value"), F.col("start_value")) - 1.0) * 100.0)
