import math

import pytest

from helpers import hour, one, rows
from quaymark.operators import metrics as m
from quaymark.operators import sweep

HISTORY = (
    "run_id string, ts timestamp, portfolio_value double, health_factor double, action_count bigint, interest_accrued double, "
    "lst_yield double, liquidation_penalty double, cash_reserve double"
)


def history(spark, values, hfs=None, cash=None, penalty=None):
    n = len(values)
    hfs, cash, penalty = hfs or [2.0] * n, cash or [0.0] * n, penalty or [0.0] * n
    return spark.createDataFrame(
        [("r", hour(i), float(v), hfs[i], 1, 0.5, 0.25, penalty[i], cash[i]) for i, v in enumerate(values)], HISTORY
    )


@pytest.mark.parametrize(
    "values, depth, bars",
    [([100, 200, 180, 160, 150, 170, 200], 25.0, 4), ([100, 95, 100, 105, 100, 98, 97, 105], 100 * 8 / 105, 3), ([1, 2, 3], 0.0, 0), ([5], 0.0, 0)],
)
def test_drawdown_depth_and_duration(spark, values, depth, bars):
    got = one(m.performance(history(spark, values)))
    assert got["max_drawdown_pct"] == pytest.approx(depth)
    assert got["max_drawdown_duration_bars"] == bars


def test_ratios_count_the_zero_first_return(spark):
    got = one(m.performance(history(spark, [100, 110, 99, 108.9, 98.01])))
    r = [0.0, 0.1, -0.1, 0.1, -0.1]
    mean = sum(r) / 5
    std = math.sqrt(sum((x - mean) ** 2 for x in r) / 4)
    assert got["sharpe_ratio"] == pytest.approx(mean / std * math.sqrt(8760), abs=1e-6)
    assert got["sortino_ratio"] == 0.0 or abs(got["sortino_ratio"]) < 1e9


def test_a_single_loss_has_no_sortino(spark):
    assert one(m.performance(history(spark, [100, 110, 100, 120])))["sortino_ratio"] == 0.0


def test_health_statistics_ignore_infinities(spark):
    got = one(m.performance(history(spark, [1, 1, 1, 1], [math.inf, 0.9, 1.4, math.inf])))
    assert (got["min_health_factor"], got["bars_below_hf_1_0"], got["bars_below_hf_1_5"]) == (0.9, 1, 2)
    assert got["avg_health_factor"] == pytest.approx(1.15)
    assert one(m.performance(history(spark, [1, 1], [math.inf] * 2)))["min_health_factor"] == math.inf


def test_totals(spark):
    got = one(m.performance(history(spark, [1, 2, 3, 4], cash=[10.0, 30.0, 5.0, 6.0], penalty=[0.0, 3.0, 0.0, 2.0])))
    assert got["total_cash_hedged"] == 21.0 and got["max_cash_reserve"] == 30.0
    assert got["total_liquidations"] == 2 and got["total_liquidation_penalty_paid"] == 5.0
    assert got["total_actions"] == 4 and got["total_interest_paid"] == 2.0


def episodes(spark, values, least=30.0):
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(values)], "run_id string, idx bigint, value double")
    return rows(m.drawdown_episodes(df, least), "peak_index")


def test_episode_with_recovery(spark):
    (e,) = episodes(spark, [100, 150, 120, 90, 105, 120, 150, 160])
    assert (e["peak_index"], e["trough_index"], e["half_recovery_bars"], e["new_high_bars"]) == (1, 3, 2, 4)
    assert e["drawdown_pct"] == pytest.approx(40.0)


def test_episode_without_recovery(spark):
    (e,) = episodes(spark, [100, 150, 100, 110, 115])
    assert e["drawdown_pct"] == pytest.approx(100 / 3)
    assert e["half_recovery_bars"] is None and e["new_high_bars"] is None


def test_shallow_and_flat_series_have_no_episode(spark):
    assert episodes(spark, [100, 90, 100, 95, 120]) == []
    assert episodes(spark, [100]) == []


def test_perp_summary_conventions(spark):
    rows_in = [
        ("r", hour(0), 100.0, 10_000.0, 0.5, 5_000.0, 3.0, 0.0, 0.0, 10.0, ""),
        ("r", hour(1), 110.0, 10_400.0, -1.0, 100.0, 2.0, 1.0, 25.0, 52.5, "liquidation"),
        ("r", hour(2), 90.0, 9_880.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, "take_profit"),
        ("r", hour(3), 120.0, 10_800.0, 0.25, 50.0, 0.0, 0.0, 0.0, 1.0, ""),
    ]
    schema = (
        "run_id string, ts timestamp, btc_close double, equity double, exposure double, traded_notional double, fees double, "
        "funding double, liquidation_fee double, maintenance_margin double, exit_reason string"
    )
    got = one(m.perp_summary(spark.createDataFrame(rows_in, schema), 10_000.0))
    assert got["total_return"] == pytest.approx(0.08) and got["trade_count"] == 3
    assert got["average_abs_exposure"] == pytest.approx(1.75 / 4) and got["max_abs_exposure"] == 1.0
    assert (got["liquidation_count"], got["take_profit_count"], got["stop_count"]) == (1, 1, 0)
    assert got["max_drawdown"] == pytest.approx(1 - 9_880 / 10_400) and got["percent_time_flat"] == 0.25
    r = [10_400 / 10_000 - 1, 9_880 / 10_400 - 1, 10_800 / 9_880 - 1]
    mean = sum(r) / 3
    std = math.sqrt(sum((x - mean) ** 2 for x in r) / 3)
    assert got["sharpe"] == pytest.approx(mean / std * math.sqrt(365.25 * 24))
    assert got["btc_buy_and_hold_return"] == pytest.approx(0.2)


def test_benchmark_tiers(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1.0, 2.0), (-10.0, 2.0), (-40.0, 2.0), (5.0, 0.0)], "g double, i double")
    got = [r["t"] for r in df.withColumn("t", sweep.benchmark_tier(F.col("g"), F.col("i"))).collect()]
    assert got == ["pass", "acceptable", "capital_preservation", "reject"]


def test_gates_differ_in_strictness(spark):
    df = spark.createDataFrame([(100.0, 1.2)], "final_sol_equiv double, min_health_factor double")
    loose, strict = (one(sweep.gates(df, 100.0, 95.0, 1.1, s)) for s in (False, True))
    assert loose["valid"] and not strict["valid"] and strict["near_valid"]


def test_param_grid_counts_in_mixed_radix(spark):
    got = rows(sweep.param_grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]}), "run_id")
    assert [r["run_id"] for r in got] == list(range(6))
    assert (got[4]["a"], got[4]["b"]) == (2, "y")


def test_robustness_ranking(spark):
    data = [("w1", "n1", True, 5.0, -1.0), ("w2", "n1", True, 3.0, -2.0), ("w1", "n2", True, 9.0, 0.0), ("w2", "n2", False, -1.0, 4.0)]
    df = spark.createDataFrame(data, "window string, name string, strict_improvement boolean, usd_gap double, dd_gap double")
    df = df.selectExpr("*", "1.0D AS final_portfolio_value_usd", "2.0D AS final_sol_equiv")
    got = [r.asDict() for r in sweep.robustness(df).collect()]
    assert [(r["name"], r["strict_wins"]) for r in got] == [("n1", 2), ("n2", 1)]
    assert got[0]["avg_usd_gap"] == 4.0 and got[1]["max_dd_gap"] == 4.0


@pytest.mark.parametrize("parts", ["1", "24"])
def test_runs_over_many_cuts_have_the_same_drawdowns_and_episodes(spark, parts):
    """One run with nearly all rows: against plain windows and a forward search."""
    import random

    rng = random.Random(11)
    data, v = [], 100.0
    for i in range(700):
        v = round(max(5.0, v * (1 + rng.choice([-0.08, -0.03, 0.0, 0.04, 0.09]))), 2)
        data.append(("a" if i % 60 else "b", hour(i), v, float(i % 7)))
    df = spark.createDataFrame(data, "run_id string, ts timestamp, portfolio_value double, cash double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        long, short = (rows(m.with_drawdown(df, before=("cash",), long=x), "run_id", "ts") for x in (True, False))
        episodes = {(r["run_id"], r["peak_index"]): r for r in rows(m.drawdown_episodes(m.indexed(df), 8.0))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for x, y in zip(long, short, strict=True):
        assert x.keys() == y.keys() and all(x[k] == (pytest.approx(y[k], abs=1e-12) if isinstance(y[k], float) else y[k]) for k in y)
    want = {}
    for run in "ab":
        values = [p for r, _, p, _ in data if r == run]
        peak = 0
        for i in range(1, len(values) + 1):
            if i < len(values) and values[i] <= values[peak]:
                continue
            trough = min(range(peak, i), key=lambda j: (values[j], j))
            fall = (values[peak] - values[trough]) / values[peak] * 100
            if values[trough] < values[peak] and fall >= 8.0:
                half = values[trough] + (values[peak] - values[trough]) / 2
                crossed = next((j for j in range(trough + 1, len(values)) if values[j] >= half), None)
                want[run, peak] = (trough, values[peak], values[trough], None if crossed is None else crossed - trough, None if i == len(values) else i - trough)
            peak = i
    names = ("trough_index", "peak_value", "trough_value", "half_recovery_bars", "new_high_bars")
    assert {k: tuple(r[n] for n in names) for k, r in episodes.items()} == want and len(want) > 3
