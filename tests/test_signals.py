import math

import pytest
from pyspark.sql import functions as F

from helpers import bars, hour, rows
from quaymark.operators import indicators as ind
from quaymark.operators import signals, traffic
from quaymark.operators.bars import resample

UP = [100.0 + i for i in range(96)]
DOWN = [200.0 - i for i in range(96)]
FLAT = [50.0] * 96


def reference_direction(highs, lows, closes, n, mult):
    """A direct, unoptimised Supertrend for comparison."""
    out, tr = [], []
    upper = lower = None
    for i in range(len(closes)):
        ranges = [highs[i] - lows[i]]
        if i:
            ranges += [abs(highs[i] - closes[i - 1]), abs(lows[i] - closes[i - 1])]
        tr.append(max(ranges))
        if i < n - 1:
            out.append(True)
            continue
        reach = mult * sum(tr[i - n + 1 : i + 1]) / n
        mid = (highs[i] + lows[i]) / 2
        if upper is None:
            upper, lower = mid + reach, mid - reach
            out.append(True)
            continue
        if mid + reach < upper or closes[i - 1] > upper:
            upper = mid + reach
        if mid - reach > lower or closes[i - 1] < lower:
            lower = mid - reach
        out.append(closes[i] >= lower if out[-1] else closes[i] > upper)
    return out


def test_supertrend_matches_a_direct_loop(spark):
    closes = [100 + 10 * math.sin(i / 5) + 6 * math.sin(i / 1.7) for i in range(240)]
    df = bars(spark, {"A": closes})
    states = ind.trend_states(resample(df, ["1h"]), [ind.TrendSpec("s", 7, 1.5), ind.TrendSpec("t", 10, 3.0)])
    for spec, n, m in (("s", 7, 1.5), ("t", 10, 3.0)):
        got = [r["bull"] for r in rows(states.filter(F.col("spec") == spec), "label")]
        assert got == reference_direction([c * 1.01 for c in closes], [c * 0.99 for c in closes], closes, n, m)


def test_ema_is_seeded_by_the_first_value(spark):
    states = ind.trend_states(resample(bars(spark, {"A": [10.0, 20.0, 30.0]}), ["1h"]), [ind.TrendSpec("s", 2, 1.0)], (3,))
    assert [r["ema_3"] for r in rows(states, "label")] == pytest.approx([10.0, 15.0, 22.5])


def test_strongest_and_weakest(spark):
    df = bars(spark, {"SOL": UP, "ETH": DOWN, "mSOL": FLAT})
    greens = traffic.green_counts(traffic.directions(df, ["1h", "4h"], 3, 1.5), ["1h", "4h"])
    last = rows(traffic.rank_symbols(greens, ["SOL", "ETH", "mSOL"]), F.desc("ts"))[0]
    assert (last["strongest"], last["weakest"]) == ("SOL", "ETH")


def test_ties_go_to_the_first_symbol_both_ways(spark):
    greens = spark.createDataFrame([(hour(0), s, 2) for s in ("b", "a", "c")], "ts timestamp, symbol string, green bigint")
    got = rows(traffic.rank_symbols(greens, ["b", "a", "c"]))[0]
    assert (got["strongest"], got["weakest"]) == ("b", "b")


def test_the_candle_in_progress_does_not_move_the_signal(spark):
    base = [100.0] * 8
    jump = [100.0] * 7 + [200.0]
    cfg = signals.SignalConfig(timeframes=("4h",), filter_frame="4h", breakout_frame="4h", ema=(2, 4), breakout_ema=(2, 4))
    a, b = (rows(signals.trend_signal(bars(spark, {"BTC": c}), cfg), "ts")[-1] for c in (base, jump))
    for name in ("supertrend_4h", "raw_score", "signal", "ema_score", "rsi_score"):
        assert a[name] == b[name]


def test_too_few_candles_vote_zero(spark):
    cfg = signals.SignalConfig(timeframes=("4h",), filter_frame="4h", breakout_frame="4h")
    got = rows(signals.trend_signal(bars(spark, {"BTC": [100.0 + i for i in range(16)]}), cfg), "ts")
    assert {r["supertrend_4h"] for r in got} == {0.0}


def test_rsi_without_losses_is_100(spark):
    got = rows(ind.with_rsi(resample(bars(spark, {"A": [1.0, 2.0, 3.0, 2.0]}), ["1h"]), [14]), "label")
    assert [r["rsi_14"] for r in got] == pytest.approx([100.0, 100.0, 100.0, 100 - 100 / (1 + 2.0)])


@pytest.mark.parametrize(
    "score, stretch, want", [(0.4, -1.0, 0.0), (0.8, -1.0, 0.3), (-0.8, 1.0, -0.3), (0.8, 1.0, 0.8), (-0.4, 1.0, 0.0)]
)
def test_the_filter_never_crosses_zero(spark, score, stretch, want):
    df = spark.range(1).select(signals.contrarian_filter(F.lit(score), F.lit(stretch), 0.5).alias("v"))
    assert df.first()["v"] == pytest.approx(want)


def test_traffic_states(spark):
    cases = [(4, 0.2, -0.02, "recovery"), (4, 0.2, 0.05, "orange"), (1, 0.0, 0.0, "red"), (4, 0.0, 0.0, "green"), (3, 0.0, 0.0, "yellow"), (2, 0.0, 0.0, "red")]
    df = spark.createDataFrame(cases, "g int, dd double, w double, want string")
    got = df.withColumn("s", traffic.traffic_state(F.col("g"), F.col("dd"), F.col("w"))).collect()
    assert all(r["s"] == r["want"] for r in got)


def test_tier_caps(spark):
    df = spark.createDataFrame([(2,), (3,), (4,)], "g int")
    got = rows(df.withColumn("t", traffic.signal_cap(F.lit(1.5), F.col("g"), [(3, 1.025), (4, 1.075)])), "g")
    assert [r["t"] for r in got] == [0.0, 1.025, 1.075]
    dd = spark.createDataFrame([(0.05,), (0.2,), (0.6,)], "d double")
    got = rows(dd.withColumn("t", traffic.drawdown_cap(F.lit(1.0), F.col("d"), [(0.5, 0.2), (0.1, 0.6)])), "d")
    assert [r["t"] for r in got] == [1.0, 0.6, 0.2]


def test_vol_governor_only_lowers(spark):
    df = spark.createDataFrame([(0.0,), (0.01,), (0.04,), (1.0,)], "v double")
    got = rows(df.withColumn("t", traffic.vol_governor(F.lit(1.0), F.col("v"), 0.02, 0.1)), "v")
    assert [r["t"] for r in got] == pytest.approx([1.0, 1.0, 0.5, 0.1])


def test_overlay_reasons(spark):
    df = spark.createDataFrame([(0.5, 0.2, 0.0), (0.2, 0.5, 0.1), (0.2, 0.5, 0.9)], "n double, f double, c double")
    eff, why = traffic.resolve_overlay(F.col("n"), F.lit("normal"), F.col("f"), F.col("c"), "up", "down")
    got = rows(df.withColumns({"e": eff, "w": why}), F.desc("n"), "c")
    assert [(r["e"], r["w"]) for r in got] == [(0.5, "normal"), (0.5, "up"), (0.5, "down")]


def test_percentile_rank_averages_ties(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0]
    df = spark.createDataFrame([("A", hour(i), v) for i, v in enumerate(values)], "symbol string, ts timestamp, v double")
    got = [r["p"] for r in rows(ind.with_percentile_rank(df, "v", "p", 4, 2), "ts")]
    assert got == [None, pytest.approx(0.5), pytest.approx(2.5 / 3), pytest.approx(0.5), pytest.approx(3.5 / 4)]


@pytest.mark.parametrize("parts", ["1", "16"])
def test_sliding_order_statistics_over_cuts(spark, parts):
    """Windows wider than a part, nulls, ties and two series, against pandas."""
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(4)
    data = [(s, hour(i), None if r.random() < 0.1 else float(r.integers(0, 40))) for s in "AB" for i in range(150)]
    df = spark.createDataFrame(data, "symbol string, ts timestamp, v double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = ind.with_rolling_median(ind.with_percentile_rank(df, "v", "p", 60, 5), "v", "m", 37)
        got = {(x["symbol"], x["ts"]): (x["p"], x["m"]) for x in rows(out)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for s in "AB":
        own = [(t, v) for k, t, v in data if k == s]
        v = pd.Series([np.nan if x is None else x for _, x in own], dtype=float)
        rank = v.rolling(60, min_periods=5).rank(pct=True)
        median = v.rolling(37, min_periods=1).median()
        for i, (t, x) in enumerate(own):
            p, m = got[s, t.replace(tzinfo=None)]
            assert (p is None) == (x is None or np.isnan(rank[i])) and (p is None or p == pytest.approx(rank[i]))
            assert (m is None) == np.isnan(median[i]) and (m is None or m == pytest.approx(median[i]))
