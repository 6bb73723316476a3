from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from helpers import BARS, bars, hour, one, rows
from quaymark.operators import asof
from quaymark.operators.bars import (
    bars_from_ticks, closed_candles, latest_candles, on_base_bars, period_last, resample,
)


def utc(*a):
    return datetime(*a)


def test_ticks_keep_first_and_last_by_time_then_sequence(spark):
    ticks = spark.createDataFrame(
        [("A", hour(0.1), 5.0, 1.0, 2), ("A", hour(0.1), 4.0, 1.0, 1), ("A", hour(0.9), 7.0, 2.0, 3), ("A", hour(1), 6.0, 1.0, 4)],
        "symbol string, ts timestamp, price double, size double, seq bigint",
    )
    first, second = rows(bars_from_ticks(ticks), "ts")
    assert (first["open"], first["high"], first["low"], first["close"], first["volume"]) == (4.0, 7.0, 4.0, 7.0, 4.0)
    assert second["open"] == second["close"] == 6.0


def test_candles_keep_the_last_arrival_in_an_inclusive_range(spark):
    step, t0 = 3_600_000, 1704067200000
    data = [("A", t0 + i * step, *(150 + 0.1 * i,) * 4, 1.0, i) for i in range(5)]
    data.append(("A", t0 + step, 9.0, 9.0, 9.0, 9.0, 9.0, 99))
    raw = spark.createDataFrame(data, "symbol string, ms bigint, open double, high double, low double, close double, volume double, arrival bigint")
    got = rows(latest_candles(raw, "2024-01-01 01:00:00", "2024-01-01 03:00:00"), "ts")
    assert [r["close"] for r in got] == pytest.approx([9.0, 150.2, 150.3])


def test_week_label_is_its_sunday_and_three_day_frames_start_at_the_first_day(spark):
    df = bars(spark, {"A": [100.0 + i for i in range(24 * 8)]})  # 2024-01-01 is a Monday
    got = rows(resample(df, ["1w", "3d", "8h"]), "tf", "label")
    weeks = [r["label"] for r in got if r["tf"] == "1w"]
    assert weeks == [utc(2024, 1, 7), utc(2024, 1, 14)]
    threes = [r["label"] for r in got if r["tf"] == "3d"]
    assert threes == [utc(2024, 1, 1), utc(2024, 1, 4), utc(2024, 1, 7)]
    eights = [r for r in got if r["tf"] == "8h"]
    assert eights[0]["open"] == 100.0 and eights[0]["close"] == 107.0 and len(eights) == 24


def test_three_day_frames_follow_a_late_start(spark):
    start = datetime(2024, 1, 3, 5, tzinfo=timezone.utc)
    got = rows(resample(bars(spark, {"A": [1.0] * 80}, start), ["3d"]), "label")
    assert [r["label"] for r in got] == [utc(2024, 1, 3), utc(2024, 1, 6)]


def test_resample_skips_nulls_and_drops_incomplete_buckets(spark):
    data = [
        ("A", hour(0), None, 2.0, 1.0, 1.5, None), ("A", hour(1), 1.2, 3.0, 1.0, None, 2.0),
        ("A", hour(4), None, None, None, None, None),
    ]
    got = one(resample(spark.createDataFrame(data, BARS), ["4h"]))
    assert (got["open"], got["high"], got["low"], got["close"], got["volume"]) == (1.2, 3.0, 1.0, 1.5, 2.0)


def test_closed_candles_leave_out_the_one_in_progress(spark):
    candles = resample(bars(spark, {"A": [1.0] * 9}), ["4h"])
    got = rows(closed_candles(candles), "label")
    assert [r["available_at"] for r in got] == [utc(2024, 1, 1, 4), utc(2024, 1, 1, 8)]
    single = resample(bars(spark, {"A": [1.0] * 3}), ["4h"])
    assert closed_candles(single).count() == 0


def test_base_bars_see_only_closed_candles(spark):
    base = bars(spark, {"A": [float(i) for i in range(12)]})
    candles = resample(base, ["4h"])
    seen = rows(on_base_bars(base, candles, ["4h"], {"close": F.lit(-1.0)}), "ts")
    assert [r["close"] for r in seen] == [-1.0] * 4 + [3.0] * 4 + [7.0] * 4


def test_weekly_candles_show_at_the_next_label(spark):
    base = bars(spark, {"A": [float(i // 24) for i in range(24 * 22)]})
    candles = resample(base, ["1w"])
    seen = {r["ts"]: r["close"] for r in rows(on_base_bars(base, candles, ["1w"], {"close": F.lit(-1.0)}))}
    # The first week (Sunday the 7th) becomes visible at the next week's label, Sunday the 14th.
    assert seen[utc(2024, 1, 13, 23)] == -1.0
    assert seen[utc(2024, 1, 14)] == 6.0
    assert seen[utc(2024, 1, 20, 12)] == 6.0
    assert seen[utc(2024, 1, 21)] == 13.0


def test_alignment_fills_forward_from_the_first_common_bar(spark):
    data = [("A", hour(0), *[1.0] * 5), ("A", hour(2), *[3.0] * 5), ("B", hour(1), *[10.0] * 5)]
    got = rows(asof.align_symbols(spark.createDataFrame(data, BARS), ["A", "B"]), "ts", "symbol")
    assert [(r["symbol"], r["close"]) for r in got] == [("A", 1.0), ("B", 10.0), ("A", 3.0), ("B", 10.0)]


@pytest.mark.parametrize("long", [True, False])
def test_asof_takes_the_latest_row_even_if_null(spark, long):
    left = spark.createDataFrame([("k", hour(h), h) for h in (0, 1, 30, 31, 60)], "k string, ts timestamp, n int")
    right = spark.createDataFrame(
        [("k", hour(1), 5.0, "x"), ("k", hour(31), None, "y"), ("z", hour(0), 9.0, "z")], "k string, ts timestamp, v double, s string"
    )
    got = rows(asof.backward_asof(left, right, ["k"], ["v", "s"], long=long), "n")
    assert [(r["n"], r["v"], r["s"]) for r in got] == [
        (0, None, None), (1, 5.0, "x"), (30, 5.0, "x"), (31, None, "y"), (60, None, "y")
    ]


def test_tiers_are_inclusive_and_open_above(spark):
    tiers = spark.createDataFrame(
        [("v", 0.0, 50_000.0, 0.01), ("v", 50_000.0, None, 0.025)], "venue string, floor double, cap double, mm double"
    )
    folded = asof.tier_array(tiers, "venue")
    amounts = spark.createDataFrame([(10_000.0,), (50_000.0,), (-75_000.0,)], "n double").withColumn("venue", F.lit("v"))
    got = rows(amounts.join(folded, "venue").select("n", asof.tier_of(F.col("n"), F.col("tiers"))["mm"].alias("mm")), F.abs("n"))
    assert [r["mm"] for r in got] == [0.01, 0.01, 0.025]


def test_interval_rows_repeat_for_overlapping_intervals(spark):
    df = spark.createDataFrame([(hour(0),), (hour(48),)], "ts timestamp")
    intervals = [("all", None, None), ("day", "2024-01-01", "2024-01-01 23:59:59"), ("none", "2020-01-01", "2020-02-01")]
    out = asof.interval_rows(df, "ts", spark.createDataFrame(intervals, "r string, start string, end string"), "r")
    assert sorted((r["ts"].day, r["r"]) for r in out.collect()) == [(1, "all"), (1, "day"), (3, "all")]


def test_interval_join_finds_each_of_many_intervals_once(spark):
    """Intervals of minutes to centuries, open ones, points, empty ones and repeated ones, against a filter per row."""
    import random
    from datetime import timedelta

    rng = random.Random(8)
    at = lambda: hour(0) + timedelta(minutes=rng.randint(-2_000_000, 2_000_000))
    points = [(i, at()) for i in range(60)] + [(60, None)]
    spans = []
    for i in range(150):
        a = at()
        spans.append((f"r{i}", a, a + timedelta(minutes=rng.choice([0, 1, 45, 3000, 100_000, 3_000_000, -5])), i))
    spans += [("open", None, None, 1), ("from", hour(0), None, 2), ("to", None, hour(0), 3), ("point", points[0][1], points[0][1], 4), ("r1", *spans[1][1:3], 5)]
    df = spark.createDataFrame(points, "n int, ts timestamp")
    table = spark.createDataFrame(spans, "r string, start timestamp, end timestamp, w int")
    out = asof.interval_rows(df, "ts", table, "r")
    want = [(n, r, w) for n, t in points for r, a, b, w in spans if t is not None and (a is None or a <= t) and (b is None or t <= b)]
    assert sorted((x["n"], x["r"], x["w"]) for x in out.collect()) == sorted(want)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_labels_without_known_bounds_are_open(spark):
    labels = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "regime string")
    known = spark.createDataFrame([("a", "2024-01-01", None), ("c", None, None)], "regime string, start string, end string")
    got = {r["regime"]: (r["start"], r["end"]) for r in asof.named_intervals(labels, known, "regime").collect()}
    assert got.keys() == {"a", "b", "full"} and got["b"] == got["full"] == (None, None) and got["a"][0] is not None


def test_period_last_takes_the_last_row(spark):
    df = spark.createDataFrame([("r", hour(h), float(h)) for h in (0, 11, 12, 13)], "run_id string, ts timestamp, v double")
    got = rows(period_last(df, ["run_id"], 12, ["v"]), "period")
    assert [r["v"] for r in got] == [11.0, 13.0]


def test_dropped_candles_show_the_last_closed_one(spark):
    """As-of on available_at: a candle is visible from the label of the next one that exists."""
    from pyspark.sql import functions as F

    from quaymark.operators.bars import closed_candles, on_base_bars, resample

    df = bars(spark, {"A": [float(i) for i in range(1, 25)]})
    df = df.withColumns({c: F.when(~F.hour("ts").between(8, 11), F.col(c)) for c in ("open", "high", "low", "close")})
    candles = resample(df, ["4h"])
    got = {r.ts: r.close for r in on_base_bars(df, candles, ["4h"], {"close": F.lit(-1.0)}).collect()}
    closed = [(r.available_at, r.close) for r in closed_candles(candles).orderBy("available_at").collect()]
    assert len(got) == 24 and len(closed) == 4
    for ts, value in got.items():
        assert value == next((c for at, c in reversed(closed) if at <= ts), -1.0)
