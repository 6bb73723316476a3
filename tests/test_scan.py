"""Range-partitioned scans against plain loops, on keys that go over many cuts."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from quaymark.operators.scan import affine, floored, running


def sample(seed: int, n: int = 400):
    rng = random.Random(seed)
    # One key owns most rows.
    return [(rng.choice("aaaab"), i, round(rng.uniform(-5, 5), 2), round(rng.uniform(0, 1.2), 3)) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "k string, i bigint, x double, a double")


@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("parts", [1, 7])
def test_running_equals_a_loop(spark, exclusive, parts):
    data = sample(1)
    df = frame(spark, data).repartition(parts)
    values = {
        "s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x")),
        "pos": ("last", F.when(F.col("x") > 0, F.col("x"))),
    }
    got = rows(running(df, ["k"], ["i"], values, True, exclusive), "i")
    state = {}
    for row in got:
        s, lo, hi, pos = state.get(row["k"], (0.0, None, None, None))
        x = row["x"]
        new = (s + x, x if lo is None else min(lo, x), x if hi is None else max(hi, x), x if x > 0 else pos)
        state[row["k"]] = new
        want = (s, lo, hi, pos) if exclusive else new
        assert row["s"] == pytest.approx(want[0])
        assert (row["lo"], row["hi"], row["pos"]) == want[1:]


def test_floored_level_equals_a_loop(spark):
    data = sample(2)
    out = floored(frame(spark, data), ["k"], ["i"], F.col("x"), "level", "before")
    state = {}
    for row in rows(out, "i"):
        before = state.get(row["k"], 0.0)
        state[row["k"]] = max(before + row["x"], 0.0)
        assert row["before"] == pytest.approx(before, abs=1e-9)
        assert row["level"] == pytest.approx(state[row["k"]], abs=1e-9)


def test_affine_recurrence_equals_a_loop(spark):
    data = sample(3)
    out = affine(frame(spark, data), ["k"], ["i"], F.col("a"), F.col("x"), "y", prev="y0")
    state = {}
    for row in rows(out, "i"):
        before = state.get(row["k"], 0.0)
        state[row["k"]] = row["a"] * before + row["x"]
        assert row["y0"] == pytest.approx(before, abs=1e-9)
        assert row["y"] == pytest.approx(state[row["k"]], abs=1e-9)


def test_affine_survives_long_decay(spark):
    """Thousands of deep reductions would underflow a product form."""
    df = spark.range(3000).select(F.lit("k").alias("k"), F.col("id").alias("i"))
    out = affine(df, ["k"], ["i"], F.lit(0.1), F.lit(1.0), "y")
    assert out.agg(F.max("y")).first()[0] == pytest.approx(1 / 0.9)


def _null_rows(spark):
    from datetime import datetime

    at = lambda d, h: datetime(2024, 1, d, h)
    rows = [("a", at(1, 1), 0, 1.0), ("a", at(2, 1), 1, -3.0), (None, at(1, 2), 2, 2.0), (None, at(2, 2), 3, 4.0), ("a", None, 4, 5.0)]
    return spark.createDataFrame(rows, "k string, ts timestamp, n int, x double")


_SEEN = {
    "running": {4: 5.0, 0: 6.0, 1: 3.0, 2: 2.0, 3: 6.0},
    "last": {4: 5.0, 0: 1.0, 1: -3.0, 2: 2.0, 3: 4.0},
    "floored": {4: 5.0, 0: 6.0, 1: 3.0, 2: 2.0, 3: 6.0},
    "affine": {4: 5.0, 0: 3.5, 1: -1.25, 2: 2.0, 3: 5.0},
}


@pytest.mark.parametrize("long", [True, False])
@pytest.mark.parametrize("scan", sorted(_SEEN))
def test_null_keys_are_one_key_and_null_times_come_first(spark, scan, long):
    from quaymark.operators import scan as s

    df = _null_rows(spark)
    if scan == "running":
        out = s.running(df, ["k"], ["ts", "n"], {"y": ("sum", F.col("x"))}, long)
    elif scan == "last":
        out = s.running(df, ["k"], ["ts"], {"y": ("last", F.col("x"))}, long)
    elif scan == "floored":
        out = s.floored(df, ["k"], ["ts", "n"], F.col("x"), "y")
    else:
        out = s.affine(df, ["k"], ["ts", "n"], F.lit(0.5), F.col("x"), "y")
    assert {r.n: r.y for r in out.collect()} == _SEEN[scan]


def test_asof_keeps_left_rows_with_null_key_or_time(spark):
    from quaymark.operators.asof import backward_asof

    left = _null_rows(spark).select("k", "ts", "n")
    right = _null_rows(spark).selectExpr("k", "ts", "x as v")
    for long in (False, True):
        got = {r.n: r.v for r in backward_asof(left, right, ["k"], ["v"], long=long).collect()}
        assert got == {0: 1.0, 1: -3.0, 2: None, 3: None, 4: None}


def _stages():
    from quaymark.operators import ranged as r

    scans = r.Sum("x", "s"), r.Extreme("x", "hi0", True, True), r.Floored("x", "level", "level0"), r.Affine("a", "x", "y", "y0")
    return [r.Stage(scans), r.Stage((r.Spent("w", "s", "spent", "part"),))], dict.fromkeys("s hi0 level level0 y y0 spent part".split(), "double")


@pytest.mark.parametrize("seed", [5, 6])
def test_dependent_stages_equal_a_loop(spark, seed):
    from quaymark.operators.ranged import scanned

    rng = random.Random(seed)
    data = [(rng.choice("aaaaaaaab"), i, round(rng.uniform(-4, 5), 2), round(rng.uniform(0, 1.2), 3), max(0.0, round(rng.uniform(-2, 3), 2))) for i in range(900)]
    df = spark.createDataFrame(data, "k string, i bigint, x double, a double, w double").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        stages, outs = _stages()
        got = rows(scanned(df, ["k"], ["i"], stages, outs), "i")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    state = {}
    for r in got:
        s, hi, level, y, spent = state.get(r["k"], (0.0, None, 0.0, 0.0, 0.0))
        total = s + r["x"]
        now = (total, r["x"] if hi is None else max(hi, r["x"]), max(0.0, level + r["x"]), r["a"] * y + r["x"], max(spent, min(spent + r["w"], total)))
        want = (now[0], hi, now[2], level, now[3], y, now[4], now[4] - spent)
        assert [r[o] for o in outs] == pytest.approx(list(want), abs=1e-9)
        state[r["k"]] = now


def test_a_hot_key_is_split_and_rows_are_shuffled_once(spark):
    """A key with nearly all rows goes to many tasks of like size, and all passes read one exchange."""
    from quaymark.operators.ranged import scanned

    df = spark.range(4000).select(
        F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("i"), F.lit(1.0).alias("x"), F.lit(0.5).alias("a"), F.lit(0.1).alias("w")
    )
    stages, outs = _stages()
    tracker = spark.sparkContext.statusTracker()
    jobs = len(tracker.getJobIdsForGroup())
    spark.sparkContext.setJobGroup("build", "")
    out = scanned(df, ["k"], ["i"], stages, outs)
    assert not tracker.getJobIdsForGroup("build") and len(tracker.getJobIdsForGroup()) == jobs
    spark.sparkContext.setJobGroup("run", "")
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 4 and max(sizes) < 2 * 4000 / len(sizes)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("== Final Plan ==") : plan.index("== Initial Plan ==")]
    assert len([line for line in final.splitlines() if "Exchange rangepartitioning" in line and "Reused" not in line]) == 1
    assert "hashpartitioning" not in final


def test_another_exchange_than_the_summary_s_is_noticed():
    import pickle

    import pyarrow as pa

    from quaymark.operators.ranged import Stage, Sum, Walk

    walk = Walk(["k"], [Stage((Sum("x", "s"),))], 1)
    batch = pa.record_batch({"k": ["b"], "x": [1.0], "__entry0": [pickle.dumps(("('a',)", [2.0]))]})
    with pytest.raises(RuntimeError, match="not reused"):
        walk.add(batch)


def test_sums_over_one_cut_are_those_of_a_loop_to_the_last_bit(spark):
    rng = random.Random(5)
    data = [(f"{i // 300:02d}", i, rng.uniform(-5, 5), 0.0) for i in range(3000)]
    got = rows(running(frame(spark, data), ["k"], ["i"], {"s": ("sum", F.col("x"))}, True), "i")
    total = {}
    for row in got:
        total[row["k"]] = total.get(row["k"], 0.0) + row["x"]
        assert row["s"] == total[row["k"]]
