"""Plan properties that must hold whatever the data size."""

import math
import pathlib
import random

import duckdb
import pytest

from quaymark.plans import QUERIES
from quaymark.plans.registry import nudge, present

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="needs the test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", ["balance_replay", "short_ledger", "perp_entries", "mark_price_asof"])
def test_long_keys_are_partitioned_by_range_only(spark, name):
    text = plan(QUERIES[name].run(spark, DATA))
    assert "rangepartitioning" in text and "hashpartitioning" not in text and "Window" not in text


@needs_data
@pytest.mark.parametrize(
    "name", ["strongest_weakest", "mark_price_asof", "executable_arbitrage", "stress_grid", "liquidation_waves", "kpi_deltas", "recovery_options", "selected_rows"]
)
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name].run(spark, DATA))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@needs_data
def test_scans_read_only_what_they_need(spark):
    text = plan(QUERIES["tick_bars_1h"].run(spark, DATA))
    assert "GreaterThan(value,0.0)" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in text


@needs_data
def test_ranks_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["liquidation_waves"].run(spark, DATA))


@needs_data
@pytest.mark.parametrize("name", ["account_risk", "stress_grid", "event_counts", "candles_latest", "tick_bars_1h", "strongest_weakest", "balance_replay"])
def test_aggregates_stay_hash_based(spark, name):
    assert "SortAggregate" not in plan(QUERIES[name].run(spark, DATA))


def test_results_are_rounded_as_in_the_sql(spark):
    rng = random.Random(3)
    values = [rng.uniform(-1, 1) * 10.0**k for k in range(0, 19) for _ in range(200)] + [-4191188709294259.5, 1e305, math.inf, -math.inf]
    con = duckdb.connect()
    con.execute("CREATE TABLE v AS SELECT unnest(?::DOUBLE[]) AS x", [values])
    for digits in (4, 6):
        want = con.execute(f"SELECT round(x + {nudge(digits)!r}::DOUBLE, {digits}) + 0.0 FROM v").fetchall()
        got = present(spark.createDataFrame([(v,) for v in values], "x double").coalesce(1), digits).collect()
        assert [r[0] for r in got] == [r[0] for r in want]
        (nan,) = present(spark.createDataFrame([(math.nan,), (None,)], "x double"), digits).filter("x IS NOT NULL").collect()
        assert math.isnan(nan[0])
