import json
import math

import pytest
from pyspark.sql import functions as F

from helpers import hour, one, rows
from quaymark.operators import onchain, orderbook, reports, universe
from quaymark.operators.liquidation import market_assets
from quaymark.sources import files
from quaymark.streaming.tick_bars import stream_bars

LEVELS = "pair string, exchange string, side string, price double, vol double"


def book(spark):
    return spark.createDataFrame(
        [("P", "x", "bid", 105.0, 2.0), ("P", "x", "bid", 104.0, 3.0), ("P", "x", "bid", 99.0, 9.0), ("P", "y", "ask", 100.0, 1.0),
         ("P", "y", "ask", 101.0, 3.0), ("P", "y", "ask", 110.0, 9.0)], LEVELS,
    )


def no_fees(spark):
    return spark.createDataFrame([("x", 0.0, 0.0), ("y", 0.0, 0.0)], "exchange string, maker double, taker double")


def unlimited(spark, base=None, quote=None):
    return spark.createDataFrame([("x", base, quote), ("y", base, quote)], "exchange string, base_balance double, quote_balance double")


def test_walk_both_books(spark):
    got = one(orderbook.executable(book(spark), no_fees(spark), unlimited(spark)))
    assert (got["bid_ex"], got["ask_ex"]) == ("x", "y")
    assert got["maximum_bid_depth"] == 5.0 and got["maximum_ask_depth"] == 4.0 and got["executable_amount"] == 4.0
    assert got["avg_bid"] == pytest.approx((105 * 2 + 104 * 2) / 4) and got["avg_ask"] == pytest.approx((100 + 101 * 3) / 4)
    assert got["nominal_return"] == pytest.approx(418 - 403) and got["pct_return"] == pytest.approx(math.log(418 / 403))


def test_balances_limit_the_amount(spark):
    got = one(orderbook.executable(book(spark), no_fees(spark), unlimited(spark, quote=2.5)))
    assert got["executable_amount"] == 2.5
    compat = one(orderbook.executable(book(spark), no_fees(spark), unlimited(spark), compat_base_amount=True))
    assert compat["executable_amount_in_base"] == 0.25


def test_fees_close_a_thin_edge(spark):
    fees = spark.createDataFrame([("x", 0.03, 0.03), ("y", 0.03, 0.03)], "exchange string, maker double, taker double")
    assert orderbook.executable(book(spark), fees, unlimited(spark)).count() == 0


def test_opposing_leg(spark):
    got = {r["exchange"]: r["opposing_value"] for r in rows(orderbook.opposing_leg(book(spark), no_fees(spark), unlimited(spark, base=2.0)))}
    assert got == {"y": pytest.approx(201.0)}


def test_a_deep_level_takes_nothing_from_those_before_it(spark):
    levels = spark.createDataFrame(
        [("P", "x", "bid", 4.0, 1e17), ("P", "y", "ask", 1.0, 0.1), ("P", "y", "ask", 2.0, 0.2), ("P", "y", "ask", 3.0, 1e17)],
        "pair string, exchange string, side string, price double, vol double",
    )
    held = unlimited(spark, base=5.0)
    paid = 0.1 * 1.0 + 0.2 * 2.0 + (5.0 - (0.1 + 0.2)) * 3.0
    assert one(orderbook.opposing_leg(levels, no_fees(spark), held))["opposing_value"] == pytest.approx(paid, rel=1e-14)
    assert one(orderbook.executable(levels, no_fees(spark), held))["opposing_value"] == pytest.approx(paid, rel=1e-14)


def test_nested_books_explode(spark):
    nested = spark.createDataFrame(
        [("P", "x", [(105.0, 2.0)], [(106.0, 1.0), (107.0, 4.0)])],
        "pair string, exchange string, bids array<struct<price:double,vol:double>>, asks array<struct<price:double,vol:double>>",
    )
    assert [(r["side"], r["level"], r["price"]) for r in rows(orderbook.explode_books(nested), "side", "level")] == [
        ("ask", 0, 106.0), ("ask", 1, 107.0), ("bid", 0, 105.0)
    ]


def test_reserve_conversions(spark):
    sf = 2**60
    df = spark.createDataFrame(
        [(1000, str(500 * sf), str(50 * sf), str(30 * sf), str(20 * sf), 700), (1, str(sf), "0", "0", "0", 0)],
        "available bigint, borrowed_sf string, protocol_fees_sf string, referrer_fees_sf string, pending_fees_sf string, mint_supply bigint",
    )
    ready = onchain.quarantine(df, ["borrowed_sf", "protocol_fees_sf", "referrer_fees_sf", "pending_fees_sf"])
    got = rows(ready.withColumn("rate", onchain.exchange_rate()), F.desc("available"))
    assert [r["rate"] for r in got] == pytest.approx([2.0, 1.0]) and got[0]["quarantined"] is None
    bad = onchain.quarantine(spark.createDataFrame([("9" * 40,)], "borrowed_sf string"), ["borrowed_sf"])
    assert one(bad)["quarantined"] == "borrowed_sf"
    assert spark.range(1).select(onchain.from_raw(F.lit(500000), F.lit(6))).first()[0] == 0.5


def test_obligation_slots_drop_empty_entries(spark):
    df = spark.createDataFrame(
        [("o", [("r", 5), ("r", 0)], [("q", 7)])],
        "obligation string, deposits array<struct<reserve:string,deposited_amount:bigint>>, borrows array<struct<reserve:string,borrowed_amount_sf:bigint>>",
    )
    assert [(r["side"], r["raw"]) for r in rows(onchain.obligation_slots(df), "side")] == [("collateral", 5), ("debt", 7)]


def test_default_universe_is_valid(spark):
    table = universe.default_universe(spark)
    assert universe.violations(table, market_assets(spark)).count() == 0
    assert [r["symbol"] for r in universe.research_symbols(table).collect()] == ["SOL", "JitoSOL", "mSOL", "ETH", "BTC"]
    assert universe.exchange_priced(table).count() == 5
    broken = table.withColumn("exchange_symbol", F.lit(None).cast("string")).withColumn("can_be_borrowed", F.col("symbol") != "BTC")
    got = {(r["symbol"], r["rule"]) for r in universe.violations(broken, market_assets(spark)).collect()}
    assert ("BTC", "not tradable both ways") in got and ("SOL", "missing exchange_symbol") in got


def test_name_matching(spark):
    s = spark.createDataFrame([("r", n) for n in ("static_1.50x", "rv336_boost", "a_b.c", "exact")], "report_id string, name string")
    h = spark.createDataFrame([("r", n) for n in ("highest_return", "high_sortino", "abc_full", "exact")], "report_id string, name string")
    got = {r["label"]: r["history_name"] for r in reports.match_histories(s, h).collect()}
    assert {k: got[k] for k in ("static_1.50x", "rv336_boost", "a_b.c", "exact")} == {"static_1.50x": "highest_return", "rv336_boost": "high_sortino", "a_b.c": "abc_full", "exact": "exact"}


def _claims_plain(summary, histories):
    """Free histories first, then all; own name, role, then the first that contains or is contained."""

    def match(name, names):
        low = name.lower()
        wishes = [name] + ["highest_return"] * ("static" in low or "highest_return" in low) + ["high_sortino"] * ("sortino" in low or low.startswith("rv"))
        small = lambda x: x.lower().replace("_", "").replace(".", "")
        near = [x for x in names if small(x) in small(name) or small(name) in small(x)]
        return next((x for x in [w for w in wishes if w in names] + near), None)

    out, free = {}, list(histories)
    for name in summary:
        got = match(name, free) or match(name, histories)
        if got is not None:
            out[name] = got
            free = [x for x in free if x != got]
    return {**{x: x for x in histories}, **out}


def test_histories_are_handed_out_in_order(spark):
    import random

    rng = random.Random(3)
    pieces = ["a", "ab", "b_c", "ABC", "x.y", "static", "rv", "sortino", "", "long_name"]
    name = lambda: "_".join(rng.choice(pieces) for _ in range(rng.randint(1, 3)))
    reports_ = {f"r{i}": ([name() for _ in range(rng.randint(0, 12))], list(dict.fromkeys([name() for _ in range(rng.randint(0, 8))] + ["highest_return"] * (i % 2)))) for i in range(25)}
    frame = lambda k: spark.createDataFrame([(r, n, p) for r, x in reports_.items() for p, n in enumerate(x[k])], "report_id string, name string, place int").repartition(3)
    got = {}
    for r in reports.match_histories(frame(0), frame(1)).collect():
        got.setdefault(r["report_id"], {})[r["label"]] = r["history_name"]
    assert got == {r: c for r, x in reports_.items() if (c := _claims_plain(*x))}


def test_timeline_counts_unpriced_bars_as_previous(spark):
    data = [("r", hour(0), None, 1.0, 0.0, "SOL", 0), ("r", hour(1), 10.0, 1.5, 0.05, "ETH", 2), ("r", hour(2), 10.0, 1.5, 0.05, "ETH", 2)]
    df = spark.createDataFrame(data, "run_id string, ts timestamp, sol_price double, target_long_fraction double, target_short_fraction double, selected_long string, liquidation_count bigint")
    got = [r["event_family"] for r in rows(reports.timeline(df), "ts", "event_no")]
    assert got == ["rotation", "buy", "short", "liquidation"]


def test_evenly_spaced_matches_linspace(spark):
    df = spark.createDataFrame([("r", hour(i), i) for i in range(37)], "run_id string, ts timestamp, i int")
    got = [r["i"] for r in rows(reports.evenly_spaced(df, 10), "i")]
    assert got == [int(j * 36 / 9) for j in range(10)]
    assert reports.every_kth(df, 10).count() == 13


def test_candle_csv_takes_the_last_file(spark, tmp_path):
    for name, close in (("SOL_USDT_1h_1.csv", 1.0), ("SOL_USDT_1h_2.csv", 2.0), ("ETH_USDT_1h_1.csv", 3.0)):
        (tmp_path / name).write_text(f"timestamp,open,high,low,close,volume\n2024-01-01 00:00:00,1,1,1,{close},1\n2024-01-01 01:00:00+00:00,1,1,1,{close},1\n")
    df = files.read_candles(spark, f"{tmp_path}/*.csv", latest_file_only=True)
    assert [(r["symbol"], r["ts"].hour, r["close"]) for r in rows(df, "symbol", "ts")] == [("ETH", 0, 3.0), ("ETH", 1, 3.0), ("SOL", 0, 2.0), ("SOL", 1, 2.0)]


def test_account_json(spark, tmp_path):
    doc = {
        "collateral": [{"symbol": "SOL", "amount": 10, "price": 150, "ltv": 0.6, "liquidation_threshold": 0.7}],
        "debt": [{"symbol": "USDC", "amount": 900, "price": 1, "borrow_factor": 9}],
        "actions": [{"type": "borrow", "symbol": "USDC", "amount": 100}, {"type": "update_price", "symbol": "SOL", "price": 130}],
    }
    (tmp_path / "acc.json").write_text(json.dumps(doc, indent=1))
    positions, actions = files.read_accounts(spark, str(tmp_path / "acc.json"), multi_line=True)
    got = rows(positions, "side")
    assert [(r["account_id"], r["symbol"], r["borrow_factor"]) for r in got] == [("acc", "SOL", 1.0), ("acc", "USDC", 1.0)]
    assert [(r["action_no"], r["type"], r["amount"]) for r in rows(actions, "action_no")] == [(0, "borrow", 100.0), (1, "update_price", 0.0)]


def test_funding_and_marks(spark, tmp_path):
    (tmp_path / "f.csv").write_text("timestamp,funding_rate\n2024-01-01 01:00:00,0.5\n")
    (tmp_path / "m.csv").write_text("timestamp,mark_price\n2024-01-01 00:30:00,7\n")
    base = spark.createDataFrame([(hour(h),) for h in range(3)], "ts timestamp")
    assert [r["funding_rate"] for r in rows(files.attach_funding(base, files.read_funding(spark, str(tmp_path / "f.csv"))), "ts")] == [0.0, 0.5, 0.0]
    assert [r["mark_price"] for r in rows(files.attach_marks(base, files.read_marks(spark, str(tmp_path / "m.csv"))), "ts")] == [None, 7.0, 7.0]
    with pytest.raises(ValueError):
        files.read_funding(spark, str(tmp_path / "m.csv"))


def test_report_bundle_and_sinks(spark, tmp_path):
    rep = tmp_path / "rep1"
    rep.mkdir()
    (rep / "summary.csv").write_text("name,final_value,extra\na,1.5,z\n")
    (rep / "best_history.csv").write_text("timestamp,portfolio_value\n2024-01-01 00:00:00,10\n")
    got = files.read_report_bundle(
        spark, str(tmp_path), "report_id string, name string, final_value double, missing double", "report_id string, name string",
        "report_id string, name string, ts timestamp, portfolio_value double",
    )
    assert one(got["summary"]) == {"report_id": "rep1", "name": "a", "final_value": 1.5, "missing": None}
    assert one(got["histories"])["name"] == "best" and got["regimes"].count() == 0
    out = str(tmp_path / "out")
    files.write_table(spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, v int"), out, "parquet", ["run_id"])
    assert spark.read.parquet(out).filter("run_id = 'r2'").first()["v"] == 2


def test_sinks_can_be_written_again(spark, tmp_path):
    frame = lambda data: spark.createDataFrame(data, "run_id string, v int")
    failing = frame([("r1", 9), ("r2", 9)]).withColumn("v", F.when(F.col("run_id") == "r2", F.raise_error("no")).otherwise(F.col("v")).cast("int"))
    for fmt, keys in (("parquet", ["run_id"]), ("csv", ["run_id"]), ("parquet", []), ("csv", []), ("json", [])):
        path = tmp_path / f"{fmt}{len(keys)}" / "table"
        read = lambda: sorted((r.run_id, r.v) for r in spark.read.format(fmt).option("header", True).schema("run_id string, v int").load(str(path)).collect())  # noqa: B023, E731
        files.write_table(frame([("r1", 1), ("r2", 2), ("r2", 3)]), str(path), fmt, keys)
        files.write_table(frame([("r1", 4)]), str(path), fmt, keys)
        want = [("r1", 4), ("r2", 2), ("r2", 3)] if keys else [("r1", 4)]
        assert read() == want
        with pytest.raises(Exception, match="no"):
            files.write_table(failing, str(path), fmt, keys)
        assert read() == want and [x.name for x in path.parent.iterdir()] == ["table"]
        files.write_table(frame([]), str(path), fmt, keys)
        assert read() == (want if keys else [])


def test_streamed_bars_equal_batch(spark, tmp_path):
    # two ticks of one instant: the later number closes the first bar, and comes first in the file
    data = [("A", hour(0.75), 3.5, 1.0, 100)] + [("A", hour(i / 4), float(i), 1.0, i) for i in range(40)]
    ticks = spark.createDataFrame(data, "symbol string, ts timestamp, price double, size double, seq bigint")
    src = str(tmp_path / "ticks")
    ticks.coalesce(1).write.parquet(src)
    stream = stream_bars(spark.readStream.schema(ticks.schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = rows(spark.table("bars_out"), "ts")
    finally:
        q.stop()
    assert [(r["open"], r["close"]) for r in got][:3] == [(0.0, 3.5), (4.0, 7.0), (8.0, 11.0)]
    assert len(got) == 7  # bars whose end the watermark (last tick - 2 h) has passed


def test_sweep_and_perp_sinks(spark, tmp_path):
    table = spark.createDataFrame(
        [("a", "f", True, True, 10.0, 5.0), ("b", "f", False, True, 8.0, 9.0), ("c", "g", False, False, 3.0, 1.0)],
        "scenario string, family string, valid boolean, near_valid boolean, max_drawdown_pct double, final_sol_equiv double",
    )
    files.write_sweep_tables(table, str(tmp_path / "sweep"))
    count = lambda name: spark.read.option("header", True).csv(str(tmp_path / "sweep" / name)).count()
    assert [count(n) for n in ("summary", "valid_configs", "near_valid_configs", "family_best")] == [3, 1, 2, 2]
    files.write_perp_report(table, table.withColumn("run_id", F.col("family")), table.limit(1), str(tmp_path / "perp"))
    assert spark.read.json(str(tmp_path / "perp" / "summary")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "perp" / "history")).filter("run_id = 'f'").count() == 2


def test_reports_and_candles_go_by_their_headers(spark, tmp_path):
    from quaymark.sources.files import read_candles, read_report_bundle

    for name, text in (("a", "name,max_drawdown_pct,final_portfolio_value_usd\nx,20.0,1000.0\n"), ("b", "name,final_portfolio_value_usd,max_drawdown_pct\ny,2000.0,30.0\n"), ("c", "name,final_portfolio_value_usd\nz,5.0\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary.csv").write_text(text)
    schema = "report_id string, name string, final_portfolio_value_usd double, max_drawdown_pct double"
    found = read_report_bundle(spark, str(tmp_path), schema, schema, schema)["summary"]
    got = {r.name: (r.final_portfolio_value_usd, r.max_drawdown_pct) for r in found.collect()}
    assert got == {"x": (1000.0, 20.0), "y": (2000.0, 30.0), "z": (5.0, None)}
    (tmp_path / "SOL_USDT_1h_x.csv").write_text("timestamp,close,open,high,low,volume\n2024-01-01 00:00:00,4,1,5,0.5,9\n")
    row = read_candles(spark, str(tmp_path / "*.csv")).first()
    assert (row.symbol, row.open, row.high, row.low, row.close, row.volume) == ("SOL", 1.0, 5.0, 0.5, 4.0, 9.0)


def test_unlisted_exchanges_have_no_fees(spark):
    from quaymark.operators.orderbook import quotes, with_fees

    levels = spark.createDataFrame([("p", "known", "bid", 0, 10.0, 1.0), ("p", "other", "ask", 0, 9.0, 1.0)], "pair string, exchange string, side string, level int, price double, vol double")
    fees = spark.createDataFrame([("known", 0.1, 0.2)], "exchange string, maker double, taker double")
    assert {r.exchange: r.price_inc_fee for r in with_fees(levels, fees).collect()} == {"known": 8.0, "other": 9.0}
    assert {r.exchange for r in quotes(levels, fees).collect()} == {"known", "other"}


def test_history_matching_sends_no_rows_to_the_driver(spark):
    """Pieces of names are many times the rows that a file's size tells of, so no join may broadcast; equal names are compared once."""
    s = spark.range(400).selectExpr("id % 2 AS report_id", "concat('static_', id % 5, '_x') AS name", "id AS place")
    h = spark.createDataFrame([(0, "2_X", 1), (1, "2.x", 1), (1, "static_3_x_long", 2)], "report_id bigint, name string, place bigint")
    out = reports.match_histories(s, h)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    got = {(r.report_id, r.label): r.history_name for r in out.collect()}
    assert got == {(0, "static_2_x"): "2_X", (1, "static_2_x"): "2.x", (1, "static_3_x"): "static_3_x_long",
                   (0, "2_X"): "2_X", (1, "2.x"): "2.x", (1, "static_3_x_long"): "static_3_x_long"}
