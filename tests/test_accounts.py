import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import hour, one, rows
from quaymark.operators import ledger, liquidation, perp, rebalance, risk

POS = (
    "account_id bigint, pos_no bigint, side string, symbol string, amount double, price double, ltv double, "
    "liq_threshold double, borrow_factor double"
)
ACTIONS = "account_id bigint, ts timestamp, action_no bigint, type string, symbol string, amount double, price double"


def account(spark, *extra):
    base = [
        (1, 1, "collateral", "SOL", 10.0, 150.0, 0.65, 0.75, 1.0),
        (1, 2, "debt", "USDC", 500.0, 1.0, 0.0, 0.0, 1.0),
    ]
    return spark.createDataFrame(base + list(extra), POS)


def test_report_golden(spark):
    got = one(risk.account_report(account(spark)))
    assert got["collateral_value"] == 1500 and got["borrow_limit"] == 975 and got["liquidation_value"] == 1125
    assert got["health_factor"] == pytest.approx(1.95) and got["liquidation_health_factor"] == pytest.approx(2.25)
    assert got["liquidation_buffer"] == 625


def test_borrow_factor_weighs_health_but_not_the_buffer(spark):
    pos = account(spark).withColumn("borrow_factor", F.lit(1.2))
    got = one(risk.account_report(pos))
    assert got["health_factor"] == pytest.approx(975 / 600) and got["liquidation_buffer"] == 625


def test_empty_sides_are_infinite_or_zero(spark):
    only_debt = one(risk.account_report(account(spark).filter("side = 'debt'")))
    assert only_debt["current_ltv"] == math.inf and only_debt["liquidation_ltv"] == 0.0
    assert one(risk.account_report(account(spark).filter("side = 'collateral'")))["health_factor"] == math.inf


def test_liquidation_prices(spark):
    got = {(r["side"], r["symbol"]): r["liquidation_price"] for r in rows(risk.liquidation_prices(account(spark)))}
    assert got[("collateral", "SOL")] == pytest.approx(500 / 7.5) and got[("debt", "USDC")] == pytest.approx(2.25)
    rich = account(spark, (1, 3, "collateral", "ETH", 10.0, 1000.0, 0.8, 0.8, 1.0), (1, 4, "collateral", "BTC", 0.0, 9.0, 0.8, 0.8, 1.0))
    got = {r["symbol"]: r["liquidation_price"] for r in rows(risk.liquidation_prices(rich))}
    assert got["SOL"] == 0.0 and got["BTC"] is None


def test_stress_moves_leave_stablecoins_alone(spark):
    got = {r["scenario_id"]: r for r in rows(risk.stress_grid(account(spark), {"down": -0.5, "fix": 0.3}, {("fix", "SOL"): 100.0}))}
    assert got["down"]["collateral_value"] == 750 and got["down"]["debt_value"] == 500
    assert got["fix"]["collateral_value"] == 1000


def test_stress_values_are_those_of_moved_prices_to_the_last_bit(spark):
    columns = account(spark).columns
    row = account(spark).filter("side = 'collateral'").limit(1)
    terms = [(0.1 * k + 7.3, 913.37 + 1.01 * k, 0.61 + 0.01 * (k % 9), 0.67 + 0.01 * (k % 7)) for k in range(50)]
    many = row.drop("account_id", "amount", "price", "ltv", "liq_threshold", "symbol").crossJoin(
        spark.createDataFrame([(k, "SOL", *t) for k, t in enumerate(terms)], "account_id long, symbol string, amount double, price double, ltv double, liq_threshold double")
    ).select(columns)
    got = {r["account_id"]: r for r in rows(risk.stress_grid(many, {"p20": 0.2}))}
    for k, (amount, price, ltv, threshold) in enumerate(terms):
        moved = amount * (price * (1.0 + 0.2))
        assert (got[k]["collateral_value"], got[k]["borrow_limit"], got[k]["liquidation_value"]) == (moved, moved * ltv, moved * threshold)


def test_action_batch_and_what_if(spark):
    acts = spark.createDataFrame(
        [(1, hour(0), 1, "borrow", "USDC", 100.0, None), (1, hour(0), 2, "set_price", "SOL", 0.0, 140.0),
         (1, hour(0), 3, "update_price", "SOL", 0.0, 130.0), (1, hour(0), 4, "withdraw_collateral", "SOL", 12.0, None)], ACTIONS,
    )
    after = risk.apply_actions(account(spark), acts)
    got = {r["symbol"]: r for r in rows(after)}
    assert got["USDC"]["amount"] == 600 and got["SOL"]["price"] == 130 and got["SOL"]["amount"] == -2.0
    delta = one(risk.scenario_deltas(after))
    assert delta["band"] == "liquidation" and delta["delta_borrow_limit"] == pytest.approx(-2 * 130 * 0.65 - 975)


def test_actions_are_added_up_in_their_order(spark):
    # 0.3, 0.2, 0.1 make 0.6; from the other end they make 0.6000000000000001
    debt = account(spark).filter("side = 'debt'").withColumn("amount", F.lit(0.6))
    acts = [(1, hour(0), k, "repay", "USDC", x, None) for k, x in ((3, 0.1), (2, 0.2), (1, 0.3))]
    after = risk.apply_actions(debt, spark.createDataFrame(acts, ACTIONS).coalesce(1))
    assert one(after)["amount"] == 0.0
    assert one(risk.scenario_deltas(after))["band"] == "safe"
    acts[0] = (*acts[0][:5], math.nan, None)
    assert math.isnan(one(risk.apply_actions(debt, spark.createDataFrame(acts, ACTIONS)))["amount"])


def test_actions_of_one_number_all_count(spark):
    acts = spark.createDataFrame([(1, hour(0), 5, "borrow", "USDC", 1.0, None)] * 9, ACTIONS)
    assert one(risk.apply_actions(account(spark).filter("side = 'debt'"), acts))["amount"] == 509.0


def test_deltas_start_from_the_opening_positions_to_the_last_bit(spark):
    lines = [(1, k, "collateral", "SOL", 7.0 + 2 * k, 913.37 + 4.04 * k, 0.61 + 0.01 * k, 0.7, 1.0) for k in range(3)]
    opening = spark.createDataFrame(lines, account(spark).schema).coalesce(1)
    net = risk.net_positions(opening)
    limit = 0.0
    for r in lines:
        limit += r[4] * r[5] * r[6]
    n = one(net)
    after = risk.apply_actions(net, spark.createDataFrame([], ACTIONS))
    assert n["amount"] * n["price"] * n["ltv"] != limit
    assert one(risk.scenario_deltas(after, opening))["delta_borrow_limit"] == n["amount"] * n["price"] * n["ltv"] - limit


def test_action_errors(spark):
    acts = spark.createDataFrame(
        [(1, hour(0), 1, "borrow", "SOL", 1.0, None), (1, hour(0), 2, "deposit_collateral", "USDC", 1.0, None),
         (1, hour(0), 3, "set_price", "XYZ", 0.0, 1.0), (1, hour(0), 4, "set_price", "SOL", 0.0, None), (1, hour(0), 5, "burn", "SOL", 1.0, None),
         (1, hour(0), 6, "repay", "USDC", 1.0, None)], ACTIONS,
    )
    got = {r["action_no"]: r["error"] for r in rows(risk.action_errors(account(spark), acts))}
    assert got == {
        1: "debt asset not found", 2: "collateral asset not found", 3: "asset not found", 4: "price required", 5: "unknown action type"
    }


def test_recovery_restores_the_target(spark):
    pos = account(spark, (1, 3, "debt", "ETH", 1.0, 400.0, 0.0, 0.0, 1.0))
    got = {(r["option"], r["collateral_symbol"], r["debt_symbol"]): r for r in rows(risk.recovery_options(pos, 1.2))}
    assert len(got) == 5
    pay = 900 - 975 / 1.2
    assert got[("A", None, "USDC")]["debt_tokens"] == pytest.approx(pay)
    added = got[("C", "SOL", None)]["collateral_tokens"]
    assert (10 + added) * 150 * 0.65 / 900 == pytest.approx(1.2)
    sold = got[("B", "SOL", "USDC")]["collateral_tokens"]
    assert (10 - sold) * 150 * 0.65 / (900 - sold * 150) == pytest.approx(1.2)


def test_healthy_accounts_need_no_recovery(spark):
    assert risk.recovery_options(account(spark)).count() == 0


def test_leverage_loops_equal_the_rounds(spark):
    got = one(risk.leverage_loops(account(spark), [("x", 4, 0.85)]))
    amount, owed = 10.0, 0.0
    for _ in range(4):
        free = (amount * 150 * 0.65 - owed) * 0.85
        owed += free
        amount += free / 150
    assert got["borrowed_usd"] == pytest.approx(owed) and got["final_amount"] == pytest.approx(amount)


def sequential_waves(positions, market, waves=5):
    """Waves replayed position by position for one account."""
    pos, out = [dict(p) for p in positions], []
    for wave in range(1, waves + 1):
        coll = [p for p in pos if p["side"] == "collateral"]
        debt = [p for p in pos if p["side"] == "debt"]
        value = lambda p: p["amount"] * p["price"]
        risk_debt = sum(value(p) * p["borrow_factor"] for p in debt)
        liq = sum(value(p) * p["liq_threshold"] for p in coll)
        if risk_debt == 0 or liq / risk_debt >= 1 or not [p for p in coll if p["amount"] > 0]:
            break
        d = max((p for p in debt if p["amount"] > 0), key=lambda p: (market.get(p["symbol"], (0, 0, 0, 0))[3], -p["pos_no"]))
        c = min((p for p in coll if p["amount"] > 0), key=lambda p: (market.get(p["symbol"], (1.0, 0, 0, 0))[0], p["pos_no"]))
        thr, low, high, _ = market.get(c["symbol"], (0.8, 200, 1000, 0))
        repaid = min(sum(map(value, debt)) * 0.2 / d["price"], d["amount"])
        ltv = sum(map(value, debt)) / sum(map(value, coll))
        bonus = low if ltv <= thr else low + min((ltv - thr) / (1 - thr), 1) * (high - low)
        seized = min(repaid * d["price"] * (1 + bonus / 1e4) / c["price"], c["amount"])
        d["amount"] -= repaid
        c["amount"] -= seized
        out.append((wave, d["symbol"], repaid, c["symbol"], seized))
    return out


def test_waves_equal_the_sequential_replay(spark):
    rng = random.Random(5)
    market = {"SOL": (0.80, 200, 1000, 1.0), "USDC": (0.93, 200, 500, 1.053), "ETH": (0.83, 200, 1000, 1.0)}
    data = []
    for acc in range(40):
        for n in range(rng.randint(3, 14)):
            side = rng.choice(["collateral", "debt"])
            data.append((acc, n, side, rng.choice(["SOL", "USDC", "ETH", "UNK"]), rng.uniform(0, 5), rng.uniform(1, 50), 0.7, 0.8, 1.0))
    got = rows(liquidation.liquidation_waves(spark.createDataFrame(data, POS), liquidation.market_assets(spark)), "account_id", "wave")
    want = []
    names = POS.replace(",", "").split()[0::2]
    for acc in range(40):
        mine = [dict(zip(names, r)) for r in data if r[0] == acc]
        if any(p["side"] == "debt" for p in mine):
            want += [(acc, *e) for e in sequential_waves(mine, market)]
    assert len(got) == len(want) > 20
    for g, w in zip(got, want):
        assert (g["account_id"], g["wave"], g["debt_symbol"], g["collateral_symbol"]) == (w[0], w[1], w[2], w[4])
        assert g["debt_repaid"] == pytest.approx(w[3]) and g["collateral_seized"] == pytest.approx(w[5])


def trades(spark, data):
    return spark.createDataFrame(
        [(1, "ETH", hour(i * 7), i, o, a, u) for i, (o, a, u) in enumerate(data)],
        "account_id bigint, symbol string, ts timestamp, action_no bigint, is_open boolean, amount double, usdc double",
    )


def test_short_ledger_golden(spark):
    got = rows(ledger.short_ledger(trades(spark, [(True, 2.0, 4000.0), (True, 2.0, 6000.0), (False, 1.0, 2000.0), (False, 5.0, 5000.0), (False, 1.0, 1.0)])), "action_no")
    assert [r["open_amount"] for r in got] == [2.0, 4.0, 3.0, 0.0, 0.0]
    assert [r["average_basis"] for r in got] == [2000.0, 2500.0, 2500.0, 0.0, 0.0]
    assert [r["realized_pnl"] for r in got] == pytest.approx([0, 0, 500.0, 3 * 2500 - 5000 * 3 / 5, 0])
    assert got[-1]["lifetime_realized"] == pytest.approx(5000.0) and got[-1]["protected_book"] == pytest.approx(1250.0)


def test_perp_entries_golden(spark):
    data = [(2.0, 100.0), (2.0, 200.0), (-1.0, 300.0), (-5.0, 120.0), (2.0, 90.0)]
    df = spark.createDataFrame(
        [(1, "BTC", hour(i * 13), i, q, p) for i, (q, p) in enumerate(data)],
        "account_id bigint, symbol string, ts timestamp, action_no bigint, delta_quantity double, price double",
    )
    got = rows(ledger.perp_entries(df), "action_no")
    assert [r["quantity"] for r in got] == [2.0, 4.0, 3.0, -2.0, 0.0]
    assert [r["average_entry"] for r in got] == pytest.approx([100.0, 150.0, 150.0, 120.0, 0.0])
    assert [r["pnl"] for r in got] == pytest.approx([0.0, 200.0, 400.0, -540.0, 60.0])


def test_interest_equals_the_hourly_loop(spark):
    moves = {0: 100.0, 5: -20.0, 30: 50.0}
    df = spark.createDataFrame(
        [(1, "USDC", h, hour(h), d, 1.0) for h, d in moves.items()],
        "account_id bigint, symbol string, bar bigint, ts timestamp, delta double, price double",
    )
    got = {r["bar"]: r for r in rows(ledger.interest_balances(df, F.lit(0.08)))}
    balance, r = 0.0, 0.08 / 8760
    for h in range(31):
        interest = balance * r
        balance += interest + moves.get(h, 0.0)
        if h in moves:
            assert got[h]["balance"] == pytest.approx(balance) and got[h]["interest"] == pytest.approx(interest)


def test_latch_prefers_entering(spark):
    df = spark.createDataFrame([("k", i, a, b) for i, (a, b) in enumerate([(0, 0), (1, 0), (0, 0), (0, 1), (1, 1), (0, 0)])], "k string, i int, a int, b int")
    got = rows(ledger.latch(df, ["k"], ["i"], F.col("a") == 1, F.col("b") == 1), "i")
    assert [r["active"] for r in got] == [False, True, True, False, True, True]


def test_order_rounding(spark):
    df = spark.createDataFrame([(123.456,), (-123.456,), (9.99,), (0.0,)], "n double")
    out = perp.round_order(F.col("n"), F.lit(100.0), F.lit(0.01), F.lit(10.0))
    assert [r["o"] for r in df.withColumn("o", out).collect()] == pytest.approx([123.0, -123.0, 0.0, 0.0])


def test_exit_reasons(spark):
    df = spark.createDataFrame([(90.0, 1.0), (130.0, 1.0), (111.0, -1.0), (79.0, -1.0), (100.0, 1.0), (50.0, 0.0)], "p double, q double")
    out = perp.exit_reason(F.col("p"), F.col("q"), F.lit(100.0), 0.1, 0.2)
    assert [r["x"] for r in df.withColumn("x", out).collect()] == ["stop_loss", "take_profit", "stop_loss", "take_profit", "", ""]


def test_exposure_curve(spark):
    df = spark.createDataFrame([("r", hour(i), p, s) for i, (p, s) in enumerate([(100.0, 1.0), (110.0, -1.0), (99.0, 0.0), (50.0, 1.0)])], "run_id string, ts timestamp, price double, exposure double")
    assert [r["equity"] for r in rows(perp.exposure_curve(df), "ts")] == pytest.approx([10_000, 11_000, 12_100, 12_100])


def test_long_plan_buys_then_borrows_and_sells_repay(spark):
    net = spark.createDataFrame(
        [(1, 1, "collateral", "USDC", 100.0, 1.0, 0.9, 0.93, 1.0), (1, 2, "collateral", "SOL", 1.0, 100.0, 0.7, 0.8, 1.0),
         (1, 3, "collateral", "ETH", 2.0, 100.0, 0.7, 0.8, 1.0), (1, 4, "debt", "USDC", 50.0, 1.0, 0.0, 0.0, 1.0)], POS,
    )
    legs = spark.createDataFrame([(1, "SOL", 400.0, 10.0)], "account_id bigint, selected_long string, target_usd double, threshold_usd double")
    got = [(r["position"], r["type"], r["symbol"], r["amount"]) for r in rows(rebalance.long_plan(net, legs, ["SOL", "ETH"], 0.0), "position", "step")]
    assert got == [
        ("ETH", "withdraw_collateral", "ETH", 2.0), ("ETH", "repay", "USDC", 50.0), ("ETH", "deposit_collateral", "USDC", 150.0),
        ("SOL", "withdraw_collateral", "USDC", 100.0), ("SOL", "deposit_collateral", "SOL", 1.0),
        ("SOL", "borrow", "USDC", 200.0), ("SOL", "deposit_collateral", "SOL", 2.0),
    ]


def test_tiny_positions_are_not_dust(spark):
    from datetime import datetime

    from quaymark.operators import ledger

    at = datetime(2024, 1, 1)
    trades = spark.createDataFrame([("a", "S", at, 0, True, 2e-10, 1.0), ("a", "S", at, 1, False, 1e-10, 0.4)], "account_id string, symbol string, ts timestamp, action_no int, is_open boolean, amount double, usdc double")
    got = {r.action_no: (r.open_amount, r.realized_pnl) for r in ledger.short_ledger(trades).collect()}
    assert got[1][0] == 1e-10 and abs(got[1][1] - 0.1) < 1e-12


def test_accounts_are_marked_with_every_asset(spark):
    from datetime import datetime

    from quaymark.operators import ledger, liquidation

    at = datetime(2024, 1, 1)
    deltas = spark.createDataFrame([("a", "collateral", "SOL", at, 0, 2.0), ("a", "collateral", "NEW", at, 1, 3.0)], "account_id string, side string, symbol string, ts timestamp, action_no int, delta double")
    marks = spark.createDataFrame([("a", at)], "account_id string, ts timestamp")
    prices = spark.createDataFrame([("SOL", at, 10.0), ("NEW", at, 5.0)], "symbol string, ts timestamp, price double")
    row = ledger.mark_to_market(deltas, marks, prices, liquidation.market_assets(spark)).first()
    assert row.collateral_value == 35.0 and row.portfolio_value == 35.0


def test_exit_thresholds_are_products_of_the_entry(spark):
    """A price right at entry * (1 - stop) is a hit, the next one towards the entry isn't."""
    rng = random.Random(7)
    data = []
    for _ in range(100):
        entry = round(rng.uniform(1, 100), 6)
        for factor, quantity, reason in ((0.9, 1.0, "stop_loss"), (1.2, 1.0, "take_profit"), (1.1, -1.0, "stop_loss"), (0.8, -1.0, "take_profit")):
            data += [(entry * factor, quantity, entry, reason), (math.nextafter(entry * factor, entry), quantity, entry, "")]
    df = spark.createDataFrame(data, "p double, q double, e double, want string")
    out = perp.exit_reason(F.col("p"), F.col("q"), F.col("e"), 0.1, 0.2)
    assert df.filter(out != F.col("want")).count() == 0


def _loop_of_shorts(rows_):
    """open_amount and average_basis in plain doubles, row after row."""
    opened, basis, out = 0.0, 0.0, []
    for is_open, amount, usdc in rows_:
        if is_open:
            opened, basis = opened + amount, (opened * basis + usdc) / (opened + amount)
        else:
            opened -= min(amount, opened)
            basis = basis if opened > 0 else 0.0
        out.append((opened, basis))
    return out


def test_short_amounts_are_added_row_by_row(spark):
    """Where covers meet what was opened, the last bits decide whether anything is open: they are those of a plain loop."""
    rng = random.Random(11)
    data, want = [], {}
    for acc in range(60):
        moves = [(True, a / 1000, 30.0 * a / 1000) for a in (rng.randint(1, 9000) for _ in range(3))]
        total = round(sum(m[1] for m in moves) * 1000)
        cut = rng.randint(1, total - 1)
        moves += [(False, cut / 1000, 20.0), (False, (total - cut) / 1000, 20.0)]
        want[acc] = _loop_of_shorts(moves)
        data += [(acc, "SOL", hour(i), i, *m) for i, m in enumerate(moves)]
    df = spark.createDataFrame(data, "account_id bigint, symbol string, ts timestamp, action_no bigint, is_open boolean, amount double, usdc double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = rows(ledger.short_ledger(df), "account_id", "action_no")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    left = [w[-1][0] for w in want.values()]
    assert any(x > 0 for x in left) and any(x == 0 for x in left)
    for r in got:
        opened, basis = want[r["account_id"]][r["action_no"]]
        assert r["open_amount"] == opened and r["average_basis"] == pytest.approx(basis)


def test_perp_quantities_are_added_row_by_row(spark):
    rng = random.Random(12)
    data, want = [], {}
    for acc in range(60):
        q = 0.0
        for i in range(8):
            dq = rng.randint(-9000, 9000) / 1000
            data.append((acc, "BTC", hour(i), i, dq, 10.0))
            want[acc, i] = (q, q := q + dq)
    df = spark.createDataFrame(data, "account_id bigint, symbol string, ts timestamp, action_no bigint, delta_quantity double, price double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {(r["account_id"], r["action_no"]): (r["previous_quantity"], r["quantity"]) for r in ledger.perp_entries(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == want


def test_a_debt_repaid_whole_leaves_no_dust(spark):
    """0.1 + 0.2 - 0.3 of debt is none, so health is infinite."""
    deltas = spark.createDataFrame(
        [("a", "collateral", "SOL", hour(0), 0, 2.0)] + [("a", "debt", "ETH", hour(0), i, d) for i, d in enumerate((0.1, 0.2, -0.3))],
        "account_id string, side string, symbol string, ts timestamp, action_no int, delta double",
    )
    marks = spark.createDataFrame([("a", hour(1))], "account_id string, ts timestamp")
    prices = spark.createDataFrame([("SOL", hour(0), 10.0), ("ETH", hour(0), 5.0)], "symbol string, ts timestamp, price double")
    got = one(ledger.mark_to_market(deltas, marks, prices, liquidation.market_assets(spark)))
    assert got["health_factor"] == math.inf and got["debt_value"] == 0.0


def test_positions_are_ranked_after_the_shuffle(spark):
    """A sort in the scan's tasks grows with the file splits; a large side is ranked in shares, with the same first positions."""
    data = [(a, n, "debt" if n % 2 else "collateral", ("SOL", "USDC", "ETH")[n * 7 % 3], float(n * 31 % 17), 2.0, 0.7, 0.8, 1.0) for a, m in ((1, 600), (2, 3), (3, 40)) for n in range(m)]
    market = liquidation.market_assets(spark)
    queues = liquidation._queues(liquidation.with_market(spark.createDataFrame(data, POS), market), 5)
    lines = queues._jdf.queryExecution().executedPlan().toString().splitlines()
    deepest = lambda word: max(i for i, line in enumerate(lines) if word in line)
    assert deepest("WindowGroupLimit") < deepest("Exchange hashpartitioning(account_id")
    factor, threshold = {"SOL": 1.0, "USDC": 1.053, "ETH": 1.0}, {"SOL": 0.80, "USDC": 0.93, "ETH": 0.83}
    for r in queues.collect():
        for side, got in (("debt", r["__debt"]), ("collateral", r["__collateral"])):
            mine = [d for d in data if d[0] == r["account_id"] and d[2] == side and d[4] > 0]
            mine.sort(key=lambda d: (-factor[d[3]] if d[2] == "debt" else threshold[d[3]], d[1]))
            assert [(x["__r"], x["symbol"], x["amount"]) for x in got] == [(i + 1, d[3], d[4]) for i, d in enumerate(mine[:5])]
