"""Ledgers replayed from action tables.

Actions are raw-volume data and one account may own a third of them, so running values here go
over a range partitioning of (key, time), in one pass each, dependent recurrences included.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.functions.numeric import ratio
from quaymark.operators.asof import backward_asof, enrich
from quaymark.operators.ranged import Affine, Floored, Frame, Last, Spent, Stage, Sum, Values, scanned
from quaymark.operators.risk import report_columns, signed_amount, verb_side
from quaymark.operators.scan import floored, running

ORDER = ("ts", "action_no")
HOURS_PER_YEAR = 8760.0
#: Share of what a key has moved so far that counts as nothing.
DUST = 1e-12


def _snap(c: Column, gross: str) -> Column:
    """Zero where nothing but rounding is left of the amounts moved so far."""
    return F.when(F.abs(c) <= DUST * F.col(gross), 0.0).otherwise(c)


def _snapped(x: np.ndarray, gross: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) <= DUST * gross, 0.0, x)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, and 0 over 0."""
    return np.divide(a, b, out=np.zeros(len(a)), where=b != 0)


def balances(actions: DataFrame) -> DataFrame:
    """Amount of each (account, side, symbol) after every action."""
    return running(signed_deltas(actions), ["account_id", "side", "symbol"], ORDER, {"balance": ("sum", F.col("delta"))}, long=True)


def interest_balances(deltas: DataFrame, apy: Column, hours_per_bar: float = 1.0) -> DataFrame:
    """Debt that grows by apy/8760 per bar before the bar's own change.

    `deltas`: (account_id, symbol, bar BIGINT, ts, delta, price), `bar` counted in
    bars from any origin.  With the index I = (1+r)^bar, balance / I is a plain
    running sum.  `interest` is what accrues in the row's bar.
    """
    r = apy / HOURS_PER_YEAR * hours_per_bar
    index = F.pow(1.0 + r, F.col("bar").cast("double"))
    rows = deltas.withColumn("__scaled", F.col("delta") / index)
    rows = running(rows, ["account_id", "symbol"], ["bar"], {"__before": ("sum", F.col("__scaled"))}, long=True, exclusive=True)
    opening = F.col("__before") * index / (1.0 + r)
    return rows.withColumns(
        {
            "balance": F.col("__before") * index + F.col("delta"),
            "interest": opening * r * F.col("price"),
        }
    ).drop("__scaled", "__before")


def staking_yield(rows: DataFrame, keys: Sequence[str], apy: Column, hours_per_bar: float = 1.0) -> DataFrame:
    """Yield per bar on the previous price; rows are bars of a position."""
    before = F.lag("price").over(W.partitionBy(*keys).orderBy("ts"))
    earned = F.col("amount") * before * apy / HOURS_PER_YEAR * hours_per_bar
    return rows.withColumn("lst_yield", F.coalesce(earned, F.lit(0.0)))


def floored_cash(flows: DataFrame, keys: Sequence[str], flow: str, out: str = "cash_reserve") -> DataFrame:
    """Running cash that never falls below zero."""
    rows = floored(flows, keys, ORDER, F.col(flow), "__level", gross="__gross")
    return rows.withColumn(out, _snap(F.col("__level"), "__gross")).select(*flows.columns, out)


def waterfall(rows: DataFrame, keys: Sequence[str], order: Sequence[str], need: str, budget: Column, long: bool = False) -> DataFrame:
    """Each row takes min(need, what the earlier rows left of the budget)."""
    out = running(rows, keys, order, {"__used": ("sum", F.col(need))}, long, exclusive=True)
    left = F.greatest(F.lit(0.0), budget - F.col("__used"))
    return out.withColumn("taken", F.least(F.col(need), left)).drop("__used")


def _covers(f: Frame) -> Values:
    """What a cover covers, and how the cost basis follows from the one before."""
    opens = f["is_open"].astype(bool)
    return {
        "covered": np.where(opens, 0.0, np.minimum(f["amount"], f["__open0"])),
        "__keep": np.where(opens, 1.0, _share(f["open_amount"], f["__open0"])),
        "__add": np.where(opens, f["usdc"], 0.0),
    }


def _profits(f: Frame) -> Values:
    """Profit of each cover, what of it is protected, and what is left to spend from."""
    covered = f["covered"]
    profit = np.where(covered > 0, covered * _share(f["__cost0"], f["__open0"]) - _share(f["usdc"] * covered, f["amount"]), 0.0)
    return {
        "realized_pnl": profit,
        "__kept": np.maximum(profit, 0.0) * f["__fraction"],
        "average_basis": _share(f["cost_basis"], f["open_amount"]),
    }


def _earned(f: Frame) -> Values:
    return {"__earned": f["lifetime_realized"] - f["protected_book"]}


def _left(f: Frame) -> Values:
    return {"spendable": np.maximum(0.0, f["__earned"] - f["consumed"])}


def short_ledger(trades: DataFrame, protected: float | Column = 0.25, wanted: Column | None = None) -> DataFrame:
    """Average-cost short ledger with realised, protected, consumed and spendable profit.

    `trades`: (account_id, symbol, ts, action_no, is_open, amount, usdc) with
    proceeds on opens and cost on covers.  `protected` is the share of a positive profit that is put
    aside, a number or a column (see `protected_fraction`); `wanted` is what a row asks to spend of the
    profit that is left, after its own trade.  The open amount is a floored running
    sum, added row by row; what rounding leaves of it keeps its basis; the cost basis is affine in its predecessor (opens add, covers scale); spending takes what is
    asked for as far as it is there.  All are stages of one scan over one exchange.
    """
    amount = F.col("amount")
    change = F.when(F.col("is_open"), amount).otherwise(-amount)
    rows = trades.withColumns(
        {
            "__change": change,
            "__fraction": protected if isinstance(protected, Column) else F.lit(float(protected)),
            "__wanted": F.greatest(F.lit(0.0), F.coalesce(wanted, F.lit(0.0))) if wanted is not None else F.lit(0.0),
        }
    )
    stages = [
        Stage((Floored("__change", "open_amount", "__open0"),)),
        Stage((Affine("__keep", "__add", "cost_basis", "__cost0"),), _covers),
        Stage((Sum("realized_pnl", "lifetime_realized"), Sum("__kept", "protected_book")), _profits),
        Stage((Spent("__wanted", "__earned", "consumed", "spent"),), _earned),
        Stage((), _left),
    ]
    outs = ["open_amount", "covered", "cost_basis", "average_basis", "realized_pnl", "lifetime_realized", "protected_book", "consumed", "spent", "spendable"]
    out = scanned(rows, ["account_id", "symbol"], ORDER, stages, dict.fromkeys(outs, "double"))
    return out.select(*trades.columns, *outs)


def protected_fraction(green: Column, fractions: dict[int, float]) -> Column:
    """The protected share of profit by green votes; votes that the table lacks, or no vote, protect nothing."""
    table = F.create_map(*[F.lit(x) for k, v in fractions.items() for x in (int(k), float(v))])
    return F.coalesce(F.try_element_at(table, green.cast("int")), F.lit(0.0))


def spendable(lifetime: Column, consumed: Column, protected: Column) -> Column:
    return F.greatest(F.lit(0.0), lifetime - consumed - protected)


def _positions(f: Frame) -> Values:
    """Quantities before and after a trade, its price profit, and how the entry's cost follows from the one before."""
    dq, price = f["delta_quantity"].astype(float), f["price"].astype(float)
    q0, q = _snapped(f["__q0"], f["__gross0"]), _snapped(f["__q"], f["__gross"])
    fresh, adding = q0 * q <= 0, np.sign(q0) == np.sign(dq)
    moved = np.abs(q), np.abs(q0)
    return {
        "previous_quantity": q0,
        "quantity": q,
        "pnl": np.nan_to_num(q0 * (price - f["__last"].to_numpy(zero_copy_only=False).astype(float))),
        "__keep": np.where(fresh, 0.0, np.where(adding, 1.0, _share(*moved))),
        "__add": np.where(fresh, moved[0] * price, np.where(adding, np.abs(dq) * price, 0.0)),
    }


def _entry(f: Frame) -> Values:
    return {"average_entry": _share(f["__basis"], np.abs(f["quantity"]))}


def perp_entries(trades: DataFrame) -> DataFrame:
    """Signed quantity, average entry and price PnL of each trade: (…, delta_quantity, price).

    Adding averages, reducing keeps the entry, opening or flipping restarts it at
    the trade price.  `pnl` is the quantity before the trade times the price move
    since the previous one.
    """
    rows = trades.withColumns({"__price": F.col("price").cast("double"), "__size": F.abs("delta_quantity"), "__priced": F.col("price").isNotNull()})
    stages = [
        Stage((Sum("delta_quantity", "__q"), Sum("delta_quantity", "__q0", True), Sum("__size", "__gross"), Sum("__size", "__gross0", True), Last("__priced", ("__price",), ("__last",), before=True))),
        Stage((Affine("__keep", "__add", "__basis", "__basis0"),), _positions),
        Stage((), _entry),
    ]
    outs = ["quantity", "pnl", "previous_quantity", "average_entry"]
    out = scanned(rows, ["account_id", "symbol"], ORDER, stages, dict.fromkeys(outs, "double"))
    return out.select(*trades.columns, *outs)


def signed_deltas(actions: DataFrame) -> DataFrame:
    """Amount changes of each (account, side, symbol)."""
    return actions.withColumns({"side": verb_side(), "delta": signed_amount()}).filter("side IS NOT NULL")


def mark_to_market(deltas: DataFrame, marks: DataFrame, prices: DataFrame, market: DataFrame) -> DataFrame:
    """Account report at each mark time from replayed balances and as-of prices.

    `marks`: (account_id, ts).  Each mark joins the ledger of every asset side
    that its account ever moved as a zero change, so one running sum replays and
    looks up at once; what rounding leaves of a balance that was moved out whole is nothing.  Assets that the market lacks have no loan value, no
    threshold and a borrow factor of 1; without a price they are worth nothing.
    """
    keys = ["account_id", "side", "symbol"]
    slots = deltas.select(*keys).distinct()
    grid = marks.join(slots, "account_id").select(*keys, "ts", F.lit(1).alias("__mark"), F.lit(0.0).alias("delta"))
    moves = deltas.select(*keys, "ts", F.lit(0).alias("__mark"), "delta")
    held = running(
        moves.unionByName(grid), keys, ["ts", "__mark"],
        {"balance": ("sum", F.col("delta")), "__moves": ("sum", 1.0 - F.col("__mark")), "__gross": ("sum", F.abs("delta"))}, long=True,
    ).withColumn("balance", _snap(F.col("balance"), "__gross"))
    held = held.filter("__mark = 1 AND __moves > 0").select(*keys, "ts", "balance")
    priced = backward_asof(held, prices, ["symbol"], ["price"])
    coll = F.col("side") == "collateral"
    unknown = {"m_ltv": 0.0, "m_threshold": 0.0, "m_borrow_factor": 1.0}
    terms = enrich(priced, market, "symbol", unknown).withColumn("value", F.col("balance") * F.col("price"))
    v = F.coalesce(F.col("value"), F.lit(0.0))
    report = terms.groupBy("account_id", "ts").agg(
        F.sum(F.when(coll, v).otherwise(0.0)).alias("collateral_value"),
        F.sum(F.when(coll, 0.0).otherwise(v)).alias("debt_value"),
        F.sum(F.when(coll, v * F.col("m_ltv")).otherwise(0.0)).alias("borrow_limit"),
        F.sum(F.when(coll, v * F.col("m_threshold")).otherwise(0.0)).alias("liquidation_value"),
        F.sum(F.when(coll, 0.0).otherwise(v * F.col("m_borrow_factor"))).alias("risk_debt"),
    )
    cols = [F.col(c) for c in ("collateral_value", "debt_value", "borrow_limit", "liquidation_value", "risk_debt")]
    return report.withColumns(
        {**report_columns(*cols), "portfolio_value": F.col("collateral_value") - F.col("debt_value")}
    )


def latch(rows: DataFrame, keys: Sequence[str], order: Sequence[str], enter: Column, leave: Column,
          out: str = "active", long: bool = True) -> DataFrame:
    """On at `enter`, off at `leave`, else unchanged; entering wins."""
    event = F.when(enter, 1).when(leave, 0)
    done = running(rows.withColumn("__e", event), keys, order, {"__on": ("last", F.col("__e"))}, long)
    return done.withColumn(out, F.coalesce(F.col("__on") == 1, F.lit(False))).drop("__e", "__on")


def equity_triggers(
    history: DataFrame,
    window: int = 90 * 24,
    lock_lookback: int = 90 * 24,
    lock_gain: float = 0.25,
    lock_drawdown: float = 0.10,
    lock_near_high: float = 0.0,
    lock_exit_gap: float = 0.02,
    containment: tuple[float, float] = (0.20, 0.10),
    crisis: tuple[float, float, float] = (0.25, 0.25, 0.20),
    crisis_ready: int = 90 * 24,
    cppi: tuple[float, float, float] = (1.5, 0.65, 2.0),
) -> DataFrame:
    """Trigger flags of an equity history: (run_id, ts, portfolio_value, price, green, bearish_*).

    Both rolling highs share one window.  Rows are bars of a run, so the frames
    are bounded and share one sort.
    """
    path = W.partitionBy("run_id").orderBy("ts")
    tail = path.rowsBetween(-(window - 1), 0)
    lock = path.rowsBetween(-(lock_lookback - 1), 0)
    upto = path.rowsBetween(W.unboundedPreceding, 0)
    v, p = F.col("portfolio_value"), F.col("price")
    rows = history.withColumn("sol_equivalent", ratio(v, p, 0.0))
    rows = rows.withColumns(
        {
            "__peak": F.max(v).over(tail),
            "__sol_peak": F.max("sol_equivalent").over(tail),
            "__price_peak": F.max(p).over(tail),
            "__lock_peak": F.max(v).over(lock),
            "__initial": F.first(v).over(upto),
            "high_watermark": F.max(v).over(upto),
            "__bars": F.row_number().over(path),
        }
    )
    fall = lambda peak, now: F.greatest(F.lit(0.0), ratio(F.col(peak) - now, F.col(peak), 0.0))
    rows = rows.withColumns(
        {
            "portfolio_drawdown": fall("__peak", v),
            "sol_drawdown": fall("__sol_peak", F.col("sol_equivalent")),
            "__price_drawdown": fall("__price_peak", p),
            "__lock_drawdown": fall("__lock_peak", v),
        }
    )
    weak = (F.col("green") <= 2) | F.col("bearish_1d")
    gained = ratio(F.col("__lock_peak"), F.col("__initial"), 0.0) - 1.0 >= lock_gain
    near = F.lit(lock_near_high > 0) & (F.col("__lock_drawdown") <= lock_near_high)
    strong = (F.col("green") >= 4) & ~F.col("bearish_1d")
    sol_dd, pf_dd, px_dd = crisis
    ready = F.col("__bars") >= crisis_ready
    bear_high = F.col("bearish_3d") | F.col("bearish_1w")
    fell = F.col("bearish_1d") & (F.col("__price_drawdown") >= sol_dd)
    reason = F.when(ready & bear_high & (F.col("sol_drawdown") >= px_dd), "sol_equivalent_drawdown").when(
        ready & fell & F.col("bearish_3d"), "sol_drawdown_with_bearish_trend"
    ).when(ready & fell & (F.col("portfolio_drawdown") >= pf_dd), "sol_drawdown_with_portfolio_damage")
    gain, protect, multiple = cppi
    on = F.col("high_watermark") >= F.col("__initial") * gain
    floor = F.col("high_watermark") * protect
    flags = rows.withColumns(
        {
            "lock_triggered": weak & gained & ((F.col("__lock_drawdown") >= lock_drawdown) | near),
            "lock_recovered": ~weak & (v >= F.col("__lock_peak") * (1.0 - lock_exit_gap)),
            "contain_enter": F.col("portfolio_drawdown") >= containment[0],
            "contain_exit": strong & (v >= F.col("__peak") * (1.0 - containment[1])),
            "crisis_reason": reason,
            "cppi_cap": F.when(on, F.greatest(F.lit(0.0), v - floor) * multiple).otherwise(-1.0),
            "cppi_floor": F.when(on, floor).otherwise(0.0),
        }
    )
    return flags.drop(*[c for c in flags.columns if c.startswith("__")])
