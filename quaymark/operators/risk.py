"""Lending-account risk: reports, liquidation prices, stress, what-if, sizing.

Positions are rows; an account is a group of rows.  Reports are map-side
combined sums, so an account that owns a third of all positions costs no more
than others.  Work that needs rows of one account side by side runs on `net`
positions, at most one row per (account, side, symbol).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.functions.numeric import INF, is_finite, num, ratio
from quaymark.operators.scan import running

# Assets left out of market-wide price moves.
STABLECOINS = ("USDC", "USDT", "USDG", "DAI", "USDS")
ACCOUNT = ("account_id",)



def is_collateral() -> Column:
    return F.col("side") == "collateral"


def _valued(price: Column) -> dict[str, Column]:
    coll = is_collateral()
    value = F.col("amount") * price
    return {
        "value": value,
        "liquidation_value": F.when(coll, value * F.col("liq_threshold")).otherwise(0.0),
        "limit_value": F.when(coll, value * F.col("ltv")).otherwise(0.0),
        "risk_debt": F.when(~coll, value * F.col("borrow_factor")).otherwise(0.0),
    }


def with_values(positions: DataFrame) -> DataFrame:
    """Value, liquidation value, borrow limit and risk-adjusted debt per position."""
    return positions.withColumns(_valued(F.col("price")))


def net_positions(positions: DataFrame, keys: Sequence[str] = ACCOUNT) -> DataFrame:
    """One row per (account, side, symbol): summed amount, value-weighted terms."""
    w = F.col("amount") * F.col("price")
    weighted = lambda c: F.sum(w * F.col(c))
    agg = positions.groupBy(*keys, "side", "symbol").agg(
        F.min("pos_no").alias("pos_no"),
        F.sum("amount").alias("amount"),
        F.sum(w).alias("__v"),
        *[weighted(c).alias(f"__{c}") for c in ("ltv", "liq_threshold", "borrow_factor")],
    )
    return agg.select(
        *keys, "pos_no", "side", "symbol", "amount",
        ratio(F.col("__v"), F.col("amount"), 0.0).alias("price"),
        *[ratio(F.col(f"__{c}"), F.col("__v"), 0.0).alias(c) for c in ("ltv", "liq_threshold", "borrow_factor")],
    )


def report_columns(coll: Column, debt: Column, limit: Column, liq: Column, risk: Column) -> dict[str, Column]:
    """Ratios of an account; infinite where there is nothing to divide by."""
    return {
        "current_ltv": ratio(debt, coll, INF),
        "borrow_ltv": ratio(risk, coll, INF),
        "liquidation_ltv": ratio(liq, coll, 0.0),
        "health_factor": ratio(limit, risk, INF),
        "liquidation_health_factor": ratio(liq, risk, INF),
        "liquidation_buffer": liq - debt,
    }


_REPORT = ("collateral_value", "debt_value", "borrow_limit", "liquidation_value", "risk_debt")


def _totals(values: Mapping[str, Column], prefix: str = "") -> list[Column]:
    """Sums of an account over the values of its positions."""
    coll = is_collateral()
    sums = (
        F.when(coll, values["value"]).otherwise(0.0), F.when(coll, 0.0).otherwise(values["value"]),
        values["limit_value"], values["liquidation_value"], values["risk_debt"],
    )
    return [F.sum(v).alias(prefix + c) for c, v in zip(_REPORT, sums)]


def _report_parts() -> tuple[list[Column], dict[str, Column]]:
    """Sums of an account over valued positions, and the ratios built on them."""
    totals = _totals({c: F.col(c) for c in ("value", "limit_value", "liquidation_value", "risk_debt")})
    return totals, report_columns(*[F.col(c) for c in _REPORT])


def _report(valued: DataFrame, keys: Sequence[str]) -> DataFrame:
    totals, ratios = _report_parts()
    return valued.groupBy(*keys).agg(*totals).withColumns(ratios)


def account_report(positions: DataFrame, keys: Sequence[str] = ACCOUNT) -> DataFrame:
    """Totals and risk ratios per account in one aggregate."""
    return _report(with_values(positions), keys)


def health_band(hf: Column) -> Column:
    return (
        F.when(hf == F.lit(INF), "safe")
        .when(hf < 1.0, "liquidation")
        .when(hf < 1.1, "critical")
        .when(hf < 1.5, "moderate")
        .otherwise("healthy")
    )


def liquidation_prices(positions: DataFrame, keys: Sequence[str] = ACCOUNT) -> DataFrame:
    """Price of each asset at which its account becomes liquidatable.

    The first position of an asset sets amount and threshold; "other" value
    leaves out every row of the asset.  Rows are first reduced to one per asset,
    so the account window holds a handful of rows.
    """
    rows = with_values(positions).groupBy(*keys, "side", "symbol").agg(
        F.min_by("amount", "pos_no").alias("amount"),
        F.min_by("liq_threshold", "pos_no").alias("liq_threshold"),
        F.sum("value").alias("value"),
        F.sum("liquidation_value").alias("liquidation_value"),
    )
    account = W.partitionBy(*keys)
    coll = is_collateral()
    debt = F.sum(F.when(coll, 0.0).otherwise(F.col("value"))).over(account)
    liq = F.sum("liquidation_value").over(account)
    for_coll = ratio(debt - (liq - F.col("liquidation_value")), F.col("amount") * F.col("liq_threshold"))
    for_debt = ratio(liq - (debt - F.col("value")), F.col("amount"))
    raw = F.when(coll, for_coll).otherwise(for_debt)
    return rows.select(
        *keys, "side", "symbol", F.when(raw.isNotNull(), F.greatest(F.lit(0.0), raw)).alias("liquidation_price")
    )


def stress_grid(
    positions: DataFrame,
    moves: Mapping[str, float],
    overrides: Mapping[tuple[str, str], float] | None = None,
    keys: Sequence[str] = ACCOUNT,
) -> DataFrame:
    """Account report under every market move; an override price beats the move.

    Positions are valued at every scenario's price, as rows of their own would be, and all
    scenarios are added up in one aggregate before they become rows: the scan and its shuffle
    do not grow with the number of scenarios.
    """
    totals, grid = [], []
    for k, (name, move) in enumerate(moves.items()):
        price = F.when(F.col("symbol").isin(*STABLECOINS), F.col("price")).otherwise(F.col("price") * (1.0 + move))
        for (scenario, symbol), fixed in (overrides or {}).items():
            if scenario == name:
                price = F.when(F.col("symbol") == symbol, float(fixed)).otherwise(price)
        totals += _totals(_valued(price), f"__{k}_")
        grid.append(F.struct(F.lit(name).alias("scenario_id"), *[F.col(f"__{k}_{c}").alias(c) for c in _REPORT]))
    rows = positions.groupBy(*keys).agg(*totals).select(*keys, F.inline(F.array(*grid)))
    return rows.withColumns(report_columns(*[F.col(c) for c in _REPORT]))


_COLLATERAL_VERBS = {"deposit_collateral": 1.0, "withdraw_collateral": -1.0}
_DEBT_VERBS = {"borrow": 1.0, "repay": -1.0}
_PRICE_VERBS = ("set_price", "update_price")


def signed_amount() -> Column:
    out = None
    for verb, s in {**_COLLATERAL_VERBS, **_DEBT_VERBS}.items():
        test = F.col("type") == verb
        out = F.when(test, F.col("amount") * s) if out is None else out.when(test, F.col("amount") * s)
    return out.otherwise(0.0)


def verb_side() -> Column:
    return F.when(F.col("type").isin(*_COLLATERAL_VERBS), "collateral").when(
        F.col("type").isin(*_DEBT_VERBS), "debt"
    )


def apply_actions(net: DataFrame, actions: DataFrame) -> DataFrame:
    """Positions after a batch: summed deltas, last set price; amounts may go negative.

    Adds the opening `amount_before` and `price_before`.  Actions reduce to one
    row per (account, asset) before they meet the positions.  Deltas are added in the order of the
    actions, so what is left of an amount moved out whole does not hang on partitions; where one is
    not finite the plain sum stands.
    """
    delta = lambda side: F.when(verb_side() == side, signed_amount()).otherwise(0.0)
    priced = F.col("type").isin(*_PRICE_VERBS) & F.col("price").isNotNull()
    moves = actions.select(
        "account_id", "symbol", "action_no", F.when(priced, F.col("price")).alias("__set"),
        delta("collateral").alias("__c"), delta("debt").alias("__d"),
    )
    sums = {"__nth": ("sum", F.lit(1)), "__c_sum": ("sum", F.col("__c")), "__d_sum": ("sum", F.col("__d"))}
    total = lambda c: F.when(is_finite(F.sum(c)), F.max_by(f"{c}_sum", "__nth")).otherwise(F.sum(c)).alias(c)
    batch = running(moves, ["account_id", "symbol"], ["action_no"], sums, long=True).groupBy("account_id", "symbol").agg(
        total("__c"),
        total("__d"),
        F.max_by("__set", F.when(F.col("__set").isNotNull(), F.col("action_no"))).alias("__price"),
    )
    change = F.coalesce(F.when(is_collateral(), F.col("__c")).otherwise(F.col("__d")), F.lit(0.0))
    return net.join(batch, ["account_id", "symbol"], "left").withColumns(
        {
            "amount_before": F.col("amount"),
            "price_before": F.col("price"),
            "amount": F.col("amount") + change,
            "price": F.coalesce("__price", "price"),
        }
    ).select(*net.columns, "amount_before", "price_before")


def scenario_deltas(after: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """Health after a batch and its change against the opening positions.

    `opening` are the positions as they were before they were netted; without them the opening
    amounts and prices of `after` serve, which agree with them but for rounding.
    """
    if opening is None:
        opening = after.withColumns({"amount": F.col("amount_before"), "price": F.col("price_before")})
    measures = ("health_factor", "borrow_limit", "liquidation_buffer", "current_ltv", "borrow_ltv", "liquidation_ltv")
    bounded = ("health_factor", "current_ltv", "borrow_ltv")
    start, end = (
        account_report(df).select("account_id", *[F.col(c).alias(f"__{n}_{c}") for c in measures])
        for n, df in enumerate((opening, after))
    )
    change = {c: F.col(f"__1_{c}") - F.col(f"__0_{c}") for c in measures}
    for c in bounded:  # infinite where there is nothing to divide by
        change[c] = F.when(is_finite(F.col(f"__1_{c}")) & is_finite(F.col(f"__0_{c}")), change[c])
    return end.join(start, "account_id").select(
        "account_id", F.col("__1_health_factor").alias("scenario_hf"), health_band(F.col("__1_health_factor")).alias("band"),
        *[change[c].alias(f"delta_{c}") for c in measures],
    )


def action_errors(positions: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions that name an asset the account lacks, an unknown verb, or no price."""
    owned = positions.groupBy("account_id", "symbol").agg(
        F.max(is_collateral()).alias("__c"), F.max(~is_collateral()).alias("__d")
    )
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    verb = F.col("type")
    error = (
        F.when(verb.isin(*_COLLATERAL_VERBS) & ~flag("__c"), "collateral asset not found")
        .when(verb.isin(*_DEBT_VERBS) & ~flag("__d"), "debt asset not found")
        .when(verb.isin(*_PRICE_VERBS) & F.col("price").isNull(), "price required")
        .when(verb.isin(*_PRICE_VERBS) & ~flag("__c") & ~flag("__d"), "asset not found")
        .when(~verb.isin(*_COLLATERAL_VERBS, *_DEBT_VERBS, *_PRICE_VERBS), "unknown action type")
    )
    return (
        actions.join(owned, ["account_id", "symbol"], "left")
        .withColumn("error", error)
        .filter("error IS NOT NULL")
        .select(*actions.columns, "error")
    )


# --- recovery and conversion formulas -------------------------------------------------

def deficit(debt: Column, limit: Column, target: float) -> Column:
    return F.lit(target) * debt - limit


def repay_usd(debt: Column, limit: Column, target: float) -> Column:
    return debt - limit / F.lit(target) if target > 0 else F.lit(0.0)


def swap_withdraw(gap: Column, price: Column, target: float, weight: Column, most: Column) -> Column:
    """Tokens to withdraw and swap into repayment, capped by what is held."""
    raw = ratio(gap, price * (F.lit(target) - weight), 0.0)
    return F.when((weight < target) & (price > 0), F.least(raw, most)).otherwise(0.0)


def deposit_tokens(gap: Column, price: Column, weight: Column) -> Column:
    return F.when((price > 0) & (weight > 0), ratio(gap, price * weight, 0.0)).otherwise(0.0)


def hedge_withdraw(debt: Column, limit: Column, target: float, price: Column, weight: Column) -> Column:
    raw = ratio(limit - F.lit(target) * debt, price * weight, 0.0)
    ok = (price > 0) & (weight > 0) & (debt > 0)
    return F.when(ok, F.greatest(raw, F.lit(0.0))).otherwise(0.0)


def swap_tokens(amount: Column, price: Column, target_price: Column) -> Column:
    """USD-neutral conversion of an amount into another token."""
    return F.when(target_price > 0, ratio(F.abs(amount) * price, target_price, 0.0)).otherwise(0.0)


def recovery_options(net: DataFrame, target: float = 1.1, trigger: float = 1.5) -> DataFrame:
    """Repay (A), swap (B) and deposit (C) amounts that restore the target health.

    Uses borrow limit and LTV against borrow-factor debt.  `net` has one row per
    asset of an account, bounded by the assets of the market, so an account folds
    into one row and its options (B pairs assets) unfold from it.
    """
    account = W.partitionBy("account_id")
    valued = with_values(net)
    limit, risk = F.sum("limit_value").over(account), F.sum("risk_debt").over(account)
    rows = valued.withColumns({"__limit": limit, "__risk": risk})
    rows = rows.withColumn("__gap", deficit(F.col("__risk"), F.col("__limit"), target)).filter(
        (ratio(F.col("__limit"), F.col("__risk"), INF) < trigger) & (F.col("__gap") > 0)
    )
    price, amount = F.col("price"), F.col("amount")
    coll = is_collateral()
    item = F.struct("symbol", "price", "amount", "ltv")
    side = lambda test: F.collect_list(F.when(test & (price > 0), item))
    folded = rows.groupBy("account_id").agg(
        F.first("__gap").alias("__gap"),
        F.first(repay_usd(F.col("__risk"), F.col("__limit"), target)).alias("__pay"),
        side(coll & (F.col("ltv") > 0)).alias("__c"),
        side(~coll & (amount > 0)).alias("__d"),
    )
    gap = F.col("__gap")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def option(name: str, c: Column, d: Column, c_tokens: Column, d_tokens: Column) -> Column:
        return F.struct(
            F.lit(name).alias("option"), c.alias("collateral_symbol"), d.alias("debt_symbol"),
            c_tokens.cast("double").alias("collateral_tokens"), d_tokens.cast("double").alias("debt_tokens"),
        )

    sold = lambda c: swap_withdraw(gap, c["price"], target, c["ltv"], c["amount"])
    a = F.transform("__d", lambda d: option("A", text, d["symbol"], number, F.least(F.col("__pay") / d["price"], d["amount"])))
    b = F.flatten(
        F.transform(
            F.filter("__c", lambda c: sold(c) > 0),
            lambda c: F.transform(
                "__d",
                lambda d: option("B", c["symbol"], d["symbol"], sold(c), F.least(sold(c) * c["price"] / d["price"], d["amount"])),
            ),
        )
    )
    c = F.transform("__c", lambda c: option("C", c["symbol"], text, deposit_tokens(gap, c["price"], c["ltv"]), number))
    return folded.select("account_id", F.inline(F.concat(a, b, c)))


def leverage_loops(positions: DataFrame, configs: Sequence[tuple[str, int, float]]) -> DataFrame:
    """Borrow-and-redeposit rounds in closed form: (name, rounds, utilization).

    Each round borrows u of the free limit and adds it as collateral, so the free
    limit shrinks by q = 1 - u(1 - ltv) and the borrowed total is a geometric sum.
    """
    plans = F.array(
        *[
            F.struct(F.lit(n).alias("config"), F.lit(k).alias("rounds"), F.lit(float(u)).alias("utilization"))
            for n, k, u in configs
        ]
    )
    rows = positions.filter(is_collateral()).select("account_id", "pos_no", "symbol", "amount", "price", "ltv", F.inline(plans))
    u, ltv = F.col("utilization"), F.col("ltv")
    q = 1.0 - u * (1.0 - ltv)
    first = u * ltv * F.col("amount") * F.col("price")
    borrowed = F.when(q == 1.0, first * F.col("rounds")).otherwise(
        first * ratio(1.0 - F.pow(q, F.col("rounds").cast("double")), 1.0 - q, 0.0)
    )
    return rows.withColumn("borrowed_usd", borrowed).withColumns(
        {
            "deposited_tokens": ratio(F.col("borrowed_usd"), F.col("price"), 0.0),
            "final_amount": F.col("amount") + ratio(F.col("borrowed_usd"), F.col("price"), 0.0),
        }
    )


def _leg(kind: str, symbol: Column | str, amount: Column, cash: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        (F.lit(symbol) if isinstance(symbol, str) else symbol).alias("symbol"),
        amount.cast("double").alias("amount"),
        (num(0.0) if cash is None else cash).cast("double").alias("cash_delta"),
    )


def account_assets(net: DataFrame, collateral: Sequence[str], debt: Sequence[str],
                   fields: Sequence[str] = ("amount", "price")) -> DataFrame:
    """Chosen assets of each account as columns next to its report."""
    wanted = []
    for side, names in (("collateral", collateral), ("debt", debt)):
        for s in names:
            here = (F.col("side") == side) & (F.col("symbol") == s)
            tag = f"{'c' if side == 'collateral' else 'd'}_{s.lower()}"
            wanted += [F.max(F.when(here, F.col(f))).alias(f"{tag}_{f}") for f in fields]
    totals, ratios = _report_parts()
    return with_values(net).groupBy("account_id").agg(*totals, *wanted).withColumns(ratios)


def rebalance_advice(
    accounts: DataFrame, collateral: str, debt: str, cash: Column | float = 0.0,
    target: float = 1.3, low: float = 1.15, high: float = 2.5, utilization: float = 0.85,
    hedge: bool = False, hedge_trigger: float = 2.5, hedge_fraction: float = 1.0,
) -> DataFrame:
    """First matching advice per account as action rows: delever, hedge, redeploy, re-lever.

    `accounts` comes from `account_assets` with amount, price and ltv.
    """
    c, d = f"c_{collateral.lower()}", f"d_{debt.lower()}"
    c_amt, c_px, c_ltv = (F.col(f"{c}_{f}") for f in ("amount", "price", "ltv"))
    d_amt, d_px = F.col(f"{d}_amount"), F.col(f"{d}_price")
    hf, limit, risk = F.col("health_factor"), F.col("borrow_limit"), F.col("risk_debt")
    cash = num(cash)
    pay = repay_usd(risk, limit, target)
    repay = F.least(ratio(pay, d_px, 0.0), d_amt)
    can_repay = (pay > 0) & (d_px > 0) & (repay > 0) & (c_px > 0)
    delever = F.array(
        _leg("withdraw_collateral", collateral, F.least(ratio(pay, c_px, 0.0), c_amt * 0.5)),
        _leg("repay", debt, repay),
    )
    out = hedge_withdraw(risk, limit, target, c_px, c_ltv) * hedge_fraction
    out = F.least(out, c_amt * 0.9)
    to_cash = F.array(_leg("withdraw_collateral", collateral, out, out * c_px))
    back = ratio(cash, c_px, 0.0)
    redeploy = F.array(_leg("deposit_collateral", collateral, back, -cash))
    free = limit - F.col("debt_value")
    lent = ratio(free * utilization, d_px, 0.0)
    relever = F.array(
        _leg("borrow", debt, lent),
        _leg("deposit_collateral", collateral, swap_tokens(lent, d_px, c_px)),
    )
    rule = F.when((hf < low) & can_repay, F.lit("delever"))
    if hedge:
        rule = rule.when((hf > hedge_trigger) & (c_px > 0) & (out > 0), "hedge")
        rule = rule.when((cash > 0) & (hf <= target) & (c_px > 0) & (back > 0), "redeploy")
    rule = rule.when((hf > high) & (free > 0) & (d_px > 0) & (c_px > 0), "relever")
    advised = accounts.filter((hf < F.lit(INF)) & (F.col("debt_value") != 0)).withColumn("advice", rule)
    legs = (
        F.when(F.col("advice") == "delever", delever)
        .when(F.col("advice") == "hedge", to_cash)
        .when(F.col("advice") == "redeploy", redeploy)
        .when(F.col("advice") == "relever", relever)
    )
    return advised.filter("advice IS NOT NULL").select(
        "account_id", "advice", F.posexplode(legs).alias("step", "leg")
    ).select("account_id", "advice", "step", "leg.*")


# --- safe sizing ----------------------------------------------------------------------

def max_short_usd(limit: Column, risk: Column, stable_ltv: Column, fee: float, min_hf: float = 1.25,
                  borrow_factor: float = 1.0) -> Column:
    """Largest extra short that keeps the health factor; proceeds count as collateral."""
    buffer = limit - F.lit(min_hf) * risk
    denom = F.lit(min_hf * borrow_factor) - stable_ltv * (1.0 - fee)
    return (
        F.when(buffer <= 0, 0.0)
        .when(denom <= 0, F.lit(INF))
        .otherwise(F.greatest(F.lit(0.0), ratio(buffer, denom, 0.0)))
    )


def cover_tokens(wanted_usd: Column, price: Column, owed: Column, cash: Column, fee: float) -> Column:
    """Short tokens that can be bought back: wanted, owed and affordable."""
    usable = F.least(owed, ratio(wanted_usd, price, 0.0), ratio(cash, price * (1.0 + fee), 0.0))
    return F.when(price > 0, F.greatest(usable, F.lit(0.0))).otherwise(0.0)


def relever_usd(equity: Column, stable_debt: Column, limit: Column, risk: Column, asset_ltv: Column,
                target: float = 1.35, max_debt_to_equity: float = 1.0, borrow_factor: float = 1.053) -> Column:
    """Stable borrow that brings health down to the target within the debt budget."""
    budget = F.greatest(F.lit(0.0), equity * max_debt_to_equity - stable_debt)
    denom = F.lit(borrow_factor * target) - asset_ltv
    room = F.greatest(F.lit(0.0), ratio(limit - F.lit(target) * risk, denom, 0.0))
    return F.when((budget > 0) & (denom > 0), F.least(budget, room)).otherwise(0.0)


def capped_spend(wanted: Column, limit: Column, risk: Column, stable_ltv: Column, asset_ltv: Column,
                 fee: float, min_hf: float = 2.0) -> Column:
    """Stable spend into the asset without falling under the minimum health."""
    loss = stable_ltv - asset_ltv * (1.0 - fee)
    buffer = limit - F.lit(min_hf) * risk
    return (
        F.when((wanted <= 0) | (risk <= 0) | (loss <= 0), wanted)
        .when(buffer <= 0, 0.0)
        .otherwise(F.least(wanted, ratio(buffer, loss, 0.0)))
    )


def surplus_spend(profit: Column, asset_value: Column, cash: Column, fraction: Column, gate: float = 0.10,
                  cap: float = 0.05) -> Column:
    """Part of the realised profit to reinvest once it passes the gate."""
    spend = F.least(profit * fraction, asset_value * cap, F.greatest(cash, F.lit(0.0)))
    ok = (asset_value > 0) & (profit >= asset_value * gate) & (fraction > 0)
    return F.when(ok, spend).otherwise(0.0)


def defensive_repay(equity: Column, fraction: Column, debt: Column, cash: Column,
                    max_debt_to_equity: float = 1.0) -> Column:
    """Repay stable debt above a votes-dependent share of the debt budget."""
    budget = F.greatest(F.lit(0.0), equity) * max_debt_to_equity
    return F.least(F.greatest(F.lit(0.0), debt - budget * fraction), cash, debt)
