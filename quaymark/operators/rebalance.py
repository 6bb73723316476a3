"""Long and short rebalance plans as action rows, for all accounts at once.

Input is `net` positions joined to the account's legs (selected symbols, target
and threshold); an account has a few net rows, so its shared stable budget is a
window over a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.functions.numeric import ratio
from quaymark.operators.risk import _leg, is_collateral

STABLE = "USDC"
_ACTIONS = "array<struct<type:string,symbol:string,amount:double,cash_delta:double>>"


def _none() -> Column:
    return F.array().cast(_ACTIONS)


def _with_stable(net: DataFrame) -> DataFrame:
    """Add the account's stable collateral and debt; null where it has no such row."""
    account = W.partitionBy("account_id")
    at = lambda test: F.max(F.when(test & (F.col("symbol") == STABLE), F.col("amount"))).over(account)
    return net.withColumns({"__cash": at(is_collateral()), "__owed": at(~is_collateral())})


def _explode(rows: DataFrame, actions: Column) -> DataFrame:
    return rows.select(
        "account_id", F.col("symbol").alias("position"), F.posexplode(actions).alias("step", "leg")
    ).select("account_id", "position", "step", "leg.type", "leg.symbol", "leg.amount")


def long_plan(net: DataFrame, legs: DataFrame, symbols: Sequence[str], fee: float) -> DataFrame:
    """Sell what is not selected, buy the selected asset from stable, then by borrowing.

    `legs`: (account_id, selected_long, target_usd, threshold_usd).  Only the
    selected asset can be short of its target, so buys share no budget.  Each
    sale repays against the same opening stable debt.
    """
    account_side = W.partitionBy("account_id", "symbol")
    rows = _with_stable(net).withColumn(
        "__own_debt", F.max(F.when(~is_collateral(), F.col("amount"))).over(account_side)
    )
    rows = rows.filter(is_collateral() & F.col("symbol").isin(*symbols) & (F.col("price") > 0))
    rows = rows.filter("__cash IS NOT NULL").join(legs, "account_id")
    price, threshold = F.col("price"), F.col("threshold_usd")
    value = F.col("amount") * price
    diff = F.when(F.col("symbol") == F.col("selected_long"), F.col("target_usd")).otherwise(0.0) - value
    rows = rows.withColumns({"__value": value, "__diff": diff}).filter(F.abs("__diff") >= threshold)
    d, cash, owed = F.col("__diff"), F.col("__cash"), F.col("__owed")
    keep = max(1.0 - fee, 1e-9)
    name = F.col("symbol")

    spend = F.least(d / keep, cash)
    left = d - spend * (1.0 - fee)
    lend = left / keep
    from_cash = F.when(
        spend > 0,
        F.array(_leg("withdraw_collateral", STABLE, spend), _leg("deposit_collateral", name, spend * (1.0 - fee) / price)),
    ).otherwise(_none())
    borrowed = lambda usd: F.array(
        _leg("borrow", STABLE, usd), _leg("deposit_collateral", name, usd * (1.0 - fee) / price)
    )
    topped_up = F.when((left > threshold) & owed.isNotNull(), borrowed(lend)).otherwise(_none())
    buy = (
        F.when(F.coalesce(F.col("__own_debt"), F.lit(0.0)) > 1e-9, _none())
        .when(cash > 0, F.concat(from_cash, topped_up))
        .when(owed.isNotNull(), borrowed(d / keep))
        .otherwise(_none())
    )
    sell_usd = F.least(-d, F.col("__value"))
    proceeds = sell_usd * (1.0 - fee)
    repay = F.when(F.coalesce(owed, F.lit(0.0)) > 0, F.least(proceeds, owed)).otherwise(0.0)
    rest = proceeds - repay
    sell = F.concat(
        F.array(_leg("withdraw_collateral", name, sell_usd / price)),
        F.when(repay > 0, F.array(_leg("repay", STABLE, repay))).otherwise(_none()),
        F.when(rest > 0, F.array(_leg("deposit_collateral", STABLE, rest))).otherwise(_none()),
    )
    actions = F.when(d > 0, buy).when((d < 0) & (F.col("__value") > 0), sell).otherwise(_none())
    return _explode(rows, actions)


def short_plan(net: DataFrame, legs: DataFrame, symbols: Sequence[str], fee: float) -> DataFrame:
    """Open or cover the selected short toward its USD target.

    `legs`: (account_id, selected_short, target_short_usd, threshold_usd).
    """
    rows = _with_stable(net).filter(~is_collateral() & F.col("symbol").isin(*symbols) & (F.col("price") > 0))
    rows = rows.filter("__cash IS NOT NULL").join(legs, "account_id")
    price, value, cash = F.col("price"), F.col("amount") * F.col("price"), F.col("__cash")
    diff = F.when(F.col("symbol") == F.col("selected_short"), F.col("target_short_usd")).otherwise(0.0) - value
    rows = rows.withColumns({"__value": value, "__diff": diff}).filter(F.abs("__diff") >= F.col("threshold_usd"))
    d, name = F.col("__diff"), F.col("symbol")
    opened = F.array(_leg("borrow", name, d / price), _leg("deposit_collateral", STABLE, d * (1.0 - fee)))
    cost = F.least(F.least(-d, F.col("__value")) * (1.0 + fee), cash)
    tokens = F.least(cost / (1.0 + fee) / price, F.col("amount"))
    covered = F.array(
        _leg("withdraw_collateral", STABLE, tokens * price * (1.0 + fee)), _leg("repay", name, tokens)
    )
    actions = (
        F.when(d > 0, opened)
        .when((d < 0) & (F.col("__value") > 0) & (cash > 0) & (tokens > 0), covered)
        .otherwise(_none())
    )
    return _explode(rows, actions)


def excess_short_cover(net: DataFrame, legs: DataFrame, fee: float) -> DataFrame:
    """Buy back the part of the protective short above its share of the basis asset.

    `legs`: (account_id, basis, protective_short, target_short_fraction, threshold_usd).
    """
    rows = _with_stable(net).join(legs, "account_id")
    account = W.partitionBy("account_id")
    basis = F.max(
        F.when(is_collateral() & (F.col("symbol") == F.col("basis")), F.col("amount") * F.col("price"))
    ).over(account)
    rows = rows.withColumn("__basis", basis).filter(
        ~is_collateral() & (F.col("symbol") == F.col("protective_short")) & (F.col("price") > 0)
        & F.col("__basis").isNotNull() & (F.col("__cash") > 0)
    )
    price = F.col("price")
    excess = F.col("amount") * price - F.col("__basis") * F.col("target_short_fraction")
    cost = F.least(excess * (1.0 + fee), F.col("__cash"))
    tokens = F.least(cost / (1.0 + fee) / price, F.col("amount"))
    legs_out = F.array(
        _leg("withdraw_collateral", STABLE, tokens * price * (1.0 + fee)), _leg("repay", F.col("symbol"), tokens)
    )
    rows = rows.filter((excess >= F.col("threshold_usd")) & (tokens > 0))
    return _explode(rows, legs_out)


def conflict_cover(net: DataFrame, legs: DataFrame, symbols: Sequence[str], fee: float) -> DataFrame:
    """Close debts that conflict with the chosen legs.

    Each debt is first repaid from collateral of the same asset, the rest from
    one stable budget in position order.  `legs`: (account_id, selected_long,
    desired_short).
    """
    own = F.max(F.when(is_collateral(), F.col("amount"))).over(W.partitionBy("account_id", "symbol"))
    rows = _with_stable(net).withColumn("__own", F.coalesce(own, F.lit(0.0))).join(legs, "account_id")
    price, amount, name = F.col("price"), F.col("amount"), F.col("symbol")
    must = (name == F.col("selected_long")) | (name != F.col("desired_short"))
    rows = rows.filter(
        ~is_collateral() & name.isin(*symbols) & (price > 0) & (amount > 0) & must
    )
    direct = F.least(F.greatest("__own", F.lit(0.0)), amount)
    rows = rows.withColumn("__direct", direct).withColumn(
        "__need", (amount - F.col("__direct")) * price * (1.0 + fee)
    )
    earlier = W.partitionBy("account_id").orderBy("pos_no").rowsBetween(W.unboundedPreceding, -1)
    used = F.coalesce(F.sum("__need").over(earlier), F.lit(0.0))
    budget = F.greatest(F.lit(0.0), F.coalesce(F.col("__cash"), F.lit(0.0)) - used)
    rows = rows.withColumn("__cost", F.least(F.col("__need"), budget))
    tokens = ratio(F.col("__cost"), price * (1.0 + fee), 0.0)
    actions = F.concat(
        F.when(
            F.col("__direct") > 0,
            F.array(_leg("withdraw_collateral", name, F.col("__direct")), _leg("repay", name, F.col("__direct"))),
        ).otherwise(_none()),
        F.when(
            F.col("__cost") > 0,
            F.array(_leg("withdraw_collateral", STABLE, F.col("__cost")), _leg("repay", name, tokens)),
        ).otherwise(_none()),
    )
    return _explode(rows, actions)
