"""Asset universe: research lists and data-quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIVERSE_SCHEMA = (
    "ordinal int, key string, symbol string, price_kind string, can_be_collateral boolean, can_be_borrowed boolean, "
    "include_in_long_short_research boolean, exchange_symbol string, peg_target string, derived_from string"
)
# The default universe, in research order
# (symbol, price kind, in long/short research, exchange symbol, peg target).
DEFAULT_UNIVERSE = (
    ("SOL", "exchange", True, "SOL/USDT", None),
    ("JitoSOL", "exchange", True, "JITOSOL/USDT", None),
    ("mSOL", "exchange", True, "MSOL/USDT", None),
    ("USDC", "pegged", False, None, "USD"),
    ("USDT", "pegged", False, None, "USD"),
    ("ETH", "exchange", True, "ETH/USDT", None),
    ("BTC", "exchange", True, "BTC/USDT", None),
)


def default_universe(spark) -> DataFrame:
    rows = [
        (i, s, s, kind, True, True, research, exchange, peg, None)
        for i, (s, kind, research, exchange, peg) in enumerate(DEFAULT_UNIVERSE)
    ]
    return spark.createDataFrame(rows, UNIVERSE_SCHEMA)


def research_symbols(universe: DataFrame, long_short_only: bool = True) -> DataFrame:
    """Symbols in research order, all or only the long/short ones."""
    rows = universe.filter("include_in_long_short_research") if long_short_only else universe
    return rows.orderBy("ordinal").select("ordinal", "symbol")


def exchange_priced(universe: DataFrame) -> DataFrame:
    """Assets that need external candles, with their exchange symbol."""
    return universe.filter("price_kind = 'exchange'").orderBy("ordinal").select(
        "ordinal", F.coalesce("exchange_symbol", F.lit("")).alias("exchange_symbol"), F.col("symbol").alias("display_name")
    )


def _missing(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def violations(universe: DataFrame, market: DataFrame) -> DataFrame:
    """One row per broken rule instead of an error for the first one."""
    known = market.select("symbol").distinct().withColumn("__in_market", F.lit(True))
    kind = F.col("price_kind")
    rules = {
        "symbol mismatch": F.col("key") != F.col("symbol"),
        "not in market": F.col("__in_market").isNull(),
        "missing exchange_symbol": (kind == "exchange") & _missing("exchange_symbol"),
        "missing peg_target": (kind == "pegged") & _missing("peg_target"),
        "missing derived_from": (kind == "derived") & _missing("derived_from"),
        "not tradable both ways": F.col("include_in_long_short_research")
        & ~(F.col("can_be_collateral") & F.col("can_be_borrowed")),
    }
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda r: r.isNotNull())
    return universe.join(known, "symbol", "left").select("symbol", F.explode(broken).alias("rule"))
