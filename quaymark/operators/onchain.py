"""Decoded lending-protocol rows to positions and reserve tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scale of 128-bit fixed-point numbers; known token addresses.
SF_SCALE = float(2**60)
KNOWN_MINTS = {
    "So11111111111111111111111111111111111111112": "SOL",
    "EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v": "USDC",
    "Es9vMFrzaCERmJfrF4H2FYD4KCoNkY11McCe8BenwNYB": "USDT",
    "7vfCXTUXx5WJV5JADk17DUJ4ksgau7utNKj4b963voxs": "ETH",
    "mSoLzYCxHdYgdzU16g5QSh3i5K3z3KZK7ytfqcJm7So": "mSOL",
    "J1toso1uCk3RLmjorhTtrVwY9HJ7X8V9yYac6Y7kGCPn": "JitoSOL",
    "7dHbWXmci3dT8UFYWYZweBLXgycu7Y3iL6trKn1Y7ARj": "stSOL",
    "bSo13r4TkiE4KumL71LsHTPpL2euBYLFx6h9HP3piy1": "bSOL",
    "DezXAZ8z7PnrnRJjz3wXBoRgixCa6xjnB7YaB1pPB263": "BONK",
    "HZ1JovNiVvGrGNiiYvEozEVgZ58xaU3RKwX8eACQBCt3": "PYTH",
    "jtojtomepa8beP8AuQc6eXt5FriJwfFMwQx2v2f9mCL": "JTO",
    "27G8MtK7VtTcCHkpASjSDdkWWYfoqT6ggEuKidVJidD4": "JLP",
    "2u1tszSeqZ3qBWF3uNGPFc8TzMk2tdiwknnRMWGWjGWH": "USDG",
    "2zMMhcVQEXDtdE6vsFS7S7D5oUodfJHE8vd1gnBouauv": "PENGU",
}


def from_sf(c: Column) -> Column:
    """Scale-factor integer to a plain number."""
    return c.cast("double") / F.lit(SF_SCALE)


def from_raw(c: Column, decimals: Column) -> Column:
    """Raw token units to tokens."""
    return c.cast("double") / F.pow(F.lit(10.0), decimals.cast("double"))


def parse_sf(text: Column) -> Column:
    """Scale-factor integers that arrive as text; null where 38 digits do not suffice."""
    return text.try_cast("decimal(38,0)")


def quarantine(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Parse text integers and name the columns that did not fit, null if all did."""
    parsed = {c: parse_sf(F.col(c)) for c in columns}
    bad = F.concat_ws(
        ",", *[F.when(F.col(c).isNotNull() & p.isNull(), F.lit(c)) for c, p in parsed.items()]
    )
    return rows.withColumn("__bad", bad).withColumns(parsed).withColumn(
        "quarantined", F.when(F.col("__bad") != "", F.col("__bad"))
    ).drop("__bad")


def exchange_rate() -> Column:
    """Underlying tokens per receipt token; 1 before any receipt exists."""
    held = F.col("available").cast("double") + from_sf(F.col("borrowed_sf"))
    owed = from_sf(F.col("protocol_fees_sf")) + from_sf(F.col("referrer_fees_sf")) + from_sf(F.col("pending_fees_sf"))
    supply = F.col("mint_supply").cast("double")
    return F.when(supply == 0, 1.0).otherwise((held - owed) / F.when(supply != 0, supply))


def reserves(decoded: DataFrame, listed: DataFrame) -> DataFrame:
    """Reserve parameters; the first present borrow-factor field decides.

    `listed`: (mint, listed_symbol), a token list.  Known addresses win over the
    list, and the address prefix is the last resort.
    """
    known = F.create_map(*[F.lit(x) for pair in KNOWN_MINTS.items() for x in pair])
    rows = decoded.join(listed, "mint", "left")
    symbol = F.coalesce(F.try_element_at(known, F.col("mint")), F.col("listed_symbol"), F.substring("mint", 1, 8))
    pct = lambda c: F.col(c).cast("double") / 100.0
    factor = F.coalesce(
        pct("borrow_factor_pct"), pct("debt_weight_pct"), F.col("added_borrow_weight_bps").cast("double") / 10000.0, F.lit(1.0)
    )
    return rows.select(
        "reserve", symbol.alias("symbol"), from_sf(F.col("market_price_sf")).alias("price"),
        pct("ltv_pct").alias("ltv"), pct("liq_threshold_pct").alias("liq_threshold"),
        factor.alias("borrow_factor"), "decimals", exchange_rate().alias("exchange_rate"),
    )


def active_reserves(table: DataFrame) -> DataFrame:
    """Reserves that have a price, by symbol."""
    return table.filter("price > 0").orderBy("symbol", "reserve")


def obligation_slots(obligations: DataFrame) -> DataFrame:
    """Nested obligations to one row per used slot (slot arrays have a fixed length)."""
    def side(name: str, column: str, amount: str) -> DataFrame:
        return obligations.select("obligation", F.lit(name).alias("side"), F.posexplode(column).alias("pos_no", "s")).select(
            "obligation", "side", "pos_no", F.col("s.reserve").alias("reserve"), F.col(f"s.{amount}").alias("raw")
        )

    both = side("collateral", "deposits", "deposited_amount").unionByName(side("debt", "borrows", "borrowed_amount_sf"))
    return both.filter("raw > 0")


def slot_positions(slots: DataFrame, table: DataFrame) -> DataFrame:
    """Slots joined with reserves: deposits go through the exchange rate, borrows are scaled.

    Slots of an unknown reserve stay, with null symbol, price and deposited amount.
    """
    rows = slots.filter("raw > 0").join(table, "reserve", "left")
    deposited = from_raw(F.col("raw").cast("double") * F.col("exchange_rate"), F.col("decimals"))
    owed = from_raw(from_sf(F.col("raw")), F.col("decimals"))
    coll = F.col("side") == "collateral"
    return rows.select(
        F.col("obligation").alias("account_id"), "pos_no", "side", "symbol",
        F.when(coll, deposited).otherwise(owed).alias("amount"), "price",
        F.when(coll, F.col("ltv")).alias("ltv"), F.when(coll, F.col("liq_threshold")).alias("liq_threshold"),
        F.when(~coll, F.col("borrow_factor")).alias("borrow_factor"),
    )
