"""Cross-exchange arbitrage over order-book level tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.functions.numeric import ratio
from quaymark.operators.asof import enrich
from quaymark.operators.ranged import runs_of_keys

PAIR_KEY = ("pair", "bid_ex", "ask_ex")
#: Of exchanges that the fee table lacks.
NO_FEES = {"maker": 0.0, "taker": 0.0}


def explode_books(books: DataFrame) -> DataFrame:
    """Nested books (pair, exchange, bids, asks of struct(price, vol)) to level rows."""
    def side(name: str, column: str) -> DataFrame:
        return books.select("pair", "exchange", F.lit(name).alias("side"), F.posexplode(column).alias("level", "q")).select(
            "pair", "exchange", "side", "level", "q.price", "q.vol"
        )

    return side("bid", "bids").unionByName(side("ask", "asks"))


def with_fees(levels: DataFrame, fees: DataFrame) -> DataFrame:
    """Add the price after fees next to the raw one: asks pay maker, bids pay taker; no fees where none are listed."""
    rows = enrich(levels, fees.select("exchange", "maker", "taker"), "exchange", NO_FEES)
    net = F.when(F.col("side") == "ask", F.col("price") * (1.0 + F.abs("maker"))).otherwise(
        F.col("price") * (1.0 - F.abs("taker"))
    )
    return rows.withColumn("price_inc_fee", net)


def merged_levels(levels: DataFrame) -> DataFrame:
    """One row per price of a book side: a walk fills equal prices alike.

    Combined map-side; what is left is bounded by the ticks in the price range.
    """
    return levels.groupBy("pair", "exchange", "side", "price").agg(F.sum("vol").alias("vol"))


def quotes(levels: DataFrame, fees: DataFrame) -> DataFrame:
    """Best raw and fee-adjusted bid and ask per (pair, exchange)."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    best = levels.groupBy("pair", "exchange").agg(
        F.max(F.when(bid, F.col("price"))).alias("bid"), F.min(F.when(ask, F.col("price"))).alias("ask")
    )
    return enrich(best, fees.select("exchange", "maker", "taker"), "exchange", NO_FEES).select(
        "pair", "exchange", "bid", "ask",
        (F.col("bid") * (1.0 - F.abs("taker"))).alias("net_bid"),
        (F.col("ask") * (1.0 + F.abs("maker"))).alias("net_ask"),
    )


def opportunities(tops: DataFrame) -> DataFrame:
    """Exchange pairs whose net bid beats the net ask.

    The quotes of a pair (one per exchange) fold into one row and unfold into the
    matrix asked for, so the quotes are computed once and not joined to
    themselves.
    """
    folded = tops.groupBy("pair").agg(F.collect_list(F.struct("exchange", "net_bid", "net_ask")).alias("__q"))
    bids = folded.select("pair", "__q", F.explode(F.filter("__q", lambda q: q["net_bid"].isNotNull())).alias("__b"))
    asks = bids.select(
        "pair", "__b", F.explode(F.filter("__q", lambda q: q["net_ask"] < F.col("__b.net_bid"))).alias("__a")
    )
    return asks.select(
        "pair", F.col("__b.exchange").alias("bid_ex"), F.col("__a.exchange").alias("ask_ex"),
        F.col("__b.net_bid").alias("net_bid"), F.col("__a.net_ask").alias("net_ask"),
        (ratio(F.col("__b.net_bid"), F.col("__a.net_ask"), 0.0) - 1.0).alias("edge"),
    )


_LADDER = ("pair", "exchange", "side", "price", "vol", "price_inc_fee", "base_balance", "quote_balance")


def _books(levels: DataFrame, fees: DataFrame, balances: DataFrame) -> DataFrame:
    """One row per price with fees and balances, a pair in one task, every ladder from its best price on.

    What meets in a task is bounded by the ticks and exchanges of a pair: raw levels are added up
    before the shuffle.
    """
    rows = with_fees(merged_levels(levels).filter("price IS NOT NULL AND side IN ('bid', 'ask')"), fees)
    held = balances.select("exchange", F.col("base_balance").cast("double"), F.col("quote_balance").cast("double"))
    rows = rows.join(held, "exchange", "left").select(*_LADDER)
    rank = F.when(F.col("side") == "ask", F.col("price")).otherwise(-F.col("price"))
    return rows.withColumn("rank", rank).repartition("pair").sortWithinPartitions("pair", "exchange", "side", "rank")


def searched(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each query, how many of values[lo:hi], which ascend, are at most x."""
    start, lo, hi = lo, lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        below = open_ & (values[np.minimum(mid, len(values) - 1)] <= x)
        lo, hi = np.where(below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
    return lo - start


class Ladders:
    """The ladders of whole pairs: where each starts, and running volume and value before every level."""

    def __init__(self, table: pa.Table):
        batch = table.combine_chunks().to_batches()[0]
        self.batch = batch
        number = lambda name: np.nan_to_num(batch.column(name).to_numpy(zero_copy_only=False).astype(float))
        self.rank, self.vol, self.price = number("rank"), number("vol"), number("price_inc_fee")
        run = runs_of_keys(batch, ("pair", "exchange", "side"))
        self.start = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
        self.end = np.append(self.start[1:], len(run))
        self.before, self.worth = self._before(self.vol, run), self._before(self.vol * self.price, run)
        self.pair = runs_of_keys(batch, ("pair",))[self.start]
        self.ask = batch.column("side").take(pa.array(self.start)).to_pylist()
        self.ask = np.array([side == "ask" for side in self.ask])
        self.balance = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)[self.start] for c in ("base_balance", "quote_balance")}

    def _before(self, x: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Running sum up to the level before. Taking a level off its own running sum would round what came before it to the level's size."""
        total = pd.Series(x).groupby(run).cumsum().to_numpy()
        out = np.concatenate([[0.0], total[:-1]])
        out[self.start] = 0.0
        return out

    def depth(self, ladder: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Volume of the first levels of a ladder."""
        last = self.start[ladder] + count - 1
        return self.before[last] + self.vol[last]

    def value(self, ladder: np.ndarray, volume: np.ndarray) -> np.ndarray:
        """What the first so much volume of a ladder is worth; it must be there."""
        level = self.start[ladder] + np.maximum(searched(self.before, self.start[ladder], self.end[ladder], volume) - 1, 0)
        return self.worth[level] + self.price[level] * (volume - self.before[level])

    def crossing(self) -> tuple[np.ndarray, np.ndarray]:
        """Bid and ask ladders of a pair whose best prices after fees cross."""
        best = self.price[self.start]
        bids, asks = [], []
        for side in np.split(np.arange(len(self.start)), np.flatnonzero(np.diff(self.pair)) + 1):
            b, a = side[~self.ask[side]], side[self.ask[side]]
            i, j = np.nonzero(best[b][:, None] > best[a][None, :])
            bids.append(b[i])
            asks.append(a[j])
        return np.concatenate(bids), np.concatenate(asks)


def _whole_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[Ladders]:
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        run = runs_of_keys(batch, ("pair",))
        cut = int(np.searchsorted(run, run[-1]))
        if waiting and batch.column("pair")[0].as_py() != waiting[0].column("pair")[-1].as_py():
            yield Ladders(pa.Table.from_batches(waiting))
            waiting = []
        if cut:
            yield Ladders(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield Ladders(pa.Table.from_batches(waiting))


def executable(levels: DataFrame, fees: DataFrame, balances: DataFrame, compat_base_amount: bool = False) -> DataFrame:
    """Depth, executable amount, average prices and returns per opportunity.

    `balances`: (exchange, base_balance, quote_balance), null where unlimited.
    `compat_base_amount` takes the reciprocal of amounts above one as the base
    amount, and none below.  An opportunity looks up two ladders of running volume and value, at the
    price where it stops to pay and at the volume it trades; no level is repeated for it.
    """
    books = _books(levels, fees, balances)
    kinds = dict(books.dtypes)
    numbers = ("maximum_bid_depth", "maximum_ask_depth", "opposing_value", "executable_amount", "executable_amount_in_base", "__b", "__a")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for books_ in _whole_pairs(batches):
            bid, ask = books_.crossing()
            best = books_.price[books_.start]
            # raw prices that beat the other side's best after fees; bids rank by their negative
            n_bid = searched(books_.rank, books_.start[bid], books_.end[bid], -best[ask])
            n_ask = searched(books_.rank, books_.start[ask], books_.end[ask], best[bid])
            deep_bid, deep_ask = books_.depth(bid, n_bid), books_.depth(ask, n_ask)
            base = books_.balance["base_balance"][ask]
            opposing = books_.value(ask, np.fmax(0.0, np.fmin(base, deep_ask)))
            opposing = np.where(np.isnan(base), np.nan, opposing)
            amount = np.fmin(np.fmin(deep_bid, deep_ask), np.fmin(books_.balance["quote_balance"][bid], opposing))
            target = amount if not compat_base_amount else np.divide(1.0, amount, out=np.full(len(amount), np.nan), where=amount > 1)
            walks = [books_.value(side, np.fmax(0.0, np.fmin(target, deep))) for side, deep in ((bid, deep_bid), (ask, deep_ask))]
            columns = [deep_bid, deep_ask, opposing, amount, target, *(np.where(np.isnan(target), np.nan, w) for w in walks)]
            first = lambda name, ladder: books_.batch.column(name).take(pa.array(books_.start[ladder]))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([first("pair", bid), first("exchange", bid), first("exchange", ask), *(pa.array(c, from_pandas=True) for c in columns)], [*PAIR_KEY, *numbers])

    schema = f"pair {kinds['pair']}, bid_ex {kinds['exchange']}, ask_ex {kinds['exchange']}, " + ", ".join(f"{n} double" for n in numbers)
    out = books.mapInArrow(walked, schema)
    target = F.col("executable_amount_in_base")
    out = out.withColumns({"avg_bid": ratio(F.col("__b"), target), "avg_ask": ratio(F.col("__a"), target)}).drop("__a", "__b")
    both = (F.col("avg_bid") > 0) & (F.col("avg_ask") > 0)
    return out.withColumns(
        {
            "nominal_return": (F.col("avg_bid") - F.col("avg_ask")) * target,
            "pct_return": F.when(both, F.log(ratio(F.col("avg_bid"), F.when(both, F.col("avg_ask"))))),
        }
    )


def opposing_leg(levels: DataFrame, fees: DataFrame, balances: DataFrame) -> DataFrame:
    """Quote value of walking each ask book with the base balance held there."""
    held = balances.select("exchange", "base_balance", F.lit(None).cast("double").alias("quote_balance"))
    books = _books(levels.filter("side = 'ask'"), fees, held)
    kinds = dict(books.dtypes)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for books_ in _whole_pairs(batches):
            every = np.arange(len(books_.start))
            base = books_.balance["base_balance"]
            value = books_.value(every, np.fmax(0.0, np.fmin(base, books_.depth(every, books_.end - books_.start))))
            at = pa.array(books_.start)
            yield pa.RecordBatch.from_arrays(
                [books_.batch.column("pair").take(at), books_.batch.column("exchange").take(at), pa.array(np.where(np.isnan(base), np.inf, value))], ["pair", "exchange", "opposing_value"]
            )

    return books.mapInArrow(walked, f"pair {kinds['pair']}, exchange {kinds['exchange']}, opposing_value double")
