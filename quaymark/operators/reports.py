"""Report marts over run histories."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.functions.numeric import INF, ratio
from quaymark.operators.asof import backward_asof
from quaymark.operators.metrics import with_drawdown

ASSETS = ("SOL", "ETH", "BTC", "USDC")


def position_values(positions: DataFrame, history: DataFrame) -> DataFrame:
    """Signed legs (collateral +, debt -) with the net value as one more series."""
    side = F.initcap("side")
    signed = F.when(F.col("side") == "debt", -F.abs("value")).otherwise(F.col("value"))
    legs = positions.select(
        "run_id", "ts", F.concat_ws(" ", side, F.col("symbol")).alias("series"), signed.alias("value")
    )
    net = history.select("run_id", "ts", F.lit("Net Portfolio").alias("series"), F.col("portfolio_value").alias("value"))
    return legs.unionByName(net)


def composition(positions: DataFrame, side: str) -> DataFrame:
    """Long composition frame with values clipped at zero."""
    return positions.filter(F.col("side") == side).select(
        "run_id", "ts", F.col("symbol").alias("asset"), F.greatest("value", F.lit(0.0)).alias("value_usd")
    )


def melt(wide: DataFrame, ids: Sequence[str], name: str = "asset", value: str = "value_usd") -> DataFrame:
    """Wide columns to (name, value) rows."""
    rest = [c for c in wide.columns if c not in ids]
    return wide.unpivot(list(ids), rest, name, value)


def every_kth(history: DataFrame, most: int, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Keep every k-th bar per run, k = max(1, bars div most); short runs stay whole."""
    w = W.partitionBy(*keys)
    rows = history.withColumns(
        {"__n": F.count(F.lit(1)).over(w), "__i": F.row_number().over(w.orderBy("ts")) - 1}
    )
    k = F.greatest(F.lit(1), F.floor(F.col("__n") / F.lit(most)))
    return rows.filter((F.col("__n") <= most) | (F.col("__i") % k == 0)).drop("__n", "__i")


def evenly_spaced(history: DataFrame, most: int, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Keep `most` bars at evenly spaced positions from first to last.

    Position i is kept when some j has floor(j * step) = i, which is tested per
    row: j = ceil(i / step).
    """
    w = W.partitionBy(*keys)
    rows = history.withColumns(
        {"__n": F.count(F.lit(1)).over(w), "__i": F.row_number().over(w.orderBy("ts")) - 1}
    )
    gaps = F.lit(most - 1)
    j = F.ceil(F.col("__i") * gaps / (F.col("__n") - 1))
    hit = (j <= gaps) & (F.floor(j * (F.col("__n") - 1) / gaps) == F.col("__i"))
    return rows.filter((F.col("__n") <= most) | hit).drop("__n", "__i")


def existing_columns(summary: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted summary columns that are present, in the wanted order."""
    return summary.select(*[c for c in wanted if c in summary.columns])


def metric_frame(history: DataFrame, metric: str, runs: Sequence[str]) -> DataFrame:
    """One column per run: value normalised to 100, drawdown percent, or a raw column."""
    path = W.partitionBy("run_id").orderBy("ts")
    if metric == "normalized_portfolio_value":
        start = F.first("portfolio_value").over(path.rowsBetween(W.unboundedPreceding, 0))
        rows = history.withColumn("__m", ratio(F.col("portfolio_value"), start) * 100.0)
    elif metric == "drawdown_pct":
        rows = with_drawdown(history).withColumn("__m", F.abs("drawdown") * 100.0)
    else:
        rows = history.withColumn("__m", F.col(metric))
    return rows.groupBy("ts").pivot("run_id", list(runs)).agg(F.first("__m"))


def buy_and_hold_values(history: DataFrame, base_run: str, prices: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """What the run's starting equity would be worth held in each symbol.

    Symbols without a positive price at the first bar are left out.
    """
    rows = history.filter(F.col("run_id") == base_run).select(
        "ts", "portfolio_value", F.explode(F.array(*[F.lit(s) for s in symbols])).alias("symbol")
    )
    aligned = backward_asof(rows, prices, ["symbol"], ["price"], long=False)
    upto = W.partitionBy("symbol").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    aligned = aligned.withColumns(
        {"__p0": F.first("price").over(upto), "__v0": F.first("portfolio_value").over(upto)}
    )
    return aligned.filter(F.col("__p0") > 0).select(
        "symbol", "ts", (F.col("price") * F.col("__v0") / F.col("__p0")).alias("value")
    )


def with_price(history: DataFrame, prices: DataFrame, symbol: str) -> DataFrame:
    """Attach the as-of price of one symbol as `sol_price`; all runs look up the same series."""
    one = prices.filter(F.col("symbol") == symbol).select("symbol", "ts", F.col("price").alias("sol_price"))
    keyed = history.withColumn("symbol", F.lit(symbol))
    return backward_asof(keyed, one, ["symbol"], ["sol_price"]).drop("symbol")


def temperature(priced: DataFrame) -> DataFrame:
    """Net exposure next to the price; incomplete rows drop out."""
    return priced.select(
        "run_id", "ts", "sol_price", (F.col("target_long_fraction") - F.col("target_short_fraction")).alias("net_temperature")
    ).dropna(subset=["sol_price", "net_temperature"])


def _fmt3(c: Column) -> Column:
    return F.format_string("%.3f", c)


def timeline(priced: DataFrame) -> DataFrame:
    """Strategy events per bar: start, rotation, buy/sell, short/cover, liquidation.

    Bars without a price emit nothing but still count as the previous bar, except
    for the liquidation counter, which remembers the last priced bar.
    """
    path = W.partitionBy("run_id").orderBy("ts")
    before = path.rowsBetween(W.unboundedPreceding, -1)
    has_price = F.col("sol_price").isNotNull()
    rows = priced.withColumns(
        {
            "__first": F.row_number().over(path) == 1,
            "__l": F.lag("target_long_fraction").over(path),
            "__s": F.lag("target_short_fraction").over(path),
            "__sel": F.lag("selected_long").over(path),
            "__liq": F.coalesce(
                F.last(F.when(has_price, F.col("liquidation_count")), ignorenulls=True).over(before), F.lit(0)
            ),
        }
    ).filter(has_price)
    long, short, sel = F.col("target_long_fraction"), F.col("target_short_fraction"), F.col("selected_long")
    l0, s0, sel0 = F.col("__l"), F.col("__s"), F.col("__sel")
    named = lambda c, empty: F.when(c == "", empty).otherwise(c)
    event = lambda test, family, *text: F.when(
        test, F.struct(family.alias("event_family"), F.concat(*text).alias("event"))
    )
    lit, later = F.lit, ~F.col("__first")
    updown = lambda now, old: F.when(now > old, "raised").otherwise("cut")
    events = F.array(
        event(F.col("__first"), lit("start"), lit("Started with "), named(sel, "no"), lit(" long target "), _fmt3(long)),
        event(later & (sel != sel0), lit("rotation"), lit("Long asset changed from "), named(sel0, "none"), lit(" to "), named(sel, "none")),
        event(later & (F.abs(long - l0) >= 0.05), F.when(long > l0, "buy").otherwise("sell"),
              lit("Long target "), updown(long, l0), lit(" from "), _fmt3(l0), lit(" to "), _fmt3(long)),
        event(later & (F.abs(short - s0) >= 0.01), F.when(short > s0, "short").otherwise("cover"),
              lit("Hedge/short target "), updown(short, s0), lit(" from "), _fmt3(s0), lit(" to "), _fmt3(short)),
        event(later & (F.col("liquidation_count") > F.col("__liq")), lit("liquidation"),
              lit("Liquidations increased from "), F.col("__liq").cast("string"), lit(" to "), F.col("liquidation_count").cast("string")),
    )
    return rows.select(
        "*", F.posexplode(F.filter(events, lambda e: e.isNotNull())).alias("event_no", "__e")
    ).select("*", "__e.*").drop("__e", "__first", "__l", "__s", "__sel", "__liq")


def timeline_frame(priced: DataFrame, shots: DataFrame) -> DataFrame:
    """The timeline's events with price, targets, health, drawdown and the account's snapshot of their bar."""
    return timeline(priced).join(shots, ["run_id", "ts"], "left")


def money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


def snapshots(history: DataFrame, positions: DataFrame, assets: Sequence[str] = ASSETS) -> DataFrame:
    """Text and structured account snapshot per bar; values at or below zero stay blank."""
    at = lambda side, a: F.max(F.when((F.col("side") == side) & (F.col("symbol") == a), F.col("value")))
    slots = [(side, a) for side in ("collateral", "debt") for a in assets]
    wide = positions.groupBy("run_id", "ts").agg(*[at(s, a).alias(f"__{s}_{a}") for s, a in slots])
    rows = history.select("run_id", "ts", "portfolio_value").join(wide, ["run_id", "ts"], "left")
    blank = lambda c: F.when(c > 0, money(c)).otherwise("")
    part = lambda s, a: F.when(
        F.col(f"__{s}_{a}") > 0, F.concat(F.lit(f"{s} {a}="), money(F.col(f"__{s}_{a}")))
    )
    text = F.concat_ws(" | ", F.concat(F.lit("portfolio="), money(F.col("portfolio_value"))), *[part(s, a) for s, a in slots])
    return rows.select(
        "run_id", "ts", text.alias("portfolio_snapshot"),
        blank(F.col("portfolio_value")).alias("snapshot_portfolio"),
        *[blank(F.col(f"__{s}_{a}")).alias(f"snapshot_{s}_{a}") for s, a in slots],
    )


def final_composition(positions: DataFrame, side: str) -> DataFrame:
    """Latest positive values and their shares per run."""
    rows = composition(positions, side)
    last = F.max("ts").over(W.partitionBy("run_id"))
    final = rows.withColumn("__last", last).filter(F.col("ts") == F.col("__last"))
    total = F.sum("value_usd").over(W.partitionBy("run_id"))
    return final.withColumn("share_pct", ratio(F.col("value_usd"), total, 0.0) * 100.0).filter("value_usd > 0").select(
        "run_id", "asset", "value_usd", "share_pct"
    )


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[_.]", "")


#: Characters of the pieces that names are looked up by.
_PIECE = 3


def _pieces(c: Column) -> Column:
    """All pieces of a compact name, down to the empty one, so that short names are found too."""
    parts = [F.when(F.length(c) >= n, _pieces_of(c, n)).otherwise(F.array().cast("array<string>")) for n in range(1, _PIECE + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *parts))


def _pieces_of(c: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: c.substr(i, F.lit(n)))


def _met(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that never broadcasts: rows made by `explode` are many more than the size of their file tells."""
    return left.join(right.hint("merge"), on, how)


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (report_id, part, whole) of compact names of a report where the part is in the whole.

    Both sides: (report_id, compact), every name once.  A whole name is listed under all its pieces; a part is looked
    up by the one of its own pieces that fewest whole names of the report have, and compared with what is found.
    """
    listed = outer.select("report_id", F.col("compact").alias("whole"), F.explode(_pieces(F.col("compact"))).alias("piece"))
    known = listed.groupBy("report_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length("compact") >= _PIECE, _pieces_of(F.col("compact"), _PIECE)).otherwise(F.array("compact"))
    asked = inner.select("report_id", F.col("compact").alias("part"), F.explode(F.array_distinct(own)).alias("piece"))
    rarest = (
        _met(asked, known, ["report_id", "piece"], "left")
        .groupBy("report_id", "part")
        .agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    )
    return _met(rarest, listed, ["report_id", "piece"]).filter(F.col("whole").contains(F.col("part"))).select("report_id", "part", "whole")


def claimed_histories(summary: DataFrame, histories: DataFrame) -> DataFrame:
    """(report_id, no, summary_name, history_name) of every summary row that finds a history, handed out in order.

    `summary` and `histories`: (report_id, name, place); places order the rows of a report, names break ties.
    A row takes its own name, or the history of its known role, or the first whose
    compact name holds its own or is held by it; from those that are still free, or, where none is,
    from all.  A report is walked through in order with the set of its taken histories as state.
    """
    number = lambda df: df.withColumn("no", F.row_number().over(W.partitionBy("report_id").orderBy("place", "name"))).withColumn("compact", compact(F.col("name")))
    s = number(summary.filter("name IS NOT NULL").select("report_id", "name", "place"))
    h = number(histories.filter("name IS NOT NULL").groupBy("report_id", "name").agg(F.min("place").alias("place")))
    low = F.lower("name")
    first = low.contains("static") | low.contains("highest_return")
    second = low.contains("sortino") | low.startswith("rv")
    wishes = F.array_compact(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("name").alias("wish")),
        F.when(first, F.struct(F.lit(1).alias("kind"), F.lit("highest_return").alias("wish"))),
        F.when(second, F.struct(F.lit(2).alias("kind"), F.lit("high_sortino").alias("wish"))),
    ))
    named = _met(s.select("report_id", "no", F.inline(wishes)), h.select("report_id", F.col("name").alias("wish"), F.col("no").alias("h")), ["report_id", "wish"])
    # many rows of a report share a name: names are compared once, and rows look up what theirs found
    rows, kept = (df.select("report_id", "compact").distinct() for df in (s, h))
    pairs = _contained(kept, rows).select("report_id", F.col("whole").alias("compact"), F.col("part").alias("kept")).union(
        _contained(rows, kept).select("report_id", F.col("part").alias("compact"), F.col("whole").alias("kept"))
    ).distinct()
    places = _met(pairs, h.select("report_id", F.col("compact").alias("kept"), F.col("no").alias("h")), ["report_id", "kept"])
    parts = _met(s.select("report_id", "compact", "no"), places, ["report_id", "compact"]).select("report_id", "no", "h")
    found = named.select("report_id", "no", "kind", "h").unionByName(parts.select("report_id", "no", F.lit(3).alias("kind"), "h"))
    ordered = found.repartition("report_id").sortWithinPartitions("report_id", "no", "kind", "h").select("report_id", "no", "h")

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, row, taken = None, None, set()
        choice = fallback = None

        for batch in batches:
            out: list[tuple] = []
            for r, no, history in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (r, no) != (report, row):
                    if row is not None:
                        taken.add(choice if choice is not None else fallback)
                        out.append((report, row, choice if choice is not None else fallback))
                    if r != report:
                        taken = set()
                    report, row, choice, fallback = r, no, None, history
                if choice is None and history not in taken:
                    choice = history
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [batch.schema.field(0).type, pa.int32(), pa.int32()], strict=True)], ["report_id", "no", "h"])
            kind = batch.schema.field(0).type
        if row is not None:
            last = choice if choice is not None else fallback
            yield pa.RecordBatch.from_arrays([pa.array([report], kind), pa.array([row], pa.int32()), pa.array([last], pa.int32())], ["report_id", "no", "h"])

    handed = ordered.mapInArrow(claim, f"report_id {dict(ordered.dtypes)['report_id']}, no int, h int")
    named_rows = _met(handed, s.select("report_id", "no", F.col("name").alias("summary_name")), ["report_id", "no"])
    return _met(named_rows, h.select("report_id", F.col("no").alias("h"), F.col("name").alias("history_name")), ["report_id", "h"]).select(
        "report_id", "no", "summary_name", "history_name"
    )


def match_histories(summary: DataFrame, histories: DataFrame) -> DataFrame:
    """(report_id, label, history_name): summary names with the history their last row got, and histories that no label names.

    Rows without a place go by name.
    """
    placed = lambda df: df if "place" in df.columns else df.withColumn("place", F.lit(0))
    summary, histories = placed(summary), placed(histories)
    got = claimed_histories(summary, histories).groupBy("report_id", F.col("summary_name").alias("label")).agg(F.max_by("history_name", "no").alias("history_name"))
    every = histories.filter("name IS NOT NULL").select("report_id", F.col("name").alias("label")).distinct()
    return got.unionByName(_met(every, got, ["report_id", "label"], "left_anti").withColumn("history_name", F.col("label")))


#: Series of hedge levels and hedge profit.
HEDGE_SERIES = ("target_ratio", "actual_ratio", "marked_ratio", "lifetime_realized_pnl", "spendable_profit", "open_short_basis")


def hedge_levels(events: DataFrame, ratios: DataFrame) -> DataFrame:
    """Target, actual and marked hedge ratio and PnL series at each event.

    `events`: (run_id, ts) and, as far as they are there, target_ratio, current_short_ratio,
    lifetime_realized, spendable, open_short_amount and average_basis; what is missing is null.
    `ratios`: (run_id, ts, debt_value, collateral_value); an infinite or missing
    mark is 0.
    """
    wanted = ("target_ratio", "current_short_ratio", "lifetime_realized", "spendable", "open_short_amount", "average_basis")
    events = events.withColumns({c: F.lit(None).cast("double") for c in wanted if c not in events.columns})
    marked = backward_asof(events, ratios, ["run_id"], ["debt_value", "collateral_value"])
    mark = ratio(F.col("debt_value"), F.col("collateral_value"), 0.0)
    return marked.select(
        *events.columns,
        F.col("current_short_ratio").cast("double").alias("actual_ratio"),
        F.when(F.abs(mark) < F.lit(INF), mark).otherwise(0.0).alias("marked_ratio"),
        F.col("lifetime_realized").cast("double").alias("lifetime_realized_pnl"),
        F.col("spendable").cast("double").alias("spendable_profit"),
        (F.col("open_short_amount") * F.col("average_basis")).alias("open_short_basis"),
    )


def kpi_deltas(summary: DataFrame, measures: Sequence[str], baseline: str) -> DataFrame:
    """Each run's KPIs and their difference to one chosen run."""
    base = summary.filter(F.col("run_id") == baseline).select(F.struct(*measures).alias("b")).scalar()
    rows = summary.withColumn("__b", base)
    return rows.select(
        "run_id", *measures, *[(F.col(m) - F.col(f"__b.{m}")).alias(f"delta_{m}") for m in measures]
    )
