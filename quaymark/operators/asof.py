"""As-of joins, multi-symbol alignment and interval lookups."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.operators.ranged import Last, Stage, scanned


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join where null equals null; the columns of `on` come from the left side."""
    renamed = right.withColumnsRenamed({c: f"__on_{c}" for c in on})
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on])
    return left.join(renamed, same, "left").drop(*[f"__on_{c}" for c in on])


def backward_asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    ts: str = "ts",
    long: bool = True,
) -> DataFrame:
    """Give each left row the values of the latest right row at or before its ts.

    The latest row counts even where its value is null; only a missing row leaves null.  Left
    rows with a null key or ts stay and find nothing; right rows with one are never found.  Both
    sides go through one shuffle; nothing is multiplied.  Keys may be long on either side (all
    accounts look up one price series): the rows are partitioned by range of (key, ts), and a
    partition takes over the last row before it.  `long=False` uses one plain window per key,
    for keys whose rows have a bound.
    """
    keys, values = list(keys), list(values)
    lcols = [c for c in left.columns if c not in keys and c != ts]
    l_side = left.select(
        *keys, F.col(ts).alias("__ts"), F.lit(1).alias("__side"), *[F.col(c).alias(f"__l_{c}") for c in lcols]
    )
    r_side = right.dropna(subset=[*keys, ts]).select(
        *keys, F.col(ts).alias("__ts"), F.lit(0).alias("__side"), *[F.col(v).alias(f"__r_{v}") for v in values]
    )
    both = l_side.unionByName(r_side, allowMissingColumns=True)
    is_right = F.col("__side") == 0
    if long:
        found = [f"__f_{v}" for v in values]
        stage = Stage((Last("__right", tuple(f"__r_{v}" for v in values), tuple(found)),))
        kinds = dict(both.dtypes)
        rows = scanned(both.withColumn("__right", is_right), keys, ["__ts", "__side"], [stage], {f: kinds[f"__r_{v}"] for f, v in zip(found, values)})
        seen = [F.col(f).alias(v) for f, v in zip(found, values)]
    else:
        row = F.when(is_right, F.struct(*[F.col(f"__r_{v}").alias(v) for v in values]))
        inside = W.partitionBy(*keys).orderBy("__ts", "__side").rowsBetween(W.unboundedPreceding, 0)
        rows = both.withColumn("__seen", F.last(row, ignorenulls=True).over(inside))
        seen = [F.col(f"__seen.{v}").alias(v) for v in values]
    return rows.filter(~is_right).select(*keys, F.col("__ts").alias(ts), *[F.col(f"__l_{c}").alias(c) for c in lcols], *seen)


def align_symbols(bars: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Give every symbol a row at every ts, forward-filled; start where all exist.

    The bars of one ts (at most one per configured symbol) fold into a map, which
    is read back per symbol: no join and no second scan of the bars.  Bars per
    symbol are bounded by span / bar length, so the fill is a plain window.
    """
    fields = ["open", "high", "low", "close", "volume"]
    by_ts = (
        bars.filter(F.col("symbol").isin(*symbols))
        .groupBy("ts")
        .agg(F.map_from_entries(F.collect_list(F.struct("symbol", F.struct(*fields)))).alias("__at"))
    )
    grid = by_ts.select("ts", "__at", F.explode(F.array(*[F.lit(s) for s in symbols])).alias("symbol"))
    w = W.partitionBy("symbol").orderBy("ts")
    row = F.try_element_at("__at", F.col("symbol"))
    filled = grid.select("symbol", "ts", row.alias("__row")).select(
        "symbol", "ts", *[F.last(F.col(f"__row.{f}"), ignorenulls=True).over(w).alias(f) for f in fields]
    )
    missing = sum((F.col(f).isNull().cast("int") for f in fields), F.lit(0))
    complete = F.sum(missing).over(W.partitionBy("ts")) == 0
    return filled.withColumn("__ok", complete).filter("__ok").drop("__ok")


def join_overlap(prices: DataFrame, signals: DataFrame, on: Sequence[str] = ("ts",)) -> DataFrame:
    """Rows that prices and signals share; raises where they share none (one row is looked for)."""
    both = prices.join(signals, list(on))
    if not both.limit(1).count():
        raise ValueError("prices and signals do not overlap")
    return both


#: Hours of a bin on each level, and how many bins make one of the next.
_FANOUT, _LEVELS = 32, 5
#: Years that open ends reach to, in hours from 1970.
_EARLIEST, _LATEST = -24 * 366 * 1970, 24 * 366 * 8030


def _bins(first: Column, end: Column) -> Column:
    """Bins (level, number) that together cover the hours from first up to, not including, end.

    Wide bins in the middle and narrow ones at both ends: a logarithmic number.
    """
    out = []
    low = [F.ceil(first / _FANOUT**k).cast("long") for k in range(_LEVELS)]  # whole bins of a level begin here
    high = [F.floor(end / _FANOUT**k).cast("long") for k in range(_LEVELS)]
    for k in range(_LEVELS):
        used, wider = low[k] <= high[k], low[k + 1] <= high[k + 1] if k + 1 < _LEVELS else F.lit(False)
        rest = (low[k + 1] * _FANOUT, high[k + 1] * _FANOUT) if k + 1 < _LEVELS else (high[k], high[k])
        runs = (low[k], F.when(wider, rest[0]).otherwise(high[k])), (F.when(wider, rest[1]).otherwise(high[k]), high[k])
        for a, b in runs:
            numbers = F.when(used & (a < b), F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
            level = F.lit(k).alias("level")
            out.append(F.transform(numbers, lambda n: F.struct(level, n.alias("bin"))))  # noqa: B023
    return F.concat(*out)


def _hour(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(3_600_000_000)).cast("long")


def interval_rows(df: DataFrame, ts: str, intervals: DataFrame, name: str) -> DataFrame:
    """Repeat each row for every interval that holds its ts, with the interval's columns other than its bounds.

    `intervals`: (`name`, start, end) and more; any number of rows.  Both ends are inclusive, null is open; an
    interval that ends before it starts holds nothing, and a row without ts lies in none.  Rows meet
    intervals by equality on time bins of several widths: an interval is covered by a logarithmic number of
    bins, and a row lies in one of each width, so an interval is found once.  Exact bounds decide.
    """
    others = [c for c in intervals.columns if c not in ("start", "end")]
    bounds = intervals.select(
        *[F.col(c).alias(c if c == name else f"__i_{c}") for c in others], F.col("start").cast("timestamp").alias("__start"), F.col("end").cast("timestamp").alias("__end")
    )
    first = F.coalesce(_hour(F.col("__start")), F.lit(_EARLIEST).cast("long"))
    after = F.coalesce(_hour(F.col("__end")), F.lit(_LATEST).cast("long")) + 1
    covered = bounds.withColumns({"__first": first, "__after": after}).filter("__first < __after")
    pieces = covered.select("*", F.inline(_bins(F.col("__first"), F.col("__after")))).drop("__first", "__after")
    hour = _hour(F.col(ts))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(hour / _FANOUT**k).cast("long").alias("bin")) for k in range(_LEVELS)])
    placed = df.filter(F.col(ts).isNotNull()).select("*", F.inline(levels))
    inside = (F.col("__start").isNull() | (F.col(ts) >= F.col("__start"))) & (F.col("__end").isNull() | (F.col(ts) <= F.col("__end")))
    found = placed.join(pieces, ["level", "bin"]).filter(inside)
    return found.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(c if c == name else f"__i_{c}").alias(c) for c in others])


def named_intervals(labels: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """(name, start, end) of every label that occurs, once: the known bounds, or open ones; and a `full` one."""
    used = labels.select(name).filter(F.col(name).isNotNull()).distinct()
    open_ = F.lit(None).cast("timestamp")
    full = used.sparkSession.range(1).select(F.lit("full").alias(name))
    every = used.union(full).distinct()
    return every.join(known.select(name, F.col("start").cast("timestamp").alias("start"), F.col("end").cast("timestamp").alias("end")), name, "left").select(
        name, F.coalesce("start", open_).alias("start"), F.coalesce("end", open_).alias("end")
    )


def tier_array(tiers: DataFrame, key: str) -> DataFrame:
    """Fold a tier table into one sorted array per key (a venue has a few tiers)."""
    others = [c for c in tiers.columns if c != key and c != "floor"]
    return tiers.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("floor", *others))).alias("tiers")
    )


def tier_of(amount: Column, tiers: Column) -> Column:
    """Lowest tier whose inclusive range holds |amount|; else the highest tier."""
    size = F.abs(amount)
    hit = F.filter(
        tiers,
        lambda t: (t["floor"] <= size) & (t["cap"].isNull() | (size <= t["cap"])),
    )
    return F.when(F.size(hit) > 0, F.element_at(hit, 1)).otherwise(F.element_at(tiers, -1))


def enrich(rows: DataFrame, dim: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Attach a small dimension; rows whose key it lacks get the defaults."""
    joined = rows.join(dim, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def relative_to_baseline(
    df: DataFrame, group: str, name: str, baseline: str, measures: Sequence[str], suffix: str
) -> DataFrame:
    """Subtract the baseline row of the same group from every row."""
    base = df.filter(F.col(name) == baseline).select(
        group, *[F.col(m).alias(f"__b_{m}") for m in measures]
    )
    joined = df.join(base, group)
    return joined.select(
        *df.columns,
        *[(F.col(m) - F.col(f"__b_{m}")).alias(f"{m}_{suffix}") for m in measures],
    )
