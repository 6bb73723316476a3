"""Running values over keys of any length, in one range-partitioned pass.

Rows are partitioned by range of (key, order), so the cuts follow the data: a key with a third of
all rows is spread over a third of the partitions.  At most one key continues over each cut, so
a partition is summed up by one row: how its last key's state follows from the state the key
came in with.  Those rows (one per partition) are folded in order, and every partition then works out its
rows from its entry state.  Recurrences that depend on each other are stages: the entry states
of one are known before the next is summed up.

All passes read the same exchange, which Spark runs once; nothing else shuffles the rows, and
building a plan starts no job.  A summary carries the first key of its partition, and a pass that
meets another partition than the summary's raises, so that a lost reuse cannot give wrong values.
"""

from __future__ import annotations

import bisect
import pickle
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Values = dict[str, object]
_SUMMARY = "part int, first string, last string, single boolean, summary binary"


class Frame:
    """Columns of a batch by name: Arrow as they came, numpy as they are asked for."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self.made = batch, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.made:
            self.made[name] = self.batch.column(name).to_numpy(zero_copy_only=False)
        return self.made[name]

    def arrow(self, name: str) -> pa.Array:
        return self.batch.column(name)


def _added(x: np.ndarray, run: np.ndarray, entry: float) -> np.ndarray:
    """Running sums of runs, the first from `entry` on, each row added to the one before as a plain loop does.

    Compensated sums differ from it in the last bits, which decide where a sum comes back to a threshold or to zero.
    """
    out = np.empty(len(x))
    starts = np.flatnonzero(np.diff(run, prepend=run[0] - 1))
    ends = np.append(starts[1:], len(x))
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        out[a:b] = x[a:b]
        if a == 0:
            out[0] += entry
        np.cumsum(out[a:b], out=out[a:b])
    return out


def _grouped(values: np.ndarray, run: np.ndarray):
    return pd.Series(values).groupby(run, sort=False)


@dataclass(frozen=True)
class Sum:
    """Running sum, nulls as 0; `before` leaves the row itself out."""

    value: str
    out: str
    before: bool = False
    zero = 0.0
    identity = 0.0

    def rows(self, f: Frame, run: np.ndarray, entry: float) -> tuple[Values, float]:
        x = np.nan_to_num(f[self.value].astype(float))
        total = _added(x, run, entry)
        out = total
        if self.before:
            start = np.concatenate([[True], run[1:] != run[:-1]])
            out = np.where(start, np.where(run == 0, entry, 0.0), np.concatenate([[0.0], total[:-1]]))
        return {self.out: out}, float(total[-1])

    def extend(self, summary: float, f: Frame, a: int) -> float:
        x = np.nan_to_num(f[self.value][a:].astype(float))
        return float(_added(x, np.zeros(len(x), int), summary)[-1])

    def apply(self, summary: float, state: float) -> float:
        return state + summary


@dataclass(frozen=True)
class Extreme:
    """Running minimum, or maximum, of what isn't null."""

    value: str
    out: str
    high: bool
    before: bool = False
    zero = None
    identity = None

    def _join(self, a: float | None, b: float | None) -> float | None:
        return b if a is None else a if b is None else (max if self.high else min)(a, b)

    def rows(self, f: Frame, run: np.ndarray, entry: float | None) -> tuple[Values, float | None]:
        worst = -np.inf if self.high else np.inf
        x = f[self.value].astype(float)
        x = np.where(np.isnan(x), worst, x)
        groups = _grouped(x, run)
        now = (groups.cummax() if self.high else groups.cummin()).to_numpy()
        pick, came = np.maximum if self.high else np.minimum, worst if entry is None else entry
        now = np.where(run == 0, pick(now, came), now)
        out = now
        if self.before:
            start = np.concatenate([[True], run[1:] != run[:-1]])
            out = np.where(start, np.where(run == 0, came, worst), np.concatenate([[worst], now[:-1]]))
        return {self.out: np.where(np.isinf(out), np.nan, out)}, None if np.isinf(now[-1]) else float(now[-1])

    def extend(self, summary: float | None, f: Frame, a: int) -> float | None:
        x = f[self.value][a:].astype(float)
        x = x[~np.isnan(x)]
        return self._join(summary, float(x.max() if self.high else x.min()) if len(x) else None)

    def apply(self, summary: float | None, state: float | None) -> float | None:
        return self._join(state, summary)


@dataclass(frozen=True)
class Peak:
    """Running maximum, and rows since it was last reached.

    A summary is (maximum, rows since its last place, rows): below a higher peak, all rows count on.
    """

    value: str
    out: str
    below: str
    zero = (None, 0)
    identity = (None, 0, 0)

    def rows(self, f: Frame, run: np.ndarray, entry: tuple) -> tuple[Values, tuple]:
        came, since = entry
        x = f[self.value].astype(float)
        top = _grouped(np.where(np.isnan(x), -np.inf, x), run).cummax().to_numpy()
        if came is not None:
            top = np.where(run == 0, np.maximum(top, came), top)
        row = np.arange(len(x))
        # the row before a run's first; where a run goes on, its last row at the peak may lie further back
        start = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])[run]
        unreached = np.where((run == 0) & (came is not None), -1 - since, start - 1)
        at = _grouped(np.where(x >= top, row, np.iinfo(np.int64).min), run).cummax().to_numpy()
        below = row - np.maximum(at, unreached)
        return {self.out: np.where(np.isinf(top), np.nan, top), self.below: pa.array(below, mask=np.isinf(top))}, (None if np.isinf(top[-1]) else float(top[-1]), int(below[-1]))

    def extend(self, summary: tuple, f: Frame, a: int) -> tuple:
        high, since, n = summary
        x = f[self.value][a:].astype(float)
        m = len(x)
        if not np.isnan(x).all() and (high is None or np.nanmax(x) >= high):
            top = np.nanmax(x)
            return float(top), m - 1 - int(np.flatnonzero(x == top)[-1]), n + m
        return high, since + m, n + m

    def apply(self, summary: tuple, state: tuple) -> tuple:
        high, since, n = summary
        came, below = state
        if high is not None and (came is None or high >= came):
            return high, since
        return came, below + n


@dataclass(frozen=True)
class Last:
    """Values of the latest row where `when` holds, nulls among them too; of any types."""

    when: str
    values: tuple[str, ...]
    outs: tuple[str, ...]
    before: bool = False
    zero = None
    identity = None

    def rows(self, f: Frame, run: np.ndarray, entry: tuple | None) -> tuple[Values, tuple | None]:
        n, hit = len(run), f[self.when].astype(bool)
        at = _grouped(np.where(hit, np.arange(n), -1), run).cummax().to_numpy()
        end = int(at[-1])
        if self.before:
            at = np.where(np.concatenate([[True], run[1:] != run[:-1]]), -1, np.concatenate([[-1], at[:-1]]))
        came = (at < 0) & (run == 0) & (entry is not None)
        index = pa.array(np.where(came, n, at), mask=(at < 0) & ~came)
        out = {}
        for k, (name, to) in enumerate(zip(self.values, self.outs, strict=True)):
            column = f.arrow(name)
            out[to] = pa.concat_arrays([column, pa.array([None if entry is None else entry[k]], column.type)]).take(index)
        if end >= 0:
            return out, tuple(f.arrow(name)[end].as_py() for name in self.values)
        return out, entry if int(run[-1]) == 0 else None

    def extend(self, summary: tuple | None, f: Frame, a: int) -> tuple | None:
        hit = np.flatnonzero(f[self.when][a:].astype(bool))
        return tuple(f.arrow(name)[a + int(hit[-1])].as_py() for name in self.values) if len(hit) else summary

    def apply(self, summary: tuple | None, state: tuple | None) -> tuple | None:
        return state if summary is None else summary


@dataclass(frozen=True)
class Floored:
    """The level max(level + flow, 0), and the level before; a summary is (sum, end level from 0)."""

    value: str
    out: str
    prev: str
    zero = 0.0
    identity = (0.0, 0.0)

    def rows(self, f: Frame, run: np.ndarray, entry: float) -> tuple[Values, float]:
        level, last, levels, before = entry, 0, [], []
        for r, x in zip(run.tolist(), np.nan_to_num(f[self.value].astype(float)).tolist(), strict=True):
            if r != last:
                level, last = 0.0, r
            before.append(level)
            level = max(level + x, 0.0)
            levels.append(level)
        return {self.out: np.array(levels), self.prev: np.array(before)}, level

    def extend(self, summary: tuple[float, float], f: Frame, a: int) -> tuple[float, float]:
        total, level = summary
        s = np.cumsum(np.nan_to_num(f[self.value][a:].astype(float)))
        return total + float(s[-1]), float(max(level + s[-1], s[-1] - s.min(), 0.0))

    def apply(self, summary: tuple[float, float], state: float) -> float:
        return max(state + summary[0], summary[1])


@dataclass(frozen=True)
class Affine:
    """y = a * y_before + b, and y_before."""

    a: str
    b: str
    out: str
    prev: str
    zero = 0.0
    identity = (1.0, 0.0)

    def rows(self, f: Frame, run: np.ndarray, entry: float) -> tuple[Values, float]:
        y, before, after, last = entry, [], [], 0
        for r, a, b in zip(run.tolist(), f[self.a].tolist(), f[self.b].tolist(), strict=True):
            if r != last:
                y, last = 0.0, r
            before.append(y)
            y = a * y + b
            after.append(y)
        return {self.out: np.array(after), self.prev: np.array(before)}, y

    def extend(self, summary: tuple[float, float], f: Frame, start: int) -> tuple[float, float]:
        scale, shift = summary
        for a, b in zip(f[self.a][start:].tolist(), f[self.b][start:].tolist(), strict=True):
            scale, shift = a * scale, a * shift + b
        return scale, shift

    def apply(self, summary: tuple[float, float], state: float) -> float:
        return summary[0] * state + summary[1]


@dataclass(frozen=True)
class Spent:
    """Spending of up to `wanted` out of what `earned` leaves over what was spent so far.

    spent' = max(spent, min(spent + wanted, earned)).  As a function of what came in it only rises,
    by slopes of 0 and 1; a summary is the list of its corners.
    """

    wanted: str
    earned: str
    out: str
    now: str
    zero = 0.0
    identity = ((0.0,), (0.0,))

    def rows(self, f: Frame, run: np.ndarray, entry: float) -> tuple[Values, float]:
        spent, last, total, parts = entry, 0, [], []
        for r, w, e in zip(run.tolist(), f[self.wanted].tolist(), f[self.earned].tolist(), strict=True):
            if r != last:
                spent, last = 0.0, r
            before = spent
            spent = max(spent, min(spent + w, e))
            total.append(spent)
            parts.append(spent - before)
        return {self.out: np.array(total), self.now: np.array(parts)}, spent

    def extend(self, summary: tuple, f: Frame, start: int) -> tuple:
        xs, ys = map(list, summary)
        for w, e in zip(f[self.wanted][start:].tolist(), f[self.earned][start:].tolist(), strict=True):
            if w <= 0:
                continue
            for corner in (e - w, e):  # where the step bends, in what was spent before it
                k = bisect.bisect_left(ys, corner)
                if k == len(ys):
                    xs.append(xs[-1] + corner - ys[-1])
                    ys.append(corner)
                elif ys[k] != corner and k > 0:
                    xs.insert(k, xs[k] - (ys[k] - corner))
                    ys.insert(k, corner)
            lo, hi = bisect.bisect_left(ys, e - w), bisect.bisect_right(ys, e)
            ys = [max(y, min(y + w, e)) for y in ys]
            if hi - lo > 2:  # a flat piece needs its ends only
                del xs[lo + 1 : hi - 1], ys[lo + 1 : hi - 1]
        return tuple(xs), tuple(ys)

    def apply(self, summary: tuple, state: float) -> float:
        xs, ys = summary
        k = bisect.bisect_right(xs, state) - 1
        if k < 0:
            raise ValueError("nothing can have been spent below zero")
        if k == len(xs) - 1:
            return ys[k] + state - xs[k]
        return ys[k] if ys[k + 1] == ys[k] else ys[k] + state - xs[k]


@dataclass(frozen=True)
class Trailing:
    """Percentile rank of a row's value, or the median, among the last `n` rows, nulls left out.

    The window is kept sorted: a row enters and one leaves.  `least` is how many values it must hold.
    Ties share their mean rank.  A state is the last n - 1 values.
    """

    value: str
    out: str
    n: int
    least: int
    stat: str
    zero = ()
    identity = ()

    def rows(self, f: Frame, run: np.ndarray, entry: tuple) -> tuple[Values, tuple]:
        x = f[self.value].astype(float)
        values, missing = x.tolist(), np.isnan(x).tolist()
        seen, last, out = deque(entry), 0, []
        window = sorted(v for v in seen if v == v)
        for r, v, gone in zip(run.tolist(), values, missing, strict=True):
            if r != last:
                seen.clear()
                window.clear()
                last = r
            if len(seen) == self.n:
                old = seen.popleft()
                if old == old:
                    del window[bisect.bisect_left(window, old)]
            seen.append(v)
            if not gone:
                bisect.insort(window, v)
            m = len(window)
            if m < max(1, self.least) or gone and self.stat == "rank":
                out.append(None)
            elif self.stat == "rank":
                below = bisect.bisect_left(window, v)
                out.append((below + (bisect.bisect_right(window, v) - below + 1) / 2.0) / m)
            else:
                out.append((window[(m - 1) // 2] + window[m // 2]) / 2.0)
        return {self.out: pa.array(out, pa.float64())}, self._tail(tuple(seen))

    def _tail(self, values: tuple) -> tuple:
        return values[max(0, len(values) - self.n + 1) :]

    def extend(self, summary: tuple, f: Frame, a: int) -> tuple:
        return self._tail(summary + tuple(f[self.value][a:].astype(float).tolist()[-self.n :]))

    def apply(self, summary: tuple, state: tuple) -> tuple:
        return self._tail(state + summary)


@dataclass(frozen=True)
class LowestSince:
    """Lowest value since the last row where `reset` holds, that row included, and its place; ties go to the first."""

    value: str
    place: str
    reset: str
    out: str
    at: str
    zero = None
    identity = (False, None)

    def _walk(self, f: Frame, a: int, state: tuple | None, run: list[int]) -> Iterator[tuple | None]:
        last = run[0]
        for r, v, p, new in zip(run, f[self.value][a:].tolist(), f[self.place][a:].tolist(), f[self.reset][a:].tolist(), strict=True):
            if r != last:
                state, last = None, r
            if new or state is None or v < state[0]:
                state = (v, p)
            yield state

    def rows(self, f: Frame, run: np.ndarray, entry: tuple | None) -> tuple[Values, tuple | None]:
        seen = list(self._walk(f, 0, entry if run[0] == 0 else None, run.tolist()))
        return {self.out: np.array([s[0] for s in seen]), self.at: np.array([s[1] for s in seen])}, seen[-1]

    def extend(self, summary: tuple, f: Frame, a: int) -> tuple:
        cut, state = summary
        *_, state = self._walk(f, a, state, [0] * (len(f[self.value]) - a))
        return cut or bool(f[self.reset][a:].any()), state

    def apply(self, summary: tuple, state: tuple | None) -> tuple | None:
        cut, low = summary
        return low if cut or state is None or low is not None and low[0] < state[0] else state


@dataclass(frozen=True)
class FirstSince:
    """Place of the first row where `hit` holds after the last where `reset` does; null where none is."""

    place: str
    hit: str
    reset: str
    out: str
    zero = None
    identity = (False, None)

    def _walk(self, f: Frame, a: int, state: float | None, run: list[int]) -> Iterator[float | None]:
        last = run[0]
        for r, p, hit, new in zip(run, f[self.place][a:].tolist(), f[self.hit][a:].tolist(), f[self.reset][a:].tolist(), strict=True):
            if r != last or new:
                state, last = None, r
            if hit and not new and state is None:
                state = p
            yield state

    def rows(self, f: Frame, run: np.ndarray, entry: float | None) -> tuple[Values, float | None]:
        seen = list(self._walk(f, 0, entry, run.tolist()))
        return {self.out: np.array([np.nan if s is None else s for s in seen])}, seen[-1]

    def extend(self, summary: tuple, f: Frame, a: int) -> tuple:
        cut, state = summary
        *_, state = self._walk(f, a, state, [0] * (len(f[self.place]) - a))
        return cut or bool(f[self.reset][a:].any()), state

    def apply(self, summary: tuple, state: float | None) -> float | None:
        cut, place = summary
        return place if cut or state is None else state


Scan = Sum | Extreme | Peak | Last | Floored | Affine | Spent | Trailing | LowestSince | FirstSince


@dataclass(frozen=True)
class Stage:
    """Columns worked out row by row from earlier ones, and then scans that read them."""

    scans: tuple[Scan, ...] = ()
    prepare: Callable[[Frame], Values] | None = field(default=None)


def _keys_of(batch: pa.RecordBatch, keys: Sequence[str], row: int) -> str:
    return repr(tuple(batch.column(k)[row].as_py() for k in keys))


def runs_of_keys(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Numbers of runs of equal keys; nulls are equal."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        a, b = batch.column(k).slice(0, batch.num_rows - 1), batch.column(k).slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.cumsum(new)


class Walk:
    """One pass over a partition: stages with entry states are worked out, the next one, if any, is summed up."""

    def __init__(self, keys: Sequence[str], stages: Sequence[Stage], known: int):
        self.keys, self.stages, self.known = list(keys), stages, known
        self.states: list[list] | None = None
        self.first = self.last = None
        self.single = True
        self.summary: list = []

    def _zero(self) -> list[list]:
        return [[s.zero for s in stage.scans] for stage in self.stages[: self.known]]

    def _entered(self, batch: pa.RecordBatch) -> list[list]:
        out = []
        for k in range(self.known):
            if not self.stages[k].scans:
                out.append([])
                continue
            entry = batch.column(f"__entry{k}")[0].as_py()
            if entry is None:
                raise RuntimeError("a partition has no entry state: its exchange was not reused")
            first, states = pickle.loads(entry)
            if first != self.first:
                raise RuntimeError("a partition is not the one that was summed up: its exchange was not reused")
            out.append(states)
        return out

    def add(self, batch: pa.RecordBatch) -> Frame:
        head = _keys_of(batch, self.keys, 0)
        if self.first is None:
            self.first = self.last = head
            self.states = self._entered(batch)
            self.summary = self._identity()
        run = runs_of_keys(batch, self.keys)
        if head != self.last:
            self.states, self.single, self.summary = self._zero(), False, self._identity()
        frame = Frame(batch)
        for stage, states in zip(self.stages[: self.known], self.states, strict=True):
            if stage.prepare is not None:
                frame.made.update(stage.prepare(frame))
            for k, scan in enumerate(stage.scans):
                made, states[k] = scan.rows(frame, run, states[k])
                frame.made.update(made)
        if self.known < len(self.stages):
            stage = self.stages[self.known]
            if stage.prepare is not None:
                frame.made.update(stage.prepare(frame))
            start = 0
            if run[-1] > 0:
                start, self.single, self.summary = int(np.searchsorted(run, run[-1])), False, self._identity()
            self.summary = [s.extend(x, frame, start) for s, x in zip(stage.scans, self.summary, strict=True)]
        self.last = _keys_of(batch, self.keys, batch.num_rows - 1)
        return frame

    def _identity(self) -> list:
        return [s.identity for s in self.stages[self.known].scans] if self.known < len(self.stages) else []


def scanned(df: DataFrame, keys: Sequence[str], order: Sequence[str], stages: Sequence[Stage], outs: dict[str, str]) -> DataFrame:
    """df with the columns `outs` (name -> type) that the stages make, along ascending `order` of each key.

    Null keys are one key, and null places come first.  Rows that tie in the order lie in one partition.
    """
    keys, order, stages = list(keys), list(order), list(stages)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id())
    entries: dict[int, DataFrame] = {}

    def entered(known: int) -> DataFrame:
        rows = dealt
        for k, entry in entries.items():
            if k < known:
                # one row per partition
                rows = rows.join(F.broadcast(entry.select(F.col("part").alias(f"__p{k}"), F.col("entry").alias(f"__entry{k}"))), F.col("__part") == F.col(f"__p{k}"), "left")
        return rows.sortWithinPartitions(*keys, *order)

    def summed(known: int):
        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, part = Walk(keys, stages, known), None
            for batch in batches:
                if batch.num_rows:
                    part = batch.column("__part")[0].as_py()
                    w.add(batch)
            if part is not None:
                row = (part, w.first, w.last, w.single, pickle.dumps(w.summary))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.binary()), strict=True)], ["part", "first", "last", "single", "summary"])

        return walk

    def folded(known: int):
        scans = stages[known].scans

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, states = None, []
            for batch in batches:
                made = []
                for part, first, last, single, summary in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    zero = [s.zero for s in scans]
                    entry = states if first == key else zero
                    made.append((part, pickle.dumps((first, entry))))
                    states = [s.apply(x, e) for s, x, e in zip(scans, pickle.loads(summary), entry if single else zero, strict=True)]
                    key = last
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary())], ["part", "entry"])

        return fold

    for k, stage in enumerate(stages):
        if stage.scans:
            summary = entered(k).mapInArrow(summed(k), _SUMMARY)
            entries[k] = summary.repartition(1).sortWithinPartitions("part").mapInArrow(folded(k), "part int, entry binary")

    columns = [f"`{c}`" for c in df.columns]
    schema = dealt.select(*columns).schema
    for name, kind in outs.items():
        schema = schema.add(StructType.fromDDL(f"`{name}` {kind}").fields[0])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Walk(keys, stages, len(stages))
        n = len(columns)
        for batch in batches:
            if batch.num_rows:
                frame = w.add(batch)
                made = [x if isinstance(x, pa.Array) else pa.array(x, from_pandas=True) for x in (frame.made[o] for o in outs)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], [*batch.schema.names[:n], *outs])

    return entered(len(stages)).mapInArrow(walk, schema)
