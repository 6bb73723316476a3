"""Suffix-array deduplication of repeated byte strings.

Two equal strings of `length` bytes have the same smallest 32-byte gram (by hash, leftmost) at
the same place, their anchor.  Every window of `length` bytes belongs to one anchor, and an
anchor's windows are neighbours; their span of bytes is the anchor's segment.  So windows only
need comparing between segments of equal anchors, and anchors are what is shuffled:

1. segments that are equal as a whole: all windows but the earliest one's repeat;
2. the earliest of every different segment of an anchor goes on with its bytes.  Segments are
   cut into blocks at fixed distances from the anchor, blocks are numbered in byte order, and a
   suffix array of the block strings is built by linear grouping.  A window that begins inside
   a block is placed by the bytes before the next block and the rank of the suffix there, so
   equal windows lie side by side, and the earliest of a run of equals stays.

The array is built without recursion or renaming: suffixes are grouped by their first symbol;
groups are taken from the greatest down, and every suffix that a member's previous-smaller
pointer reaches moves up into a group of its own kind, which leaves suffixes grouped by Lyndon
prefix; then the suffixes are emitted in order, each placing those before it that point on.

Matches are judged on the input; ranges to remove are united per document at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.text import Rolling, copies_numbered, runs_of, small_batches, stored, utf8

LENGTH, GRAM, BLOCK = 100, 32, 16
#: Segments that one suffix array takes.
CHUNK = 4096
#: Anchors that a task compares among themselves before it sends them on.
TOGETHER = 500_000
_LAST = 2**63 - 1


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes of a text in order; its last symbol must be smaller than all others."""
    n = len(text)
    # groups of suffixes are ranges of `order`; a group is known by where it starts
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for at, s in enumerate(order):
        if text[s] != text[order[start]]:
            start = at
        place[s], group[s] = at, start
        size[start] += 1
    previous = [-1] * n
    top = n
    while top > 0:
        begin = group[order[top - 1]]
        pointed: dict[int, int] = {}
        for s in sorted(order[begin:top]):
            p = s - 1
            while p >= 0 and group[p] >= begin:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        levels: dict[int, list[int]] = {}
        for p, times in pointed.items():
            levels.setdefault(times, []).append(p)
        for times in sorted(levels, reverse=True) if len(levels) > 1 else levels:
            taken: dict[int, list[int]] = {}
            for p in levels[times]:
                taken.setdefault(group[p], []).append(p)
            for old, members in taken.items():
                if len(members) == size[old]:
                    continue  # the whole group moves up: it stays where it is
                edge = old + size[old]
                for p in members:
                    edge -= 1
                    at, other = place[p], order[edge]
                    order[at], order[edge] = other, p
                    place[other], place[p] = at, edge
                size[old] -= len(members)
                size[edge] = len(members)
                for p in members:
                    group[p] = edge
        top = begin
    out, filled, placed = [-1] * n, [0] * n, [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for at in range(n):
        s = out[at] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[g + filled[g]] = s
            filled[g] += 1
            placed[s] = True
            s = previous[s]
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows: document, anchor position, first window, number of windows (batch positions)."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, None, None
    rolling = Rolling(data)
    at = np.arange(len(data) - gram + 1)
    h = rolling.of(at, at + gram)
    # hash above, place below: the least is the leftmost least hash
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    least = (h >> bits << bits) | at.astype(np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(offsets)
    row, k = runs_of(np.maximum(sizes - length + 1, 0))
    first = offsets[:-1][row] + k
    own = anchor[first]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    edge = np.flatnonzero(new)
    return row[edge], own[edge], first[edge], np.diff(np.append(edge, len(own))), h, rolling


def segments(docs: DataFrame, length: int, gram: int, together: int = TOGETHER) -> DataFrame:
    """One row per anchor: gram, hash of its segment, document, copy, place (position, windows before, windows), whole.

    whole tells that the task itself has met the segment earlier in the order, so that of a
    segment with many copies few rows meet in one place.
    """
    names = ["gram", "segment", "doc", "copy", "place", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            whole = np.zeros(len(order), bool)
            whole[1:] = (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])
            for a in range(0, len(order), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in (*columns, whole)], names)

        for batch in batches:
            data, offsets = utf8(batch.column(2))
            doc, at, first, count, h, rolling = anchors(data, offsets, length, gram)
            if not len(doc):
                continue
            copy = batch.column(1).to_numpy().astype(np.int64)[doc]
            position = at - offsets[doc]
            if position.max() >= 1 << 31:
                raise ValueError("texts of 2 GiB or more aren't supported")
            left = at - first
            place = (position << 14) | (left << 7) | (count - 1)
            segment = rolling.of(first, first + count - 1 + length) ^ (left * 128 + count).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            held.append((h[at].view(np.int64), segment.view(np.int64), batch.column(0).to_numpy()[doc], copy, place))
            size += len(doc)
            if size >= together:
                yield from sent()
                held, size = [], 0
        if held:
            yield from sent()

    return docs.select("doc", "copy", "text").mapInArrow(run, "gram long, segment long, doc long, copy long, place long, whole boolean")


def sorted_out(rows: DataFrame) -> DataFrame:
    """gram, doc, copy, place, whole: segments equal to an earlier one (whole), and the earliest of each
    kind where an anchor has several kinds.

    Rows stream in order; a frequent anchor takes constant memory.  Rows that are known to repeat
    come along wherever they lie.
    """
    key = F.when(F.col("whole"), F.xxhash64("doc", "copy", "place")).otherwise(F.col("gram"))
    ordered = rows.withColumn("key", key).repartition("key").sortWithinPartitions("whole", "gram", "segment", "doc", "copy", "place")
    names = ["gram", "doc", "copy", "place", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = opener = None  # gram and segment of the last row; first row of its gram while that isn't emitted
        for batch in batches:
            known = batch.column(5).to_numpy(zero_copy_only=False)
            n = int(np.searchsorted(known, True))
            if n < batch.num_rows:
                rest = batch.slice(n)
                yield pa.RecordBatch.from_arrays([rest.column(0), *rest.columns[2:]], names)
            if not n:
                continue
            gram, segment, doc, copy, place = (c.to_numpy() for c in batch.slice(0, n).columns[:5])
            new_gram, new_kind = np.ones(n, bool), np.ones(n, bool)
            new_gram[1:] = gram[1:] != gram[:-1]
            new_kind[1:] = new_gram[1:] | (segment[1:] != segment[:-1])
            if before is not None:
                new_gram[0] = gram[0] != before[0]
                new_kind[0] = new_gram[0] or segment[0] != before[1]
            further = new_kind & ~new_gram
            first = np.maximum.accumulate(np.where(new_gram, np.arange(n), -1))
            several = np.zeros(n, bool)  # openers of grams with several kinds
            several[np.unique(first[further & (first >= 0)])] = True
            extra = []
            if opener is not None and (further & (first < 0)).any():
                extra, opener = [opener], None
            pick = np.flatnonzero(further | several | ~new_kind)
            out = [np.concatenate([np.array([x[k] for x in extra], np.int64), c[pick]]) for k, c in enumerate((gram, doc, copy, place))]
            whole = np.concatenate([np.zeros(len(extra), bool), ~new_kind[pick]])
            before = (gram[-1], segment[-1])
            if first[-1] >= 0:
                f = first[-1]
                opener = None if several[f] else (gram[f], doc[f], copy[f], place[f])
            yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(whole)], names)

    selected = ordered.select("gram", "segment", "doc", "copy", "place", "whole")
    return selected.mapInArrow(run, "gram long, doc long, copy long, place long, whole boolean")


def with_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """gram, doc, copy, place and the bytes of the wanted segments."""
    lists = wanted.groupBy("doc", "copy").agg(F.collect_list(F.struct("place", "gram")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            asked = batch.column(3)
            row, _ = runs_of(asked.value_lengths().to_numpy())
            place, gram = (asked.flatten().field(k).to_numpy() for k in (0, 1))
            position, left, count = (place >> 14) & (2**31 - 1), (place >> 7) & 127, (place & 127) + 1
            begin = offsets[:-1][row] + position - left
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(begin.tolist(), (begin + count - 1 + length).tolist(), strict=True)]
            for a in range(0, len(texts), 8192):
                s = slice(a, a + 8192)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[s]), *(batch.column(k).take(pa.array(row[s])) for k in range(2)), pa.array(place[s]), pa.array(texts[s], pa.binary())], ["gram", "doc", "copy", "place", "bytes"]
                )

    return docs.join(lists, ["doc", "copy"]).select("doc", "copy", "text", "wanted").mapInArrow(run, "gram long, doc long, copy long, place long, bytes binary")


def repeated_windows(gram: np.ndarray, left: np.ndarray, count: np.ndarray, texts: list[bytes], length: int, block: int) -> tuple[np.ndarray, ...]:
    """Windows equal to one of an earlier segment of the same anchor: segment and window numbers, and all windows' keys.

    Segments come in order of their places; equal grams are neighbours.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    skip = left % block  # bytes before the first block border, at multiples of `block` from the anchor
    blocks = -(-(sizes - skip) // block)
    row, k = runs_of(blocks)
    first = begin[row] + skip[row] + k * block
    padded = np.zeros(len(data) + block, np.uint8)
    padded[: len(data)] = data
    cells = padded[first[:, None] + np.arange(block)]
    cells[np.arange(block) >= (begin + sizes)[row][:, None] - first[:, None]] = 0  # nothing of the next segment
    words = cells.view(">u8").astype(np.uint64)
    by = np.lexsort(words.T[::-1])
    step = np.ones(len(by), np.int64)
    step[1:] = (words[by[1:]] != words[by[:-1]]).any(axis=1)
    symbol = np.empty(len(by), np.int64)
    symbol[by] = np.cumsum(step) + 1
    # block strings one after the other, each closed by 1, and 0 at the end
    slot = np.arange(len(row)) + row
    string = np.ones(len(row) + len(texts) + 1, np.int64)
    string[slot], string[-1] = symbol, 0
    rank = np.empty(len(string), np.int64)
    rank[suffix_array(string.tolist())] = np.arange(len(string))
    # every window: bytes before the next border, rank of the suffix there, and a hash of all its bytes
    seg, w = runs_of(count)
    start = begin[seg] + w
    border = np.maximum(0, -(-(w - skip[seg]) // block))
    head = skip[seg] + border * block - w
    border_slot = np.minimum((np.cumsum(blocks) - blocks)[seg] + border, len(row) - 1) + seg
    rolling = Rolling(data)
    whole = rolling.of(start, start + length)
    offset = left[seg] - w  # bytes from the window's start to the anchor
    owner = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))[seg]
    where = owner * (length + 1) + offset
    order = np.lexsort((seg, rank[border_slot], rolling.of(start, start + head), where))
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (where[a] != where[b]) | (whole[a] != whole[b])
    runs = np.flatnonzero(new)
    least = np.minimum.reduceat(seg[order], runs)[np.cumsum(new) - 1] if len(order) else seg
    again = np.zeros(len(seg), bool)
    again[order] = seg[order] > least
    keys = whole ^ (offset.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return seg, w, again, keys


def repeats(rows: DataFrame, length: int, block: int, chunk: int) -> DataFrame:
    """doc, copy, start and end of the ranges that repeat earlier segments of their anchor.

    A task takes anchors in turns of `chunk` segments.  Of an anchor with more, it keeps
    one 8-byte key per different window between turns.
    """
    ordered = rows.repartition("gram").sortWithinPartitions("gram", "doc", "copy", "place").select("gram", "doc", "copy", "place", "bytes")
    names = ["doc", "copy", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        seen_gram, seen = None, np.zeros(0, np.uint64)

        def turn(table: pa.Table) -> pa.RecordBatch:
            nonlocal seen_gram, seen
            gram, doc, copy, place = (table.column(k).to_numpy() for k in range(4))
            position, left, count = (place >> 14) & (2**31 - 1), (place >> 7) & 127, (place & 127) + 1
            seg, w, again, keys = repeated_windows(gram, left, count, table.column(4).to_pylist(), length, block)
            if seen_gram is not None and gram[0] == seen_gram:
                mine = gram[seg] == seen_gram
                again[mine] |= np.isin(keys[mine], seen)
            last = gram[seg] == gram[-1]
            old = seen if seen_gram is not None and gram[-1] == seen_gram else seen[:0]
            seen_gram, seen = gram[-1], np.unique(np.concatenate([old, keys[last]]))
            seg, w = seg[again], w[again]
            new = np.ones(len(seg), bool)
            new[1:] = (seg[1:] != seg[:-1]) | (w[1:] != w[:-1] + 1)
            edge = np.flatnonzero(new)
            n = np.diff(np.append(edge, len(seg)))
            s = seg[edge]
            start = position[s] - left[s] + w[edge]
            return pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(copy[s]), pa.array(start), pa.array(start + n - 1 + length)], names)

        rows_waiting = 0
        for batch in batches:
            waiting.append(batch)
            rows_waiting += batch.num_rows
            if rows_waiting >= chunk:
                table = pa.Table.from_batches(waiting).combine_chunks()
                gram = table.column(0).to_numpy()
                # an anchor that may go on waits for its rest, unless it fills the turn alone
                whole = int(np.searchsorted(gram, gram[-1])) or len(gram)
                for a in range(0, whole, chunk):
                    yield turn(table.slice(a, min(chunk, whole - a)))
                rest = table.slice(whole)
                waiting, rows_waiting = rest.to_batches(), rest.num_rows
        if rows_waiting:
            table = pa.Table.from_batches(waiting).combine_chunks()
            for a in range(0, rows_waiting, chunk):
                yield turn(table.slice(a, chunk))

    return ordered.mapInArrow(run, "doc long, copy long, first long, last long")


def repeated_ranges(numbered: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """doc, copy and ranges (array of first, last): bytes covered by strings that also start earlier."""
    found = stored(sorted_out(segments(numbered, length, gram)), "anchors")
    kinds = repeats(with_bytes(numbered, found.filter("not whole"), length), length, block, chunk)
    start = (F.shiftright("place", 14).bitwiseAND(2**31 - 1) - F.shiftright("place", 7).bitwiseAND(127)).alias("first")
    count = F.col("place").bitwiseAND(127)
    whole = found.filter("whole").select("doc", "copy", start, (start + count + length).alias("last"))
    return whole.unionByName(kinds).groupBy("doc", "copy").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))


def _kept(docs: DataFrame, schema: str, emit) -> DataFrame:
    """Map rows with a `text` and its `ranges` (the last two columns) through emit(batch, data, offsets, covered)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 2))
            ranges = batch.column(batch.num_columns - 1)
            row, _ = runs_of(ranges.value_lengths().fill_null(0).to_numpy())
            pairs = ranges.flatten()
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, offsets[:-1][row] + pairs.field(0).to_numpy(), 1)
            np.add.at(change, offsets[:-1][row] + pairs.field(1).to_numpy(), -1)
            yield emit(batch, data, offsets, np.cumsum(change[:-1]) > 0)

    return docs.mapInArrow(run, schema)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = copies_numbered(docs, id_col, text_col)
    return rows.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "copy", "text")


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def removed(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """Per row: bytes, bytes removed, maximal removed runs, checksum of the rest, and the rest (with_kept).

    Null text is empty; matches never cross rows.  Rows are ordered by id (null last) and, where an
    id repeats, as copies_numbered does; equal rows are a text and its repetition.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = _numbered(docs, id_col, text_col)
    ranges = repeated_ranges(rows, length)
    schema = REMOVED if with_kept else REMOVED.rpartition(",")[0]
    names = [part.split()[0] for part in schema.split(", ")]

    def emit(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, covered: np.ndarray) -> pa.RecordBatch:
        total = np.concatenate([[0], np.cumsum(covered)])
        opens = covered.copy()
        opens[1:] &= ~covered[:-1]
        first = offsets[:-1][np.diff(offsets) > 0]
        opens[first] = covered[first]
        runs = np.concatenate([[0], np.cumsum(opens)])
        rest = [data[a:b][~covered[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        out = [batch.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(np.diff(runs[offsets])), pa.array([hashlib.sha256(r).hexdigest() for r in rest], pa.string())]
        return pa.RecordBatch.from_arrays([*out, pa.array(rest, pa.binary())][: len(names)], names)

    joined = rows.join(ranges, ["doc", "copy"], "left").select("doc", "text", "ranges")
    return _kept(joined, schema, emit).withColumn("doc_id", F.nullif("doc_id", F.lit(_LAST)))


def deduplicated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs with repeated strings cut from the text (a character cut in two goes whole); null text stays null.

    chars_col, where docs has it, is counted anew.
    """
    small_batches(docs.sparkSession)
    rows = copies_numbered(docs, id_col, text_col, whole=True).withColumn("__doc", F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)))
    plain = rows.select(F.col("__doc").alias("doc"), F.col("__copy").alias("copy"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = repeated_ranges(plain, length).withColumnsRenamed({"doc": "__doc", "copy": "__copy", "ranges": "__ranges"})
    joined = rows.join(ranges, ["__doc", "__copy"], "left").select(*(f"`{c}`" for c in docs.columns), F.col(text_col).alias("__text"), "__ranges")
    at = docs.columns.index(text_col)

    def emit(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, covered: np.ndarray) -> pa.RecordBatch:
        whole = batch.column(batch.num_columns - 2).is_null().to_numpy(zero_copy_only=False)
        char = np.cumsum((data & 0xC0) != 0x80)
        gone = np.zeros(int(char[-1]) + 1 if len(char) else 1, bool)
        gone[char[covered]] = True
        covered = gone[char]
        texts = [None if null else data[a:b][~covered[a:b]].tobytes().decode() for a, b, null in zip(offsets[:-1], offsets[1:], whole, strict=True)]
        columns = list(batch.columns[:-2])
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-2])

    out = _kept(joined, docs.schema, emit)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType))
    return out
