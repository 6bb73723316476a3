"""Benchmark decontamination with suffix arrays of the training text.

Each shard (the documents of an Arrow batch) becomes an array of word numbers; its suffixes are
sorted by their first `window` words, and every test suffix is binary-searched among them.  Only
training suffixes that stay inside the benchmark's vocabulary for as long as the shortest
window can equal a test suffix, so the others are left out of the array beforehand; that is
exact.  Runs of adjacent matches on one diagonal are the longest verbatim matches, with their
places in both texts.  A hit is compared word for word before it counts.

The benchmark travels in blocks of at most `block_words` words.  Every block is searched over
all documents; a document's row gathers what the blocks found, so nothing is joined or
shuffled.  Each task needs one block and one batch in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.text import LOWER, NOT_ALNUM, Rolling, runs_of, set_aside, small_batches, utf8, words
from quaymark.llm.tokens import HashIndex

WINDOW, BLOCK_WORDS = 13, 1_000_000
#: A document is contaminated when its hit words are at least one in so many.
SHARE = 20

FOUND = "n_words long, hit_starts array<int>, hit_ends array<int>, item_ids array<long>"
MATCHES = "doc_id long, item_id long, doc_word long, item_word long, n_words long"


class TestBlock:
    """Test suffixes of some benchmark items."""

    def __init__(self, items: list[tuple], window: int):
        self.window = window
        data, offsets = utf8(pa.array([t for _, t in items], pa.large_string()))
        data = LOWER[data]
        start, end, owner = words(data, offsets, NOT_ALNUM)
        self.text = [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
        hashes = Rolling(data).of(start, end)
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        self.numbers = (number + 1).astype(np.int32)  # 0: a word outside, or a document's end
        self.items = [i for i, _ in items]
        counts = np.bincount(owner, minlength=len(items))
        first = np.cumsum(counts) - counts
        # one test suffix per window: every start with `window` words left, or the whole of a shorter item
        row, k = runs_of(np.where(counts >= window, counts - window + 1, np.minimum(counts, 1)))
        self.start = first[row] + k
        self.depth = np.minimum(counts[row], window)
        self.item = row
        self.item_word = k

    def keys(self) -> HashIndex:
        index = HashIndex(max(1, len(self.vocabulary)))
        index.add(self.vocabulary, np.arange(1, len(self.vocabulary) + 1, dtype=np.int32))
        return index


def suffix_array(numbers: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The given suffixes in the order of their first `depth` numbers (numbers padded by depth zeros)."""
    per_key = max(1, 62 // max(1, int(numbers.max(initial=1)).bit_length()))
    bits = 62 // per_key
    keys = []
    for k in range(0, depth, per_key):
        key = np.zeros(len(at), np.int64)
        for j in range(k, min(k + per_key, depth)):
            key = (key << bits) | numbers[at + j]
        keys.append(key)
    return at[np.lexsort(keys[::-1])] if keys else at


def search(numbers: np.ndarray, order: np.ndarray, tests: np.ndarray, start: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every test suffix, the range of the suffix array that agrees with its first `depth` words."""

    def bound(right: bool) -> np.ndarray:
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            sign = np.zeros(len(start), np.int8)
            for k in range(int(depth.max())):
                use = (sign == 0) & (depth > k)
                if not use.any():
                    break
                a, b = numbers[at[use] + k], tests[start[use] + k]
                sign[use] = np.sign(a - b)
            below = (sign < 0) | (right & (sign == 0))
            lo, hi = np.where(open_ & below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
        return lo

    if not len(order) or not len(start):
        return np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    return bound(False), bound(True)


def shard_hits(block: TestBlock, index: HashIndex, column: pa.Array) -> tuple[np.ndarray, ...]:
    """Words per document, and every occurrence of a test window: document, first word there, test suffix."""
    data, offsets = utf8(column)
    data = LOWER[data]
    start, end, owner = words(data, offsets, NOT_ALNUM)
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    none = np.zeros(0, np.int64)
    if not len(start) or not len(block.start):
        return counts, none, none, none
    found = index.find(Rolling(data).of(start, end))
    # positions with a gap after each document, so that no suffix crosses it
    place = np.arange(len(start)) + owner
    numbers = np.zeros(len(start) + len(counts) + block.window + 1, np.int32)
    numbers[place] = np.maximum(found, 0)
    inside = numbers > 0
    breaks = np.flatnonzero(~inside)
    run = breaks[np.searchsorted(breaks, place)] - place  # words of the vocabulary from here on
    candidates = place[run >= int(block.depth.min())]
    order = suffix_array(numbers, candidates, block.window)
    lo, hi = search(numbers, order, block.numbers, block.start, block.depth)
    row, k = runs_of(hi - lo)
    at = order[lo[row] + k]
    back = np.zeros(len(numbers), np.int64)
    back[place] = np.arange(len(start))
    first = back[at]
    # word for word
    raw = data.tobytes()
    good = np.ones(len(row), bool)
    same: dict[tuple[int, int], bool] = {}
    for n, (w, t) in enumerate(zip(first.tolist(), row.tolist(), strict=True)):
        for j in range(int(block.depth[t])):
            key = (w + j, int(block.start[t]) + j)
            if key not in same:
                same[key] = raw[start[key[0]] : end[key[0]]] == block.text[key[1]]
            if not same[key]:
                good[n] = False
                break
    row, first = row[good], first[good]
    return counts, owner[first], first - (np.cumsum(counts) - counts)[owner[first]], row


def blocks_of(benchmark: DataFrame, window: int, block_words: int) -> Iterator[TestBlock]:
    """The benchmark in blocks of bounded size; the driver holds one at a time."""
    part: list[tuple] = []
    size = 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).toLocalIterator():
        part.append((item_id, text))
        size += len(text) // 2 + 1
        if size >= block_words:
            yield TestBlock(part, window)
            part, size = [], 0
    if part:
        yield TestBlock(part, window)


def _searched(rows: DataFrame, block: TestBlock, text_at: int) -> DataFrame:
    """Add a block's finds to the last four columns."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        index = own.keys()
        for batch in batches:
            counts, doc, word, test = shard_hits(own, index, batch.column(text_at))
            starts, ends, items = (batch.column(batch.num_columns - k).to_pylist() for k in (3, 2, 1))
            order = np.argsort(doc, kind="stable")
            edge = np.flatnonzero(np.diff(doc[order], prepend=-1, append=-1)) if len(doc) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                d, pick = int(doc[order[a]]), order[a:b]
                first = word[pick].tolist() + (starts[d] or [])
                last = (word[pick] + own.depth[test[pick]]).tolist() + (ends[d] or [])
                starts[d], ends[d] = merged(first, last)
                items[d] = sorted({*(items[d] or []), *(own.items[k] for k in own.item[test[pick]].tolist())}, key=lambda x: (x is None, x))
            columns = [*batch.columns[:-4], pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def merged(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """Disjoint union of half-open ranges."""
    a, b = [], []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if b and s <= b[-1]:
            b[-1] = max(b[-1], e)
        else:
            a.append(s)
            b.append(e)
    return a, b


def found(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text_col: str = "text") -> DataFrame:
    """All columns of docs with n_words and, where a window occurs, hit word ranges and item ids (else null).

    Columns of docs that have the names of the new ones are replaced.  Null text has no words;
    items without words have no windows; ids may be null or repeated, rows are told apart by
    themselves.  An empty benchmark hits nothing.
    """
    small_batches(docs.sparkSession)
    names = [part.split()[0] for part in FOUND.split(", ")]
    kept = docs.drop(*names)
    rows = kept.selectExpr("*", "cast(null as long) n_words", *(f"cast(null as {part.split()[1]}) {part.split()[0]}" for part in FOUND.split(", ")[1:]))
    at = kept.columns.index(text_col)
    blocks = blocks_of(benchmark, window, block_words)
    rows = _searched(rows, next(blocks, None) or TestBlock([], window), at)
    for block in blocks:
        rows = _searched(rows, block, at)
    return rows


def verdicts(rows: DataFrame, share: int = SHARE) -> DataFrame:
    """n_hit, n_items and contaminated from found()."""
    length = F.expr("aggregate(zip_with(hit_ends, hit_starts, (b, a) -> cast(b - a as bigint)), cast(0 as bigint), (s, x) -> s + x)")
    return (
        rows.withColumn("n_hit", F.coalesce(length, F.lit(0).cast("long")))
        .withColumn("n_items", F.coalesce(F.size("item_ids"), F.lit(0)).cast("long"))
        .withColumn("n_items", F.when(F.col("item_ids").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_items")))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    )


def items_digest() -> F.Column:
    """Checksum of the item ids, sorted as strings and joined by commas."""
    ids = F.array_sort(F.transform(F.coalesce("item_ids", F.array().cast("array<bigint>")), lambda x: F.coalesce(x.cast("string"), F.lit(""))))
    return F.sha2(F.concat_ws(",", ids), 256)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    share = options.pop("share", SHARE)
    names = {part.split()[0] for part in FOUND.split(", ")} | {"n_hit", "n_items", "contaminated"}
    docs, own = set_aside(docs, names)
    return verdicts(found(docs, benchmark, **options), share).filter(~F.col("contaminated")).select(*own)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal verbatim matches of at least a window: where in the document, where in the item, how many words."""
    small_batches(docs.sparkSession)
    names = [part.split()[0] for part in MATCHES.split(", ")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in blocks_of(benchmark, window, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            index = own.keys()
            for batch in batches:
                _, doc, word, test = shard_hits(own, index, batch.column(1))
                item, item_word, depth = own.item[test], own.item_word[test], own.depth[test]
                order = np.lexsort((word, word - item_word, item, doc))
                doc, word, item, item_word, depth = doc[order], word[order], item[order], item_word[order], depth[order]
                new = np.ones(len(doc), bool)
                new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(word - item_word) != 0) | (np.diff(word) != 1)
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, len(doc))) + depth[first] - 1 if len(first) else first
                ids = np.array([i if i is not None else -1 for i in own.items], np.int64)
                blank = np.array([i is None for i in own.items], bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc[first])), pa.array(ids[item[first]], mask=blank[item[first]]), *(pa.array(x.astype(np.int64)) for x in (word[first], item_word[first], size))],
                    names,
                )

        part = rows.mapInArrow(run, MATCHES)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], MATCHES)
