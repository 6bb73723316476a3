"""Ranked lexical search over bit-sliced Bloom signatures.

Every document has a Bloom signature of its terms.  Documents of like size are laid side by side
in blocks, and a block keeps the signatures turned: one bitmap over its documents for each signature
position, so that the documents that may hold a term are the intersection of a few bitmaps.  A
term that occurs often is entered once more for every step of `STEPS` that its count reaches; the
steps that a document seems to have reached bound the count from above.  A false positive only
raises a bound, never lowers it.

For a set of queries, the terms' bitmaps of a block are intersected once, and every query adds up
its terms' greatest possible contributions.  The documents with the greatest bounds are scored
exactly to get the k-th best score so far; all documents whose bound reaches it are then scored
exactly from their texts, so the ranking is the exact one.  Queries travel in blocks of a
bounded number of terms.

The index is written without a shuffle, once for any number of queries.  Terms are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.llm.text import LOWER, NOT_ALNUM, Rolling, mixed, runs_of, small_batches, stored, utf8, words

#: Counts at which a term is entered again.
STEPS = np.array(sorted({a << s for a in (2, 3) for s in range(30)} | {1}), np.int64)
#: Bitmaps a term is looked up in, signature positions per entry, and most positions of a signature.
PROBES, POSITIONS, WIDEST = 4, 8, 1 << 22
#: Bits and most documents of a block.
BLOCK_BITS, BLOCK_DOCS = 1 << 22, 2048
#: Bytes of text that are taken apart at a time, and terms whose counts a task holds at most.
PIECE, HELD = 1 << 22, 1 << 20
#: Terms of a block of queries; documents with the greatest bounds that are scored for the threshold.
QUERY_TERMS, FIRST = 1 << 14, 64
#: Candidate documents that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

BLOCK = "ids array<long>, lengths array<long>, positions long, bitmaps binary, terms array<long>, counts array<long>"
_SALT = np.uint64(0x9E3779B97F4A7C15)
_PROBE_SALTS = np.array([p * 0xD1B54A32D192ED03 % 2**64 for p in range(PROBES)], np.uint64)


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that cut no word."""
    at, n = 0, len(data)
    while at < n:
        end = at + PIECE
        if end < n:
            inside = np.searchsorted(offsets, end, side="right")
            limit = int(offsets[inside])  # the end of the document that is cut
            while end < limit and not NOT_ALNUM[data[end]]:
                gap = np.flatnonzero(NOT_ALNUM[data[end : min(limit, end + PIECE)]])
                end = end + int(gap[0]) if len(gap) else min(limit, end + PIECE)
        yield at, min(end, n)
        at = end


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of every distinct term of every document, by document and term."""
    data = LOWER[data]
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
    for a, b in pieces(data, offsets):
        start, end, doc = words(data[a:b], np.clip(offsets, a, b) - a, NOT_ALNUM)
        for column, values in zip(found, _merged(doc, Rolling(data[a:b]).of(start, end), np.ones(len(doc), np.int64)), strict=True):
            column.append(values)
    return _merged(*map(np.concatenate, found)) if len(found[0]) > 2 else tuple(c[-1] for c in found)


def _merged(doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(doc):
        return doc, term, count
    order = np.lexsort((term, doc))
    doc, term, count = doc[order], term[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]))
    return doc[first], term[first], np.add.reduceat(count, first)


def probes(term: np.ndarray, step: np.ndarray, positions: int) -> np.ndarray:
    """The PROBES positions of each (term, step) in a signature."""
    keys = term + step.astype(np.uint64) * _SALT
    return (mixed(keys[..., None] + _PROBE_SALTS) % np.uint64(positions)).astype(np.int64)


class Shelf:
    """Documents of like size, until they fill a block."""

    def __init__(self, positions: int):
        self.positions, self.room = positions, int(np.clip(BLOCK_BITS // positions, 8, BLOCK_DOCS))
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.entries: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, ident: int | None, length: int, terms: np.ndarray, counts: np.ndarray) -> bool:
        self.ids.append(ident)
        self.lengths.append(length)
        self.entries.append((terms, counts))
        return len(self.ids) == self.room

    def block(self) -> tuple:
        n = len(self.ids)
        bits = np.zeros((self.positions, n + -n % 8), bool)
        doc = np.repeat(np.arange(n), [len(t) for t, _ in self.entries])
        term, count = (np.concatenate([e[i] for e in self.entries]) for i in (0, 1))
        row, step = runs_of(np.searchsorted(STEPS, count, side="right"))
        bits[probes(term[row], step, self.positions), doc[row][:, None]] = True
        out = (self.ids, self.lengths, self.positions, np.packbits(bits, axis=1).tobytes(), [], [])
        self.ids, self.lengths, self.entries = [], [], []
        return out


class Tally:
    """In how many documents a task has seen each term."""

    def __init__(self):
        self.terms, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []
        self.waiting = 0

    def add(self, terms: np.ndarray) -> Iterator[tuple]:
        self.new.append(terms)
        self.waiting += len(terms)
        if self.waiting > HELD:
            self.fold()
            if len(self.terms) > HELD:
                yield from self.rows()

    def fold(self) -> None:
        term = np.concatenate([self.terms, *self.new])
        _, self.terms, self.counts = _merged(np.zeros(len(term), np.int64), term, np.concatenate([self.counts, np.ones(self.waiting, np.int64)]))
        self.new, self.waiting = [], 0

    def rows(self) -> Iterator[tuple]:
        self.fold()
        for a in range(0, len(self.terms), HELD // 16):
            yield ([], [], 0, b"", self.terms[a : a + HELD // 16].view(np.int64), self.counts[a : a + HELD // 16])
        self.terms, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _batch(row: tuple) -> pa.RecordBatch:
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["ids", "lengths", "positions", "bitmaps", "terms", "counts"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shelves: dict[int, Shelf] = {}
    tally = Tally()
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        doc, term, count = term_counts(data, offsets)
        yield from map(_batch, tally.add(term))
        ids = batch.column(0).to_pylist()
        cut = np.searchsorted(doc, np.arange(len(ids) + 1))
        steps = np.concatenate([[0], np.cumsum(np.searchsorted(STEPS, count, side="right"))])
        lengths = np.concatenate([[0], np.cumsum(count)])
        for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if a == b:
                continue
            entries = max(32, int(steps[b] - steps[a]))
            positions = min(WIDEST, POSITIONS * int(np.ceil(2 ** (np.ceil(2 * np.log2(entries)) / 2))))
            shelf = shelves.setdefault(positions, Shelf(positions))
            if shelf.add(ids[i], int(lengths[b] - lengths[a]), term[a:b].copy(), count[a:b].copy()):
                yield _batch(shelf.block())
    yield from map(_batch, tally.rows())
    yield from (_batch(s.block()) for s in shelves.values() if s.ids)


@dataclass
class Index:
    """Blocks of signatures, in how many documents each term is, and the corpus' size."""

    blocks: DataFrame
    terms: DataFrame
    n_docs: int
    n_terms: int


def indexed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents; those without a term (null and empty texts too) are counted nowhere.

    Repeated ids, null ids and repeated rows are documents of their own.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("length(text) > 0")
    table = stored(rows.mapInArrow(_indexed, BLOCK), "signatures")
    blocks = table.filter("positions > 0").select("ids", "lengths", "positions", "bitmaps")
    terms = table.filter("positions = 0").select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("df"))
    size = blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0)).alias("l")).first()
    return Index(blocks, terms, size["n"], size["l"])


@dataclass
class Asked:
    """A block of queries: their distinct terms, and each query's terms with weights."""

    terms: np.ndarray
    items: list[int]
    at: list[np.ndarray]
    weights: list[np.ndarray]
    n_docs: int
    n_terms: int

    @classmethod
    def of(cls, rows: list[Row], index: Index) -> Asked:
        terms = [np.array([t["term"] for t in r["asked"]], np.int64).view(np.uint64) for r in rows]
        distinct = np.unique(np.concatenate(terms))
        return cls(distinct, [r["item"] for r in rows], [np.searchsorted(distinct, t) for t in terms], [np.array([t["weight"] for t in r["asked"]], np.int64) for r in rows], index.n_docs, index.n_terms)

    def norms(self, lengths: list[int]) -> np.ndarray:
        return np.array([75 + 25 * n * self.n_docs // self.n_terms for n in lengths], np.int64)

    def bounds(self, ids: list, lengths: list[int], positions: int, bitmaps: bytes) -> Iterator[np.ndarray]:
        """For each query, what each document of a block scores at most."""
        n, m = len(ids), self.norms(lengths)
        slices = np.frombuffer(bitmaps, np.uint8).reshape(positions, -1)
        level = np.zeros((len(self.terms), n), np.uint8)
        alive, seen = np.arange(len(self.terms)), None
        for step in range(len(STEPS)):
            if STEPS[step] > max(lengths):
                break
            rows = probes(self.terms[alive], np.full(len(alive), step), positions)
            now = slices[rows[:, 0]]
            for p in range(1, PROBES):
                now &= slices[rows[:, p]]
            if seen is not None:
                now &= seen
            some = now.any(axis=1)
            alive, seen = alive[some], now[some]
            if not len(alive):
                break
            level[alive] += np.unpackbits(seen, axis=1, count=n)
        most = np.append(STEPS[1:], STEPS[-1] * 2) - 1
        count = np.minimum(most[:, None], np.array(lengths))
        worth = np.concatenate([np.zeros((1, n), np.int64), 1_000_000_000 * count // (1000 * count + 12 * m)]).astype(np.float64)
        value = worth[level, np.arange(n)]
        for at, weight in zip(self.at, self.weights, strict=True):
            # in doubles: the sum's rounding is made up for
            yield np.ceil((weight.astype(np.float64) @ value[at]) * (1 + 1e-12))

    def score(self, item: int, terms: np.ndarray, counts: np.ndarray, m: int) -> int:
        asked = self.terms[self.at[item]]
        place = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
        hit = terms[place] == asked
        tf = counts[place][hit]
        return int((self.weights[item][hit] * (1_000_000_000 * tf // (1000 * tf + 12 * m))).sum())


def _weighted(items: DataFrame, index: Index) -> DataFrame:
    """item and its distinct terms with weight times repeats; terms that no document holds, or that weigh nothing, go."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, term, count = term_counts(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(term.view(np.int64)), pa.array(count)], ["item", "term", "times"])

    asked = items.select("item", "text").mapInArrow(parts, "item long, term long, times long")
    weight = F.floor(1000 * F.ln(F.lit(2.0 * index.n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    rows = asked.join(index.terms, "term").select("item", "term", (weight * F.col("times")).alias("weight")).filter("weight > 0")
    return rows.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("asked"))


def _blocks_of(rows: Iterator[Row], most: int) -> Iterator[list[Row]]:
    block: list[Row] = []
    held = 0
    for row in rows:
        if block and held + len(row["asked"]) > most:
            yield block
            block, held = [], 0
        block.append(row)
        held += len(row["asked"])
    if block:
        yield block


CANDIDATE = "item long, doc_id long, bound double"


def _candidates(index: Index, shared, least: list[float] | None) -> DataFrame:
    """Documents whose bound reaches the query's least, or, without it, each task's FIRST by bound."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in asked.items]

        def out(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            bound, ids, missing = (np.concatenate([r[k] for r in rows]) for k in range(3))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(asked.items), [len(r[0]) for r in rows])), pa.array(ids, mask=missing), pa.array(bound)], ["item", "doc_id", "bound"])

        for batch in batches:
            for row in batch.to_pylist():
                ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
                missing = np.array([i is None for i in row["ids"]], bool)
                rows = []
                for k, bound in enumerate(asked.bounds(**row)):
                    take = np.flatnonzero((bound > 0) if least is None else (bound >= max(1.0, least[k])))
                    if least is not None:
                        rows.append((bound[take], ids[take], missing[take]))
                        continue
                    have = best[k]
                    if len(have[0]) == FIRST:
                        take = take[bound[take] > have[0].min()]
                    if len(take):
                        merged = [np.concatenate([h, x[take]]) for h, x in zip(have, (bound, ids, missing), strict=True)]
                        order = np.argsort(-merged[0], kind="stable")[:FIRST]
                        best[k] = tuple(x[order] for x in merged)
                if least is not None:
                    yield out(rows)
        if least is None:
            yield out(best)

    return index.blocks.mapInArrow(found, CANDIDATE)


def _rescored(docs: DataFrame, candidates: DataFrame, shared) -> DataFrame:
    """item, doc_id and exact score (above 0) of every candidate; all rows of a repeated id are scored."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        number = {item: k for k, item in enumerate(asked.items)}
        for batch in batches:
            doc, term, count = term_counts(*utf8(batch.column(1)))
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            items, rows, scores = [], [], []
            for i, wanted in enumerate(batch.column(2).to_pylist()):
                t, c = term[cut[i] : cut[i + 1]], count[cut[i] : cut[i + 1]]
                if not len(t):
                    continue
                m = int(asked.norms([int(c.sum())])[0])
                for item in wanted:
                    score = asked.score(number[item], t, c, m)
                    if score > 0:
                        items.append(item)
                        rows.append(i)
                        scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    wanted = stored(candidates.groupBy("doc_id").agg(F.collect_set("item").alias("items")), "candidates")
    small = wanted.count() <= BROADCAST_ROWS
    wanted = wanted.withColumnRenamed("doc_id", "wanted_id")
    joined = docs.join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")))
    return joined.select("doc_id", "text", "items").mapInArrow(scored, "item long, doc_id long, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    index: Index | None = None,
    query_terms: int = QUERY_TERMS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents with a score above 0, for every row of items.

    Terms are runs of letters, digits and all that isn't ASCII, with A-Z lower-cased.  Null and empty
    texts hold none: such documents are not found, such items find nothing.  Equal scores go by
    ascending doc_id, null ids last.  Repeated ids are documents, and items, of their own: a repeated
    item_id has the ranks of each of its rows.  Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    index = index or indexed(docs, id_col, text_col)
    names = "item_id {}, rank int, doc_id long, score long".format(items.schema[item_col].dataType.simpleString())
    if not index.n_docs:
        return spark.createDataFrame([], names)
    numbered = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")), "items")
    queries = stored(_weighted(numbered, index), "queries")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("length(text) > 0")
    best = lambda order: F.row_number().over(Window.partitionBy("item").orderBy(*order))
    found = None
    for rows in _blocks_of(queries.toLocalIterator(), query_terms):
        asked = Asked.of(rows, index)
        shared = spark.sparkContext.broadcast(asked)
        first = _candidates(index, shared, None).withColumn("n", best([F.desc("bound"), F.asc_nulls_last("doc_id")])).filter(F.col("n") <= max(k, FIRST))
        scored = _rescored(texts, first, shared).withColumn("n", best([F.desc("score")])).filter(F.col("n") == k)
        kth = {r["item"]: float(r["score"]) for r in scored.select("item", "score").toLocalIterator()}
        # the double next below bounds a score that is none
        least = [float(np.nextafter(kth.get(i, 0.0), 0)) for i in asked.items]
        ranked = _rescored(texts, _candidates(index, shared, least), shared).withColumn("rank", best([F.desc("score"), F.asc_nulls_last("doc_id")])).filter(F.col("rank") <= k)
        part = stored(ranked.select("item", "rank", "doc_id", "score"), "ranked")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], names)
    return found.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
