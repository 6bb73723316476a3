"""Nearest neighbours by inner product with a forest of hash prefixes.

Each of TREES trees gives every vector a string of 64 hash bits, the sides of random hyperplanes on
which it lies, and keeps the strings as a sorted array, cut into cells by their leading bits.  A
query descends in every array to its longest matching prefixes and then ascends in all trees together,
a bit at a time, until the prefixes hold `budget` rows; every row of those is scored, however many
they are.  How large the budget must be depends on the data: `fitted` finds it with a bounded
sample of queries that are compared with all rows, for a wanted recall.

Inner products are made angles by one more coordinate, which brings all rows to the largest norm; the
coordinate of queries is 0.  Equal vectors are one row of the forest, with the ids that can be
among the k nearest.  A cell with more rows, or more queries, than a task takes is dealt over several.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.llm.text import mixed, small_batches, stored

TREES, BITS, SEED = 8, 64, 11
#: Rows of a block, and queries that meet them in a task; queries that are scored at a time.
BLOCK_ROWS, BLOCK_QUERIES, STRIPE = 4096, 2048, 128
#: Cells next to each other that go to one task, and queries whose best rows a task holds.
NEIGHBOURS, MOST_HELD = 4, 50_000
#: Leading bits that cells are cut by at most: bounds the tables of cells that tasks are given.
MOST_BITS = 16
#: Sampled queries, and the recall that the budget is fitted to.
SAMPLE, RECALL = 64, 0.95


def planes(dimensions: int, trees: int, seed: int = SEED) -> np.ndarray:
    """Hyperplanes through the origin of one more dimension, tree by tree."""
    return np.random.default_rng(seed).standard_normal((dimensions + 1, trees * BITS))


def norms(v: np.ndarray) -> np.ndarray:
    """Lengths of rows; components of any finite size."""
    scale = np.abs(v).max(axis=1, keepdims=True)
    return (scale * np.sqrt(((v / scale) ** 2).sum(axis=1, keepdims=True)))[:, 0]


def strings(v: np.ndarray, longest: float | None, book: np.ndarray) -> np.ndarray:
    """The hash strings of rows, one per tree: of queries where longest is None, else of rows to be found."""
    size = norms(v)
    if longest is None:
        unit, last = v / size[:, None], np.zeros(len(v))
    else:
        unit, part = v / longest, np.minimum(size / longest, 1)
        last = np.sqrt((1 - part) * (1 + part))
    side = (unit @ book[:-1] + last[:, None] * book[-1]) > 0
    return np.packbits(side.reshape(len(v), -1, BITS), axis=2).view(">u8")[:, :, 0].astype(np.uint64)


def common_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of strings."""
    x = a ^ b
    high = np.frexp((x >> np.uint64(32)).astype(np.float64))[1]
    low = np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return (BITS - np.where(high > 0, high + 32, low)).astype(np.int64)


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Forest:
    """Distinct vectors: number, ids and rows (of the k + 1 smallest ids), vector, wanted, strings (to be found by), asking (to search with)."""

    rows: DataFrame
    queries: DataFrame  # row, id and number of every query
    dimensions: int
    trees: int
    k: int
    count: int

    @property
    def kind(self) -> str:
        return dict(self.rows.dtypes)["vector"]


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def planted(vectors: DataFrame, dimensions: int, k: int, trees: int = TREES) -> Forest:
    """The forest of vectors (row, id, vector, asked), all usable and of one length."""
    peak = vectors.agg(F.max(F.array_max(F.transform("vector", F.abs))).cast("double")).first()[0]
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / F.lit(peak)) * (x / F.lit(peak))))
    longest = peak * vectors.agg(F.max(length)).first()[0]
    keyed = vectors.withColumn("key", F.sha2(F.to_json(F.struct("vector")), 256))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_last("id"), "row"))
    first = keyed.select("key", "row", "id", "vector").withColumn("n", place).filter(F.col("n") <= k + 1)
    members = F.sort_array(F.collect_list(F.struct("n", "id", "row")))
    classes = first.groupBy("key").agg(members.alias("members"), F.first("vector").alias("vector"))
    classes = classes.select("key", F.col("members.id").alias("ids"), F.col("members.row").alias("rows"), "vector")
    wanted = keyed.filter("asked").select("key").distinct().withColumn("wanted", F.lit(True))
    classes = classes.join(wanted, "key", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    book = planes(dimensions, trees)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _lists(batch.column(4), dimensions).astype(np.float64)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(strings(v, size, book).view(np.int64).ravel()), trees).cast(pa.list_(pa.int64())) for size in (longest, None)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "strings", "asking"])

    numbered = classes.select(F.monotonically_increasing_id().alias("number"), "key", "ids", "rows", "vector", "wanted")
    kind = dict(vectors.dtypes)["vector"]
    rows = stored(numbered.mapInArrow(hashed, f"number long, key string, ids array<long>, rows array<long>, vector {kind}, wanted boolean, strings array<long>, asking array<long>"), "forest")
    queries = keyed.filter("asked").select("row", "id", "key").join(rows.filter("wanted").select("key", "number"), "key").select("row", "id", "number")
    return Forest(rows.drop("key"), queries, dimensions, trees, k, rows.count())


def fitted(forest: Forest, recall: float = RECALL, sample: int = SAMPLE) -> int:
    """The budget at which `sample` queries, compared with every row, find the wanted share of their nearest.

    The sample is drawn by hash.  A task holds its vectors, 65 counts for each, and its nearest rows with
    the depth at which the forest meets them; the driver gets their sums.
    """
    chosen = forest.rows.filter("wanted").orderBy(F.xxhash64("vector"), "number").limit(sample).select("number", "vector", "asking").collect()
    if not chosen:
        return 0
    vectors = np.array([r["vector"] for r in chosen], np.float64)
    asking = np.array([r["asking"] for r in chosen], np.int64).view(np.uint64)
    numbers = [r["number"] for r in chosen]
    k, dimensions, trees = forest.k, forest.dimensions, forest.trees

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(vectors), BITS + 1), np.int64)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in vectors]
        for batch in batches:
            v = _lists(batch.column(1), dimensions).astype(np.float64)
            own = batch.column(0).to_numpy()
            found = _lists(batch.column(2), trees).view(np.uint64)
            with np.errstate(all="ignore"):
                product = vectors @ v.T
            for i in range(len(vectors)):
                depth = common_bits(found, asking[i])
                counts[i] += np.bincount(depth.ravel(), minlength=BITS + 1)
                other = np.flatnonzero(own != numbers[i])
                score, deepest = np.concatenate([best[i][0], product[i, other]]), np.concatenate([best[i][1], depth.max(axis=1)[other]])
                order = np.argsort(-score, kind="stable")[:k]
                best[i] = score[order], deepest[order]
        n = [len(b[0]) for b in best]
        names, row = ["query", "score", "depth", "counts"], np.arange(len(n))
        near = [pa.array(np.repeat(row, n)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best])), pa.nulls(sum(n), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(near, names)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.nulls(len(n), pa.float64()), pa.nulls(len(n), pa.int64()), pa.array(counts.tolist(), pa.list_(pa.int64()))], names)

    seen = stored(forest.rows.select("number", "vector", "strings").mapInArrow(met, "query long, score double, depth long, counts array<long>"), "fitted")
    counts = np.zeros((len(vectors), BITS + 1), np.int64)
    for r in seen.filter("counts is not null").select("query", F.posexplode("counts")).groupBy("query", "pos").agg(F.sum("col").alias("n")).collect():
        counts[r["query"], r["pos"]] = r["n"]
    within = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows at a depth or deeper, added up over trees
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    nearest = seen.filter("counts is null").withColumn("n", place).filter(F.col("n") <= k).select("query", "depth").collect()
    needed = np.sort([within[r["query"], r["depth"]] for r in nearest])
    return int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 0


@dataclass
class Cells:
    """Rows under every prefix of `bits` bits, tree by tree, and, once known, how many queries come to each."""

    bits: int
    rows: np.ndarray
    queries: np.ndarray | None = None
    block: tuple[int, int] = (BLOCK_ROWS, BLOCK_QUERIES)

    def of(self, string: np.ndarray) -> np.ndarray:
        return (string >> np.uint64(BITS - self.bits)).astype(np.int64) if self.bits else np.zeros(string.shape, np.int64)

    def under(self) -> list[np.ndarray]:
        """Rows under every prefix of 0, 1, .. `bits` bits."""
        out = [self.rows]
        for _ in range(self.bits):
            out.append(out[-1].reshape(len(self.rows), -1, 2).sum(axis=2))
        return out[::-1]

    def visited(self, string: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) for every cell with rows under the query's prefix of `stop` bits."""
        width = np.int64(1) << np.maximum(self.bits - stop, 0)
        row = np.repeat(np.arange(len(string)), width)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
        return row, (self.of(string) // width * width)[row] + inside


def _counted(pairs: Iterator[tuple[int, np.ndarray]], trees: int, bits: int) -> pa.RecordBatch:
    """One row per (tree, cell) that occurs."""
    table = np.zeros((trees, 1 << bits), np.int64)
    for tree, cell in pairs:
        table[tree] += np.bincount(cell, minlength=1 << bits)
    tree, cell = np.nonzero(table)
    return pa.RecordBatch.from_arrays([pa.array(tree), pa.array(cell), pa.array(table[tree, cell])], ["tree", "cell", "n"])


def _table(counts: DataFrame, trees: int, bits: int) -> np.ndarray:
    """The sums, as at most trees x 2 ** MOST_BITS numbers."""
    out = np.zeros((trees, 1 << bits), np.int64)
    for r in counts.groupBy("tree", "cell").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["tree"], r["cell"]] = r["n"]
    return out


def _dealt(rows: DataFrame, cells: Cells, trees: int, asks: bool, kind: str) -> DataFrame:
    """rows (number, draw, strings, stop, first, vector) by block: a cell, a part of its rows, a share of its queries."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, shares = -(-cells.rows // cells.block[0]), -(-cells.queries // cells.block[1])
        for batch in batches:
            found = _lists(batch.column(2), trees).view(np.uint64)
            draw = batch.column(1).to_numpy()
            stop = batch.column(3).to_numpy()
            for tree in range(trees):
                row, cell = cells.visited(found[:, tree], stop) if asks else (np.arange(len(draw)), cells.of(found[:, tree]))
                # rows lie in one part and meet every share of the queries, queries the other way round
                mine, theirs = (shares, parts) if asks else (parts, shares)
                own, copies = draw[row] % np.maximum(mine[tree, cell], 1), theirs[tree, cell] * (mine[tree, cell] > 0)
                at = np.repeat(np.arange(len(row)), copies)
                other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                for a in range(0, len(at), 2000):
                    some = at[a : a + 2000]
                    mine_, other_ = own[some], other[a : a + 2000]
                    part, share = (other_, mine_) if asks else (mine_, other_)
                    of = pa.array(row[some])
                    block = [np.full(len(some), tree), cell[some], part, share]
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, block), pa.array(np.full(len(some), not asks)), batch.column(0).take(of), pa.array(found[row[some], tree].view(np.int64)), *(batch.column(c).take(of) for c in (3, 4, 5))],
                        [*BLOCK, "held", "number", "string", "stop", "first", "vector"],
                    )

    return rows.mapInArrow(spread, f"tree long, cell long, part long, share long, held boolean, number long, string long, stop int, first long, vector {kind}")


BLOCK = ["tree", "cell", "part", "share"]
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[Block, Block]]:
    """Queries and rows of every block: number, string, stop or first id, vector; by string."""

    def parts(table: pa.Table) -> tuple[Block, Block]:
        out = []
        for held, column in ((False, "stop"), (True, "first")):
            t = table.filter(pa.compute.equal(table["held"], held))
            string = t["string"].to_numpy().view(np.uint64)
            order = np.argsort(string, kind="stable")
            vector = _lists(t["vector"].combine_chunks(), dimensions).astype(np.float64) if dimensions else np.zeros((len(string), 0))
            out.append((t["number"].to_numpy()[order], string[order], t[column].to_numpy()[order], vector[order]))
        return out[0], out[1]

    waiting: list[pa.RecordBatch] = []
    name: tuple | None = None
    for batch in batches:
        labels = np.stack([batch.column(i).to_numpy() for i in range(4)])
        cuts = [0, *(np.flatnonzero((labels[:, 1:] != labels[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(cuts):
            if a == b:
                continue
            if waiting and tuple(labels[:, a]) != name:
                yield parts(pa.Table.from_batches(waiting))
                waiting = []
            name = tuple(labels[:, a])
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield parts(pa.Table.from_batches(waiting))


def _range(string: np.ndarray, asked: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where, in sorted strings, those lie that share `stop` leading bits with each asked one."""
    rest = np.where(stop >= BITS, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(stop, BITS - 1).astype(np.uint64))
    return np.searchsorted(string, asked & ~rest, side="left"), np.searchsorted(string, asked | rest, side="right")


def _stops(forest: Forest, cells: Cells, budget: int) -> DataFrame:
    """number and stop of every wanted row: the most leading bits under which the trees hold the budget, together."""
    trees, bits = forest.trees, cells.bits
    schema = "number long, stop int, n long"

    def shallow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        under = cells.under()
        for batch in batches:
            string = _lists(batch.column(1), trees).view(np.uint64)
            at = cells.of(string)
            held = np.stack([sum(under[d][t, at[:, t] >> (bits - d)] for t in range(trees)) for d in range(bits + 1)], axis=1)
            stop = np.maximum((held >= budget).sum(axis=1) - 1, 0)  # counts only fall with the depth
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stop.astype(np.int32)), pa.array(held[np.arange(len(stop)), stop])], ["number", "stop", "n"])

    def deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number, asked, _, _), (_, string, _, _) in _blocks(batches, 0):
            if not len(number) or not len(string):
                continue
            for a in range(0, len(number), STRIPE):
                q, s = number[a : a + STRIPE], asked[a : a + STRIPE]
                out = []
                for d in range(bits + 1, BITS + 1):
                    lo, hi = _range(string, s, np.full(len(s), d))
                    some = np.flatnonzero(hi > lo)
                    if not len(some):
                        break
                    out.append((q[some], np.full(len(some), d, np.int32), (hi - lo)[some]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["number", "stop", "n"])

    asking = forest.rows.filter("wanted").select("number", F.pmod(F.xxhash64("number"), F.lit(1 << 40)).alias("draw"), F.col("asking").alias("strings"))
    first = stored(asking.select("number", "strings").mapInArrow(shallow, schema), "stops")
    on = first.filter(F.col("stop") == bits).filter(F.col("n") >= budget).select("number", "stop")
    further = asking.join(on, "number").select("number", "draw", "strings", "stop", F.lit(0).cast("long").alias("first"), F.lit(None).cast("boolean").alias("vector"))
    held = forest.rows.select("number", F.pmod(F.xxhash64("number"), F.lit(1 << 40)).alias("draw"), "strings", F.lit(0).alias("stop"), F.lit(0).cast("long").alias("first"), F.lit(None).cast("boolean").alias("vector"))
    come = Cells(bits, cells.rows, _table(_coming(further.select("strings", "stop"), cells, trees), trees, bits), cells.block)
    blocks = _dealt(further, come, trees, True, "boolean").unionByName(_dealt(held, come, trees, False, "boolean")).repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    sums = blocks.mapInArrow(deep, schema).groupBy("number", "stop").agg(F.sum("n").alias("n")).filter(F.col("n") >= budget)
    return stored(first.select("number", "stop").unionByName(sums.select("number", "stop")).groupBy("number").agg(F.max("stop").alias("stop")), "stops")


def _coming(asking: DataFrame, cells: Cells, trees: int) -> DataFrame:
    """How many queries (strings, stop) come to each cell, task by task."""

    def coming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((t, cells.visited(found[:, t], batch.column(1).to_numpy())[1]) for batch in batches for found in [_lists(batch.column(0), trees).view(np.uint64)] for t in range(trees))
        yield _counted(pairs, trees, cells.bits)

    return asking.mapInArrow(coming, "tree long, cell long, n long")


def found(forest: Forest, budget: int, block: tuple[int, int] = (BLOCK_ROWS, BLOCK_QUERIES)) -> DataFrame:
    """number, other and score: for every wanted row, the k + 1 best of the rows under its prefixes, itself among them."""
    trees, dimensions, k = forest.trees, forest.dimensions, forest.k
    bits = int(np.clip(np.ceil(np.log2(max(1, forest.count / block[0]))), 0, MOST_BITS))
    cells = Cells(bits, np.zeros((trees, 1 << bits), np.int64), block=block)

    def lying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _counted(((t, cells.of(f[:, t])) for batch in batches for f in [_lists(batch.column(0), trees).view(np.uint64)] for t in range(trees)), trees, bits)

    cells.rows = _table(forest.rows.select("strings").mapInArrow(lying, "tree long, cell long, n long"), trees, bits)
    draw = F.pmod(F.xxhash64("number"), F.lit(1 << 40)).alias("draw")
    asking = forest.rows.filter("wanted").join(_stops(forest, cells, budget), "number").select("number", draw, F.col("asking").alias("strings"), "stop", F.lit(0).cast("long").alias("first"), "vector")
    cells.queries = _table(_coming(asking.select("strings", "stop"), cells, trees), trees, bits)
    first = F.coalesce(F.element_at("ids", 1), F.lit(np.iinfo(np.int64).max)).alias("first")
    held = forest.rows.select("number", draw, "strings", F.lit(0).alias("stop"), first, "vector")
    blocks = _dealt(asking, cells, trees, True, forest.kind).unionByName(_dealt(held, cells, trees, False, forest.kind))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def kept() -> Iterator[pa.RecordBatch]:
            for part in itertools.batched(best, 2000):
                columns = [np.repeat(part, [len(best[q][0]) for q in part]), *(np.concatenate([best[q][c] for q in part]) for c in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["number", "other", "first", "score"])
            best.clear()

        for (number, asked, stop, vector), (other, string, smallest, rows) in _blocks(batches, dimensions):
            if not len(number) or not len(other):
                continue
            lo, hi = _range(string, asked, np.where(stop > bits, stop, 0))
            reach = np.abs(rows).max() * dimensions * 1e-12
            for a in range(0, len(number), STRIPE):
                q = slice(a, min(a + STRIPE, len(number)))
                low, high = int(lo[q].min()), int(hi[q].max())
                with np.errstate(all="ignore"):
                    product = vector[q] @ rows[low:high].T
                    for i, query in enumerate(number[q].tolist(), a):
                        own = product[i - a, lo[i] - low : hi[i] - low]
                        had = best.get(query)
                        # whatever ties with the last place but for rounding stays in
                        least = had[2][-1] if had is not None and len(had[0]) > k else -np.inf
                        if len(own) > k + 1:
                            least = np.fmax(least, -np.partition(-own, k)[k])
                        take = np.flatnonzero(~(own < least - reach * np.abs(vector[i]).max())) + lo[i]
                        score = np.add.reduce(vector[i] * rows[take], axis=1)  # in one order, whatever else is in the block
                        near = other[take], smallest[take], score
                        if had is not None:
                            near = tuple(map(np.concatenate, zip(had, near, strict=True)))
                            _, once = np.unique(near[0], return_index=True)  # other trees find the same rows
                            near = tuple(c[once] for c in near)
                        order = np.lexsort((near[0], near[1], -near[2]))[: k + 1]
                        best[query] = tuple(c[order] for c in near)
            if len(best) > MOST_HELD:
                yield from kept()
        yield from kept()

    # neighbouring cells go to one task, where a query's best rows of all of them are kept
    blocks = blocks.withColumn("near", F.expr(f"cell div {NEIGHBOURS}"))
    dealt = blocks.repartition("tree", "near", "part", "share").sortWithinPartitions("tree", "near", "part", "share", "cell").drop("near")
    near = dealt.mapInArrow(scored, "number long, other long, first long, score double")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.isnan("score"), F.desc("score"), "first", "other"))
    return near.distinct().withColumn("n", place).filter(F.col("n") <= k + 1).select("number", "other", "score")


def nearest(
    vectors: DataFrame,
    asked: Column,
    k: int = 20,
    recall: float = RECALL,
    trees: int = TREES,
    budget: int | None = None,
    block: tuple[int, int] = (BLOCK_ROWS, BLOCK_QUERIES),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows of the largest inner product found for every row where asked holds.

    A row is no neighbour of itself; other rows with its id or its vector are.  Equal scores go by smaller
    id, null ids last; a query without id is a query like others, with query_id null.  Repeated ids are
    rows of their own, and so are the queries among them.  Vectors that are null, empty, zero, or hold null
    or non-finite components take no part, and vectors of different lengths do not meet.  Scores that
    overflow are infinite, and those that are not a number come last.  asked is a condition on the columns
    of vectors; other columns are ignored.  An empty table gives no rows.  budget is fitted where not given.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    zero = F.lit(0).cast(kind[6:-1])  # of either sign
    own = own.filter(usable(F.col("vector"))).withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, zero).otherwise(x)))
    own = stored(own.withColumn("row", F.monotonically_increasing_id()), "vectors")
    best = F.row_number().over(Window.partitionBy("row").orderBy(F.isnan("score"), F.desc("score"), F.asc_nulls_last("vec_id"), "other_row"))
    out = None
    for size in [r["n"] for r in own.select(F.size("vector").alias("n")).distinct().collect()]:
        forest = planted(own.filter(F.size("vector") == size), size, k, trees)
        near = found(forest, fitted(forest, recall) if budget is None else budget, block)
        members = forest.rows.select(F.col("number").alias("other"), F.explode(F.arrays_zip("ids", "rows")).alias("m")).select("other", F.col("m.ids").alias("vec_id"), F.col("m.rows").alias("other_row"))
        met = near.join(members, "other").join(forest.queries, "number").filter("row <> other_row")
        ranked = met.withColumn("rank", best).filter(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
