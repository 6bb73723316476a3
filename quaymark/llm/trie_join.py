"""N-gram Jaccard join with tries.

A document is the set of its distinct word n-grams, as 64-bit hashes in one global order: rare
hash buckets first (bucket counts of the whole corpus), then by hash.  Equal sets are joined to
their smallest document first, so copies travel no further.

Two sets can only reach the similarity if they share an element among their first
n - ceil(t n) + 1, so only those are shuffled.  Where they meet,

1. every set is paired with a few sets drawn from the group (stars, linear in the group); pairs
   that prove similar already tie near copies into groups, and stars of other groups are drawn
   again, from the elements at which groups meet too often, as long as the join of step 2 would
   be more than linear and that shrinks it;
2. sets are dealt to tries of at most `block` sets, near copies side by side, and sets of
   different groups that share an element, and whose lengths and positions allow the
   similarity, are looked up in each other's tries.

A trie stores the ordered sets of its block.  One traversal carries the overlap of the probe
with the path, so sets with a common beginning share it, and leaves a subtree as soon as the
overlap so far plus what remains, of the probe and of the longest set below, can't reach the
bound.  Pairs within a group are never listed, and a task keeps only links that tie something
new together; no link between different groups is lost, so the components are exact.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.llm.components import components
from quaymark.llm.text import LOWER, SPACES, Rolling, copies_numbered, dropped, runs_of, small_batches, stored, utf8, words

N, PERCENT, BLOCK = 5, 75, 256
#: Stars that a set is compared with at first, and the ratio of sizes that counts as alike.
STARS, LIKE = 5, 1.15
#: Rows of the join across groups, to rows that go into it, at which no more stars are drawn.
FEW = 2
#: Bits of the bitmap that picks documents, for each of them, and in all (more documents are picked by a join), and bits that a document sets.
KEY_BITS, MOST_BITS, PROBES = 16, 1 << 28, 4
#: Buckets of the corpus-wide counts: a fixed size, whatever the corpus.
BUCKET_BITS = 21
#: Bits of a set's parity map.
PARITY_BITS = 4096


def shingle_sets(column: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-grams of every text (fewer words: the whole sequence), and their counts."""
    data, offsets = utf8(column)
    data = LOWER[data]
    start, end, owner = words(data, offsets, SPACES)
    docs = len(offsets) - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    h = Rolling(data).of(start, end)
    sums = Rolling(h)
    counts = np.bincount(owner, minlength=docs)
    first = np.cumsum(counts) - counts
    row, k = runs_of(np.where(counts >= n, counts - n + 1, np.minimum(counts, 1)))
    at = first[row] + k
    grams = sums.of(at, at + np.minimum(counts, n)[row])
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (grams[1:] != grams[:-1])
    return grams[new], np.bincount(row[new], minlength=docs)


def parity_maps(grams: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Per set, for every bit whether an odd number of elements falls on it, as 64-bit words.

    Two sets' maps differ in at most as many bits as the sets differ in elements.
    """
    row, _ = runs_of(sizes)
    at = (grams >> np.uint64(9)).astype(np.int64) % PARITY_BITS
    upto = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for a in range(0, len(sizes), 256):
        n = min(256, len(sizes) - a)
        s = slice(upto[a], upto[a + n])
        odd = np.bincount((row[s] - a) * PARITY_BITS + at[s], minlength=n * PARITY_BITS).astype(np.uint8) & 1
        out.extend(np.packbits(odd).view(np.int64).reshape(n, -1))
    return out


def surveyed(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """One pass over the corpus, with two kinds of rows.

    Per document: doc_id, copy, n_shingles, node, a hash of its set (null without words), so that
    equal sets are one node, and the set's parity map.  Per task: the hash buckets that its documents use more often than
    evenly, with counts.  The counts only order the elements, and any order that is the same
    everywhere is right, so rare buckets needn't be sent.
    """
    schema = "doc_id long, copy long, n_shingles long, node long, parity array<long>, bucket int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in schema.split(", ")]
        total = np.zeros(1 << bits, np.int32)
        for batch in batches:
            grams, sizes = shingle_sets(batch.column(2), n)
            bucket, times = np.unique((grams >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
            total[bucket] += times.astype(np.int32)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            node = Rolling(grams).of(upto[:-1], upto[1:]).view(np.int64)
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), pa.array(node, mask=sizes == 0), pa.array(parity_maps(grams, sizes), pa.list_(pa.int64())), none.cast(pa.int32()), none], names
            )
        at = np.flatnonzero(total > 2 + 2 * total.mean())
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(at), pa.list_(pa.int64())), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names)

    return docs.select("doc_id", "copy", "text").mapInArrow(run, schema)


def bucket_counts(survey: DataFrame, bits: int) -> np.ndarray:
    """Summed counts of the buckets: an array of fixed size."""
    table = survey.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, np.int32)
    out[table["bucket"].to_numpy()] = np.minimum(table["n"].to_numpy(), 2**31 - 1)
    return out


def required(a, b, percent: int):
    """Least overlap of sets of sizes a and b with 100 |A and B| >= percent |A or B|."""
    return -(-(a + b) * percent // (100 + percent))


def prefix(size, percent: int):
    """Elements of which one must be shared with any similar set."""
    return size + percent * -size // 100 + 1


def in_order(column: pa.Array, n: int, often: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every text's elements in the global order, the sizes, and the sets' nodes."""
    grams, sizes = shingle_sets(column, n)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    node = Rolling(grams).of(upto[:-1], upto[1:]).view(np.int64)
    row, _ = runs_of(sizes)
    heavy = often[(grams >> np.uint64(64 - bits)).astype(np.int64)]
    moved = heavy > 0  # the others keep their places, before these
    order = np.lexsort((heavy, row)) if moved.any() else slice(None)
    return grams[order], sizes, node


def key_hashes(bits: int) -> Column:
    """The bits of (doc_id, copy) in a bitmap."""
    return F.array(*(F.pmod(F.xxhash64("doc_id", "copy", F.lit(k)), F.lit(bits)) for k in range(PROBES)))


def key_bits(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap in which the hashes of (doc_id, copy) are set."""
    at = keys.select(F.explode(key_hashes(bits)).alias("at"))
    words = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(at, 64) as int))").alias("bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[table["word"].to_numpy()] = table["bit"].to_numpy()
    return out.view(np.uint64)


def sets_of(docs: DataFrame, keys: DataFrame, n: int, often, bits: int) -> DataFrame:
    """node and its set's elements, as bytes in the global order, at least for the given rows; stored.

    The corpus is read again.  A bitmap of `KEY_BITS` bits a row picks the rows, so no text is
    shuffled, and what it picks beyond them, one row in four hundred at most, is sifted out where
    sets are joined.  Rows too many for a bitmap of `MOST_BITS` are picked by a join.
    """
    count = keys.count()
    size = 1 << max(12, (KEY_BITS * count - 1).bit_length())
    small = size <= MOST_BITS
    wanted = docs.sparkSession.sparkContext.broadcast(key_bits(keys, size) if small else None)
    if not small:
        docs = docs.join(keys.select(F.col("doc_id").alias("i"), F.col("copy").alias("c")), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("copy") == F.col("c")), "left_semi")
    h = key_hashes(size).alias("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            if small:
                key = batch.column(1).flatten().to_numpy().reshape(-1, PROBES)
                hit = (wanted.value[key >> 6] >> (key & 63).astype(np.uint64)) & np.uint64(1) > 0
                texts = texts.filter(pa.array(hit.all(axis=1)))
            if not len(texts):
                continue
            grams, sizes, node = in_order(texts, n, often.value, bits)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            raw = [grams[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(raw, pa.binary())], ["node", "grams"]).filter(pa.array(sizes > 0))

    out = stored(docs.select("text", h).mapInArrow(run, "node long, grams binary"), "sets")
    wanted.destroy()
    return out


def prefix_rows(docs: DataFrame, n: int, often, bits: int, percent: int) -> DataFrame:
    """gram, node, size and pos of the elements that can show a similar set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, sizes, node = in_order(batch.column(0), n, often.value, bits)
            row, k = runs_of(np.where(sizes > 0, prefix(sizes, percent), 0))
            own = grams[(np.cumsum(sizes) - sizes)[row] + k].view(np.int64)
            for a in range(0, len(row), 100_000):
                s = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[s]), pa.array(node[row[s]]), pa.array(sizes[row[s]].astype(np.int32)), pa.array(k[s].astype(np.int32))],
                    ["gram", "node", "size", "pos"],
                )

    return docs.select("text").mapInArrow(run, "gram long, node long, size int, pos int")


def shared_rows(rows: DataFrame) -> DataFrame:
    """The rows whose gram two nodes have, once per node.

    Rows stream sorted by gram, so a gram of any frequency passes in constant memory.
    """
    ordered = rows.repartition("gram").sortWithinPartitions("gram", "node").select("gram", "node", "size", "pos")
    names, kinds = ["gram", "node", "size", "pos"], [np.int64, np.int64, np.int32, np.int32]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, going = None, False  # the last row read, which waits for its successor; whether its gram began before it
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            gram, node = cols[:2]
            fresh = np.ones(len(gram), bool)
            fresh[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
            cols = [c[fresh] for c in cols]
            gram = cols[0]
            same = np.zeros(len(gram) + 1, bool)  # the gram goes on from the row before
            same[0], same[1:-1] = going, gram[1:] == gram[:-1]
            at = np.flatnonzero((same[:-1] | same[1:])[:-1])
            held, going = [c[-1:] for c in cols], bool(same[-2])
            yield pa.RecordBatch.from_arrays([pa.array(c[at].astype(k)) for c, k in zip(cols, kinds, strict=True)], names)
        if held is not None and going:
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(held, kinds, strict=True)], names)

    return ordered.mapInArrow(run, "gram long, node long, size int, pos int")


def starred(shared: DataFrame, groups: DataFrame | None, most: int, turn: int) -> DataFrame:
    """Pairs (a, b): every node with the sets, of those drawn from its grams, that it meets most often.

    Among the sets of a gram with like sizes, two are drawn, and a node is paired with those of
    another group (their own node at first).  One is drawn by a hash.  The other has the gram
    nearest to its beginning: rare elements come first, so it has the fewest of its own and is
    the likeliest to be similar to the rest.  Every turn draws it from twice as many positions.
    Sizes fall into two overlapping scales, so near sizes are alike in one of them.
    """
    size = F.log(F.col("size").cast("double")) / math.log(LIKE)
    scales = F.array(F.floor(size), F.floor(size + 0.5) + 100_000)
    label = F.col("node") if groups is None else F.coalesce("label", "node")
    rows = (shared if groups is None else shared.join(groups, "node", "left")).select("gram", "node", label.alias("label"), F.explode(scales).alias("like"), F.shiftright("pos", turn).alias("pos"))
    set_, by = F.struct("node", "label"), F.xxhash64("node", F.lit(turn))
    drawn = rows.groupBy("gram", "like").agg(
        F.min_by(set_, F.struct("pos", by)).alias("x"), F.max_by(set_, F.xxhash64("label", F.lit(turn))).alias("y"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    met = rows.join(drawn.filter("low <> high"), ["gram", "like"]).select("node", "label", F.explode(F.array_distinct(F.array("x", "y"))).alias("star"))
    met = met.filter("label <> star.label").groupBy("node", F.col("star.node").alias("star")).count()
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("count"), "star"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= most).select(F.col("node").alias("a"), F.col("star").alias("b"))


class Trie:
    """Ordered sets; a path of single children is one node."""

    def __init__(self, sets: list[tuple[int, list[int]]]):
        self.root = self._node(sorted(sets, key=lambda s: s[1]), 0)

    def _node(self, sets: list, depth: int) -> tuple:
        """(labels, children, sets that end here, least and greatest size below)."""
        first, last = sets[0][1], sets[-1][1]
        stop, most = depth, min(len(first), len(last))
        while stop < most and first[stop] == last[stop]:
            stop += 1
        ends = [i for i, s in sets if len(s) == stop]
        children, k = [], len(ends)
        while k < len(sets):
            label, begin = sets[k][1][stop], k
            while k < len(sets) and sets[k][1][stop] == label:
                k += 1
            children.append((sets[begin:k], stop))
        sizes = [len(s) for _, s in sets]
        return first[depth:stop], [self._node(*c) for c in children], ends, min(sizes), max(sizes)

    def similar(self, probe: list[int], percent: int) -> list[int]:
        """Sets whose Jaccard similarity with the probe reaches the bound."""
        place = {g: k for k, g in enumerate(probe)}
        size, out, stack = len(probe), [], [(self.root, 0, 0, -1)]
        while stack:
            (labels, children, ends, least, most), depth, overlap, last = stack.pop()
            need = required(size, least, percent)
            for g in labels:
                depth += 1
                k = place.get(g)
                if k is not None:
                    overlap, last = overlap + 1, k
                elif overlap + min(size - last - 1, most - depth) < need:
                    break
            else:
                if ends and overlap >= required(size, depth, percent):
                    out.extend(ends)
                if overlap + min(size - last - 1, most - depth) >= need:
                    stack.extend((c, depth, overlap, last) for c in children)
        return out


def looked_up(probes: DataFrame, members: DataFrame, sets: DataFrame, percent: int, probes_per_task: int = 2048) -> DataFrame:
    """Links (a, b): every probe (node, block) against the trie of the block's members (node, block).

    A block with many probes is built in several tasks, each with a share of the probes; the
    members come first in a task, which holds one trie at a time.  Of the links in a block only
    those are kept that tie something new together.
    """
    many = probes.groupBy("block").agg(F.ceil(F.count("*") / probes_per_task).cast("int").alias("parts"))
    dealt = probes.join(many, "block").select("node", "block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    spread = members.join(many, "block").select("node", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = spread.withColumn("kind", F.lit(0)).unionByName(dealt.withColumn("kind", F.lit(1))).join(sets.dropDuplicates(["node"]), "node")
    rows = rows.repartition("block", "part").sortWithinPartitions("block", "part", "kind", "node").select("block", "part", "kind", "node", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, trie = None, [], None
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        for batch in batches:
            a, b = [], []
            for block, part, kind, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, part) != current:
                    current, waiting, trie = (block, part), [], None
                    above.clear()
                grams = np.frombuffer(raw, np.uint64).tolist()
                if kind == 0:
                    waiting.append((node, grams))
                    continue
                trie = trie or Trie(waiting)
                for other in trie.similar(grams, percent):
                    if (x := root(node)) != (y := root(other)):
                        above[x] = y
                        a.append(node)
                        b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def plausible(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parity maps don't rule out the similarity; exact, as maps never differ more than sets."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    maps = own.join(nodes, "node", "left_semi").select("node", "n_shingles", "parity").dropDuplicates(["node"])
    a, b = (maps.select(*(F.col(c).alias(f"{c}_{x}") for c in maps.columns)) for x in "ab")
    joined = pairs.join(a, F.col("a") == F.col("node_a")).join(b, F.col("b") == F.col("node_b"))
    apart = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col("n_shingles_a") + F.col("n_shingles_b")
    need = F.ceil(total * percent / (100 + percent))
    return joined.filter(apart <= total - 2 * need).select("a", "b")


def crossing(shared: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different groups that may be similar, by lengths and positions.

    shared: gram, node, size, pos; groups: node, label.  For each pair the shared elements of
    the prefixes are counted; what follows the last of them bounds the rest of the overlap.
    """
    rows = shared.join(groups, "node", "left").select("gram", "node", "size", "pos", F.coalesce("label", "node").alias("label"))
    mixed_grams = rows.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("gram")
    rows = rows.join(mixed_grams, "gram", "left_semi")
    a = rows.select("gram", *(F.col(c).alias(f"{c}_a") for c in ("node", "size", "pos", "label")))
    b = rows.select("gram", *(F.col(c).alias(f"{c}_b") for c in ("node", "size", "pos", "label")))
    need = F.ceil((F.col("size_a") + F.col("size_b")) * percent / (100 + percent))
    left = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
    met = a.join(b, "gram").filter((F.col("label_a") < F.col("label_b")) & (left >= need))
    pairs = met.groupBy("node_a", "node_b").agg(
        F.count("*").alias("met"), F.max("pos_a").alias("pos_a"), F.max("pos_b").alias("pos_b"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b")
    )
    rest = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) - 1
    return pairs.filter(F.col("met") + rest >= need).select("node_a", "node_b")


def meetings(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """gram, n and pairs of the grams that several groups have: its rows, and their pairs of different groups, lengths and positions apart."""
    label = F.coalesce("label", "node").alias("label")
    held = shared.join(groups, "node", "left").groupBy("gram", label).agg(F.count("*").cast("double").alias("n"))
    grams = held.groupBy("gram").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same")).filter("n * n > same")
    return grams.select("gram", "n", ((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs"))


def similar_groups(docs: DataFrame, n: int = N, percent: int = PERCENT, block: int = BLOCK, bits: int = BUCKET_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, copy, n_shingles, component_id and component_copy of every row.

    component_id is the smallest doc_id reachable by links.  Null and empty texts and those
    without words have no set and link with nothing; ids that are null come after all others.
    Repeated ids are told apart by copy (0, 1, ...).  Other columns are ignored; an empty table
    gives no rows.
    """
    return groups_of(copies_numbered(docs, id_col, text_col), n, percent, block, bits)


def one_per_group(docs: DataFrame, n: int = N, percent: int = PERCENT, block: int = BLOCK, bits: int = BUCKET_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of every group, with the columns of docs."""
    rows = copies_numbered(docs, id_col, text_col, whole=True)
    texts = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col("__copy").alias("copy"))
    groups = groups_of(texts, n, percent, block, bits)
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("copy") == F.col("component_copy")))
    keys = stay.select(F.col("doc_id").alias("__id"), F.col("copy").alias("__kept"))
    same = rows[id_col].cast("long").eqNullSafe(keys["__id"]) & (rows["__copy"] == keys["__kept"])
    return rows.join(keys, same, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def groups_of(docs: DataFrame, n: int, percent: int, block: int, bits: int) -> DataFrame:
    """similar_groups over numbered rows: doc_id, copy, text."""
    spark = docs.sparkSession
    small_batches(spark)
    survey = stored(surveyed(docs, n, bits), "survey")
    often = spark.sparkContext.broadcast(bucket_counts(survey, bits))
    own = survey.filter("bucket is null").select("doc_id", "copy", "n_shingles", "node", "parity")
    shared = stored(shared_rows(prefix_rows(docs, n, often, bits, percent)), "shared")

    def fetched(nodes: DataFrame) -> DataFrame:
        """The sets of some nodes, each from one of its documents."""
        first = own.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "copy")).alias("d")).select("d.doc_id", "d.copy")
        keys = stored(first, "keys")
        sets = sets_of(docs, keys, n, often, bits)
        dropped(keys)
        return sets

    # 1. every set with a few stars, and again with stars of other groups
    near = groups = None
    drawn, before, most = shared, math.inf, None
    for turn in itertools.count():
        stars = stored(plausible(starred(drawn, groups, STARS, turn), own, percent).toDF("node", "block"), "stars")
        centres = stars.select("block").distinct().select(F.col("block").alias("node"), "block")
        sets = fetched(stars.select("node").union(centres.select("node")).distinct())
        found = looked_up(stars, centres, sets, percent)
        earlier, near = near, stored(found if near is None else near.union(found), "near")
        dropped(stars, sets, *([groups] if groups else []), *([earlier] if earlier else []))
        groups = components(near).select("node", F.col("component").alias("label"))
        met = stored(meetings(drawn, groups), "meetings")
        crowded = F.col("pairs") > FEW * F.col("n")
        rows, across, much = met.agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in ("n", "pairs", F.when(crowded, F.col("pairs"))))).first()
        most = FEW * rows if most is None else most
        if across <= most or across > 0.8 * before:
            dropped(met, *([drawn] if turn else []))
            break
        # the next turn draws from the grams at which groups meet too often; the others' pairs stay
        often_met = stored(met.filter(crowded).select("gram"), "crowded")
        before, most = much, most - (across - much)
        earlier, drawn = drawn, stored(drawn.join(often_met, "gram", "left_semi").select(shared.columns), "drawn")
        dropped(met, often_met, *([earlier] if turn else []))
    # 2. pairs across groups; near copies share a trie
    pairs = stored(plausible(crossing(shared, groups, percent).toDF("a", "b"), own, percent).toDF("node_a", "node_b"), "pairs")
    nodes = pairs.select(F.col("node_a").alias("node")).union(pairs.select("node_b")).distinct()
    label = nodes.join(groups, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    sizes = label.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    members = stored(label.join(sizes, "label").select("node", F.xxhash64("label", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")), "members")
    probes = pairs.join(members.withColumnRenamed("node", "node_b"), "node_b").select(F.col("node_a").alias("node"), "block").distinct()
    sets = fetched(nodes)
    links = stored(near.union(looked_up(probes, members, sets, percent)).distinct(), "links")
    often.destroy()
    dropped(shared, groups, pairs, members, sets, near)
    found = components(links).select("node", F.col("component").alias("label"))
    dropped(links)
    labelled = own.drop("parity").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "copy")
    smallest = labelled.filter("label is not null").groupBy("label").agg(F.min(order).alias("first"))
    alone = F.col("label").isNull()
    return labelled.join(smallest, "label", "left").select(
        "doc_id",
        "copy",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        F.when(alone, F.col("copy")).otherwise(F.col("first.copy")).alias("component_copy"),
    )
