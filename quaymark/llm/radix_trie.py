"""Prefix trie of conversations, by adaptive radix trees.

A turn is a fixed-width id, WIDTH big-endian bytes of a SHA-256 of role and text, and a
conversation is the string of its turns' ids.  Equal conversations are one string with a count.
The strings are sorted by range, cut into blocks of bounded size, and every block is put into an
adaptive radix tree: nodes of 4, 16, 48 or 256 places that grow as they fill, with whole runs of
bytes that do not branch kept in one node.  A trie node stands at every depth on such a run that is
a multiple of WIDTH; other branchings are inside an id and mean nothing.

Neighbouring blocks share the nodes on the way to the cut.  A block knows the last string before it
and the first after it, so it can tell which of its nodes are shared, and counts each distinct node
in one block only.  All counts then add up; a node that is shared gets its sums from the blocks, and
the number of such nodes is blocks times depth.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.llm.text import small_batches, stored

WIDTH = 16
#: Strings and bytes of a block, and turns that a conversation can borrow at most.
BLOCK_ROWS, BLOCK_BYTES, LONGEST_HEAD = 20_000, 1 << 24, 1024


class Few:
    """Up to 4 or 16 children, sorted by byte."""

    def __init__(self, room: int = 4):
        self.room, self.keys, self.below = room, bytearray(), []

    def find(self, byte: int) -> Branch | None:
        at = self.keys.find(byte)
        return self.below[at] if at >= 0 else None

    def put(self, byte: int, child: Branch) -> Few | Indexed:
        if len(self.keys) == self.room:
            wider = Few(16) if self.room == 4 else Indexed()
            for b, c in self.items():
                wider.put(b, c)
            return wider.put(byte, child)
        at = bisect.bisect(self.keys, byte)
        self.keys.insert(at, byte)
        self.below.insert(at, child)
        return self

    def items(self) -> Iterator[tuple[int, Branch]]:
        return zip(self.keys, self.below, strict=True)


class Indexed:
    """Up to 48 children: an index by byte into a list."""

    def __init__(self):
        self.index, self.below = bytearray(256), []

    def find(self, byte: int) -> Branch | None:
        at = self.index[byte]
        return self.below[at - 1] if at else None

    def put(self, byte: int, child: Branch) -> Indexed | Direct:
        if len(self.below) == 48:
            wider = Direct()
            for b, c in self.items():
                wider.put(b, c)
            return wider.put(byte, child)
        self.below.append(child)
        self.index[byte] = len(self.below)
        return self

    def items(self) -> Iterator[tuple[int, Branch]]:
        return ((b, self.below[at - 1]) for b, at in enumerate(self.index) if at)


class Direct:
    """A place for every byte."""

    def __init__(self):
        self.below: list[Branch | None] = [None] * 256

    def find(self, byte: int) -> Branch | None:
        return self.below[byte]

    def put(self, byte: int, child: Branch) -> Direct:
        self.below[byte] = child
        return self

    def items(self) -> Iterator[tuple[int, Branch]]:
        return ((b, c) for b, c in enumerate(self.below) if c is not None)


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


class Branch:
    """A run of bytes, what ends after it, and the children by their next byte."""

    __slots__ = ("children", "prefix", "value")

    def __init__(self, prefix: bytes, value: tuple | None = None, children: Few | Indexed | Direct | None = None):
        self.prefix, self.value, self.children = prefix, value, children or Few()

    def insert(self, key: bytes, value: tuple) -> None:
        node, at = self, 0
        while True:
            n = shared(node.prefix, key[at : at + len(node.prefix)])
            if n < len(node.prefix):
                below = Branch(node.prefix[n + 1 :], node.value, node.children)
                byte, node.prefix, node.value, node.children = node.prefix[n], node.prefix[:n], None, Few()
                node.children = node.children.put(byte, below)
            at += n
            if at == len(key):
                node.value = value
                return
            child = node.children.find(key[at])
            if child is None:
                node.children = node.children.put(key[at], Branch(key[at + 1 :], value))
                return
            node, at = child, at + 1


def _chain(key: bytes, turns: int) -> list[bytes]:
    """Digests of the first 0, 1, .. turns of a string."""
    h = hashlib.sha256()
    out = [h.digest()]
    for d in range(turns):
        h.update(key[d * WIDTH : (d + 1) * WIDTH])
        out.append(h.copy().digest())
    return out


class Spot:
    """A branch met on the way down, and what its subtree adds up to."""

    __slots__ = ("above", "branch", "first", "kids", "last", "left", "leaves", "n", "own_kids", "own_tops", "right", "saved", "sizes", "smallest", "stand", "tops", "up")

    def __init__(self, branch: Branch, first: int, last: int, left: bool, right: bool, up: Spot | None):
        self.branch, self.first, self.last, self.left, self.right, self.up = branch, first, last, left, right, up
        self.n = self.leaves = self.saved = self.kids = self.own_kids = 0
        self.smallest, self.sizes = None, None


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node binary, parent binary"
_KINDS = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary()]
_NAMES = [part.split()[0] for part in NODE.split(", ")]


def trie_nodes(rows: list[tuple[bytes, bytes, int, int, str]], before: bytes | None, after: bytes | None) -> Iterator[tuple]:
    """Nodes of a block of sorted distinct strings (key, sizes, members, smallest member, digest of members).

    node is set where the node is shared with a neighbouring block (before: the last string of the one
    before, after: the first of the next), and then the counts are this block's part; parent is set,
    and parent_conv_id not, where the parent is shared.
    """
    first, last = rows[0][0], rows[-1][0]
    p = shared(first, before) // WIDTH if before is not None else -1
    r = shared(last, after) // WIDTH if after is not None else -1
    ids_first, ids_last = _chain(first, max(p, 0)), _chain(last, max(r, 0))
    tree = Branch(b"")
    for key, *value in rows:
        tree.insert(key, tuple(value))

    spots: list[Spot] = []
    stack = [Spot(tree, 0, len(tree.prefix), True, True, None)]
    while stack:
        spot = stack.pop()
        spots.append(spot)
        below = [c for _, c in spot.branch.children.items()]
        for k, child in enumerate(below):
            stack.append(
                Spot(child, spot.last + 1, spot.last + 1 + len(child.prefix), spot.left and k == 0 and spot.branch.value is None, spot.right and k == len(below) - 1, spot)
            )

    def owned(spot: Spot, depth: int) -> bool:
        return not (spot.left and depth <= p)

    def shared_id(spot: Spot, depth: int) -> bytes | None:
        return ids_first[depth] if spot.left and depth <= p else ids_last[depth] if spot.right and depth <= r else None

    for spot in reversed(spots):
        if spot.branch.value is not None:
            sizes, n, smallest, _ = spot.branch.value
            spot.n += n
            spot.smallest = smallest if spot.smallest is None else min(spot.smallest, smallest)
            spot.sizes = sizes
        # depths of the nodes on the run; the root stands at 0
        depths = range(-(-spot.first // WIDTH), spot.last // WIDTH + 1)
        spot.stand = []
        for depth in reversed(depths):
            own = owned(spot, depth)
            if depth == depths[-1] and not spot.kids and own and not (spot.right and depth <= r):
                spot.leaves = 1
            size = int.from_bytes(spot.sizes[8 * depth - 8 : 8 * depth], "little") if depth else 0
            spot.saved += size * (spot.n - own)
            spot.stand.append((depth, spot.own_kids, spot.leaves, spot.saved))
            spot.kids, spot.own_kids = 1, int(own)
        if spot.up is not None:
            up = spot.up
            up.n, up.leaves, up.saved = up.n + spot.n, up.leaves + spot.leaves, up.saved + spot.saved
            up.kids, up.own_kids = up.kids + spot.kids, up.own_kids + spot.own_kids
            up.smallest = spot.smallest if up.smallest is None else min(up.smallest, spot.smallest)
            up.sizes = spot.sizes

    for spot in spots:
        conv, ident = spot.up.above if spot.up is not None else (None, None)
        for depth, kids, leaves, saved in reversed(spot.stand):
            own = shared_id(spot, depth)
            ends = spot.branch.value[3] if spot.branch.value is not None and depth * WIDTH == spot.last else None
            yield spot.smallest, depth, None if ident else conv, spot.n, kids, leaves, saved, ends, own, ident
            conv, ident = spot.smallest, own
        spot.above = conv, ident


def turn_id(role: str, text: str) -> Column:
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))


def sequences(conversations: DataFrame, base: Column | None = None, borrowed: Column | None = None) -> DataFrame:
    """conv_id, key (the turns' ids) and sizes (bytes of every turn's text, 8 little-endian bytes each).

    With base and borrowed (columns over conv_id), a conversation is the first `borrowed` turns of the
    conversation base, and then its own turns after as many.  Turns that tie are ordered by their ids,
    which no row order changes; rows without conv_id belong to no conversation.
    """
    small_batches(conversations.sparkSession)
    own = F.col("conv_id")
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id("role", "text").alias("id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size")
    )
    rows = rows.select("*", (base if base is not None else own).alias("base"), (borrowed if borrowed is not None else F.lit(0)).cast("long").alias("borrowed"))
    dealt = rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "id", "size")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = conv = None
        head: list[tuple[bytes, int]] = []  # first turns of the base
        ids, sizes, seen = bytearray(), [], 0

        def start(c: int, n: int) -> None:
            nonlocal ids, sizes, seen, conv
            conv, seen = c, 0
            take = head[:n] if c != family else []
            ids, sizes = bytearray(b"".join(i for i, _ in take)), [s for _, s in take]

        for batch in batches:
            out: list[tuple] = []
            for c, i, size, b, n in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if c != conv:
                    if conv is not None:
                        out.append((conv, bytes(ids), np.array(sizes, "<i8").tobytes()))
                    if b != family:
                        family, head = b, []
                    start(c, n)
                if c == b:
                    if len(head) < LONGEST_HEAD:
                        head.append((i, size))
                elif n > LONGEST_HEAD:
                    raise ValueError(f"at most {LONGEST_HEAD} turns can be borrowed")
                if c == b or seen >= n:
                    ids += i
                    sizes.append(size)
                seen += 1
            if out:
                yield _sequences(out)
        if conv is not None:
            yield _sequences([(conv, bytes(ids), np.array(sizes, "<i8").tobytes())])

    return dealt.select("conv_id", "id", "size", "base", "borrowed").mapInArrow(joined, "conv_id long, key binary, sizes binary")


def _sequences(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["conv_id", "key", "sizes"])


def _ends(strings: DataFrame) -> DataFrame:
    """class and the SHA-256 of its members' decimal ids, in order and joined by commas.

    A class may hold most of the rows: its ids are sorted and joined into chunks by range, in as many
    tasks as they fill, and one task hashes the chunks of a class in order.
    """

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [0, *(i for i in range(1, len(ids)) if kinds[i] != kinds[i - 1]), len(ids)]
            spans = [(a, b) for a, b in itertools.pairwise(cuts) if a < b]
            yield pa.RecordBatch.from_arrays(
                [pa.array([kinds[a] for a, _ in spans], pa.binary()), pa.array([ids[a] for a, _ in spans], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in spans])],
                ["class", "first", "ids"],
            )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, h = None, None
        for batch in batches:
            out: list[tuple] = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != kind:
                    if h is not None:
                        out.append((kind, h.hexdigest()))
                    kind, h = k, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["class", "ends"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.binary()), pa.array([h.hexdigest()])], ["class", "ends"])

    members = strings.select("class", "conv_id").repartitionByRange("class", "conv_id").sortWithinPartitions("class", "conv_id")
    chunks = members.mapInArrow(chunked, "class binary, first long, ids string")
    return chunks.repartition("class").sortWithinPartitions("class", "first").mapInArrow(hashed, "class binary, ends string")


def _cut(classes: DataFrame, most: int) -> DataFrame:
    """The classes sorted by key, with block, and whether a row opens or closes its block."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        rows = held = 0
        waiting: tuple | None = None  # the last row, until the next tells whether it closes a block
        names = ["key", "sizes", "n", "conv_id", "ends", "block", "opens", "closes"]
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full = rows == most or held > BLOCK_BYTES
                if waiting is not None:
                    out.append((*waiting, full))
                if full:
                    block, rows, held = block + 1, 0, 0
                waiting = (*row, block, rows == 0)
                rows, held = rows + 1, held + len(row[0])
            if out:
                yield table(out)
        if waiting is not None:
            yield table([(*waiting, True)])

    return classes.select("key", "sizes", "n", "conv_id", "ends").mapInArrow(
        numbered, "key binary, sizes binary, n long, conv_id long, ends string, block long, opens boolean, closes boolean"
    )


def prefix_trie(
    conversations: DataFrame, base: Callable[[Column], Column] | None = None, borrowed: Callable[[Column], Column] | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The nodes of the trie of all conversations, root included.

    conv_id is the smallest member; parent_conv_id the parent's (null for the root); n_convs counts
    members, n_children and n_leaves nodes; saved_tokens adds up, over the node's subtree, (n_convs - 1)
    times the bytes of the node's text; ends_sha256 is the digest of the ids of the conversations that
    end at the node, ascending and joined by commas (of nothing where none does).

    Null role and text are empty, null turns come first, repeated rows are repeated turns, and turns that
    tie are ordered by their ids.  Rows without conv_id belong to no conversation.  Other columns are
    ignored; no conversations give no nodes.  A conversation's ids must fit in a task.
    """
    conv = F.col("conv_id")
    strings = stored(sequences(conversations, base and base(conv), borrowed and borrowed(conv)).withColumn("class", F.unhex(F.sha2("key", 256))), "strings")
    classes = strings.groupBy("key", "sizes", "class").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    classes = stored(classes.join(_ends(strings), "class"), "classes")
    blocks = stored(_cut(classes.repartitionByRange("key").sortWithinPartitions("key"), block_rows), "blocks")

    by_key = Window.orderBy("key")  # a row for each block
    after = blocks.filter("opens").select("block", F.lead("key").over(by_key).alias("key"), F.lit(1).alias("kind"))
    before = blocks.filter("closes").select("block", F.lag("key").over(by_key).alias("key"), F.lit(0).alias("kind"))
    edges = after.unionByName(before).filter("key is not null")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("sizes", "binary"), ("n", "long"), ("conv_id", "long"), ("ends", "string"))]
    fed = blocks.select("block", F.lit(2).alias("kind"), "key", "sizes", "n", "conv_id", "ends").unionByName(edges.select("block", "kind", "key", *empty))

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple], edge: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
            nodes = trie_nodes(rows, edge.get(0), edge.get(1))
            while part := list(itertools.islice(nodes, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), _KINDS, strict=True)], _NAMES)

        block, rows, edge = None, [], {}
        for batch in batches:
            for b, kind, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    if rows:
                        yield from out(rows, edge)
                    block, rows, edge = b, [], {}
                if kind == 2:
                    rows.append(tuple(row))
                else:
                    edge[kind] = row[0]
        if rows:
            yield from out(rows, edge)

    parts = stored(fed.repartition("block").sortWithinPartitions("block", "kind", "key").mapInArrow(built, NODE), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.filter("node is not null").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.max("ends_sha256").alias("ends_sha256"), *sums
    )
    merged = stored(merged, "shared").withColumn("parent_conv_id", F.lit(None).cast("long"))
    alone = parts.filter("node is null")
    names = [n for n in _NAMES if n not in ("node", "parent")]
    orphans = merged.select(*names, "parent").filter("parent is not null").unionByName(alone.filter("parent is not null").select(*names, "parent"))
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("found"))
    done = alone.filter("parent is null").select(*names).unionByName(merged.filter("parent is null").select(*names))
    found = orphans.join(parents, "parent").withColumn("parent_conv_id", F.col("found")).select(*names)
    nothing = hashlib.sha256(b"").hexdigest()
    return done.unionByName(found).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
