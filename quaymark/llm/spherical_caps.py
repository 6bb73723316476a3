"""Near-duplicate vectors with spherical-cap filters.

Filters are directions of a structured random product code: the dimensions are cut into blocks,
each with its own random unit vectors, and a filter takes one from every block.  A vector lies in
a filter's cap when their inner product exceeds a threshold.  Since it is a sum over blocks, all
such filters are decoded without trying each: partial sums of one half of the blocks are
kept while the best of the other half can still lift them over the threshold.  Vectors that
share a label and a filter meet and are compared exactly.

A vector in no cap, or in few, also takes the filters nearest to it, `least` in all, so that
every vector is indexed.  Equal vectors of a label are one class from the start; pairs between
classes carry on, copies only add to counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.components import components
from quaymark.llm.text import small_batches, stored

COSINE, BLOCKS, CODES, CAP, LEAST, CHUNK, SEED = 0.98, 4, 32, 0.50, 24, 256, 7
#: Candidate pairs within this of the bound are recomputed row by row in double precision.
_EDGE = 1e-9


def code(dimensions: int, blocks: int = BLOCKS, codes: int = CODES, seed: int = SEED) -> list[np.ndarray]:
    """Per block of dimensions, unit directions scaled so that a filter is a unit vector."""
    random = np.random.default_rng(seed)
    parts = [len(p) for p in np.array_split(np.arange(dimensions), min(blocks, dimensions))]
    out = []
    for size in parts:
        v = random.standard_normal((codes, size))
        out.append(v / np.linalg.norm(v, axis=1, keepdims=True) / np.sqrt(len(parts)))
    return out


def decoded(vectors: np.ndarray, book: list[np.ndarray], cap: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for every filter whose inner product with a unit vector exceeds the cap; at least `least` each."""
    ends = np.cumsum([c.shape[1] for c in book])
    scores = [vectors[:, e - c.shape[1] : e] @ c.T for c, e in zip(book, ends, strict=True)]
    half = max(1, len(book) // 2)

    def sums(parts: list[np.ndarray]) -> np.ndarray:
        total = np.zeros((len(vectors), 1))
        for s in parts:
            total = (total[:, :, None] + s[:, None, :]).reshape(len(vectors), -1)
        return total

    front, back = sums(scores[:half]), sums(scores[half:])
    width = back.shape[1]
    rows, filters = [], []
    for i in range(len(vectors)):
        b_order = np.argsort(-back[i], kind="stable")
        b = back[i][b_order]
        f_order = np.argsort(-front[i], kind="stable")
        f = front[i][f_order]
        # the greatest sums lie in a staircase of both orders, so `least` of each are enough for the nearest
        k = min(least, len(f)), min(least, len(b))
        nearest = np.sort((f[: k[0], None] + b[None, : k[1]]).ravel())
        bound = min(cap, nearest[-min(least, len(nearest))])
        n_front = int(np.searchsorted(-f, -(bound - b[0]), side="right"))
        n_back = np.searchsorted(-b, -(bound - f[:n_front]), side="right")
        at_f = np.repeat(np.arange(n_front), n_back)
        at_b = np.arange(len(at_f)) - np.repeat(np.cumsum(n_back) - n_back, n_back)
        rows.append(np.full(len(at_f), i))
        filters.append(f_order[at_f].astype(np.int64) * width + b_order[at_b])
    return np.concatenate(rows), np.concatenate(filters)


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows of a list column and their unit vectors in double precision; all rows have the same length."""
    values = [None if v is None or any(x is None for x in v) else np.array(v, np.float64) for v in column.to_pylist()]
    good = [i for i, v in enumerate(values) if v is not None and len(v) and np.isfinite(v).all() and v.any()]
    if not good:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    table = np.stack([values[i] / np.abs(values[i]).max() for i in good])
    return np.array(good), table / np.linalg.norm(table, axis=1, keepdims=True)


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    cap: float = CAP,
    least: int = LEAST,
    blocks: int = BLOCKS,
    codes: int = CODES,
    chunk: int = CHUNK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows link when labels are equal and not null and their cosine reaches the bound.  Vectors that
    are null, empty, zero, or hold null or non-finite components link with nothing, nor do
    vectors of different lengths.  A repeated id is one vector per row: rows count apart, and
    component and kept go by id.  Rows without id get component null and kept false unless
    linked.  Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    usable = F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    keyed = stored(own.select("vec_id", F.when(usable, F.sha2(F.to_json(F.struct("label", F.transform("vector", lambda x: x + 0.0).alias("vector"))), 256)).alias("class"), "vector", "label"), "vectors")
    classes = stored(
        keyed.filter("class is not null").groupBy("class").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("vector").alias("vector"), F.first("label").alias("label")), "classes"
    ).withColumn("node", F.xxhash64("class"))

    def caps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            for size in np.unique(lengths).tolist():
                pick = np.flatnonzero(lengths == size)
                for a in range(0, len(pick), 500):
                    part = pick[a : a + 500]
                    _, units = unit_rows(batch.column(1).take(pa.array(part)))
                    book = books.setdefault(size, code(size, blocks, codes))
                    row, f = decoded(units, book, cap, least)
                    at = pa.array(part[row])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(np.full(len(row), size, np.int32)), pa.array(f)], ["node", "label", "size", "filter"])

    hits = stored(
        classes.select("node", "vector", F.col("label").cast("string").alias("label")).mapInArrow(caps, "node long, label string, size int, filter long"), "caps"
    )
    cells = hits.groupBy("label", "size", "filter").agg(F.count("*").alias("m")).filter("m > 1").withColumn("parts", F.ceil(F.col("m") / chunk).cast("int")).drop("m")
    # a full cell is cut into parts, and every two parts meet in a task of their own
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    met = (
        hits.join(cells, ["label", "size", "filter"])
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("node", F.xxhash64("label", "size", "filter", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), "part", "size")
    )
    rows = met.join(classes.select("node", "vector"), "node").repartition("cell").sortWithinPartitions("cell", "part", "node").select("cell", "part", "size", "node", "vector")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(group: list[tuple]) -> tuple[list, list]:
            units = np.stack([np.array(g[4]) for g in group])
            units /= np.abs(units).max(axis=1, keepdims=True)
            units /= np.linalg.norm(units, axis=1, keepdims=True)
            nodes, parts = np.array([g[3] for g in group]), np.array([g[1] for g in group])
            i, j = np.nonzero(np.triu(units @ units.T >= cosine - _EDGE, 1))
            use = (parts[i] != parts[j]) | (parts.min() == parts.max())
            i, j = i[use], j[use]
            good = exact(np.stack([np.array(group[k][4]) for k in i]), np.stack([np.array(group[k][4]) for k in j])) >= cosine if len(i) else np.zeros(0, bool)
            return np.minimum(nodes[i], nodes[j])[good].tolist(), np.maximum(nodes[i], nodes[j])[good].tolist()

        group: list[tuple] = []
        for batch in batches:
            a: list = []
            b: list = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[0] != group[0][0]:
                    x, y = pairs(group) if len(group) > 1 else ([], [])
                    a, b, group = a + x, b + y, []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if len(group) > 1:
            a, b = pairs(group)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = stored(rows.mapInArrow(compared, "a long, b long").distinct(), "links")
    sizes = classes.select("node", "n")
    both = links.union(links.select("b", "a")).toDF("node", "other")
    degree = both.join(sizes.withColumnsRenamed({"node": "other"}), "other").groupBy("node").agg(F.sum("n").alias("linked"))
    label = components(links)
    grouped = classes.select("class", "node", "first", "n").join(label, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    found = grouped.join(smallest, "component").select("class", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = keyed.select("vec_id", "class").join(found, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision; powers of two bring components of any size into range."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    dot = (a * b).sum(axis=1)
    return dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
