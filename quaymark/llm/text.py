"""Byte-level text kernels (numpy on Arrow buffers) and small Spark helpers shared by the operators."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.session import checkpoint_folder

#: Bytes and rows of one Arrow batch: bounds a Python worker's memory whatever the partition size.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 4000

_RNG = np.random.default_rng(20240101)
_TABLE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words end at space and the control characters 9 to 13.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Words of letters, digits and all that isn't ASCII (after lower-casing).
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes and rows (runtime settings)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = (out[0], out[1])
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """64-bit hashes of any ranges of one array, position-independent.

    Takes bytes, or values that are hashes already.
    """

    def __init__(self, data: np.ndarray):
        power, self.inverse = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_TABLE[data] if data.dtype == np.uint8 else data) * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mixed(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of every word; no word crosses documents."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~separators[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][np.diff(offsets) > 0]
    starts[first] = inside[first]
    last = first[1:] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def runs_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged rows: the row and the position within the row of every element."""
    lengths = np.asarray(lengths, np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def take(batch: pa.RecordBatch, names: list[str], rows: np.ndarray) -> list[pa.Array]:
    at = pa.array(rows)
    return [batch.column(batch.schema.get_field_index(n)).take(at) for n in names]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote, once everything that reads them is stored itself."""
    for table in tables:
        spark = table.sparkSession
        root = checkpoint_folder(spark).rstrip("/") + "/"
        folder = os.path.dirname(next(iter(table.inputFiles()), ""))
        at = folder.find(root.split(":", 1)[-1].lstrip("/"))  # a file's name may spell the scheme differently
        if at >= 0:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def set_aside(docs: DataFrame, names: set[str]) -> tuple[DataFrame, list[F.Column]]:
    """docs with columns of these names renamed, and what selects the original columns afterwards."""
    new = {c: f"__own_{c}" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(new), [F.col(f"`{new.get(c, c)}`").alias(c) for c in docs.columns]


#: Characters of a text that rows of one id are ordered by, before the text's checksum.
HEAD = 256


def copies_numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Columns doc_id, text and copy (whole: all columns and __copy) that make (id, copy) a key of rows.

    copy is 0, or the number among rows that share an id, ordered by the text's first `HEAD`
    characters and then by its checksum.  Ids are unique in sound tables, and then no text is
    shuffled.  Null ids count as one repeated id.  Rows are numbered in blocks of a range
    partitioning that cuts groups anywhere, equal rows too, so no task takes a whole group.
    """
    ident = F.col(id_col).cast("long")
    repeated = docs.groupBy(ident.alias("i")).count().filter("count > 1").limit(1).count()
    columns = [F.col(f"`{c}`") for c in docs.columns] if whole else [ident.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    name = "__copy" if whole else "copy"
    if not repeated:
        return docs.select(*columns, F.lit(0).cast("long").alias(name))
    order = ["__head", "__sum", "__row"]
    rows = docs if whole else docs.select(id_col, text_col)
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")  # from here on a row keeps its number
    keys = rows.select(ident.alias("__i"), F.substring(text_col, 1, HEAD).alias("__head"), F.xxhash64(text_col).alias("__sum"), "__row")
    keys = stored(keys.repartitionByRange("__i", *order).withColumn("__part", F.spark_partition_id()), "ordered")
    before = Window.partitionBy("__i").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = keys.groupBy("__i", "__part").agg(F.count("*").alias("n")).select(F.col("__i").alias("__bi"), F.col("__part").alias("__bp"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    placed = keys.withColumn("__place", F.row_number().over(Window.partitionBy("__i", "__part").orderBy(*order)) - 1)
    numbers = placed.join(blocks, placed["__i"].eqNullSafe(blocks["__bi"]) & (placed["__part"] == blocks["__bp"]))
    out = rows.join(numbers.select("__row", (F.col("__before") + F.col("__place")).alias("__copy")), "__row")
    return stored(out.select(*columns, F.col("__copy").alias(name)), "numbered")
