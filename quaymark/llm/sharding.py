"""Sharding over fixed virtual slots, in DataFrame operations only.

Every record hashes into one of `slots` virtual slots.  Bytes and rows are aggregated per slot,
and a versioned map says which shard holds a slot.  Version 0 deals the slots in turn;
`rebalanced` edits a version into the next: each shard keeps its largest slots up to the mean
and gives up the rest, and what was given up goes, largest first, to the shard that is lightest
then.  Few slots move, and no shard exceeds the mean by more than one small slot.  The map
has as many rows as there are slots, whatever the data, so its fold runs on bounded input.

A record's place in its shard is the place of its slot (a running count over the map) plus its
place among the records of the slot, so no task sorts a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.llm.text import stored

SLOTS, SHARDS = 8192, 40
OVERHEAD = 16
#: Rows equal in id and text that share a virtual slot; more take further slots.
COPIES = 16


def records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every row; the text itself goes no further."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    # a hash of the row's id and content: rows without an id still spread
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def spread(rows: DataFrame, slots: int = SLOTS, copies: int = COPIES) -> DataFrame:
    """The rows of `records`, with rows equal in id and text over one virtual slot per `copies` of them.

    Rows that are repeated no oftener keep the slot of their hash.  The others are dealt by a
    running row number, which is stored first, so that a retried task deals them alike.  AQE
    splits a repeated key that holds much of the table.
    """
    key = ["doc_id", "text_crc32", "size"]
    often = rows.groupBy(*key).count().filter(F.col("count") > copies)
    if not often.limit(1).count():
        return rows
    rows = stored(rows.withColumn("running", F.monotonically_increasing_id()), "records")
    often = rows.groupBy(*key).count().filter(F.col("count") > copies).select(*(F.col(c).alias(f"{c}_2") for c in key), F.ceil(F.col("count") / copies).alias("blocks"))
    same = [rows[c].eqNullSafe(often[f"{c}_2"]) for c in key]
    block = F.pmod(F.xxhash64("running"), F.col("blocks"))
    dealt = F.pmod(F.xxhash64(*key, block), F.lit(slots)).cast("int")
    return rows.join(often, same, "left").select(*key, F.when(F.col("blocks").isNull(), F.col("virtual_slot")).otherwise(dealt).alias("virtual_slot"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 0: slots dealt in turn."""
    at = F.col("id").cast("int")
    return spark.range(slots).select(F.lit(0).alias("version"), at.alias("virtual_slot"), (at % shards).alias("shard"))


def rebalanced(current: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map for the measured slots; growing or shrinking `shards` works the same way."""
    load = current.join(sizes, "virtual_slot", "left").select(
        (F.col("version") + 1).alias("version"), "virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes")
    )
    per_shard = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    ranked = load.withColumn("upto", F.sum("bytes").over(per_shard.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "turn", F.row_number().over(per_shard)
    )
    whole = ranked.agg((F.sum("bytes") / shards).alias("mean"))
    # one row: all slots (a fixed number) with the mean
    folded = (
        ranked.crossJoin(F.broadcast(whole))
        .withColumn("stays", (F.col("shard") < shards) & ((F.col("upto") <= F.col("mean")) | (F.col("turn") == 1) | (F.col("bytes") == 0)))
        .groupBy("version")
        .agg(
            F.collect_list(F.when(F.col("stays"), F.struct("shard", "bytes", "virtual_slot"))).alias("kept"),
            F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct("bytes", "virtual_slot"))), asc=False).alias("moving"),
        )
    )
    zero = F.expr(f"""named_struct(
        'loads', aggregate(kept, array_repeat(cast(0 as bigint), {shards}),
            (a, x) -> concat(slice(a, 1, x.shard), array(a[x.shard] + x.bytes), slice(a, x.shard + 2, {shards}))),
        'placed', cast(array() as array<struct<virtual_slot: int, shard: int>>))""")
    dealt = folded.withColumn("begin", zero).withColumn(
        "done",
        F.expr(f"""aggregate(moving, begin, (a, x) -> named_struct(
            'loads', transform(a.loads, (v, i) -> if(i = array_position(a.loads, array_min(a.loads)) - 1, v + x.bytes, v)),
            'placed', concat(a.placed, array(named_struct('virtual_slot', x.virtual_slot, 'shard', cast(array_position(a.loads, array_min(a.loads)) - 1 as int))))))"""),
    )
    stay = F.expr("transform(kept, x -> named_struct('virtual_slot', x.virtual_slot, 'shard', x.shard))")
    return dealt.select("version", F.explode(F.concat(stay, "done.placed")).alias("s")).select("version", "s.virtual_slot", "s.shard")


def edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """The slots that move between two versions of a map."""
    a = before.select("virtual_slot", F.col("shard").alias("from_shard"))
    b = after.select("version", "virtual_slot", F.col("shard").alias("to_shard"))
    return b.join(a, "virtual_slot").filter("from_shard <> to_shard")


def save_version(slot_map: DataFrame, path: str) -> None:
    """Append a version to a stored map; earlier versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a stored map, the latest by default."""
    table = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    latest = table.agg(F.max("version").alias("version")) if version is None else spark.range(1).select(F.lit(version).alias("version"))
    return table.join(F.broadcast(latest), "version").select("version", "virtual_slot", "shard")


def placed(rows: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """shard and slot (place within the shard, gapless from 0) of every record under a map.

    The map has one row per virtual slot, a fixed number, so broadcasting it is bounded.
    """
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(sizes, "virtual_slot", "left").select(
        "version", "virtual_slot", "shard", F.coalesce(F.sum(F.coalesce("rows", F.lit(0))).over(before), F.lit(0)).alias("first")
    )
    return (
        rows.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), "virtual_slot")
        .withColumn("slot", F.col("first") + F.col("place"))
        .drop("first", "place")
    )


def shard(docs: DataFrame, slots: int = SLOTS, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of nearly equal bytes for all rows.

    Null text has no bytes (size 16, checksum 0).  Null and repeated ids are carried as they
    are; up to 16 rows equal in id and text share a virtual slot, more are spread over further
    ones.  Columns other than id and text are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = spread(records(docs, slots, id_col, text_col), slots)
    sizes = stored(slot_sizes(rows), "slot-sizes")
    slot_map = stored(rebalanced(first_map(spark, slots, shards), sizes, shards), "slot-map")
    return placed(rows, slot_map, sizes)
