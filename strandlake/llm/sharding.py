"""Sharding over fixed virtual slots [native].

Records hash by key into thousands of slots. Bytes and rows are aggregated for each slot. A slot map, a stored table of
(version, slot, shard), says which shard holds a slot; growing and rebalancing edit the map into a new version and move
whole slots, so rows move only with their slot. Everything is DataFrame operations: the slot statistics are one partial
aggregation, and the map never has more rows than slots.

Defined results: a null key hashes as the empty string; a null text has size 16 and a null checksum; repeated rows
are separate rows of the same slot; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Virtual slots; fixed for the life of a dataset.
SLOTS = 4096
SHARDS = 40
#: Bytes that a record takes besides its text.
OVERHEAD = 16
#: Parts of a slot that are numbered apart.
PARTS = 16
#: Places of a run of equal rows that are listed at once.
PIECE = 1 << 16


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 32 bits of its MD5, so that any engine can recompute it."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(slots)).cast("int")


def initial_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt in turn."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(F.lit(1).alias("version"), slot.alias("slot"), F.pmod(slot, F.lit(shards)).cast("int").alias("shard"))


def add_shard(slot_map: DataFrame) -> DataFrame:
    """The next version, with one more shard.

    Every shard gives up its highest slots beyond the new even share, so rows move only into the new shard, and the
    result depends on the map alone.
    """
    even = F.floor(F.lit(1.0) * F.col("_slots") / (F.col("_shards") + 1))
    totals = slot_map.agg(F.count("*").alias("_slots"), F.countDistinct("shard").alias("_shards"), F.max("shard").alias("_last"))
    ranked = slot_map.withColumn("_rank", F.row_number().over(W.partitionBy("shard").orderBy("slot")))
    stays = F.col("_rank") <= even + (F.col("shard") < F.col("_slots") - even * (F.col("_shards") + 1)).cast("int")
    return ranked.join(F.broadcast(totals)).select(
        (F.col("version") + 1).alias("version"), "slot", F.when(stays, F.col("shard")).otherwise(F.col("_last") + 1).cast("int").alias("shard")
    )


def slot_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot that has rows."""
    return df.groupBy(slot_of(F.col(key), slots).alias("slot")).agg(F.sum(size_of(F.col(text))).alias("bytes"), F.count("*").alias("rows"))


def rebalance(slot_map: DataFrame, stats: DataFrame, slack: float = 0.005) -> DataFrame:
    """The next version, with shards of nearly equal bytes, that moves few slots.

    A shard keeps its slots, largest first, while they fit in the mean and the slack. What doesn't fit is laid end to end,
    largest first, and so is the room of the shards below the mean, on the same scale; a slot goes to the shard whose room
    its middle falls into. Both inputs have a row for each slot at most, so the orders are over thousands of rows whatever the corpus holds.
    """
    sized = slot_map.join(stats.select("slot", "bytes"), "slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    totals = sized.agg((F.sum("bytes") / F.countDistinct("shard")).alias("_mean"))
    held = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.desc("bytes"), "slot"))
    marked = sized.join(F.broadcast(totals)).withColumn("_stays", held <= F.col("_mean") * (1 + slack))
    room = marked.groupBy("shard").agg(F.greatest(F.lit(0.0), F.first("_mean") - F.coalesce(F.sum(F.when(F.col("_stays"), F.col("bytes"))), F.lit(0))).alias("_room"))
    room = room.withColumn("_end", F.sum("_room").over(W.orderBy("shard"))).select(F.col("shard").alias("_to"), (F.col("_end") - F.col("_room")).alias("_begin"), "_end")
    moved = marked.where(~F.col("_stays"))
    scale = moved.agg(F.sum("bytes").alias("_load")).join(room.agg(F.max("_end").alias("_all"))).select((F.col("_all") / F.col("_load")).alias("_scale"))
    middle = F.sum("bytes").over(W.orderBy(F.desc("bytes"), "slot")) - F.col("bytes") / 2
    placed = moved.withColumn("_at", middle).join(F.broadcast(scale)).withColumn("_at", F.col("_at") * F.col("_scale")).join(F.broadcast(room), (F.col("_at") >= F.col("_begin")) & (F.col("_at") < F.col("_end")), "left")
    edits = placed.select("slot", F.coalesce("_to", "shard").alias("_new"))
    edited = slot_map.join(F.broadcast(edits), "slot", "left")
    return edited.select((F.col("version") + 1).alias("version"), "slot", F.coalesce("_new", "shard").cast("int").alias("shard"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Appends a version to the stored map; earlier versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest unless named."""
    stored = spark.read.parquet(path)
    wanted = F.lit(version) if version is not None else stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == wanted).select("version", "slot", "shard")


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def assign(df: DataFrame, slot_map: DataFrame, grown: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Every row with its shard under a map and under the grown map, its slot's bytes, and its place in the shard.

    Places are gapless from 0 in every shard. Rows equal in key, checksum and size are counted first and numbered as one
    run, so no row of a repeated document needs a place in an order of its own. A slot is numbered in PARTS parts, dealt
    by checksum and size: a part follows those before it, by one count for each part of a slot.
    """
    size, crc = size_of(F.col(text)), F.crc32(text)
    rows = df.select(F.col(key).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), slot_of(F.col(key), slots).alias("virtual_slot"))
    counted = rows.groupBy("virtual_slot", "doc_id", "text_crc32", "size").agg(F.count("*").alias("_n"))
    counted = counted.withColumn("_part", F.pmod(F.coalesce("text_crc32", F.lit(0)) + F.col("size"), F.lit(PARTS)).cast("int"))
    parts = counted.groupBy("virtual_slot", "_part").agg(F.sum("_n").alias("_rows"), F.sum(F.col("size") * F.col("_n")).alias("_bytes"))
    before = W.partitionBy("shard").orderBy("virtual_slot", "_part").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        slot_map.select(F.col("slot").alias("virtual_slot"), "shard")
        .join(grown.select(F.col("slot").alias("virtual_slot"), F.col("shard").alias("grown_shard")), "virtual_slot")
        .join(parts, "virtual_slot")
        .withColumn("slot_bytes", F.sum("_bytes").over(W.partitionBy("virtual_slot")))
        .select("virtual_slot", "_part", "shard", "grown_shard", "slot_bytes", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    order = W.partitionBy("virtual_slot", "_part").orderBy("doc_id", "text_crc32", "size")
    run = counted.withColumn("_end", F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    first = F.col("_before") + F.col("_end") - F.col("_n")
    last = F.col("_before") + F.col("_end") - 1
    # A run of equal rows is spelled out in pieces, so that no array grows with it.
    pieces = run.join(placed, ["virtual_slot", "_part"]).select("*", last.alias("_last"), F.explode(F.sequence(first, last, F.lit(PIECE).cast("long"))).alias("_piece"))
    numbered = pieces.withColumn("slot", F.explode(F.sequence(F.col("_piece"), F.least(F.col("_piece") + PIECE - 1, F.col("_last")))))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard", "virtual_slot", "slot_bytes")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored map's first version, and the second, which one more shard has edited."""
    from .common import checkpoint_dir, documents

    path = f"{checkpoint_dir(spark)}/slot_maps/{uuid4().hex}"
    save_map(initial_map(spark), path)
    save_map(add_shard(load_map(spark, path)), path)
    return assign(documents(spark, sf_dir), load_map(spark, path, 1), load_map(spark, path, 2))
