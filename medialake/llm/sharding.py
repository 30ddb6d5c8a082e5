"""Contiguous shards of nearly equal bytes, by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running, sliced, whole_text

SHARDS = 40
OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Cuts the rows, in order of doc_id, where the running size passes equal shares of the total.

    Sizes are UTF-8 bytes plus OVERHEAD. Only ids, sizes and checksums move: each slice of the
    id order sums its own rows, and the slices' totals give what stands before each. A row goes
    where its middle byte falls, so shards differ from the target by one row at most. Null texts
    have no bytes; null ids come first; equal rows are ordered by checksum and size and are then
    alike; an empty table gives an empty one. Returns doc_id, size, text_crc32, shard, slot.
    """
    data = whole_text().cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit(1).alias("one"))
    rows = sliced(rows, "doc_id", "text_crc32", "size")
    total = rows.agg(F.sum("size")).first()[0] or 1
    placed = running(rows, ["doc_id", "text_crc32", "size"], {"before": "size", "index": "one"})
    # in decimals, as twice the bytes before a row times the shards can pass 63 bits
    middle = (F.col("before").cast("decimal(38,0)") * 2 + F.col("size")) * shards
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / F.lit(2 * total).cast("decimal(20,0)")).cast("int")))
    first = placed.groupBy("shard").agg(F.min("index").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("index") - F.col("first")).alias("slot"))
