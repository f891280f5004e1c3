"""Sharding by longest processing time first.

Groups of equal texts stay together. Sorted by size they go to the least loaded shard, which a heap names.
The heap sees a bounded number of items at any corpus size: groups of at least 1 / (16 x HEAVY) of all bytes
one by one, and the others in bundles that a hash of their text forms. Sizes are summed before any shuffle.

Null text counts as the empty one and forms one group with it. Slots are gapless within a shard, by blocks of
rows; rows that are repeated get a slot each.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from reelspark.llm.common import prepared, written

# A shard's share of all bytes is cut into so many parts: larger groups are placed alone.
HEAVY = 256
BUNDLES = 4096
SLOTS = 4096


def least_loaded(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Shard of each (name, size): largest first, each to the shard with the least so far."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heap[0]
        placed[name] = s
        heapq.heapreplace(heap, (load + size, s))
    return placed


def shard_by_size(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    whole = F.coalesce("text", F.lit(""))
    base = prepared(docs, text, key).select(
        "doc_id", (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), F.md5(whole).alias("same"))
    base = written(base, "sizes")
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    limit = max(1, total["bytes"] // (shards * HEAVY))
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("same"), F.lit(shards * BUNDLES)).cast("string"))
    groups = base.groupBy("same").agg(F.sum("size").alias("size")).withColumn("item", F.when(F.col("size") >= limit, F.col("same")).otherwise(bundle))
    # At most shards x (HEAVY + BUNDLES) rows.
    items = [(r["item"], r["size"]) for r in groups.groupBy("item").agg(F.sum("size").alias("size")).collect()]
    placed = least_loaded(items, shards)
    heavy = spark.createDataFrame([(k, s) for k, s in placed.items() if k[0] != "b" or len(k) == 32], "same string, alone int")
    light = spark.createDataFrame([(k, s) for k, s in placed.items()], "item string, shard int")
    # Both are of the bounded size above.
    found = (base.withColumn("item", bundle).join(F.broadcast(heavy), "same", "left").join(F.broadcast(light), "item", "left")
             .select("doc_id", "size", "text_crc32", F.coalesce("alone", "shard").alias("shard")))
    blocks = max(1, -(-total["n"] // (shards * SLOTS)))
    found = found.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)))
    counts = found.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("shard", "block", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    return (found.withColumn("at", within).join(starts, ["shard", "block"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at") - 1).alias("slot")))
