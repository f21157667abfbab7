"""Sharding by longest processing time first: large groups go to the least loaded shard in turn.

Documents with equal texts form a group that stays together. Groups above 1/``GRAIN`` of all bytes
are items of their own; there can be at most ``GRAIN`` of them, whatever the table. All smaller
groups fall by their digest into ``GRAIN`` bundles. So the list that is sorted by size and dealt out
through a heap has at most 2 * ``GRAIN`` rows at every scale; it is all that reaches the driver, and
what comes back (item -> shard) is all that is broadcast. No shard differs from another by more than
one item, and a bundle has about 1/``GRAIN`` of the bytes.

Places within a shard are gapless. A shard is numbered in sub-blocks by a hash of the row, with
running offsets, so neither a shard nor a hot group is ordered in one task.

Defined cases: null texts are one group, without bytes; equal rows get different places; an empty
table gives an empty result; more shards than groups leave shards empty. The result carries its own
columns only.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.session import stored

#: Parts of the whole: groups larger than 1/GRAIN of all bytes are dealt one by one.
GRAIN = 10_240
#: Bytes that a document costs besides its text.
OVERHEAD = 16
#: Sub-blocks in which a shard is numbered.
BLOCKS = 256


def longest_first(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Item -> shard: by size, largest first, each to the least loaded shard."""
    loads = [(0, shard) for shard in range(shards)]
    placed = {}
    for name, size in sorted(items, key=lambda item: (-item[1], item[0])):
        load, shard = heapq.heappop(loads)
        placed[name] = shard
        heapq.heappush(loads, (load + size, shard))
    return placed


def _utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    spark = docs.sparkSession
    body = _utf8(F.col("text"))
    rows = stored(docs.select(
        "doc_id",
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.md5(body)).alias("group"),
    ), "shard-rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("group"), F.lit(GRAIN)).cast("string"))
    large = groups.where(F.col("bytes") * GRAIN > total)
    small = groups.where(F.col("bytes") * GRAIN <= total)
    items = (
        large.select(F.col("group").alias("item"), "bytes")
        .unionByName(small.groupBy(bundle.alias("item")).agg(F.sum("bytes").alias("bytes")))
    )
    placed = longest_first([(r["item"], r["bytes"]) for r in items.collect()], shards)
    plan = F.broadcast(spark.createDataFrame(list(placed.items()), "item string, shard int"))

    # A group is dealt by itself exactly if the plan names it; else its bundle is.
    own = rows.join(plan.select(F.col("item").alias("group"), F.col("shard").alias("_own")), "group", "left")
    put = (
        own.withColumn("item", bundle)
        .join(plan.withColumnRenamed("shard", "_bundle"), "item", "left")
        .withColumn("shard", F.coalesce("_own", "_bundle"))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "group"), F.lit(BLOCKS)).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "block")
    )
    counts = put.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(  # at most shards * BLOCKS rows
        counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    return put.join(offsets, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.row_number().over(within) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
