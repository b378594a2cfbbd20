"""Byte-balanced shards by Karmarkar-Karp differencing.

Groups of equal texts are indivisible. Groups above a fixed share of all bytes are items of their
own; the others are dealt by hash to a fixed number of bundles. So differencing always works on a
bounded number of items, whatever the input, while the bundles are as fine as the balance needs.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rows

BUNDLES = 8192


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item. Every item begins as a partial partition with one filled part. The
    two partials of largest spread are joined, largest part to smallest, until one is left."""
    heap = []
    for k, size in enumerate(sizes):
        sums = [0] * (shards - 1) + [size]
        heap.append((-size, k, sums, [None] * (shards - 1) + [k]))
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a, pa = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        joined = sorted(((x + y, i) for i, (x, y) in enumerate(zip(a, reversed(b)))))
        low = joined[0][0]
        sums = [s - low for s, _ in joined]  # only differences matter
        parts = [(pa[i], pb[shards - 1 - i]) for _, i in joined]
        count += 1
        heapq.heappush(heap, (-sums[-1], count, sums, parts))
    out = [0] * len(sizes)
    if heap:
        for shard, tree in enumerate(heap[0][3]):
            stack = [tree]
            while stack:
                node = stack.pop()
                if isinstance(node, tuple):
                    stack += node
                elif node is not None:
                    out[node] = shard
    return out


def assign_shards(docs: DataFrame, shards: int = 8, id: str = "doc_id", text: str = "text", bundles: int = BUNDLES) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1; null texts are a group of their own with
    checksum 0. Equal texts share a shard. At most 2 x ``bundles`` items (heavy groups, which hold
    more than 1/``bundles`` of all bytes each, and bundles) pass through the driver; documents,
    groups and links never do. ``slot`` numbers a shard's rows from 0 without gaps. Null and
    repeated ids and extra columns change nothing; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = rows.keyed(docs, id, text).select(
        "doc_id", "text_hash", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("group"))
    base = rows.land(base.withColumn("row", F.monotonically_increasing_id()), "sizes")
    total = base.agg(F.sum("size")).first()[0] or 0
    bundle = F.pmod(F.xxhash64("group"), F.lit(bundles))
    groups = base.groupBy("group").agg(F.sum("size").alias("bytes"))
    heavy = groups.filter(F.col("bytes") * bundles > total)
    items = rows.land(
        heavy.select("group", F.lit(None).cast("long").alias("bundle"), "bytes").unionByName(
            groups.filter(F.col("bytes") * bundles <= total).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes")).select(
                F.lit(None).cast("binary").alias("group"), "bundle", "bytes")), "items")
    held = items.orderBy(F.col("bytes").desc(), "bundle", "group").collect()  # at most 2 x bundles rows
    shard = difference([r["bytes"] for r in held], shards)
    plan = spark.createDataFrame([(bytes(r["group"]) if r["group"] is not None else None, r["bundle"], s) for r, s in zip(held, shard)],
                                 "heavy binary, light long, shard int")
    dealt = base.withColumn("light", bundle).join(
        F.broadcast(plan.filter("heavy is not null").select(F.col("heavy").alias("group"), F.col("shard").alias("_own"))), "group", "left").join(
        F.broadcast(plan.filter("light is not null").select("light", F.col("shard").alias("_with"))), "light", "left").withColumn(
        "shard", F.coalesce("_own", "_with")).withColumn("part", F.shiftright("row", 33))
    dealt = rows.land(dealt.select("doc_id", "text_hash", "size", "text_crc32", "shard", "part", "row"), "dealt")
    # Slots: numbered inside each (input part, shard), after the rows of earlier parts.
    before = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    return dealt.withColumn("slot", inside).join(before, ["shard", "part"]).select(
        "doc_id", "text_hash", "size", "text_crc32", "shard", (F.col("slot") + F.col("before")).cast("long").alias("slot"))


def op1_karmarkar_karp(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes."""
    return assign_shards(rows.table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
