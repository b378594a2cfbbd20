"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root): the smallest node reachable, for each node that has an edge. Alternates two
    rewirings until nothing changes: a node's larger neighbours move to its smallest neighbour, then
    its smaller ones do. Edges never grow in number, and rounds grow with the logarithm of a chain's
    length. Edges stay in tables; only three numbers a round reach the driver."""
    now = rows.land(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u > v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.select("u", F.col("m").alias("v")).union(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = rows.land(moved.filter("u > v").distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
