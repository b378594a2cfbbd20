"""Labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id: str = "doc_id"):
    """Rows no label is learnt from: a fifth, by checksum of the id. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id: str = "doc_id", text: str = "text",
                   balanced: bool = False) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled rows outside the held-out fifth, drawn by
    hash of the id; ``balanced`` draws half from each class. Rows without id, text or label are left
    out; an id with several labels takes the larger, one with several texts the least. The draw's bound
    makes its broadcast safe."""
    given = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull() & ~held_out(id)).groupBy(F.col(id).alias("_id")).agg(
        F.max(F.col(label).cast("int")).alias("_label"))
    order = F.xxhash64("_id", F.lit(label))
    if balanced:
        half = max_rows // 2
        drawn = given.filter("_label = 1").orderBy(order, "_id").limit(half).unionAll(given.filter("_label = 0").orderBy(order, "_id").limit(half))
    else:
        drawn = given.orderBy(order, "_id").limit(max_rows)
    met = docs.filter(F.col(text).isNotNull()).select(F.col(id).alias("_doc"), F.col(text).alias("_text")).join(
        F.broadcast(drawn), F.col("_doc") == F.col("_id")).select(F.col("_doc").alias("doc_id"), F.col("_text").alias("text"), F.col("_label").alias("label"))
    return met.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
