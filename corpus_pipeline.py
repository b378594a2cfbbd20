"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next.

Quality comes first because it is one pass without a shuffle; exact copies go before near copies,
so that the near-duplicate join meets each text once; what is left is cleared of benchmark passages
and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.llm import decontaminate, gam, naming, near, packing, rows


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on the labelled rows, scores 0.3 or more. Null and
    empty texts are scored like others, repeated rows each; all columns pass through, whatever their
    names; an empty table stays empty."""
    model = gam.train(docs, rows.table(spark, sf_dir, "labels"))
    return docs.filter(gam.quality(model, docs) >= 0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white-space runs aside) the row with the smallest id: null ids come last, a null
    text equals an empty one, and of rows that share the id too, one stays. Columns pass through,
    whatever their names; an empty table stays empty."""
    return rows.keep_rows(docs, naming.exact_duplicates(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked at 0.8 of their five-word runs, the row with the smallest id: null ids
    come last, and of repeated rows one stays. Texts without words, null ones included, all stay.
    Columns pass through, whatever their names; an empty table stays empty."""
    return rows.keep_rows(docs, near.near_duplicates(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item. Null and empty texts have none and
    stay, as do repeated rows, each. Columns pass through, whatever their names; an empty table stays
    empty, an empty benchmark drops nothing."""
    found = decontaminate.contamination(docs, rows.table(spark, sf_dir, "benchmark"))
    return rows.keep_rows(docs, found.select("doc_id", "text_hash", (F.col("n_hit") == 0).alias("kept")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of at most 4096 tokens. A null or empty text is its
    end token alone; repeated rows are documents of their own; columns of the given table are not
    read but id and text; an empty table gives no rows."""
    return packing.pack(docs).drop("text_hash")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage but the last is landed and reread."""
    docs = rows.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = rows.land(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
