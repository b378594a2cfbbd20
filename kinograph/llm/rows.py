"""Helpers shared by the operators of this package."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinograph.session import landed, with_small

#: Words of the near-duplicate and n-gram operators: bytes.split() cuts at exactly these.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def land(df: DataFrame, name: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: a lineage cut that keeps column pruning."""
    return landed(df, f"llm-{name}")


def utf8(column: pa.Array) -> list:
    """The UTF-8 bytes of a string column, None for null, without decoding."""
    return column.cast(pa.binary()).to_pylist()


#: Bytes of a batch of texts on its way to a Python worker.
BATCH_BYTES = 8 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes a batch, so that a worker's memory does not grow with the
    length of texts; a lower limit of the session's own stays."""
    if int(spark.conf.get(_ARROW_BYTES).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(_ARROW_BYTES, str(BATCH_BYTES))


_CACHE: dict = {}


def worker_cache(owner, make):
    """What an operator remembers between the tasks of a Python worker. A worker holds one such
    cache: when the next operator asks, the last one's is dropped, so caches never add up."""
    if owner not in _CACHE:
        _CACHE.clear()
        _CACHE[owner] = make()
    return _CACHE[owner]


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads, under names of its own, plus ``text_hash``: with it a
    verdict finds its row again even where ids are null or used twice."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))


#: Rows up to which a table of keys is broadcast; beyond it both sides are shuffled.
SMALL = 500_000


def keep_rows(docs: DataFrame, report: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``report`` (doc_id, text_hash, kept) keeps, with all their columns.

    Rows equal in id and text share a key. Where the report keeps fewer of them than there are,
    that many stay; only such rows are numbered. Names of the operator's own are not taken from ``docs``.
    """
    hashed, named, number_name = (_free(docs, c) for c in ("hash", "key", "number"))
    key = land(report.groupBy("doc_id", "text_hash").agg(
        F.sum(F.col("kept").cast("long")).alias("__keep"), F.count(F.lit(1)).alias("__rows")).filter("__keep > 0").select(
        F.xxhash64("doc_id", "text_hash").alias(named), F.col("text_hash").alias(hashed),
        F.col("__keep").alias(_free(docs, "keep")), F.col("__rows").alias(_free(docs, "rows"))), "kept")
    on, keep, total = [named, hashed], F.col(_free(docs, "keep")), F.col(_free(docs, "rows"))
    given = docs.withColumn(hashed, F.xxhash64(text)).withColumn(named, F.xxhash64(F.col(id), F.col(hashed)))
    whole = given.join(with_small(key.filter(keep == total).select(on), SMALL), on, "left_semi")
    part = key.filter(keep < total)
    if not part.isEmpty():
        number = F.row_number().over(Window.partitionBy(on).orderBy(F.lit(1)))
        whole = whole.unionByName(given.join(part, on).withColumn(number_name, number).filter(F.col(number_name) <= keep).select(whole.columns))
    return whole.select(docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return name
