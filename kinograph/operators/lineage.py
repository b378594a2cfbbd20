"""Fingerprints, digests and manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, global_index


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """File sizes and times below ``path``; contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))


def source_stamp(spark: SparkSession, path: str) -> str:
    """One string for a source's current version; ``missing`` when it is not there."""
    try:
        row = source_files(spark, path).agg(
            F.sum("size").alias("s"), F.max("modified").alias("m"), F.count("*").alias("n")).head()
    except AnalysisException:
        return "missing"
    return f"{row['n']}:{row['s']}:{row['m']}" if row["n"] else "missing"


def input_fingerprint(spark: SparkSession, version: int, sources: dict[str, str], settings: dict) -> DataFrame:
    """Hash of a stage's version, sources and settings; equal means the stage can be skipped."""
    parts = [f"version={version}"] + [f"{n}={source_stamp(spark, p)}" for n, p in sorted(sources.items())]
    parts += [f"{k}={json.dumps(v)}" for k, v in sorted(settings.items())]
    return spark.createDataFrame([("\n".join(parts),)], "inputs string").withColumn("fingerprint", F.sha2("inputs", 256))


def content_fingerprint(sources: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """Per source its rows and an order-free checksum of its key columns, stated so that any
    engine with md5 gets the same: what a stage compares when file times do not tell."""
    out = None
    for name, df in sorted(sources.items()):
        h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in keys[name]])), 1, 8), 16, 10).cast("bigint")
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("bigint").alias("checksum")).withColumn("source", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def stage_is_current(recorded: DataFrame, fingerprint: DataFrame) -> DataFrame:
    return fingerprint.join(recorded.select("fingerprint").distinct().withColumn("_r", F.lit(True)), "fingerprint", "left").withColumn(
        "current", F.coalesce("_r", F.lit(False))).drop("_r")


def table_digest(df: DataFrame) -> DataFrame:
    """Order-free digest of a whole table: row count and the sum of row hashes."""
    cols = sorted(df.columns)
    row = F.xxhash64(*[F.col(c) for c in cols]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).alias("_h")).select(
        "rows", F.concat_ws(":", F.col("rows").cast("string"), F.col("_h").cast("string"), F.sha2(F.lit(",".join(cols)), 256)).alias("digest"))


#: Rows, then digests, that one digest of the next level stands for.
BRANCH = 1000


def plain_text(name: str, kind: T.DataType) -> Column:
    """A column as text that any engine writes alike: numbers with a fraction in millionths, times in
    microseconds, lists comma-joined, the rest as JSON; null is a mark of its own."""
    c = F.col(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        text = F.round(c * 1e6).cast("long").cast("string")
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        text = F.array_join(F.transform(c, lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string")), ",")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.unix_micros(c.cast("timestamp")).cast("string")
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        text = F.array_join(c, ",")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("\u2205"))


def content_root(df: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """(rows, root): one digest of a table's content, whatever its files and order of rows.

    Rows in the order of ``key`` (unique) are digested each; runs of ``BRANCH`` digests become one, level
    by level, so no task holds more than a run. An empty table has the digest of nothing.
    """
    columns = columns or df.columns
    text = F.concat_ws("|", *[plain_text(c, df.schema[c].dataType) for c in columns])
    level = global_index(df.select(*key, F.md5(text).alias("_digest")), [F.col(c) for c in key], "_place").select("_place", "_digest")
    rows = level.count()
    n = max(rows, 1)
    while True:
        level = cut(level.groupBy(F.floor(F.col("_place") / BRANCH).cast("long").alias("_run")).agg(F.sort_array(F.collect_list(F.struct("_place", "_digest"))).alias("_all")).select(
            F.col("_run").alias("_place"), F.sha2(F.array_join("_all._digest", ""), 256).alias("_digest")))
        n = -(-n // BRANCH)
        if n == 1:
            break
    if not rows:
        return df.sparkSession.createDataFrame([(0, hashlib.sha256(b"").hexdigest())], "rows long, root string")
    return level.select(F.lit(rows).cast("long").alias("rows"), F.col("_digest").alias("root"))


def space_id(space: DataFrame, vector: str = "vec") -> str:
    """The name of an item space: which items it holds and where they stand. A new fusion of the same
    items has another name, which models, impressions and vectors carry."""
    return "sp-" + content_root(space, ["item_id"], ["item_id", vector]).first()["root"][:16]


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256) of the files below ``path``, read and digested in tasks; one file at a time in
    each."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select(
        F.regexp_extract("path", r"([^/]+/)?[^/]+$", 0).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def root_of(roots: dict[str, str]) -> str:
    """One digest over named digests, in the order of their names."""
    return hashlib.sha256("\n".join(f"{name}={root}" for name, root in sorted(roots.items())).encode()).hexdigest()


def manifest(tables: dict[str, DataFrame], kind: str, payload: dict, created_at: Column, keys: dict[str, list[str]]) -> DataFrame:
    """A provenance record over several tables, one row per table with its content digest."""
    out = None
    for name, df in sorted(tables.items()):
        row = content_root(df, keys[name]).withColumns({"artefact": F.lit(name), "schema": F.lit(df.schema.json())})
        out = row if out is None else out.unionByName(row)
    return out.withColumns({"kind": F.lit(kind), "payload": F.lit(json.dumps(payload, sort_keys=True)), "created_at": created_at}).withColumn(
        "manifest_id", F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.concat_ws("|", "payload", "created_at"), 256), 1, 16)))


def write_manifest(rows: DataFrame, path: str) -> None:
    """Append-only: a manifest is never overwritten."""
    rows.write.mode("append").parquet(path)
