"""Catalogue snapshots: content-addressed Parquet, verified on the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import lineage as L
from ..session import global_index

#: Rows of a file.
SLICE = 100_000
MANIFEST = T.StructType([
    T.StructField("build_id", T.StringType()), T.StructField("schema_version", T.IntegerType()), T.StructField("rows", T.LongType()),
    T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("space_id", T.StringType()),
    T.StructField("contents", T.ArrayType(T.StructType([
        T.StructField("artefact", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("root", T.StringType()), T.StructField("files_sha256", T.StringType())])))])


def _write_slices(df: DataFrame, key: str, path: str) -> None:
    """Files of ``SLICE`` rows in the order of the key, whatever order and partitions the rows come in."""
    placed = global_index(df, [F.col(key)], "_place").withColumn("slice", F.floor(F.col("_place") / SLICE)).drop("_place")
    placed.repartition("slice").sortWithinPartitions("slice", key).write.mode("overwrite").option("compression", "zstd").partitionBy("slice").parquet(path)


def _files_root(spark: SparkSession, path: str) -> str:
    """One digest of the files below a folder: theirs, in order, folded in runs."""
    files = L.file_digests(spark, path).select("sha256", "size")
    return L.content_root(files.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")), ["sha256"]).first()["root"]


def write_snapshot(titles: DataFrame, path: str, version: int = schemas.SCHEMA_VERSION, space: DataFrame | None = None,
                   encodings: DataFrame | None = None) -> DataFrame:
    """Titles, and on wish the item space (item_id, vec) and the raw encodings (item_id, …), with a one-row
    manifest. It holds each table's content digest and the digest of its files; the build id and the space
    id follow from content alone, so equal content has equal names."""
    spark, contents = titles.sparkSession, []
    for name, table in (("titles", titles), ("space", space), ("encodings", encodings)):
        if table is not None:
            _write_slices(table, "item_id", f"{path}/{name}")
            got = L.content_root(spark.read.schema(table.schema).parquet(f"{path}/{name}"), ["item_id"], table.columns).first()
            contents.append((name, got["rows"], got["root"], _files_root(spark, f"{path}/{name}")))
    build = "cat-" + L.root_of({name: root for name, _, root, _ in contents})[:16]
    home = L.space_id(spark.read.schema(space.schema).parquet(f"{path}/space")) if space is not None else None
    row = (build, version, contents[0][1], titles.columns, home, contents)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def check_compatible(manifest: DataFrame, known: list[str] = tuple(schemas.TITLES.names)) -> DataFrame:
    """Why a snapshot cannot be read; NULL when it can."""
    unknown = F.array_except("columns", F.array(*[F.lit(c) for c in known]))
    return manifest.withColumn("refusal", F.when(
        F.col("schema_version").isNull() | (F.col("schema_version") > schemas.SCHEMA_VERSION), "newer schema"
    ).when(F.size(unknown) > 0, F.concat(F.lit("unknown columns: "), F.array_join(F.array_sort(unknown), ", "))
    ).when(~F.array_contains("columns", "imdb_id"), "no stable id"))


def read_snapshot(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """Titles in the current schema, missing columns NULL. Raises on refusal or where any table's files do not
    match their digest."""
    manifest = check_compatible(spark.read.schema(MANIFEST).json(f"{path}/manifest")).select("refusal", "rows", "contents").head()
    if manifest["refusal"]:
        raise ValueError(manifest["refusal"])
    for part in manifest["contents"] if verify else ():
        if _files_root(spark, f"{path}/{part['artefact']}") != part["files_sha256"]:
            raise ValueError(f"snapshot does not match its digest: {part['artefact']}")
    empty = spark.createDataFrame([], schemas.TITLES)
    return empty.unionByName(spark.read.parquet(f"{path}/titles").drop("slice"), allowMissingColumns=True) if manifest["rows"] else empty


def read_artefact(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The item space or the encodings of a verified snapshot."""
    return spark.read.parquet(f"{path}/{name}").drop("slice")
