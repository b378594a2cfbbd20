"""Bulk dumps: text tables, links and ratings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalar as S
from ..operators import catalogue as C
from ..operators import lineage as L
from ..session import scratch


def read_tsv_dump(spark: SparkSession, path: str, name: str, land: str | None = None) -> DataFrame:
    """Tab-separated, unquoted, ``\\N`` for NULL, every column text. A gzip file is one
    split, so ``land`` rewrites it once as Parquet spread over all tasks."""
    df = spark.read.schema(schemas.dump_schema(name)).csv(
        path, sep="\t", header=True, quote="", escape="", nullValue="\\N", emptyValue="", mode="PERMISSIVE")
    if land is None:
        return df
    df.repartition(spark.sparkContext.defaultParallelism).write.mode("overwrite").parquet(land)
    return spark.read.schema(df.schema).parquet(land)


def optional_source(spark: SparkSession, path: str, name: str, required: bool = False, land: str | None = None) -> DataFrame | None:
    """The dump, or None when an optional one is not there."""
    try:
        return read_tsv_dump(spark, path, name, land)
    except AnalysisException:
        if required:
            raise
        return None


def read_dumps(spark: SparkSession, root: str, land: str | None = None) -> dict[str, DataFrame | None]:
    """All dumps below ``root``. A gzip file is one split, so each is landed once as Parquet spread over all
    tasks, below ``land`` or in the scratch folder, and every join reads that."""
    needed, land = ("title.basics", "title.ratings"), land or scratch(spark, "dumps")
    return {n: optional_source(spark, f"{root}/{n}.tsv.gz", n, n in needed, f"{land}/{n}") for n in schemas.DUMPS}


def build_from_dumps(spark: SparkSession, root: str, min_votes: int = 50) -> DataFrame:
    return C.build_catalogue(read_dumps(spark, root), min_votes)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("movieId string, imdbId string, tmdbId string").csv(path, header=True)
    return raw.select(
        S.padded_id(F.col("imdbId")).alias("imdb_id"), F.col("movieId").try_cast("int").alias("movielens_id"),
        F.col("tmdbId").try_cast("int").alias("tmdb_id"))


def read_ratings(spark: SparkSession, path: str, cache: str) -> DataFrame:
    """Typed ratings through a Parquet copy that is rebuilt when the CSV's fingerprint changes."""
    stamp = L.source_stamp(spark, path)
    names = schemas.RATINGS.names
    try:
        kept = spark.read.text(f"{cache}/stamp").head()
        if kept is not None and kept[0] == stamp:
            return spark.read.schema(schemas.RATINGS).parquet(f"{cache}/ratings")
    except AnalysisException:
        pass
    fresh = spark.read.schema("userId int, movieId int, rating float, timestamp long").csv(path, header=True).select(*names)
    fresh.write.mode("overwrite").parquet(f"{cache}/ratings")
    spark.createDataFrame([(stamp,)], "value string").coalesce(1).write.mode("overwrite").text(f"{cache}/stamp")
    return spark.read.schema(schemas.RATINGS).parquet(f"{cache}/ratings")
