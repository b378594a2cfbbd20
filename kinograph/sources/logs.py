"""Line-oriented logs and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import scalar as S

EXPORT = T.StructType([T.StructField("user_id", T.LongType()), *schemas.EXPORT_LINE.fields])


def write_export(rows: DataFrame, path: str, ordered: bool = False) -> None:
    """One JSON object per line; ordered by time only when one sorted set of files is asked for."""
    rows = rows.orderBy("ts") if ordered else rows
    rows.write.mode("errorifexists").json(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPORT).json(path)


def read_bulk_list(lines: DataFrame, default_verdict: str = "like") -> DataFrame:
    """``title | verdict`` lines, split on the last pipe; blanks and comments skipped."""
    line = F.trim(F.col("value"))
    rows = lines.withColumn("value", line).filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    pattern = r"(?s)^(.*)\|([^|]*)$"
    piped = F.contains(F.col("value"), F.lit("|"))
    return rows.withColumns({
        "title": F.when(piped, F.trim(F.regexp_extract("value", pattern, 1))).otherwise(F.col("value")),
        "verdict": F.when(piped, F.trim(F.regexp_extract("value", pattern, 2))).otherwise(F.lit(default_verdict)),
    }).drop("value")


def read_text_list(spark: SparkSession, path: str, default_verdict: str = "like") -> DataFrame:
    return read_bulk_list(spark.read.text(path), default_verdict)


_THUMB = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("thumbs", T.StringType()),
    T.StructField("movieID", T.LongType()), T.StructField("date", T.StringType()),
    T.StructField("reactionRatings", T.StructType([T.StructField("thumbs", T.StringType())])),
])
_ITEMS = T.StructType([T.StructField("ratingItems", T.ArrayType(_THUMB))])
THUMBS_PAGE = T.StructType([
    T.StructField("jsonGraph", T.StructType([T.StructField("aui", T.StructType([
        T.StructField("ratingHistory", T.StructType([T.StructField("value", _ITEMS)]))]))])),
    *_ITEMS.fields,
])


def parse_export_date(raw):
    """``YY-M-DD`` with two-digit years in the 2000s; anything impossible is NULL."""
    parts = F.split(raw, "-")
    year, month, day = (F.get(parts, i).try_cast("int") for i in range(3))
    full = F.when(year < 100, year + 2000).otherwise(year)
    text = F.format_string("%04d-%02d-%02d", full, month, day)
    return F.when((F.size(parts) == 3) & year.isNotNull() & month.isNotNull() & day.isNotNull() & full.between(1, 9999),
                  text.try_cast("date"))


def parse_thumbs(pages: DataFrame, column: str = "payload", keep: tuple = ()) -> DataFrame:
    """Rating items of landed export pages, in file order; unknown thumbs dropped, empty titles kept."""
    from .. import dims

    page = F.from_json(column, THUMBS_PAGE)
    items = F.coalesce(F.col("_p.jsonGraph.aui.ratingHistory.value.ratingItems"), F.col("_p.ratingItems"))
    rows = pages.withColumn("_p", page).select(*keep, F.posexplode(items).alias("pos", "_i"))
    thumbs = F.coalesce(F.nullif("_i.thumbs", F.lit("")), F.col("_i.reactionRatings.thumbs"))
    return (
        rows.withColumn("thumbs", thumbs).withColumn("verdict", dims.lookup(dims.THUMBS, F.col("thumbs")))
        .filter(F.col("verdict").isNotNull())
        .select(*keep, "pos", F.trim(F.coalesce("_i.title", F.lit(""))).alias("title"), "thumbs", "verdict",
                F.col("_i.movieID").alias("source_id"), parse_export_date(F.coalesce("_i.date", F.lit(""))).alias("rated_on"))
    )


def read_thumbs_export(spark: SparkSession, path: str) -> DataFrame:
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))
    return parse_thumbs(pages, keep=("file",))


JOB_LINE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in (
        "at", "kind", "id", "state", "reason", "folder", "imdb_id", "label", "path", "source", "link", "chat", "msg")],
    T.StructField("item_id", T.LongType()),
    T.StructField("request", T.MapType(T.StringType(), T.StringType())),
    T.StructField("candidate", T.MapType(T.StringType(), T.StringType())),
    T.StructField("candidates", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("film", T.MapType(T.StringType(), T.StringType())),
    T.StructField("chats", T.ArrayType(T.StringType())),
])


def parse_job_lines(raw: DataFrame) -> DataFrame:
    """Job lines of many files (file, line, value). A torn line is skipped; a file whose
    first readable line is not a request is not a job."""
    schema = T.StructType([*JOB_LINE.fields, T.StructField("_bad", T.StringType())])
    lines = raw.withColumn("_j", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"})).filter(
        F.col("_j.kind").isNotNull() & F.col("_j._bad").isNull()).select("file", "line", *[F.col(f"_j.{f}").alias(f) for f in JOB_LINE.names])
    first = lines.groupBy("file").agg(F.min_by(F.struct("kind", "id", "request"), F.col("line")).alias("_f")).filter(
        (F.col("_f.kind") == "request") & F.col("_f.id").isNotNull()).select("file", F.col("_f.id").alias("job_id"))
    return lines.join(first, "file")


def read_job_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines ordered by where they stand in their file, however it was split."""
    return parse_job_lines(spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line"), "value"))
