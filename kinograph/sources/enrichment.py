"""Landed API records to catalogue columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims, schemas


def _prose(c: str) -> Column:
    return F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))


def _strings(c: Column) -> Column:
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def _names(c: str) -> Column:
    return _strings(F.transform(F.col(c), lambda x: x["name"]))


def _genres(ids: Column) -> Column:
    return F.array_compact(F.transform(F.coalesce(ids, F.array().cast("array<bigint>")),
                                       lambda g: dims.lookup(dims.GENRE_NAMES, g.cast("int"))))


def _year(*dates: str) -> Column:
    head = F.substring(F.coalesce(*[F.nullif(F.col(d), F.lit("")) for d in dates], F.lit("")), 1, 4)
    return F.when(head.rlike(r"^\d+$"), head.try_cast("int"))


def parse_find(payloads: DataFrame) -> DataFrame:
    """First hit of a lookup by stable id, films before series."""
    p = payloads.withColumn("_p", F.from_json("payload", schemas.FIND))
    movie, tv = F.get("_p.movie_results", F.lit(0)), F.get("_p.tv_results", F.lit(0))
    p = p.withColumn("_h", F.coalesce(movie, tv)).withColumn("kind", F.when(movie.isNotNull(), "movie").when(tv.isNotNull(), "tv"))
    return p.select(
        "imdb_id", F.col("_h").isNotNull().alias("found"), "kind", F.col("_h.id").alias("tmdb_id"),
        _prose("_h.overview").alias("overview"), F.lit(None).cast("string").alias("tagline"),
        F.col("_h.original_language").alias("language"),
        F.coalesce(F.nullif("_h.original_title", F.lit("")), "_h.original_name").alias("original_title"),
        F.col("_h.popularity").alias("popularity"), F.col("_h.vote_average").alias("tmdb_rating"),
        F.col("_h.vote_count").alias("tmdb_votes"), F.col("_h.poster_path").alias("poster_path"),
        _genres(F.col("_h.genre_ids")).alias("genres"), F.array().cast("array<string>").alias("keywords"),
        F.lit(False).alias("keywords_fetched"))


def parse_movie(payloads: DataFrame) -> DataFrame:
    """A film record with keywords appended; the same columns as ``parse_find``."""
    p = payloads.withColumn("_p", F.from_json("payload", schemas.DETAIL))
    return p.select(
        "imdb_id", F.col("_p").isNotNull().alias("found"), F.lit("movie").alias("kind"), F.col("_p.id").alias("tmdb_id"),
        _prose("_p.overview").alias("overview"), _prose("_p.tagline").alias("tagline"),
        F.col("_p.original_language").alias("language"), F.col("_p.original_title").alias("original_title"),
        F.col("_p.popularity").alias("popularity"), F.col("_p.vote_average").alias("tmdb_rating"),
        F.col("_p.vote_count").alias("tmdb_votes"), F.col("_p.poster_path").alias("poster_path"),
        _genres(F.transform(F.col("_p.genres"), lambda g: g["id"])).alias("genres"),
        _names("_p.keywords.keywords").alias("keywords"), F.col("_p.keywords").isNotNull().alias("keywords_fetched"))


def detail_to_row(payloads: DataFrame) -> DataFrame:
    """A full record as catalogue columns; everything best-effort."""
    p = payloads.withColumn("_p", F.from_json("payload", schemas.DETAIL))
    crew = F.coalesce(F.col("_p.credits.crew"), F.array().cast("array<struct<job:string,department:string,name:string>>"))

    def people(rule):
        return F.slice(_strings(F.transform(F.filter(crew, rule), lambda c: c["name"])), 1, 4)

    return p.select(
        "row_id", F.col("_p.external_ids.imdb_id").alias("imdb_id"), F.col("_p.id").alias("tmdb_id"), "kind",
        F.coalesce(F.nullif("_p.title", F.lit("")), "_p.name").alias("title"),
        F.coalesce(F.nullif("_p.original_title", F.lit("")), "_p.original_name").alias("original_title"),
        _year("_p.release_date", "_p.first_air_date").alias("year"),
        F.coalesce(F.nullif("_p.runtime", F.lit(0)), F.get("_p.episode_run_time", F.lit(0))).alias("runtime"),
        _names("_p.genres").alias("genres"), F.col("_p.original_language").alias("language"),
        _strings(F.transform(F.col("_p.spoken_languages"), lambda x: x["iso_639_1"])).alias("languages"),
        _strings(F.transform(F.col("_p.production_countries"), lambda x: x["iso_3166_1"])).alias("countries"),
        F.col("_p.vote_average").alias("tmdb_rating"), F.col("_p.vote_count").alias("tmdb_votes"), F.col("_p.popularity").alias("popularity"),
        people(lambda c: c["job"] == "Director").alias("directors"), people(lambda c: c["department"] == "Writing").alias("writers"),
        _strings(F.transform(F.slice(F.coalesce("_p.credits.cast", F.array().cast("array<struct<name:string>>")), 1, 8),
                             lambda c: c["name"])).alias("cast_names"),
        F.when(F.size(_names("_p.keywords.keywords")) > 0, _names("_p.keywords.keywords"))
        .otherwise(_names("_p.keywords.results")).alias("keywords"),
        _prose("_p.overview").alias("overview"), _prose("_p.tagline").alias("tagline"), F.col("_p.poster_path").alias("poster_path"),
        F.coalesce("_p.adult", F.lit(False)).alias("adult"))
