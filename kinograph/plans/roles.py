"""Roles the given tables play: each as a DataFrame and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def titles(spark: SparkSession, d: str) -> DataFrame:
    stats = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("n"), F.avg("l_quantity").alias("q"))
    s = F.col("p_size")
    voted = s > 1
    return (
        table(spark, d, "part")
        .join(stats, F.col("p_partkey") == F.col("l_partkey"), "left")
        .select(
            F.col("p_partkey").alias("item_id"),
            F.concat(F.lit("tt"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("imdb_id"),
            F.when(s > 10, F.col("p_partkey") + 100000).alias("tmdb_id"),
            F.when(s > 20, F.col("p_partkey") + 200000).alias("movielens_id"),
            F.when(F.col("p_type") == "PROMO", "tv").otherwise("movie").alias("kind"),
            F.col("p_name").alias("title"),
            F.when(s % 2 == 0, F.concat("p_name", F.lit(" "), F.lower("p_brand")))
            .otherwise(F.col("p_name")).alias("original_title"),
            F.when(s != 2, s + 1975).alias("year"),
            F.when(s != 3, s * 2 + 60).alias("runtime"),
            F.array(F.lower("p_type")).alias("genres"),
            F.when(s == 4, "xx").otherwise(F.col("p_brand")).alias("language"),
            F.when(voted, F.col("q") / 5).alias("imdb_rating"),
            F.when(voted, F.col("n") * 100).alias("imdb_votes"),
            F.when(s <= 25, s / 10.0 + 4).cast("double").alias("tmdb_rating"),
            F.when(s <= 25, s * 20).alias("tmdb_votes"),
            F.when(s > 5, F.split("p_name", " ")).otherwise(F.array().cast("array<string>")).alias("keywords"),
            F.array("p_brand", "p_type").alias("directors"),
            F.array("p_type", "p_brand", "p_name").alias("cast_names"),
            F.when(s > 7, F.concat(F.lit("A "), "p_name", F.lit(" made by "), "p_brand")).alias("overview"),
            F.when(s > 40, F.concat("p_name", F.lit("."))).alias("tagline"),
            F.when(s > 12, F.concat(F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".jpg"))).alias("poster_path"),
            F.when(s > 15, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).alias("enriched_at"),
            F.when(s > 30, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("keywords_at"),
            F.coalesce(F.when(voted, F.col("q") / 50), F.lit(0.5)).alias("quality"),
        )
    )


TITLES = """
part_stats AS (SELECT l_partkey, count(*) AS n, avg(l_quantity) AS q FROM lineitem GROUP BY 1),
titles AS (
  SELECT p_partkey AS item_id, 'tt' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS imdb_id,
    CASE WHEN p_size > 10 THEN p_partkey + 100000 END AS tmdb_id,
    CASE WHEN p_size > 20 THEN p_partkey + 200000 END AS movielens_id,
    CASE WHEN p_type = 'PROMO' THEN 'tv' ELSE 'movie' END AS kind,
    p_name AS title,
    CASE WHEN p_size % 2 = 0 THEN p_name || ' ' || lower(p_brand) ELSE p_name END AS original_title,
    CASE WHEN p_size <> 2 THEN p_size + 1975 END AS year,
    CASE WHEN p_size <> 3 THEN p_size * 2 + 60 END AS runtime,
    [lower(p_type)] AS genres,
    CASE WHEN p_size = 4 THEN 'xx' ELSE p_brand END AS language,
    CASE WHEN p_size > 1 THEN q / 5 END AS imdb_rating,
    CASE WHEN p_size > 1 THEN n * 100 END AS imdb_votes,
    CAST(CASE WHEN p_size <= 25 THEN p_size / 10.0 + 4 END AS DOUBLE) AS tmdb_rating,
    CASE WHEN p_size <= 25 THEN p_size * 20 END AS tmdb_votes,
    CASE WHEN p_size > 5 THEN string_split(p_name, ' ') ELSE CAST([] AS VARCHAR[]) END AS keywords,
    [p_brand, p_type] AS directors,
    [p_type, p_brand, p_name] AS cast_names,
    CASE WHEN p_size > 7 THEN 'A ' || p_name || ' made by ' || p_brand END AS overview,
    CASE WHEN p_size > 40 THEN p_name || '.' END AS tagline,
    CASE WHEN p_size > 12 THEN '/p' || p_partkey || '.jpg' END AS poster_path,
    CASE WHEN p_size > 15 THEN TIMESTAMP '2024-01-10 00:00:00' END AS enriched_at,
    CASE WHEN p_size > 30 THEN TIMESTAMP '2024-01-15 00:00:00' END AS keywords_at,
    coalesce(CASE WHEN p_size > 1 THEN q / 50 END, 0.5) AS quality
  FROM part LEFT JOIN part_stats ON p_partkey = l_partkey)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = (
        F.when(F.col("event_type") == "purchase", "rate").when(F.col("event_type") == "click", "seen")
        .when(F.col("event_type") == "error", "dismiss").when(F.col("event_type") == "view", "watchlist")
        .otherwise("unseen")
    )
    rating = F.least(F.col("value") / 25, F.lit(10.0))
    verdict = (F.when(F.col("value") >= 125, "love").when(F.col("value") >= 50, "like")
               .when(F.col("value") >= 10, "ok").otherwise("dislike"))
    slate = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
    context = (
        F.when((kind == "rate") & (F.col("value") > 15),
               F.concat(F.lit('{"verdict":"'), verdict, F.lit('","slate_id":"'), slate, F.lit('"}')))
        .when(kind == "rate", F.concat(F.lit('{"verdict":"'), verdict, F.lit('"}')))
        .when((kind == "watchlist") & (F.col("event_id") % 2 == 0), F.lit('{"active":true}'))
        .when(kind == "watchlist", F.lit('{"active":false}'))
        .otherwise(F.lit("{}"))
    )
    source = F.when(F.col("value") > 15, "web").when(F.col("value") > 5, "import").otherwise("rec")
    return e.select(
        "event_id", "user_id", "ts",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        kind.alias("kind"),
        F.when(kind == "rate", rating).alias("value"),
        source.alias("source"),
        context.alias("context"),
    )


EVENTS = """
ev0 AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'rate' WHEN 'click' THEN 'seen' WHEN 'error' THEN 'dismiss'
    WHEN 'view' THEN 'watchlist' ELSE 'unseen' END AS kind0,
  CASE WHEN value >= 125 THEN 'love' WHEN value >= 50 THEN 'like' WHEN value >= 10 THEN 'ok' ELSE 'dislike' END AS word
  FROM events),
log AS (SELECT event_id, user_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, kind0 AS kind,
  CASE WHEN kind0 = 'rate' THEN least(value / 25, 10.0) END AS value,
  CASE WHEN value > 15 THEN 'web' WHEN value > 5 THEN 'import' ELSE 'rec' END AS source,
  CASE WHEN kind0 = 'rate' AND value > 15 THEN '{"verdict":"' || word || '","slate_id":"' || user_id || '-' || strftime(ts, '%Y-%m-%d') || '"}'
    WHEN kind0 = 'rate' THEN '{"verdict":"' || word || '"}'
    WHEN kind0 = 'watchlist' AND event_id % 2 = 0 THEN '{"active":true}'
    WHEN kind0 = 'watchlist' THEN '{"active":false}' ELSE '{}' END AS context
  FROM ev0)"""


def impressions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    slate = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
    w = Window.partitionBy("slate_id").orderBy("ts", "impression_id")
    return (
        table(spark, d, "events").filter(F.col("event_type") == "view")
        .select(F.col("event_id").alias("impression_id"), "user_id", "ts",
                F.get_json_object("props", "$.k").cast("long").alias("item_id"),
                slate.alias("slate_id"), F.col("value").alias("score"),
                (1 / (1 + F.col("value"))).alias("propensity"),
                (F.col("value") < 5).alias("explored"))
        .withColumn("position", F.row_number().over(w) - 1)
        .withColumn("policy", F.lit("thompson:both"))
    )


IMPRESSIONS = """
impressions AS (SELECT event_id AS impression_id, user_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
  user_id || '-' || strftime(ts, '%Y-%m-%d') AS slate_id, value AS score, 1 / (1 + value) AS propensity, value < 5 AS explored,
  row_number() OVER (PARTITION BY user_id || '-' || strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) - 1 AS position,
  'thompson:both' AS policy
  FROM events WHERE event_type = 'view')"""


def rating_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every rating, repeats included."""
    line = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    return line.join(
        table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("movie_id"),
        (F.lit(0.5) + 0.5 * F.floor((F.col("l_quantity") - 1) / 5)).alias("rating"),
        F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber")


def ratings(spark: SparkSession, d: str) -> DataFrame:
    return (
        rating_lines(spark, d).groupBy("user_id", "movie_id")
        .agg(F.max_by("rating", F.struct("ts", "l_orderkey", "l_linenumber")).alias("rating"),
             F.max("ts").alias("ts"))
    )


RATINGS = """
ratings AS (SELECT user_id, movie_id, rating, ts FROM (
  SELECT o_custkey AS user_id, l_partkey AS movie_id, 0.5 + 0.5 * floor((l_quantity - 1) / 5) AS rating, l_shipdate AS ts,
    row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1)"""


def space(spark: SparkSession, d: str) -> DataFrame:
    """Fused item space: one unit vector per item."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))


SPACE = """
space AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"""


def text_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("overview"), F.col("lang").alias("language"), "source")


TEXT = """
text_items AS (SELECT doc_id AS item_id, text AS overview, lang AS language, source FROM documents)"""

PARTS = {"titles": TITLES, "log": EVENTS, "impressions": IMPRESSIONS, "ratings": RATINGS, "space": SPACE, "text": TEXT}


def sql(body: str, *roles: str) -> str:
    """SQL for the check: the named roles as leading common tables, then ``body``.

    A body that brings its own common tables starts with ``WITH``.
    """
    ctes = ",".join(PARTS[r] for r in roles)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


FLOORS_SQL = "floors AS (SELECT p_brand AS language, CAST(1500 + 50 * length(p_brand) + 40 * CAST(substr(p_brand, 7) AS INTEGER) AS INTEGER) AS floor FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1)"


def floors(spark: SparkSession, d: str) -> DataFrame:
    """Vote floor per language; one language is left out so the default applies."""
    return (
        table(spark, d, "part").filter(F.col("p_brand") != "Brand#1")
        .groupBy(F.col("p_brand").alias("language")).agg(F.lit(1).alias("_"))
        .select("language", (F.lit(1500) + 50 * F.length("language")
                             + 40 * F.expr("try_cast(substr(language, 7) AS int)")).alias("floor"))
    )
