"""Source and sink queries: the given tables go out in a format and come back through the reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import catalogue as C
from ..operators import lineage as L
from ..session import scratch
from ..sources import dumps, enrichment, logs, snapshot
from . import catalogue, roles as R
from .events import micros
from .registry import query
from .roles import sql


def _land_tsv(df, path, **kw):
    df.write.csv(path, sep="\t", header=True, quote="", nullValue="\\N", emptyValue="", compression="gzip", **kw)
    return path


@query("read_tsv_dump", f"""WITH {catalogue.BASICS} SELECT tconst, titleType AS title_type, CASE adult WHEN 1 THEN '1' WHEN 0 THEN '0' END AS is_adult,
  CAST(year AS VARCHAR) AS start_year, CASE WHEN p_size = 11 THEN 'soon' ELSE CAST(runtime AS VARCHAR) END AS runtime, genres FROM basics""")
def _(spark, d):
    path = _land_tsv(catalogue.basics(spark, d), scratch(spark, "basics"))
    back = dumps.read_tsv_dump(spark, path, "title.basics", land=scratch(spark, "landed"))
    return back.select("tconst", F.col("titleType").alias("title_type"), F.col("isAdult").alias("is_adult"), F.col("startYear").alias("start_year"),
                       F.col("runtimeMinutes").alias("runtime"), "genres")


@query("optional_source", f"""WITH {catalogue.BASICS}, {catalogue.DUMP_RATINGS} SELECT tconst AS imdb_id, 0 AS credits, 'xx' AS language
FROM scope JOIN dr USING (tconst) WHERE imdb_votes >= 50""")
def _(spark, d):
    """Only the two required dumps are landed; the rest degrade to empty lists."""
    root = scratch(spark, "dumps")
    _land_tsv(catalogue.basics(spark, d), f"{root}/title.basics.tsv.gz")
    _land_tsv(catalogue.dump_ratings(spark, d), f"{root}/title.ratings.tsv.gz")
    out = dumps.build_from_dumps(spark, root)
    return out.select("imdb_id", (F.size("countries") + F.size("directors") + F.size("cast_names")).alias("credits"), "language")


@query("build_catalogue", f"""WITH {catalogue.BASICS}, {catalogue.DUMP_RATINGS}, pairs AS (SELECT CAST(l_partkey AS VARCHAR) AS tconst, list_slice(list_sort(list(DISTINCT s_name)), 1, 4) AS ds
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
SELECT scope.tconst AS imdb_id, p_name AS title, year, array_to_string(coalesce(ds, CAST([] AS VARCHAR[])), '|') AS directors FROM scope JOIN dr USING (tconst) LEFT JOIN pairs USING (tconst) WHERE imdb_votes >= 50""")
def _(spark, d):
    out = C.build_catalogue({"title.basics": catalogue.basics(spark, d), "title.ratings": catalogue.dump_ratings(spark, d),
                             "title.crew": catalogue.crew_dump(spark, d), "name.basics": catalogue.name_dump(spark, d)})
    return out.select("imdb_id", "title", "year", F.array_join("directors", "|").alias("directors"))


@query("read_links", "SELECT 'tt' || CASE WHEN length(CAST(o_orderkey * 977 AS VARCHAR)) >= 7 THEN CAST(o_orderkey * 977 AS VARCHAR) ELSE lpad(CAST(o_orderkey * 977 AS VARCHAR), 7, '0') END AS imdb_id, CAST(o_custkey AS INTEGER) AS movielens_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS tmdb_id FROM orders", floats=("tmdb_id",))
def _(spark, d):
    path = scratch(spark, "links")
    R.table(spark, d, "orders").select(
        F.col("o_custkey").alias("movieId"), (F.col("o_orderkey") * 977).alias("imdbId"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey").cast("string")).otherwise("n/a").alias("tmdbId")).write.csv(path, header=True)
    return dumps.read_links(spark, path)


@query("read_ratings", sql("SELECT user_id AS \"userId\", movie_id AS \"movieId\", CAST(rating AS DOUBLE) AS rating FROM ratings", "ratings"))
def _(spark, d):
    path, cache = scratch(spark, "ratings"), scratch(spark, "ratings-cache")
    R.ratings(spark, d).select(F.col("user_id").alias("userId"), F.col("movie_id").alias("movieId"), "rating", F.lit(0).alias("timestamp")).write.csv(path, header=True)
    dumps.read_ratings(spark, path, cache)
    return dumps.read_ratings(spark, path, cache).select(F.col("userId").cast("long").alias("userId"), F.col("movieId").cast("long").alias("movieId"), F.col("rating").cast("double").alias("rating"))


def find_payloads(spark, d):
    """Parts as lookup answers: film hits, series hits, or nothing."""
    p, s = R.table(spark, d, "part"), F.col("p_size")
    hit = F.struct(
        F.col("p_partkey").alias("id"), F.when(s > 10, F.concat(F.lit("  about "), "p_name", F.lit(" "))).otherwise(" ").alias("overview"),
        F.lower("p_brand").alias("original_language"), F.when(s % 2 == 0, F.col("p_name")).alias("original_title"), F.col("p_type").alias("original_name"),
        F.col("p_retailprice").alias("vote_average"), s.alias("vote_count"), F.array(F.lit(18), s, F.lit(80)).alias("genre_ids"))
    none = F.array().cast(f"array<{p.select(hit.alias('h')).schema['h'].dataType.simpleString()}>")
    payload = F.to_json(F.struct(F.when(s <= 30, F.array(hit)).otherwise(none).alias("movie_results"), F.when(s.between(20, 40), F.array(hit)).otherwise(none).alias("tv_results")))
    return p.select(F.col("p_partkey").cast("string").alias("imdb_id"), payload.alias("payload"))


@query("parse_find", """SELECT CAST(p_partkey AS VARCHAR) AS imdb_id, p_size <= 40 AS found, CASE WHEN p_size <= 30 THEN 'movie' WHEN p_size <= 40 THEN 'tv' END AS kind,
  CASE WHEN p_size <= 40 AND p_size > 10 THEN 'about ' || p_name END AS overview, CASE WHEN p_size <= 40 THEN CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END END AS original_title,
  CASE WHEN p_size <= 40 THEN p_retailprice END AS tmdb_rating,
  CASE WHEN p_size > 40 THEN '' ELSE 'Drama|' || CASE p_size WHEN 12 THEN 'Adventure|' WHEN 14 THEN 'Fantasy|' WHEN 16 THEN 'Animation|' WHEN 18 THEN 'Drama|' WHEN 27 THEN 'Horror|'
    WHEN 28 THEN 'Action|' WHEN 35 THEN 'Comedy|' WHEN 36 THEN 'History|' WHEN 37 THEN 'Western|' ELSE '' END || 'Crime' END AS genres FROM part""")
def _(spark, d):
    return enrichment.parse_find(find_payloads(spark, d)).select("imdb_id", "found", "kind", "overview", "original_title", "tmdb_rating", F.array_join("genres", "|").alias("genres"))


def detail_payloads(spark, d):
    p, s = R.table(spark, d, "part"), F.col("p_size")
    crew = F.array(*[F.struct(F.lit(j).alias("job"), F.lit(dep).alias("department"), n.alias("name")) for j, dep, n in (
        ("Director", "Directing", F.col("p_brand")), ("Editor", "Editing", F.col("p_name")), ("Writer", "Writing", F.col("p_type")), ("Director", "Directing", F.when(s > 20, F.col("p_type"))))])
    words = F.transform(F.split("p_name", " "), lambda w: F.struct(F.lit(1).alias("id"), w.alias("name")))
    payload = F.to_json(F.struct(
        F.col("p_partkey").alias("id"), F.when(s % 3 > 0, F.col("p_name")).alias("title"), F.col("p_brand").alias("name"), F.concat(F.lit(" "), "p_type").alias("tagline"),
        F.lower("p_brand").alias("original_language"), F.when(s > 5, F.concat((s + 1970).cast("string"), F.lit("-01-02"))).otherwise("soon").alias("release_date"),
        F.when(s > 25, s).otherwise(0).alias("runtime"), F.array(F.lit(42)).alias("episode_run_time"),
        F.array(F.struct(F.lit(18).alias("id"), F.col("p_type").alias("name")), F.struct(F.lit(7).alias("id"), F.lit("Odd").alias("name"))).alias("genres"),
        F.struct(F.when(F.col("p_type") != "PROMO", words).alias("keywords"), words.alias("results")).alias("keywords"),
        F.struct(F.concat(F.lit("tt"), F.col("p_partkey").cast("string")).alias("imdb_id")).alias("external_ids"),
        F.struct(crew.alias("crew"), F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.lit("").alias("name"))).alias("cast")).alias("credits")))
    return p.select(F.col("p_partkey").alias("row_id"), F.col("p_partkey").cast("string").alias("imdb_id"), F.when(F.col("p_type") == "PROMO", "tv").otherwise("movie").alias("kind"), payload.alias("payload"))


@query("detail_to_row", """SELECT p_partkey AS row_id, 'tt' || p_partkey AS imdb_id, CASE WHEN p_size % 3 > 0 THEN p_name ELSE p_brand END AS title, CAST(CASE WHEN p_size > 5 THEN p_size + 1970 END AS DOUBLE) AS year,
  CASE WHEN p_size > 25 THEN p_size ELSE 42 END AS runtime, p_type || '|Odd' AS genres, CASE WHEN p_size > 20 THEN p_brand || '|' || p_type ELSE p_brand END AS directors, p_type AS writers, p_brand AS cast_names,
  replace(p_name, ' ', '|') AS keywords, p_type AS tagline FROM part""")
def _(spark, d):
    out = enrichment.detail_to_row(detail_payloads(spark, d))
    return out.select("row_id", "imdb_id", "title", F.col("year").cast("double").alias("year"), "runtime", *[F.array_join(c, "|").alias(c) for c in ("genres", "directors", "writers", "cast_names", "keywords")], "tagline")


@query("parse_movie", """SELECT CAST(p_partkey AS VARCHAR) AS imdb_id, p_partkey AS tmdb_id, 'Drama' AS genres, p_type AS tagline, CASE WHEN p_type <> 'PROMO' THEN replace(p_name, ' ', '|') ELSE '' END AS keywords, true AS keywords_fetched FROM part""")
def _(spark, d):
    out = enrichment.parse_movie(detail_payloads(spark, d))
    return out.select("imdb_id", "tmdb_id", F.array_join("genres", "|").alias("genres"), "tagline", F.array_join("keywords", "|").alias("keywords"), "keywords_fetched")


@query("read_bulk_list", """WITH l AS (SELECT p_partkey, p_name, p_size, p_brand FROM part)
SELECT p_name || CASE WHEN p_size > 30 THEN ' | part two' ELSE '' END AS title, CASE WHEN p_size > 30 THEN 'hate' WHEN p_size > 15 THEN lower(p_brand) ELSE 'like' END AS verdict FROM l WHERE p_size > 5""")
def _(spark, d):
    path = scratch(spark, "list")
    s = F.col("p_size")
    line = F.when(s <= 2, "").when(s <= 5, F.concat(F.lit("# "), "p_name")).when(s > 30, F.concat(F.lit(" "), "p_name", F.lit(" | part two | hate "))).when(
        s > 15, F.concat("p_name", F.lit("|"), F.lower("p_brand"))).otherwise(F.col("p_name"))
    R.table(spark, d, "part").select(line.alias("value")).write.text(path)
    return logs.read_text_list(spark, path)


def thumbs_pages(spark, d):
    """Each order as one export page; odd orders carry a bare list."""
    q = F.col("l_quantity")
    thumb = F.when(q > 40, "THUMBS_WAY_UP").when(q > 25, "THUMBS_UP").when(q > 10, "THUMBS_DOWN").otherwise("NONE")
    item = F.struct(
        F.concat(F.lit(" t"), F.col("l_partkey").cast("string")).alias("title"), F.when(q % 2 == 0, thumb).alias("thumbs"), F.col("l_suppkey").alias("movieID"),
        F.concat_ws("-", F.date_format("l_shipdate", "yy"), F.month("l_shipdate").cast("string"), F.when(q == 11, F.lit("31")).otherwise(F.dayofmonth("l_shipdate").cast("string"))).alias("date"),
        F.struct(thumb.alias("thumbs")).alias("reactionRatings"))
    pages = R.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("i")))), lambda x: x["i"]).alias("ratingItems"))
    nested = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct("ratingItems").alias("value")).alias("ratingHistory")).alias("aui")).alias("jsonGraph")))
    return pages.select("l_orderkey", F.when(F.col("l_orderkey") % 2 == 0, nested).otherwise(F.to_json(F.struct("ratingItems"))).alias("payload"))


@query("read_thumbs_export", """SELECT 't' || l_partkey AS title, l_suppkey AS source_id, CASE WHEN l_quantity > 40 THEN 'love' WHEN l_quantity > 25 THEN 'like' ELSE 'dislike' END AS verdict,
  CASE WHEN l_quantity = 11 AND month(l_shipdate) IN (2, 4, 6, 9, 11) THEN NULL WHEN l_quantity = 11 THEN strftime(l_shipdate, '20%y-%m-31') ELSE strftime(l_shipdate, '20%y-%m-%d') END AS rated_on FROM lineitem WHERE l_quantity > 10""")
def _(spark, d):
    return logs.parse_thumbs(thumbs_pages(spark, d), keep=("l_orderkey",)).select("title", "source_id", "verdict", F.date_format("rated_on", "yyyy-MM-dd").alias("rated_on"))


def job_lines(spark, d, key="o_custkey"):
    """Each customer's orders as one job's log, torn and headless files included."""
    from pyspark.sql import Window

    o = R.table(spark, d, "orders").select(
        key.alias("job") if not isinstance(key, str) else F.col(key).alias("job"), F.col("o_orderkey"), F.col("o_orderdate").alias("ts"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    n = F.row_number().over(Window.partitionBy("job").orderBy("ts", "o_orderkey"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    first = F.to_json(F.struct(at.alias("at"), F.lit("request").alias("kind"), F.concat(F.lit("job-"), F.col("job").cast("string")).alias("id"), F.create_map(F.lit("title"), F.col("o_orderpriority")).alias("request")))
    p = F.substring("o_orderpriority", 1, 1)
    label = F.concat(F.lit("copy "), F.col("o_orderkey").cast("string"))
    offer = F.to_json(F.struct(at.alias("at"), F.lit("offer").alias("kind"), F.array(F.create_map(F.lit("label"), label)).alias("candidates")))
    line = (
        F.when(F.col("n") == 1, F.when(F.col("job") % 10 == 3, F.lit('{"at":"x","kind":')).otherwise(first))
        .when(p == "1", F.to_json(F.struct(at.alias("at"), F.lit("state").alias("kind"), F.when(F.col("o_orderstatus") == "F", "paused").when(F.col("o_orderstatus") == "O", "downloading").otherwise("failed").alias("state"), F.lit("r").alias("reason"))))
        .when(p == "2", offer)
        .when(p == "3", F.to_json(F.struct(at.alias("at"), F.lit("filed").alias("kind"), F.lit("/x").alias("path"), label.alias("label"), F.lit("s").alias("source"))))
        .when(p == "4", F.to_json(F.struct(at.alias("at"), F.lit("wrong").alias("kind"), label.alias("label"))))
        .otherwise(F.to_json(F.struct(at.alias("at"), F.lit("target").alias("kind"), F.lit("f").alias("folder"), F.lit("tt1").alias("imdb_id"), F.col("o_orderkey").alias("item_id"))))
    )
    return o.withColumn("n", n).withColumn("value", line)


def parsed_jobs(spark, d):
    return logs.parse_job_lines(job_lines(spark, d).select(F.col("job").cast("string").alias("file"), F.col("n").alias("line"), "value"))


def landed_jobs(spark, d):
    """Customers dealt to 25 log files, which grow with the orders."""
    path = scratch(spark, "jobs")
    lines = job_lines(spark, d, F.pmod("o_custkey", F.lit(25))).select("job", "n", "value")
    lines.repartition("job").sortWithinPartitions("job", "n").select("job", "value").write.partitionBy("job").text(path)
    return path


JOBS = """jl AS (SELECT o_custkey AS job, o_orderkey, o_orderstatus, substr(o_orderpriority, 1, 1) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
  jk AS (SELECT *, CASE WHEN n = 1 THEN 'request' WHEN p = '1' THEN 'state' WHEN p = '2' THEN 'offer' WHEN p = '3' THEN 'filed' WHEN p = '4' THEN 'wrong' ELSE 'target' END AS kind FROM jl WHERE job % 10 <> 3)"""


@query("read_job_log", f"WITH {JOBS.replace('o_custkey', '(o_custkey % 25)')} SELECT 'job-' || job AS job_id, kind, count(*) AS n FROM jk GROUP BY 1, 2")
def _(spark, d):
    return logs.read_job_log(spark, landed_jobs(spark, d)).groupBy("job_id", "kind").agg(F.count("*").alias("n"))


def root_sql(table: str, key: str, columns: list[tuple[str, str]]) -> str:
    """Rows and content digest of a table of up to a million rows: rows, runs of a thousand, one."""
    plain = {"text": "CAST({c} AS VARCHAR)", "number": "CAST(CAST(round({c} * 1e6) AS BIGINT) AS VARCHAR)", "time": "CAST(epoch_us({c}) AS VARCHAR)",
             "words": "array_to_string({c}, ',')", "numbers": "array_to_string(list_transform({c}, lambda x: CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT)), ',')"}
    text = ", ".join(f"coalesce({plain[kind].format(c=c)}, '\u2205')" for c, kind in columns)
    return f"""(SELECT max(n) AS rows, CASE WHEN count(*) = 1 THEN max(run) ELSE sha256(string_agg(run, '' ORDER BY g)) END AS root FROM (
      SELECT g, sha256(string_agg(h, '' ORDER BY p)) AS run, any_value(n) AS n FROM (
        SELECT (row_number() OVER (ORDER BY {key}) - 1) // 1000 AS g, row_number() OVER (ORDER BY {key}) AS p, count(*) OVER () AS n, md5(concat_ws('|', {text})) AS h FROM {table}) GROUP BY g))"""


TITLE_KINDS = [(c, {"genres": "words", "keywords": "words", "directors": "words", "cast_names": "words", "imdb_rating": "number", "tmdb_rating": "number", "quality": "number",
                    "enriched_at": "time", "keywords_at": "time"}.get(c, "text")) for c in (
    "item_id", "imdb_id", "tmdb_id", "movielens_id", "kind", "title", "original_title", "year", "runtime", "genres", "language", "imdb_rating", "imdb_votes", "tmdb_rating",
    "tmdb_votes", "keywords", "directors", "cast_names", "overview", "tagline", "poster_path", "enriched_at", "keywords_at", "quality")]


@query("write_snapshot", sql(f"""WITH t AS {root_sql("titles", "item_id", TITLE_KINDS)}, s AS {root_sql("space", "item_id", [("item_id", "text"), ("vec", "numbers")])}
SELECT 'titles' AS artefact, t.rows, t.root, 'cat-' || substr(sha256('space=' || s.root || chr(10) || 'titles=' || t.root), 1, 16) AS build_id, 'sp-' || substr(s.root, 1, 16) AS space_id, 24 AS n_columns FROM t, s
UNION ALL SELECT 'space', s.rows, s.root, 'cat-' || substr(sha256('space=' || s.root || chr(10) || 'titles=' || t.root), 1, 16), 'sp-' || substr(s.root, 1, 16), 24 FROM t, s""", "titles", "space"))
def _(spark, d):
    """Titles and their item space: what each holds, the build's name and the space's, from content alone."""
    out = snapshot.write_snapshot(R.titles(spark, d), scratch(spark, "snapshot"), space=R.space(spark, d))
    return out.select(F.explode("contents").alias("c"), "build_id", "space_id", F.size("columns").alias("n_columns")).select(
        "c.artefact", "c.rows", "c.root", "build_id", "space_id", "n_columns")


@query("read_snapshot", sql("SELECT item_id, imdb_id, title, CAST(year AS DOUBLE) AS year, CAST(NULL AS VARCHAR) AS end_year, round(quality, 9) AS quality FROM titles", "titles"))
def _(spark, d):
    path = scratch(spark, "snapshot")
    snapshot.write_snapshot(R.titles(spark, d), path)
    return snapshot.read_snapshot(spark, path).select("item_id", "imdb_id", "title", F.col("year").cast("double").alias("year"), F.col("end_year").cast("string").alias("end_year"), F.round("quality", 9).alias("quality"))


@query("input_fingerprint", """SELECT 'lineitem' AS source, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM lineitem
UNION ALL SELECT 'orders', count(*), CAST(sum(CAST('0x' || substr(md5(o_orderkey || '|' || o_orderstatus), 1, 8) AS BIGINT)) AS BIGINT) FROM orders""")
def _(spark, d):
    tables = {"lineitem": R.table(spark, d, "lineitem"), "orders": R.table(spark, d, "orders")}
    return L.content_fingerprint(tables, {"lineitem": ["l_orderkey", "l_linenumber", "l_partkey"], "orders": ["o_orderkey", "o_orderstatus"]})


@query("manifest", f"""WITH l AS {root_sql("lineitem", "l_orderkey, l_linenumber, l_partkey, l_quantity", [("l_orderkey", "text"), ("l_linenumber", "text"), ("l_partkey", "text"), ("l_quantity", "number")])},
  o AS {root_sql("orders", "o_orderkey", [("o_orderkey", "text"), ("o_orderstatus", "text"), ("o_orderdate", "time")])}
SELECT 'lineitem' AS artefact, rows, root FROM l UNION ALL SELECT 'orders', rows, root FROM o""")
def _(spark, d):
    lines = R.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("l_quantity"))
    orders = R.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    keys = {"lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], "orders": ["o_orderkey"]}
    return L.manifest({"lineitem": lines, "orders": orders}, "check", {"v": 1}, R.as_of(), keys).select("artefact", "rows", "root")
