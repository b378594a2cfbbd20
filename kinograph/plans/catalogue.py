"""Catalogue queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import catalogue as C
from . import roles as R
from .registry import query
from .roles import sql


def basics(spark, d):
    """The part table in the shape of a title dump: every column text."""
    p = R.table(spark, d, "part")
    s = F.col("p_size")
    return p.select(
        F.col("p_partkey").cast("string").alias("tconst"),
        F.when(F.col("p_type") == "PROMO", "tvSeries").when(F.col("p_type") == "ECONOMY", "tvMovie")
        .when(F.col("p_type") == "SMALL", "short").otherwise("movie").alias("titleType"),
        F.col("p_name").alias("primaryTitle"), F.col("p_name").alias("originalTitle"),
        F.when(s == 7, "1").when(s == 8, F.lit(None)).otherwise("0").alias("isAdult"),
        F.when(s != 9, (s + 1920).cast("string")).alias("startYear"), F.lit(None).cast("string").alias("endYear"),
        F.when(s == 11, "soon").otherwise((s * 2 + 60).cast("string")).alias("runtimeMinutes"),
        F.when(s != 12, F.concat(F.lower("p_type"), F.lit(","), F.lower("p_brand"))).alias("genres"))


BASICS = """basics AS (SELECT CAST(p_partkey AS VARCHAR) AS tconst,
  CASE p_type WHEN 'PROMO' THEN 'tvSeries' WHEN 'ECONOMY' THEN 'tvMovie' WHEN 'SMALL' THEN 'short' ELSE 'movie' END AS titleType,
  p_name, p_brand, p_type, p_size,
  CASE WHEN p_size = 7 THEN 1 WHEN p_size = 8 THEN NULL ELSE 0 END AS adult,
  CASE WHEN p_size <> 9 THEN p_size + 1920 END AS year,
  CASE WHEN p_size <> 11 THEN p_size * 2 + 60 END AS runtime,
  CASE WHEN p_size <> 12 THEN lower(p_type) || ',' || lower(p_brand) END AS genres FROM part),
scope AS (SELECT * FROM basics WHERE titleType <> 'short' AND year >= 1930 AND coalesce(adult, 0) <> 1)"""


def dump_ratings(spark, d):
    return R.table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.round(F.avg("l_quantity") / 5, 1).alias("q"), F.count("*").alias("n")).select(
        F.col("l_partkey").cast("string").alias("tconst"), F.col("q").cast("string").alias("averageRating"),
        F.when(F.col("n") != 20, (F.col("n") * 3).cast("string")).otherwise("many").alias("numVotes"))


DUMP_RATINGS = """dr AS (SELECT CAST(l_partkey AS VARCHAR) AS tconst, round(avg(l_quantity) / 5, 1) AS imdb_rating,
  CASE WHEN count(*) <> 20 THEN count(*) * 3 END AS imdb_votes FROM lineitem GROUP BY 1)"""


@query("catalogue_scope", f"""WITH {BASICS}
SELECT tconst, CASE WHEN titleType = 'tvSeries' THEN 'tv' ELSE 'movie' END AS kind, year, runtime,
  coalesce(genres, '') AS genres, p_name AS title FROM scope""", floats=("runtime",))
def _(spark, d):
    return C.catalogue_scope(basics(spark, d)).select(
        "tconst", "kind", "year", "runtime", F.array_join("genres", ",").alias("genres"), "title")


@query("derive_kind", f"""WITH {BASICS} SELECT tconst, titleType AS title_type,
  CASE WHEN titleType = 'tvSeries' THEN 'tv' ELSE 'movie' END AS kind FROM basics""")
def _(spark, d):
    return basics(spark, d).select("tconst", F.col("titleType").alias("title_type"), S.derive_kind(F.col("titleType")).alias("kind"))


@query("split_genres", f"""WITH {BASICS}
SELECT tconst, len(string_split(coalesce(genres, ''), ',')) AS n, string_split(coalesce(genres, ''), ',')[1] AS first FROM basics""")
def _(spark, d):
    g = S.split_genres(F.col("genres"))
    return basics(spark, d).select("tconst", F.size(g).alias("n"), g[0].alias("first"))


@query("attach_ratings", f"""WITH {BASICS}, {DUMP_RATINGS}
SELECT scope.tconst, imdb_rating, imdb_votes FROM scope LEFT JOIN dr USING (tconst)""", floats=("imdb_votes",))
def _(spark, d):
    return C.attach_ratings(C.catalogue_scope(basics(spark, d)), dump_ratings(spark, d)).select("tconst", "imdb_rating", "imdb_votes")


@query("flat_vote_floor", f"""WITH {BASICS}, {DUMP_RATINGS}
SELECT scope.tconst, imdb_votes FROM scope LEFT JOIN dr USING (tconst) WHERE imdb_votes >= 80""")
def _(spark, d):
    return C.flat_vote_floor(C.attach_ratings(C.catalogue_scope(basics(spark, d)), dump_ratings(spark, d)), 80).select("tconst", "imdb_votes")


def akas(spark, d):
    """Supplier lines as release rows: the supplier's return flag and nation as region."""
    li, s, n = (R.table(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("l_partkey").cast("string").alias("titleId"), F.when(F.col("l_quantity") > 3, F.col("n_name")).alias("region"))


@query("restrict_to_kept", f"""WITH {BASICS}
SELECT l_orderkey AS line, CAST(l_partkey AS VARCHAR) AS tconst FROM lineitem WHERE CAST(l_partkey AS VARCHAR) IN (SELECT tconst FROM scope)""")
def _(spark, d):
    dump = R.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_partkey").cast("string").alias("tconst"))
    return C.restrict_to_kept(dump, C.catalogue_scope(basics(spark, d)).select("tconst")).select("line", "tconst")


@query("release_regions", f"""WITH {BASICS}, regions AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS tconst, n_name AS region
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity > 3)
SELECT tconst, array_to_string(list_slice(list_sort(list(region)), 1, 12), '|') AS countries FROM regions JOIN scope USING (tconst) GROUP BY 1""")
def _(spark, d):
    return C.release_regions(akas(spark, d), C.catalogue_scope(basics(spark, d))).select("tconst", F.array_join("countries", "|").alias("countries"))


def crew_dump(spark, d):
    """Suppliers of a part as directors, customers' segments of it as writers."""
    return R.table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("tconst")).agg(
        F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("directors"),
        F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 45, F.col("l_suppkey").cast("string")))), ","), F.lit("")).alias("writers"))


def name_dump(spark, d):
    return R.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("nconst"), F.col("s_name").alias("primaryName"))


@query("resolve_crew", f"""WITH {BASICS}, pairs AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS tconst, s_name, l_quantity > 45 AS w
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT tconst, array_to_string(list_slice(list_sort(list(DISTINCT s_name)), 1, 4), '|') AS directors,
  array_to_string(list_slice(list_sort(list(DISTINCT s_name) FILTER (WHERE w)), 1, 4), '|') AS writers
FROM pairs JOIN scope USING (tconst) GROUP BY 1""")
def _(spark, d):
    out = C.resolve_crew(crew_dump(spark, d), name_dump(spark, d), C.catalogue_scope(basics(spark, d)))
    return out.select("tconst", F.array_join("directors", "|").alias("directors"), F.array_join("writers", "|").alias("writers"))


@query("resolve_cast", f"""WITH {BASICS}, c AS (SELECT CAST(l_partkey AS VARCHAR) AS tconst, l_linenumber AS o, s_name, l_returnflag
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag <> 'R' AND l_linenumber <= 5)
SELECT tconst, array_to_string(list_slice(list(s_name ORDER BY o, s_name), 1, 5), '|') AS cast_names FROM c JOIN scope USING (tconst) GROUP BY 1""")
def _(spark, d):
    principals = R.table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("tconst"), F.col("l_linenumber").cast("string").alias("ordering"),
        F.col("l_suppkey").cast("string").alias("nconst"),
        F.when(F.col("l_returnflag") == "R", "producer").when(F.col("l_returnflag") == "A", "actor").otherwise("self").alias("category"))
    out = C.resolve_cast(principals, name_dump(spark, d), C.catalogue_scope(basics(spark, d)), top_n=5)
    return out.select("tconst", F.array_join("cast_names", "|").alias("cast_names"))


def links(spark, d):
    o = R.table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b")).select(
        F.concat(F.lit("tt"), F.lpad(F.col("k").cast("string"), 7, "0")).alias("imdb_id"),
        F.explode(F.array("a", "b")).alias("movielens_id")).withColumn("tmdb_id", F.col("movielens_id") + 7)


@query("attach_links", sql("""WITH links AS (SELECT 'tt' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS imdb_id, min(o_orderkey) AS movielens_id FROM orders GROUP BY 1)
SELECT item_id, links.movielens_id, links.movielens_id + 7 AS tmdb_id FROM titles LEFT JOIN links USING (imdb_id)""", "titles"), floats=("movielens_id", "tmdb_id"))
def _(spark, d):
    return C.attach_links(R.titles(spark, d), links(spark, d)).select("item_id", "movielens_id", "tmdb_id")


@query("hard_filters", sql("""SELECT item_id FROM titles WHERE kind <> 'tv' AND coalesce(year, 0) >= 1990 AND year <= 2015 AND runtime <= 150
  AND coalesce(runtime, 0) >= 70 AND imdb_votes >= 1500 AND language IN (SELECT DISTINCT p_brand FROM part WHERE length(p_brand) = 8)
  AND item_id NOT IN (SELECT item_id FROM log WHERE kind = 'seen')""", "titles", "log"))
def _(spark, d):
    langs = [f"Brand#{i}" for i in range(10, 60)]
    seen = R.events(spark, d).filter(F.col("kind") == "seen")
    return C.hard_filters(R.titles(spark, d), langs, "movie", 1990, 2015, 70, 150, 1500, seen).select("item_id")


@query("lean_projection", sql("SELECT item_id, title, year, kind, language, runtime, imdb_rating, imdb_votes, quality FROM titles", "titles"), floats=("year", "runtime", "imdb_votes"))
def _(spark, d):
    return C.lean_projection(R.titles(spark, d)).drop("original_title", "genres", "keywords", "directors", "cast_names")


@query("present", sql("""SELECT item_id, title, CASE WHEN original_title <> title THEN original_title END AS original_title,
  CASE WHEN language = 'xx' THEN 'unknown-language' ELSE language END AS language_name, array_to_string(list_slice(genres, 1, 3), '|') AS genres,
  array_to_string(list_slice(directors, 1, 2), '|') AS directors, imdb_rating AS rating, imdb_votes AS votes,
  substr(overview, 1, 260) AS overview, 'https://image.tmdb.org/t/p/w342' || poster_path AS poster FROM titles""", "titles"), floats=("votes",))
def _(spark, d):
    return C.present(R.titles(spark, d)).select(
        "item_id", "title", "original_title", "language_name", F.array_join("genres", "|").alias("genres"),
        F.array_join("directors", "|").alias("directors"), "rating", "votes", "overview", "poster")


@query("exclude_items", sql("SELECT item_id FROM titles WHERE NOT EXISTS (SELECT 1 FROM log WHERE log.item_id = titles.item_id AND kind IN ('rate','skip','seen','dismiss','request'))", "titles", "log"))
def _(spark, d):
    return C.exclude_items(R.titles(spark, d), R.events(spark, d).filter(F.col("kind").isin("rate", "skip", "seen", "dismiss", "request"))).select("item_id")


@query("lookup_titles", sql("SELECT item_id, title, year FROM titles WHERE item_id IN (SELECT item_id FROM log WHERE kind = 'rate')", "titles", "log"), floats=("year",))
def _(spark, d):
    return C.lookup_titles(R.titles(spark, d), R.events(spark, d).filter(F.col("kind") == "rate")).select("item_id", "title", "year")


@query("quality_prior", sql("""SELECT item_id, round(CASE WHEN imdb_rating IS NULL OR imdb_votes IS NULL OR imdb_votes <= 0 THEN 0.64
  ELSE least(greatest(0.85 * ((imdb_rating * imdb_votes + 6.4 * 2500.0) / (imdb_votes + 2500.0)) / 10.0 + 0.15 * ln(1 + imdb_votes) / ln(1000001.0), 0.0), 1.0) END, 6) AS quality FROM titles""", "titles"))
def _(spark, d):
    return R.titles(spark, d).select("item_id", F.round(S.quality_prior(F.col("imdb_rating"), F.col("imdb_votes")), 6).alias("quality"))


@query("shrink_rating", sql("""SELECT item_id, round(CASE WHEN imdb_votes > 0 THEN (imdb_rating * imdb_votes + 6.4 * 2500.0) / (imdb_votes + 2500.0) END, 6) AS shrunk FROM titles""", "titles"))
def _(spark, d):
    return R.titles(spark, d).select("item_id", F.round(S.shrink_rating(F.col("imdb_rating"), F.col("imdb_votes"), 6.4), 6).alias("shrunk"))


DIST = """stats AS (SELECT language, count(*) AS n, avg(imdb_rating) AS m, stddev_samp(imdb_rating) AS s FROM titles
    WHERE imdb_rating IS NOT NULL AND imdb_votes > 0 GROUP BY 1),
  g AS (SELECT coalesce(avg(imdb_rating), 6.4) AS gm, coalesce(stddev_samp(imdb_rating), 1.0) AS gs FROM titles WHERE imdb_rating IS NOT NULL AND imdb_votes > 0),
  dist AS (SELECT language, n, n >= 75 AND s > 0.1 AS own, CASE WHEN n >= 75 AND s > 0.1 THEN m ELSE gm END AS mean,
    CASE WHEN n >= 75 AND s > 0.1 THEN s ELSE gs END AS sd FROM stats, g)"""


@query("rating_distribution", sql(f"WITH {DIST} SELECT language, n, own, round(mean, 6) AS mean, round(sd, 6) AS sd FROM dist", "titles"))
def _(spark, d):
    return C.rating_distribution(R.titles(spark, d), 75).select("language", "n", "own", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


RECAL = f"""{DIST}, shr AS (SELECT t.*, coalesce(mean, gm) AS mu, greatest(coalesce(sd, gs), 1e-6) AS sg,
    coalesce(CASE WHEN imdb_votes > 0 THEN (imdb_rating * imdb_votes + coalesce(mean, gm) * 2500.0) / (imdb_votes + 2500.0) END,
             CASE WHEN tmdb_votes > 0 THEN (tmdb_rating * tmdb_votes + coalesce(mean, gm) * 400.0) / (tmdb_votes + 400.0) END) AS shrunk
    FROM titles t LEFT JOIN dist USING (language), g),
  recal AS (SELECT * EXCLUDE (quality), CASE WHEN shrunk IS NULL THEN 0.5 ELSE least(greatest(0.85 * (0.5 + 0.18 * (shrunk - mu) / sg)
    + 0.15 * ln(1 + coalesce(nullif(imdb_votes, 0), nullif(tmdb_votes, 0), 0)) / ln(1000001.0), 0.0), 1.0) END AS quality FROM shr)"""


@query("recalibrate_quality", sql(f"WITH {RECAL} SELECT item_id, round(quality, 6) AS quality FROM recal", "titles"))
def _(spark, d):
    return C.recalibrate_quality(R.titles(spark, d), 75).select("item_id", F.round("quality", 6).alias("quality"))


TOP = sql(f"WITH {RECAL} SELECT item_id, title, language, round(quality, 6) AS quality FROM recal WHERE kind <> 'tv' ORDER BY round(quality, 9) DESC, item_id LIMIT 100", "titles")


@query("top_calibrated_titles", TOP)
def top_calibrated(spark, d):
    """The flagship: best titles by quality within their own language."""
    best = C.recalibrate_quality(R.titles(spark, d), 75)
    return C.hard_filters(best, kind="movie").orderBy(F.desc(F.round("quality", 9)), "item_id").limit(100).select(
        "item_id", "title", "language", F.round("quality", 6).alias("quality"))


@query("floor_lookup", sql(f"WITH {R.FLOORS_SQL} SELECT item_id, coalesce(CAST(round_even(floor * 0.75, 0) AS INTEGER), 1500) AS floor FROM titles LEFT JOIN floors USING (language)", "titles"))
def _(spark, d):
    return C.floor_lookup(R.titles(spark, d), R.floors(spark, d), scale=0.75).select("item_id", "floor")


PRUNE = f"""{R.FLOORS_SQL}, tagged AS (SELECT t.*, coalesce(floor, 2000) AS fl, item_id IN (SELECT item_id FROM log) AS touched FROM titles t LEFT JOIN floors USING (language))"""


@query("prune_by_language", sql(f"WITH {PRUNE} SELECT item_id, language, imdb_votes FROM tagged WHERE imdb_votes IS NULL OR imdb_votes >= fl OR touched", "titles", "log"), floats=("imdb_votes",))
def _(spark, d):
    return C.prune_by_language(R.titles(spark, d), R.floors(spark, d), R.events(spark, d)).select("item_id", "language", "imdb_votes")


@query("prune_counts", sql(f"WITH {PRUNE} SELECT count(*) AS before, count(*) FILTER (WHERE imdb_votes IS NULL OR imdb_votes >= fl OR touched) AS after FROM tagged", "titles", "log"))
def _(spark, d):
    return C.prune_counts(R.titles(spark, d), R.floors(spark, d), R.events(spark, d))


@query("pending_enrichment", sql(f"""WITH {PRUNE}, low AS (SELECT least(min(CAST(round_even(floor * 1.5, 0) AS INTEGER)), 3000) AS f FROM floors)
SELECT imdb_id, CASE WHEN movielens_id IS NOT NULL THEN tmdb_id END AS tmdb_id, imdb_votes FROM tagged, low
WHERE enriched_at IS NULL AND (imdb_votes IS NULL OR imdb_votes >= f OR touched)""", "titles", "log"), floats=("tmdb_id", "imdb_votes"))
def _(spark, d):
    return C.pending_enrichment(R.titles(spark, d), R.floors(spark, d), R.events(spark, d), scale=1.5)


@query("assign_item_ids", sql("SELECT imdb_id, row_number() OVER (ORDER BY imdb_votes DESC NULLS LAST, imdb_id) - 1 AS item_id FROM titles", "titles"))
def _(spark, d):
    return C.assign_item_ids(R.titles(spark, d)).select("imdb_id", "item_id")


def rebuilt(spark, d):
    """A rebuild: ids renumbered by price order, the smallest parts gone."""
    t = R.titles(spark, d).join(R.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_size"), "item_id")
    return t.filter(F.col("p_size") > 5).withColumn("item_id", F.col("item_id") * 2 + 1).drop("p_size")


REBUILT = "rebuilt AS (SELECT t.* REPLACE (t.item_id * 2 + 1 AS item_id) FROM titles t JOIN part ON p_partkey = t.item_id WHERE p_size > 5)"


@query("remap_ids", sql(f"""WITH {REBUILT} SELECT event_id, r.item_id, r.item_id IS NULL AS unmapped FROM log
LEFT JOIN titles t USING (item_id) LEFT JOIN rebuilt r USING (imdb_id)""", "titles", "log"), floats=("item_id",))
def _(spark, d):
    return C.remap_ids(R.events(spark, d), C.id_map(R.titles(spark, d), rebuilt(spark, d))).select("event_id", "item_id", "unmapped")


@query("remap_id_lists", sql(f"""WITH {REBUILT}, lists AS (SELECT slate_id, list(item_id ORDER BY position) AS ids FROM impressions GROUP BY 1),
  px AS (SELECT slate_id, unnest(ids) AS item_id, generate_subscripts(ids, 1) AS pos FROM lists),
  m AS (SELECT slate_id, list(r.item_id ORDER BY pos) AS ids FROM px JOIN titles t USING (item_id) JOIN rebuilt r USING (imdb_id) GROUP BY 1)
SELECT slate_id, coalesce(array_to_string(m.ids, '|'), '') AS ids FROM lists LEFT JOIN m USING (slate_id)""", "titles", "impressions"))
def _(spark, d):
    lists = R.impressions(spark, d).groupBy("slate_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "item_id"))), lambda x: x["item_id"]).alias("ids"))
    out = C.remap_id_lists(lists, C.id_map(R.titles(spark, d), rebuilt(spark, d)), "slate_id", "ids")
    return out.select("slate_id", F.array_join("ids", "|").alias("ids"))


@query("orphans", sql(f"""WITH {REBUILT} SELECT DISTINCT item_id FROM log WHERE item_id NOT IN (SELECT t.item_id FROM titles t JOIN rebuilt USING (imdb_id))""", "titles", "log"))
def _(spark, d):
    return C.orphans(R.events(spark, d), R.titles(spark, d), rebuilt(spark, d))


@query("carry_enrichment", sql(f"""WITH {REBUILT}, fresh AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS overview, CAST(NULL AS BIGINT) AS tmdb_id, [kind] AS genres) FROM rebuilt)
SELECT f.imdb_id, o.overview, o.tmdb_id,
  array_to_string(list_sort(CASE WHEN o.imdb_id IS NULL THEN f.genres ELSE list_distinct(list_concat(f.genres, o.genres)) END), '|') AS genres
FROM fresh f LEFT JOIN (SELECT * FROM titles WHERE enriched_at IS NOT NULL) o USING (imdb_id)""", "titles"), floats=("tmdb_id",))
def _(spark, d):
    fresh = rebuilt(spark, d).withColumns({"overview": F.lit(None).cast("string"), "tmdb_id": F.lit(None).cast("long"), "genres": F.array("kind")})
    return C.carry_enrichment(fresh, R.titles(spark, d)).select("imdb_id", "overview", "tmdb_id", F.array_join(F.array_sort("genres"), "|").alias("genres"))


def enrichment_batch(spark, d):
    """Order lines as arriving API answers, several per title."""
    return R.table(spark, d, "lineitem").select(
        F.concat(F.lit("tt"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")).alias("imdb_id"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("seq"),
        F.when(F.col("l_quantity") > 10, F.concat(F.lit("line "), F.col("l_orderkey").cast("string"))).alias("overview"),
        F.when(F.col("l_quantity") > 20, F.lower("l_returnflag")).alias("language"),
        (F.col("l_quantity") / 10).alias("tmdb_rating"), F.col("l_linenumber").cast("long").alias("tmdb_votes"),
        F.when(F.col("l_quantity") > 30, F.array("l_linestatus")).otherwise(F.array().cast("array<string>")).alias("keywords"),
        F.array(F.lower("l_returnflag")).alias("genres"), (F.col("l_quantity") > 25).alias("keywords_fetched"),
        (F.col("l_discount") < 0.09).alias("answered"))


BATCH = """batch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn
  FROM lineitem WHERE l_discount < 0.09) WHERE rn = 1)"""


@query("merge_enrichment", sql(f"""WITH {BATCH} SELECT item_id,
  coalesce(CASE WHEN l_quantity > 10 THEN 'line ' || l_orderkey END, overview) AS overview,
  coalesce(CASE WHEN l_quantity > 20 THEN lower(l_returnflag) END, language) AS language,
  coalesce(l_quantity / 10, tmdb_rating) AS tmdb_rating, imdb_votes,
  array_to_string(CASE WHEN l_quantity > 30 THEN [l_linestatus] ELSE keywords END, '|') AS keywords,
  epoch_us(CASE WHEN l_quantity > 25 THEN TIMESTAMP '{R.AS_OF}' ELSE keywords_at END) AS keywords_at,
  array_to_string(list_sort(CASE WHEN l_partkey IS NULL THEN genres ELSE list_distinct(list_concat(genres, [lower(l_returnflag)])) END), '|') AS genres
FROM titles LEFT JOIN batch ON l_partkey = item_id""", "titles"), floats=("imdb_votes", "keywords_at"))
def _(spark, d):
    out = C.merge_enrichment(R.titles(spark, d), enrichment_batch(spark, d), R.as_of())
    return out.select("item_id", "overview", "language", "tmdb_rating", "imdb_votes", F.array_join("keywords", "|").alias("keywords"),
                      F.unix_micros(F.col("keywords_at").cast("timestamp")).alias("keywords_at"), F.array_join(F.array_sort("genres"), "|").alias("genres"))


@query("merge_keywords", sql(f"""WITH {BATCH.replace('WHERE l_discount < 0.09', '')} SELECT item_id,
  array_to_string(CASE WHEN l_partkey IS NULL THEN keywords WHEN l_quantity > 30 THEN [l_linestatus] ELSE CAST([] AS VARCHAR[]) END, '|') AS keywords,
  CASE WHEN l_partkey IS NOT NULL THEN true ELSE keywords_at IS NOT NULL END AS stamped FROM titles LEFT JOIN batch ON l_partkey = item_id""", "titles"))
def _(spark, d):
    batch = enrichment_batch(spark, d).select(F.substring("imdb_id", 3, 20).cast("long").alias("item_id"), "seq", "keywords")
    return C.merge_keywords(R.titles(spark, d), batch, R.as_of()).select(
        "item_id", F.array_join("keywords", "|").alias("keywords"), F.col("keywords_at").isNotNull().alias("stamped"))


@query("stamp_existing_keywords", sql(f"SELECT item_id, keywords_at IS NULL AND len(keywords) > 0 AS stamped, epoch_us(CASE WHEN keywords_at IS NULL AND len(keywords) > 0 THEN TIMESTAMP '{R.AS_OF}' ELSE keywords_at END) AS keywords_at FROM titles", "titles"), floats=("keywords_at",))
def _(spark, d):
    return C.stamp_existing_keywords(R.titles(spark, d), R.as_of()).select("item_id", "stamped", F.unix_micros(F.col("keywords_at").cast("timestamp")).alias("keywords_at"))


@query("keyword_targets", sql("""SELECT item_id, tmdb_id, kind FROM (SELECT *, row_number() OVER (ORDER BY imdb_votes DESC NULLS LAST, item_id) AS rk
  FROM titles WHERE tmdb_id IS NOT NULL) WHERE rk <= 1500 AND keywords_at IS NULL""", "titles"))
def _(spark, d):
    return C.keyword_targets(R.titles(spark, d), 1500)


@query("resolve_or_insert", sql("""WITH inc AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 2 = 0 THEN 'tt' || lpad(CAST(o_custkey * 3 AS VARCHAR), 7, '0') END AS imdb_id, 100000 + o_custkey * 2 AS tmdb_id FROM orders),
  f AS (SELECT inc.*, coalesce(a.item_id, b.item_id) AS found, coalesce(inc.imdb_id, 'tmdb:' || inc.tmdb_id) AS k FROM inc
    LEFT JOIN titles a ON a.imdb_id = inc.imdb_id LEFT JOIN titles b ON b.tmdb_id = inc.tmdb_id),
  fresh AS (SELECT k, min(row_id) AS first FROM f WHERE found IS NULL GROUP BY 1),
  num AS (SELECT *, row_number() OVER (ORDER BY first, k) AS n FROM fresh)
SELECT row_id, coalesce(found, (SELECT max(item_id) FROM titles) + n) AS item_id, found IS NULL AND row_id = first AS inserted
FROM f LEFT JOIN num ON f.found IS NULL AND f.k = num.k""", "titles"))
def _(spark, d):
    inc = R.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("tt"), F.lpad((F.col("o_custkey") * 3).cast("string"), 7, "0"))).alias("imdb_id"),
        (F.col("o_custkey") * 2 + 100000).alias("tmdb_id"), (F.col("o_totalprice") / 100000).alias("tmdb_rating"), F.lit(10).alias("tmdb_votes"))
    return C.resolve_or_insert(R.titles(spark, d), inc).select("row_id", "item_id", F.coalesce("inserted", F.lit(False)).alias("inserted"))


@query("dedupe_last", sql("SELECT l_partkey AS part, l_orderkey AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1"))
def _(spark, d):
    li = R.table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("line"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("seq"))
    return C.dedupe_last(li, "part", "seq").select("part", "line")


@query("distinct_union", sql("SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(keywords, string_split(original_title, ' ')))), '|') AS words FROM titles", "titles"))
def _(spark, d):
    return R.titles(spark, d).select("item_id", F.array_join(F.array_sort(S.distinct_union(F.col("keywords"), F.split("original_title", " "))), "|").alias("words"))


@query("language_histogram", sql("SELECT language, count(*) AS n FROM titles GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "titles"))
def _(spark, d):
    return C.language_histogram(R.titles(spark, d), 10)


@query("offered_languages", sql("SELECT language, count(*) AS n FROM titles WHERE poster_path IS NOT NULL AND year >= 2010 AND language <> 'xx' GROUP BY 1 HAVING count(*) >= 20", "titles"))
def _(spark, d):
    return C.offered_languages(R.titles(spark, d), 2016)


@query("counts", sql("""SELECT (SELECT count(*) FROM titles) AS titles, (SELECT count(enriched_at) FROM titles) AS enriched,
  count(DISTINCT item_id) FILTER (WHERE kind = 'rate') AS ratings, count(DISTINCT item_id) FILTER (WHERE kind = 'skip') AS skips, count(*) AS events,
  (SELECT count(*) FROM impressions) AS impressions FROM log""", "titles", "log", "impressions"))
def _(spark, d):
    return C.counts(R.titles(spark, d), R.events(spark, d), R.impressions(spark, d))


@query("column_stats", sql("""SELECT round(avg(quality), 9) AS quality_mean, round(stddev_pop(quality), 9) AS quality_sd, round(avg(imdb_votes), 6) AS imdb_votes_mean,
  round(stddev_pop(imdb_votes), 6) AS imdb_votes_sd FROM titles""", "titles"))
def _(spark, d):
    out = C.column_stats(R.titles(spark, d), ["quality", "imdb_votes"])
    return out.select(*[F.round(c, 9 if c.startswith("q") else 6).alias(c) for c in out.columns])


@query("coverage", sql("""SELECT count(*) AS catalogue, count(*) FILTER (WHERE item_id IN (SELECT doc_id FROM documents)) AS embedded,
  count(*) FILTER (WHERE item_id IN (SELECT vec_id FROM embeddings)) AS fused, count(*) FILTER (WHERE item_id IN (SELECT vec_id FROM embeddings)) / count(*) < 0.995 AS stale FROM titles""", "titles"))
def _(spark, d):
    return C.coverage(R.titles(spark, d), R.text_items(spark, d), R.space(spark, d))


@query("integrity_report", sql(f"""WITH {REBUILT} SELECT 'event-without-title' AS "check", (SELECT count(DISTINCT item_id) FROM log WHERE item_id NOT IN (SELECT item_id FROM rebuilt)) AS n
UNION ALL SELECT 'duplicate-item-id', (SELECT count(*) FROM (SELECT item_id FROM rebuilt GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'duplicate-stable-id', (SELECT count(*) FROM (SELECT imdb_id FROM rebuilt GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'vector-without-title', (SELECT count(*) FROM space WHERE item_id NOT IN (SELECT item_id FROM rebuilt))
UNION ALL SELECT 'title-without-vector', (SELECT count(*) FROM rebuilt WHERE item_id NOT IN (SELECT item_id FROM space))
UNION ALL SELECT 'missing-stable-id', (SELECT count(*) FROM rebuilt WHERE imdb_id IS NULL)""", "titles", "log", "space"))
def _(spark, d):
    return C.integrity_report(rebuilt(spark, d), R.events(spark, d), R.space(spark, d))


POOL = """voted AS (SELECT * FROM titles WHERE imdb_votes > 0), rule AS (SELECT language, count(*) AS titles, quantile_cont(imdb_votes, 0.9) AS floor FROM voted GROUP BY 1),
  lim AS (SELECT language, count(*) FILTER (WHERE imdb_votes >= floor) AS above FROM voted JOIN rule USING (language) WHERE titles >= 12 GROUP BY 1),
  pool AS (SELECT v.item_id, v.language, v.imdb_votes FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY imdb_votes DESC, item_id) AS rn FROM voted) v
    JOIN lim USING (language) WHERE rn <= least(CASE WHEN above < {least} THEN {least} ELSE above END, 400))"""


@query("recognisable_pool", sql("WITH " + POOL.format(least=9) + " SELECT * FROM pool", "titles"))
def _(spark, d):
    return C.recognisable_pool(R.titles(spark, d), least=9).select("item_id", "language", "imdb_votes")


@query("feed_candidates", sql("SELECT item_id FROM titles WHERE year >= 2000 AND quality >= 0.5 AND poster_path IS NOT NULL AND kind = 'movie' AND item_id NOT IN (SELECT item_id FROM log)", "titles", "log"))
def _(spark, d):
    return C.feed_candidates(R.titles(spark, d), R.events(spark, d), 2010, 10, 0.5, "movie").select("item_id")


def weights(spark, d):
    """A feed request: brand weights in brand order."""
    from pyspark.sql import Window

    brands = R.table(spark, d, "part").groupBy(F.col("p_brand").alias("language")).agg(F.count("*").alias("n"))
    return brands.select("language", (F.pmod(F.col("n"), F.lit(7)) / 4.0).alias("weight"),
                         F.row_number().over(Window.orderBy("language")).alias("ord"))


WEIGHTS = "weights AS (SELECT p_brand AS language, (count(*) % 7) / 4.0 AS weight, row_number() OVER (ORDER BY p_brand) AS ord FROM part GROUP BY 1)"
QUOTA = WEIGHTS + """, ex AS (SELECT language, ord, weight / sum(weight) OVER () * {limit} AS exact FROM weights WHERE weight > 0),
  rk AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, ord) AS rn FROM ex),
  quota AS (SELECT language, ord, CAST(base + CASE WHEN rn <= {limit} - (SELECT sum(base) FROM rk) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM rk
    WHERE base + CASE WHEN rn <= {limit} - (SELECT sum(base) FROM rk) THEN 1 ELSE 0 END > 0)"""


@query("allocate_largest_remainder", sql("WITH " + QUOTA.format(limit=60) + " SELECT language, quota FROM quota"))
def _(spark, d):
    return C.allocate_largest_remainder(weights(spark, d), 60).select("language", "quota")


@query("allocate_rounded", sql(f"WITH {WEIGHTS} SELECT language, CAST(greatest(1, round_even(weight / (SELECT sum(weight) FROM weights WHERE weight > 0) * 61, 0)) AS BIGINT) AS quota FROM weights WHERE weight > 0"))
def _(spark, d):
    return C.allocate_rounded(weights(spark, d), 61).select("language", F.col("quota").cast("long").alias("quota"))


@query("allocate_round_robin", sql("""WITH pools AS (SELECT language, count(*) AS available FROM titles GROUP BY 1),
  o AS (SELECT *, row_number() OVER (ORDER BY available DESC, language) AS ord FROM pools),
  s AS (SELECT language, ord, unnest(generate_series(1, least(4, available))) AS round FROM o)
SELECT language, count(*) AS quota FROM (SELECT * FROM s ORDER BY round, ord LIMIT 70) GROUP BY 1""", "titles"))
def _(spark, d):
    pools = R.titles(spark, d).groupBy("language").agg(F.count("*").alias("available"))
    return C.allocate_round_robin(pools, 70, 4)


ROTATE = QUOTA.format(limit=60) + """, cand AS (SELECT t.*, row_number() OVER (PARTITION BY language ORDER BY quality DESC, item_id) AS rn FROM titles t
    WHERE year >= 2000 AND quality >= 0.0 AND poster_path IS NOT NULL AND item_id NOT IN (SELECT item_id FROM log)),
  p AS (SELECT c.*, quota, ord, count(*) OVER (PARTITION BY language) AS n FROM cand c JOIN quota USING (language) WHERE rn <= 3 * quota),
  rot AS (SELECT *, ((rn - 1 - ((2 * quota) % n)) % n + n) % n + 1 AS place FROM p),
  picked AS (SELECT *, count(*) OVER (PARTITION BY language) AS gs FROM rot WHERE place <= quota)"""


@query("rotate_window", sql(f"WITH {ROTATE} SELECT item_id, language, place FROM picked", "titles", "log"))
def _(spark, d):
    from pyspark.sql import Window

    limit = 60
    quota = C.allocate_largest_remainder(weights(spark, d), limit)
    cands = C.feed_candidates(R.titles(spark, d), R.events(spark, d), 2010, 10)
    w = Window.partitionBy("language").orderBy(F.desc("quality"), "item_id")
    ranked = cands.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 3 * limit).join(quota, "language")
    return C.rotate_window(ranked, 2).select("item_id", "language", "place")


@query("feed", sql(f"WITH {ROTATE} SELECT item_id, language, place FROM picked ORDER BY place, gs DESC, ord LIMIT 60", "titles", "log"))
def _(spark, d):
    return C.feed(R.titles(spark, d), R.events(spark, d), weights(spark, d), 2010, 60, 2, 10).select("item_id", "language", "place")


@query("interleave", sql("""WITH g AS (SELECT item_id, language, row_number() OVER (PARTITION BY language ORDER BY imdb_votes DESC NULLS LAST, item_id) AS rk,
  count(*) OVER (PARTITION BY language) AS gs FROM titles) SELECT item_id, row_number() OVER (ORDER BY rk, gs DESC, language) AS place FROM g""", "titles"))
def _(spark, d):
    from ..session import global_index, running_totals

    ranked = running_totals(R.titles(spark, d).select("item_id", "language", "imdb_votes"), ["language"], [F.desc_nulls_last("imdb_votes"), F.asc("item_id")], {}).select(
        "item_id", "language", (F.col("before") + 1).cast("int").alias("rk"))
    mixed = C.interleave(ranked, "language", "rk")
    return global_index(mixed, [F.asc("rk"), F.desc("group_size"), F.asc("language")], "place", 1).select("item_id", "place")


def hits(spark, d):
    return R.table(spark, d, "orders").select(F.col("o_orderkey").alias("hit"), (F.col("o_orderkey") % 4000 + 100000).alias("tmdb_id"), F.col("o_custkey").alias("user_id"))


@query("external_only", sql("SELECT o_orderkey AS hit FROM orders WHERE o_orderkey % 4000 + 100000 NOT IN (SELECT tmdb_id FROM titles WHERE tmdb_id IS NOT NULL)", "titles"))
def _(spark, d):
    return C.external_only(hits(spark, d), R.titles(spark, d)).select("hit")


@query("unrated_external", sql("""SELECT o_orderkey AS hit FROM orders WHERE NOT EXISTS (SELECT 1 FROM log JOIN titles USING (item_id)
  WHERE log.kind = 'rate' AND user_id = o_custkey AND tmdb_id = o_orderkey % 4000 + 100000)""", "titles", "log"))
def _(spark, d):
    return C.unrated_external(hits(spark, d), R.titles(spark, d), R.events(spark, d)).select("hit")
