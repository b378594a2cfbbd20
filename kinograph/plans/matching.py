"""Text, title matching, imports and copy decisions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import scalar as S
from ..functions import text as X
from ..operators import copies as K
from ..operators import matching as M
from . import roles as R
from .registry import query
from .roles import sql
from .sources import JOBS, parsed_jobs

WORD = r"regexp_replace(regexp_replace(lower(strip_accents(nfc_normalize({c}))), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')"


def norm_sql(c):
    return rf"regexp_replace(trim({WORD.format(c=c)}), '^(the|a|an) ', '')"


@query("normalise_title", f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def _(spark, d):
    return R.table(spark, d, "documents").select("doc_id", X.normalise_title(F.col("text")).alias("norm"))


@query("normalise_export_title", "SELECT doc_id, trim(" + WORD.format(c="regexp_replace(replace(text, 'ß', 'ss'), '[''‘’ʼ´`]', '', 'g')") + ") AS norm FROM documents")
def _(spark, d):
    return R.table(spark, d, "documents").select("doc_id", X.normalise_export_title(F.col("text")).alias("norm"))


@query("normalise_label", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '&', ' and '), '^(the|a|an)\s+', ''), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents""")
def _(spark, d):
    return R.table(spark, d, "documents").select("doc_id", X.normalise_label(F.col("text")).alias("norm"))


def asked(spark, d):
    """Parts as typed queries: with years, shouted, cut short and misspelt."""
    s, name = F.col("p_size"), F.col("p_name")
    text = (
        F.when(s % 4 == 0, F.concat(F.lit("The "), name, F.lit(" ("), (s + 1975).cast("string"), F.lit(")")))
        .when(s % 4 == 1, F.upper(name)).when(s % 4 == 2, F.substring(name, 1, 7)).otherwise(F.concat(name, F.lit("x")))
    )
    return R.table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), text.alias("query"), F.when(F.col("p_type") == "PROMO", "tv").alias("kind"))


ASKED = rf"""asked AS (SELECT p_partkey AS query_id, CASE p_size % 4 WHEN 0 THEN 'The ' || p_name || ' (' || (p_size + 1975) || ')' WHEN 1 THEN upper(p_name) WHEN 2 THEN substr(p_name, 1, 7) ELSE p_name || 'x' END AS query,
    CASE WHEN p_type = 'PROMO' THEN 'tv' END AS want_kind FROM part),
  s0 AS (SELECT DISTINCT query, want_kind, trim(regexp_replace(query, '[\s(\[]+((?:19|20)\d{{2}})[\s)\]]*$', '')) AS raw, TRY_CAST(regexp_extract(query, '[\s(\[]+((?:19|20)\d{{2}})[\s)\]]*$', 1) AS INTEGER) AS want_year FROM asked),
  sr AS (SELECT *, 1 AS attempt, {norm_sql('raw')} AS norm FROM s0 UNION ALL SELECT query, want_kind, query, NULL, 2, {norm_sql('query')} FROM s0 WHERE want_year IS NOT NULL),
  yb AS (SELECT sr.*, t.* FROM sr JOIN titles t ON (want_kind IS NULL OR t.kind = want_kind) AND (want_year IS NULL OR t.year BETWEEN want_year - 1 AND want_year + 1)),
  pr AS (SELECT *, 0.06 * least(1.0, ln(1 + coalesce(imdb_votes, 0)) / ln(500001.0)) + CASE WHEN want_year IS NOT NULL AND year IS NOT NULL THEN CASE WHEN want_year = year THEN 0.10 ELSE 0.03 END ELSE 0.0 END AS bonus FROM yb),
  m1 AS (SELECT *, 1.0 + bonus AS score FROM pr
    WHERE lower(regexp_replace(title, '[^a-zA-Z0-9 ]', ' ', 'g')) = norm OR lower(regexp_replace(original_title, '[^a-zA-Z0-9 ]', ' ', 'g')) = norm OR lower(title) = lower(raw) OR lower(original_title) = lower(raw)),
  m2 AS (SELECT * FROM (SELECT *, greatest(CASE WHEN contains({norm_sql('title')}, norm) THEN 0.55 + 0.30 * (length(norm) / length({norm_sql('title')})) ELSE 0.0 END,
      CASE WHEN contains({norm_sql('original_title')}, norm) THEN 0.55 + 0.30 * (length(norm) / length({norm_sql('original_title')})) ELSE 0.0 END) + bonus AS score FROM pr
    WHERE contains(lower(title), lower(raw)) OR contains(lower(original_title), lower(raw))) WHERE score > 0)"""
HIT = "SELECT query, want_kind, attempt, item_id, round(score, 9) AS score FROM "


def _hits(df):
    return df.select("query", "want_kind", F.col("attempt"), "item_id", F.round("score", 9).alias("score"))


def _search(spark, d):
    return M.prepare_queries(asked(spark, d)), M.prepare_titles(R.titles(spark, d))


@query("match_exact", sql(f"WITH {ASKED} {HIT} m1", "titles"))
def _(spark, d):
    return _hits(M.match_exact(*_search(spark, d)))


@query("match_contains", sql(f"WITH {ASKED} {HIT} m2", "titles"))
def _(spark, d):
    return _hits(M.match_contains(*_search(spark, d)))


@query("match_fuzzy")
def _(spark, d):
    return _hits(M.match_fuzzy(*_search(spark, d)))


@query("confident_match", sql(f"""WITH {ASKED}, h AS (SELECT *, row_number() OVER (PARTITION BY query, want_kind, attempt ORDER BY round(score, 9) DESC, item_id) AS rank FROM m2),
  g AS (SELECT query, want_kind, attempt, count(*) AS n, max(CASE WHEN rank = 1 THEN score END) AS a, max(CASE WHEN rank = 2 THEN score END) AS b, max(CASE WHEN rank = 1 THEN item_id END) AS best_id FROM h GROUP BY 1, 2, 3)
SELECT query, want_kind, attempt, n, best_id, coalesce(CASE WHEN n = 1 THEN a >= 0.6 ELSE (a >= 0.95 AND a - b >= 0.08) OR (a >= 0.75 AND a - b >= 0.20) END, false) AS confident FROM g""", "titles"))
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("query", "want_kind", "attempt").orderBy(F.desc(F.round("score", 9)), "item_id")
    hits = M.match_contains(*_search(spark, d)).withColumn("rank", F.row_number().over(w))
    return M.confident_match(hits, ("query", "want_kind", "attempt")).select("query", "want_kind", "attempt", "n", "best_id", "confident")


@query("search_titles")
def _(spark, d):
    return M.search_titles(asked(spark, d), R.titles(spark, d)).select("query", "want_kind", "rank", "item_id", F.round("score", 9).alias("score"))


@query("resolve_batch")
def _(spark, d):
    return M.resolve_batch(asked(spark, d), R.titles(spark, d)).select("query_id", "query", "status", "item_id", "closest")


@query("split_year", r"""SELECT p_partkey, trim(regexp_replace(q, '[\s(\[]+((?:19|20)\d{2})[\s)\]]*$', '')) AS bare, TRY_CAST(regexp_extract(q, '[\s(\[]+((?:19|20)\d{2})[\s)\]]*$', 1) AS DOUBLE) AS year
FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || ' [' || (1875 + 3 * p_size) || ']' WHEN p_size % 3 = 1 THEN p_name || ' ' || (1975 + p_size) ELSE p_name END AS q FROM part)""")
def _(spark, d):
    s, n = F.col("p_size"), F.col("p_name")
    q = F.when(s % 3 == 0, F.concat(n, F.lit(" ["), (s * 3 + 1875).cast("string"), F.lit("]"))).when(s % 3 == 1, F.concat(n, F.lit(" "), (s + 1975).cast("string"))).otherwise(n)
    bare, year = S.split_year(q)
    return R.table(spark, d, "part").select("p_partkey", bare.alias("bare"), year.cast("double").alias("year"))


EDITIONS = "CASE WHEN p_size % 4 = 0 THEN p_name || ': Extended Version (Director''s Cut)' WHEN p_size % 4 = 1 THEN p_name || ' - limited series' WHEN p_size % 4 = 2 THEN 'Limited Series ' || p_name ELSE p_name END"


def _edition():
    s, n = F.col("p_size") % 4, F.col("p_name")
    return F.when(s == 0, F.concat(n, F.lit(": Extended Version (Director's Cut)"))).when(s == 1, F.concat(n, F.lit(" - limited series"))).when(s == 2, F.concat(F.lit("Limited Series "), n)).otherwise(n)


@query("strip_edition", "SELECT p_partkey, CASE WHEN p_size % 4 = 2 THEN 'Limited Series ' || p_name ELSE p_name END AS title FROM part")
def _(spark, d):
    return R.table(spark, d, "part").select("p_partkey", S.strip_edition(_edition()).alias("title"))


@query("item_card", sql(r"""SELECT item_id, title || CASE WHEN original_title <> title THEN ' (' || original_title || ')' ELSE '' END || ' — ' || concat_ws(', ', CAST(year AS VARCHAR),
    CASE WHEN language <> 'xx' THEN language || '-language ' ELSE '' END || CASE kind WHEN 'tv' THEN 'series' ELSE 'film' END, runtime || ' min') || '.' || chr(10) ||
  'Directed by ' || directors[1] || ' and ' || directors[2] || '. starring ' || array_to_string(cast_names, ', ') || '.' || chr(10) || 'Genre: ' || genres[1] || '.' ||
  CASE WHEN len(keywords) > 0 THEN chr(10) || 'Themes: ' || array_to_string(keywords, ', ') || '.' ELSE '' END || coalesce(chr(10) || tagline, '') || coalesce(chr(10) || overview, '') AS card FROM titles""", "titles"))
def _(spark, d):
    return R.titles(spark, d).select("item_id", S.item_card().alias("card"))


TERMS = """terms AS (SELECT item_id, imdb_votes, unnest(list_concat(genres, list_transform(keywords, lambda k: lower(k)), ['dir: ' || directors[1], 'dir: ' || directors[2], 'lang: ' || language],
  CASE WHEN year IS NULL THEN [] ELSE [(year // 10 * 10) || 's'] END, CASE kind WHEN 'tv' THEN ['series'] ELSE [] END, CASE WHEN runtime >= 150 THEN ['long runtime'] WHEN runtime <= 95 THEN ['short runtime'] ELSE [] END)) AS term FROM titles)"""


@query("describing_terms", sql(f"WITH {TERMS} SELECT item_id, term, count(*) AS n FROM terms GROUP BY 1, 2", "titles"))
def _(spark, d):
    return R.titles(spark, d).select("item_id", F.explode(S.describing_terms()).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))


@query("card_key", "SELECT doc_id, sha1('hashed' || chr(0) || '256' || chr(0) || text) AS key FROM documents")
def _(spark, d):
    return R.table(spark, d, "documents").select("doc_id", S.card_key(F.col("text"), "hashed", 256).alias("key"))


@query("match_label", sql("""SELECT item_id, title || CASE WHEN original_title <> title THEN ' (' || original_title || ')' ELSE '' END || ' [' || concat_ws(', ', CAST(year AS VARCHAR), language, CASE WHEN kind = 'tv' THEN 'series' END) || ']' AS label,
  title || CASE WHEN year IS NOT NULL THEN ' (' || year || ')' ELSE '' END AS short FROM titles""", "titles"))
def _(spark, d):
    c = F.col
    return R.titles(spark, d).select("item_id", S.match_label(c("title"), c("original_title"), c("year"), c("language"), c("kind")).alias("label"), S.title_label(c("title"), c("year")).alias("short"))


@query("match_bonuses", sql("""SELECT item_id, round(0.06 * least(1.0, ln(1 + coalesce(imdb_votes, 0) * 200) / ln(500001.0)), 9) AS popularity, CASE WHEN year IS NULL THEN 0.0 WHEN year = 2000 THEN 0.1 ELSE 0.03 END AS year_bonus FROM titles""", "titles"))
def _(spark, d):
    return R.titles(spark, d).select("item_id", F.round(S.popularity_bonus(F.coalesce("imdb_votes", F.lit(0)) * 200), 9).alias("popularity"), S.year_bonus(F.lit(2000), F.col("year")).alias("year_bonus"))


@query("named_language", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'tamil' ELSE
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'hindi,tamil' WHEN '2' THEN 'tamil' WHEN '3' THEN 'french' ELSE '' END END AS lang FROM orders""")
def _(spark, d):
    p = F.substring("o_orderpriority", 1, 1)
    label = F.when(p == "1", "Film Tamil.Hindi 1080p TAMIL").when(p == "2", "Film.tamil.mkv").when(p == "3", "Film French Frenchman").otherwise("Tamilian film")
    wanted = F.when(F.col("o_orderstatus") == "F", "Tamil")
    return R.table(spark, d, "orders").select("o_orderkey", K.named_language(label, wanted).alias("lang"))


# --- imports ---


@query("dedupe_first", r"""WITH t AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'Ti''tle ' ELSE 'TITLE-' END || l_partkey % 300 AS title, l_suppkey AS source_id, l_orderkey, l_linenumber FROM lineitem)
SELECT title, source_id, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN title LIKE 'Ti%' THEN replace(lower(title), '''', '') ELSE replace(lower(title), '-', ' ') END, source_id ORDER BY l_orderkey, l_linenumber) AS rn FROM t) WHERE rn = 1""")
def _(spark, d):
    rows = R.table(spark, d, "lineitem").select(
        F.concat(F.when(F.col("l_linenumber") % 2 == 0, "Ti'tle ").otherwise("TITLE-"), F.pmod("l_partkey", F.lit(300)).cast("string")).alias("title"),
        F.col("l_suppkey").alias("source_id"), "l_orderkey", "l_linenumber")
    return M.dedupe_first(rows, ("l_orderkey", "l_linenumber"))


def import_rows(spark, d):
    s = F.col("p_size")
    title = F.when(s == 50, "").otherwise(F.concat("p_name", F.lit(" "), "p_brand", F.when(s % 5 == 0, ": Extended Cut").otherwise("")))
    return R.table(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"), F.pmod("p_partkey", F.lit(150)).alias("user_id"), title.alias("title"), F.lit("THUMBS_UP").alias("thumbs"),
        F.when(s > 30, "love").otherwise("like").alias("verdict"), F.col("p_partkey").alias("source_id"),
        F.make_date(s + 1975, F.lit(6), F.lit(1)).alias("rated_on"))


def import_candidates(spark, d):
    """What a search would have returned: titles of the same name and brand, best known first."""
    from pyspark.sql import Window

    p = R.table(spark, d, "part").filter(F.col("p_size") != 49)
    q = F.concat("p_name", F.lit(" "), "p_brand")
    w = Window.partitionBy("query").orderBy(F.desc("popularity"), "tmdb_id")
    return p.select(
        q.alias("query"), F.col("p_partkey").alias("tmdb_id"), F.when(F.col("p_type") == "PROMO", "tv").otherwise("movie").alias("kind"),
        F.when(F.col("p_size") % 3 > 0, F.upper(q)).otherwise(F.col("p_name")).alias("title"), F.col("p_name").alias("original_title"),
        F.when(F.col("p_size") != 48, F.col("p_size") + 1975).alias("year"), (F.col("p_size") * F.col("p_size") / 10.0).alias("popularity"),
        F.col("p_size").cast("long").alias("votes")).withColumn("rank", F.row_number().over(w))


GRADE = """ir AS (SELECT p_partkey AS row_id, p_name || ' ' || p_brand AS query, p_size = 50 AS blank, p_size + 1975 AS bound, p_partkey AS source_id, CASE WHEN p_size > 30 THEN 'love' ELSE 'like' END AS verdict, p_partkey % 150 AS user_id FROM part),
  cd AS (SELECT p_name || ' ' || p_brand AS query, p_partkey AS tmdb_id, p_type = 'PROMO' AS tv, p_size % 3 > 0 AS exact, CASE WHEN p_size <> 48 THEN p_size + 1975 END AS year, p_size * p_size / 10.0 AS pop, p_size AS votes FROM part WHERE p_size <> 49),
  pj AS (SELECT row_id, cd.*, coalesce(year <= bound, true) AS inn, bool_or(coalesce(year <= bound, true)) OVER (PARTITION BY row_id) AS anyin FROM ir JOIN cd USING (query) WHERE NOT blank),
  us AS (SELECT *, row_number() OVER (PARTITION BY row_id, exact ORDER BY pop DESC, tmdb_id) AS rn FROM pj WHERE inn OR NOT anyin),
  gg AS (SELECT row_id, count(*) AS cn, count(*) FILTER (WHERE exact) AS en, max(CASE WHEN exact AND rn = 1 THEN pop END) AS p1, coalesce(max(CASE WHEN exact AND rn = 2 THEN pop END), 0.0) AS p2,
    max(CASE WHEN exact AND rn = 1 THEN votes END) AS v1, coalesce(max(CASE WHEN exact AND rn = 2 THEN votes END), 0) AS v2, max(CASE WHEN exact AND rn = 1 THEN tmdb_id END) AS best, max(CASE WHEN NOT exact AND rn = 1 THEN tmdb_id END) AS guess FROM us GROUP BY 1),
  gr AS (SELECT ir.*, CASE WHEN blank THEN 'unresolvable' WHEN cn IS NULL OR en = 0 THEN 'low' WHEN en = 1 OR ((p1 + 1.0) / (p2 + 1.0) >= 8.0 AND v1 > v2) THEN 'high' ELSE 'ambiguous' END AS confidence, CASE WHEN NOT blank THEN coalesce(best, guess) END AS tmdb_id
    FROM ir LEFT JOIN gg USING (row_id)),
  co AS (SELECT gr.* REPLACE (CASE WHEN n > 1 THEN 'ambiguous' ELSE confidence END AS confidence) FROM gr LEFT JOIN (SELECT tmdb_id, count(*) AS n FROM gr WHERE tmdb_id IS NOT NULL GROUP BY 1) USING (tmdb_id)),
  ru AS (SELECT s_suppkey * 7 AS source_id, CASE WHEN s_suppkey % 4 = 0 THEN 'skip' WHEN s_suppkey % 4 = 1 THEN 'accept' WHEN s_suppkey % 4 = 2 THEN 'pick' ELSE 'dunno' END AS ruling, s_suppkey AS pick FROM supplier),
  rl AS (SELECT row_id, user_id, verdict, CASE WHEN ruling IS NULL THEN confidence WHEN ruling = 'skip' THEN 'skipped' WHEN ruling = 'accept' AND tmdb_id IS NULL THEN 'low' WHEN ruling IN ('accept', 'pick') THEN 'high' ELSE 'error' END AS confidence,
    CASE WHEN ruling = 'pick' THEN pick ELSE tmdb_id END AS tmdb_id FROM co LEFT JOIN ru USING (source_id))"""


def rulings(spark, d):
    k = F.col("s_suppkey")
    return R.table(spark, d, "supplier").select(
        (k * 7).alias("source_id"), F.when(k % 4 == 0, "skip").when(k % 4 == 1, "accept").when(k % 4 == 2, "pick").otherwise("dunno").alias("ruling"),
        k.alias("tmdb_id"), F.lit("movie").alias("kind"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("year"))


def _graded(spark, d):
    return M.grade_import(import_rows(spark, d), import_candidates(spark, d))


@query("grade_import", f"WITH {GRADE} SELECT row_id, confidence, tmdb_id FROM gr", floats=("tmdb_id",))
def _(spark, d):
    return _graded(spark, d).select("row_id", "confidence", F.col("match.tmdb_id").alias("tmdb_id"))


@query("flag_collisions", f"WITH {GRADE} SELECT row_id, confidence FROM co")
def _(spark, d):
    return M.flag_collisions(_graded(spark, d)).select("row_id", "confidence")


@query("apply_rulings", f"WITH {GRADE} SELECT row_id, confidence, tmdb_id FROM rl", floats=("tmdb_id",))
def _(spark, d):
    return M.apply_rulings(M.flag_collisions(_graded(spark, d)), rulings(spark, d)).select("row_id", "confidence", F.col("match.tmdb_id").alias("tmdb_id"))


@query("review_rows", f"WITH {GRADE} SELECT row_id, verdict, confidence FROM rl WHERE confidence NOT IN ('high', 'skipped')")
def _(spark, d):
    return M.review_rows(M.apply_rulings(M.flag_collisions(_graded(spark, d)), rulings(spark, d))).select("row_id", "verdict", "confidence")


@query("confidence_buckets", f"WITH {GRADE} SELECT confidence, count(*) AS n FROM rl GROUP BY 1")
def _(spark, d):
    return M.confidence_buckets(M.apply_rulings(M.flag_collisions(_graded(spark, d)), rulings(spark, d)))


@query("import_external_ratings", f"WITH {GRADE} SELECT row_id, user_id, tmdb_id, CASE verdict WHEN 'love' THEN 10.0 ELSE 7.5 END::DOUBLE AS value FROM rl WHERE confidence = 'high'")
def _(spark, d):
    events, _review = M.import_external_ratings(import_rows(spark, d), import_candidates(spark, d), rulings(spark, d), R.titles(spark, d))
    return events.select("row_id", "user_id", "tmdb_id", "value")


# --- copies ---


def scored_lines(spark, d):
    """Order lines as already scored copies of each order's film."""
    q = F.col("l_quantity")
    return R.table(spark, d, "lineitem").join(R.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("target_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("_c"), q, "l_extendedprice", "l_returnflag", "l_linestatus", "l_partkey",
        F.substring("o_orderpriority", 1, 1).alias("p"), "l_linenumber", "l_suppkey").select(
        "target_id", (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("candidate_id"), F.lit("s").alias("source"),
        F.concat(F.lit("copy "), F.col("l_partkey").cast("string")).alias("label"), (F.col("l_extendedprice") * 100000).alias("size"), F.lit("mkv").alias("ext"),
        F.when(q < 8, 0.0).otherwise(q / 3).alias("score"), F.lit("").alias("why"), F.when(q > 40, "film").otherwise(F.concat(F.lit("film "), F.lower("l_returnflag"))).alias("title"),
        F.when(q != 45, F.lit(2000)).alias("year"), F.when(F.col("l_linestatus") == "F", "tamil").otherwise("").alias("lang"),
        F.when(F.col("p") < "3", F.lit(2000)).alias("t_year"), F.when(F.col("p") == "1", "Tamil").alias("t_language"))


DECIDE = """sc AS (SELECT l_orderkey AS target_id, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS candidate_id, 'copy ' || l_partkey AS label, l_extendedprice * 100000 AS size, CASE WHEN l_quantity < 8 THEN 0.0 ELSE l_quantity / 3 END AS score,
    CASE WHEN l_quantity > 40 THEN 'film' ELSE 'film ' || lower(l_returnflag) END AS title, CASE WHEN l_quantity <> 45 THEN 2000 END AS year, CASE WHEN l_linestatus = 'F' THEN 'tamil' END AS lang,
    CASE WHEN substr(o_orderpriority, 1, 1) < '3' THEN 2000 END AS t_year, CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'tamil' END AS t_lang FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  us AS (SELECT *, NOT (size > 6 * 1073741824.0) AS fit FROM sc WHERE score > 0),
  fi AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, candidate_id) AS rn FROM us WHERE fit),
  tp AS (SELECT * FROM fi WHERE rn = 1),
  cl AS (SELECT f.target_id, count(DISTINCT f.title) > 1 AS ct, count(DISTINCT f.year) > 1 AS cy, count(DISTINCT f.lang) > 1 AS cl FROM fi f JOIN tp ON f.target_id = tp.target_id AND f.score >= tp.score - 3 GROUP BY 1),
  de AS (SELECT a.target_id, CASE WHEN u.target_id IS NULL THEN 'nothing usable' WHEN tp.target_id IS NULL THEN 'over cap' WHEN tp.score < 13 THEN 'low score' WHEN tp.t_year IS NOT NULL AND tp.year IS NULL THEN 'silent year'
      WHEN tp.t_lang IS NOT NULL AND coalesce(tp.lang, '') <> tp.t_lang THEN 'silent language' WHEN ct THEN 'disagree on title' WHEN cy THEN 'disagree on year' WHEN cl.cl THEN 'disagree on language' ELSE 'clear' END AS reason, tp.label, tp.score AS tscore, tp.title AS tt, tp.lang AS tl, tp.year AS ty
    FROM (SELECT DISTINCT target_id FROM sc) a LEFT JOIN (SELECT DISTINCT target_id FROM us) u USING (target_id) LEFT JOIN tp ON tp.target_id = a.target_id LEFT JOIN cl ON cl.target_id = a.target_id)"""


@query("decide", f"WITH {DECIDE} SELECT target_id, reason, label, CASE reason WHEN 'clear' THEN 'pick' WHEN 'nothing usable' THEN 'nothing' ELSE 'paused' END AS outcome FROM de")
def _(spark, d):
    return K.decide(scored_lines(spark, d), 6)[0].select("target_id", "reason", "label", "outcome")


@query("decide_picks", f"""WITH {DECIDE} SELECT fi.target_id, candidate_id FROM fi JOIN de USING (target_id) WHERE reason = 'clear' AND fi.title = tt AND (lang IS NULL OR tl IS NULL OR lang = tl) AND (year IS NULL OR ty IS NULL OR year = ty)""")
def _(spark, d):
    return K.decide(scored_lines(spark, d), 6)[1].select("target_id", "candidate_id")


@query("decide_offers", f"""WITH {DECIDE}, o AS (SELECT fi.target_id, candidate_id, row_number() OVER (PARTITION BY fi.target_id ORDER BY fi.score DESC, candidate_id) AS rank FROM fi JOIN de USING (target_id)
    WHERE reason NOT IN ('clear', 'nothing usable', 'over cap') AND (reason NOT LIKE 'disagree%' OR fi.score >= tscore - 3)),
  sm AS (SELECT target_id, candidate_id, row_number() OVER (PARTITION BY target_id ORDER BY size, candidate_id) AS rank FROM us JOIN de USING (target_id) WHERE reason = 'over cap')
SELECT * FROM o WHERE rank <= 3 UNION ALL SELECT * FROM sm WHERE rank = 1""")
def _(spark, d):
    return K.decide(scored_lines(spark, d), 6)[2].select("target_id", "candidate_id", F.col("rank").cast("long").alias("rank"))


JUDGED = "ju AS (SELECT l_orderkey AS target_id, 'copy ' || l_partkey AS label, bool_or(l_returnflag = 'R') AS wrong, bool_or(l_returnflag <> 'R') AS rgt FROM lineitem WHERE l_discount > 0.04 GROUP BY 1, 2)"


@query("replay_decisions", f"""WITH {DECIDE}, {JUDGED} SELECT target_id, CASE WHEN reason = 'nothing usable' THEN 'nothing' WHEN reason <> 'clear' THEN 'paused' WHEN wrong THEN 'wrong' WHEN rgt THEN 'right' ELSE 'unlabelled' END AS outcome FROM de LEFT JOIN ju USING (target_id, label)""")
def _(spark, d):
    judged = R.table(spark, d, "lineitem").filter("l_discount > 0.04").select(
        F.col("l_orderkey").alias("target_id"), F.concat(F.lit("copy "), F.col("l_partkey").cast("string")).alias("label"), (F.col("l_returnflag") != "R").alias("right"))
    return K.replay_decisions(scored_lines(spark, d), judged, 6).select("target_id", "outcome")


@query("score_candidates")
def _(spark, d):
    """Each order's film against its lines' labels."""
    o, li = R.table(spark, d, "orders"), R.table(spark, d, "lineitem")
    p = R.table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    named = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    targets = named.groupBy("l_orderkey").agg(F.min_by(F.struct("p_name", "p_size"), F.col("l_linenumber")).alias("x")).select(
        F.col("l_orderkey").alias("target_id"), F.col("x.p_name").alias("title"), F.array().cast("array<string>").alias("alt_titles"), (F.col("x.p_size") + 1975).alias("year"), F.lit("Tamil").alias("language"))
    label = F.concat(F.initcap(F.replace("p_name", F.lit(" "), F.lit("."))), F.lit("."), (F.col("p_size") + 1975).cast("string"), F.lit(".Tamil.1080p.x265."), F.when(F.col("l_quantity") > 48, "sample.").otherwise(""), F.lit("mkv"))
    cands = named.select(F.col("l_orderkey").alias("target_id"), F.col("l_linenumber").alias("candidate_id"), F.lit("s").alias("source"), label.alias("label"), F.lit(None).cast("double").alias("size"), F.lit("").alias("ext"))
    return K.score_candidates(targets, cands).select("target_id", "candidate_id", F.round("score", 6).alias("score"), "why", "lang")


FOLD = f"""{JOBS}, fo AS (SELECT 'job-' || job AS job_id, coalesce(arg_max(CASE o_orderstatus WHEN 'F' THEN 'paused' WHEN 'O' THEN 'downloading' ELSE 'failed' END, n) FILTER (WHERE kind = 'state'), 'queued') AS state,
    count(*) FILTER (WHERE kind = 'wrong') AS wrong, arg_max(o_orderkey, n) FILTER (WHERE kind = 'target') AS item_id, coalesce(bool_or(kind = 'offer'), false) AS asked,
    CASE WHEN coalesce(max(n) FILTER (WHERE kind = 'filed') > coalesce(max(n) FILTER (WHERE kind = 'wrong'), 0), false) THEN arg_max('copy ' || o_orderkey, n) FILTER (WHERE kind = 'filed') END AS filed,
    coalesce(max(n) FILTER (WHERE kind = 'offer') > coalesce(max(n) FILTER (WHERE kind = 'state' AND o_orderstatus <> 'F'), 0), false) AS offered FROM jk GROUP BY 1)"""


@query("fold_jobs", f"WITH {FOLD} SELECT * FROM fo", floats=("item_id",))
def _(spark, d):
    jobs = K.fold_jobs(parsed_jobs(spark, d))
    return jobs.select("job_id", "state", "wrong", "item_id", "asked", F.col("filed.label").alias("filed"), F.col("offer").isNotNull().alias("offered"))


@query("job_measures", f"""WITH {FOLD} SELECT count(*) AS jobs, CAST(count(filed) + sum(wrong) AS BIGINT) AS filed, CAST(sum(wrong) AS BIGINT) AS wrong, sum(wrong) / (count(filed) + sum(wrong)) AS wrong_rate,
  count(*) FILTER (WHERE item_id IS NOT NULL AND asked) / count(item_id) AS pause_rate, count(*) FILTER (WHERE state = 'failed') AS failed FROM fo""")
def _(spark, d):
    return K.job_measures(K.fold_jobs(parsed_jobs(spark, d)))


@query("expire_paused", f"""WITH {FOLD}, up AS (SELECT 'job-' || o_custkey AS job_id, max(o_orderdate) AS updated FROM orders GROUP BY 1)
SELECT job_id, CASE WHEN state = 'paused' AND TIMESTAMP '2001-06-01' - updated > INTERVAL 24 HOUR THEN 'cancelled' ELSE state END AS state FROM fo JOIN up USING (job_id)""")
def _(spark, d):
    jobs = K.fold_jobs(parsed_jobs(spark, d))
    return K.expire_paused(jobs, F.lit("2001-06-01 00:00:00").cast("timestamp_ntz")).select("job_id", "state")


@query("mark_interrupted", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND (o_orderpriority LIKE '5%' OR epoch(TIMESTAMP '2000-01-01' - o_orderdate) > 30) THEN 'interrupted' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END AS status FROM orders""")
def _(spark, d):
    beat = F.when(~F.col("o_orderpriority").startswith("5"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    builds = R.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"),
                                                beat.alias("heartbeat_at"), F.lit(None).cast("string").alias("updated_at"))
    return K.mark_interrupted(builds, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")).select("o_orderkey", "status")
