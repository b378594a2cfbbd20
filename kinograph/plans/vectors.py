"""Vector, taste, slate, cold-start and discovery queries on the given tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalar as S
from ..functions import vectors as V
from ..operators import catalogue as C
from ..operators import coldstart as Q
from ..operators import discovery as D
from ..operators import events as E
from ..operators import itemspace as I
from ..operators import slates as L
from ..operators import taste as K
from ..session import cut
from . import roles as R
from .events import LABELS
from .matching import TERMS
from .registry import query
from .roles import sql


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


# --- co-consumption ---

ACTIVE = """au AS (SELECT user_id FROM ratings GROUP BY 1 HAVING count(*) >= 30), ai AS (SELECT movie_id FROM ratings GROUP BY 1 HAVING count(*) >= 25),
  act AS (SELECT * FROM ratings WHERE user_id IN (SELECT user_id FROM au) AND movie_id IN (SELECT movie_id FROM ai))"""


@query("activity_thresholds", sql(f"WITH {ACTIVE} SELECT user_id, movie_id, rating FROM act", "ratings"))
def _(spark, d):
    return I.activity_thresholds(R.ratings(spark, d), 30, 25).select("user_id", "movie_id", "rating")


@query("interaction_matrix", sql(f"WITH {ACTIVE} SELECT user_id, movie_id, round(0.3 + 1.7 * least(greatest((rating - 0.5) / 4.5, 0.0), 1.0), 9) AS confidence FROM act", "ratings"))
def _(spark, d):
    return I.interaction_matrix(R.ratings(spark, d), min_user=30, min_item=25).select("user_id", "movie_id", F.round("confidence", 9).alias("confidence"))


@query("confidence", sql("SELECT user_id, movie_id, 1.0 + 2.0 * (rating - 3.5) AS confidence FROM ratings WHERE rating >= 3.5", "ratings"))
def _(spark, d):
    return I.interaction_matrix(R.ratings(spark, d), "liked", 1, 1).select("user_id", "movie_id", "confidence")


@query("rating_reward", sql("SELECT user_id, movie_id, round(least(greatest((rating - 0.5) / 4.5, 0.0), 1.0), 9) AS reward FROM ratings", "ratings"))
def _(spark, d):
    return R.ratings(spark, d).select("user_id", "movie_id", F.round(S.rating_reward(F.col("rating")), 9).alias("reward"))


HOLD = "ho AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM ratings) ORDER BY md5('0-' || user_id), user_id LIMIT 100)"


@query("choose_holdout", sql(f"WITH {HOLD} SELECT user_id FROM ho", "ratings"))
def _(spark, d):
    return I.choose_holdout(R.ratings(spark, d), 100)


@query("exclude_holdout", sql(f"WITH {HOLD} SELECT user_id, movie_id, rating FROM ratings WHERE user_id NOT IN (SELECT user_id FROM ho)", "ratings"))
def _(spark, d):
    r = R.ratings(spark, d)
    return I.exclude_holdout(r, I.choose_holdout(r, 100)).select("user_id", "movie_id", "rating")


# Where values are open (any rotation or draw is right) the checks are sets, widths and norms.
@query("als_factors", sql("SELECT DISTINCT movie_id, 16 AS width FROM ratings", "ratings"))
def _(spark, d):
    f = I.als_factors(I.interaction_matrix(R.ratings(spark, d)), rank=16, iterations=6)
    return f.select("movie_id", F.size("vec").alias("width"))


@query("attach_factors", sql("SELECT item_id, movielens_id IS NOT NULL AND movielens_id - 200000 IN (SELECT item_id FROM space) AS has_cf FROM titles", "titles", "space"))
def _(spark, d):
    f = R.space(spark, d).select((F.col("item_id") + 200000).alias("movie_id"), "vec")
    return I.attach_factors(R.titles(spark, d), f).select("item_id", "has_cf")


# --- vectors ---


@query("truncate_normalise", sql("""WITH n AS (SELECT item_id, vec[1:16] AS h, greatest(sqrt(list_dot_product(vec[1:16], vec[1:16])), 1e-9) AS z FROM space)
SELECT item_id, unnest(generate_series(1, 16)) AS pos, round(unnest(h) / z, 6) AS x FROM n""", "space"))
def _(spark, d):
    v = R.space(spark, d).select("item_id", F.posexplode(V.truncate_normalise(F.col("vec"), 16)).alias("p", "x"))
    return v.select("item_id", (F.col("p") + 1).cast("long").alias("pos"), r6("x"))


@query("neighbours", sql("""WITH p AS (SELECT a.item_id AS qid, b.item_id, list_dot_product(a.vec, b.vec) AS s FROM space a JOIN space b ON a.item_id <> b.item_id JOIN titles t ON t.item_id = b.item_id WHERE t.language <> 'xx')
SELECT qid, item_id, rank, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, item_id) AS rank FROM p) WHERE rank <= 10""", "titles", "space"))
def _(spark, d):
    sp = cut(R.space(spark, d))
    out = I.neighbours(sp, sp.select("item_id"), 10, R.titles(spark, d).filter("language <> 'xx'"))
    return out.select("qid", "item_id", F.col("rank").cast("long").alias("rank"), r6("similarity"))


SIDE = """ra AS (SELECT s.item_id, CAST(quality AS DOUBLE) AS a0, ln(1 + nullif(imdb_votes, 0)) AS a1, -(2026 - nullif(year, 0)) AS a2, least(nullif(runtime, 0), 300) AS a3, CASE WHEN kind = 'tv' THEN 1.0 ELSE 0.0 END AS a4 FROM space s LEFT JOIN titles USING (item_id)),
  st AS (SELECT avg(a0) AS m0, stddev_pop(a0) AS d0, avg(a1) AS m1, stddev_pop(a1) AS d1, avg(a2) AS m2, stddev_pop(a2) AS d2, avg(a3) AS m3, stddev_pop(a3) AS d3, avg(a4) AS m4 FROM ra),
  si AS (SELECT item_id, least(greatest((coalesce(a0, m0) - m0) / d0, -4), 4) * 0.15 AS s0, least(greatest((coalesce(a1, m1) - m1) / d1, -4), 4) * 0.15 AS s1, least(greatest((coalesce(a2, m2) - m2) / d2, -4), 4) * 0.15 AS s2,
    least(greatest((coalesce(a3, m3) - m3) / d3, -4), 4) * 0.15 AS s3, (a4 - m4) * 0.15 AS s4 FROM ra, st)"""
SIDES = ", ".join(f"round(s{i}, 6) AS s{i}" for i in range(5))


@query("side_features", sql(f"WITH {SIDE} SELECT item_id, {SIDES} FROM si", "titles", "space"))
def _(spark, d):
    f = I.side_features(R.titles(spark, d), R.space(spark, d))
    return f.select("item_id", *[F.round(F.col("side")[i], 6).alias(f"s{i}") for i in range(5)])


@query("side_features_for", sql(f"""WITH {SIDE} SELECT t.item_id, round(least(greatest((quality - m0) / d0, -4), 4) * 0.15, 6) AS s0, round(((CASE WHEN kind = 'tv' THEN 1.0 ELSE 0.0 END) - m4) * 0.15, 6) AS s4
FROM titles t, st WHERE t.item_id NOT IN (SELECT item_id FROM space)""", "titles", "space"))
def _(spark, d):
    t, sp = R.titles(spark, d), R.space(spark, d)
    outside = t.join(sp.select("item_id"), "item_id", "left_anti")
    f = I.side_features_for(outside, I.side_stats(t, sp))
    return f.select("item_id", F.round(F.col("side")[0], 6).alias("s0"), F.round(F.col("side")[4], 6).alias("s4"))


@query("feature_vectors", sql(f"WITH {SIDE} SELECT item_id, len(vec) + 5 AS width, round(list_sum(vec) + s0 + s1 + s2 + s3 + s4, 5) AS total FROM si JOIN space USING (item_id)", "titles", "space"))
def _(spark, d):
    f = I.feature_vectors(R.titles(spark, d), R.space(spark, d))
    return f.select("item_id", F.size("vec").cast("long").alias("width"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("random_fourier_features", sql("SELECT item_id, 64 + 5 + 128 AS width FROM space", "space"))
def _(spark, d):
    return I.random_fourier_features(I.feature_vectors(R.titles(spark, d), R.space(spark, d)).select("item_id", "vec"), 128, 0.5).select("item_id", F.size("vec").alias("width"))


def cards(spark, d):
    """One card per document: its whole text."""
    return R.text_items(spark, d).select("item_id", F.col("overview").alias("card"), "source")


CACHE_TS = "2024-01-01 00:00:00"


def _cache(spark, d, encoder):
    old = cards(spark, d).filter(F.col("source") != "web").withColumn("key", S.card_key(F.col("card"), encoder.name, encoder.width))
    return I.encode_texts(old, encoder).select("key", "vec", F.lit(CACHE_TS).cast("timestamp_ntz").alias("written_at"))


@query("embed_cards", "SELECT doc_id AS item_id, 64 AS width FROM documents")
def _(spark, d):
    enc = I.hashed_encoder(64)
    vecs, _fresh = I.embed_cards(cards(spark, d), cut(_cache(spark, d, enc)), enc, R.as_of())
    return vecs.select("item_id", F.size("vec").cast("long").alias("width"))


@query("missing_cards", f"SELECT DISTINCT sha1('hashed' || chr(0) || '64' || chr(0) || text) AS key FROM documents WHERE sha1('hashed' || chr(0) || '64' || chr(0) || text) NOT IN (SELECT sha1('hashed' || chr(0) || '64' || chr(0) || text) FROM documents WHERE source <> 'web')")
def _(spark, d):
    enc = I.hashed_encoder(64)
    return I.missing_cards(cards(spark, d), _cache(spark, d, enc), enc).select("key")


@query("latest_cached_vector", """SELECT key, CAST(v AS DOUBLE) AS first FROM (SELECT l_partkey AS key, l_quantity AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn
  FROM lineitem WHERE l_discount > 0.02) WHERE rn = 1""")
def _(spark, d):
    vec = F.when(F.col("l_discount") > 0.02, F.array("l_quantity", "l_tax")).otherwise(F.array("l_quantity"))
    cache = R.table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), vec.alias("vec"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("written_at"))
    return I.latest_cached_vector(cache, 2).select("key", F.col("vec")[0].alias("first"))


@query("compact_cache", "SELECT count(DISTINCT sha1('hashed' || chr(0) || '64' || chr(0) || text)) AS kept FROM documents WHERE source <> 'web'")
def _(spark, d):
    enc = I.hashed_encoder(64)
    live = cards(spark, d).select(
        S.card_key(F.col("card"), enc.name, enc.width).alias("key"))
    return I.compact_cache(_cache(spark, d, enc), live, 64).agg(F.count("*").alias("kept"))


PROMPT = dims.QUERY_PROMPT.replace("'", "''")


@query("embed_query", rf"""WITH w AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower('{PROMPT}' || coalesce(text, '')), '\s+'), lambda x: x <> '')) AS word FROM conversations WHERE role = 'user'),
  h AS (SELECT conv_id, turn, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS h FROM w), b AS (SELECT conv_id, turn, (h >> 1) % 256 AS pos, sum(CASE WHEN h & 1 = 1 THEN 1.0 ELSE -1.0 END) AS x FROM h GROUP BY ALL),
  n AS (SELECT conv_id, turn, sqrt(sum(x * x)) AS n FROM b GROUP BY ALL)
SELECT conv_id, turn, pos, round(x / n, 6) AS x FROM b JOIN n USING (conv_id, turn) WHERE x <> 0""")
def _(spark, d):
    q = R.table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    v = I.embed_query(q, I.hashed_encoder()).select("conv_id", "turn", F.posexplode("vec").alias("p", "x")).filter("x != 0")
    return v.select("conv_id", "turn", F.col("p").cast("long").alias("pos"), r6("x"))


def _blocks(spark, d):
    """Content: hashed title cards. Factors: the given embeddings, known where there is an external id."""
    t = R.titles(spark, d)
    content = cut(I.encode_texts(t.select("item_id", S.item_card().alias("card")), I.hashed_encoder()).select("item_id", "vec"))
    known = t.filter("movielens_id is not null").select("item_id")
    factors = cut(R.space(spark, d).join(known, "item_id", "left_semi").select("item_id", F.col("vec").cast("array<double>").alias("vec")))
    return content, factors


@query("reduce_factors", sql("SELECT item_id, 48 AS width FROM space JOIN titles USING (item_id) WHERE movielens_id IS NOT NULL", "titles", "space"))
def _(spark, d):
    return I.reduce_factors(_blocks(spark, d)[1]).select("item_id", F.size("vec").alias("width"))


@query("fit_imputation")
def _(spark, d):
    content, factors = _blocks(spark, d)
    pairs = content.withColumnRenamed("vec", "content").join(I.reduce_factors(factors).withColumnRenamed("vec", "factor").hint("merge"), "item_id")
    coef, intercept, alpha, r2 = I.fit_imputation(pairs)
    rows = [(i, o, round(float(coef[i, o]), 6), round(float(intercept[o]), 6), float(alpha), round(float(r2), 6)) for i in range(coef.shape[0]) for o in range(coef.shape[1])]
    return spark.createDataFrame(rows, "input int, output int, value double, intercept double, alpha double, r2 double")  # width x width, not rows


@query("fuse_space", sql("SELECT item_id, 192 AS width, 1.0 AS length FROM titles", "titles"))
def _(spark, d):
    space, _art = I.fuse_space(*_blocks(spark, d))
    return space.select("item_id", F.size("vec").alias("width"), r6(V.norm(F.col("vec")), "length"))


@query("project", "SELECT doc_id AS item_id, 192 AS width, 1.0 AS length FROM documents")
def _(spark, d):
    content, factors = _blocks(spark, d)
    _space, art = I.fuse_space(content, factors)
    new = I.encode_texts(cards(spark, d), I.hashed_encoder()).select("item_id", "vec")
    return I.project(new, art).select("item_id", F.size("vec").alias("width"), r6(V.norm(F.col("vec")), "length"))


@query("place_new_items", sql("SELECT item_id, 192 AS width FROM titles WHERE tmdb_id IS NULL", "titles"))
def _(spark, d):
    content, factors = _blocks(spark, d)
    space, art = I.fuse_space(content, factors)
    have = space.join(R.titles(spark, d).filter("tmdb_id is not null").select("item_id"), "item_id", "left_semi")
    return I.place_new_items(R.titles(spark, d), have, I.hashed_encoder(), art).select("item_id", F.size("vec").alias("width"))


# --- taste ---


def features(spark, d, t=None):
    return cut(I.feature_vectors(t if t is not None else cut(R.titles(spark, d)), R.space(spark, d)))


def labels(spark, d):
    return cut(E.label_weights(E.build_labels(R.events(spark, d), R.space(spark, d), R.as_of())))


def models(spark, d, feats=None, labs=None):
    feats = feats if feats is not None else features(spark, d)
    labs = labs if labs is not None else labels(spark, d)
    return cut(K.packed(K.fit_taste(labs, feats, K.sample_negatives(feats))))


SAMPLE = "neg AS (SELECT item_id FROM space ORDER BY md5('0-' || item_id), item_id LIMIT 1000)"


@query("sample_negatives", sql(f"WITH {SAMPLE} SELECT item_id FROM neg", "space"))
def _(spark, d):
    return K.sample_negatives(R.space(spark, d))


@query("user_negatives", sql(f"WITH {LABELS}, {SAMPLE} SELECT user_id, item_id FROM lab WHERE item_id IN (SELECT item_id FROM neg)", "log", "space"))
def _(spark, d):
    return K.user_negatives(K.sample_negatives(R.space(spark, d)), labels(spark, d))


@query("vote_floors", sql(f"""WITH {LABELS}, v AS (SELECT item_id, coalesce(imdb_votes, 0) AS votes FROM titles),
  af AS (SELECT votes AS a FROM (SELECT votes, row_number() OVER (ORDER BY votes DESC) - 1 AS i FROM v) WHERE i = 150)
SELECT user_id, round(least(quantile_cont(votes, 0.25), (SELECT a FROM af)), 6) AS floor FROM lab JOIN v USING (item_id) WHERE votes > 0 GROUP BY 1""", "titles", "log", "space"))
def _(spark, d):
    return K.vote_floors(labels(spark, d), R.titles(spark, d), 30).select("user_id", r6("floor"))


@query("sample_popular_negatives", sql("""WITH q AS (SELECT DISTINCT 100.0 * l_linenumber + 2800 AS floor FROM lineitem), v AS (SELECT item_id, coalesce(imdb_votes, 0) AS votes FROM titles),
  c AS (SELECT floor, item_id, votes >= floor AS above FROM q, v), n AS (SELECT floor, count(*) FILTER (WHERE above) >= 2000 AS use FROM c GROUP BY 1)
SELECT CAST(floor AS DOUBLE) AS floor, item_id FROM (SELECT c.floor, item_id, row_number() OVER (PARTITION BY c.floor ORDER BY md5('0-' || item_id), item_id) AS rn FROM c JOIN n USING (floor) WHERE above OR NOT use) WHERE rn <= 1000""", "titles"))
def _(spark, d):
    floors = R.table(spark, d, "lineitem").select((F.col("l_linenumber") * 100.0 + 2800).alias("floor")).distinct()
    return K.sample_popular_negatives(floors, R.titles(spark, d))


@query("gram", sql(f"""WITH {LABELS}, x AS (SELECT user_id, greatest(CASE WHEN weak THEN 0.5 ELSE 1.0 END * exp(-ln(2.0) * age / 1100.0), 1e-3) AS w, reward AS y, vec[1] AS a, vec[64] AS b FROM lab JOIN space USING (item_id))
SELECT user_id, CAST(count(*) AS DOUBLE) AS n, round(sum(w), 6) AS sw, round(sum(w * a * a), 6) AS saa, round(sum(w * a * b), 6) AS sab, round(sum(w * y * b), 6) AS sby, round(sum(w * y * y), 6) AS syy FROM x GROUP BY 1""", "log", "space"))
def _(spark, d):
    from ..operators import blocks as B

    rows = labels(spark, d).join(R.space(spark, d), "item_id").select("user_id", F.col("weight").alias("w"), F.col("reward").alias("y"), F.lit(1.0).alias("cnt"), V.doubles(F.col("vec")).alias("vec"))
    m = B.moments(rows, ["user_id"])
    at = lambda i, j: F.round(F.col("packed")[i * 66 - i * (i - 1) // 2 + j - i], 6)  # noqa: E731 - packed triangle of width 66
    return m.select("user_id", "n", at(0, 0).alias("sw"), at(1, 1).alias("saa"), at(1, 64).alias("sab"), at(64, 65).alias("sby"), at(65, 65).alias("syy"))


@query("fit_taste")
def _(spark, d):
    return models(spark, d).select("user_id", "n_obs", "n_real", r6("beta"), r6("y_mean"), r6("log_evidence"))


@query("select_capacity")
def _(spark, d):
    feats = features(spark, d)
    m = K.fit_taste(labels(spark, d), feats, K.sample_negatives(feats), rff_gate=30)
    return m.select("user_id", "n_real", "n_rff", "gamma", r6("log_evidence"))


@query("fit_taste_popular")
def _(spark, d):
    m = K.fit_taste_popular(labels(spark, d), features(spark, d), R.titles(spark, d))
    return m.select("user_id", "n_obs", r6("beta"))


# A model both engines can state: the mean rated vector as weights, one variance for all of them.

AXES = """ax AS (SELECT item_id, unnest(generate_series(0, 63)) AS axis, unnest(vec) AS x FROM space), sp AS (SELECT axis, stddev_pop(x) AS spread FROM ax GROUP BY 1),
  di AS (SELECT l.user_id, axis, avg(x) AS weight FROM log l JOIN ax USING (item_id) WHERE kind = 'rate' GROUP BY 1, 2)"""
PLAIN = AXES + """, dv AS (SELECT item_id, CAST(vec AS DOUBLE[]) AS x, 1 + list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[])) AS e FROM space),
  pm AS (SELECT user_id, list(weight ORDER BY axis) AS w FROM di GROUP BY 1), pv AS (SELECT user_id, 1.0 / (1 + count(*)) AS v FROM log JOIN space USING (item_id) WHERE kind = 'rate' GROUP BY 1),
  plain AS (SELECT user_id, w, v, 0.3 + v AS y FROM pm JOIN pv USING (user_id)),
  pp AS (SELECT user_id, item_id, list_dot_product(w, x) + y AS mean, sqrt(v * e + 0.25) AS sd FROM (SELECT DISTINCT user_id, item_id FROM log) JOIN plain USING (user_id) JOIN dv USING (item_id))"""


def directions(spark, d):
    """Mean rated vector per user as a direction."""
    long = R.space(spark, d).select("item_id", F.posexplode(V.doubles(F.col("vec"))).alias("axis", "x"))
    return R.events(spark, d).filter("kind = 'rate'").select("user_id", "item_id").join(long, "item_id").groupBy("user_id", "axis").agg(F.avg("x").alias("weight"))


def plain_features(spark, d):
    return R.space(spark, d).select("item_id", F.col("vec").cast("array<double>").alias("vec"))


def plain_models(spark, d):
    # As ``directions``, a vector a user instead of a row an axis.
    rated = R.events(spark, d).filter("kind = 'rate'").select("user_id", "item_id").join(plain_features(spark, d).filter("vec is not null"), "item_id")
    mean = rated.groupBy("user_id").agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("vec")))).alias("_w")).withColumn(
        "mean", F.concat(F.array(F.lit(0.0)), F.col("_w")))
    n = R.events(spark, d).filter("kind = 'rate'").join(R.space(spark, d).select("item_id"), "item_id").groupBy("user_id").agg(F.count("*").alias("n_real"))
    v = 1.0 / (1 + F.col("n_real"))
    cov = F.transform(F.sequence(F.lit(0), F.lit(65 * 65 - 1)), lambda i: F.when(i % 66 == 0, v).otherwise(0.0))
    return cut(K.packed(mean.join(n, "user_id").select("user_id", "mean", cov.alias("cov"), F.lit(40.0).alias("alpha"), F.lit(4.0).alias("beta"), F.col("n_real").cast("double").alias("n_obs"),
                                              "n_real", (0.3 + v).alias("y_mean"), F.lit(0.0).alias("log_evidence"), F.lit(0).alias("n_rff"), F.lit(1.0).alias("gamma"))))


def logged_pairs(spark, d):
    return R.events(spark, d).select("user_id", "item_id").distinct()


def tail_sql(z):
    """P(Z > z) of a standard normal: its central half from the density times sum |z|^(2k+1) / (2k+1)!!."""
    z = f"least(greatest({z}, -8.0), 8.0)"
    a = f"greatest(abs({z}), 1e-12)"
    return (f"(0.5 - sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 160), "
            f"lambda k: exp((2 * k + 1) * ln({a}) - lgamma(2 * k + 2) + k * ln(2.0) + lgamma(k + 1)))))")


@query("predict_pairs", sql(f"WITH {PLAIN} SELECT user_id, item_id, round(mean, 6) AS mean, round(sd, 6) AS sd FROM pp", "log", "space"))
def _(spark, d):
    p = K.predict_pairs(logged_pairs(spark, d), plain_features(spark, d), plain_models(spark, d))
    return p.select("user_id", "item_id", r6("mean"), r6("sd"))


@query("predict_pairs_fitted")
def _(spark, d):
    feats = features(spark, d)
    p = K.predict_pairs(logged_pairs(spark, d), feats, models(spark, d, feats))
    return p.select("user_id", "item_id", r6("mean"), r6("sd"))


PLANE = f"""WITH {LABELS}, x AS (SELECT user_id, greatest(CASE WHEN weak THEN 0.5 ELSE 1.0 END * exp(-ln(2.0) * age / 1100.0), 1e-3) AS w, reward AS y, CAST(vec[1] AS DOUBLE) AS a, CAST(vec[2] AS DOUBLE) AS b, weak FROM lab JOIN space USING (item_id)),
  m AS (SELECT user_id, count(*) AS n, sum(w) AS s0, sum(w * a) AS sa, sum(w * b) AS sb, sum(w * a * a) AS saa, sum(w * a * b) AS sab, sum(w * b * b) AS sbb, sum(w * y) AS sy, sum(w * y * a) AS sya, sum(w * y * b) AS syb, sum(w * y * y) AS syy
    FROM x GROUP BY 1 HAVING count(*) FILTER (WHERE NOT weak) >= 3),
  g AS (SELECT user_id, n, sy / s0 AS ym, n / s0 * s0 + 10 AS a11, n / s0 * sa AS a12, n / s0 * sb AS a13, n / s0 * saa + 10 AS a22, n / s0 * sab AS a23, n / s0 * sbb + 10 AS a33,
    n / s0 * (sya - sy / s0 * sa) AS r2, n / s0 * (syb - sy / s0 * sb) AS r3, n / s0 * (syy - sy * sy / s0) AS yy FROM m),
  i AS (SELECT *, a22 * a33 - a23 * a23 AS i11, a13 * a23 - a12 * a33 AS i12, a12 * a23 - a13 * a22 AS i13, a11 * a33 - a13 * a13 AS i22, a12 * a13 - a11 * a23 AS i23, a11 * a22 - a12 * a12 AS i33 FROM g),
  c AS (SELECT *, a11 * i11 + a12 * i12 + a13 * i13 AS det FROM i),
  s AS (SELECT *, (i12 * r2 + i13 * r3) / det AS c1, (i22 * r2 + i23 * r3) / det AS c2, (i23 * r2 + i33 * r3) / det AS c3, 3 - 10 * (i11 + i22 + i33) / det AS known FROM c),
  f AS (SELECT *, yy - c2 * r2 - c3 * r3 - 10 * (c1 * c1 + c2 * c2 + c3 * c3) AS left_, c1 * c1 + c2 * c2 + c3 * c3 AS cc FROM s),
  b AS (SELECT *, least(greatest(greatest(n - known, 1e-6) / greatest(left_, 1e-12), 1e-4), 1e6) AS beta FROM f)
SELECT user_id, CAST(n AS DOUBLE) AS n_obs, round(c1, 6) AS w0, round(c2, 6) AS w1, round(c3, 6) AS w2, round(beta, 4) AS beta, round(ym, 6) AS y_mean,
  round(0.5 * (3 * ln(10.0) - ln(det) + n * ln(beta / (2 * pi())) - beta * (greatest(left_, 1e-12) + 10 * cc)), 5) AS log_evidence FROM b"""


@query("fit_taste_plane", sql(PLANE, "log", "space"))
def _(spark, d):
    """The fit on two features, a 3 x 3 solve that SQL can write out."""
    feats = cut(R.space(spark, d).select("item_id", F.slice(F.col("vec").cast("array<double>"), 1, 2).alias("vec")))
    m = K.fit_taste(labels(spark, d), feats, None, allow_rff=False)
    return m.select("user_id", "n_obs", *[r6(F.col("mean")[k], f"w{k}") for k in range(3)], F.round("beta", 4).alias("beta"), r6("y_mean"), F.round("log_evidence", 5).alias("log_evidence"))


@query("thompson_scores")
def _(spark, d):
    feats = features(spark, d)
    return K.thompson_scores(models(spark, d, feats), feats, 10, F.lit("s1")).select("user_id", "item_id", "rank")


@query("ucb_scores", sql(f"WITH {PLAIN} SELECT user_id, item_id, round(mean + sd, 6) AS score FROM pp", "log", "space"))
def _(spark, d):
    p = K.ucb_scores(logged_pairs(spark, d), plain_features(spark, d), plain_models(spark, d))
    return p.select("user_id", "item_id", r6("score"))


@query("like_probability", f"SELECT event_id, round({tail_sql('((0.75 - value / 50) / 0.2)')}, 6) AS p FROM events")
def _(spark, d):
    e = R.table(spark, d, "events")
    return e.select("event_id", r6(K.like_probability(F.col("value") / 50, F.lit(0.2)), "p"))


@query("ridge_like_probability", "SELECT event_id, round(1 / (1 + exp(-(value / 50 - 0.75) * 5.0)), 9) AS p FROM events")
def _(spark, d):
    return R.table(spark, d, "events").select("event_id", F.round(S.ridge_like_probability(F.col("value") / 50), 9).alias("p"))


@query("credible_interval", "SELECT event_id, least(greatest((value / 50 - 1.645 * 0.2) * 10.0, 0.0), 10.0) AS low, least(greatest((value / 50 + 1.645 * 0.2) * 10.0, 0.0), 10.0) AS high FROM events")
def _(spark, d):
    low, high = S.credible_interval(F.col("value") / 50, F.lit(0.2))
    return R.table(spark, d, "events").select("event_id", low.alias("low"), high.alias("high"))


@query("taste_direction", sql(f"WITH {AXES} SELECT user_id, axis, round(weight, 6) AS weight FROM di", "log", "space"))
def _(spark, d):
    return K.taste_direction(plain_models(spark, d), 64).select("user_id", F.col("axis").cast("long").alias("axis"), r6("weight"))


@query("surface_preferences", sql(f"""WITH {SIDE}, m AS (SELECT user_id, {", ".join(f"avg(s{i}) AS s{i}" for i in range(5))} FROM log JOIN si USING (item_id) WHERE kind = 'rate' GROUP BY 1)
{" UNION ALL ".join(f"SELECT user_id, '{name}' AS name, round(s{i}, 6) AS weight FROM m" for i, name in enumerate(dims.SIDE_FEATURES))}""", "titles", "log", "space"))
def _(spark, d):
    """The side part of a model whose weights are the mean rated feature vector."""
    long = features(spark, d).select("item_id", F.posexplode("vec").alias("axis", "x"))
    mean = R.events(spark, d).filter("kind = 'rate'").select("user_id", "item_id").join(long, "item_id").groupBy("user_id", "axis").agg(F.avg("x").alias("x"))
    model = mean.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("axis", "x"))).alias("w")).select(
        "user_id", F.concat(F.array(F.lit(0.0)), F.transform("w", lambda v: v["x"])).alias("mean"), F.lit(0).alias("n_rff"))
    return K.surface_preferences(model, 64).select("user_id", "name", r6("weight"))


@query("ridge_baseline")
def _(spark, d):
    feats = features(spark, d)
    return K.ridge_baseline(labels(spark, d), feats, K.sample_negatives(feats)).select("user_id", "alpha", r6("b"))


# --- slates: a plain scored frame stands in for a model where the step is checkable ---


def scored(spark, d):
    """Order lines as each customer's scored candidates."""
    r = R.ratings(spark, d).join(R.titles(spark, d).select(F.col("item_id").alias("movie_id"), "language", "imdb_votes", "quality"), "movie_id")
    return r.select("user_id", F.col("movie_id").alias("item_id"), "language", "imdb_votes", (F.col("rating") * F.col("quality")).alias("score"), F.col("rating").alias("mean"), F.col("quality").alias("affinity"))


SCORED = "sc AS (SELECT user_id, movie_id AS item_id, language, imdb_votes, rating * quality AS score, rating AS mean, quality AS affinity FROM ratings JOIN titles ON item_id = movie_id)"


def ranked(spark, d):
    return L.top_k_scored(scored(spark, d), 30)


RANKED = SCORED + ", rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM sc) WHERE rank <= 30)"


@query("top_k_scored", sql(f"WITH {RANKED} SELECT user_id, item_id, rank FROM rk", "titles", "ratings"))
def _(spark, d):
    return ranked(spark, d).select("user_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("shortlist", sql(f"""WITH {SCORED} SELECT DISTINCT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY mean DESC, item_id) AS b FROM sc) WHERE a <= 20 OR b <= 64""", "titles", "ratings"))
def _(spark, d):
    return L.shortlist(scored(spark, d), 1, 20).select("user_id", "item_id")


@query("union_pool", sql(f"WITH {SCORED} SELECT user_id, item_id FROM sc WHERE score > 2 UNION SELECT user_id, item_id FROM sc WHERE mean > 4", "titles", "ratings"))
def _(spark, d):
    s = scored(spark, d).select("user_id", "item_id", "score", "mean")
    return s.filter("score > 2").union(s.filter("mean > 4")).select("user_id", "item_id").distinct()


@query("mood_adjust", sql(f"""WITH {SCORED}, st AS (SELECT user_id, avg(affinity) AS m, stddev_pop(affinity) AS d, stddev_pop(score) AS s FROM sc GROUP BY 1)
SELECT user_id, item_id, round(score + 0.6 * s * (affinity - m) / (d + 1e-9), 6) AS score FROM sc JOIN st USING (user_id)""", "titles", "ratings"))
def _(spark, d):
    return L.mood_adjust(scored(spark, d)).select("user_id", "item_id", r6("score"))


@query("novelty_adjust", sql(f"""WITH {SCORED}, x AS (SELECT *, ln(1 + coalesce(imdb_votes, 0)) AS e FROM sc), st AS (SELECT user_id, avg(e) AS m, stddev_pop(e) AS d, stddev_pop(score) AS s FROM x GROUP BY 1)
SELECT user_id, item_id, round(score - 0.4 * s * (e - m) / (d + 1e-9), 6) AS score FROM x JOIN st USING (user_id)""", "titles", "ratings"))
def _(spark, d):
    return L.novelty_adjust(scored(spark, d), 0.4).select("user_id", "item_id", r6("score"))


@query("language_quota", sql(f"""WITH {RANKED}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, language ORDER BY rank) > 2 AS ov FROM rk),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ov, rank) - 1 AS position FROM o) SELECT user_id, item_id, position FROM p WHERE position < 10""", "titles", "ratings"))
def _(spark, d):
    return L.language_quota(ranked(spark, d), 10, 0.25).select("user_id", "item_id", F.col("position").cast("long").alias("position"))


@query("propensity", sql(f"""WITH {RANKED}, st AS (SELECT user_id, max(score) AS m, greatest(stddev_pop(score), 1e-3) AS t FROM rk GROUP BY 1), e AS (SELECT user_id, item_id, exp((score - m) / t) AS e FROM rk JOIN st USING (user_id))
SELECT user_id, item_id, round(e / sum(e) OVER (PARTITION BY user_id), 9) AS propensity FROM e""", "titles", "ratings"))
def _(spark, d):
    return L.propensity(ranked(spark, d)).select("user_id", "item_id", F.round("propensity", 9).alias("propensity"))


@query("explored_flag", sql(f"""WITH {RANKED}, m AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean DESC, item_id) AS rn FROM sc) WHERE rn <= 10)
SELECT rk.user_id, rk.item_id, m.item_id IS NULL AS explored FROM rk LEFT JOIN m USING (user_id, item_id)""", "titles", "ratings"))
def _(spark, d):
    return L.explored_flag(ranked(spark, d), scored(spark, d), 10).select("user_id", "item_id", "explored")


REASON = f"""{LABELS}, lk AS (SELECT user_id, item_id AS liked_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY reward DESC, item_id) AS rn FROM lab WHERE reward >= 0.2) WHERE rn <= 60),
  sl AS (SELECT DISTINCT user_id, item_id FROM log WHERE kind = 'unseen')"""


@query("reasons", sql(f"""WITH {REASON}, s AS (SELECT sl.user_id, sl.item_id, liked_id, list_dot_product(a.vec, b.vec) AS s FROM sl JOIN lk USING (user_id) JOIN space a ON a.item_id = sl.item_id JOIN space b ON b.item_id = liked_id)
SELECT user_id, item_id, liked_id, rank, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY s DESC, liked_id) AS rank FROM s) WHERE rank <= 3 AND s >= 0.15""", "log", "space"))
def _(spark, d):
    liked = E.liked_titles(labels(spark, d), R.titles(spark, d), 0.2, 60)
    slate = R.events(spark, d).filter("kind = 'unseen'").select("user_id", "item_id").distinct()
    return L.reasons(slate, liked, R.space(spark, d)).select("user_id", "item_id", "liked_id", F.col("rank").cast("long").alias("rank"), r6("similarity"))


@query("mmr")
def _(spark, d):
    feats = features(spark, d)
    return L.mmr(ranked(spark, d).drop("rank"), feats, 10).select("user_id", "item_id", "rank")


# Greedy choices, written out pick by pick.
PICKED = """pk AS (SELECT DISTINCT {by}, 0 AS n, CAST([] AS BIGINT[]) AS ids, CAST([] AS DOUBLE[][]) AS vecs, CAST(NULL AS BIGINT) AS item_id FROM cd
    UNION ALL SELECT {by}, n + 1, list_append(ids, item_id), list_append(vecs, x), item_id FROM (
      SELECT pk.{by}, pk.n, ids, vecs, cd.item_id, x, row_number() OVER (PARTITION BY pk.{by} ORDER BY worth - {weight} * coalesce(list_max(list_transform(vecs, lambda u: {alike})), 0.0) DESC, {ties}) AS rn
      FROM pk JOIN cd ON cd.{by} = pk.{by} WHERE pk.n < {k} AND NOT list_contains(ids, cd.item_id)) WHERE rn = 1)"""


@query("mmr_plain", sql(f"""WITH RECURSIVE {RANKED}, cd AS (SELECT user_id, item_id, 0.72 * score AS worth, score, CAST(vec AS DOUBLE[]) AS x FROM rk JOIN space USING (item_id)),
  {PICKED.format(by="user_id", weight="0.28", alike="greatest(list_dot_product(u, x), 0.0)", ties="score DESC, cd.item_id", k=10)}
SELECT user_id, item_id, n AS rank FROM pk WHERE n > 0""", "titles", "ratings", "space"))
def _(spark, d):
    latent = R.space(spark, d).select("item_id", F.col("vec").cast("array<double>").alias("latent"))
    return L.mmr(ranked(spark, d).drop("rank"), latent, 10).select("user_id", "item_id", "rank")


def _recommend(spark, d, **kw):
    t = cut(R.titles(spark, d))
    feats = features(spark, d, t)
    return L.recommend(models(spark, d, feats), feats, t, E.excluded(R.events(spark, d)), **kw).select(
        "user_id", "item_id", "position", r6("score"), r6("mean"), r6("sd"), F.round("propensity", 9).alias("propensity"), "explored")


@query("recommend_mean")
def _(spark, d):
    return _recommend(spark, d, strategy="mean")


@query("recommend_thompson")
def _(spark, d):
    return _recommend(spark, d, strategy="thompson", novelty=0.3, slate=F.lit("s1"))


@query("recommend_ucb")
def _(spark, d):
    sp = R.space(spark, d)
    last = F.max_by(F.get_json_object("props", "$.k").cast("long"), F.struct("ts", "event_id"))
    moods = R.table(spark, d, "events").groupBy("user_id").agg(last.alias("item_id")).join(sp, "item_id").select("user_id", F.col("vec").alias("mood"))
    return _recommend(spark, d, strategy="ucb", moods=moods, filters={"kind": "movie"})


@query("produce_slate", sql(f"""WITH {RANKED}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, language ORDER BY rank) > 2 AS ov FROM rk),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ov, rank) - 1 AS position FROM o)
SELECT user_id, item_id, 'slate-' || user_id AS slate_id, position, 'bayesian-mean-v1:both' AS policy, strftime(TIMESTAMP '{R.AS_OF}', '%Y-%m-%d') AS day FROM p WHERE position < 10""", "titles", "ratings"))
def _(spark, d):
    """The ranked lines of each customer as a slate under the language quota, logged as shown."""
    slate = L.language_quota(ranked(spark, d), 10, 0.25).withColumns({"propensity": F.lit(1.0), "explored": F.lit(False)})
    out = L.produce_slate(slate, L.policy_label("mean", None), F.concat(F.lit("slate-"), F.col("user_id").cast("string")), R.as_of())
    return out.select("user_id", "item_id", "slate_id", F.col("position").cast("long").alias("position"), "policy", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("judge_plain", sql(f"""WITH {PLAIN}, t AS (SELECT *, {tail_sql('((0.75 - mean) / greatest(sd, 1e-6))')} AS p FROM pp)
SELECT user_id, item_id, round(least(greatest(mean * 10, 0.0), 10.0), 5) AS score, round(least(greatest((mean - 1.645 * sd) * 10, 0.0), 10.0), 5) AS interval_low,
  round(least(greatest((mean + 1.645 * sd) * 10, 0.0), 10.0), 5) AS interval_high, round(p, 6) AS like_probability FROM t""", "log", "space"))
def _(spark, d):
    j = L.judge(logged_pairs(spark, d), plain_features(spark, d), plain_models(spark, d))
    return j.select("user_id", "item_id", *[F.round(c, 5).alias(c) for c in ("score", "interval_low", "interval_high")], r6("like_probability"))


@query("judge")
def _(spark, d):
    feats, labs = features(spark, d), labels(spark, d)
    ridge = K.ridge_baseline(labs, feats, K.sample_negatives(feats))
    pairs = R.events(spark, d).filter("kind = 'unseen'").select("user_id", "item_id").distinct()
    return L.judge(pairs, feats, models(spark, d, feats, labs), ridge).select(
        "user_id", "item_id", r6("score"), r6("interval_low"), r6("interval_high"), r6("like_probability"), "likely_like", r6("ridge_score"))


# --- cold start ---


SPREAD = """cd AS (SELECT language, item_id, greatest(CASE WHEN coalesce(quality, 0.0) = 0.0 THEN 0.5 ELSE quality END, 0.05) AS q, list_transform(CAST(vec AS DOUBLE[]), lambda v: v * greatest(CASE WHEN coalesce(quality, 0.0) = 0.0 THEN 0.5 ELSE quality END, 0.05)) AS r
    FROM titles JOIN space USING (item_id)),
  st AS (SELECT DISTINCT language, 0 AS n, CAST([] AS BIGINT[]) AS ids, CAST([] AS DOUBLE[][]) AS dirs, CAST(NULL AS BIGINT) AS item_id FROM cd
    UNION ALL SELECT language, n + 1, list_append(ids, item_id), list_append(dirs, list_transform(r, lambda v, k: (v - coalesce(list_sum(list_transform(dirs, lambda u: list_dot_product(u, r) * u[k])), 0.0)) / sqrt(greatest(rest, 1e-9)))), item_id FROM (
      SELECT st.language, n, ids, dirs, cd.item_id, r, q * q - coalesce(list_sum(list_transform(dirs, lambda u: pow(list_dot_product(u, r), 2))), 0.0) AS rest,
        row_number() OVER (PARTITION BY st.language ORDER BY q * q - coalesce(list_sum(list_transform(dirs, lambda u: pow(list_dot_product(u, r), 2))), 0.0) DESC, cd.item_id) AS rn
      FROM st JOIN cd ON cd.language = st.language WHERE n < 5 AND NOT list_contains(ids, cd.item_id)) WHERE rn = 1 AND (n = 0 OR rest >= 1e-9))"""


@query("greedy_dpp", sql(f"WITH RECURSIVE {SPREAD} SELECT item_id, language, n AS pick FROM st WHERE n > 0", "titles", "space"))
def _(spark, d):
    pool = R.titles(spark, d).join(R.space(spark, d), "item_id").select("item_id", "language", "quality", "vec")
    quotas = pool.groupBy("language").agg(F.least(F.lit(5), F.count("*")).cast("int").alias("quota"))
    return Q.greedy_dpp(pool, quotas)


@query("seed_questions")
def _(spark, d):
    return Q.seed_questions(R.titles(spark, d), R.space(spark, d), 24, least=5, min_titles=3)


def _pool(spark, d, feats):
    known = R.titles(spark, d).join(R.space(spark, d).select("item_id"), "item_id", "left_semi")
    return cut(C.recognisable_pool(known, least=10, min_titles=3).select("item_id").join(feats, "item_id"))


GAINS = PLAIN + """, pool AS (SELECT item_id, x, e FROM dv JOIN titles USING (item_id) WHERE imdb_votes >= 3000), sd AS (SELECT DISTINCT user_id, item_id FROM log WHERE kind = 'rate'),
  qq AS (SELECT p.item_id, any_value(p.e) AS e, avg(pow(1 + list_dot_product(p.x, r.x), 2)) AS q FROM pool p, dv r GROUP BY 1),
  ga AS (SELECT user_id, item_id, v, e, q FROM plain, qq WHERE (user_id, item_id) NOT IN (SELECT user_id, item_id FROM sd))"""


def _gain_inputs(spark, d):
    feats = plain_features(spark, d)
    pool = R.titles(spark, d).filter("imdb_votes >= 3000").select("item_id").join(feats, "item_id")
    return plain_models(spark, d), cut(pool), R.events(spark, d).filter("kind = 'rate'").select("user_id", "item_id").distinct()


@query("information_gain", sql(f"WITH {GAINS} SELECT user_id, item_id, round(0.5 * ln(1 + 4 * v * e), 6) AS gain FROM ga", "titles", "log", "space"))
def _(spark, d):
    return Q.information_gain(*_gain_inputs(spark, d)).select("user_id", "item_id", r6("gain"))


@query("variance_reduction", sql(f"WITH {GAINS} SELECT user_id, item_id, round(4 * v * v * q / (1 + 4 * v * e), 6) AS gain FROM ga", "titles", "log", "space"))
def _(spark, d):
    return Q.variance_reduction(*_gain_inputs(spark, d), plain_features(spark, d)).select("user_id", "item_id", r6("gain"))


@query("next_questions_plain", sql(f"""WITH RECURSIVE {GAINS}, cd AS (SELECT user_id, item_id, 4 * v * v * q / (1 + 4 * v * ga.e) AS worth, x FROM ga JOIN dv USING (item_id)),
  {PICKED.format(by="user_id", weight="0.55", alike="abs(list_dot_product(u, x))", ties="cd.item_id", k=8)}
SELECT user_id, item_id, n AS pick FROM pk WHERE n > 0""", "titles", "log", "space"))
def _(spark, d):
    model, pool, asked = _gain_inputs(spark, d)
    return Q.next_questions(model, pool.withColumn("latent", F.col("vec")), asked, plain_features(spark, d)).select("user_id", "item_id", "pick")


@query("next_questions")
def _(spark, d):
    feats = features(spark, d)
    return Q.next_questions(models(spark, d, feats), _pool(spark, d, feats), E.already_asked(R.events(spark, d)), feats).select("user_id", "item_id", "pick")


@query("question_batch")
def _(spark, d):
    ev, t = R.events(spark, d), cut(R.titles(spark, d))
    return Q.question_batch(ev, ev.select("user_id"), t, features(spark, d, t), R.space(spark, d), least=10, min_titles=3)


# --- discovery ---


@query("term_counts", sql(f"WITH {TERMS} SELECT term, count(*) AS n FROM terms GROUP BY 1", "titles"))
def _(spark, d):
    return D.term_counts(R.titles(spark, d))


POLES = """w AS (SELECT lang, quality, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS term FROM documents JOIN labels USING (doc_id)),
  po AS (SELECT lang, term, count(*) FILTER (WHERE quality = 1) AS a, count(*) FILTER (WHERE quality = 0) AS b FROM w GROUP BY 1, 2),
  bg AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY 1)"""


@query("log_odds_terms", f"""WITH {POLES}, s AS (SELECT lang, sum(a) AS na, sum(b) AS nb FROM po GROUP BY 1), x AS (SELECT po.*, na, nb, 500.0 * n / (SELECT sum(n) FROM bg) AS p FROM po JOIN s USING (lang) JOIN bg USING (term) WHERE a + b >= 3),
  z AS (SELECT lang, term, (ln((a + p) / (na + 500.0 - a - p)) - ln((b + p) / (nb + 500.0 - b - p))) / sqrt(1.0 / (a + p) + 1.0 / (b + p)) AS z FROM x)
SELECT lang, rank, round(z, 6) AS z FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY z DESC, term DESC) AS rank FROM z) WHERE rank <= 8""")
def _(spark, d):
    docs = R.table(spark, d, "documents").select("doc_id", "lang", F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")).alias("term"))
    poles = docs.join(R.table(spark, d, "labels").select("doc_id", "quality"), "doc_id").groupBy("lang", "term").agg(
        F.count_if(F.col("quality") == 1).alias("a"), F.count_if(F.col("quality") == 0).alias("b"))
    background = docs.groupBy("term").agg(F.count("*").alias("n"))
    return D.log_odds_terms(poles, background, ("lang",)).select("lang", F.col("rank").cast("long").alias("rank"), r6("z"))


@query("axis_strength", sql(f"""WITH {AXES} SELECT user_id, axis, rank, round(st, 6) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY st DESC, axis) AS rank FROM (SELECT user_id, axis, abs(weight) * spread AS st FROM di JOIN sp USING (axis))) WHERE rank <= 6""", "log", "space"))
def _(spark, d):
    return D.axis_strength(directions(spark, d), R.space(spark, d)).select("user_id", F.col("axis").cast("long").alias("axis"), F.col("rank").cast("long").alias("rank"), r6("strength"))


@query("axis_poles", sql(f"""WITH {AXES}, r AS (SELECT axis, item_id, row_number() OVER (PARTITION BY axis ORDER BY x, item_id) AS lo, row_number() OVER (PARTITION BY axis ORDER BY x DESC, item_id DESC) AS hi FROM ax)
SELECT axis, item_id, 'low' AS pole FROM r WHERE lo <= 40 UNION ALL SELECT axis, item_id, 'high' FROM r WHERE hi <= 40""", "log", "space"))
def _(spark, d):
    return D.axis_poles(R.space(spark, d), directions(spark, d).select("axis"), 40).select(F.col("axis").cast("long").alias("axis"), "item_id", "pole")


def _described(spark, d):
    t = cut(R.titles(spark, d))
    return D.describe_axes(models(spark, d, features(spark, d, t)), R.space(spark, d), t, 64, pole=60)


@query("describe_axes")
def _(spark, d):
    return _described(spark, d).select("user_id", "axis", "rank", r6("weight"), F.array_join("liked_terms", "|").alias("liked"), F.array_join("other_terms", "|").alias("other"), F.array_join("liked_examples", "|").alias("examples"))


@query("taste_summary")
def _(spark, d):
    return D.taste_summary(_described(spark, d))
