"""Evaluation queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as P
from ..operators import events as E
from ..operators import taste as K
from ..operators import timeline as Z
from ..session import cut, landed
from . import roles as R
from .events import LOOSE, SEQ
from .registry import query
from .roles import sql
from .vectors import HOLD, features, labels, models, r6


def links(spark, d):
    return R.titles(spark, d).filter("movielens_id is not null").select((F.col("movielens_id") - 200000).alias("movie_id"), "item_id")


def histories(spark, d, least=15):
    """Ratings whose items are catalogue titles; every user is eligible."""
    r = R.ratings(spark, d).withColumnRenamed("movie_id", "item_id").select("user_id", "item_id", "rating")
    known = r.join(R.titles(spark, d).select("item_id"), "item_id", "left_semi")
    users = known.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("user_id")
    return known.join(users, "user_id", "left_semi")


HIST = "hi AS (SELECT r.user_id, movie_id AS item_id, rating FROM ratings r JOIN (SELECT user_id FROM ratings GROUP BY 1 HAVING count(*) >= 15) USING (user_id))"
SPLIT = HIST + """, pl AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('0-' || user_id || '-' || item_id), item_id) - 1 AS b, count(*) OVER (PARTITION BY user_id) AS n FROM hi),
  spl AS (SELECT user_id, item_id, rating, b < floor(n * 0.6) AS known FROM pl)"""
ANS = SPLIT + """, an AS (SELECT user_id, item_id, least(greatest((rating - 0.5) / 4.5, 0.0), 1.0) AS reward FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('answer-0-' || user_id || '-' || item_id), item_id) AS rn FROM spl WHERE known) WHERE rn <= 10)"""
REL = "re AS (SELECT user_id, item_id, rating - 3.0 AS relevance FROM spl WHERE NOT known AND rating >= 4)"


@query("user_histories", sql(f"""WITH {HOLD}, m AS (SELECT r.user_id, t.item_id, rating FROM ratings r JOIN titles t ON t.movielens_id - 200000 = r.movie_id WHERE r.user_id IN (SELECT user_id FROM ho)),
  u AS (SELECT user_id FROM m GROUP BY 1 HAVING count(*) >= 20 ORDER BY md5('0-' || user_id), user_id LIMIT 50) SELECT * FROM m WHERE user_id IN (SELECT user_id FROM u)""", "titles", "ratings"))
def _(spark, d):
    from ..operators import itemspace as I

    r = R.ratings(spark, d)
    return P.user_histories(r, links(spark, d), I.choose_holdout(r, 100), 50, 20)


@query("split_history", sql(f"WITH {SPLIT} SELECT user_id, item_id, known FROM spl", "ratings"))
def _(spark, d):
    return P.split_history(histories(spark, d)).select("user_id", "item_id", "known")


def _answers(spark, d):
    return cut(P.answers(P.split_history(histories(spark, d)).filter("known"), 10))


def _held(spark, d):
    """The held-out ratings, stored for slates and relevance alike."""
    return landed(P.split_history(histories(spark, d)).filter("not known").select("user_id", "item_id", "rating"), "held")


def _rel(spark, d, held=None):
    return P.relevance(held if held is not None else _held(spark, d))


@query("answers", sql(f"WITH {ANS} SELECT user_id, item_id, round(reward, 9) AS reward FROM an", "ratings"))
def _(spark, d):
    return _answers(spark, d).select("user_id", "item_id", F.round("reward", 9).alias("reward"))


@query("relevance", sql(f"WITH {SPLIT}, {REL} SELECT * FROM re", "ratings"))
def _(spark, d):
    return _rel(spark, d)


def arm_answers(spark, d):
    """Answers on items the space holds, from the verdict log."""
    last = E.latest_rating(R.events(spark, d)).select("user_id", "item_id", (F.col("value") / 10).alias("reward"))
    return cut(last.join(R.space(spark, d).select("item_id"), "item_id", "left_semi"))


def arm_items(spark, d):
    t = cut(R.titles(spark, d))
    return cut(features(spark, d, t).join(t.select("item_id", "imdb_votes", "quality", "language"), "item_id"))


ARM = "la AS (SELECT user_id, item_id, value / 10 AS reward FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, event_id DESC) AS rn FROM log WHERE kind = 'rate' AND value IS NOT NULL) WHERE rn = 1 AND item_id IN (SELECT item_id FROM space))"
RANK = "SELECT user_id, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM ({body}) x WHERE NOT EXISTS (SELECT 1 FROM la WHERE la.user_id = x.user_id AND la.item_id = x.item_id)) WHERE rank <= 10"
ITEMS = "it AS (SELECT t.item_id, imdb_votes, quality, vec FROM titles t JOIN space USING (item_id))"


def _rank(df):
    return df.select("user_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("arm_popularity", sql(f"WITH {ARM}, {ITEMS} " + RANK.format(body="SELECT u.user_id, item_id, coalesce(imdb_votes, 0) AS score FROM (SELECT DISTINCT user_id FROM la) u, it"), "titles", "log", "space"))
def _(spark, d):
    return _rank(P.arm_popularity(arm_answers(spark, d), arm_items(spark, d)))


@query("arm_quality", sql(f"WITH {ARM}, {ITEMS} " + RANK.format(body="SELECT u.user_id, item_id, quality AS score FROM (SELECT DISTINCT user_id FROM la) u, it"), "titles", "log", "space"))
def _(spark, d):
    return _rank(P.arm_quality(arm_answers(spark, d), arm_items(spark, d)))


@query("arm_centroid", sql(f"""WITH {ARM}, {ITEMS}, ce AS (SELECT user_id, list(m ORDER BY pos) AS c FROM (SELECT user_id, pos, avg(x) AS m FROM (SELECT user_id, unnest(generate_series(1, 64)) AS pos, unnest(vec) AS x FROM la JOIN space USING (item_id) WHERE reward >= 0.2) GROUP BY 1, 2) GROUP BY 1) """
       + RANK.format(body="SELECT user_id, item_id, list_dot_product(vec, c) AS score FROM ce, it UNION ALL SELECT u.user_id, item_id, quality FROM (SELECT DISTINCT user_id FROM la WHERE user_id NOT IN (SELECT user_id FROM ce)) u, it"), "titles", "log", "space"))
def _(spark, d):
    return _rank(P.arm_centroid(arm_answers(spark, d), arm_items(spark, d), at=0.2))


@query("arm_weighted_knn", sql(f"""WITH {ARM}, {ITEMS}, si AS (SELECT la.user_id, it.item_id, la.reward, greatest(list_dot_product(it.vec, a.vec), 0.0) AS s, row_number() OVER (PARTITION BY la.user_id, it.item_id ORDER BY list_dot_product(it.vec, a.vec) DESC) AS rn
    FROM la JOIN space a USING (item_id), it) """ + RANK.format(body="SELECT user_id, item_id, round(sum(s * reward), 9) AS score FROM si WHERE rn <= 5 GROUP BY 1, 2"), "titles", "log", "space"))
def _(spark, d):
    return _rank(P.arm_weighted_knn(arm_answers(spark, d), arm_items(spark, d), near=5))


def _arm(name):
    def run(spark, d):
        return _rank(P.ARMS[name](arm_answers(spark, d), arm_items(spark, d)))
    return run


query("arm_ridge")(_arm("ridge"))
query("arm_taste")(_arm("taste"))
query("arm_taste_no_negatives")(_arm("taste-no-negatives"))
query("arm_taste_popular_negatives")(_arm("taste-popular-negatives"))

# --- metrics: each user's slate is their ten best-known unseen titles by a hash order ---


def slates(spark, d, held=None):
    """Two arms per user over the held-out and unrated titles they are shown."""
    from pyspark.sql import Window

    held = (held if held is not None else _held(spark, d)).select("user_id", "item_id")
    rows = held.withColumn("arm", F.explode(F.array(F.lit("a"), F.lit("b"))))
    w = Window.partitionBy("user_id", "arm").orderBy(F.md5(F.concat_ws("-", "arm", F.col("user_id").cast("string"), F.col("item_id").cast("string"))), "item_id")
    return landed(rows.withColumn("rank", F.row_number().over(w)).filter("rank <= 10"), "slates")


def _shown(spark, d):
    """Slates and relevance of the same held-out ratings."""
    held = _held(spark, d)
    return slates(spark, d, held), _rel(spark, d, held)


SLATES = SPLIT + ", " + REL + """, sla AS (SELECT * FROM (SELECT user_id, arm, item_id, row_number() OVER (PARTITION BY user_id, arm ORDER BY md5(arm || '-' || user_id || '-' || item_id), item_id) AS rank FROM spl, (VALUES ('a'), ('b')) v(arm) WHERE NOT known) WHERE rank <= 10),
  hx AS (SELECT sla.*, coalesce(relevance, 0.0) AS rel, CASE WHEN relevance > 0 THEN 1 ELSE 0 END AS hit FROM sla LEFT JOIN re USING (user_id, item_id)),
  idl AS (SELECT user_id, sum(relevance / log2(rn + 1.0)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY relevance DESC, item_id) AS rn FROM re) WHERE rn <= 10 GROUP BY 1), po AS (SELECT user_id, count(*) AS np FROM re GROUP BY 1)"""
PER = "FROM hx LEFT JOIN idl USING (user_id) LEFT JOIN po USING (user_id) GROUP BY user_id, arm"


@query("ndcg_at_k", sql(f"WITH {SLATES} SELECT user_id, arm, round(coalesce(sum(rel / log2(rank + 1.0)) / max(ideal), 0.0), 9) AS ndcg {PER}", "ratings"))
def _(spark, d):
    return P.ndcg_at_k(*_shown(spark, d)).select("user_id", "arm", F.round("ndcg", 9).alias("ndcg"))


@query("precision_recall", sql(f'WITH {SLATES} SELECT user_id, arm, sum(hit) / 10 AS precision, round(coalesce(sum(hit) / max(np), 0.0), 9) AS recall {PER}', "ratings"))
def _(spark, d):
    return P.precision_recall(*_shown(spark, d)).select("user_id", "arm", "precision", F.round("recall", 9).alias("recall"))


@query("average_precision", sql(f"WITH {SLATES}, ru AS (SELECT *, sum(hit) OVER (PARTITION BY user_id, arm ORDER BY rank) AS c FROM hx) SELECT user_id, arm, round(coalesce(sum(hit * c / rank) / least(max(np), 10), 0.0), 9) AS map FROM ru LEFT JOIN po USING (user_id) GROUP BY 1, 2", "ratings"))
def _(spark, d):
    return P.average_precision(*_shown(spark, d)).select("user_id", "arm", F.round("map", 9).alias("map"))


@query("reciprocal_rank", sql(f"WITH {SLATES} SELECT user_id, arm, round(coalesce(1.0 / min(CASE WHEN hit = 1 THEN rank END), 0.0), 9) AS mrr {PER}", "ratings"))
def _(spark, d):
    return P.reciprocal_rank(*_shown(spark, d)).select("user_id", "arm", F.round("mrr", 9).alias("mrr"))


def popularity(spark, d):
    return R.titles(spark, d).select("item_id", F.coalesce("imdb_votes", F.lit(0)).alias("popularity"))


@query("novelty", sql(f"WITH {SLATES} SELECT user_id, arm, round(avg(-log2((coalesce(imdb_votes, 0) + 1) / (SELECT sum(imdb_votes) FROM titles))), 6) AS novelty FROM sla JOIN titles USING (item_id) GROUP BY 1, 2", "titles", "ratings"))
def _(spark, d):
    return P.novelty(slates(spark, d), popularity(spark, d)).select("user_id", "arm", r6("novelty"))


@query("self_information", sql("SELECT item_id, round(-log2((coalesce(imdb_votes, 0) + 1) / 1000000), 9) AS bits FROM titles", "titles"))
def _(spark, d):
    from ..functions import scalar as S

    return R.titles(spark, d).select("item_id", F.round(S.self_information(F.col("imdb_votes"), F.lit(1000000)), 9).alias("bits"))


@query("intra_list_diversity", sql(f"""WITH {SLATES}, v AS (SELECT user_id, arm, item_id, vec FROM sla JOIN space USING (item_id)), n AS (SELECT user_id, arm, count(*) AS n FROM v GROUP BY 1, 2),
  p AS (SELECT a.user_id, a.arm, sum(list_dot_product(a.vec, b.vec)) AS s FROM v a JOIN v b ON a.user_id = b.user_id AND a.arm = b.arm AND a.item_id <> b.item_id GROUP BY 1, 2)
SELECT user_id, arm, round(CASE WHEN n < 2 THEN 0.0 ELSE 1.0 - s / (n * (n - 1)) END, 6) AS diversity FROM n LEFT JOIN p USING (user_id, arm)""", "ratings", "space"))
def _(spark, d):
    return P.intra_list_diversity(slates(spark, d), R.space(spark, d)).select("user_id", "arm", r6("diversity"))


@query("serendipity", sql(f"WITH {SLATES}, tp AS (SELECT item_id FROM titles ORDER BY coalesce(imdb_votes, 0) DESC, item_id LIMIT 200) SELECT user_id, arm, sum(CASE WHEN item_id IN (SELECT item_id FROM tp) THEN 0 ELSE hit END) / 10 AS serendipity FROM hx GROUP BY 1, 2", "titles", "ratings"))
def _(spark, d):
    return P.serendipity(*_shown(spark, d), popularity(spark, d)).select("user_id", "arm", "serendipity")


@query("summarise_metrics", sql(f"""WITH {SLATES}, m AS (SELECT user_id, arm, coalesce(sum(rel / log2(rank + 1.0)) / max(ideal), 0.0) AS ndcg {PER})
SELECT arm, 'ndcg' AS metric, count(*) AS n, round(avg(ndcg), 9) AS mean, round(stddev_samp(ndcg) / sqrt(count(*)), 9) AS se FROM m GROUP BY 1""", "ratings"))
def _(spark, d):
    out = P.summarise_metrics(P.ndcg_at_k(*_shown(spark, d)), ["ndcg"])
    return out.select("arm", "metric", "n", F.round("mean", 9).alias("mean"), F.round("se", 9).alias("se"))


@query("paired_bootstrap", sql(f"""WITH {SLATES}, m AS (SELECT user_id, arm, coalesce(sum(rel / log2(rank + 1.0)) / max(ideal), 0.0) AS ndcg {PER}),
  df AS (SELECT user_id, max(CASE WHEN arm = 'a' THEN ndcg END) - max(CASE WHEN arm = 'b' THEN ndcg END) AS v FROM m GROUP BY 1),
  d0 AS (SELECT i.iter, v, (user_id * {P.DRAW_FACTORS[0]} + i.iter * {P.DRAW_FACTORS[1]}) & 4294967295 AS x FROM df, (SELECT unnest(generate_series(0, 9999)) AS iter) i),
  d1 AS (SELECT iter, v, (xor(x, x >> 16) * {P.DRAW_FACTORS[2]}) & 4294967295 AS x FROM d0), d2 AS (SELECT iter, v, (xor(x, x >> 15) * {P.DRAW_FACTORS[3]}) & 4294967295 AS x FROM d1),
  du AS (SELECT iter, v, xor(x, x >> 16) >> 8 AS u FROM d2), d3 AS (SELECT iter, v, {" + ".join(f"CASE WHEN u >= {b} THEN 1 ELSE 0 END" for b in P.POISSON_BOUNDS)} AS c FROM du),
  bo AS (SELECT iter, sum(c * v) / sum(c) AS mean FROM d3 GROUP BY 1 HAVING sum(c) > 0)
SELECT round(avg(v), 9) AS delta, count(*) AS n, round((SELECT avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0.0 END) FROM bo), 3) AS p FROM df""", "ratings"))
def _(spark, d):
    """At the operator's 10,000 rounds."""
    out = P.paired_bootstrap(P.ndcg_at_k(*_shown(spark, d)), "a", "b")
    return out.select(F.round("delta", 9).alias("delta"), "n", F.round("p", 3).alias("p"))


@query("ranking_metrics", sql(f"""WITH {SLATES}, tp AS (SELECT item_id FROM titles ORDER BY coalesce(imdb_votes, 0) DESC, item_id LIMIT 200),
  m1 AS (SELECT user_id, arm, round(coalesce(sum(rel / log2(rank + 1.0)) / max(ideal), 0.0), 9) AS ndcg, sum(hit) / 10 AS precision, round(coalesce(sum(hit) / max(np), 0.0), 9) AS recall,
    round(coalesce(1.0 / min(CASE WHEN hit = 1 THEN rank END), 0.0), 9) AS mrr, sum(CASE WHEN item_id IN (SELECT item_id FROM tp) THEN 0 ELSE hit END) / 10 AS serendipity {PER}),
  ru AS (SELECT *, sum(hit) OVER (PARTITION BY user_id, arm ORDER BY rank) AS c FROM hx), m2 AS (SELECT user_id, arm, round(coalesce(sum(hit * c / rank) / least(max(np), 10), 0.0), 9) AS map FROM ru LEFT JOIN po USING (user_id) GROUP BY 1, 2),
  m3 AS (SELECT user_id, arm, round(avg(-log2((coalesce(imdb_votes, 0) + 1) / (SELECT sum(imdb_votes) FROM titles))), 6) AS novelty FROM sla JOIN titles USING (item_id) GROUP BY 1, 2),
  v AS (SELECT user_id, arm, item_id, vec FROM sla JOIN space USING (item_id)), n AS (SELECT user_id, arm, count(*) AS n FROM v GROUP BY 1, 2),
  p AS (SELECT a.user_id, a.arm, sum(list_dot_product(a.vec, b.vec)) AS s FROM v a JOIN v b ON a.user_id = b.user_id AND a.arm = b.arm AND a.item_id <> b.item_id GROUP BY 1, 2),
  m4 AS (SELECT user_id, arm, round(CASE WHEN n < 2 THEN 0.0 ELSE 1.0 - s / (n * (n - 1)) END, 6) AS diversity FROM n LEFT JOIN p USING (user_id, arm))
SELECT * FROM m1 JOIN m2 USING (user_id, arm) JOIN m3 USING (user_id, arm) JOIN m4 USING (user_id, arm)""", "titles", "ratings", "space"))
def _(spark, d):
    m = P.ranking_metrics(*_shown(spark, d), popularity(spark, d), R.space(spark, d))
    return m.withColumns({**{c: F.round(c, 9) for c in ("ndcg", "recall", "map", "mrr")}, **{c: F.round(c, 6) for c in ("novelty", "diversity")}})


@query("evaluate_arms")
def _(spark, d):
    """All eight arms on every user's log verdicts as history."""
    hist = E.latest_rating(R.events(spark, d)).select("user_id", "item_id", F.least(F.lit(5.0), F.col("value") + 0.5).alias("rating"))
    hist = hist.join(R.space(spark, d).select("item_id"), "item_id", "left_semi")
    return P.evaluate_arms(cut(hist), arm_items(spark, d))


# --- progressive validation ---


def _sequence(spark, d):
    return cut(E.first_verdict_sequence(R.events(spark, d), R.space(spark, d)))


@query("prequential")
def _(spark, d):
    return P.prequential(_sequence(spark, d), features(spark, d)).select("user_id", "step", r6("predicted"), r6("sd"), r6("error"), "inside", r6("control_error"))


AUDIT = SEQ + """, st AS (SELECT user_id, step, reward AS actual, round(earlier, 12) AS predicted, abs(earlier - reward) AS error, abs(0.3 - reward) AS ctl FROM seq WHERE step >= 3),
  ra AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY predicted) + (count(*) OVER (PARTITION BY user_id, predicted) - 1) / 2 AS pr, rank() OVER (PARTITION BY user_id ORDER BY actual) + (count(*) OVER (PARTITION BY user_id, actual) - 1) / 2 AS ar FROM st),
  nf AS (SELECT *, ctl - error AS skill, row_number() OVER (PARTITION BY user_id ORDER BY step) - 1 AS b, count(*) OVER (PARTITION BY user_id) AS m FROM st WHERE ctl > 0.005),
  tr AS (SELECT user_id, m, avg(skill) FILTER (WHERE b < CASE WHEN m < 20 THEN greatest(m // 2, 1) ELSE 10 END) AS early, avg(skill) FILTER (WHERE b >= m - CASE WHEN m < 20 THEN greatest(m // 2, 1) ELSE 10 END) AS late,
    CASE WHEN m >= 8 THEN regr_slope(skill, step) END AS slope FROM nf GROUP BY 1, 2)"""


def _audit_steps(spark, d):
    """Steps of a stand-in model, the running mean, against a constant control."""
    seq = E.running_mean_control(E.first_verdict_sequence(R.events(spark, d), R.space(spark, d))).filter("step >= 3")
    return seq.select("user_id", "step", F.col("reward").alias("actual"), F.round("earlier_mean", 12).alias("predicted"), F.col("control_error").alias("error"),
                      F.abs(F.lit(0.3) - F.col("reward")).alias("control_error"), (F.col("control_error") < 0.2).alias("inside"))


@query("audit_readings", sql(f"""WITH {AUDIT} SELECT user_id, count(*) AS n, round(avg(error) * 10, 6) AS mae, round(avg(ctl) * 10, 6) AS control_mae, round(avg(CASE WHEN error < 0.2 THEN 1.0 ELSE 0.0 END), 6) AS coverage,
  max(coalesce(m, 0)) AS n_informative, round(max(early), 6) AS early_skill, round(max(late), 6) AS late_skill, round(max(slope), 6) AS slope, round(CASE WHEN count(*) >= 8 THEN corr(pr, ar) END, 6) AS spearman
FROM ra LEFT JOIN tr USING (user_id) GROUP BY 1""", "log", "space"))
def _(spark, d):
    out = P.audit_readings(_audit_steps(spark, d))
    return out.select("user_id", "n", *[r6(c) for c in ("mae", "control_mae", "coverage")], "n_informative", *[r6(c) for c in ("early_skill", "late_skill", "slope", "spearman")])


@query("audit_significance")
def _(spark, d):
    return P.audit_readings(_audit_steps(spark, d)).select("user_id", r6("slope_p"), r6("spearman_p"), "model_wins", "calibrated", "trend")


# --- off-policy ---


@query("snips", """WITH r AS (SELECT user_id, event_id, value / 50 AS reward, 1 / (1 + value) AS p, (event_id % 17) / 10 AS score FROM events), e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY user_id)) AS e FROM r),
  w AS (SELECT *, e / sum(e) OVER (PARTITION BY user_id) / greatest(p, 1e-6) AS w FROM e), c AS (SELECT user_id, quantile_cont(w, 0.99) AS q FROM w GROUP BY 1)
SELECT user_id, count(*) AS n, round(avg(reward), 9) AS logged_value, round(CASE WHEN count(*) >= 60 THEN sum(least(w, q) * reward) / sum(least(w, q)) END, 9) AS estimate FROM w JOIN c USING (user_id) GROUP BY 1""")
def _(spark, d):
    rows = R.table(spark, d, "events").select("user_id", F.col("event_id").alias("row_id"), (F.col("value") / 50).alias("reward"), (1 / (1 + F.col("value"))).alias("propensity"),
                                              (F.pmod("event_id", F.lit(17)) / 10).alias("score"))
    out = P.snips(rows, least=60)
    return out.select("user_id", "n", F.round("logged_value", 9).alias("logged_value"), F.round("estimate", 9).alias("estimate"))


@query("off_policy_status", sql(f"""WITH {LOOSE}, u AS (SELECT user_id, item_id FROM ex WHERE propensity > 0 UNION ALL SELECT user_id, item_id FROM lo WHERE propensity > 0)
SELECT user_id, count(*) AS n_usable, CASE WHEN count(*) < 30 THEN 'not-enough-data' ELSE 'ok' END AS status FROM u GROUP BY 1""", "log", "impressions"))
def _(spark, d):
    feats = features(spark, d)
    usable = cut(E.usable_impressions(R.impressions(spark, d), R.events(spark, d)))
    return P.off_policy_status(usable, models(spark, d, feats), feats).select("user_id", "n_usable", "status")


@query("off_policy_estimate")
def _(spark, d):
    """Every view as a logged pick with the day's later value as reward."""
    feats = features(spark, d)
    logged = R.impressions(spark, d).select("user_id", "item_id", "slate_id", "impression_id", "propensity", F.least(F.col("score") / 50, F.lit(1.0)).alias("reward"))
    return P.off_policy_status(cut(logged), models(spark, d, feats), feats, least=10).select("user_id", "n_usable", "status", r6("logged_value"), r6("estimate"), "better")


# --- models as of a moment ---


def as_of_sql(asks: str, events: str) -> str:
    """Common tables up to ``pr`` (user_id, ask_id, predicted): each ask answered by a regression on two
    features over the labels known before it, written out as a 3 x 3 solve."""
    return f"""ask AS ({asks}), le AS ({events}),
  st AS (SELECT k.user_id, k.ask_id, k.ts, e.item_id, e.value / 10.0 AS y, 1.0 AS base, e.ts AS said FROM ask k JOIN le e ON e.user_id = k.user_id AND e.ts < k.ts AND e.kind = 'rate' AND e.value IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY k.user_id, k.ask_id, e.item_id ORDER BY e.ts DESC, e.event_id DESC) = 1),
  ra AS (SELECT DISTINCT k.user_id, k.ask_id, e.item_id FROM ask k JOIN le e ON e.user_id = k.user_id AND e.ts < k.ts AND e.kind = 'rate'),
  we AS (SELECT k.user_id, k.ask_id, k.ts, e.item_id, 0.25 AS y, 0.5 AS base, max(e.ts) AS said FROM ask k JOIN le e ON e.user_id = k.user_id AND e.ts < k.ts AND e.kind IN ('skip', 'dismiss')
    WHERE (k.user_id, k.ask_id, e.item_id) NOT IN (SELECT user_id, ask_id, item_id FROM ra) GROUP BY ALL),
  x AS (SELECT user_id, ask_id, greatest(base * exp(-ln(2.0) * date_diff('day', said, ts) / 1100.0), 1e-3) AS w, y, base, CAST(vec[1] AS DOUBLE) AS a, CAST(vec[2] AS DOUBLE) AS b
    FROM (SELECT * FROM st UNION ALL SELECT * FROM we) JOIN space USING (item_id)),
  m AS (SELECT user_id, ask_id, count(*) AS n, sum(w) AS s0, sum(w * a) AS sa, sum(w * b) AS sb, sum(w * a * a) AS saa, sum(w * a * b) AS sab, sum(w * b * b) AS sbb, sum(w * y) AS sy, sum(w * y * a) AS sya, sum(w * y * b) AS syb
    FROM x GROUP BY ALL HAVING count(*) FILTER (WHERE base = 1.0) >= 3),
  g AS (SELECT user_id, ask_id, sy / s0 AS ym, n + 10 AS a11, n / s0 * sa AS a12, n / s0 * sb AS a13, n / s0 * saa + 10 AS a22, n / s0 * sab AS a23, n / s0 * sbb + 10 AS a33,
    n / s0 * (sya - sy / s0 * sa) AS r2, n / s0 * (syb - sy / s0 * sb) AS r3 FROM m),
  i AS (SELECT *, a22 * a33 - a23 * a23 AS i11, a13 * a23 - a12 * a33 AS i12, a12 * a23 - a13 * a22 AS i13, a11 * a33 - a13 * a13 AS i22, a12 * a13 - a11 * a23 AS i23, a11 * a22 - a12 * a12 AS i33 FROM g),
  c AS (SELECT *, a11 * i11 + a12 * i12 + a13 * i13 AS det FROM i),
  pr AS (SELECT c.user_id, c.ask_id, k.item_id, (i12 * r2 + i13 * r3) / det + (i22 * r2 + i23 * r3) / det * CAST(vec[1] AS DOUBLE) + (i23 * r2 + i33 * r3) / det * CAST(vec[2] AS DOUBLE) + ym AS predicted
    FROM c JOIN ask k USING (user_id, ask_id) JOIN space USING (item_id))"""


def plane(spark, d):
    """The first two features of each item."""
    return cut(R.space(spark, d).select("item_id", F.slice(F.col("vec").cast("array<double>"), 1, 2).alias("vec")))


@query("prequential_serving", sql(f"""WITH {SEQ}, {as_of_sql("SELECT user_id, step AS ask_id, item_id, ts FROM seq WHERE step >= 5", "SELECT * FROM log")}
SELECT pr.user_id, step, round(predicted, 6) AS predicted, round(abs(predicted - reward), 6) AS error, round(abs(earlier - reward), 6) AS control_error FROM pr JOIN seq ON seq.user_id = pr.user_id AND step = ask_id""", "log", "space"))
def _(spark, d):
    """Each verdict predicted by the model that served at its moment, on two features."""
    feats = plane(spark, d)
    changes = Z.label_changes(Z.label_lives(R.events(spark, d), feats))
    return P.prequential(_sequence(spark, d), feats, serving=changes).select("user_id", "step", r6("predicted"), r6("error"), r6("control_error"))


#: Verdicts of the web page only, so that some users have too few of them for a model.
WEB = "SELECT * FROM log WHERE kind <> 'rate' OR source = 'web'"


@query("off_policy_as_of", sql(f"""WITH im AS (SELECT user_id, item_id, slate_id, impression_id, ts, propensity, least(score / 50, 1.0) AS reward, CASE WHEN ts < TIMESTAMP '2024-01-03' THEN 'before' ELSE 'now' END AS space_id FROM impressions),
  {as_of_sql("SELECT user_id, impression_id AS ask_id, item_id, ts FROM im", WEB)},
  us AS (SELECT im.user_id, count(*) AS n_usable, count(*) FILTER (im.space_id <> 'now' OR sp.item_id IS NULL) AS gone, avg(reward) AS logged FROM im LEFT JOIN space sp ON sp.item_id = im.item_id GROUP BY 1),
  sc AS (SELECT im.user_id, slate_id, reward, propensity, predicted AS score FROM im JOIN pr ON pr.user_id = im.user_id AND ask_id = impression_id),
  e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY user_id, slate_id)) AS e FROM sc), w AS (SELECT *, e / sum(e) OVER (PARTITION BY user_id, slate_id) / greatest(propensity, 1e-6) AS w FROM e),
  q AS (SELECT user_id, quantile_cont(w, 0.99) AS q, count(*) AS n FROM w GROUP BY 1), es AS (SELECT user_id, n, sum(least(w, q) * reward) / sum(least(w, q)) AS estimate FROM w JOIN q USING (user_id) GROUP BY ALL)
SELECT user_id, n_usable, CASE WHEN n_usable < 10 THEN 'not-enough-data' WHEN es.n IS NULL THEN 'no-model' WHEN gone > 0 THEN 'item-space-changed' WHEN es.n < 10 THEN 'estimate-unavailable' ELSE 'ok' END AS status,
  CASE WHEN n_usable >= 10 AND es.n IS NOT NULL AND gone = 0 THEN round(logged, 6) END AS logged_value, CASE WHEN n_usable >= 10 AND gone = 0 AND es.n >= 10 THEN round(estimate, 6) END AS estimate,
  CASE WHEN n_usable >= 10 AND gone = 0 AND es.n >= 10 THEN estimate > logged END AS better FROM us LEFT JOIN es USING (user_id)""", "log", "impressions", "space"))
def _(spark, d):
    """Every view as a pick, scored by what was known before it; softmax inside its slate."""
    feats, events = plane(spark, d), R.events(spark, d).filter("kind <> 'rate' or source = 'web'")
    shown = R.impressions(spark, d)
    space_id = F.when(F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz"), "before").otherwise("now")
    usable = shown.select("user_id", "item_id", "slate_id", "impression_id", "propensity", F.least(F.col("score") / 50, F.lit(1.0)).alias("reward"), space_id.alias("space_id"))
    changes = Z.label_changes(Z.label_lives(events, feats))
    out = P.off_policy_status(cut(usable), None, feats, 10, True, (changes, shown.select("impression_id", "ts")), space_id="now")
    return out.select("user_id", "n_usable", "status", r6("logged_value"), r6("estimate"), "better")


# --- sealed predictions ---


def wanted(spark, d):
    """Saved titles, one batch per user."""
    return R.events(spark, d).filter(F.col("kind").isin("watchlist", "unseen")).select(F.concat(F.lit("b"), F.col("user_id").cast("string")).alias("batch_id"), "user_id", "item_id")


def _old_cases(spark, d):
    return R.events(spark, d).filter("kind = 'dismiss'").select("user_id", "item_id")


@query("seal_candidates", sql("""WITH w AS (SELECT DISTINCT 'b' || user_id AS batch_id, user_id, item_id FROM log WHERE kind IN ('watchlist', 'unseen')), n AS (SELECT batch_id, count(*) AS n FROM w GROUP BY 1)
SELECT batch_id, user_id, item_id, CASE WHEN n < 20 THEN 'too few candidates' WHEN item_id NOT IN (SELECT item_id FROM titles) THEN 'not in catalogue'
  WHEN EXISTS (SELECT 1 FROM log l WHERE l.kind = 'rate' AND l.user_id = w.user_id AND l.item_id = w.item_id) THEN 'already rated'
  WHEN EXISTS (SELECT 1 FROM log l WHERE l.kind = 'dismiss' AND l.user_id = w.user_id AND l.item_id = w.item_id) THEN 'already sealed' END AS reject FROM w JOIN n USING (batch_id)""", "titles", "log"))
def _(spark, d):
    return P.seal_candidates(wanted(spark, d), R.titles(spark, d), R.events(spark, d), _old_cases(spark, d))


def _cases(spark, d):
    feats, labs = features(spark, d), labels(spark, d)
    ok = P.seal_candidates(wanted(spark, d), R.titles(spark, d), R.events(spark, d), _old_cases(spark, d), 8).filter("reject is null")
    ridge = K.ridge_baseline(labs, feats, K.sample_negatives(feats))
    return cut(P.seal_predictions(ok, feats, models(spark, d, feats, labs), ridge, R.as_of()))


@query("seal_predictions")
def _(spark, d):
    return _cases(spark, d).select("case_id", "batch_id", "item_id", r6("full_score"), r6("full_like_prob"), r6("ridge_like_prob"), "full_rank", "ridge_rank")


def _case_id():
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                       F.date_format("l_shipdate", "yyyyMMdd"))


def plain_cases(spark, d):
    """Order lines as sealed cases of one batch per order."""
    q = F.col("l_quantity")
    return R.table(spark, d, "lineitem").select(
        _case_id().alias("case_id"), F.col("l_orderkey").cast("string").alias("batch_id"),
        F.pmod("l_orderkey", F.lit(40)).alias("user_id"), F.col("l_partkey").alias("item_id"), (q / 50).alias("full_score"), (q / 50).alias("full_like_prob"), (F.col("l_discount") * 10).alias("ridge_score"),
        F.row_number().over(_w("l_quantity")).alias("full_rank"), F.row_number().over(_w("l_discount")).alias("ridge_rank"),
        F.when(F.col("l_returnflag") == "R", "revealed").otherwise("sealed").alias("status"), F.when(F.col("l_returnflag") == "R", 0.4).alias("actual_reward"),
        F.lit(None).cast("string").alias("actual_verdict"), F.lit(None).cast("timestamp_ntz").alias("revealed_at"))


def _w(c):
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy(F.desc(c), "l_linenumber", "l_partkey", "l_suppkey")


def reveals(spark, d):
    word = F.when(F.col("l_quantity") > 40, "love").when(F.col("l_quantity") > 25, "like").when(F.col("l_quantity") > 20, "unseen").when(F.col("l_quantity") > 2, "dislike").otherwise("what")
    line = R.table(spark, d, "lineitem").select(
        _case_id().alias("case_id"), word.alias("verdict"), F.col("l_shipdate").alias("ts"))
    return line.unionByName(line.withColumns({"verdict": F.lit("hate"), "ts": F.expr("ts + INTERVAL 1 DAY")}))


REV = """ca AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS case_id, CAST(l_orderkey AS VARCHAR) AS batch_id, l_orderkey % 40 AS user_id, l_quantity / 50 AS fs, l_discount * 10 AS rs, l_returnflag = 'R' AS pre, l_shipdate, l_quantity,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS fr, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey) AS rr FROM lineitem),
  rw AS (SELECT case_id, verdict FROM (SELECT case_id, verdict, row_number() OVER (PARTITION BY case_id ORDER BY ts, verdict) AS rn FROM (
      SELECT case_id, CASE WHEN l_quantity > 40 THEN 'love' WHEN l_quantity > 25 THEN 'like' WHEN l_quantity > 20 THEN 'unseen' WHEN l_quantity > 2 THEN 'dislike' ELSE 'what' END AS verdict, l_shipdate AS ts FROM ca
      UNION ALL SELECT case_id, 'hate', l_shipdate + INTERVAL 1 DAY FROM ca)) WHERE rn = 1),
  rv AS (SELECT ca.case_id, batch_id, user_id, fs, rs, fr, rr, CASE WHEN pre THEN 'revealed' WHEN verdict = 'unseen' THEN 'unseen' WHEN verdict = 'what' THEN 'sealed' ELSE 'revealed' END AS status,
    CASE WHEN pre THEN 0.4 ELSE CASE verdict WHEN 'love' THEN 1.0 WHEN 'like' THEN 0.75 WHEN 'dislike' THEN 0.1 END END AS reward FROM ca JOIN rw USING (case_id))"""


@query("reveal_predictions", f"WITH {REV} SELECT case_id, status, CAST(reward AS DOUBLE) AS actual_reward FROM rv")
def _(spark, d):
    return P.reveal_predictions(plain_cases(spark, d), reveals(spark, d)).select("case_id", "status", "actual_reward")


@query("reveal_events", f"WITH {REV} SELECT rv.case_id, reward * 10 AS value FROM rv JOIN (SELECT case_id FROM ca WHERE NOT pre) USING (case_id) WHERE status = 'revealed'")
def _(spark, d):
    before = plain_cases(spark, d)
    after = P.reveal_predictions(before, reveals(spark, d)).withColumn("item_id", F.col("case_id"))
    return P.reveal_events(before, after).select(F.col("item_id").alias("case_id"), "value")


@query("open_cases", sql("SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS case_id, title FROM lineitem JOIN titles ON item_id = l_partkey WHERE l_returnflag <> 'R'", "titles"))
def _(spark, d):
    return P.open_cases(plain_cases(spark, d), R.titles(spark, d)).select("case_id", "title")


SUMMARY = REV + """, li AS (SELECT * FROM rv WHERE status <> 'unseen'), ok AS (SELECT batch_id, count(*) AS n FROM li GROUP BY 1 HAVING count(*) FILTER (WHERE status <> 'revealed') = 0),
  c AS (SELECT li.*, least(10, n) AS k, CASE WHEN reward >= 0.75 THEN 1.0 ELSE 0.0 END AS hit, row_number() OVER (PARTITION BY batch_id ORDER BY fr) AS f, row_number() OVER (PARTITION BY batch_id ORDER BY rr) AS r FROM li JOIN ok USING (batch_id)),
  lf AS (SELECT user_id, avg(x) AS lift FROM (SELECT user_id, batch_id, avg(CASE WHEN f <= k THEN hit END) - avg(CASE WHEN r <= k THEN hit END) AS x FROM c GROUP BY 1, 2) GROUP BY 1)"""


def summary_cases(spark, d):
    return P.reveal_predictions(plain_cases(spark, d), reveals(spark, d))


@query("validation_summary", f"""WITH {SUMMARY}, a AS (SELECT user_id, count(*) AS completed, avg(abs(fs - reward)) AS full_mae, avg(abs(rs - reward)) AS ridge_mae, avg((fs - hit) * (fs - hit)) AS full_brier, avg(CASE WHEN f <= k THEN hit END) AS full_top10, avg(CASE WHEN r <= k THEN hit END) AS ridge_top10 FROM c GROUP BY 1)
SELECT user_id, completed, what, round(value, 9) AS value FROM (SELECT user_id, completed, unnest(['full_mae', 'ridge_mae', 'full_brier', 'full_top10', 'ridge_top10', 'top10_lift']) AS what, unnest([full_mae, ridge_mae, full_brier, full_top10, ridge_top10, lift]) AS value FROM a JOIN lf USING (user_id))""")
def _(spark, d):
    out = P.validation_summary(summary_cases(spark, d))
    return out.select("user_id", "completed", "what", F.round("value", 9).alias("value"))


@query("validation_decision")
def _(spark, d):
    return P.validation_summary(_reveal_sealed(spark, d)).select("user_id", "what", r6("low"), r6("high"), "decision", "status")


def _reveal_sealed(spark, d):
    """The models' own sealed cases, revealed by the log's words."""
    cases = _cases(spark, d)
    said = cases.select("case_id", F.when(F.conv(F.substring(F.md5("case_id"), 1, 4), 16, 10).cast("int") % 3 == 0, "love").otherwise("dislike").alias("verdict"), R.as_of().alias("ts"))
    return P.reveal_predictions(cases, said)
