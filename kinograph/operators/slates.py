"""Recommendation slates for all users: score, shortlist, diversify, cap, log."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as N
from ..functions import scalar as S
from ..functions import vectors as V
from ..session import bounded_batches, cut, top_per_key
from . import blocks as B
from . import catalogue as C
from . import taste as K


def top_k_scored(scored: DataFrame, k: int, keys: tuple = ("user_id",), score: str = "score") -> DataFrame:
    """k best per key; the limit applies before the shuffle too."""
    return top_per_key(scored, list(keys), [F.desc(score), F.asc("item_id")], k)


def shortlist(scored: DataFrame, k: int, size: int = 400) -> DataFrame:
    """Top max(size, 20k) by score and top max(4k, 64) by posterior mean."""
    by_score = top_k_scored(scored, max(size, 20 * k)).drop("rank")
    by_mean = top_k_scored(scored, max(4 * k, 64), score="mean").drop("rank")
    return by_score.union(by_mean).distinct()


def _adjust(scored: DataFrame, signal: Column, weight: float) -> DataFrame:
    """Adds weight · sd(score) · z(signal), over each user's candidates."""
    x = scored.withColumn("_x", signal)
    stats = x.groupBy("user_id").agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_d"), F.stddev_pop("score").alias("_s"))
    z = (F.col("_x") - F.col("_m")) / (F.col("_d") + 1e-9)
    return x.join(stats, "user_id").withColumn("score", F.col("score") + F.lit(weight) * F.col("_s") * z).drop("_x", "_m", "_d", "_s")


def mood_adjust(scored: DataFrame, affinity: str = "affinity", weight: float = 0.6) -> DataFrame:
    return _adjust(scored, F.col(affinity), weight)


def novelty_adjust(scored: DataFrame, novelty: float, votes: str = "imdb_votes") -> DataFrame:
    return _adjust(scored, F.log1p(F.coalesce(F.col(votes), F.lit(0)).cast("double")), -novelty)


def language_quota(ranked: DataFrame, k: int, share: float = 0.5, keys: tuple = ("user_id",)) -> DataFrame:
    """At most max(1, round(k·share)) per language; the overflow refills the tail."""
    cap = max(1, int(round(k * share)))
    lang = F.coalesce("language", F.lit("xx"))
    inner = Window.partitionBy(*keys, lang).orderBy("rank")
    tagged = ranked.withColumn("_over", F.row_number().over(inner) > cap)
    outer = Window.partitionBy(*keys).orderBy("_over", "rank")
    return tagged.withColumn("position", F.row_number().over(outer) - 1).filter(F.col("position") < k).drop("_over")


def propensity(listed: DataFrame, keys: tuple = ("user_id",), score: str = "score") -> DataFrame:
    """Softmax over each shortlist at temperature max(sd, 1e-3)."""
    stats = listed.groupBy(*keys).agg(F.max(score).alias("_m"), F.greatest(F.stddev_pop(score), F.lit(1e-3)).alias("_t"))
    e = listed.join(stats, list(keys)).withColumn("_e", F.exp((F.col(score) - F.col("_m")) / F.col("_t")))
    total = e.groupBy(*keys).agg(F.sum("_e").alias("_z"))
    return e.join(total, list(keys)).withColumn("propensity", F.col("_e") / F.col("_z")).drop("_m", "_t", "_e", "_z")


def explored_flag(slate: DataFrame, best_by_mean: DataFrame, k: int) -> DataFrame:
    """Explored: not among the k best by posterior mean over all candidates."""
    top = top_k_scored(best_by_mean, k, score="mean").select("user_id", "item_id", F.lit(True).alias("_top"))
    return slate.join(top, ["user_id", "item_id"], "left").withColumn("explored", F.col("_top").isNull()).drop("_top")


def mmr(listed: DataFrame, latent: DataFrame, k: int, balance: float = 0.72) -> DataFrame:
    """Greedy diversification of each user's shortlist, whose size the shortlist rule bounds.

    Users are read in a stream, many a batch, and short lists take their picks together.
    """
    rows = listed.join(latent.select("item_id", F.col("latent").cast("array<double>").alias("_v")), "item_id")
    bounded_batches(rows.sparkSession)
    schema = T.StructType([*listed.schema.fields, T.StructField("rank", T.IntegerType())])

    def chosen(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        score, ids = t["score"].to_numpy().astype(float), t["item_id"].to_numpy()
        flat = t["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(np.append(starts, t.num_rows))
        order = np.lexsort((ids, -score, np.repeat(np.arange(len(starts)), sizes)))
        picks = N.diverse_lists(balance * score[order], flat.reshape(t.num_rows, -1)[order], sizes, k, 1.0 - balance)
        at = order[np.concatenate(picks)]
        rank = np.concatenate([np.arange(1, len(p) + 1, dtype=np.int32) for p in picks])
        return t.drop_columns(["_v"]).take(at).append_column("rank", pa.array(rank)).select(schema.names).combine_chunks().to_batches()[0]

    def run(batches):
        wait = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            wait = part if wait is None else pa.concat_tables([wait, part])
            starts = _run_starts(wait["user_id"].combine_chunks())
            if len(starts) > 1:
                # The last user's rows may go on in the next batch.
                yield chosen(wait.slice(0, starts[-1]), starts[:-1])
                wait = wait.slice(starts[-1])
        if wait is not None:
            yield chosen(wait, _run_starts(wait["user_id"].combine_chunks()))

    return B.gathered(rows, "user_id").sortWithinPartitions("user_id").mapInArrow(run, schema)


def _run_starts(keys) -> np.ndarray:
    """Where runs of equal keys start; nulls are equal to each other."""
    a, b = keys.slice(1), keys.slice(0, len(keys) - 1)
    new = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_valid(a), pc.is_valid(b)))
    return np.concatenate([[0], np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1])


#: Rows that leave a block's task together.
ROWS_AT_ONCE = 65_536


def _scan(weights: DataFrame, means: DataFrame, features: DataFrame, skip: DataFrame | None, pool: int, greedy: int,
          moods: DataFrame | None, mood_weight: float, novelty: float) -> tuple[DataFrame, DataFrame]:
    """Per user: the ``pool`` best by adjusted score and ``greedy`` best by mean, with both numbers.

    One pass per block. With a mood or novelty a first pass collects the candidate moments
    (of score, affinity and exposure) from which both adjustments follow.
    """
    asked = weights.withColumnRenamed("user_id", "qid").join(
        means.select(F.col("user_id").alias("qid"), F.col("w").alias("mw"), F.col("b").alias("mb")), "qid")
    use_mood = moods is not None and mood_weight > 0
    empty = F.lit(None).cast("array<double>")
    asked = asked.join(moods.select(F.col("user_id").alias("qid"), F.col("mood").cast("array<double>").alias("mood")), "qid", "left") if use_mood else asked.withColumn("mood", empty)
    gone = skip.withColumnRenamed("user_id", "qid") if skip is not None else None
    items = B.one_vector(features.withColumn("heat", F.log1p(F.coalesce("imdb_votes", F.lit(0)).cast("double"))), "heat")
    sizes = (asked.count(), items.count())

    def columns(q, rp, drop):
        """Some users at a time: their places in ``q``, and per user the kept items' columns."""
        ids, x, heat = rp["item_id"].to_numpy(), B._stack(rp["vec"]), rp["heat"].to_numpy(float)
        latent = B.latent_of(rp, x)
        for (_, _), users in q.assign(place=np.arange(len(q))).groupby(["n_rff", "gamma"]):
            phi = K._phi(users.iloc[0], x).T
            for part in B.in_slices(len(users), 2 * len(ids)):
                some = users.iloc[part]
                drawn = B._stack(some["w"]) @ phi + some["b"].to_numpy(float)[:, None]
                mean = B._stack(some["mw"]) @ phi + some["mb"].to_numpy(float)[:, None]
                for i, r in enumerate(some.itertuples(index=False)):
                    keep = B.keep_mask(ids, drop.get(r.qid))
                    aff = latent @ np.asarray(r.mood) if r.mood is not None else np.zeros(len(ids))
                    yield r, keep, drawn[i], mean[i], aff, heat, ids

    if use_mood or novelty > 0:
        mom = T.StructType([asked.schema["qid"], *[T.StructField(c, T.DoubleType()) for c in ("n", "s", "a", "e", "ss", "aa", "ee", "sa", "se", "ae")]])

        def gather(q, rp, drop):
            out = []
            for r, keep, s, _m, a, e, _ids in columns(q, rp, drop):
                s, a, e = s[keep], a[keep], e[keep]
                out.append((r.qid, len(s), s.sum(), a.sum(), e.sum(), s @ s, a @ a, e @ e, s @ a, s @ e, a @ e))
            return pd.DataFrame(out, columns=mom.names)

        m = B.per_block(asked, items, gone, gather, mom, sizes, block=B.MODEL_QUERIES).groupBy("qid").agg(*[F.sum(c).alias(c) for c in mom.names[1:]])
        n = F.col("n")

        def cov(xy, x, y):
            return F.greatest(F.col(xy) / n - F.col(x) / n * F.col(y) / n, F.lit(0.0)) if x == y else F.col(xy) / n - F.col(x) / n * F.col(y) / n

        c1 = F.lit(mood_weight if use_mood else 0.0) * F.sqrt(cov("ss", "s", "s")) / (F.sqrt(cov("aa", "a", "a")) + 1e-9)
        m = m.withColumn("c1", c1)
        spread = F.sqrt(F.greatest(cov("ss", "s", "s") + 2 * F.col("c1") * cov("sa", "s", "a") + F.col("c1") ** 2 * cov("aa", "a", "a"), F.lit(0.0)))
        m = m.select("qid", "c1", (F.lit(-float(novelty)) * spread / (F.sqrt(cov("ee", "e", "e")) + 1e-9)).alias("c2"), (F.col("a") / n).alias("am"), (F.col("e") / n).alias("em"))
        asked = cut(asked.join(m, "qid"))
    else:
        asked = asked.withColumns({c: F.lit(0.0) for c in ("c1", "c2", "am", "em")})
    out = T.StructType([T.StructField("user_id", weights.schema["user_id"].dataType), features.schema["item_id"], T.StructField("score", T.DoubleType()),
                        T.StructField("mean", T.DoubleType()), T.StructField("kind", T.StringType())])

    def pick(q, found, drop):
        # Each user's best of both kinds so far, while the sheets pass: (scores, ids, the other number).
        held = [[None, None] for _ in range(len(q))]
        for rp in found:
            for r, keep, s, mean, a, e, ids in columns(q, rp, drop):
                kept = np.flatnonzero(keep)
                s, mean = (s + r.c1 * (a - r.am) + r.c2 * (e - r.em))[kept], mean[kept]
                for j, (by, k) in enumerate(((s, pool), (mean, greedy))):
                    best = N.best_indices(by, k)
                    new, old = (s[best], mean[best], ids[kept[best]]), held[r.place][j]
                    if old is not None:
                        both = [np.concatenate(c) for c in zip(old, new)]
                        order = np.lexsort((both[2], -both[j]))[:k]
                        new = tuple(c[order] for c in both)
                    held[r.place][j] = new
        wait, size = [], 0
        for qid, of in zip(q["qid"], held):
            for kind, rows in zip("sm", of):
                if rows is not None and len(rows[0]):
                    wait.append((np.full(len(rows[0]), qid), rows[2], rows[0], rows[1], np.full(len(rows[0]), kind, object)))
                    size += len(rows[0])
            if size >= ROWS_AT_ONCE:
                yield B.as_frame(wait, out.names)
                wait, size = [], 0
        if wait:
            yield B.as_frame(wait, out.names)

    hits = cut(B.per_block(asked, items, gone, pick, out, sizes, block=B.MODEL_QUERIES, streamed=True))
    top = top_k_scored(hits.filter("kind = 's'"), pool).drop("rank", "kind")
    greedy_rows = top_k_scored(hits.filter("kind = 'm'"), greedy, score="mean").drop("rank", "kind")
    return top, greedy_rows


def _tilt(s: np.ndarray, a: np.ndarray, e: np.ndarray, mood_weight: float, novelty: float) -> np.ndarray:
    """What mood and novelty add to one user's scores, in units of their spread over all candidates."""
    c1 = mood_weight * s.std() / (a.std() + 1e-9)
    moved = s.var() + 2 * c1 * ((s * a).mean() - s.mean() * a.mean()) + c1 * c1 * a.var()
    c2 = -novelty * np.sqrt(max(moved, 0.0)) / (e.std() + 1e-9)
    return c1 * (a - a.mean()) + c2 * (e - e.mean())


def _whole_lists(models: DataFrame, weights: DataFrame | None, items: DataFrame, sizes: tuple[int, int], skip: DataFrame | None, pool: int,
                 greedy: int, moods: DataFrame | None, mood_weight: float, novelty: float, strategy: str, kappa: float, compat: bool, k: int,
                 balance: float, top: int) -> DataFrame:
    """What a slate needs of each shortlist: the rows with a diversified rank, and the ``top`` best by mean. All
    of a list is scored, weighed and ranked where the users' block meets the whole item table, so neither vectors
    nor lists leave a task. ``propensity`` has those of the list's rows of that item, as an item may repeat."""
    own = K.packed(models).select(F.col("user_id").alias("qid"), F.col("mean").alias("mw"), F.col("y_mean").alias("mb"), "cov", "beta", "n_rff", "gamma")
    # A draw is one vector a user: it is the side to send where there are few users; a mean is in the model already.
    drawn_first = weights is not None
    asked = own if weights is None else own.join(weights.select(F.col("user_id").alias("qid"), "w", "b"), "qid")
    use_mood = moods is not None and mood_weight > 0
    asked = asked.join(moods.select(F.col("user_id").alias("qid"), F.col("mood").cast("array<double>").alias("mood")), "qid", "left") if use_mood else asked.withColumn(
        "mood", F.lit(None).cast("array<double>"))
    out = T.StructType([T.StructField("user_id", models.schema["user_id"].dataType), items.schema["item_id"], *[
        T.StructField(c, T.DoubleType()) for c in ("score", "mean", "sd")], T.StructField("rank", T.IntegerType()), T.StructField("best", T.BooleanType()),
        T.StructField("propensity", T.ArrayType(T.DoubleType()))])

    def run(q, rp, drop):
        ids, x, heat, held = rp["item_id"].to_numpy(), B._stack(rp["vec"]), rp["heat"].to_numpy(float), []
        latent = B.latent_of(rp, x)
        for _, users in q.groupby(["n_rff", "gamma"]):
            phi = K._phi(users.iloc[0], x)
            mw, mb = B._stack(users["mw"]), users["mb"].to_numpy(float)[:, None]
            w, b = (mw, mb) if not drawn_first else (B._stack(users["w"]), users["b"].to_numpy(float)[:, None])
            for part in B.in_slices(len(users), 2 * len(ids)):
                mean = mw[part] @ phi.T + mb[part]
                drawn = mean if not drawn_first else w[part] @ phi.T + b[part]
                for i, r in enumerate(users.iloc[part].itertuples(index=False)):
                    if row := one(r, ids, phi, latent, heat, np.flatnonzero(B.keep_mask(ids, drop.get(r.qid))), drawn[i], mean[i]):
                        held.append(row)
        return pd.DataFrame({c: [x for v in vs for x in v] if c == "propensity" else np.concatenate(vs) for c, vs in zip(out.names, zip(*held))}).astype(
            {"rank": "Int32"}) if held else pd.DataFrame([], columns=out.names)

    def one(r, ids, phi, latent, heat, keep, s, m):
        if not len(keep):
            return None
        s, m = s[keep], m[keep]
        if use_mood or novelty > 0:
            mood = latent[keep] @ np.asarray(r.mood) if r.mood is not None else np.zeros(len(keep))
            s = s + _tilt(s, mood, heat[keep], mood_weight if use_mood else 0.0, novelty)
        best = N.best_indices(m, greedy)
        both = np.union1d(N.best_indices(s, pool), best)
        at, score, mu = keep[both], s[both], m[both]
        sd = np.sqrt(np.maximum(N.quadratic(phi[at], N.symmetric(r.cov, phi.shape[1])) + 1.0 / r.beta, 1e-12))
        if strategy == "ucb":
            score = (mu if compat else score) + kappa * sd
        order = np.lexsort((ids[at], -score))
        picks = order[N.diverse_greedy(balance * score[order], latent[at[order]], k, 1.0 - balance)]
        rank = np.full(len(at), np.nan)
        rank[picks] = np.arange(1, len(picks) + 1)
        # As ``propensity`` does over rows: a softmax over the list at temperature max(sd, 1e-3).
        e = np.exp((score - score.max()) / max(score.std(), 1e-3))
        e /= e.sum()
        first = np.isin(both, best[:top])
        sent = np.flatnonzero(~np.isnan(rank) | first)
        return (np.full(len(sent), r.qid), ids[at[sent]], score[sent], mu[sent], sd[sent], rank[sent], first[sent], [e[ids[at] == i] for i in ids[at[sent]]])

    gone = skip.withColumnRenamed("user_id", "qid") if skip is not None else None
    given = B.one_vector(items.withColumn("heat", F.log1p(F.coalesce("imdb_votes", F.lit(0)).cast("double"))), "heat")
    return B.per_block(asked, given, gone, run, out, sizes, True, B.MODEL_QUERIES)


def recommend(models: DataFrame, features: DataFrame, titles: DataFrame, excluded: DataFrame | None = None, k: int = 10,
              strategy: str = "thompson", slate: Column | None = None, mmr_lambda: float = 0.72, size: int = 400,
              max_share: float = 0.5, explore: float = 1.0, novelty: float = 0.0, moods: DataFrame | None = None,
              mood_weight: float = 0.6, compat: bool = False, filters: dict | None = None) -> DataFrame:
    """A slate per user: item, position, score, mean, sd, propensity, explored.

    ``strategy`` mean, thompson or ucb; ``compat`` lets the optimistic score replace mood and
    novelty instead of adding to them. ``models`` is read several times: give a stored table. Up to a
    shard of items, a user's list is finished where it is scored; more items are scored by shards and
    the shortlists meet again.
    """
    keep = C.hard_filters(titles, **(filters or {}))
    items = cut(features.join(keep.select("item_id", "imdb_votes", "language"), "item_id"))
    means = K.mean_weights(models)
    weights = cut(K.sample_weights(models, slate if slate is not None else F.lit("slate"), max(explore, 0.0))) if strategy == "thompson" else means
    pool, greedy = max(size, 20 * k), max(4 * k, 64)
    n_items = items.count()
    if n_items <= B.BLOCK_ITEMS:
        listed = cut(_whole_lists(models, weights if strategy == "thompson" else None, items, (models.count(), n_items), excluded, pool, greedy, moods, mood_weight, novelty, strategy,
                                  max(explore, 0.0), compat, 3 * k, mmr_lambda, k))
        best = listed.filter("best").select("user_id", "item_id", "score", "mean")
        weighed = None
    else:
        top, best = _scan(weights, means, items, excluded, pool, greedy, moods, mood_weight, novelty)
        listed = cut(_finish(top.union(best).distinct(), features, models, strategy, max(explore, 0.0), compat, 3 * k, mmr_lambda))
        weighed = propensity(listed).select("user_id", "item_id", "propensity")
    picked = listed.filter("rank is not null").join(titles.select("item_id", "language"), "item_id")
    final = language_quota(picked, k, max_share).drop("rank", "language")
    with_p = final.drop("best").withColumn("propensity", F.explode("propensity")) if weighed is None else final.join(weighed, ["user_id", "item_id"])
    return explored_flag(with_p, best, k)


def _finish(pairs: DataFrame, features: DataFrame, models: DataFrame, strategy: str, kappa: float, compat: bool, k: int, balance: float) -> DataFrame:
    """Predictive sd, the optimistic score and diversification of each shortlist in one pass.

    Shortlists are bounded by their rule, so a user's rows meet in one group. ``rank`` is NULL
    for rows diversification did not pick.
    """
    rows = pairs.join(features.select("item_id", "vec", F.size("latent").alias("_d")), "item_id")
    schema = T.StructType([*pairs.schema.fields, T.StructField("sd", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def run(lp: pd.DataFrame, mp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or mp.empty:
            return pd.DataFrame([], columns=schema.names)
        model, x = mp.iloc[0], B._stack(lp["vec"])
        phi = K._phi(model, x)
        sd = np.sqrt(np.maximum(N.quadratic(phi, N.symmetric(model["cov"], phi.shape[1])) + 1.0 / model["beta"], 1e-12))
        score = lp["score"].to_numpy(float)
        if strategy == "ucb":
            score = (lp["mean"].to_numpy(float) if compat else score) + kappa * sd
        order = np.lexsort((lp["item_id"].to_numpy(), -score))
        picks = order[N.diverse_greedy(balance * score[order], x[order, : int(lp["_d"].iloc[0])], k, 1.0 - balance)]
        rank = np.full(len(lp), None, dtype=object)
        rank[picks] = np.arange(1, len(picks) + 1)
        return lp.assign(score=score, sd=sd, rank=pd.array(rank, dtype="Int32"))[schema.names]

    left = B.spread(rows.toDF(*rows.columns), "user_id")
    right = K.packed(models).select("user_id", "cov", "beta", "n_rff", "gamma")
    right = B.spread(right.toDF(*right.columns), "user_id")
    return left.groupBy("user_id").cogroup(right.groupBy("user_id")).applyInPandas(run, schema)


def reasons(slate: DataFrame, liked: DataFrame, space: DataFrame, top: int = 3, min_similarity: float = 0.15) -> DataFrame:
    """Each pick's nearest liked titles of the same user, nearest first.

    Slates have k rows and liked lists at most their limit, so a user's pairs are bounded
    by the feature itself.
    """
    v = space.select("item_id", V.doubles(F.col("vec")).alias("_v"))
    a = slate.select("user_id", "item_id").join(v, "item_id")
    b = liked.select("user_id", F.col("item_id").alias("liked_id"), "label").join(
        v.select(F.col("item_id").alias("liked_id"), F.col("_v").alias("_u")), "liked_id")
    sims = a.join(b, "user_id").withColumn("similarity", V.dot(F.col("_v"), F.col("_u"))).drop("_v", "_u")
    w = Window.partitionBy("user_id", "item_id").orderBy(F.desc("similarity"), "liked_id")
    return sims.withColumn("rank", F.row_number().over(w)).filter(
        (F.col("rank") <= top) & (F.col("similarity") >= min_similarity))


def produce_slate(slate: DataFrame, policy: str, slate_id: Column, now: Column) -> DataFrame:
    """Impression rows of a slate; the caller appends them. An empty slate yields none."""
    from .events import append_impressions

    return append_impressions(slate.withColumn("slate_id", slate_id), policy, now)


def policy_label(strategy: str, kind: str | None) -> str:
    """The kind filter is part of the policy."""
    return f"bayesian-{strategy}-v1:{kind or 'both'}"


def judge(pairs: DataFrame, features: DataFrame, models: DataFrame, ridge: DataFrame | None = None) -> DataFrame:
    """Display-ready predictions for any (user_id, item_id) whose vector is in ``features``,
    catalogue row or not; nothing is written."""
    p = K.predict_pairs(pairs, features, models)
    low, high = S.credible_interval(F.col("mean"), F.col("sd"))
    prob = K.like_probability(F.col("mean"), F.col("sd"))
    out = p.withColumns({"score": S.display_scale(F.col("mean")), "interval_low": low, "interval_high": high, "like_probability": prob})
    out = out.withColumn("likely_like", F.col("like_probability") >= 0.5)
    if ridge is not None:
        out = K.ridge_scores(out, features, ridge).withColumn("ridge_score", S.display_scale(F.col("ridge_score")))
    return out
