"""Measuring: replayed users, ranking metrics, progressive validation, sealed and off-policy checks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions import kernels as N
from ..functions import scalar as S
from ..functions import vectors as V
from ..session import cut, landed, running_totals, with_small
from . import blocks as B
from . import taste as K
from . import timeline

# --- replayed users -----------------------------------------------------------------


def user_histories(ratings: DataFrame, links: DataFrame, eligible: DataFrame, n_users: int, min_history: int = 60, seed: int = 0) -> DataFrame:
    """Held-out users with long mapped histories; a bounded draw by hash order."""
    mapped = ratings.join(eligible.select("user_id"), "user_id", "left_semi").join(links.select("movie_id", "item_id"), "movie_id")
    mapped = mapped.groupBy("user_id", "item_id").agg(F.max_by("rating", "movie_id").alias("rating"))
    drawn = mapped.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_history).orderBy(
        S.hash_order(seed, F.col("user_id")), "user_id").limit(n_users)
    return mapped.join(drawn.select("user_id"), "user_id", "left_semi")


#: Rows of one user up to which they are placed where they meet; a user of more is placed by a range sort.
ROWS_TOGETHER = 1_000_000


def split_history(history: DataFrame, share: float = 0.4, seed: int = 0) -> DataFrame:
    """Adds ``known``: the first floor((1-share)·n) of each user's items in hash order. The history is stored once, as
    it is read more than once."""
    columns = history.columns
    history = landed(history.filter(F.col("user_id").isNotNull()), "history")
    n = history.groupBy("user_id").agg(F.count("*").alias("_n"))
    busy = cut(n.filter(F.col("_n") > ROWS_TOGETHER))
    some = not busy.isEmpty()
    # As bytes the hash takes half the room, in the same order.
    order, user = [F.asc("_h"), F.asc("item_id")], Window.partitionBy("user_id")
    hashed = history.withColumn("_h", F.unhex(S.hash_order(seed, F.col("user_id"), F.col("item_id"))))
    few = hashed.join(busy.select("user_id"), "user_id", "left_anti") if some else hashed
    placed = few.withColumns({"before": F.row_number().over(user.orderBy(*order)) - 1, "_n": F.count("*").over(user)})
    if some:
        many = running_totals(hashed.join(busy.select("user_id"), "user_id", "left_semi"), ["user_id"], order, {}).join(busy, "user_id")
        placed = placed.unionByName(many)
    # The cut truncates, with the product taken in tenths so 0.6·n has no float dust.
    return placed.withColumn("known", F.col("before") < F.floor(F.col("_n") * round(10 * (1 - share)) / 10)).select(*columns, "known")


def answers(known: DataFrame, budget: int = 30, seed: int = 0) -> DataFrame:
    """Budgeted answers in random order."""
    w = Window.partitionBy("user_id").orderBy(S.hash_order(f"answer-{seed}", F.col("user_id"), F.col("item_id")), "item_id")
    return known.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= budget).select(
        "user_id", "item_id", S.rating_reward(F.col("rating")).alias("reward"))


def relevance(held: DataFrame, at: float = 4.0) -> DataFrame:
    return held.filter(F.col("rating") >= at).select("user_id", "item_id", F.greatest(F.lit(0.0), F.col("rating") - at + 1.0).alias("relevance"))


# --- arms: (answers, items) -> ranked items per user -----------------------------------


def _same_for_all(users: DataFrame, items: DataFrame, answered: DataFrame, score: str, k: int) -> DataFrame:
    """A user-independent ranking without what each user was asked: the head of the list,
    long enough to survive the longest answer sheet, is dealt to every user."""
    most = answered.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("m")).head()["m"] or 0
    head = items.select("item_id", F.col(score).cast("double").alias("score")).orderBy(F.desc("score"), "item_id").limit(k + most)
    lst = head.agg(F.collect_list(F.struct("item_id", "score")).alias("l")).scalar()
    rows = users.select("user_id").distinct().withColumn("_i", F.explode(lst)).select("user_id", "_i.*").join(
        answered.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def arm_popularity(answered, items, k=10):
    return _same_for_all(answered, items.withColumn("_s", F.coalesce("imdb_votes", F.lit(0))), answered, "_s", k)


def arm_quality(answered, items, k=10):
    return _same_for_all(answered, items.withColumn("_s", F.coalesce("quality", F.lit(0.5))), answered, "_s", k)


def _or_quality(ranked: DataFrame, answered: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Users an arm has no model for fall back to quality."""
    lost = answered.join(ranked.select("user_id").distinct(), "user_id", "left_anti")
    return ranked.unionByName(arm_quality(lost, items, k).select(*ranked.columns))


def arm_centroid(answered, items, k=10, at: float = 0.7):
    liked = answered.filter(F.col("reward") >= at).join(items.select("item_id", "latent"), "item_id")
    mean = liked.groupBy("user_id").agg(Summarizer.mean(array_to_vector(F.col("latent"))).alias("m")).select(
        F.col("user_id").alias("qid"), V.unit(vector_to_array("m"), eps=1e-9).alias("w"))
    ranked = B.top_items(cut(mean), items.select("item_id", F.col("latent").alias("vec")), k, answered.select(F.col("user_id").alias("qid"), "item_id"))
    return _or_quality(cut(ranked.select(F.col("qid").alias("user_id"), "item_id", "score", "rank")), answered, items, k)


def arm_weighted_knn(answered, items, k=10, near: int = 30):
    """Σ max(similarity, 0)·reward over the nearest answered items. Answer sheets are budgeted,
    so one travels as an array.

    The sum over all answered items bounds that over the nearest, and is one product of all items with the
    answered ones of many users and one with their rewards; the nearest are taken only of items whose bound
    reaches the k-th best.
    """
    sheets = answered.join(items.select("item_id", "latent"), "item_id").groupBy(F.col("user_id").alias("qid")).agg(
        F.sort_array(F.collect_list(F.struct("item_id", "reward", "latent"))).alias("sheet")).select(
        "qid", F.transform("sheet", lambda x: x["item_id"]).alias("i"), F.transform("sheet", lambda x: x["reward"]).alias("r"), F.flatten(F.transform("sheet", lambda x: x["latent"])).alias("a"))
    schema = T.StructType([sheets.schema["qid"], items.schema["item_id"], T.StructField("score", T.DoubleType())])

    def run(q, found, drop):
        # Users who answered the same items stand together, so that few distinct ones meet all items at once.
        q, held = q.assign(_first=q["i"].map(lambda i: i[0])).sort_values("_first", kind="stable"), []
        for rp in found:
            held += nearest(q, rp, drop)
        best = B.as_frame(held, schema.names).sort_values(["qid", "score", "item_id"], ascending=[True, False, True])
        yield best.groupby("qid", dropna=False).head(k)

    def nearest(q, rp, drop):
        ids, x, held = rp["item_id"].to_numpy(), B._stack(rp["vec"]), []
        # Bounds in single precision, with room for its errors; sums are of the given numbers.
        plain, longest = x.T.astype(np.float32), np.sqrt((x * x).sum(axis=1)).max()
        users = max(min(2 * B.SCORES_AT_ONCE // max(len(ids), 1), SHEETS_AT_ONCE), 1)
        for k0 in range(0, len(q), users):
            part = q.iloc[k0:k0 + users]
            sizes = part["i"].map(len).to_numpy()
            vectors = np.concatenate(part["a"].to_numpy()).reshape(int(sizes.sum()), -1)
            # Rows of one vector are one column, whatever items they are.
            distinct, column = np.unique(vectors, axis=0, return_inverse=True)
            rewards = np.concatenate(part["r"].to_numpy()).astype(float)
            owner = np.repeat(np.arange(len(part)), sizes)
            column = column.ravel()
            bounds = np.zeros((len(part), len(ids)), np.float32)
            for c0 in range(0, len(distinct), SHEETS_AT_ONCE):
                mine = (column >= c0) & (column < c0 + SHEETS_AT_ONCE)
                some = distinct[c0:c0 + SHEETS_AT_ONCE]
                weight = np.zeros((len(part), len(some)), np.float32)
                np.add.at(weight, (owner[mine], column[mine] - c0), np.maximum(rewards[mine], 0.0))
                bounds += weight @ np.maximum(some.astype(np.float32) @ plain, 0.0)
            ends = np.cumsum(sizes)
            for qid, bound, end, size in zip(part["qid"], bounds, ends, sizes):
                bound[~B.keep_mask(ids, drop.get(qid))] = -np.inf
                a, r = vectors[end - size:end], rewards[end - size:end]
                first = N.best_indices(bound, 4 * k)
                first = first[np.isfinite(bound[first])]
                score = _nearest_sum(x[first], a, r, near)
                if len(first) == 4 * k:
                    # An item whose bound is below the k-th best sum found is not among the k best.
                    least = np.partition(score, len(score) - k)[len(score) - k]
                    least -= 1e-5 * (1.0 + np.abs(r).sum()) * longest * max(np.sqrt((a * a).sum(axis=1)).max(), 1.0) + 1e-9
                    if bound[first[-1]] >= least:
                        first = np.flatnonzero(bound >= least)
                        score = _nearest_sum(x[first], a, r, near)
                order = np.argsort(first, kind="stable")
                first, score = first[order], score[order]
                best = N.best_indices(score, k)
                held.append((np.full(len(best), qid), ids[first[best]], score[best]))
        return held

    gone = answered.select(F.col("user_id").alias("qid"), "item_id")
    hits = B.per_block(cut(sheets), items.select("item_id", F.col("latent").alias("vec")), gone, run, schema, block=B.MODEL_QUERIES, streamed=True)
    return B.best_per_query(hits, k).select(F.col("qid").alias("user_id"), "item_id", "score", "rank")


#: Answer sheets, and distinct answered vectors, that meet all items of a shard in one product.
SHEETS_AT_ONCE = 512


def _nearest_sum(x: np.ndarray, a: np.ndarray, rewards: np.ndarray, near: int) -> np.ndarray:
    sims = x @ a.T
    if len(rewards) <= near:
        return np.maximum(sims, 0.0) @ rewards
    pick = np.argpartition(-sims, near - 1, axis=1)[:, :near]
    return (np.maximum(np.take_along_axis(sims, pick, 1), 0.0) * rewards[pick]).sum(axis=1)


def _arm_model(answered, items, k, negatives: str | None):
    labels = answered.withColumn("weight", F.lit(1.0))
    feats = items.select("item_id", "vec")
    if negatives == "popular":
        models = K.fit_taste_popular(labels, feats, items)
    else:
        draw = K.sample_negatives(feats) if negatives else None
        models = K.fit_taste(labels, feats, draw)
    ranked = K.top_scored(cut(K.mean_weights(models)), feats, k, answered.select("user_id", "item_id"))
    return _or_quality(cut(ranked.select("user_id", "item_id", "score", "rank")), answered, items, k)


def arm_taste(answered, items, k=10):
    return _arm_model(answered, items, k, "uniform")


def arm_taste_no_negatives(answered, items, k=10):
    return _arm_model(answered, items, k, None)


def arm_taste_popular_negatives(answered, items, k=10):
    return _arm_model(answered, items, k, "popular")


def arm_ridge(answered, items, k=10):
    feats = items.select("item_id", "vec")
    ridge = K.ridge_baseline(answered, feats, K.sample_negatives(feats))
    q = cut(ridge.select(F.col("user_id").alias("qid"), "w", "b"))
    ranked = B.top_items(q, feats, k, answered.select(F.col("user_id").alias("qid"), "item_id"), bias=True)
    return _or_quality(cut(ranked.select(F.col("qid").alias("user_id"), "item_id", "score", "rank")), answered, items, k)


ARMS = {
    "popularity": arm_popularity, "quality-prior": arm_quality, "content-centroid": arm_centroid, "weighted-knn": arm_weighted_knn,
    "ridge": arm_ridge, "taste-no-negatives": arm_taste_no_negatives, "taste-popular-negatives": arm_taste_popular_negatives, "taste": arm_taste,
}

# --- ranking metrics: ranked(user_id[, arm], item_id, rank), relevance(user_id, item_id, relevance) ---


def _keys(ranked: DataFrame) -> list[str]:
    return [c for c in ("user_id", "arm") if c in ranked.columns]


def _hits(ranked: DataFrame, rel: DataFrame, k: int) -> DataFrame:
    return ranked.filter(F.col("rank") <= k).join(rel, ["user_id", "item_id"], "left").withColumn("hit", (F.coalesce("relevance", F.lit(0.0)) > 0).cast("int"))


def _ideal(rel: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("relevance"), "item_id")
    top = rel.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    ideal = top.groupBy("user_id").agg(F.sum(F.col("relevance") / F.log2(F.col("_r") + 1.0)).alias("ideal"))
    return rel.groupBy("user_id").agg(F.count_if(F.col("relevance") > 0).alias("positives")).join(ideal, "user_id")


def ndcg_at_k(ranked: DataFrame, rel: DataFrame, k: int = 10) -> DataFrame:
    keys = _keys(ranked)
    dcg = _hits(ranked, rel, k).groupBy(*keys).agg(F.sum(F.coalesce("relevance", F.lit(0.0)) / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    return dcg.join(_ideal(rel, k), "user_id", "left").select(*keys, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def precision_recall(ranked: DataFrame, rel: DataFrame, k: int = 10) -> DataFrame:
    keys = _keys(ranked)
    h = _hits(ranked, rel, k).groupBy(*keys).agg(F.sum("hit").alias("_h")).join(_ideal(rel, k), "user_id", "left")
    return h.select(*keys, (F.col("_h") / k).alias("precision"), F.coalesce(F.try_divide("_h", F.col("positives")), F.lit(0.0)).alias("recall"))


def average_precision(ranked: DataFrame, rel: DataFrame, k: int = 10) -> DataFrame:
    keys = _keys(ranked)
    w = Window.partitionBy(*keys).orderBy("rank")  # a slate has k rows
    run = _hits(ranked, rel, k).withColumn("_c", F.sum("hit").over(w))
    s = run.groupBy(*keys).agg(F.sum(F.col("hit") * F.col("_c") / F.col("rank")).alias("_s")).join(_ideal(rel, k), "user_id", "left")
    return s.select(*keys, F.coalesce(F.try_divide("_s", F.least("positives", F.lit(k))), F.lit(0.0)).alias("map"))


def reciprocal_rank(ranked: DataFrame, rel: DataFrame, k: int = 10) -> DataFrame:
    keys = _keys(ranked)
    return _hits(ranked, rel, k).groupBy(*keys).agg(F.coalesce(1.0 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"))


def novelty(ranked: DataFrame, popularity: DataFrame, k: int = 10) -> DataFrame:
    total = popularity.agg(F.greatest(F.sum("popularity"), F.lit(1)).alias("t")).scalar()
    j = ranked.filter(F.col("rank") <= k).join(popularity, "item_id", "left")
    return j.groupBy(*_keys(ranked)).agg(F.avg(S.self_information(F.col("popularity"), total)).alias("novelty"))


def intra_list_diversity(ranked: DataFrame, space: DataFrame, k: int = 10) -> DataFrame:
    """1 − mean pairwise similarity, from ‖Σv‖² instead of pairs."""
    keys = _keys(ranked)
    j = ranked.filter(F.col("rank") <= k).join(space.select("item_id", V.doubles(F.col("vec")).alias("v")), "item_id")
    s = j.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(V.dot(F.col("v"), F.col("v"))).alias("own"),
                             vector_to_array(Summarizer.sum(array_to_vector(F.col("v")))).alias("sum"))
    pairs = F.col("n") * (F.col("n") - 1)
    return s.select(*keys, F.when(F.col("n") < 2, 0.0).otherwise(1.0 - F.try_divide(V.dot(F.col("sum"), F.col("sum")) - F.col("own"), pairs)).alias("diversity"))


def serendipity(ranked: DataFrame, rel: DataFrame, popularity: DataFrame, k: int = 10, cutoff: int = 200) -> DataFrame:
    top = popularity.orderBy(F.desc("popularity"), "item_id").limit(cutoff).select("item_id", F.lit(1).alias("_p"))
    j = _hits(ranked, rel, k).join(top, "item_id", "left")
    return j.groupBy(*_keys(ranked)).agg((F.sum(F.when(F.col("_p").isNull(), F.col("hit")).otherwise(0)) / k).alias("serendipity"))


def ranking_metrics(ranked: DataFrame, rel: DataFrame, popularity: DataFrame, space: DataFrame, k: int = 10) -> DataFrame:
    keys = _keys(ranked)
    out = ndcg_at_k(ranked, rel, k)
    for part in (precision_recall(ranked, rel, k), average_precision(ranked, rel, k), reciprocal_rank(ranked, rel, k),
                 novelty(ranked, popularity, k), intra_list_diversity(ranked, space, k), serendipity(ranked, rel, popularity, k)):
        out = out.join(part, keys)
    return out


def summarise_metrics(rows: DataFrame, metrics: list[str], by: str = "arm") -> DataFrame:
    """Mean and standard error per metric, long form."""
    long = rows.select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("_m"))
    return long.groupBy(by, F.col("_m.metric").alias("metric")).agg(
        F.count("*").alias("n"), F.avg("_m.v").alias("mean"),
        F.when(F.count("*") > 1, F.stddev_samp("_m.v") / F.sqrt(F.count("*"))).otherwise(0.0).alias("se"))


def evaluate_arms(history: DataFrame, items: DataFrame, arms: tuple = tuple(ARMS), budget: int = 30, k: int = 10, seed: int = 0,
                  exclude_known: bool = False) -> DataFrame:
    """Every arm on identical answers: one metric row per (user, arm)."""
    split = cut(split_history(history, seed=seed))
    told = answers(split.filter("known"), budget, seed)
    rel = cut(relevance(split.filter(~F.col("known"))))
    enough = told.groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 3").select("user_id").join(rel.select("user_id").distinct(), "user_id", "left_semi")
    told = cut(told.join(enough, "user_id", "left_semi"))
    space = items.select("item_id", F.col("latent").alias("vec"))
    popularity = items.select("item_id", F.coalesce("imdb_votes", F.lit(0)).alias("popularity"))
    depth, known = k, split.filter("known").select("user_id", "item_id")
    if exclude_known:
        # Known but unasked titles are no misses: rank deep enough to drop them all.
        depth = k + (known.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("m")).head()["m"] or 0)
    ranked = None
    for name in arms:
        rows = ARMS[name](told, items, depth).select("user_id", "item_id", "rank")
        if exclude_known:
            left = rows.join(known, ["user_id", "item_id"], "left_anti")
            rows = left.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("rank"))).filter(F.col("rank") <= k)
        rows = rows.withColumn("arm", F.lit(name))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    return ranking_metrics(cut(ranked), rel, popularity, space, k)


# --- resampling ---------------------------------------------------------------------


#: A round counts a row as often as a Poisson variable of mean 1 says: the value whose bounds its
#: 24-bit draw falls between. The draw is a hash of (seed, round, row), the same in any engine.
POISSON_BOUNDS = [int(sum(1 / math.factorial(k) for k in range(n + 1)) / math.e * (1 << 24)) for n in range(10)]
DRAW_FACTORS = (0x1B873593, 0x2545F491, 0x7FEB352D, 0x2C1B3C6D)
_ROWS_AT_ONCE = 64
#: Keys whose rounds a task adds up before it passes them on.
_KEYS_AT_ONCE = 256


def poisson_counts(rows: np.ndarray, rounds: np.ndarray, seed: int = 0) -> np.ndarray:
    """Counts (rows x rounds)."""
    row, turn, first, second = (np.uint32(f) for f in DRAW_FACTORS)
    # Unsigned numbers of 32 bits wrap around by themselves.
    turns = rounds.astype(np.uint32) * turn + np.uint32(seed & 0xFFFFFFFF)
    x = ((rows.astype(np.int64) & 0x7FFFFFFF).astype(np.uint32) * row)[:, None] + turns[None, :]
    x = (x ^ (x >> np.uint32(16))) * first
    x = (x ^ (x >> np.uint32(15))) * second
    x = (x ^ (x >> np.uint32(16))) >> np.uint32(8)
    counts = np.zeros(x.shape, np.int8)
    for bound in POISSON_BOUNDS:
        counts += x >= np.uint32(bound)
    return counts


def resampled_means(values: DataFrame, iters: int, keys: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Poisson-bootstrap means: values(keys, idx, v) -> (keys, iter, mean).

    Each task adds its rows into one vector of sums and one of counts per key, so what is
    shuffled is keys x tasks x rounds, whatever the number of rows. A round that counts no row
    has no mean.
    """
    keys = keys or []
    rows = values.select(*keys, "idx", "v")
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("iter", T.IntegerType()), T.StructField("s", T.DoubleType()), T.StructField("c", T.LongType())])
    rounds = np.arange(iters)

    def run(batches):
        total: dict = {}

        def sent():
            for key, (sums, counts) in total.items():
                yield pd.DataFrame({**dict(zip(keys, key)), "iter": rounds.astype(np.int32), "s": sums, "c": counts})[schema.names]
            total.clear()

        for pdf in batches:
            drawn: dict = {}  # values of several keys have the same row numbers
            for key, part in pdf.groupby(keys, sort=False) if keys else [((), pdf)]:
                if key not in total and len(total) >= _KEYS_AT_ONCE:
                    yield from sent()
                sums, counts = total.setdefault(key, (np.zeros(iters), np.zeros(iters, np.int64)))
                idx, v = part["idx"].to_numpy(), part["v"].to_numpy(float)
                for k in range(0, len(idx), _ROWS_AT_ONCE):
                    some = idx[k:k + _ROWS_AT_ONCE]
                    if (named := some.tobytes()) not in drawn:
                        if len(drawn) >= _KEYS_AT_ONCE:
                            drawn.clear()
                        c = poisson_counts(some, rounds, seed)
                        drawn[named] = c, c.sum(axis=0, dtype=np.int64)
                    c, times = drawn[named]
                    sums += v[k:k + _ROWS_AT_ONCE] @ c
                    counts += times
        yield from sent()

    return rows.mapInPandas(run, schema).groupBy(*keys, "iter").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).filter("c > 0").select(
        *keys, "iter", (F.col("s") / F.col("c")).alias("mean"))


#: Values of a key up to which its rounds are drawn and read off where its rows meet.
FEW_VALUES = 1024


def resampled_intervals(values: DataFrame, iters: int, keys: list[str], bounds: tuple = (0.025, 0.975), seed: int = 0) -> DataFrame:
    """Quantiles of the Poisson-bootstrap means: values(keys, idx, v, n: how many the key has) -> (keys, ci).

    A key of few values sends its rows to one task, which draws its rounds and returns their quantiles alone; the draws of
    a row number are the same for all keys and are made once a task. A key of many values is added up where
    its rows are, as ``resampled_means`` does.
    """
    rows = values.select(*keys, "idx", "v", "n")
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("ci", T.ArrayType(T.DoubleType()))])
    rounds = np.arange(iters)

    def run(batches):
        drawn, held = {}, None

        def counts(idx):
            blocks = idx // _ROWS_AT_ONCE
            for block in np.unique(blocks):
                if block not in drawn:
                    if len(drawn) >= 2 * FEW_VALUES // _ROWS_AT_ONCE:
                        drawn.clear()
                    drawn[block] = poisson_counts(block * _ROWS_AT_ONCE + np.arange(_ROWS_AT_ONCE), rounds, seed)
            return [(blocks == block, drawn[block][idx[blocks == block] % _ROWS_AT_ONCE].astype(float)) for block in np.unique(blocks)]

        def read(pdf):
            out = []
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                idx, v = part["idx"].to_numpy(np.int64), part["v"].to_numpy(float)
                sums, times = np.zeros(iters), np.zeros(iters)
                for mine, c in counts(idx):
                    sums += v[mine] @ c
                    times += c.sum(axis=0)
                some = times > 0
                out.append((*key, np.quantile(sums[some] / times[some], bounds) if some.any() else None))
            return pd.DataFrame(out, columns=schema.names)

        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            # The last key's rows may go on in the next batch.
            last = (held[keys].iloc[-1:].reset_index(drop=True).loc[np.zeros(len(held), int)].reset_index(drop=True))
            same = ((held[keys] == last) | (held[keys].isna() & last.isna())).all(axis=1).to_numpy()
            if not same.all():
                yield read(held[~same])
                held = held[same].reset_index(drop=True)
        if held is not None and len(held):
            yield read(held)

    few = B.gathered(rows.filter(F.col("n") <= FEW_VALUES), *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
    many = resampled_means(rows.filter(F.col("n") > FEW_VALUES), iters, keys, seed)
    return few.unionByName(many.groupBy(*keys).agg(F.percentile("mean", F.array(*[F.lit(b) for b in bounds])).alias("ci")))


def paired_bootstrap(metrics: DataFrame, a: str, b: str, metric: str = "ndcg", iters: int = 10_000, seed: int = 0) -> DataFrame:
    """Mean paired difference and the share of resampled means at or below zero."""
    diff = metrics.filter(F.col("arm").isin(a, b)).groupBy("user_id").agg(
        F.max(F.when(F.col("arm") == a, F.col(metric))).alias("x"), F.max(F.when(F.col("arm") == b, F.col(metric))).alias("y")).select(
        "user_id", (F.col("x") - F.col("y")).alias("v")).filter("v is not null")
    placed = cut(diff.withColumn("idx", F.col("user_id").cast("long")))
    boots = resampled_means(placed.select("idx", "v"), iters, seed=seed).agg(F.avg((F.col("mean") <= 0).cast("double")).alias("p")).scalar()
    return placed.agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("delta"), F.count("*").alias("n")).withColumn("p", F.coalesce(boots, F.lit(1.0)))


def average_rank(df: DataFrame, group: list[str], value: str, tie: str) -> DataFrame:
    """Ranks with ties averaged, without one window per group."""
    placed = running_totals(df, group, [F.asc(value), F.asc(tie)], {})
    shared = placed.groupBy(*group, value).agg((F.avg("before") + 1).alias(f"{value}_rank"))
    return df.join(shared, [*group, value])


def exact_quantile(df: DataFrame, group: list[str], value: str, q: float, tie: str) -> DataFrame:
    """Linear-interpolated quantile per group from two order statistics."""
    placed = running_totals(df.select(*group, value, tie), group, [F.asc(value), F.asc(tie)], {})
    n = placed.groupBy(*group).agg(F.count("*").alias("_n"))
    pos = F.lit(q) * (F.col("_n") - 1)
    near = placed.join(n, group) if group else placed.withColumn("_n", n.scalar())
    near = near.withColumn("_pos", pos).filter((F.col("before") == F.floor("_pos")) | (F.col("before") == F.ceil("_pos")))
    low = F.max(F.when(F.col("before") == F.floor("_pos"), F.col(value)))
    high = F.max(F.when(F.col("before") == F.ceil("_pos"), F.col(value)))
    return near.groupBy(*group).agg((low + (high - low) * F.max(F.col("_pos") - F.floor("_pos"))).alias("quantile"))


# --- progressive validation -----------------------------------------------------------

SEGMENT, MIN_TRAIN, RFF_FROM = 64, 5, 150


def _walk(seq: DataFrame, features: DataFrame, capacity: tuple, penalty) -> DataFrame:
    """Predict every step from all earlier ones. Moments of 64-step segments are summed up
    to each segment's start, so segments walk in parallel and no step re-reads the past."""
    width, gamma = capacity
    rows = seq.join(features.select("item_id", "vec"), "item_id").withColumn("seg", F.floor(F.col("step") / SEGMENT).cast("int"))
    lifted = K._lifted(rows.select("user_id", "seg", "step", "reward", "vec"), capacity, 0)
    lifted = cut(lifted)
    parts = B.moments(lifted.select("user_id", "seg", F.lit(1.0).alias("w"), F.col("reward").alias("y"), F.lit(1.0).alias("cnt"), "vec"), ["user_id", "seg"])
    sums = cut(timeline.earlier_sums(parts.select("user_id", F.col("seg").cast("long").alias("g"), F.concat("packed", F.array("n")).alias("packed")), ["user_id"]))
    starts = None
    for (level,) in sorted(sums.select("level").distinct().collect()):
        up = lifted.select("user_id", "seg").distinct().withColumn("g", F.floor(F.col("seg") / timeline.FAN**level).cast("long"))
        some = up.join(sums.filter(F.col("level") == level).drop("level"), ["user_id", "g"]).select("user_id", "seg", "packed")
        starts = some if starts is None else starts.unionByName(some)
    schema = T.StructType([seq.schema["user_id"], T.StructField("step", T.LongType()), T.StructField("actual", T.DoubleType()), T.StructField("predicted", T.DoubleType()),
                           T.StructField("sd", T.DoubleType()), T.StructField("evidence", T.DoubleType()), T.StructField("width", T.IntegerType()), T.StructField("gamma", T.DoubleType())])

    def predict(rp, sp):
        if rp.empty or sp.empty:
            return pd.DataFrame([], columns=schema.names)
        rp = rp.sort_values("step", ignore_index=True)
        aug = N.augmented(B._stack(rp["vec"]), rp["reward"].to_numpy(float))
        m, n, out = np.zeros((aug.shape[1],) * 2), 0.0, []
        for packed in sp["packed"]:  # one a level
            if packed is not None and len(packed):
                m, n = m + N.unpack(packed[:-1], aug.shape[1]), n + packed[-1]
        for a, step in zip(aug, rp["step"]):
            f = len(a) - 1
            if step >= (RFF_FROM if width else MIN_TRAIN) and not (width and f > max(8 * n, 64)):
                mean, cov, _, beta, ev, y_mean = N.posterior(m, n, penalty)
                phi = a[:-1]
                sd = float(np.sqrt(max(phi @ cov @ phi + 1.0 / beta, 1e-12)))
                out.append((rp["user_id"].iloc[0], int(step), float(a[-1]), float(phi @ mean + y_mean), sd, ev, width, gamma))
            m, n = m + np.outer(a, a), n + 1.0
        return pd.DataFrame(out, columns=schema.names)

    lifted, starts = B.spread(lifted.toDF(*lifted.columns), "user_id", "seg"), B.spread(starts.toDF(*starts.columns), "user_id", "seg")
    return lifted.groupBy("user_id", "seg").cogroup(starts.groupBy("user_id", "seg")).applyInPandas(predict, schema)


def prequential(sequence: DataFrame, features: DataFrame, penalty: float | None = dims.PENALTY, z: float = 1.6448536269514722,
                lifts: bool = True, serving: DataFrame | None = None, negatives: DataFrame | None = None,
                half_life: float = dims.HALF_LIFE_DAYS) -> DataFrame:
    """Each verdict predicted from the ones before it, beside the running-mean control.

    ``sequence``: user_id, item_id, step (0-based), reward, earlier_mean. The plain fit weighs first
    verdicts alike. With ``serving`` (``timeline.label_changes``; ``sequence`` then has ts too) each
    step is predicted by the model that would have served at that moment: latest verdicts, skips until a
    verdict replaces them, fading weights, and ``negatives`` if given.
    """
    if serving is not None:
        asked = sequence.filter(F.col("step") >= MIN_TRAIN).withColumn("ask_id", F.col("step"))
        out = timeline.predict_as_of(serving, asked, features, negatives, penalty, half_life).select(
            "user_id", F.col("ask_id").alias("step"), F.col("mean").alias("predicted"), "sd")
        return _beside_control(out.join(sequence.select("user_id", "step", F.col("reward").alias("actual")), ["user_id", "step"]), sequence, z)
    out = _walk(sequence, features, K.CAPACITIES[0], penalty)
    long = sequence.groupBy("user_id").agg(F.max("step").alias("m")).filter(F.col("m") >= RFF_FROM).select("user_id")
    if lifts and long.limit(1).count():
        some = cut(sequence.join(long, "user_id", "left_semi"))
        for capacity in K.CAPACITIES[1:]:
            out = out.unionByName(_walk(some, features, capacity, penalty))
        rank = F.struct("evidence", (-F.col("width")).alias("_w"), (-F.col("gamma")).alias("_g"))
        out = out.groupBy("user_id", "step").agg(F.max_by(F.struct("actual", "predicted", "sd"), rank).alias("_b")).select("user_id", "step", "_b.*")
    return _beside_control(out, sequence, z)


def _beside_control(out: DataFrame, sequence: DataFrame, z: float) -> DataFrame:
    control = sequence.select("user_id", "step", F.abs(F.col("earlier_mean") - F.col("reward")).alias("control_error"))
    return out.select("user_id", "step", "actual", "predicted", "sd").join(control, ["user_id", "step"]).withColumns({
        "error": F.abs(F.col("predicted") - F.col("actual")), "inside": F.abs(F.col("predicted") - F.col("actual")) <= F.lit(z) * F.col("sd")})


def _two_sided(t: float, df: float) -> float:
    """Student-t tail by the continued fraction of the incomplete beta function."""
    from math import exp, lgamma, log

    if df <= 0:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    flip = x > (a + 1.0) / (a + b + 2.0)
    if flip:
        a, b, x = b, a, 1.0 - x
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    frac = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            frac *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    value = exp(a * log(x) + b * log(1.0 - x) - (lgamma(a) + lgamma(b) - lgamma(a + b))) * frac / a
    return 1.0 - value if flip else value


@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    def one(rho, count):
        if rho is None or rho != rho or count is None or count < 3:
            return None
        rest = 1.0 - rho * rho
        return 0.0 if rest <= 0 else _two_sided(rho * ((count - 2) / rest) ** 0.5, count - 2)

    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")


def _corr(x: str, y: str) -> Column:
    """Correlation, NULL rather than an error when either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def audit_readings(steps: DataFrame, window: int = 10, uninformative: float = 0.005, interval: float = 0.90) -> DataFrame:
    """One row per user: error, control, coverage, rank correlation, skill trend and slope;
    NULL where the sample is too small to say."""
    steps = cut(steps)
    base = steps.groupBy("user_id").agg(
        F.count("*").alias("n"), (F.avg("error") * 10).alias("mae"), (F.avg("control_error") * 10).alias("control_mae"),
        F.avg(F.col("inside").cast("double")).alias("coverage"))
    informative = steps.filter(F.col("control_error") > uninformative).withColumn("skill", F.col("control_error") - F.col("error"))
    sizes = informative.groupBy("user_id").agg(
        F.count("*").alias("n_informative"), F.try_divide(F.covar_pop("skill", "step"), F.var_pop("step")).alias("_slope"), _corr("skill", "step").alias("_r"))
    w = F.when(F.col("n_informative") < 2 * window, F.greatest(F.floor(F.col("n_informative") / 2), F.lit(1))).otherwise(window)
    placed = running_totals(informative.select("user_id", "step", "skill"), ["user_id"], [F.asc("step")], {}).join(sizes.select("user_id", "n_informative"), "user_id").withColumn("_w", w)
    trend = placed.groupBy("user_id").agg(
        F.avg(F.when(F.col("before") < F.col("_w"), F.col("skill"))).alias("early_skill"),
        F.avg(F.when(F.col("before") >= F.col("n_informative") - F.col("_w"), F.col("skill"))).alias("late_skill"))
    a = average_rank(steps.select("user_id", "step", "predicted"), ["user_id"], "predicted", "step").select("user_id", "step", "predicted_rank")
    b = average_rank(steps.select("user_id", "step", "actual"), ["user_id"], "actual", "step").select("user_id", "step", "actual_rank")
    rho = a.join(b, ["user_id", "step"]).groupBy("user_id").agg(_corr("predicted_rank", "actual_rank").alias("_rho"))
    out = base.join(sizes, "user_id", "left").join(trend, "user_id", "left").join(rho, "user_id", "left")
    enough, enough_i = F.col("n") >= 8, F.coalesce("n_informative", F.lit(0)) >= 8
    return out.select(
        "user_id", "n", "mae", "control_mae", "coverage", F.coalesce("n_informative", F.lit(0)).alias("n_informative"), "early_skill", "late_skill",
        F.when(enough_i, F.col("_slope")).alias("slope"), F.when(enough_i, correlation_p_value(F.col("_r"), F.col("n_informative"))).alias("slope_p"),
        F.when(enough, F.col("_rho")).alias("spearman"), F.when(enough, correlation_p_value(F.col("_rho"), F.col("n"))).alias("spearman_p"),
        (F.col("mae") < F.col("control_mae")).alias("model_wins"), (F.abs(F.col("coverage") - interval) < 0.12).alias("calibrated"),
        F.when(F.col("early_skill").isNull(), "need more data").when(F.col("late_skill") > F.col("early_skill"), "improving").otherwise("flat or worse").alias("trend"))


# --- off-policy -----------------------------------------------------------------------


def snips(logged: DataFrame, temperature: float = 1.0, least: int = 30, keys: tuple = ("user_id",), per_slate: bool = False) -> DataFrame:
    """Self-normalised importance estimate from (keys, row_id, reward, propensity, score);
    NULL below ``least`` rows. ``per_slate`` normalises the new policy inside each slate."""
    keys = list(keys)
    inner = [*keys, "slate_id"] if per_slate else keys
    top = logged.groupBy(*inner).agg(F.max("score").alias("_m"))
    e = logged.join(top, inner).withColumn("_e", F.exp((F.col("score") - F.col("_m")) / max(temperature, 1e-6)))
    z = e.groupBy(*inner).agg(F.sum("_e").alias("_z"))
    w = cut(e.join(z, inner).withColumn("_w", F.col("_e") / F.col("_z") / F.greatest("propensity", F.lit(1e-6))).select(*keys, "row_id", "reward", "_w"))
    clip = exact_quantile(w, keys, "_w", 0.99, "row_id")
    c = F.least("_w", "quantile")
    out = w.join(clip, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(c * F.col("reward")).alias("_a"), F.sum(c).alias("_b"), F.avg("reward").alias("logged_value"))
    return out.select(*keys, "n", "logged_value", F.when((F.col("n") >= least) & (F.col("_b") > 0), F.col("_a") / F.col("_b")).alias("estimate"))


def off_policy_status(usable: DataFrame, models: DataFrame | None, features: DataFrame, least: int = 30, per_slate: bool = False,
                      fit_before: tuple[DataFrame, DataFrame] | None = None, negatives: DataFrame | None = None, space_id: str | None = None) -> DataFrame:
    """Why each user has an estimate or not, and the estimate.

    ``models`` scores all of a user's logged picks. With ``fit_before`` (changes of
    ``timeline.label_changes``, impressions with their ts) each pick is scored by the model of what was
    known before its impression instead; picks without a model yet are left out of the estimate.
    With ``space_id``, picks whose column space_id differs count as made in another item space, like
    picks whose item the space no longer holds.
    """
    gone = F.col("_in").isNull()
    if space_id is not None:
        gone |= ~F.col("space_id").eqNullSafe(F.lit(space_id))
    picks = cut(usable.withColumn("row_id", F.xxhash64("impression_id", "slate_id", "reward")))
    rows = picks.join(features.select("item_id", F.lit(True).alias("_in")), "item_id", "left")
    s = rows.groupBy("user_id").agg(F.count("*").alias("n_usable"), F.count_if(gone).alias("_out"))
    if fit_before is None:
        have = models.select("user_id", F.lit(True).alias("_model"))
    else:
        changes, shown = fit_before
        asked = picks.join(shown.select("impression_id", "ts"), "impression_id").select("user_id", "item_id", F.col("row_id").alias("ask_id"), "ts").distinct()
        known = cut(timeline.predict_as_of(changes, asked, features, negatives).select("user_id", F.col("ask_id").alias("row_id"), F.col("mean").alias("score")))
        have = known.select("user_id").distinct().withColumn("_model", F.lit(True))
    ok = cut(s.join(have, "user_id", "left").withColumn(
        "status", F.when(F.col("n_usable") < least, "not-enough-data").when(F.col("_model").isNull(), "no-model")
        .when(F.col("_out") > 0, "item-space-changed").otherwise("ok")))
    good = picks.join(ok.filter("status = 'ok'").select("user_id"), "user_id", "left_semi").select("user_id", "item_id", "slate_id", "row_id", "reward", "propensity")
    if fit_before is None:
        scored = K.predict_pairs(good, features, models).withColumnRenamed("mean", "score")
    else:
        scored = good.join(known, ["user_id", "row_id"])
    est = snips(scored, least=least, per_slate=per_slate).select("user_id", "estimate")
    value = good.groupBy("user_id").agg(F.avg("reward").alias("logged_value"))
    return ok.join(value, "user_id", "left").join(est, "user_id", "left").select(
        "user_id", "n_usable", F.when((F.col("status") == "ok") & F.col("estimate").isNull(), "estimate-unavailable").otherwise(F.col("status")).alias("status"),
        "logged_value", "estimate", (F.col("estimate") > F.col("logged_value")).alias("better"))


# --- sealed predictions ---------------------------------------------------------------


def seal_candidates(wanted: DataFrame, titles: DataFrame, events: DataFrame, cases: DataFrame, least: int = 20) -> DataFrame:
    """Distinct (batch_id, user_id, item_id) with ``reject``; NULL means it can be sealed."""
    rows = wanted.select("batch_id", "user_id", "item_id").distinct()
    n = rows.groupBy("batch_id").agg(F.count("*").alias("_n"))
    rated = events.filter(F.col("kind") == "rate").select("user_id", "item_id").distinct().withColumn("_r", F.lit(True))
    old = cases.select("user_id", "item_id").distinct().withColumn("_o", F.lit(True))
    known = titles.select("item_id", F.lit(True).alias("_k"))
    j = rows.join(n, "batch_id").join(rated, ["user_id", "item_id"], "left").join(old, ["user_id", "item_id"], "left").join(known, "item_id", "left")
    return j.withColumn("reject", F.when(F.col("_n") < least, "too few candidates").when(F.col("_k").isNull(), "not in catalogue")
                        .when(F.col("_r"), "already rated").when(F.col("_o"), "already sealed")).select("batch_id", "user_id", "item_id", "reject")


def seal_predictions(candidates: DataFrame, features: DataFrame, models: DataFrame, ridge: DataFrame, now: Column) -> DataFrame:
    """Immutable cases of batches without a reject: both models' scores, chances and places."""
    bad = candidates.filter("reject is not null").select("batch_id").distinct()
    pairs = candidates.join(bad, "batch_id", "left_anti").drop("reject")
    p = K.ridge_scores(K.predict_pairs(pairs, features, models), features, ridge)
    full = Window.partitionBy("batch_id").orderBy(F.desc("mean"), "item_id")
    alt = Window.partitionBy("batch_id").orderBy(F.desc("ridge_score"), "item_id")
    return p.select(
        F.concat(F.lit("case-"), F.md5(F.concat_ws("-", "batch_id", F.col("user_id").cast("string"), F.col("item_id").cast("string")))).alias("case_id"),
        "batch_id", "user_id", "item_id", now.alias("sealed_at"), F.col("mean").alias("full_score"), F.col("sd").alias("full_std"),
        K.like_probability(F.col("mean"), F.col("sd")).alias("full_like_prob"), "ridge_score", S.ridge_like_probability(F.col("ridge_score")).alias("ridge_like_prob"),
        F.row_number().over(full).alias("full_rank"), F.row_number().over(alt).alias("ridge_rank"), F.lit("sealed").alias("status"),
        F.lit(None).cast("double").alias("actual_reward"), F.lit(None).cast("string").alias("actual_verdict"), F.lit(None).cast("timestamp_ntz").alias("revealed_at"))


def reveal_predictions(cases: DataFrame, reveals: DataFrame) -> DataFrame:
    """Cases after the first reveal of each; ``unseen`` records no reward."""
    first = reveals.groupBy("case_id").agg(F.min_by(F.struct("verdict", "ts"), F.struct("ts", "verdict")).alias("_v"))
    j = cases.join(first, "case_id", "left")
    reward = dims.lookup(dims.VERDICTS, F.col("_v.verdict"))
    unseen = F.col("_v.verdict") == "unseen"
    now = (F.col("status") == "sealed") & (unseen | reward.isNotNull())
    return j.withColumns({
        "actual_reward": F.when(now & ~unseen, reward).otherwise(F.col("actual_reward")),
        "actual_verdict": F.when(now, F.col("_v.verdict")).otherwise(F.col("actual_verdict")),
        "revealed_at": F.when(now, F.col("_v.ts")).otherwise(F.col("revealed_at")),
        "status": F.when(now & unseen, "unseen").when(now, "revealed").otherwise(F.col("status")),
    }).drop("_v")


def reveal_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """Verdict events of newly revealed cases."""
    new = after.filter("status = 'revealed'").join(before.filter("status = 'sealed'").select("case_id"), "case_id", "left_semi")
    return new.select("user_id", "item_id", F.lit("rate").alias("kind"), (F.col("actual_reward") * 10).alias("value"), F.lit("validation").alias("source"),
                      F.to_json(F.struct(F.col("actual_verdict").alias("verdict"))).alias("context"), F.col("revealed_at").alias("ts"))


def open_cases(cases: DataFrame, titles: DataFrame) -> DataFrame:
    return cases.filter("status = 'sealed'").join(titles.select("item_id", "title", "year", "kind"), "item_id")


def _intervals(values: DataFrame, iters: int) -> DataFrame:
    """Per (user_id, what): number, mean and 95% bootstrap interval if it has at least two values.
    ``values`` has user_id, what, idx and v."""
    sizes = cut(values.groupBy("user_id", "what").agg(F.count("*").alias("n"), F.avg("v").alias("value")))
    known = values.join(with_small(sizes.select("user_id", "what", "n")), ["user_id", "what"])
    ci = resampled_intervals(known, iters, ["user_id", "what"])
    return sizes.join(ci, ["user_id", "what"], "left").select(
        "user_id", "what", "n", "value", F.when(F.col("n") >= 2, F.col("ci")[0]).alias("low"), F.when(F.col("n") >= 2, F.col("ci")[1]).alias("high"))


def validation_summary(cases: DataFrame, iters: int = 5000, compat: bool = False) -> DataFrame:
    """Per user and measure, over complete batches only, with the decision on each row.

    Unseen cases leave their batch; with ``compat`` one of them keeps it incomplete.
    """
    live = cases if compat else cases.filter("status <> 'unseen'")
    done = live.groupBy("batch_id").agg(F.count("*").alias("_n"), F.count_if(F.col("status") != "revealed").alias("_open")).filter("_open = 0")
    c = live.join(done.select("batch_id", "_n"), "batch_id")
    full = Window.partitionBy("batch_id").orderBy("full_rank")
    alt = Window.partitionBy("batch_id").orderBy("ridge_rank")
    k = F.least(F.lit(10), "_n")
    hit = (F.col("actual_reward") >= dims.LIKE_AT).cast("double")
    c = c.withColumns({"fr": F.row_number().over(full), "rr": F.row_number().over(alt), "hit": hit}).withColumn("k", k)
    measures = {
        "full_mae": F.abs(F.col("full_score") - F.col("actual_reward")), "ridge_mae": F.abs(F.col("ridge_score") - F.col("actual_reward")),
        "full_brier": (F.col("full_like_prob") - F.col("hit")) ** 2,
        "full_top10": F.when(F.col("fr") <= F.col("k"), F.col("hit")), "ridge_top10": F.when(F.col("rr") <= F.col("k"), F.col("hit"))}
    # Cases are sorted once, not once a measure: a value's number among its user's is a running count beside the case.
    slim = c.select("user_id", "batch_id", F.concat_ws("|", "batch_id", "case_id").alias("o"), *[v.cast("double").alias(w) for w, v in measures.items()])
    c = running_totals(slim, ["user_id"], [F.asc("o")], {f"n_{w}": F.col(w).isNotNull().cast("double") for w in measures})
    c = landed(c.select("user_id", "batch_id", *measures, *[F.col(f"n_{w}").cast("long").alias(f"n_{w}") for w in measures]), "cases")
    per_case = c.select("user_id", F.explode(F.array(*[F.struct(F.lit(w).alias("what"), F.col(f"n_{w}").alias("idx"), F.col(w).alias("v")) for w in measures])).alias("_x")).select(
        "user_id", "_x.*").filter("v is not null")
    lift = c.groupBy("user_id", F.col("batch_id").alias("o")).agg((F.avg("full_top10") - F.avg("ridge_top10")).alias("v"))
    placed = running_totals(lift, ["user_id"], [F.asc("o")], {}).select("user_id", F.lit("top10_lift").alias("what"), F.col("before").cast("long").alias("idx"), "v")
    m = cut(_intervals(per_case.unionByName(cut(placed)), iters))
    state = c.groupBy("user_id").agg(F.count("*").alias("completed")).join(m.filter("what = 'top10_lift'").select("user_id", F.col("low").alias("_low")), "user_id", "left")
    decision = F.when(F.col("completed") >= 100, F.when(F.col("_low") > 0, "keep-full").otherwise("simplify-to-ridge")).otherwise("collecting")
    state = state.withColumn("decision", decision).withColumn("status", F.when(F.col("completed").between(30, 99), "preliminary").otherwise(F.col("decision")))
    return m.join(state.drop("_low"), "user_id")
