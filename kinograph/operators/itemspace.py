"""Vectors: co-consumption factors, text embeddings, the fused space and features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions import kernels as N
from ..functions import scalar as S
from ..functions import vectors as V
from ..session import BATCH_BYTES, bounded_batches, landed, one_row
from . import blocks as B

VEC = T.ArrayType(T.DoubleType())


# --- co-consumption -----------------------------------------------------------------


def activity_thresholds(ratings: DataFrame, min_user: int = dims.MIN_USER_RATINGS, min_item: int = dims.MIN_ITEM_RATINGS) -> DataFrame:
    """Ratings of active users and known items, both counted once on the same frame."""
    users = ratings.groupBy("user_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_user).select("user_id")
    items = ratings.groupBy("movie_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_item).select("movie_id")
    return ratings.join(users, "user_id", "left_semi").join(items, "movie_id", "left_semi")


def interaction_matrix(ratings: DataFrame, signal: str = "watched", min_user: int = dims.MIN_USER_RATINGS,
                       min_item: int = dims.MIN_ITEM_RATINGS) -> DataFrame:
    """Long-form confidences; the matrix itself is never built."""
    if signal == "liked":
        ratings = ratings.filter(F.col("rating") >= dims.POSITIVE_THRESHOLD)
    return activity_thresholds(ratings, min_user, min_item).select(
        "user_id", "movie_id", S.confidence(F.col("rating"), signal).alias("confidence"))


def choose_holdout(ratings: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Seeded users to keep out of factorisation; a bounded draw by hash order."""
    return ratings.select("user_id").distinct().orderBy(S.hash_order(seed, F.col("user_id")), "user_id").limit(n)


def exclude_holdout(ratings: DataFrame, holdout: DataFrame) -> DataFrame:
    return ratings.join(holdout.select("user_id"), "user_id", "left_anti")


def require_holdout(recorded: DataFrame) -> DataFrame:
    """The recorded hold-out, or an error: an evaluation without one reads its own answers."""
    if recorded.limit(1).count() == 0:
        raise ValueError("no recorded hold-out; factorise with one before evaluating")
    return recorded.select("user_id")


#: Interactions of a block of users or items: a block is built, sorted and held whole by one task.
ALS_BLOCK, ALS_BLOCKS = 2_000_000, 10


def als_factors(interactions: DataFrame, rank: int = 192, reg: float = 0.05, iterations: int = 20, alpha: float = 12.0, seed: int = 0) -> DataFrame:
    """Item factors of implicit alternating least squares. Blocks grow in number with the interactions, not in size."""
    given = interactions.select(F.col("user_id").cast("int"), F.col("movie_id").cast("int"), F.col("confidence").cast("float"))
    given = landed(given, "interactions")  # counted, then read
    blocks = max(ALS_BLOCKS, -(-given.count() // ALS_BLOCK))
    als = ALS(numUserBlocks=blocks, numItemBlocks=blocks, rank=rank, maxIter=iterations, regParam=reg, alpha=alpha, implicitPrefs=True, seed=seed, userCol="user_id",
              itemCol="movie_id", ratingCol="confidence", coldStartStrategy="nan", checkpointInterval=5)
    model = als.fit(given)
    return model.itemFactors.select(F.col("id").cast("bigint").alias("movie_id"), F.col("features").cast("array<double>").alias("vec"))


def attach_factors(items: DataFrame, factors: DataFrame) -> DataFrame:
    """Factors per catalogue item through its external id; NULL where there are none."""
    f = factors.select(F.col("movie_id").alias("movielens_id"), F.col("vec").alias("factor"))
    return items.select("item_id", "movielens_id").join(f, "movielens_id", "left").select(
        "item_id", "factor", F.col("factor").isNotNull().alias("has_cf"))


def factor_coverage(attached: DataFrame) -> DataFrame:
    return attached.agg(F.count("*").alias("items"), F.count_if("has_cf").alias("with_factors"),
                        F.avg(F.col("has_cf").cast("double")).alias("coverage"))


# --- text ---------------------------------------------------------------------------


def hashed_encoder(width: int = 256):
    """Default encoder: signed hashed words, by a hash any engine has. Any callable texts -> matrix
    can replace it."""
    def encode(texts) -> np.ndarray:
        from hashlib import md5

        out, known = np.zeros((len(texts), width)), {}
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                if word not in known:
                    h = int(md5(word.encode()).hexdigest()[:8], 16)
                    known[word] = ((h >> 1) % width, 1.0 if h & 1 else -1.0)
                place, sign = known[word]
                out[i, place] += sign
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    encode.name, encode.width = "hashed", width
    return encode


def encode_texts(df: DataFrame, encoder, text: str = "card") -> DataFrame:
    """Adds ``vec``. Long texts lead each partition so batches pad evenly. Texts are small beside their
    vectors, so they are dealt to a fixed number of tasks however few files they come from."""
    schema = T.StructType([*df.schema.fields, T.StructField("vec", VEC)])

    def run(batches):
        for pdf in batches:
            # Vectors are wider than their texts: so many rows at a time as their bytes allow.
            step = max(BATCH_BYTES // (8 * getattr(encoder, "width", 1024)), 1)
            for k in range(0, len(pdf), step):
                part = pdf.iloc[k : k + step]
                yield part.assign(vec=list(np.asarray(encoder(part[text].tolist()), dtype=float)))

    return B.spread(df).sortWithinPartitions(F.desc(F.length(text))).mapInPandas(run, schema)


def latest_cached_vector(cache: DataFrame, width: int) -> DataFrame:
    """Newest vector per key; chunks of another width are skipped."""
    return cache.filter(F.size("vec") == width).groupBy("key").agg(F.max_by("vec", "written_at").alias("vec"))


def missing_cards(cards: DataFrame, cache: DataFrame, encoder) -> DataFrame:
    """Distinct (key, card) the cache lacks."""
    keyed = cards.withColumn("key", S.card_key(F.col("card"), encoder.name, encoder.width))
    return keyed.select("key", "card").dropDuplicates(["key"]).join(cache.select("key").distinct(), "key", "left_anti")


def embed_cards(cards: DataFrame, cache: DataFrame, encoder, now: Column) -> tuple[DataFrame, DataFrame]:
    """(vectors per item, rows to append to the cache). Known keys are never encoded again."""
    fresh = encode_texts(missing_cards(cards, cache, encoder), encoder).select("key", "vec", now.alias("written_at"))
    have = latest_cached_vector(cache, encoder.width).select("key", "vec").unionByName(fresh.select("key", "vec"))
    keyed = cards.withColumn("key", S.card_key(F.col("card"), encoder.name, encoder.width))
    return keyed.select("item_id", "key").join(have, "key").select("item_id", "vec"), fresh


def compact_cache(cache: DataFrame, live: DataFrame, width: int) -> DataFrame:
    """Only live keys, newest vector each; worth it when the cache has over twice as many rows."""
    return latest_cached_vector(cache, width).join(live.select("key").distinct(), "key", "left_semi")


def needs_compaction(cache: DataFrame, live: DataFrame) -> DataFrame:
    rows = cache.agg(F.count("*").alias("cached"))
    keys = one_row(live.agg(F.count_distinct("key").alias("live")))
    return rows.withColumn("live", keys["live"]).withColumn("due", F.col("cached") > 2 * F.greatest("live", F.lit(1)))


def embed_query(queries: DataFrame, encoder, art: Fusion | None = None) -> DataFrame:
    """Free-text moods as vectors, in the fused space when ``art`` is given."""
    vecs = encode_texts(queries.withColumn("card", F.concat(F.lit(dims.QUERY_PROMPT), F.col("query"))), encoder).drop("card")
    return project(vecs, art) if art is not None else vecs


# --- fusion -------------------------------------------------------------------------


@dataclass(frozen=True)
class Fusion:
    """Everything needed to place a new vector; a few hundred kilobytes."""

    coef: np.ndarray
    intercept: np.ndarray
    mean: np.ndarray
    components: np.ndarray
    r2: float
    coverage: float
    alpha: float


def _map_vec(df: DataFrame, fn, out: str = "vec", column: str = "vec") -> DataFrame:
    bounded_batches(df.sparkSession)
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, VEC)])

    def run(batches):
        for pdf in batches:
            new = list(fn(B._stack(pdf[column]))) if len(pdf) else []
            yield pdf.assign(**{out: new})[schema.names]

    return df.mapInPandas(run, schema)


def _fixed_signs(components: np.ndarray) -> np.ndarray:
    """Columns flipped so the largest loading is positive; PCA leaves the sign open."""
    top = np.abs(components).argmax(axis=0)
    return components * np.sign(components[top, np.arange(components.shape[1])])


def axes_of(moment: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, d×k axes, their variances, largest first) from the moments of [1, x]."""
    n = moment[0, 0]
    mean = moment[0, 1:] / n
    values, axes = np.linalg.eigh(moment[1:, 1:] / n - np.outer(mean, mean))
    order = np.argsort(-values, kind="stable")[:k]
    return mean, _fixed_signs(axes[:, order]), np.maximum(values[order], 0.0)


def principal_axes(df: DataFrame, k: int, column: str = "vec") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, d×k axes, their variances) of a vector column, from one pass for its moments."""
    rows = df.select(F.lit(1.0).alias("w"), F.lit(0.0).alias("y"), F.lit(1.0).alias("cnt"), F.col(column).alias("vec"))
    return axes_of(B.one_moment(rows)[0][:-1, :-1], k)


def reduce_factors(factors: DataFrame, rank: int = 48) -> DataFrame:
    """Factors on their leading axes, divided by one global sd, which the axes' variances give."""
    mean, axes, spread = principal_axes(factors, rank)
    sd = float(np.sqrt(spread.mean())) + 1e-9
    return _map_vec(factors, lambda x: (x - mean) @ axes / sd)


ALPHAS = (1.0, 3.0, 10.0, 30.0, 100.0, 300.0)


def fit_imputation(pairs: DataFrame, seed: int = 0, alphas: tuple = ALPHAS) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Ridge from content to factors: (coef, intercept, alpha, mean 5-fold R²).

    One pass gives the moments of each fold; training moments are the total minus the
    fold, and test residuals follow from the fold's own moments, so no row is read again.
    """
    return _imputation(pairs, seed, alphas)[:4]


def _imputation(pairs: DataFrame, seed: int, alphas: tuple = ALPHAS) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    fold = F.pmod(F.xxhash64(F.lit(seed), F.col("item_id")), F.lit(5)).cast("int")
    rows = pairs.select(fold.alias("fold"), F.lit(1.0).alias("w"), F.lit(0.0).alias("y"), F.lit(1.0).alias("cnt"),
                        F.concat(F.col("content").cast("array<double>"), F.col("factor").cast("array<double>")).alias("vec"))
    sizes = pairs.select(F.size("content").alias("c"), F.size("factor").alias("f")).head()
    dx, dy = sizes["c"], sizes["f"]
    width = dx + dy + 2
    got = {r["fold"]: N.unpack(r["packed"], width)[:-1, :-1] for r in B.moments(rows, ["fold"], few=True).collect()}
    total = sum(got.values())

    def centred(m, mean):
        # Second moments around ``mean`` of the rows behind ``m``.
        n, s = m[0, 0], m[0, 1:]
        return m[1:, 1:] - np.outer(s, mean) - np.outer(mean, s) + n * np.outer(mean, mean)

    scores = []
    for fold_m in got.values():
        train = total - fold_m
        if train[0, 0] <= 0:
            continue
        mean = train[0, 1:] / train[0, 0]
        c, t = centred(train, mean), centred(fold_m, mean)
        lam, basis = np.linalg.eigh(c[:dx, :dx])
        proj = basis.T @ c[:dx, dx:]
        row = []
        for a in alphas:
            coef = basis @ (proj / (lam + a)[:, None])
            res = np.trace(t[dx:, dx:]) - 2 * np.sum(coef * t[:dx, dx:]) + np.sum((t[:dx, :dx] @ coef) * coef)
            row.append(1.0 - res / max(np.trace(t[dx:, dx:]), 1e-9))
        scores.append(row)
    r2 = np.mean(scores, axis=0)
    best = int(np.argmax(r2))
    mean = total[0, 1:] / total[0, 0]
    c = centred(total, mean)
    coef = np.linalg.solve(c[:dx, :dx] + alphas[best] * np.eye(dx), c[:dx, dx:])
    return coef, mean[dx:] - mean[:dx] @ coef, alphas[best], float(r2[best]), float(total[0, 0])


def _rows_unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)


def fuse_space(content: DataFrame, factors: DataFrame, dim: int = 192, rank: int = 48, seed: int = 0) -> tuple[DataFrame, Fusion]:
    """(item vectors, artefact). ``content`` (item_id, vec), ``factors`` (item_id, vec) where known.

    The joint matrix is read twice: one pass for its moments, which give its mean and axes, and one
    that places the items. Both sides are shuffled: Spark takes an array for one element when it sizes a
    side, so it would broadcast vectors of gigabytes.
    """
    low = reduce_factors(factors, rank).select("item_id", F.col("vec").alias("factor"))
    both = content.select("item_id", F.col("vec").alias("content")).join(low.hint("merge"), "item_id", "left")
    coef, intercept, alpha, r2, known_rows = _imputation(both.filter("factor is not null"), seed)
    sure = max(r2, 0.0)
    schema = T.StructType([content.schema["item_id"], T.StructField("vec", VEC)])

    def joint(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            x = B._stack(pdf["content"])
            guess = x @ coef + intercept
            known = pdf["factor"].notna().to_numpy()
            if known.any():
                guess[known] = B._stack(pdf.loc[known, "factor"])
            conf = np.where(known, 1.0, sure)[:, None]
            yield pd.DataFrame({"item_id": pdf["item_id"], "vec": list(np.hstack([_rows_unit(x), _rows_unit(guess), conf]))})

    wide = both.mapInPandas(joint, schema)
    block, n = B.one_moment(wide.select(F.lit(1.0).alias("w"), F.lit(0.0).alias("y"), F.lit(1.0).alias("cnt"), "vec"))
    mean, axes, _ = axes_of(block[:-1, :-1], dim)
    space = _map_vec(wide, lambda x: _rows_unit((x - mean) @ axes))
    return space, Fusion(coef, intercept, mean, axes, r2, known_rows / max(n, 1.0), alpha)


def project(vectors: DataFrame, art: Fusion) -> DataFrame:
    """Content vectors from outside the catalogue into the fused space."""
    if art.mean is None:
        raise ValueError("this space has no stored mean; fuse again")
    sure = max(art.r2, 0.0)

    def place(x):
        cf = x @ art.coef + art.intercept
        wide = np.hstack([_rows_unit(x), _rows_unit(cf), np.full((len(x), 1), sure)])
        return _rows_unit((wide - art.mean) @ art.components)

    return _map_vec(vectors, place)


def place_new_items(new: DataFrame, space: DataFrame, encoder, art: Fusion) -> DataFrame:
    """New catalogue rows as vectors, each item once and never twice."""
    due = new.dropDuplicates(["item_id"]).join(space.select("item_id"), "item_id", "left_anti")
    cards = due.select("item_id", S.item_card().alias("card"))
    return project(encode_texts(cards, encoder).select("item_id", "vec"), art)


# --- features -----------------------------------------------------------------------


def _raw_side(year_now: int) -> list[Column]:
    def positive(c):
        return F.nullif(F.col(c), F.lit(0))

    return [
        F.col("quality").cast("double"), F.log1p(positive("imdb_votes").cast("double")),
        -(F.lit(year_now) - positive("year")).cast("double"), F.least(positive("runtime"), F.lit(300)).cast("double"),
        F.when(F.col("kind") == "tv", 1.0).otherwise(0.0),
    ]


def side_stats(titles: DataFrame, space: DataFrame, year_now: int = 2026) -> DataFrame:
    """One row: mean and sd of each side feature over the items of the space."""
    raw = space.select("item_id").join(titles, "item_id", "left").select(
        *[c.alias(f"s{i}") for i, c in enumerate(_raw_side(year_now))])
    return raw.agg(*[a for i in range(5) for a in (F.avg(f"s{i}").alias(f"m{i}"), F.stddev_pop(f"s{i}").alias(f"d{i}"))])


def scale_side(stats, year_now: int = 2026) -> Column:
    """Side features on the stored scale; a missing value sits at the mean."""
    raw = _raw_side(year_now)
    out = []
    for i in range(4):
        sd = F.when(stats[f"d{i}"] > 1e-9, stats[f"d{i}"]).otherwise(1.0)
        z = F.try_divide(F.coalesce(raw[i], stats[f"m{i}"]) - stats[f"m{i}"], sd)
        out.append(F.coalesce(S.clamp(z, -4.0, 4.0) * 0.15, F.lit(0.0)))
    return F.array(*out, (raw[4] - stats["m4"]) * 0.15)


def side_features(titles: DataFrame, space: DataFrame, year_now: int = 2026) -> DataFrame:
    stats = one_row(side_stats(titles, space, year_now))
    return space.select("item_id").join(titles, "item_id", "left").select("item_id", scale_side(stats, year_now).alias("side"))


def side_features_for(rows: DataFrame, stats: DataFrame, year_now: int = 2026) -> DataFrame:
    """The same scaling for rows outside the space."""
    return rows.withColumn("side", scale_side(one_row(stats), year_now))


def feature_vectors(titles: DataFrame, space: DataFrame, year_now: int = 2026) -> DataFrame:
    """[latent | side] per item, with the latent part kept beside it."""
    side = side_features(titles, space, year_now)
    return space.select("item_id", F.col("vec").cast("array<double>").alias("latent")).join(side, "item_id").select(
        "item_id", "latent", F.concat("latent", "side").alias("vec"))


def random_fourier_features(features: DataFrame, width: int, gamma: float, seed: int = 0) -> DataFrame:
    return _map_vec(features, lambda x: N.lift(x, width, gamma, seed))


def neighbours(space: DataFrame, queries: DataFrame, k: int = 10, titles: DataFrame | None = None, languages=()) -> DataFrame:
    """The k nearest items of each query item, itself left out; items without metadata never show."""
    # Vectors are shuffled as they are given; tasks compute in doubles.
    items = space.select("item_id", "vec")
    pool = items
    if titles is not None:
        known = titles.filter(F.col("language").isin(*languages)) if languages else titles
        pool = items.join(known.select("item_id"), "item_id", "left_semi")
    asked = items.join(queries.select("item_id").distinct(), "item_id", "left_semi").select(F.col("item_id").alias("qid"), F.col("vec").alias("w"))
    return B.top_items(asked, pool, k, skip=asked.select("qid", F.col("qid").alias("item_id"))).withColumnRenamed("score", "similarity")
