"""One preference posterior per user, fitted for all users in the same jobs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import dims
from ..functions import kernels as N
from ..functions import scalar as S
from ..session import bounded_batches, cut, running_totals, with_small
from . import blocks as B

VEC = T.ArrayType(T.DoubleType())
CAPACITIES = ((0, 1.0), *[(w, g) for w in (128, 256) for g in (0.25, 0.5, 1.0, 2.0)])
RIDGE_ALPHAS = (0.1, 1.0, 10.0, 100.0)
CHUNK = 4096
#: Distinct vote floors whose moments (21 KB each) are sent to every task; more are joined by a shuffle.
FLOORS = 1024
#: The same of lifted moments (below 1 MB each), and users who get a floor's drawn rows together.
LIFTED_FLOORS, USERS_A_DRAW = 32, 64

MODEL = T.StructType([
    T.StructField("mean", VEC), T.StructField("cov", VEC), T.StructField("alpha", T.DoubleType()), T.StructField("beta", T.DoubleType()),
    T.StructField("n_obs", T.DoubleType()), T.StructField("n_real", T.LongType()), T.StructField("y_mean", T.DoubleType()),
    T.StructField("log_evidence", T.DoubleType()), T.StructField("n_rff", T.IntegerType()), T.StructField("gamma", T.DoubleType()),
])


def sample_negatives(space: DataFrame, count: int = dims.NEGATIVE_SAMPLES, seed: int = 0) -> DataFrame:
    """Items standing in for "not for me": one hash-ordered draw shared by all users."""
    return space.select("item_id").orderBy(S.hash_order(seed, F.col("item_id")), "item_id").limit(count)


def user_negatives(negatives: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows a user takes back out of the shared draw: what they have labelled themselves."""
    return labels.join(negatives.select("item_id"), "item_id", "left_semi").select("user_id", "item_id")


def vote_floors(labels: DataFrame, titles: DataFrame, count: int = dims.NEGATIVE_SAMPLES) -> DataFrame:
    """Per user: the 25th percentile of rated votes, relaxed until the pool is several
    times the draw; NULL floor means draw from everything."""
    votes = titles.select("item_id", F.coalesce("imdb_votes", F.lit(0)).alias("votes"))
    n = votes.agg(F.count("*").alias("n")).head()["n"]
    count, depth = min(count, n), min(n - 1, max(min(count, n) * 5, 1))
    # The depth-th largest vote count from a histogram, not from a sort of the catalogue.
    bins = votes.groupBy("votes").agg(F.count("*").alias("c"))
    affordable = bins.agg(F.round(F.expr(f"percentile(votes, {1 - depth / max(n - 1, 1)}, c)"), 6).alias("v")).head()["v"] if n > 1 else 0
    rated = labels.join(votes, "item_id").filter("votes > 0").groupBy("user_id").agg(F.expr("percentile(votes, 0.25)").alias("wanted"))
    floor = F.least("wanted", F.lit(float(affordable)))
    return rated.select("user_id", floor.alias("floor")).withColumn("count", F.lit(count))


def sample_popular_negatives(floors: DataFrame, titles: DataFrame, count: int = dims.NEGATIVE_SAMPLES, seed: int = 0) -> DataFrame:
    """(floor, item_id): the shared draw above each distinct floor, or over everything where
    fewer than twice the draw lie above it. Each block keeps its own first ``count``."""
    asked = floors.select(F.col("floor").alias("qid")).filter("qid is not null").distinct()
    items = titles.select("item_id", F.coalesce("imdb_votes", F.lit(0)).cast("double").alias("votes"),
                          S.hash_order(seed, F.col("item_id")).alias("h"))
    schema = T.StructType([T.StructField("qid", T.DoubleType()), T.StructField("above", T.BooleanType()), items.schema["item_id"],
                           T.StructField("h", T.StringType())])

    def run(q, rp, _drop):
        rp = rp.sort_values(["h", "item_id"], ignore_index=True)
        out = []
        for f in q["qid"]:
            for above, pool in ((True, rp[rp["votes"] >= f]), (False, rp)):
                head = pool.head(count)
                out.append(pd.DataFrame({"qid": f, "above": above, "item_id": head["item_id"], "h": head["h"]}))
        return pd.concat(out)

    hits = cut(B.per_block(asked, items, None, run, schema))
    w = Window.partitionBy("qid", "above").orderBy("h", "item_id")
    drawn = hits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= count).drop("_r")
    sizes = asked.join(_pool_sizes(asked, titles), "qid")
    use = sizes.select("qid", (F.col("size") >= 2 * count).alias("above"))
    return drawn.join(use, ["qid", "above"]).select(F.col("qid").alias("floor"), "item_id")


def _pool_sizes(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """Titles at or above each floor, from the vote histogram."""
    bins = titles.groupBy(F.coalesce("imdb_votes", F.lit(0)).cast("double").alias("v")).agg(F.count("*").alias("c"))
    marks = asked.select(F.col("qid").alias("v"), F.lit(0).cast("long").alias("c"), F.col("qid")).unionByName(
        bins.withColumn("qid", F.lit(None).cast("double")))
    total = bins.agg(F.sum("c").alias("t")).scalar()
    below = running_totals(marks, [], [F.asc("v"), F.asc_nulls_last("qid")], {"below": F.col("c").cast("double")})
    return below.filter("qid is not null").select("qid", (total - F.col("below")).alias("size"))


# --- fitting ------------------------------------------------------------------------


def _label_rows(labels: DataFrame, features: DataFrame, negatives: DataFrame | None) -> DataFrame:
    """Weighted rows per user; a labelled item of the shared draw is taken back out."""
    more = [c for c in labels.columns if c == "n_real"]
    own = labels.select("user_id", *more, "item_id", F.col("weight").alias("w"), F.col("reward").alias("y"), F.lit(1.0).alias("cnt"))
    if negatives is not None:
        back = labels.join(negatives.select("item_id"), "item_id", "left_semi").select(
            "user_id", *more, "item_id", F.lit(-dims.NEGATIVE_WEIGHT).alias("w"), F.lit(dims.NEGATIVE_REWARD).alias("y"), F.lit(-1.0).alias("cnt"))
        own = own.unionByName(back)
    return own.join(features.select("item_id", "vec"), "item_id")


def _negative_rows(negatives: DataFrame, features: DataFrame) -> DataFrame:
    return negatives.join(features.select("item_id", "vec"), "item_id").select(
        F.lit(dims.NEGATIVE_WEIGHT).alias("w"), F.lit(dims.NEGATIVE_REWARD).alias("y"), F.lit(1.0).alias("cnt"), "vec",
        *[c for c in negatives.columns if c != "item_id"])


def _lifted(rows: DataFrame, capacity: tuple, seed: int) -> DataFrame:
    width, gamma = capacity
    if not width:
        return rows
    schema = rows.schema

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(vec=list(N.lift(B._stack(pdf["vec"]), width, gamma, seed)))

    return rows.mapInPandas(run, schema)


def evidence_counts(labels: DataFrame) -> DataFrame:
    """Labels per user, and how many are stated verdicts."""
    weak = F.col("weak") if "weak" in labels.columns else F.lit(False)
    return labels.groupBy("user_id").agg(F.count("*").alias("n_real"), F.count_if(~weak).alias("verdicts"))


def fit_taste(labels: DataFrame, features: DataFrame, negatives: DataFrame | None = None, penalty: float | None = dims.PENALTY,
              allow_rff: bool = True, rff_gate: int = dims.RFF_MIN_LABELS, min_verdicts: int = 3, seed: int = 0) -> DataFrame:
    """One posterior row per user from labels(user_id, item_id, reward, weight[, weak]).

    Everything the fit needs are moments of [1, x, y]: a user's own, plus those of the
    negatives all users share (computed once), minus the negatives the user has labelled.
    Users with enough labels also try random-feature lifts; the evidence picks.
    """
    counts = evidence_counts(labels).filter(F.col("verdicts") >= min_verdicts)
    labels = labels.drop("n_real")
    eligible = labels.join(counts.select("user_id"), "user_id", "left_semi")
    lively = counts.filter(F.col("n_real") >= rff_gate)
    if not (allow_rff and lively.limit(1).count()):
        return _fit_capacity(eligible, counts, features, negatives, CAPACITIES[0], penalty, seed)
    out = _fit_capacity(eligible, counts.filter(F.col("n_real") < rff_gate), features, negatives, CAPACITIES[0], penalty, seed)
    out = out.unionByName(_best_capacity(eligible, lively.filter(F.col("n_real") <= CHUNK), features, negatives, penalty, seed))
    most = lively.filter(F.col("n_real") > CHUNK)
    if most.limit(1).count():
        some = cut(eligible.join(most.select("user_id"), "user_id", "left_semi"))
        out = out.unionByName(_most_evidence([_fit_capacity(some, most, features, negatives, c, penalty, seed) for c in CAPACITIES]))
    return out


def _best_capacity(labels, counts, features, negatives, penalty, seed) -> DataFrame:
    """The fit of most evidence for users of at most a chunk of labels: their rows meet once, as they are,
    and are lifted, fitted and compared where they meet, so neither lifted rows nor matrices are shuffled."""
    counted = labels.join(counts.select("user_id", "n_real"), "user_id")
    rows = _label_rows(counted, features, negatives).select("user_id", "n_real", "w", "y", "cnt", "vec")
    shared = [(0.0, 0.0)] * len(CAPACITIES)
    if negatives is not None:
        found = [B.one_moment(_lifted(_negative_rows(negatives, features), c, seed)) for c in CAPACITIES]
        shared = [(block if len(block) else 0.0, extra) for block, extra in found]
    schema = T.StructType([rows.schema["user_id"], *MODEL.fields])

    return _per_user(rows, lambda user, part: _of_most_evidence(user, part, shared, penalty, seed), schema)


def _of_most_evidence(user, part: pd.DataFrame, shared: list, penalty, seed: int) -> tuple:
    """A user's fit from all their rows and, for each capacity, the moments and number of the shared ones."""
    x, y, w = B._stack(part["vec"]), part["y"].to_numpy(float), part["w"].to_numpy(float)
    own, n_real, kept = float(part["cnt"].sum()), int(part["n_real"].iloc[0]), None
    for (width, gamma), (block, extra) in zip(CAPACITIES, shared):
        a = N.augmented(N.lift(x, width, gamma, seed), y)
        if width and a.shape[1] - 1 > max(8 * n_real, 64):
            continue
        mean, cov, alpha, beta, evidence, y_mean = N.posterior((a * w[:, None]).T @ a + block, own + extra, penalty)
        # Equal evidence keeps the plainer map, which comes first.
        if kept is None or evidence > kept[8]:
            kept = (user, mean, cov.ravel(), alpha, beta, own + extra, n_real, y_mean, evidence, width, gamma)
    return kept


def _most_evidence(tried: list[DataFrame]) -> DataFrame:
    """Of several fits of the same users, each user's of most evidence."""
    rest = [c for c in tried[0].columns if c != "user_id"]
    # Equal evidence keeps the plainer map: lower width, then the smaller gamma.
    rank = F.struct("log_evidence", (-F.col("n_rff")).alias("_w"), (-F.col("gamma")).alias("_g"))
    return reduce(DataFrame.unionByName, tried).groupBy("user_id").agg(F.max_by(F.struct(*rest), rank).alias("_m")).select("user_id", "_m.*")


def _per_user(rows: DataFrame, fn, schema: T.StructType) -> DataFrame:
    """``fn(user, rows)`` -> tuple, where a user's rows meet; many users a batch. For users of bounded numbers of rows."""
    bounded_batches(rows.sparkSession)

    def solved(batches):
        current, wait = None, []
        for pdf in batches:
            for user, part in pdf.groupby("user_id", sort=False):
                if wait and user != current:
                    yield fn(current, pd.concat(wait))
                    wait = []
                current = user
                wait.append(part)
        if wait:
            yield fn(current, pd.concat(wait))

    return B.gathered(rows, "user_id").sortWithinPartitions("user_id").mapInPandas(lambda batches: B.in_batches(solved(batches), schema.names), schema)


def _fit_capacity(labels, counts, features, negatives, capacity, penalty, seed) -> DataFrame:
    width, gamma = capacity
    # The count travels as a key, so that no user's matrix is shuffled again to meet it.
    counted = labels.join(counts.select("user_id", "n_real"), "user_id")
    own = B.moments(_lifted(_label_rows(counted, features, negatives), capacity, seed).select("user_id", "n_real", "w", "y", "cnt", "vec"), ["user_id", "n_real"])
    shared, extra = (np.zeros(1), 0.0)
    if negatives is not None:
        block, extra = B.one_moment(_lifted(_negative_rows(negatives, features), capacity, seed))
        shared = N.pack(block) if len(block) else np.zeros(1)
    return _solve(own, shared, extra, penalty, width, gamma)


def _solve(own: DataFrame, shared: np.ndarray, extra: float, penalty, width: int, gamma: float) -> DataFrame:
    bounded_batches(own.sparkSession)
    schema = T.StructType([own.schema["user_id"], *MODEL.fields])

    def solved(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                flat = np.asarray(r.packed) + (np.asarray(r.shared) if hasattr(r, "shared") else shared)
                n = r.n + (r.shared_n if hasattr(r, "shared_n") else extra)
                m = N.unpack(flat, int((np.sqrt(8 * len(flat) + 1) - 1) / 2))
                f = len(m) - 1
                if width and f > max(8 * r.n_real, 64):
                    continue
                mean, cov, a, b, ev, y_mean = N.posterior(m, n, penalty)
                yield r.user_id, mean, cov.ravel(), a, b, float(n), int(r.n_real), y_mean, ev, width, gamma

    return own.mapInPandas(lambda batches: B.in_batches(solved(batches), schema.names), schema)


def fit_taste_popular(labels: DataFrame, features: DataFrame, titles: DataFrame, count: int = dims.NEGATIVE_SAMPLES,
                      penalty: float | None = dims.PENALTY, seed: int = 0, allow_rff: bool = True, rff_gate: int = dims.RFF_MIN_LABELS) -> DataFrame:
    """As ``fit_taste``, lifts included, with negatives drawn where each user's own verdicts live: the shared
    moments are per distinct vote floor. Users who rated no title with votes draw from everything."""
    counts = evidence_counts(labels).filter(F.col("verdicts") >= 3)
    pool = titles.join(features.select("item_id"), "item_id", "left_semi")
    floors = vote_floors(labels, pool, count).select("user_id", "floor")
    # All titles lie above the floor of those who have none.
    counts = cut(counts.select("user_id", "n_real").join(floors, "user_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))
    drawn = cut(sample_popular_negatives(counts, pool, count, seed))
    lively = counts.filter(F.col("n_real") >= rff_gate)
    if not (allow_rff and lively.limit(1).count()):
        return _fit_popular_capacity(labels, counts, features, drawn, CAPACITIES[0], penalty, seed)
    out = _fit_popular_capacity(labels, counts.filter(F.col("n_real") < rff_gate), features, drawn, CAPACITIES[0], penalty, seed)
    out = out.unionByName(_best_popular_capacity(labels, lively.filter(F.col("n_real") <= CHUNK), features, drawn, penalty, seed))
    most = lively.filter(F.col("n_real") > CHUNK)
    if most.limit(1).count():
        some, of_some = cut(labels.join(most.select("user_id"), "user_id", "left_semi")), cut(drawn.join(most.select("floor"), "floor", "left_semi"))
        out = out.unionByName(_most_evidence([_fit_popular_capacity(some, most, features, of_some, c, penalty, seed) for c in CAPACITIES]))
    return out


def _popular_rows(labels: DataFrame, counts: DataFrame, features: DataFrame, drawn: DataFrame) -> DataFrame:
    """As ``_label_rows``, for users whose counts and floors travel as keys."""
    keys = [c for c in counts.columns if c != "user_id"]
    known = labels.select("user_id", "item_id", "weight", "reward").join(counts, "user_id")
    back = known.join(drawn, ["floor", "item_id"], "left_semi").select(
        "user_id", *keys, "item_id", F.lit(-dims.NEGATIVE_WEIGHT).alias("w"), F.lit(dims.NEGATIVE_REWARD).alias("y"), F.lit(-1.0).alias("cnt"))
    rows = known.select("user_id", *keys, "item_id", F.col("weight").alias("w"), F.col("reward").alias("y"), F.lit(1.0).alias("cnt")).unionByName(back)
    return rows.join(features.select("item_id", "vec"), "item_id").select("user_id", *keys, "w", "y", "cnt", "vec")


def _fit_popular_capacity(labels, counts, features, drawn, capacity, penalty, seed) -> DataFrame:
    width, gamma = capacity
    shared = B.moments(_lifted(_negative_rows(drawn, features).select("floor", "w", "y", "cnt", "vec"), capacity, seed), ["floor"], few=True).select(
        "floor", F.col("packed").alias("shared"), F.col("n").alias("shared_n"))
    # Count and floor travel as keys, and few floors' matrices go to the users', so that no user's matrix is shuffled again.
    own = B.moments(_lifted(_popular_rows(labels, counts, features, drawn), capacity, seed), ["user_id", "n_real", "floor"])
    full = own.join(with_small(cut(shared), LIFTED_FLOORS if width else FLOORS), "floor").drop("floor")
    return _solve(full, np.zeros(1), 0.0, penalty, width, gamma)


def _best_popular_capacity(labels, counts, features, drawn, penalty, seed) -> DataFrame:
    """As ``_best_capacity``: a floor's drawn rows go to its users, some users together, and their moments are made there."""
    crowds = cut(counts.groupBy("floor").agg(F.ceil(F.count("*") / USERS_A_DRAW).cast("int").alias("_n")))
    crowd = F.pmod(F.xxhash64("user_id"), F.col("_n")).cast("int").alias("_crowd")
    rows = _popular_rows(labels, counts.join(crowds, "floor").select("user_id", "n_real", "floor", crowd), features, drawn)
    asked = crowds.select("floor", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_crowd"))
    shared = asked.join(_negative_rows(drawn, features), "floor").withColumns({
        "user_id": F.lit(0).cast(rows.schema["user_id"].dataType), "n_real": F.lit(0).cast("long")})
    order = ["floor", "_crowd", "_own", "user_id"]
    both = rows.withColumn("_own", F.lit(True)).unionByName(shared.withColumn("_own", F.lit(False)))
    schema = T.StructType([rows.schema["user_id"], *MODEL.fields])
    bounded_batches(rows.sparkSession)

    def runs(batches):
        current, wait = None, []
        for pdf in batches:
            for key, part in pdf.groupby(order, sort=False, dropna=False):
                if wait and key != current:
                    yield current, pd.concat(wait)
                    wait = []
                current = key
                wait.append(part)
        if wait:
            yield current, pd.concat(wait)

    def solved(batches):
        of, found = None, None
        for (floor, some, own, user), part in runs(batches):
            if not own:
                of, x, y, w = (floor, some), B._stack(part["vec"]), part["y"].to_numpy(float), part["w"].to_numpy(float)
                lifted = [N.augmented(N.lift(x, *c, seed), y) for c in CAPACITIES]
                found = [((a * w[:, None]).T @ a, float(part["cnt"].sum())) for a in lifted]
            elif of == (floor, some):
                yield _of_most_evidence(user, part, found, penalty, seed)

    return B.gathered(both, "floor", "_crowd").sortWithinPartitions(*order).mapInPandas(lambda batches: B.in_batches(solved(batches), schema.names), schema)


# --- using a model ------------------------------------------------------------------


def packed(models: DataFrame) -> DataFrame:
    """Models whose covariances are upper triangles, about half the bytes, to be stored or shuffled; every user of a
    model takes both forms."""
    f = F.size("mean")
    triangle = F.flatten(F.transform(F.sequence(F.lit(0), f - 1), lambda i: F.slice("cov", i * (f + 1) + 1, f - i)))
    return models.withColumn("cov", F.when(F.size("cov") == f * f, triangle).otherwise(F.col("cov")))


def with_model(rows: DataFrame, models: DataFrame, fn, schema: T.StructType, pairs: DataFrame | None = None) -> DataFrame:
    """``fn(model row, rows)`` over each user's rows in chunks of bounded size; a busy
    user's rows spread over as many chunks as they need. Rows and models are shuffled once. ``pairs`` has at
    least the users of ``rows``, where these are cheaper to count without their vectors."""
    pairs = rows if pairs is None else pairs
    bounded_batches(rows.sparkSession)
    # Only users above one chunk need to be told their number of chunks; there is at most one in CHUNK rows.
    busy = cut(pairs.groupBy("user_id").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_n")).filter("_n > 1"))
    busy = with_small(busy)
    known = F.col("user_id").isNotNull()
    n = F.coalesce("_n", F.lit(1))
    left = rows.filter(known).join(busy, "user_id", "left").withColumn("_c", F.pmod(F.xxhash64("item_id"), n).cast("int")).drop("_n")
    right = models.filter(known).join(busy, "user_id", "left").withColumn("_c", F.explode(F.sequence(F.lit(0), n - 1))).drop("_n")

    models_columns = models.columns
    of_model = [f"_m_{c}" for c in models_columns]
    right = right.select("user_id", "_c", *[F.col(c).alias(m) for c, m in zip(models_columns, of_model)], F.lit(True).alias("_model"))
    # A user's model comes before the user's rows; both are read in a stream, many users a batch.
    both = B.spread(left.toDF(*left.columns).withColumn("_model", F.lit(False)).unionByName(right.toDF(*right.columns), allowMissingColumns=True), "user_id", "_c")
    given, sent = [*rows.columns, "_c"], to_arrow_schema(schema)

    def run(batches):
        known = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            new = table.filter(table["_model"]).select(["_c", *of_model]).rename_columns(["_c", *models_columns]).to_pandas()
            for _, model in new.iterrows():
                known.setdefault((model["user_id"], model["_c"]), model)
            mine = table.filter(pc.invert(table["_model"])).select(given).to_pandas()
            user, chunk = mine["user_id"].to_numpy(), mine["_c"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (user[1:] != user[:-1]) | (chunk[1:] != chunk[:-1])]) if len(mine) else []
            rows_of = mine.drop(columns="_c")
            found = [fn(known[key], rows_of.iloc[first:last]) for first, last in zip(starts, [*starts[1:], len(mine)]) if (key := (user[first], chunk[first])) in known]
            if found:
                yield pa.RecordBatch.from_pandas(pd.concat(found, ignore_index=True), sent, preserve_index=False)
            # The last user's rows may go on in the next batch.
            last = (table["user_id"][-1].as_py(), table["_c"][-1].as_py())
            known = {last: known[last]} if last in known else {}

    return both.sortWithinPartitions("user_id", "_c", F.desc("_model")).mapInArrow(lambda batches: run(b for b in batches if b.num_rows), schema)


def _phi(model, x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = N.lift(x, int(model["n_rff"]), float(model["gamma"]), seed)
    return np.hstack([np.ones((len(x), 1)), x])


def predict_pairs(pairs: DataFrame, features: DataFrame, models: DataFrame) -> DataFrame:
    """Mean and predictive sd for (user_id, item_id, …) rows."""
    rows = pairs.join(features.select("item_id", "vec"), "item_id")
    schema = T.StructType([*pairs.schema.fields, T.StructField("mean", T.DoubleType()), T.StructField("sd", T.DoubleType())])

    def run(model, pdf):
        phi = _phi(model, B._stack(pdf["vec"]))
        cov = N.symmetric(model["cov"], phi.shape[1])
        mean = phi @ np.asarray(model["mean"]) + model["y_mean"]
        sd = np.sqrt(np.maximum(N.quadratic(phi, cov) + 1.0 / model["beta"], 1e-12))
        return pdf.assign(mean=mean, sd=sd)[schema.names]

    return with_model(rows, packed(models).select("user_id", "mean", "cov", "beta", "y_mean", "n_rff", "gamma"), run, schema, pairs)


def sample_weights(models: DataFrame, slate: Column, temperature: float = 1.0) -> DataFrame:
    """One posterior draw per user, its generator seeded by (user, slate)."""
    bounded_batches(models.sparkSession)
    seeded = models.withColumn("_seed", F.pmod(F.xxhash64("user_id", slate), F.lit(2**31 - 1)))
    schema = T.StructType([models.schema["user_id"], T.StructField("w", VEC), T.StructField("b", T.DoubleType()),
                           T.StructField("n_rff", T.IntegerType()), T.StructField("gamma", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                f = len(r.mean)
                root = np.linalg.cholesky(N.symmetric(r.cov, f) + 1e-8 * np.eye(f))
                # ``_seed`` is the last column.
                z = np.random.default_rng(int(r[-1])).standard_normal(f)
                rows.append((r.user_id, np.asarray(r.mean) + temperature * (root @ z), r.y_mean, r.n_rff, r.gamma))
            yield pd.DataFrame(rows, columns=schema.names)

    return seeded.mapInPandas(run, schema)


def mean_weights(models: DataFrame) -> DataFrame:
    return models.select("user_id", F.col("mean").alias("w"), F.col("y_mean").alias("b"), "n_rff", "gamma")


def top_scored(weights: DataFrame, features: DataFrame, k: int, skip: DataFrame | None = None) -> DataFrame:
    """Best items per user under linear-in-features weights (user_id, w, b, n_rff, gamma)."""
    asked = weights.withColumnRenamed("user_id", "qid")
    schema = T.StructType([T.StructField("qid", weights.schema["user_id"].dataType), features.schema["item_id"], T.StructField("score", T.DoubleType())])

    def run(q, found, drop):
        best = B.BestRows(q["qid"].to_numpy(), k, drop)
        groups = [(users, users["_at"].to_numpy(), B._stack(users["w"]), users["b"].to_numpy(float)[:, None])
                  for _, users in q.assign(_at=np.arange(len(q))).groupby(["n_rff", "gamma"])]
        for rp in found:
            ids, x = rp["item_id"].to_numpy(), B._stack(rp["vec"])
            for users, at, w, b in groups:
                phi = _phi(users.iloc[0], x).T
                for part in B.in_slices(len(w), len(ids)):
                    best.add(at[part], w[part] @ phi + b[part], ids)
        yield best.frame(schema.names)

    gone = skip.withColumnRenamed("user_id", "qid") if skip is not None else None
    hits = B.per_block(asked, features.select("item_id", "vec"), gone, run, schema, streamed=True)
    return B.best_per_query(hits, k).withColumnRenamed("qid", "user_id")


def thompson_scores(models: DataFrame, features: DataFrame, k: int, slate: Column, temperature: float = 1.0, skip: DataFrame | None = None) -> DataFrame:
    return top_scored(cut(sample_weights(models, slate, temperature)), features, k, skip)


def ucb_scores(pairs: DataFrame, features: DataFrame, models: DataFrame, kappa: float = 1.0) -> DataFrame:
    return predict_pairs(pairs, features, models).withColumn("score", F.col("mean") + kappa * F.col("sd"))


@F.pandas_udf(T.DoubleType())
def _normal_tail(z: pd.Series) -> pd.Series:
    from math import erfc, sqrt

    return z.map(lambda v: None if v is None or v != v else 0.5 * erfc(v / sqrt(2.0))).astype("float64")


def like_probability(mean: Column, sd: Column) -> Column:
    """P(reward at least 0.75) under a normal prediction."""
    return _normal_tail((F.lit(dims.LIKE_AT) - mean) / F.greatest(sd, F.lit(1e-6)))


def taste_direction(models: DataFrame, width: int) -> DataFrame:
    """The linear part of the mean, one row per (user, axis)."""
    return models.select("user_id", F.posexplode(F.slice("mean", 2, width)).alias("axis", "weight"))


def surface_preferences(models: DataFrame, n_latent: int) -> DataFrame:
    """Weights of the five named side features; none when the widths disagree."""
    side = F.slice(F.col("mean"), n_latent + 2, 10_000)
    linear = models.filter((F.col("n_rff") == 0) & (F.size(side) == len(dims.SIDE_FEATURES)))
    names = F.array(*[F.lit(n) for n in dims.SIDE_FEATURES])
    return linear.select("user_id", F.explode(F.arrays_zip(names.alias("name"), side.alias("weight"))).alias("_z")).select(
        "user_id", F.col("_z.name").alias("name"), F.col("_z.weight").alias("weight"))


# --- ridge baseline -----------------------------------------------------------------


def ridge_baseline(labels: DataFrame, features: DataFrame, negatives: DataFrame, alphas: tuple = RIDGE_ALPHAS) -> DataFrame:
    """Weighted ridge per user on the same rows, alpha by leave-one-out error.

    The moments give every row's leverage, so the errors of a user's rows are sums over
    chunks; the shared negatives enter once per user and labelled ones are taken back.
    """
    plain = labels.drop("n_real").withColumn("weight", F.lit(1.0))
    counts = evidence_counts(labels).filter("verdicts >= 3")
    block, _ = B.one_moment(_negative_rows(negatives, features))
    neg = _negative_rows(negatives, features).select("vec").toPandas()  # at most the draw's size
    nx = B._stack(neg["vec"])
    ny, nw = np.full(len(nx), dims.NEGATIVE_REWARD), np.full(len(nx), dims.NEGATIVE_WEIGHT)
    usual = plain.join(counts.filter(F.col("n_real") <= CHUNK).select("user_id"), "user_id", "left_semi")
    rows = _label_rows(usual, features, negatives).select("user_id", "w", "y", "cnt", "vec")
    out = T.StructType([rows.schema["user_id"], T.StructField("w", VEC), T.StructField("b", T.DoubleType()), T.StructField("alpha", T.DoubleType())])

    def best(user, part):
        # All of a user's rows stand here: their moments, their errors and the shared negatives' meet in one pass.
        x, y, w = B._stack(part["vec"]), part["y"].to_numpy(float), part["w"].to_numpy(float)
        a = N.augmented(x, y)
        m = (a * w[:, None]).T @ a + (block if len(block) else 0.0)
        if len(nx):
            x, y, w = np.vstack([x, nx]), np.r_[y, ny], np.r_[w, nw]
        sign = np.r_[np.sign(part["cnt"].to_numpy(float)), np.ones(len(nx))]
        alpha = alphas[int(N.loo_errors(m, x, y, np.abs(w), alphas, sign).argmin())]
        return (user, *N.ridge_from_moments(m, alpha), alpha)

    found = _per_user(rows, best, out)
    most = counts.filter(F.col("n_real") > CHUNK).select("user_id")
    if most.limit(1).count():
        found = found.unionByName(_ridge_in_chunks(plain.join(most, "user_id", "left_semi"), features, negatives, alphas, N.pack(block) if len(block) else 0.0, nx, ny, nw, out))
    return found


def _ridge_in_chunks(plain: DataFrame, features: DataFrame, negatives: DataFrame, alphas: tuple, shared, nx, ny, nw, out: T.StructType) -> DataFrame:
    """The ridge of users above a chunk of labels: moments first, then the errors of their rows in chunks."""
    rows = _label_rows(plain, features, negatives)
    own = cut(B.moments(rows.select("user_id", "w", "y", "cnt", "vec"), ["user_id"]))
    schema = T.StructType([own.schema["user_id"], T.StructField("errors", VEC)])

    def full(flat):
        flat = np.asarray(flat) + shared
        return N.unpack(flat, int((np.sqrt(8 * len(flat) + 1) - 1) / 2))

    def chunk_errors(model, pdf):
        x, y, w = B._stack(pdf["vec"]), pdf["y"].to_numpy(float), np.abs(pdf["w"].to_numpy(float))
        total = N.loo_errors(full(model["packed"]), x, y, w, alphas, np.sign(pdf["cnt"].to_numpy(float)))
        return pd.DataFrame([(model["user_id"], total)], columns=schema.names)

    def negative_errors(batches):
        for pdf in batches:
            yield pd.DataFrame([(r.user_id, N.loo_errors(full(r.packed), nx, ny, nw, alphas) if len(nx) else np.zeros(len(alphas))) for r in pdf.itertuples(index=False)], columns=schema.names)

    parts = with_model(rows, own, chunk_errors, schema).unionByName(own.mapInPandas(negative_errors, schema))
    errors = parts.groupBy("user_id").agg(F.array(*[F.sum(F.col("errors")[i]) for i in range(len(alphas))]).alias("errors"))
    best = errors.select("user_id", (F.array_position("errors", F.array_min("errors")) - 1).cast("int").alias("pick"))

    def solve(batches):
        for pdf in batches:
            rows_ = []
            for r in pdf.itertuples(index=False):
                coef, b = N.ridge_from_moments(full(r.packed), alphas[r.pick])
                rows_.append((r.user_id, coef, b, alphas[r.pick]))
            yield pd.DataFrame(rows_, columns=out.names)

    return own.join(best, "user_id").mapInPandas(solve, out)


def ridge_scores(pairs: DataFrame, features: DataFrame, ridge: DataFrame) -> DataFrame:
    """Ridge prediction per pair, a JVM dot product."""
    from ..functions import vectors as V

    return pairs.join(features.select("item_id", "vec"), "item_id").join(ridge.select("user_id", "w", "b"), "user_id").withColumn(
        "ridge_score", V.dot(F.col("vec"), F.col("w")) + F.col("b")).drop("vec", "w", "b")
