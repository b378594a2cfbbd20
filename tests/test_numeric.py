"""Distributed numerics against direct NumPy computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinograph.functions import kernels as N
from kinograph.operators import blocks as B
from kinograph.operators import coldstart as Q
from kinograph.operators import evaluation as P
from kinograph.operators import itemspace as I
from kinograph.operators import slates as L
from kinograph.operators import taste as K
from kinograph.operators import timeline as Z
from kinograph.session import global_index, running_totals

RNG = np.random.default_rng(7)
D = 6


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def world(spark):
    n = 120
    latent, side = unit(RNG.normal(size=(n, D))), RNG.normal(size=(n, 2)) * 0.15
    vec = np.hstack([latent, side])
    votes = RNG.integers(1, 5000, n)
    langs = RNG.choice(["en", "ta", "ko"], n)
    quality = RNG.uniform(0.1, 0.9, n)
    feats = spark.createDataFrame(pd.DataFrame({"item_id": range(n), "latent": latent.tolist(), "vec": vec.tolist()})).cache()
    titles = spark.createDataFrame(pd.DataFrame({"item_id": range(n), "imdb_votes": votes, "language": langs, "quality": quality, "kind": "movie",
                                                 "year": 2000, "runtime": 100})).cache()
    rows = []
    for u, count in ((1, 40), (2, 5), (3, 2), (4, 12)):
        for i in RNG.choice(n, count, replace=False):
            rows.append((u, int(i), float(np.clip(0.5 + latent[i, 0] + 0.1 * RNG.normal(), 0, 1)), float(RNG.uniform(0.3, 1.0)), bool(RNG.random() < 0.2)))
    labels = pd.DataFrame(rows, columns=["user_id", "item_id", "reward", "weight", "weak"])
    return dict(n=n, latent=latent, vec=vec, votes=votes, langs=langs, quality=quality, feats=feats, titles=titles, labels=labels,
                sl=spark.createDataFrame(labels).cache())


def direct_fit(x, y, w, penalty=10.0):
    """Row-wise fit: weighted design with its intercept, then the evidence fixed point."""
    w = w / w.mean()
    r = np.sqrt(w)
    ym = np.average(y, weights=w)
    phi = np.hstack([np.ones((len(x), 1)), x]) * r[:, None]
    t = (y - ym) * r
    a, b = 1.0, 4.0
    for _ in range(500):
        s = np.linalg.inv(a * np.eye(phi.shape[1]) + b * phi.T @ phi)
        m = b * s @ phi.T @ t
        g = phi.shape[1] - a * np.trace(s)
        nb = np.clip(max(len(y) - g, 1e-6) / max(((t - phi @ m) ** 2).sum(), 1e-12), 1e-4, 1e6)
        na = np.clip(penalty * nb if penalty is not None else g / max(m @ m, 1e-9), 1e-4, 1e9)
        if abs(na - a) < 1e-9 and abs(nb - b) < 1e-9:
            break
        a, b = na, nb
    s = np.linalg.inv(a * np.eye(phi.shape[1]) + b * phi.T @ phi)
    return b * s @ phi.T @ t, s, b, ym


def rows_for(world, user, negatives=None):
    lab = world["labels"].query("user_id == @user")
    x, y, w = world["vec"][lab.item_id], lab.reward.to_numpy(), lab.weight.to_numpy()
    if negatives is not None:
        neg = [i for i in negatives if i not in set(lab.item_id)]
        x, y, w = np.vstack([x, world["vec"][neg]]), np.append(y, np.full(len(neg), 0.15)), np.append(w, np.full(len(neg), 0.3))
    return x, y, w


def test_shared_moments_equal_rowwise_fit(spark, world):
    draw = K.sample_negatives(world["feats"], 50)
    neg = [r.item_id for r in draw.collect()]
    got = {r.user_id: r for r in K.fit_taste(world["sl"], world["feats"], draw).collect()}
    assert set(got) == {u for u in (1, 2, 3, 4) if (~world["labels"].query("user_id == @u").weak).sum() >= 3}
    for u, r in got.items():
        x, y, w = rows_for(world, u, neg)
        m, s, b, ym = direct_fit(x, y, w)
        assert r.n_obs == len(y) and abs(r.y_mean - ym) < 1e-9
        assert np.allclose(r.mean, m, atol=1e-6) and np.allclose(np.reshape(r.cov, s.shape), s, atol=1e-6) and abs(r.beta / b - 1) < 1e-5


def test_learned_prior_equals_rowwise_fit(world):
    x, y, w = rows_for(world, 1)
    aug = N.augmented(x, y)
    mean, cov, a, b, _ev, _ym = N.posterior((aug * w[:, None]).T @ aug, len(y), None)
    m, s, b2, _ = direct_fit(x, y, w, None)
    assert np.allclose(mean, m, atol=1e-4) and abs(b / b2 - 1) < 1e-3


def test_capacity_takes_the_best_evidence(world):
    one = world["sl"].filter("user_id = 1")
    got = K.fit_taste(one, world["feats"], None, rff_gate=10).head()
    x, y, w = rows_for(world, 1)
    best = None
    for width, gamma in K.CAPACITIES:
        lifted = N.lift(x, width, gamma)
        if width and lifted.shape[1] + 1 > max(8 * len(y), 64):
            continue
        aug = N.augmented(lifted, y)
        ev = N.posterior((aug * w[:, None]).T @ aug, len(y))[4]
        if best is None or ev > best[0] + 1e-12:
            best = (ev, width, gamma)
    assert (got.n_rff, got.gamma) == best[1:] and abs(got.log_evidence - best[0]) < 1e-6


def test_predictions(world):
    models = K.fit_taste(world["sl"], world["feats"], None).cache()
    pairs = models.select("user_id").distinct().withColumn("item_id", F.explode(F.sequence(F.lit(0), F.lit(world["n"] - 1)).cast("array<bigint>")))
    got = K.predict_pairs(pairs, world["feats"], models).toPandas()
    for r in models.collect():
        phi = np.hstack([np.ones((world["n"], 1)), world["vec"]])
        g = got[got.user_id == r.user_id].sort_values("item_id")
        assert np.allclose(g["mean"], phi @ np.array(r.mean) + r.y_mean)
        assert np.allclose(g["sd"], np.sqrt(N.quadratic(phi, np.reshape(r.cov, (phi.shape[1],) * 2)) + 1 / r.beta))


def test_ridge_leave_one_out(spark, world):
    draw = K.sample_negatives(world["feats"], 30)
    neg = [r.item_id for r in draw.collect()]
    got = {r.user_id: r for r in K.ridge_baseline(world["sl"], world["feats"], draw).collect()}
    for u in got:
        lab = world["labels"].query("user_id == @u").assign(weight=1.0)
        x, y, w = rows_for({**world, "labels": lab}, u, neg)

        def solve(x, y, w, a):
            xm, ym = np.average(x, axis=0, weights=w), np.average(y, weights=w)
            xc = x - xm
            c = np.linalg.solve((xc * w[:, None]).T @ xc + a * np.eye(x.shape[1]), (xc * w[:, None]).T @ (y - ym))
            return c, ym - xm @ c

        errs = []
        for a in K.RIDGE_ALPHAS:
            e = 0.0
            for i in range(len(y)):
                keep = np.arange(len(y)) != i
                c, b = solve(x[keep], y[keep], w[keep], a)
                e += w[i] * (y[i] - x[i] @ c - b) ** 2
            errs.append(e)
        a = K.RIDGE_ALPHAS[int(np.argmin(errs))]
        c, b = solve(x, y, w, a)
        assert got[u].alpha == a and np.allclose(got[u].w, c, atol=1e-8) and abs(got[u].b - b) < 1e-8


def test_popular_negatives(spark, world):
    count = 10
    floors = K.vote_floors(world["sl"], world["titles"], count).toPandas()
    order = [r.item_id for r in K.sample_negatives(world["titles"], world["n"]).collect()]
    votes, depth = world["votes"], min(world["n"] - 1, count * 5)
    got = K.sample_popular_negatives(spark.createDataFrame(floors), world["titles"], count).toPandas()
    for r in floors.itertuples():
        rated = votes[world["labels"].query("user_id == @r.user_id").item_id]
        want = min(np.quantile(rated, 0.25), np.sort(votes)[::-1][depth])
        assert abs(r.floor - want) < 1e-6
        pool = [i for i in order if votes[i] >= r.floor]
        pool = pool if len(pool) >= 2 * count else order
        assert sorted(got[got.floor == r.floor].item_id) == sorted(pool[:count])


def test_moments_of_a_dominant_key(spark):
    x = RNG.normal(size=(3000, 3))
    frame = pd.DataFrame({"k": np.where(np.arange(3000) % 10 < 7, 0, np.arange(3000) % 97), "w": RNG.uniform(size=3000), "y": x[:, 0], "cnt": 1.0, "vec": x.tolist()})
    got = B.moments(spark.createDataFrame(frame).repartition(5), ["k"]).collect()
    assert len(got) == frame.k.nunique()
    for r in got:
        m = (frame.k == r.k).to_numpy()
        aug = N.augmented(x[m], x[m, 0])
        assert r.n == m.sum() and np.allclose(N.unpack(r.packed, 5), (aug * frame.w[m].to_numpy()[:, None]).T @ aug)


def test_top_items_with_many_blocks(spark, world, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(B, "BLOCK_ITEMS", 30)
    w = RNG.normal(size=(5, D + 2))
    q = spark.createDataFrame(pd.DataFrame({"qid": range(5), "w": w.tolist()}))
    skip = spark.createDataFrame([(0, 3), (0, 4), (2, 7)], "qid long, item_id long")
    got = B.top_items(q, world["feats"].select("item_id", "vec"), 7, skip).toPandas()
    for i in range(5):
        s = world["vec"] @ w[i]
        s[[j for a, j in ((0, 3), (0, 4), (2, 7)) if a == i]] = -np.inf
        assert list(got[got.qid == i].sort_values("rank").item_id) == list(np.argsort(-s, kind="stable")[:7])


def test_volume_greedy_is_greedy_determinant(world):
    v, q = world["latent"][:25], world["quality"][:25]
    kernel = np.outer(q, q) * (v @ v.T)
    np.fill_diagonal(kernel, q**2)
    picks = []
    for _ in range(5):
        best = max((i for i in range(25) if i not in picks), key=lambda i: np.linalg.det(kernel[np.ix_(picks + [i], picks + [i])]))
        picks.append(best)
    assert N.volume_greedy(v, q, 5) == picks


def test_lazy_greedy_is_the_plain_greedy():
    for either in (False, True):
        value, unit_ = RNG.normal(size=60), unit(RNG.normal(size=(60, 4)))
        value[10:20] = value[10]
        unit_[10:20] = unit_[10]
        picks = []
        for _ in range(12):
            alike = unit_ @ unit_[picks].T if picks else np.zeros((60, 1))
            net = value - 0.7 * np.maximum(0.0, (np.abs(alike) if either else alike).max(axis=1))
            net[picks] = -np.inf
            picks.append(int(np.argmax(np.round(net, 12))))
        assert N.diverse_greedy(value, unit_, 12, 0.7, either) == picks


def test_regression_is_stationary():
    x = np.hstack([np.ones((80, 1)), RNG.normal(size=(80, 3))])
    y = x @ np.array([0.1, 1.0, -0.5, 0.0]) + 0.3 * RNG.normal(size=80)
    mean, cov, a, b, evidence = N.bayes_ridge(x.T @ x, x.T @ y, y @ y, 80.0, None)
    assert np.allclose(cov, np.linalg.inv(a * np.eye(4) + b * x.T @ x)) and np.allclose(mean, b * cov @ x.T @ y)
    s = np.eye(80) / b + x @ x.T / a
    assert np.isclose(evidence, -0.5 * (np.linalg.slogdet(2 * np.pi * s)[1] + y @ np.linalg.solve(s, y)))
    known = 4 - a * np.trace(cov)
    assert np.isclose(a, known / (mean @ mean), rtol=1e-4) and np.isclose(b, (80 - known) / ((y - x @ mean) ** 2).sum(), rtol=1e-4)


def test_poisson_counts_have_mean_and_spread_one():
    c = P.poisson_counts(np.arange(2000), np.arange(500)).astype(float)
    assert abs(c.mean() - 1) < 0.01 and abs(c.var() - 1) < 0.02 and abs(np.corrcoef(c[:, 0], c[:, 1])[0, 1]) < 0.1


def test_variance_reduction_is_the_explicit_update(world):
    model = K.fit_taste(world["sl"].filter("user_id = 1"), world["feats"], None, allow_rff=False)
    r = model.head()
    none = world["sl"].filter("1 = 0").select("user_id", "item_id")
    got = Q.variance_reduction(model, world["feats"], none, world["feats"]).toPandas().sort_values("item_id")
    phi = np.hstack([np.ones((world["n"], 1)), world["vec"]])
    s = np.reshape(r.cov, (phi.shape[1],) * 2)
    for i in (0, 17, 63):
        new = np.linalg.inv(np.linalg.inv(s) + r.beta * np.outer(phi[i], phi[i]))
        assert np.isclose(got.gain.iloc[i], N.quadratic(phi, s).mean() - N.quadratic(phi, new).mean())


def test_next_questions_never_repeat(world):
    models = K.fit_taste(world["sl"], world["feats"], None, allow_rff=False).cache()
    asked = world["sl"].select("user_id", "item_id")
    for criterion in ("v-optimal", "d-optimal"):
        got = Q.next_questions(models, world["feats"], asked, world["feats"], 6, criterion)
        assert got.join(asked, ["user_id", "item_id"]).count() == 0
        assert got.groupBy("user_id").count().filter("count <> 6").count() == 0


def brute_slate(world, r, gone, k, strategy, novelty=0.0, mood=None, weight=0.6):
    keep = np.array([i for i in range(world["n"]) if i not in gone])
    phi = np.hstack([np.ones((len(keep), 1)), world["vec"][keep]])
    mean = phi @ np.array(r.mean) + r.y_mean
    score, latent = mean.copy(), world["latent"][keep]
    if mood is not None:
        a = latent @ mood
        score = score + weight * score.std() * (a - a.mean()) / (a.std() + 1e-9)
    if novelty:
        e = np.log1p(world["votes"][keep])
        score = score - novelty * score.std() * (e - e.mean()) / (e.std() + 1e-9)
    top = np.union1d(N.best_indices(score, max(20, 20 * k)), N.best_indices(mean, max(4 * k, 64)))
    sd = np.sqrt(N.quadratic(phi[top], np.reshape(r.cov, (phi.shape[1],) * 2)) + 1 / r.beta)
    if strategy == "ucb":
        score[top] = score[top] + sd
    order = top[np.argsort(-score[top], kind="stable")]
    sims, picks, live = np.zeros(len(order)), [], score[order].copy()
    for _ in range(min(3 * k, len(order))):
        i = int(np.argmax(0.72 * live - 0.28 * sims))
        picks.append(order[i])
        live[i] = -np.inf
        sims = np.maximum(sims, latent[order] @ latent[order[i]])
    cap, used, out, over = max(1, round(k * 0.5)), {}, [], []
    for p in picks:
        lang = world["langs"][keep[p]]
        (over if used.get(lang, 0) >= cap else out).append(p)
        used[lang] = used.get(lang, 0) + 1
    final = (out + over)[:k]
    e = np.exp((score[order] - score[order].max()) / max(score[order].std(), 1e-3))
    prob = dict(zip(order, e / e.sum()))
    best = set(N.best_indices(mean, k))
    return [int(keep[p]) for p in final], [prob[p] for p in final], [p not in best for p in final]


@pytest.mark.parametrize("strategy,novelty,moody,block", [("mean", 0.0, False, 20_000), ("ucb", 0.0, False, 20_000), ("mean", 0.5, True, 20_000), ("ucb", 0.3, True, 20_000),
                                                           ("mean", 0.0, False, 50), ("ucb", 0.3, True, 50)])
def test_slates(spark, world, monkeypatch, strategy, novelty, moody, block):
    monkeypatch.setattr(B, "BLOCK_ITEMS", block)  # lists finished where they are scored, and merged from shards
    models = K.fit_taste(world["sl"], world["feats"], None, allow_rff=False).cache()
    mood = unit(RNG.normal(size=(1, D)))[0]
    moods = models.select("user_id", F.array(*[F.lit(float(x)) for x in mood]).alias("mood")) if moody else None
    gone = world["sl"].select("user_id", "item_id")
    got = L.recommend(models, world["feats"], world["titles"], gone, k=5, strategy=strategy, size=20, novelty=novelty, moods=moods).toPandas()
    for r in models.collect():
        ids, prob, explored = brute_slate(world, r, set(world["labels"].query("user_id == @r.user_id").item_id), 5, strategy, novelty, mood if moody else None)
        g = got[got.user_id == r.user_id].sort_values("position")
        assert list(g.item_id) == ids and np.allclose(g.propensity, prob, atol=1e-9) and list(g.explored) == explored


def test_thompson_draws_follow_the_posterior(spark, world):
    model = K.fit_taste(world["sl"].filter("user_id = 1"), world["feats"], None, allow_rff=False).cache()
    r = model.head()
    many = model.drop("user_id").withColumn("user_id", F.explode(F.sequence(F.lit(1), F.lit(4000)).cast("array<bigint>")))
    many = many.select("user_id", *[c for c in model.columns if c != "user_id"])
    w = np.array([x.w for x in K.sample_weights(many, F.lit("s")).collect()])
    assert np.allclose(w.mean(0), r.mean, atol=0.02)
    assert np.allclose(np.cov(w.T), np.reshape(r.cov, (len(r.mean),) * 2), atol=0.03)
    again = K.sample_weights(model, F.lit("s")).head().w
    assert again == K.sample_weights(model, F.lit("s")).head().w != K.sample_weights(model, F.lit("t")).head().w


def test_prequential_refits_each_step(spark, world, monkeypatch):
    monkeypatch.setattr(P, "SEGMENT", 7)
    monkeypatch.setattr(P.timeline, "FAN", 2)  # six segments: three levels of sums
    lab = world["labels"].query("user_id in (1, 4)").copy()
    lab["step"] = lab.groupby("user_id").cumcount().astype("int64")
    lab["earlier_mean"] = lab.groupby("user_id").reward.transform(lambda s: s.shift().expanding().mean())
    got = P.prequential(spark.createDataFrame(lab[["user_id", "item_id", "step", "reward", "earlier_mean"]]), world["feats"]).toPandas()
    assert len(got) == sum(len(g) - 5 for _, g in lab.groupby("user_id"))
    for u, g in lab.groupby("user_id"):
        x, y = world["vec"][g.item_id], g.reward.to_numpy()
        mine = got[got.user_id == u].set_index("step")
        for i in range(5, len(y), 6):
            m, s, b, ym = direct_fit(x[:i], y[:i], np.ones(i))
            phi = np.append(1.0, x[i])
            assert abs(mine.predicted[i] - (phi @ m + ym)) < 1e-6 and abs(mine.sd[i] - np.sqrt(phi @ s @ phi + 1 / b)) < 1e-6
            assert abs(mine.control_error[i] - abs(y[:i].mean() - y[i])) < 1e-9


def test_imputation_matches_explicit_folds(spark):
    n, dx, dy = 200, 5, 3
    x = RNG.normal(size=(n, dx))
    y = x @ RNG.normal(size=(dx, dy)) + 0.3 * RNG.normal(size=(n, dy))
    pairs = spark.createDataFrame(pd.DataFrame({"item_id": range(n), "content": x.tolist(), "factor": y.tolist()}))
    fold = np.array([r.f for r in pairs.select("item_id", F.pmod(F.xxhash64(F.lit(0), F.col("item_id")), F.lit(5)).alias("f")).orderBy("item_id").collect()])
    scores = []
    for f in range(5):
        tr, te = fold != f, fold == f
        xm, ym, row = x[tr].mean(0), y[tr].mean(0), []
        for a in I.ALPHAS:
            c = np.linalg.solve((x[tr] - xm).T @ (x[tr] - xm) + a * np.eye(dx), (x[tr] - xm).T @ (y[tr] - ym))
            row.append(1 - ((y[te] - ym - (x[te] - xm) @ c) ** 2).sum() / ((y[te] - ym) ** 2).sum())
        scores.append(row)
    want = np.mean(scores, axis=0)
    coef, intercept, alpha, r2 = I.fit_imputation(pairs)
    assert alpha == I.ALPHAS[int(np.argmax(want))] and abs(r2 - want.max()) < 1e-9
    xm, ym = x.mean(0), y.mean(0)
    c = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(dx), (x - xm).T @ (y - ym))
    assert np.allclose(coef, c) and np.allclose(intercept, ym - xm @ c)


def test_projection_places_imputed_items_where_fusion_did(spark):
    n = 150
    x = unit(RNG.normal(size=(n, 8)))
    f = x @ RNG.normal(size=(8, 6)) + 0.2 * RNG.normal(size=(n, 6))
    content = spark.createDataFrame(pd.DataFrame({"item_id": range(n), "vec": x.tolist()})).cache()
    space, art = I.fuse_space(content, content.filter("item_id < 90").drop("vec").join(
        spark.createDataFrame(pd.DataFrame({"item_id": range(n), "vec": f.tolist()})), "item_id"), dim=6, rank=4)
    got = {r.item_id: np.array(r.vec) for r in space.collect()}
    new = {r.item_id: np.array(r.vec) for r in I.project(content.filter("item_id >= 90"), art).collect()}
    assert len(got) == n and all(np.allclose(got[i], v) for i, v in new.items())
    assert abs(art.coverage - 0.6) < 1e-9


def test_planted_groups_survive_factorisation(spark):
    """Two taste groups: items of a group end up nearer to each other than across."""
    rows = [(u, i, float(RNG.choice([4, 4.5, 5]) if (u % 2) == (i % 2) else RNG.choice([0.5, 1, 2]))) for u in range(40) for i in RNG.choice(60, 40, replace=False)]
    r = spark.createDataFrame([(int(u), int(i), x) for u, i, x in rows], "user_id long, movie_id long, rating double")
    held = I.choose_holdout(r, 5)
    train = I.exclude_holdout(r, held)
    assert train.join(held, "user_id").count() == 0
    f = I.als_factors(I.interaction_matrix(train, "liked"), rank=4, iterations=5).toPandas()
    v = unit(np.stack(f.vec))
    same = (f.movie_id.to_numpy()[:, None] % 2) == (f.movie_id.to_numpy()[None, :] % 2)
    assert (v @ v.T)[same].mean() > (v @ v.T)[~same].mean() + 0.2
    with pytest.raises(ValueError):
        I.require_holdout(held.filter("1 = 0"))


def test_order_helpers(spark):
    v = RNG.integers(0, 5, 300)
    g = np.where(np.arange(300) < 200, 0, np.arange(300) % 3)
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "g": g, "v": v.astype(float)}))
    got = global_index(df, [F.desc("v"), F.asc("id")]).toPandas().sort_values("position")
    assert list(got.id) == sorted(range(300), key=lambda i: (-v[i], i)) and list(got.position) == list(range(300))
    rt = running_totals(df, ["g"], [F.asc("id")], {"s": F.col("v")}).toPandas().sort_values("id")
    pdf = pd.DataFrame({"g": g, "v": v})
    assert list(rt.before) == list(pdf.groupby("g").cumcount()) and np.allclose(rt.s, pdf.groupby("g").v.cumsum() - v)
    q = P.exact_quantile(df, ["g"], "v", 0.99, "id").toPandas().set_index("g")["quantile"]
    assert all(abs(q[k] - np.quantile(v[g == k], 0.99)) < 1e-9 for k in set(g))
    rk = P.average_rank(df, ["g"], "v", "id").toPandas().sort_values("id")
    assert list(rk.v_rank) == list(pdf.groupby("g").v.rank(method="average"))


def test_student_tail():
    # Table values: t at 5% two-sided.
    for t, df in ((12.7062, 1), (2.2281, 10), (2.0423, 30), (1.9840, 100)):
        assert abs(P._two_sided(t, df) - 0.05) < 2e-5
    assert abs(P._two_sided(0.0, 5) - 1.0) < 1e-9


def test_like_probability(spark):
    row = spark.range(1).select(K.like_probability(F.lit(0.75), F.lit(0.1)).alias("a"), K.like_probability(F.lit(0.85), F.lit(0.1)).alias("b")).head()
    assert abs(row.a - 0.5) < 1e-12 and abs(row.b - 0.8413447) < 1e-6


# --- models as of a moment ---

DAY0 = pd.Timestamp("2020-01-01")


def frame(spark, rows, schema):
    plain = lambda v: v.to_pydatetime() if isinstance(v, pd.Timestamp) else None if isinstance(v, float) and v != v else v
    return spark.createDataFrame([tuple(plain(v) for v in r) for r in rows], schema)


LOG = "event_id long, user_id long, item_id long, kind string, value double, ts timestamp_ntz"


def log_of(rng, n_items, n, users):
    rows = []
    for k in range(n):
        kind = rng.choice(["rate", "rate", "rate", "skip", "dismiss", "seen"])
        rows.append((k, int(rng.choice(users)), int(rng.integers(0, n_items)), str(kind), float(rng.integers(0, 11)) if kind == "rate" and rng.random() < 0.9 else None,
                     DAY0 + pd.Timedelta(hours=int(rng.integers(0, 24 * 400)))))
    return pd.DataFrame(rows, columns=["event_id", "user_id", "item_id", "kind", "value", "ts"])


def labels_at(log, user, ts, half_life):
    """What is known strictly before ``ts``, written out row by row."""
    past = log[(log.user_id == user) & (log.ts < ts)].sort_values(["ts", "event_id"])
    out = {}
    for r in past[past.kind.isin(["skip", "dismiss"])].itertuples():
        if not ((past.kind == "rate") & (past.item_id == r.item_id)).any():
            out[r.item_id] = (0.25, 0.5, r.ts, True)
    for r in past[(past.kind == "rate") & past.value.notna()].itertuples():
        out[r.item_id] = (r.value / 10.0, 1.0, r.ts, False)
    days = {i: (ts.normalize() - v[2].normalize()).days for i, v in out.items()}
    return {i: (v[0], max(v[1] * (0.5 ** (days[i] / half_life) if half_life else 1.0), 1e-3), v[3]) for i, v in out.items()}


@pytest.mark.parametrize("half_life,with_negatives", [(1100.0, False), (20.0, False), (0.0, True), (300.0, True)])
def test_models_as_of_equal_refits(spark, world, monkeypatch, half_life, with_negatives):
    monkeypatch.setattr(Z, "SEGMENT", 5)
    monkeypatch.setattr(Z, "FAN", 3)
    rng = np.random.default_rng(11)
    log = log_of(rng, 30, 260, [1, 2, 3])
    log.loc[len(log)] = (9999, 7, 3, "rate", 5.0, DAY0)
    events = frame(spark, log.itertuples(index=False), LOG)
    negatives = spark.createDataFrame([(i,) for i in (0, 3, 50, 51, 52)], "item_id long") if with_negatives else None
    changes = Z.label_changes(Z.label_lives(events, world["feats"]), negatives, half_life)
    asks = [(k, int(rng.choice([1, 2, 3, 7])), int(rng.integers(0, 100)), DAY0 + pd.Timedelta(hours=int(rng.integers(0, 24 * 420)))) for k in range(80)]
    asks += [(100 + k, int(r.user_id), int(r.item_id), r.ts) for k, r in enumerate(log.head(20).itertuples())]  # at the very moment of a verdict
    asked = frame(spark, asks, "ask_id long, user_id long, item_id long, ts timestamp_ntz")
    got = {r.ask_id: r for r in Z.predict_as_of(changes, asked, world["feats"], negatives, half_life=half_life).collect()}
    seen = 0
    for ask, user, item, ts in asks:
        known = labels_at(log, user, ts, half_life)
        said = sum(not v[2] for v in known.values())
        if said < 3:
            assert ask not in got
            continue
        rows = [(world["vec"][i], y, w) for i, (y, w, _) in known.items()]
        if with_negatives:
            rows += [(world["vec"][i], 0.15, 0.3) for i in (0, 3, 50, 51, 52) if i not in known]
        x, y, w = (np.array(c) for c in zip(*rows))
        m, s, b, ym = direct_fit(x, y, w)
        phi = np.append(1.0, world["vec"][item])
        assert abs(got[ask].mean - (phi @ m + ym)) < 1e-6 and abs(got[ask].sd - np.sqrt(phi @ s @ phi + 1 / b)) < 1e-5
        assert got[ask].verdicts == said
        seen += 1
    assert seen == len(got) > 50


def test_serving_validation_and_picks_before_their_impression(spark, world):
    rng = np.random.default_rng(5)
    log = log_of(rng, 100, 300, [1, 2])
    extra = pd.DataFrame([(2000 + k, 3, k, "rate", 7.0, DAY0 + pd.Timedelta(days=390)) for k in range(2)]  # two verdicts: never a model
                         + [(2100 + k, u, k, "rate", float(k), DAY0 + pd.Timedelta(days=200)) for u in (4, 5) for k in range(6)], columns=log.columns)
    log = pd.concat([log, extra], ignore_index=True)
    events = frame(spark, log.itertuples(index=False), LOG)
    changes = Z.label_changes(Z.label_lives(events, world["feats"]))
    from kinograph.operators import events as E

    seq = E.first_verdict_sequence(events, world["feats"])
    got = P.prequential(seq, world["feats"], serving=changes).toPandas()
    steps = seq.toPandas()
    assert set(got.user_id) == {1, 2} and got.step.min() >= 5  # users 4 and 5 said all at one moment
    for r in got.itertuples():
        step = steps[(steps.user_id == r.user_id) & (steps.step == r.step)].iloc[0]
        known = labels_at(log, r.user_id, step.ts, 1100.0)
        x, y, w = (np.array(c) for c in zip(*((world["vec"][i], v, k) for i, (v, k, _) in known.items())))
        m, *_, ym = direct_fit(x, y, w)
        assert abs(r.predicted - (np.append(1.0, world["vec"][step.item_id]) @ m + ym)) < 1e-6
    picks = []
    for u, n, day in ((1, 12, 300), (2, 12, 300), (3, 12, 300), (4, 12, 300), (5, 4, 300), (6, 2, 300)):
        picks += [(u, 1000 * u + k, f"{u}-{k // 3}", int(rng.integers(0, 100)), float(rng.uniform(0.1, 0.9)), float(rng.uniform()), DAY0 + pd.Timedelta(days=day, hours=k)) for k in range(n)]
    picks += [(5, 5100 + k, f"5-{k}", k, 0.5, 0.5, DAY0 + pd.Timedelta(days=100)) for k in range(8)]  # before user 5's verdicts
    usable = spark.createDataFrame([(p[0], p[1], p[2], p[3], p[4], p[5], "old" if p[0] == 2 and p[1] == 2003 else "now") for p in picks],
                                   "user_id long, impression_id long, slate_id string, item_id long, propensity double, reward double, space_id string")
    shown = frame(spark, [(p[1], p[6]) for p in picks], "impression_id long, ts timestamp_ntz")
    out = {r.user_id: r for r in P.off_policy_status(usable, None, world["feats"], 6, True, (changes, shown), space_id="now").collect()}
    assert {u: r.status for u, r in out.items()} == {1: "ok", 2: "item-space-changed", 3: "no-model", 4: "ok", 5: "estimate-unavailable", 6: "not-enough-data"}
    for u in (1, 4):
        rows = []
        for p in (p for p in picks if p[0] == u):
            known = labels_at(log, u, p[6], 1100.0)
            x, y, w = (np.array(c) for c in zip(*((world["vec"][i], v, k) for i, (v, k, _) in known.items())))
            m, *_, ym = direct_fit(x, y, w)
            rows.append((p[2], p[4], p[5], np.append(1.0, world["vec"][p[3]]) @ m + ym))
        df = pd.DataFrame(rows, columns=["slate", "p", "reward", "score"])
        e = np.exp(df.score - df.groupby("slate").score.transform("max"))
        w = e / e.groupby(df.slate).transform("sum") / np.maximum(df.p, 1e-6)
        c = np.minimum(w, np.quantile(w, 0.99))
        assert out[u].estimate == pytest.approx((c * df.reward).sum() / c.sum(), abs=1e-6) and out[u].logged_value == pytest.approx(df.reward.mean())


@pytest.mark.parametrize("n,fan", [(1, 2), (5, 2), (64, 4), (130, 4)])
def test_sums_in_levels(spark, n, fan):
    rng = np.random.default_rng(n)
    data = rng.normal(size=(n, 3))
    parts = spark.createDataFrame([(1, k, None if k % 5 == 2 else data[k].tolist()) for k in range(n)] + [(2, 0, [1.0, 1.0, 1.0])], "user_id long, g long, packed array<double>")
    data[2::5] = 0.0
    got = Z.earlier_sums(parts, ["user_id"], fan).filter("user_id = 1").collect()
    for s in range(n):
        total = sum((np.asarray(r.packed) for r in got if r.packed is not None and r.g == s // fan**r.level), np.zeros(3))
        assert np.allclose(total, data[:s].sum(0))


def test_axes_from_one_moment(spark):
    x = RNG.normal(size=(300, 6)) @ RNG.normal(size=(6, 6)) + 2.0
    df = spark.createDataFrame(pd.DataFrame({"item_id": range(300), "vec": x.tolist()})).repartition(5)
    mean, axes, variance = I.principal_axes(df, 4)
    values, vectors = np.linalg.eigh(np.cov(x.T, ddof=0))
    assert np.allclose(mean, x.mean(0)) and np.allclose(variance, values[::-1][:4])
    assert np.allclose(np.abs((axes * vectors[:, ::-1][:, :4]).sum(0)), 1.0)
    low = np.array([r.vec for r in I.reduce_factors(df, 4).orderBy("item_id").collect()])
    assert abs(low.std() - 1.0) < 1e-6 and np.allclose(low @ low.T, ((x - mean) @ axes) @ ((x - mean) @ axes).T / variance.mean())


@pytest.mark.parametrize("tree", [64, 1])
def test_moments_over_batches_and_in_groups(spark, monkeypatch, tree):
    """A run of rows over many batches leaves as one matrix a partition, with and without groups."""
    monkeypatch.setattr(B, "TREE_FROM", tree)
    n = 400
    x, y, w, k = RNG.normal(size=(n, 3)), RNG.normal(size=n), RNG.normal(size=n), RNG.choice([1, 2, 3], n, p=[0.9, 0.09, 0.01])
    df = spark.createDataFrame(pd.DataFrame({"k": k, "w": w, "y": y, "cnt": np.sign(w), "vec": x.tolist()})).repartition(4)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.k: r for r in B.moments(df, ["k"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert set(got) == set(k.tolist())
    for key, r in got.items():
        a = N.augmented(x[k == key], y[k == key])
        assert np.allclose(N.unpack(r.packed, 5), (a * w[k == key][:, None]).T @ a) and abs(r.n - np.sign(w[k == key]).sum()) < 1e-9


def test_rough_greedy_equals_greedy():
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(700, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    unit[350:] = unit[:350]  # every row twice: equal ones go to the earlier
    value = np.tile(rng.uniform(0, 0.3, (5, 350)), 2)
    value[4, :695] = -np.inf
    rough = (value + rng.uniform(-1e-4, 1e-4, value.shape)).astype(np.float32)
    weighed = []

    def exact(i, rows):
        weighed.append(len(rows))
        return value[i][rows]

    got = N.rough_greedy(rough, np.full(5, 1.1e-4), exact, unit, np.ascontiguousarray(unit.T, np.float32), 8, 0.55)
    for i, (picks, gains) in enumerate(got):
        assert picks.tolist() == N.diverse_greedy(value[i], unit, 8, 0.55, either_way=True)
        assert np.array_equal(gains, value[i][picks])
    assert len(got[4][0]) == 5 and max(weighed) < 40  # few rows are weighed exactly
