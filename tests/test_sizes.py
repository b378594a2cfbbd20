"""Steps whose cost must follow the rows: where work is dealt, what is shuffled and what Python holds at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinograph.operators import itemspace as I
from kinograph.session import cut, rocksdb_state

DIR = "/root/testdata/sf0.001"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_watch_jobs_brings_its_state_store(spark):
    import __spark_entry__ as entry

    before, plain = spark.conf.get(PROVIDER), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(PROVIDER, plain)
    try:
        assert entry.queries()["watch_jobs"](spark, DIR).count() == entry.queries()["job_standing"](spark, DIR).count() > 0
        assert spark.conf.get(PROVIDER) == plain
        try:
            with rocksdb_state(spark):
                assert spark.conf.get(PROVIDER) != plain
                raise KeyError
        except KeyError:
            assert spark.conf.get(PROVIDER) == plain
    finally:
        spark.conf.set(PROVIDER, before)


def test_texts_are_dealt_before_they_are_encoded(spark):
    one = spark.range(40).select(F.col("id").alias("item_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("card")).coalesce(1)
    got = I.encode_texts(one, I.hashed_encoder(16))
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and got.count() == 40


def test_vectors_are_not_broadcast(spark):
    items = spark.range(60).select(F.col("id").alias("item_id"))
    vec = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.sin(F.col("item_id") * j + j))
    content, factors = cut(items.select("item_id", vec(12).alias("vec"))), cut(items.filter("item_id % 2 = 0").select("item_id", vec(6).alias("vec")))
    space, art = I.fuse_space(content, factors, dim=8, rank=4)
    assert "BroadcastHashJoin" not in plan_of(space) and space.count() == 60 and art.coverage == 0.5


def test_imports_are_graded_by_search_and_year(spark):
    import datetime as dt

    from kinograph.operators import matching as M

    day = lambda y: dt.date(y, 6, 1)
    rows = spark.createDataFrame(
        [(1, "A film", day(2000)), (2, "A film", day(2000)), (3, "A film", day(1980)), (4, "A film", None), (5, "A film", day(2000)), (5, "A film", day(2000)),
         (None, "A film", day(2000)), (7, "", day(2000)), (8, "Other", day(2000))], "row_id long, title string, rated_on date")
    cands = spark.createDataFrame(
        [("A film", 1, 10, "movie", "A film", "A film", 1990, 5.0, 10), ("A film", 2, 11, "movie", "a film!", "x", 2010, 4.0, 9),
         ("A film", 3, 12, "movie", "Nearly a film", "y", 1985, 3.0, 8)],
        "query string, rank int, tmdb_id long, kind string, title string, original_title string, year int, popularity double, votes long")
    got = M.grade_import(rows, cands)
    seen = sorted((r.row_id or 0, r.confidence, r.match.tmdb_id if r.match else None) for r in got.collect())
    # Ids that repeat add their candidates up; a row without an id is met by none.
    assert seen == [(0, "low", None), (1, "high", 10), (2, "high", 10), (3, "ambiguous", 10), (4, "ambiguous", 10), (5, "ambiguous", 10), (5, "ambiguous", 10), (7, "unresolvable", None), (8, "low", None)]
    # Many rows of one search and year are one comparison with its candidates, not one each.
    many = spark.range(5000).select(F.col("id").alias("row_id"), F.lit("A film").alias("title"), F.lit(day(2000)).alias("rated_on"))
    asked = many.select("row_id", F.col("title").alias("query"), F.lit(2000).alias("_bound"))
    assert M._tops(asked.select("query", "_bound").distinct(), cands.withColumnRenamed("title", "c_title").withColumn("_exact", F.lit(True)), ["query", "_bound"]).count() == 1
    assert M.grade_import(many, cands).filter("confidence = 'high' and match.tmdb_id = 10").count() == 5000


def test_gram_index_is_not_broadcast(spark):
    from kinograph.operators import matching as M

    titles = spark.createDataFrame([(1, "Blue anvil", "Blue anvil two", 2000, "movie", "en", 10), (2, "Red gear", "Red gear", 2001, "tv", "en", 5)],
                                   "item_id long, title string, original_title string, year int, kind string, language string, imdb_votes int")
    asked = spark.createDataFrame([(1, "anvil"), (2, "RED"), (3, "none")], "query_id long, query string")
    hits = M.match_contains(M.prepare_queries(asked), M.prepare_titles(titles))
    assert any("SortMergeJoin [gram" in line for line in plan_of(hits).splitlines())
    assert sorted((r.query, r.item_id) for r in hits.collect()) == [("RED", 2), ("anvil", 1)]


def test_wide_rows_leave_python_in_small_batches(spark):
    import numpy as np

    from kinograph.operators import blocks as B

    frames = list(B.in_batches(((i, np.zeros(1 << 17)) for i in range(40)), ["k", "v"]))
    assert [k for f in frames for k in f["k"]] == list(range(40)) and max(len(f) for f in frames) <= 8
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(1 << 28))
    try:
        rows = spark.range(10).select(F.lit(1).alias("k"), F.lit(1.0).alias("w"), F.lit(1.0).alias("y"), F.lit(1.0).alias("cnt"), F.array(F.lit(1.0)).alias("vec"))
        assert B.moments(rows, ["k"]).head()["n"] == 10.0 and int(spark.conf.get(name).removesuffix("b")) <= 8 << 20
    finally:
        spark.conf.set(name, before)


def test_models_are_not_shuffled_to_meet_a_count(spark):
    from kinograph.operators import taste as K

    items = spark.range(30).select(F.col("id").alias("item_id"), F.array(F.sin("id"), F.cos("id")).alias("vec"))
    labels = spark.range(60).select((F.col("id") % 3).alias("user_id"), (F.col("id") % 30).alias("item_id"), (F.col("id") / 60).alias("reward"), F.lit(1.0).alias("weight"))
    models = K.fit_taste(labels, items, None, allow_rff=False)
    # From the top down to the first exchange stand only the solver and the sums it reads.
    top = plan_of(models).split("Exchange")[0]
    assert "MapInPandas" in top and "Join" not in top
    assert {r.user_id: r.n_real for r in models.collect()} == {0: 20, 1: 20, 2: 20}
    pairs = labels.select("user_id", "item_id").unionByName(spark.range(5000).select(F.lit(1).cast("long").alias("user_id"), (F.col("id") % 30).alias("item_id")))
    got = K.predict_pairs(pairs, items, cut(models))
    # A user above one chunk is predicted in several, each with the user's model.
    assert got.count() == 5060 and got.groupBy("user_id", "item_id").agg(F.count_distinct("mean").alias("n")).filter("n > 1").count() == 0


def test_lifted_fits_are_compared_where_they_are_made(spark, monkeypatch):
    import numpy as np

    from kinograph.operators import taste as K

    items = cut(spark.range(60).select(F.col("id").alias("item_id"), F.array(F.sin("id"), F.cos(F.col("id") * 2), F.sin(F.col("id") * 3)).alias("vec")))
    labels = cut(spark.range(110).select((F.col("id") % 2).alias("user_id"), (F.col("id") % 55).alias("item_id"), F.abs(F.sin(F.col("id") * 5)).alias("reward"), F.lit(1.0).alias("weight")).unionByName(
        spark.range(8).select(F.lit(2).cast("long").alias("user_id"), F.col("id").alias("item_id"), (F.col("id") / 8).alias("reward"), F.lit(1.0).alias("weight"))))
    draw = K.sample_negatives(items, 20)
    one = K.fit_taste(labels, items, draw, rff_gate=30)
    assert "max_by" not in plan_of(one)  # no matrix is shuffled to be compared
    got = {r.user_id: r for r in one.collect()}
    monkeypatch.setattr(K, "CHUNK", 40)  # the same users by moments alone
    want = {r.user_id: r for r in K.fit_taste(labels, items, draw, rff_gate=30).collect()}
    assert got.keys() == want.keys() == {0, 1, 2}
    for user, r in got.items():
        w = want[user]
        assert (r.n_rff, r.gamma, r.n_real, r.n_obs) == (w.n_rff, w.gamma, w.n_real, w.n_obs)
        assert np.allclose(r.mean, w.mean, atol=1e-6) and np.allclose(r.cov, w.cov, atol=1e-6) and np.isclose(r.log_evidence, w.log_evidence)


def test_popular_models_are_not_shuffled_to_meet_a_count_or_floor(spark):
    from kinograph.operators import taste as K

    items = cut(spark.range(30).select(F.col("id").alias("item_id"), F.array(F.sin("id"), F.cos("id")).alias("vec"), (F.col("id") * 10).alias("imdb_votes")))
    labels = spark.range(60).select((F.col("id") % 3).alias("user_id"), (F.col("id") % 30).alias("item_id"), (F.col("id") / 60).alias("reward"), F.lit(1.0).alias("weight"))
    models = K.fit_taste_popular(labels, items.select("item_id", "vec"), items.select("item_id", "imdb_votes"), 5)
    # From the sums of each user to the solver, as planned, no matrix is shuffled: only the few floors' matrices are sent.
    top = plan_of(models).split("MapInPandas")[1]
    assert "BroadcastHashJoin" in top and "SortMergeJoin" not in top
    assert {r.user_id: r.n_real for r in models.collect()} == {0: 20, 1: 20, 2: 20}


def test_runs_of_ngrams_take_little_more_than_their_entropy():
    import numpy as np

    from kinograph.llm import backoff

    # A sorted run of one partition as op3 sends it: 8,000 of 1.3 million random numbers.
    gaps = np.random.default_rng(1).exponential(2.0**64 / 1.3e6, 8000).astype("<u8")
    data = backoff._planes(gaps)
    assert len(data) / 8000 < 5.75 and (backoff._whole(data, "<u8") == gaps).all()  # entropy: 5.64 bytes
    for x in (gaps[:0], gaps[:1], gaps * 0, gaps >> 60):
        assert (backoff._whole(backoff._planes(x), "<u8") == x).all()


def test_copies_of_items_do_not_follow_every_few_queries(spark):
    from kinograph.operators import blocks as B

    blocks, shards = B.block_plan(spark, 540_000, 720_000)
    assert blocks <= 34 and shards <= 22
    assert B.block_plan(spark, 90_000, 120_000, B.MODEL_QUERIES, True)[1] == 1
    gone = [__import__("numpy").array(x) for x in ([2, 9, 4], [])]
    ids = __import__("numpy").array([1, 2, 2, 4, 7])
    assert B.keep_mask(ids, gone[0]).tolist() == [True, False, False, False, True] and B.keep_mask(ids, gone[1]).all()


def test_rows_of_many_keys_meet_in_one_shuffle(spark, monkeypatch):
    from kinograph.operators import blocks as B

    monkeypatch.setattr(B, "TREE_FROM", 1)
    rows = spark.range(90).select((F.col("id") % 30).alias("k"), F.lit(1.0).alias("w"), F.lit(1.0).alias("y"), F.lit(1.0).alias("cnt"), F.array(F.sin("id")).alias("vec"))
    many, few = B.moments(rows, ["k"]), B.moments(rows, ["k"], few=True)
    # Groups of partitions would make matrices of a key's few rows.
    assert plan_of(many).count("Exchange") == 1 and plan_of(few).count("Exchange") == 2
    got = lambda df: sorted((r.k, r.n, tuple(round(x, 9) for x in r.packed)) for r in df.collect())
    assert got(many) == got(few)


def test_models_are_stored_as_triangles(spark):
    from kinograph.operators import taste as K

    items = cut(spark.range(30).select(F.col("id").alias("item_id"), F.array(F.sin("id"), F.cos("id")).alias("vec")))
    labels = spark.range(60).select((F.col("id") % 3).alias("user_id"), (F.col("id") % 30).alias("item_id"), (F.col("id") / 60).alias("reward"), F.lit(1.0).alias("weight"))
    models = cut(K.fit_taste(labels, items, None, allow_rff=False))
    small = K.packed(models)
    assert {len(r.cov) for r in models.collect()} == {9} and {len(r.cov) for r in K.packed(small).collect()} == {6}
    got = [sorted((r.user_id, r.item_id, r.mean, r.sd) for r in K.predict_pairs(labels.select("user_id", "item_id"), items, m).collect()) for m in (models, small)]
    assert got[0] == got[1]


def test_ridge_rows_meet_once(spark, monkeypatch):
    import numpy as np

    from kinograph.operators import taste as K

    items = cut(spark.range(40).select(F.col("id").alias("item_id"), F.array(F.sin("id"), F.cos(F.col("id") * 2)).alias("vec")))
    labels = cut(spark.range(60).select((F.col("id") % 3).alias("user_id"), (F.col("id") % 30).alias("item_id"), F.abs(F.sin(F.col("id") * 5)).alias("reward"), F.lit(1.0).alias("weight")))
    draw = K.sample_negatives(items, 15)
    one = K.ridge_baseline(labels, items, draw)
    assert "CoGroup" not in plan_of(one)
    monkeypatch.setattr(K, "CHUNK", 10)  # the same users by moments and chunks
    two = {r.user_id: r for r in K.ridge_baseline(labels, items, draw).collect()}
    got = {r.user_id: r for r in one.collect()}
    assert got.keys() == two.keys() == {0, 1, 2}
    assert all(g.alpha == two[u].alpha and np.allclose(g.w, two[u].w) and np.isclose(g.b, two[u].b) for u, g in got.items())


def test_short_lists_are_picked_from_together(spark):
    import numpy as np

    from kinograph.functions import kernels as N
    from kinograph.operators import slates as L

    rng = np.random.default_rng(3)
    sizes = np.array([1, 30, 30, 7, 80, 3])
    value, unit = rng.normal(size=sizes.sum()), rng.normal(size=(sizes.sum(), 5))
    got, at = N.diverse_lists(value, unit, sizes, 6, 0.4), 0
    for picks, n in zip(got, sizes):
        assert [p - at for p in picks] == N.diverse_greedy(value[at:at + n], unit[at:at + n], 6, 0.4)
        at += n
    listed = spark.range(300).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("user_id"), F.col("id").alias("item_id"), F.sin("id").alias("score"))
    vectors = spark.range(300).select(F.col("id").alias("item_id"), F.array(F.sin(F.col("id") * 3), F.cos(F.col("id") * 3)).alias("latent"))
    out = L.mmr(listed, vectors, 4)
    assert "MapInArrow" in plan_of(out)
    # A list without a user is a list too.
    assert sorted((r.user_id or 0, r["rank"]) for r in out.collect()) == [(u, k) for u in range(7) for k in range(1, 5)]


def test_nearest_sums_are_exact_where_bounds_skip_items(spark):
    import numpy as np

    from kinograph.operators import evaluation as P

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, latent array<double>")
    told = [(u, int(i), float(rng.uniform(-0.2, 1.0))) for u in range(5) for i in rng.choice(400, 4 + 3 * u, replace=False)]
    got = P.arm_weighted_knn(spark.createDataFrame(told, "user_id long, item_id long, reward double"), items, 5, 3).toPandas()
    for u in range(5):
        own = [(i, r) for who, i, r in told if who == u]
        sims, r = x @ x[[i for i, _ in own]].T, np.array([r for _, r in own])
        pick = np.argsort(-sims, axis=1)[:, :3]
        score = (np.maximum(np.take_along_axis(sims, pick, 1), 0) * r[pick]).sum(axis=1)
        score[[i for i, _ in own]] = -np.inf
        assert list(got[got.user_id == u].sort_values("rank").item_id) == list(np.argsort(-score, kind="stable")[:5])


def test_intervals_of_few_values_leave_their_task_alone(spark, monkeypatch):
    import numpy as np

    from kinograph.operators import evaluation as P

    values = cut(spark.range(900).select(F.when(F.col("id") % 6 > 0, F.col("id") % 6).alias("user_id"), F.lit("x").alias("what"), F.floor(F.col("id") / 6).alias("idx"),
                                         F.sin("id").alias("v"), F.lit(150).alias("n")).filter("user_id is not null"))
    few = P.resampled_intervals(values, 300, ["user_id", "what"])
    got = {r.user_id: r.ci for r in few.collect()}
    monkeypatch.setattr(P, "FEW_VALUES", 0)
    many = {r.user_id: r.ci for r in P.resampled_intervals(values, 300, ["user_id", "what"]).collect()}
    assert got.keys() == many.keys() == {1, 2, 3, 4, 5} and all(np.allclose(got[u], many[u]) for u in got)


def test_questions_stop_where_no_title_is_left(spark):
    from kinograph.operators import coldstart as Q
    from kinograph.operators import taste as K

    items = cut(spark.range(20).select(F.col("id").alias("item_id"), F.array(F.sin("id"), F.cos("id")).alias("vec")))
    labels = spark.range(20).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("item_id"), F.abs(F.sin("id")).alias("reward"), F.lit(1.0).alias("weight"))
    models = cut(K.fit_taste(labels, items, None, allow_rff=False))
    asked = labels.filter("item_id < 17").select("user_id", "item_id")
    out = Q.next_questions(models, items.withColumn("latent", F.col("vec")), asked, items, 8)
    assert sorted(r.item_id for r in out.collect()) == [17, 18, 19]


def test_items_are_not_copied_to_blocks(spark, monkeypatch):
    import numpy as np

    from kinograph.operators import blocks as B

    space = cut(spark.range(300).select(F.col("id").alias("item_id"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda j: F.sin(F.col("id") * j + j)).alias("vec")))
    rows = []
    for block in (150, 10):
        monkeypatch.setattr(B, "BLOCK_QUERIES", block)
        monkeypatch.setattr(B, "SHARD_ITEMS", 70)  # several sheets a block
        got = I.neighbours(space, space.select("item_id"), 3)
        rows.append(sorted((r.qid, r["rank"], r.item_id) for r in got.collect()))
        assert "CartesianProduct" in plan_of(got) and "Generate" not in plan_of(got)
    x = np.array([r.vec for r in space.orderBy("item_id").collect()])
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    best = np.argsort(-s, axis=1, kind="stable")[:, :3]
    assert rows[0] == rows[1] == [(q, k + 1, int(i)) for q, row in enumerate(best) for k, i in enumerate(row)]


def test_best_rows_over_sheets():
    import numpy as np

    from kinograph.operators import blocks as B

    rng = np.random.default_rng(5)
    scores, ids = rng.integers(0, 9, size=(7, 90)).astype(float), np.sort(rng.integers(0, 80, size=90))  # ties, and ids that repeat
    scores[2, 5], scores[3], scores[6, 4:] = np.nan, -np.inf, -np.inf
    best = B.BestRows(np.arange(7), 6, {1: ids[[3, 40]], 4: np.array([500])})
    best.HEAD = 10
    for a, b in ((0, 50), (50, 53), (53, 90)):
        for rows in (np.arange(4), np.array([4, 6, 5])):
            best.add(rows, scores[rows, a:b], ids[a:b])
    got = best.frame(["qid", "item_id", "score"])
    for q in range(7):
        gone = ids[[3, 40]] if q == 1 else []
        want = sorted((-s, i) for s, i in zip(scores[q], ids) if np.isfinite(s) and i not in gone)[:6]
        mine = got[got.qid == q]
        assert list(zip(-mine.score, mine.item_id)) == want


def test_gains_leave_a_task_in_bounded_frames(spark, monkeypatch):
    import numpy as np

    from kinograph.functions import kernels as N
    from kinograph.operators import blocks as B
    from kinograph.operators import coldstart as Q

    # Numbers are handed on as few users by few items, whatever a block holds.
    monkeypatch.setattr(Q, "USERS_AT_ONCE", 3)
    monkeypatch.setattr(Q, "SQUARES_AT_ONCE", 8 * 15 * 4)
    rng = np.random.default_rng(2)
    x, roots = rng.normal(size=(20, 4)), rng.normal(size=(8, 5, 5))
    covs = [r @ r.T for r in roots]
    models = spark.createDataFrame([(u, [0.0] * 5, covs[u].ravel().tolist(), 2.0 + u, 0, 1.0) for u in range(8)], "user_id long, mean array<double>, cov array<double>, beta double, n_rff int, gamma double")
    pool = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, vec array<double>")
    asked = spark.createDataFrame([(0, 3), (0, 3), (5, 7), (99, 1)], "user_id long, item_id long")
    sizes, plain = [], B.per_block

    def watched(queries, items, skip, fn, schema, *args, **more):
        if more.get("streamed"):
            users = B._of_sheet(B.sheets(queries.coalesce(1), "a", 100).head()["a"])
            sizes.extend(len(f) for f in fn(users, iter([items.toPandas()]), {}))
        return plain(queries, items, skip, fn, schema, *args, **more)

    monkeypatch.setattr(B, "per_block", watched)
    phi = np.hstack([np.ones((20, 1)), x])
    ref = phi.T @ phi / 20
    for got, rule in ((Q.information_gain(models, pool, asked), lambda b, e, s: 0.5 * np.log1p(b * e)), (Q.variance_reduction(models, pool, asked, pool), lambda b, e, s: b * s / (1 + b * e))):
        rows = {(r.user_id, r.item_id): r.gain for r in got.collect()}
        assert len(rows) == 8 * 20 - 2 and (0, 3) not in rows and (5, 7) not in rows
        for (u, i), gain in rows.items():
            want = rule(2.0 + u, phi[i] @ covs[u] @ phi[i], phi[i] @ covs[u] @ ref @ covs[u] @ phi[i])
            assert abs(gain - want) < 1e-9 * max(1.0, abs(want))
    assert max(sizes) <= 3 * 4 and sum(sizes) == 2 * 160
    assert np.allclose(N.forms(np.stack([N.pack(covs[0])]), 5) @ N.squares(phi), N.quadratic(phi, covs[0]))


def test_models_and_rows_meet_in_a_stream(spark, monkeypatch):
    from pyspark.sql import types as T

    from kinograph.operators import taste as K

    monkeypatch.setattr(K, "CHUNK", 10)
    big, calls = 2**60 + 1, spark.sparkContext.accumulator(0)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(47).select(F.when(F.col("id") < 25, 1).when(F.col("id") < 32, 2).when(F.col("id") < 46, 3).cast("long").alias("user_id"), F.col("id").alias("item_id"), (F.col("id") + big).alias("row_id"))
    models = spark.createDataFrame([(1, [2.0]), (3, [5.0]), (4, [7.0]), (None, [1.0])], "user_id long, row_id array<double>")  # a name that rows have too
    schema = T.StructType([*rows.schema.fields, T.StructField("x", T.DoubleType())])

    def fn(model, pdf):
        calls.add(1)
        return pdf.assign(x=model["row_id"][0] * pdf["item_id"])[schema.names]

    try:
        for batch in ("10000", "4"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            before = calls.value
            got = K.with_model(rows, models, fn, schema)
            assert "CoGroup" not in plan_of(got) and "MapInArrow" in plan_of(got)
            seen = sorted((r.user_id, r.item_id, r.row_id, r.x) for r in got.collect())
            assert seen == [(u, i, big + i, m * i) for u, m, ids in ((1, 2.0, range(25)), (3, 5.0, range(32, 46))) for i in ids]
            assert calls.value - before >= 5  # busy users' rows stand in several chunks
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_sheets_are_bounded_by_rows_and_bytes(spark):
    from kinograph.operators import blocks as B

    B.bounded_batches(spark)
    wide = spark.range(0, 3000, 1, 1).select(F.col("id").alias("item_id"), F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda j: j / 7).alias("vec"))
    sizes = [len(B._of_sheet(r.a)) for r in B.sheets(wide, "a", 2500).collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 2 and max(sizes) * 8000 <= 2 * B.BATCH_BYTES
    assert [len(B._of_sheet(r.a)) for r in B.sheets(wide.limit(10), "a", 4).collect()] == [4, 4, 2]
    assert B.sheets(wide.limit(0), "a", 4).count() == 0


def _popular_world(spark, per_user):
    """Items 0 to 29 have no votes, 30 to 89 have ten; users 0 and 1 rated items with votes, users 2 and 3 only items without."""
    items = cut(spark.range(90).select(F.col("id").alias("item_id"), F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * F.col("id"))).alias("vec"), F.when(F.col("id") >= 30, 10).alias("imdb_votes")))
    rated = [(u, (30 if u < 2 else 0) + (7 * k) % (60 if u < 2 else 30), ((u + 3 * k) % 11) / 10, 1.0) for u in range(4) for k in range(per_user[u])]
    return items, spark.createDataFrame(rated, "user_id long, item_id long, reward double, weight double")


def _same_models(got, want):
    import numpy as np

    got, want = ({r.user_id: r for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys()
    for user, r in got.items():
        w = want[user]
        assert (r.n_rff, r.gamma, r.n_real, r.n_obs) == (w.n_rff, w.gamma, w.n_real, w.n_obs)
        assert np.allclose(r.mean, w.mean, atol=1e-6) and np.allclose(r.cov, w.cov, atol=1e-6) and np.isclose(r.log_evidence, w.log_evidence)
    return got


def test_popular_models_try_lifts_and_draw_for_users_without_a_floor(spark, monkeypatch):
    from kinograph.operators import taste as K

    items, labels = _popular_world(spark, (60, 20, 30, 8))
    feats = items.select("item_id", "vec")
    ours, others = labels.filter("user_id < 2"), labels.filter("user_id >= 2")
    got = K.fit_taste_popular(labels, feats, items.select("item_id", "imdb_votes"), 6, rff_gate=18)
    # Ten votes is the floor of users 0 and 1: their draw is the uniform one of the items above it, that of the others of all.
    want = K.fit_taste(ours, feats, K.sample_negatives(items.filter("imdb_votes >= 10"), 6), rff_gate=18).unionByName(
        K.fit_taste(others, feats, K.sample_negatives(items, 6), rff_gate=18))
    found = _same_models(got, want)
    assert len(found) == 4 and any(r.n_rff for r in found.values())
    monkeypatch.setattr(K, "CHUNK", 25)  # users 0 and 2 by moments alone
    monkeypatch.setattr(K, "USERS_A_DRAW", 1)
    _same_models(K.fit_taste_popular(labels, feats, items.select("item_id", "imdb_votes"), 6, rff_gate=18), want)


def test_watched_jobs_share_calls_to_the_state_store():
    import types

    import pandas as pd

    from kinograph.streaming import jobs as J

    held, timers, writes = [], [], []
    state = types.SimpleNamespace(exists=lambda: bool(held), get=lambda: held[-1], update=lambda v: (held.append(v), writes.append(1)))
    handle = types.SimpleNamespace(getValueState=lambda *_: state, listTimers=lambda: iter(list(timers)), deleteTimer=timers.remove, registerTimer=timers.append)
    watch = J.JobWatch(("downloading",), 1000, 30)
    watch.init(handle)
    at = lambda ms: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms, getExpiryTimeInMs=lambda: ms)
    lines = pd.DataFrame([(f"j{k}", 1, 10 * k, "state", "paused" if k % 2 else "downloading", None) for k in range(50)], columns=["job_id", "line", "at_ms", "kind", "state", "reason"])
    said = pd.concat(watch.handleInputRows((0,), iter([lines[:20], lines[20:]]), None))
    assert sorted(said["job_id"]) == sorted(lines["job_id"]) and len(writes) == 1 and timers == [30]
    said = pd.concat(watch.handleExpiredTimer((0,), at(50), at(30)))  # jobs 0 and 2 are silent, the next is due at 70
    assert list(zip(said["job_id"], said["state"], said["status"])) == [("j0", "downloading", "interrupted"), ("j2", "downloading", "interrupted")] and timers == [70]
    said = pd.concat(watch.handleExpiredTimer((0,), at(1010), at(70)))
    assert len(said) == 24 and list(said.loc[said["job_id"] == "j1", "status"]) == ["cancelled"] and timers == [1030] and len(writes) == 3


def test_shortlists_of_sheets_leave_their_block_once(spark, monkeypatch):
    from kinograph.operators import blocks as B
    from kinograph.operators import slates as L
    from kinograph.operators import taste as K

    monkeypatch.setattr(B, "BLOCK_ITEMS", 50)
    items = cut(spark.range(400).select(F.col("id").alias("item_id"), *[F.array(F.sin("id"), F.cos(F.col("id") * F.col("id"))).alias(c) for c in ("vec", "latent")]))
    titles = items.select("item_id", F.lit("en").alias("language"), (F.col("item_id") * 3).alias("imdb_votes"), F.lit("movie").alias("kind"), F.lit(2000).alias("year"))
    labels = spark.range(60).select((F.col("id") % 6).alias("user_id"), (F.col("id") * 5).alias("item_id"), (F.col("id") / 60).alias("reward"), F.lit(1.0).alias("weight"))
    models = cut(K.fit_taste(labels, items, None, allow_rff=False))
    seen, plain = [], L.top_k_scored
    monkeypatch.setattr(L, "top_k_scored", lambda df, k, *a, **b: (seen.append((df.groupBy("user_id").count().agg(F.max("count")).first()[0], k)), plain(df, k, *a, **b))[1])
    some = models.select("user_id")
    top, best = L._scan(K.mean_weights(models), K.mean_weights(models), items.join(titles, "item_id"), None, 20, 10, None, 0.6, 0.3)
    assert top.count() == 20 * some.count() and best.count() == 10 * some.count()
    assert seen == [(20, 20), (10, 10)]  # not so many a sheet, of which there are eight


def test_split_places_users_where_they_meet_and_busy_ones_by_a_range_sort(spark, monkeypatch):
    import hashlib

    from kinograph.operators import evaluation as P

    rows = [(u, i, float(i % 5)) for u, n in ((1, 40), (2, 7), (None, 3)) for i in range(n)]
    history = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    want = set()
    for u, n in ((1, 40), (2, 7)):
        order = sorted(range(n), key=lambda i: hashlib.md5(f"0-{u}-{i}".encode()).hexdigest())
        want |= {(u, i, float(i % 5), at < n * 6 // 10) for at, i in enumerate(order)}
    plan = P.split_history(history)
    assert {tuple(r) for r in plan.collect()} == want and plan.columns == ["user_id", "item_id", "rating", "known"]
    assert plan_of(plan).split("== Initial Plan ==")[-1].count("Exchange ") == 1  # one shuffle by user, of rows that were stored once
    monkeypatch.setattr(P, "ROWS_TOGETHER", 20)
    assert {tuple(r) for r in P.split_history(history).collect()} == want


def test_slates_and_relevance_share_one_split(spark, monkeypatch):
    from kinograph.operators import evaluation as P
    from kinograph.plans import evaluation as plans

    asked, plain = [], P.split_history
    monkeypatch.setattr(P, "split_history", lambda *a, **b: (asked.append(1), plain(*a, **b))[1])
    shown, rel = plans._shown(spark, DIR)
    assert len(asked) == 1
    shown.count(), rel.count()
    assert len(asked) == 1


def test_als_blocks_grow_in_number(spark, monkeypatch):
    from pyspark.ml.recommendation import ALS

    given, plain = [], ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda self, df, *a: (given.append((self.getNumUserBlocks(), self.getNumItemBlocks())), plain(self, df, *a))[1])
    rows = spark.range(300).select((F.col("id") % 17).alias("user_id"), (F.col("id") % 23).alias("movie_id"), (1.0 + F.col("id") % 3).alias("confidence"))
    assert I.als_factors(rows, 2, iterations=1).count() == 23
    monkeypatch.setattr(I, "ALS_BLOCK", 25)
    assert I.als_factors(rows, 2, iterations=1).count() == 23
    assert given == [(10, 10), (12, 12)]
