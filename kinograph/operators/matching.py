"""Free-text titles to catalogue rows, for a whole table of queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import alike
from ..functions import scalar as S
from ..functions import text as X
from ..session import cut, top_per_key
from . import blocks as B

MATCH = ("item_id", "title", "original_title", "year", "kind", "language", "imdb_votes")
#: The least score of a similarity match.
FUZZY_FLOOR = 0.45


def prepare_queries(queries: DataFrame) -> DataFrame:
    """Distinct searches of (query_id, query[, kind]): raw text, year, search form.

    Equal texts are searched once. A query with a trailing year also carries the whole
    string as a second attempt, used when the year-filtered tiers find nothing.
    """
    kind = F.col("kind") if "kind" in queries.columns else F.lit(None).cast("string")
    kind = F.when(kind.isin("movie", "tv"), kind)
    base = queries.select("query", kind.alias("want_kind")).distinct()
    bare, year = S.split_year(F.col("query"))
    first = base.select("query", "want_kind", F.lit(1).alias("attempt"), bare.alias("raw"), year.alias("want_year"))
    second = first.filter(F.col("want_year").isNotNull()).select(
        "query", "want_kind", F.lit(2).alias("attempt"), F.trim("query").alias("raw"), F.lit(None).cast("int").alias("want_year"))
    return (
        first.unionByName(second).withColumn("norm", X.normalise_title(F.col("raw"))).filter(F.col("norm") != "")
        .withColumn("search_id", F.sha2(F.concat_ws("\x1f", "query", F.coalesce("want_kind", F.lit("")), F.col("attempt").cast("string")), 256))
    )


def prepare_titles(titles: DataFrame) -> DataFrame:
    return titles.select(*MATCH).withColumns({
        "norm_title": X.normalise_title(F.col("title")), "norm_original": X.normalise_title(F.col("original_title"))})


def _fits(with_year: bool = True) -> Column:
    keep = F.col("want_kind").isNull() | (F.col("kind") == F.col("want_kind"))
    if with_year:
        keep &= F.col("want_year").isNull() | F.col("year").between(F.col("want_year") - 1, F.col("want_year") + 1)
    return keep


def _best(hits: DataFrame, limit: int | None) -> DataFrame:
    """The best-scored hits of each search, or all; known titles first among equals."""
    if limit is None:
        return hits
    return top_per_key(hits, ["search_id"], [F.desc("score"), F.desc_nulls_last("imdb_votes"), F.asc("item_id")], limit, "_r").drop("_r")


def _bonus() -> Column:
    return S.popularity_bonus(F.col("imdb_votes")) + S.year_bonus(F.col("want_year"), F.col("year"))


def match_exact(searches: DataFrame, titles: DataFrame, limit: int | None = None) -> DataFrame:
    """Tier 1: a title form equals the query, as an equi-join on keyed forms. Every hit is scored
    before ``limit`` keeps the best of each search."""
    forms = F.array_distinct(F.array(*[
        F.struct(F.lit(t).alias("tag"), f.alias("key")) for c in ("title", "original_title")
        for t, f in (("n", X.search_key(F.col(c))), ("r", F.lower(c)))]))
    keyed = titles.withColumn("_f", F.explode(forms)).select(*titles.columns, "_f.tag", "_f.key").filter("key is not null")
    asked = searches.withColumn("_f", F.explode(F.array(
        F.struct(F.lit("n").alias("tag"), F.col("norm").alias("key")), F.struct(F.lit("r").alias("tag"), F.lower("raw").alias("key")))))
    hits = asked.select(*searches.columns, "_f.tag", "_f.key").join(keyed, ["tag", "key"]).filter(_fits()).drop("tag", "key")
    return _best(hits.dropDuplicates(["search_id", "item_id"]).withColumn("score", F.lit(1.0) + _bonus()), limit)


def _grams(text: Column, n: Column | int) -> Column:
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n) if isinstance(n, int) else n))))


def match_contains(searches: DataFrame, titles: DataFrame, limit: int | None = None) -> DataFrame:
    """Tier 2: the raw query is inside a title. The join runs on the query's rarest
    character gram (three letters, fewer for shorter queries) and is then verified. Every
    hit is scored, by how much of the title the query covers, before ``limit`` applies."""
    low = titles.withColumns({"_lt": F.lower("title"), "_lo": F.lower("original_title")})
    empty = F.array().cast("array<string>")
    all_grams = F.array_distinct(F.concat(*[F.coalesce(_grams(F.col(c), n), empty) for c in ("_lt", "_lo") for n in (1, 2, 3)]))
    index = low.select("item_id", F.explode(all_grams).alias("gram"))
    freq = index.groupBy("gram").agg(F.count("*").alias("_n"))
    raw = F.lower("raw")
    wanted = searches.withColumn("_raw", raw).filter(F.length("_raw") > 0).withColumn(
        "gram", F.explode(_grams(F.col("_raw"), F.least(F.length("_raw"), F.lit(3)))))
    # A gram no title holds proves the query matches nothing, so it may be the rarest too.
    rarest = (
        wanted.select("search_id", "gram").join(freq, "gram", "left").groupBy("search_id")
        .agg(F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram"))
    )
    hits = (
        # The index is many times the titles, which Spark does not see: unasked it would be broadcast.
        searches.withColumn("_raw", raw).join(rarest, "search_id").join(index.hint("merge"), "gram").drop("gram").join(low, "item_id")
        .filter((F.contains("_lt", "_raw") | F.contains("_lo", "_raw")) & _fits())
    )

    def cover(c):
        c = F.col(c)
        return F.when((c != "") & F.contains(c, F.col("norm")), F.lit(0.55) + F.lit(0.30) * (F.length("norm") / F.length(c)))

    best = F.greatest(F.coalesce(cover("norm_title"), F.lit(0.0)), F.coalesce(cover("norm_original"), F.lit(0.0)))
    return _best(hits.drop("_raw", "_lt", "_lo").withColumn("score", best + _bonus()).filter(F.col("score") > 0), limit)


#: Distinct queries and title forms of a block; characters of a band of lengths.
BLOCK_NORMS, BLOCK_FORMS, BAND = 512, 2048, 4
#: Seeds of a search: its rarest grams of these lengths, each held by at most so many forms.
SEED_GRAMS, SEED_LENGTHS, SEED_FORMS = 4, (8, 5, 3), 128
#: The most a title's fame adds to its score, and what its similarity counts.
FAME, SCALE = 0.06, 0.9


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries and of title forms to the pairs that can reach the queries' scores."""
    for batch in batches:
        asked, forms = batch.column("asked"), batch.column("forms")
        for k in range(batch.num_rows):
            left, right = asked[k].values, forms[k].values
            norms, texts = left.field("text").to_pylist(), right.field("text").to_pylist()
            i, j, same = alike.near_pairs(norms, left.field("least").to_numpy(), texts, right.field("lift").to_numpy(), SCALE)
            yield pa.RecordBatch.from_arrays(
                [left.field("text").take(pa.array(i)), right.field("text").take(pa.array(j)), pa.array(same, pa.float64())], names=["norm", "form", "_s"])


def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = alike.pair_ratios(batch.column("norm").to_pylist(), batch.column("form").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("norm"), batch.column("form"), pa.array(same, pa.float64())], names=["norm", "form", "_s"])


_ALIKE = "norm string, form string, _s double"


def _blocked(texts: DataFrame, size: int, *cols: str) -> DataFrame:
    """(band, block, rows): the rows of each band of lengths in blocks of ``size`` in the mean, dealt by
    hash of distinct texts."""
    sizes = texts.groupBy("band").agg(F.ceil(F.count("*") / size).alias("_n"))
    return texts.join(sizes, "band").groupBy("band", F.pmod(F.xxhash64("text"), F.col("_n")).alias("block")).agg(
        F.collect_list(F.struct("text", *cols)).alias("rows"))


def _alike(norms: DataFrame, forms: DataFrame) -> DataFrame:
    """Pairs of distinct ``norms`` (text, least: the score to reach without the title's fame) and
    ``forms`` (text, lift: its fame). They meet in the bands of lengths whose shorter string could be matched whole and
    reach the score; a bound on shared characters then decides which pairs are compared."""
    tight = F.greatest((F.col("least") - FAME) / SCALE, F.lit(0.02))
    low, high = F.length("text") * tight / (2 - tight), F.length("text") * (2 - tight) / tight
    banded = forms.withColumn("band", F.floor(F.length("text") / BAND))
    last = F.lit(banded.agg(F.max("band")).first()[0] or 0)
    bands = F.sequence(F.least(F.floor(F.ceil(low - 1e-6) / BAND), last), F.least(F.floor(F.floor(high + 1e-6) / BAND), last))
    asked = _blocked(norms.withColumn("band", F.explode(bands)), BLOCK_NORMS, "least").withColumnsRenamed({"block": "_q", "rows": "asked"})
    given = _blocked(banded, BLOCK_FORMS, "lift").withColumnsRenamed({"block": "_f", "rows": "forms"})
    return B.spread(asked.join(given, "band"), "band", "_q", "_f").select("asked", "forms").mapInArrow(_near, _ALIKE)


def _seeds(norms: DataFrame, forms: DataFrame) -> DataFrame:
    """Some likely pairs: they share one of a query's rarest grams. What they miss is only speed."""
    none = F.array().cast("array<string>")

    def grams(df, name):
        every = F.concat(*[F.coalesce(_grams(F.col("text"), n), none) for n in SEED_LENGTHS])
        return df.select(F.col("text").alias(name), F.explode(every).alias("gram"))

    index = grams(forms, "form")
    rare = index.groupBy("gram").agg(F.count("*").alias("_n")).filter(F.col("_n") <= SEED_FORMS)
    wanted = top_per_key(grams(norms, "norm").join(rare, "gram"), ["norm"], [F.col("_n"), F.col("gram")], SEED_GRAMS, "_r").select("norm", "gram")
    pairs = wanted.join(index, "gram").select("norm", "form").distinct()
    return B.spread(pairs, "norm", "form").mapInArrow(_ratios, _ALIKE)


def _similarity_hits(asked: DataFrame, named: DataFrame, alike_: DataFrame, same_start: bool) -> DataFrame:
    """Searches and titles by the similarity of the title's better form, scored."""
    # Equal names are joined once.
    names = named.select("_nt", "_no").distinct().withColumn("form", F.explode(F.array_distinct(F.array("_nt", "_no"))))
    best = alike_.join(names, "form").groupBy("norm", "_nt", "_no").agg(F.max("_s").alias("_s"))
    pairs = asked.join(best, "norm").join(named, ["_nt", "_no"]).filter(_fits(with_year=False))
    if same_start:
        starts = F.startswith(F.lower("title"), F.col("_prefix")) | F.startswith(F.lower("original_title"), F.col("_prefix"))
        pairs = pairs.filter(F.col("_block").isNull() | F.coalesce(starts, F.lit(False)))
    return pairs.withColumn("score", F.col("_s") * SCALE + _bonus())


def _started(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """Each search's first letters, and whether a title of its kind starts with them."""
    starts = F.array_distinct(F.array_compact(F.array(*[
        F.when(F.length(c) >= n, F.substring(F.lower(c), 1, n)) for c in ("title", "original_title") for n in (1, 2, 3, 4)])))
    begun = titles.select("kind", F.explode(starts).alias("_prefix"))
    begun = begun.select("_prefix", F.explode(F.array(F.lit(""), F.coalesce("kind", F.lit("")))).alias("_kind")).distinct().withColumn("_block", F.lit(True))
    return asked.withColumns({"_prefix": F.substring(F.split("norm", " ")[0], 1, 4), "_kind": F.coalesce("want_kind", F.lit(""))}).join(
        begun, ["_prefix", "_kind"], "left")


def match_fuzzy(searches: DataFrame, titles: DataFrame, limit: int | None = None, floor: float = FUZZY_FLOOR, same_start: bool = False) -> DataFrame:
    """Tier 3: sequence similarity, from a score of ``floor`` up; of each search the best ``limit``.

    Every title that reaches the score is found: strings meet in bands of lengths, and only pairs
    whose lengths, characters and largest possible bonus keep them below it are not compared. With
    ``limit``, titles that share rare grams are scored first, and the last score they leave within the
    limit is what all others have to reach, so near-hopeless pairs drop out by length and characters.
    ``same_start`` keeps titles that start with the query's first letters only, where a title does.
    """
    searches = searches.filter(~((F.length("norm") <= 4) & F.col("norm").rlike(r"^\d+$")))
    asked = cut(_started(searches, titles) if same_start else searches)
    named = cut(titles.withColumns({"_nt": F.coalesce("norm_title", F.lit("")), "_no": F.coalesce("norm_original", F.lit(""))}))
    dated = F.when(F.coalesce("want_year", F.lit(0)) != 0, 0.10).otherwise(0.0)
    norms = asked.groupBy(F.col("norm").alias("text")).agg(F.min(floor - dated).alias("least"))
    forms = cut(named.select(F.explode(F.array_distinct(F.array("_nt", "_no"))).alias("text"), S.popularity_bonus(F.col("imdb_votes")).alias("_b")).groupBy(
        "text").agg(F.max("_b").alias("lift")))
    if limit is not None:
        seen = _similarity_hits(asked, named, _seeds(norms, forms), same_start)
        last = top_per_key(seen, ["search_id"], [F.desc("score"), F.asc("item_id")], limit, "_r").groupBy("search_id").agg(
            F.count("*").alias("_n"), F.min("score").alias("_last")).filter(F.col("_n") == limit).select("search_id", "_last")
        norms = asked.join(last, "search_id", "left").groupBy(F.col("norm").alias("text")).agg(
            F.min(F.greatest(F.lit(floor), F.coalesce("_last", F.lit(floor))) - dated).alias("least"))
    scored = _similarity_hits(asked, named, cut(_alike(cut(norms), forms)), same_start)
    return _best(scored.select(*searches.columns, *titles.columns, "score").filter(F.col("score") >= floor), limit)


def search_titles(queries: DataFrame, titles: DataFrame, limit: int = 8, same_start: bool = False) -> DataFrame:
    """The cascade: exact, else containment scoring 0.80 or more, else the best of
    containment and similarity from 0.45 up; ``same_start`` as in ``match_fuzzy``."""
    # Each of these feeds several tiers; a reliable checkpoint computes it once.
    searches, forms = cut(prepare_queries(queries)), cut(prepare_titles(titles))
    exact = cut(match_exact(searches, forms, limit))
    rest = searches.join(exact.select("search_id").distinct(), "search_id", "left_anti")
    within = cut(match_contains(rest, forms, limit))
    settled = within.groupBy("search_id").agg(F.max("score").alias("_top")).filter("_top >= 0.80").select("search_id")
    open_ = rest.join(settled, "search_id", "left_anti")
    numeric = (F.length("norm") <= 4) & F.col("norm").rlike(r"^\d+$")
    # A second attempt only stands in when the first found nothing in the first two tiers.
    fuzzy = cut(match_fuzzy(cut(open_), forms, limit, same_start=same_start))
    keep = ["query", "want_kind", "attempt", "search_id", *MATCH, "score"]
    found = (
        exact.withColumn("tier", F.lit(1)).select(*keep, "tier")
        .unionByName(within.join(settled, "search_id", "left_semi").withColumn("tier", F.lit(2)).select(*keep, "tier"))
        .unionByName(within.join(settled, "search_id", "left_anti").filter(numeric | (F.col("score") >= FUZZY_FLOOR)).withColumn("tier", F.lit(3)).select(*keep, "tier"))
        .unionByName(fuzzy.withColumn("tier", F.lit(4)).select(*keep, "tier"))
    )
    # Tiers 1 to 3 are the first two tiers of the cascade; 4 is similarity.
    strong = found.groupBy("query", "want_kind").agg(
        F.bool_or((F.col("attempt") == 1) & (F.col("tier") <= 3)).alias("_first"),
        F.bool_or((F.col("attempt") == 2) & (F.col("tier") <= 3)).alias("_second"))
    use = F.when(~F.col("_first") & F.col("_second"), 2).otherwise(1)
    chosen = found.alias("f").join(strong.withColumn("_use", use).alias("s"),
                                   (F.col("f.query") == F.col("s.query")) & F.col("f.want_kind").eqNullSafe(F.col("s.want_kind"))
                                   & (F.col("f.attempt") == F.col("s._use"))).select("f.*")
    best = chosen.groupBy("search_id", "query", "want_kind", "item_id").agg(
        F.max_by(F.struct(*[c for c in MATCH if c != "item_id"], "score"), F.col("score")).alias("_b")
    ).select("search_id", "query", "want_kind", "item_id", "_b.*")
    w = Window.partitionBy("search_id").orderBy(F.desc("score"), F.desc_nulls_last("imdb_votes"), "item_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("search_id")


def confident_match(hits: DataFrame, keys: tuple = ("query", "want_kind")) -> DataFrame:
    """Per query: the winner when it is good and clearly ahead, else none."""
    top = hits.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(F.when(F.col("rank") == 1, F.struct("item_id", "score"))).alias("_a"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_b"))
    gap = F.col("_a.score") - F.col("_b")
    sure = F.when(F.col("n") == 1, F.col("_a.score") >= 0.6).otherwise(
        ((F.col("_a.score") >= 0.95) & (gap >= 0.08)) | ((F.col("_a.score") >= 0.75) & (gap >= 0.20)))
    return top.select(*keys, "n", F.col("_a.item_id").alias("best_id"), F.col("_a.score").alias("best_score"),
                      F.coalesce(sure, F.lit(False)).alias("confident"),
                      F.when(sure, F.col("_a.item_id")).alias("item_id"))


def resolve_batch(queries: DataFrame, titles: DataFrame, same_start: bool = False) -> DataFrame:
    """Every query with its confident item, or the label of the closest title."""
    kind = F.col("kind") if "kind" in queries.columns else F.lit(None).cast("string")
    asked = queries.withColumn("want_kind", F.when(kind.isin("movie", "tv"), kind))
    hits = cut(search_titles(queries, titles, 6, same_start))
    closest = hits.filter(F.col("rank") == 1).select(
        F.col("query").alias("_q"), F.col("want_kind").alias("_k"),
        S.match_label(F.col("title"), F.col("original_title"), F.col("year"), F.col("language"), F.col("kind")).alias("closest"))
    picks = confident_match(hits).select(F.col("query").alias("_q2"), F.col("want_kind").alias("_k2"), "item_id", "confident", "best_score")
    return (
        asked.join(picks, (F.col("query") == F.col("_q2")) & F.col("want_kind").eqNullSafe(F.col("_k2")), "left")
        .join(closest, (F.col("query") == F.col("_q")) & F.col("want_kind").eqNullSafe(F.col("_k")), "left")
        .withColumn("status", F.when(F.col("confident"), "resolved").otherwise("unresolved"))
        .drop("_q", "_k", "_q2", "_k2", "confident", "want_kind")
    )


# --- external rating imports --------------------------------------------------------


def dedupe_first(rows: DataFrame, order: tuple = ("file_no", "pos")) -> DataFrame:
    """First occurrence of (normalised title, source id) in file order."""
    rest = [c for c in rows.columns]
    keyed = rows.withColumn("_key", X.normalise_export_title(F.col("title")))
    return keyed.groupBy("_key", "source_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select("_r.*")


def _tops(asked: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys`` of ``asked`` (query, _bound, …): how many candidates count, how many of them are exact, the two
    best exact ones and the best other one."""
    dated = asked.join(found, "query").withColumn("_in", F.coalesce(F.col("year").isNull() | (F.col("year") <= F.col("_bound")), F.lit(True)))
    match = F.struct("tmdb_id", F.col("kind"), F.col("c_title").alias("title"), "year", "popularity", "votes")
    # Both readings are kept side by side, so that no group is read twice: candidates in time, and all where none is.
    w = Window.partitionBy(*keys, "_exact", "_in").orderBy("rank")
    first = dated.select(*keys, "_exact", "_in", "rank", match.alias("_m")).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2).groupBy(*keys, "_in").agg(
        F.max(F.when(F.col("_exact") & (F.col("_n") == 1), F.col("_m"))).alias("_best"),
        F.max(F.when(F.col("_exact") & (F.col("_n") == 2), F.col("_m"))).alias("_next"),
        F.min_by(F.when(~F.col("_exact"), F.col("_m")), F.when(~F.col("_exact"), F.col("rank"))).alias("_guess"))
    counts = dated.groupBy(*keys, "_in").agg(F.count_if("_exact").alias("exact_n"), F.count("*").alias("cand_n"))
    both = counts.join(first, [*keys, "_in"])
    kept = [c for c in both.columns if c not in (*keys, "_in")]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*kept), "_in").alias("_t")).select(*keys, "_t.*")


def grade_import(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Grade each row against its landed search results (query, rank, tmdb_id, kind, title,
    original_title, year, popularity, votes)."""
    rows = rows.withColumn("query", S.strip_edition(F.col("title")))
    # A row without a date takes every year.
    asked = rows.select("row_id", "query", F.coalesce(F.year("rated_on"), F.lit(2**31 - 1)).alias("_bound"))
    repeated = asked.groupBy("row_id").agg(F.count("*").alias("_c")).filter("_c > 1").select("row_id")
    once, again = asked.join(repeated, "row_id", "left_anti"), asked.join(repeated, "row_id", "left_semi")
    wanted = X.normalise_export_title(F.col("query"))
    found = candidates.withColumnRenamed("title", "c_title").withColumn("_wanted", wanted).withColumn(
        "_exact", F.coalesce((X.normalise_export_title(F.coalesce("c_title", F.lit(""))) == F.col("_wanted"))
                             | (X.normalise_export_title(F.coalesce("original_title", F.lit(""))) == F.col("_wanted")), F.lit(False))).drop("_wanted")
    # Rows of one search and year share their result; only rows whose id repeats, and so their candidates add up, are met one by one.
    by_search = once.join(_tops(once.select("query", "_bound").distinct(), found, ["query", "_bound"]), ["query", "_bound"]).drop("query", "_bound")
    tops = by_search.unionByName(_tops(again, found, ["row_id"]))
    g = rows.join(tops, "row_id", "left")
    margin = (F.round(F.coalesce("_best.popularity", F.lit(0.0)), 1) + 1.0) / (F.round(F.coalesce("_next.popularity", F.lit(0.0)), 1) + 1.0)
    clear = (margin >= 8.0) & (F.coalesce("_best.votes", F.lit(0)) > F.coalesce("_next.votes", F.lit(0)))
    n = F.coalesce("exact_n", F.lit(0))
    level = (
        F.when(F.col("title") == "", "unresolvable").when(F.col("cand_n").isNull(), "low").when(n == 0, "low")
        .when((n == 1) | clear, "high").otherwise("ambiguous")
    )
    reason = (
        F.when(F.col("title") == "", "empty title; only the source id remains").when(F.col("cand_n").isNull(), "search returned nothing")
        .when(n == 0, "no exact title match").when(n == 1, "unique exact title match")
        .when(clear, "exact match far more popular than next").otherwise(F.concat(n.cast("string"), F.lit(" films share this title")))
    )
    hit = F.when(F.col("title") == "", None).otherwise(F.coalesce("_best", "_guess"))
    return g.withColumns({"confidence": level, "reason": reason, "match": hit}).drop("exact_n", "cand_n", "_best", "_next", "_guess")


def flag_collisions(graded: DataFrame) -> DataFrame:
    """Rows that resolved to one title become ambiguous; counted, then joined back."""
    key = [F.col("match.tmdb_id").alias("_id"), F.coalesce("match.kind", F.lit("")).alias("_kind")]
    n = graded.filter(F.col("match.tmdb_id").isNotNull()).groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1")
    joined = graded.withColumns({"_id": F.col("match.tmdb_id"), "_kind": F.coalesce("match.kind", F.lit(""))}).join(n, ["_id", "_kind"], "left")
    clash = F.col("_n").isNotNull()
    return joined.withColumns({
        "confidence": F.when(clash, "ambiguous").otherwise(F.col("confidence")),
        "reason": F.when(clash, F.concat(F.col("_n").cast("string"), F.lit(" rows resolved to this same title"))).otherwise(F.col("reason")),
    }).drop("_id", "_kind", "_n")


def apply_rulings(graded: DataFrame, rulings: DataFrame) -> DataFrame:
    """Rulings (source_id, ruling: accept | skip | pick, tmdb_id, kind, title, year) settle
    rows; an unknown ruling shows as ``error``."""
    r = rulings.select("source_id", F.struct("ruling", "tmdb_id", "kind", "title", "year").alias("_u"))
    j = graded.join(r, "source_id", "left")
    rule = F.col("_u.ruling")
    pick = (rule == "pick") & F.col("_u.tmdb_id").isNotNull()
    chosen = F.struct(
        F.col("_u.tmdb_id").alias("tmdb_id"), F.coalesce("_u.kind", F.lit("movie")).alias("kind"), F.coalesce("_u.title", "title").alias("title"),
        F.col("_u.year").alias("year"), F.lit(None).cast("double").alias("popularity"), F.lit(None).cast("long").alias("votes"))
    none = rule.isNull()
    return j.withColumns({
        "confidence": F.when(none, F.col("confidence")).when(rule == "skip", "skipped").when((rule == "accept") & F.col("match").isNull(), "low")
        .when((rule == "accept") | pick, "high").otherwise("error"),
        "reason": F.when(none, F.col("reason")).when(rule == "skip", "ruled out by hand")
        .when((rule == "accept") & F.col("match").isNull(), "accepted by hand, but there was no candidate to accept")
        .when(rule == "accept", "best guess confirmed by hand").when(pick, "chosen by hand").otherwise("unrecognised ruling"),
        "match": F.when(pick, chosen.cast(graded.schema["match"].dataType)).otherwise(F.col("match")),
    }).drop("_u")


def review_rows(graded: DataFrame) -> DataFrame:
    return graded.filter(~F.col("confidence").isin("high", "skipped")).select(
        "row_id", "title", "thumbs", "verdict", "source_id", "rated_on", "confidence", "reason", "match")


def confidence_buckets(graded: DataFrame) -> DataFrame:
    return graded.groupBy("confidence").agg(F.count("*").alias("n"))


def import_external_ratings(rows: DataFrame, candidates: DataFrame, rulings: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole import: events for confident rows, dated back, and the review list.

    The caller decides whether to write (a dry run does not) and whether to clear the
    earlier import first.
    """
    graded = apply_rulings(flag_collisions(grade_import(rows, candidates)), rulings)
    ids = titles.filter(F.col("tmdb_id").isNotNull()).groupBy("tmdb_id", "kind").agg(F.min("item_id").alias("item_id"))
    sure = graded.filter(F.col("confidence") == "high").withColumns({"tmdb_id": F.col("match.tmdb_id"), "kind": F.col("match.kind")})
    events = sure.join(ids, ["tmdb_id", "kind"], "left").select(
        "row_id", "user_id", "item_id", "tmdb_id", F.lit("rate").alias("kind"),
        (dims.lookup(dims.VERDICTS, F.col("verdict")) * 10.0).alias("value"), F.lit("netflix").alias("source"),
        F.col("rated_on").cast("timestamp_ntz").alias("ts"),
        F.to_json(F.struct(F.col("source_id").alias("source_id"), "verdict")).alias("context"))
    return events, review_rows(graded)
