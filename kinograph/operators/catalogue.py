"""Building and maintaining the title catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalar as S
from ..session import global_index, one_row, top_per_key

# --- scope, projections, predicates -------------------------------------------------


def catalogue_scope(basics: DataFrame, min_year: int = dims.MIN_YEAR) -> DataFrame:
    """Kept title types from ``min_year`` on, without adult titles."""
    year = F.col("startYear").try_cast("int")
    adult = F.coalesce(F.col("isAdult").try_cast("tinyint"), F.lit(0)) == 1
    return (
        basics.filter(F.col("titleType").isin(*dims.KEPT_TITLE_TYPES) & (year >= min_year) & ~adult)
        .select(
            "tconst", S.derive_kind(F.col("titleType")).alias("kind"), year.alias("year"),
            F.col("endYear").try_cast("int").alias("end_year"),
            F.col("runtimeMinutes").try_cast("int").alias("runtime"),
            S.split_genres(F.col("genres")).alias("genres"), F.lit(False).alias("adult"),
            F.col("primaryTitle").alias("title"), F.col("originalTitle").alias("original_title"),
        )
    )


def rating_columns(ratings: DataFrame) -> DataFrame:
    return ratings.select(
        "tconst", F.col("averageRating").try_cast("double").alias("imdb_rating"),
        F.col("numVotes").try_cast("int").alias("imdb_votes"))


def attach_ratings(scope: DataFrame, ratings: DataFrame) -> DataFrame:
    return scope.join(rating_columns(ratings), "tconst", "left")


def flat_vote_floor(titles: DataFrame, floor: int = dims.MIN_VOTES) -> DataFrame:
    return titles.filter(F.col("imdb_votes") >= floor)


def restrict_to_kept(dump: DataFrame, keep: DataFrame, on: str = "tconst") -> DataFrame:
    """Cut a large dump to the kept titles before any other work on it."""
    return dump.join(keep.select(F.col("tconst").alias(on)), on, "left_semi")


def release_regions(akas: DataFrame, keep: DataFrame, limit: int = 12) -> DataFrame:
    regions = akas.select(F.col("titleId").alias("tconst"), "region").filter(F.col("region").isNotNull())
    return restrict_to_kept(regions, keep).groupBy("tconst").agg(
        F.slice(F.array_sort(F.collect_set("region")), 1, limit).alias("countries"))


def _names(names: DataFrame) -> DataFrame:
    return names.select("nconst", F.col("primaryName").alias("name"))


def resolve_crew(crew: DataFrame, names: DataFrame, keep: DataFrame, limit: int = 4) -> DataFrame:
    """At most ``limit`` distinct director and writer names per title.

    Both roles go through one explode and one join with the name dump.
    """
    kept = restrict_to_kept(crew.select("tconst", "directors", "writers"), keep)
    ids = kept.select("tconst", F.expr("stack(2, 'd', directors, 'w', writers) AS (role, ids)")).select(
        "tconst", "role", F.explode(F.split("ids", ",")).alias("nconst"))
    named = ids.join(_names(names), "nconst")

    def people(role: str) -> Column:
        return F.slice(F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("name")))), 1, limit)

    return named.groupBy("tconst").agg(
        F.nullif(people("d"), F.array().cast("array<string>")).alias("directors"),
        F.nullif(people("w"), F.array().cast("array<string>")).alias("writers"))


def resolve_cast(principals: DataFrame, names: DataFrame, keep: DataFrame, top_n: int = 8) -> DataFrame:
    billed = principals.select(
        "tconst", F.col("ordering").try_cast("smallint").alias("ordering"), "nconst", "category"
    ).filter(F.col("category").isin("actor", "actress", "self") & (F.col("ordering") <= top_n))
    return (
        restrict_to_kept(billed, keep).join(_names(names), "nconst").groupBy("tconst")
        .agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("ordering", "name"))), lambda x: x["name"]),
                     1, top_n).alias("cast_names"))
    )


def build_catalogue(dumps: dict[str, DataFrame | None], min_votes: int = dims.MIN_VOTES) -> DataFrame:
    """All dump joins; a missing optional dump leaves empty lists."""
    keep = flat_vote_floor(attach_ratings(catalogue_scope(dumps["title.basics"]), dumps["title.ratings"]), min_votes)
    names, out = dumps.get("name.basics"), keep
    if dumps.get("title.akas") is not None:
        out = out.join(release_regions(dumps["title.akas"], keep), "tconst", "left")
    if dumps.get("title.crew") is not None and names is not None:
        out = out.join(resolve_crew(dumps["title.crew"], names, keep), "tconst", "left")
    if dumps.get("title.principals") is not None and names is not None:
        out = out.join(resolve_cast(dumps["title.principals"], names, keep), "tconst", "left")
    empty = F.array().cast("array<string>")
    for c in ("countries", "directors", "writers", "cast_names"):
        out = out.withColumn(c, F.coalesce(F.col(c), empty) if c in out.columns else empty)
    return out.withColumnRenamed("tconst", "imdb_id").withColumns({
        "language": F.lit("xx"), "languages": F.lit(None).cast("array<string>"),
        "quality": S.quality_prior(F.col("imdb_rating"), F.col("imdb_votes")),
    })


def attach_links(titles: DataFrame, links: DataFrame) -> DataFrame:
    """External ids by stable id; repeated links keep the smallest id so no title doubles."""
    one = links.groupBy("imdb_id").agg(
        F.min(F.struct("movielens_id", "tmdb_id")).alias("_l")
    ).select("imdb_id", F.col("_l.movielens_id").alias("movielens_id"), F.col("_l.tmdb_id").alias("tmdb_id"))
    return titles.drop("movielens_id", "tmdb_id").join(one, "imdb_id", "left")


LEAN = ("item_id", "title", "original_title", "year", "kind", "language", "runtime", "genres", "keywords",
        "directors", "cast_names", "imdb_rating", "imdb_votes", "quality")


def lean_projection(titles: DataFrame) -> DataFrame:
    return titles.select(*LEAN)


def present(titles: DataFrame, overview: int = 260) -> DataFrame:
    """Display columns; the overview is shown up to so many characters."""
    empty = F.array().cast("array<string>")
    return titles.select(
        "item_id", "title",
        F.when((F.col("original_title") != "") & (F.coalesce(F.col("original_title") != F.col("title"), F.lit(True))),
               F.col("original_title")).alias("original_title"),
        "year", "kind", "language", dims.language_label(F.col("language")).alias("language_name"), "runtime",
        F.slice(F.coalesce("genres", empty), 1, 3).alias("genres"),
        F.slice(F.coalesce("directors", empty), 1, 2).alias("directors"),
        F.col("imdb_rating").alias("rating"), F.col("imdb_votes").alias("votes"),
        F.nullif(F.substring(F.coalesce("overview", F.lit("")), 1, overview), F.lit("")).alias("overview"),
        F.when(F.col("poster_path") != "", F.concat(F.lit(dims.POSTER_BASE), "poster_path")).alias("poster"),
    )


def hard_filters(titles: DataFrame, languages=(), kind: str | None = None, min_year=None, max_year=None,
                 min_runtime=None, max_runtime=None, min_votes=None, exclude: DataFrame | None = None) -> DataFrame:
    """Constraints, never penalties: an unknown value fails a bound; a falsy bound is not set."""
    def known(name):
        return F.coalesce(F.col(name), F.lit(0))

    keep = F.lit(True)
    if languages:
        keep &= F.coalesce(F.col("language"), F.lit("xx")).isin(*languages)
    if kind == "tv":
        keep &= F.coalesce(F.col("kind") == "tv", F.lit(False))
    elif kind == "movie":
        keep &= F.coalesce(F.col("kind") != "tv", F.lit(True))
    if min_year:
        keep &= known("year") >= min_year
    if max_year:
        keep &= (known("year") <= max_year) & (known("year") > 0)
    if min_runtime:
        keep &= known("runtime") >= min_runtime
    if max_runtime:
        keep &= (known("runtime") <= max_runtime) & (known("runtime") > 0)
    if min_votes:
        keep &= known("imdb_votes") >= min_votes
    out = titles.filter(keep)
    return exclude_items(out, exclude) if exclude is not None else out


def exclude_items(items: DataFrame, excluded: DataFrame, on=("item_id",)) -> DataFrame:
    """Anti-join on non-null keys, so a NULL in the list can never empty the result."""
    keys = excluded.select(*on).filter(F.col(on[0]).isNotNull()).distinct()
    return items.join(keys, list(on), "left_anti")


def lookup_titles(titles: DataFrame, ids: DataFrame) -> DataFrame:
    return titles.join(ids.select("item_id"), "item_id", "left_semi")


# --- quality ------------------------------------------------------------------------


def rating_distribution(titles: DataFrame, min_titles: int = 200) -> DataFrame:
    """Mean and sd per language; thin or flat languages take the global ones.

    One pass groups the titles; the global row is rebuilt from the per-language
    moments, so it needs no second scan.
    """
    per = (
        titles.filter(F.col("imdb_rating").isNotNull() & (F.col("imdb_votes") > 0))
        .groupBy("language").agg(F.count("*").alias("n"), F.avg("imdb_rating").alias("mean"),
                                 F.stddev_samp("imdb_rating").alias("sd"))
    )
    total = per.agg(
        F.sum("n").alias("gn"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("gm"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("gm2"),
        F.sum(F.coalesce(F.col("sd") * F.col("sd") * (F.col("n") - 1), F.lit(0.0))).alias("gss"),
    ).select(
        F.coalesce("gm", F.lit(6.4)).alias("g_mean"),
        F.coalesce(F.nullif(F.sqrt(F.try_divide(
            F.greatest(F.col("gss") + F.col("gm2") - F.col("gn") * F.col("gm") * F.col("gm"), F.lit(0.0)),
            F.col("gn") - 1)), F.lit(0.0)), F.lit(1.0)).alias("g_sd"))
    usable = (F.col("n") >= min_titles) & (F.col("sd") > 0.1)
    ok = F.coalesce(usable, F.lit(False))
    whole = one_row(total)
    return per.withColumn("g_mean", whole["g_mean"]).withColumn("g_sd", whole["g_sd"]).select(
        "language", "n", F.when(ok, F.col("mean")).otherwise(F.col("g_mean")).alias("mean"),
        F.when(ok, F.col("sd")).otherwise(F.col("g_sd")).alias("sd"), "g_mean", "g_sd", ok.alias("own"))


def recalibrate_quality(titles: DataFrame, min_titles: int = 200) -> DataFrame:
    """Quality as standing within a title's own language."""
    dist = rating_distribution(titles, min_titles)
    whole = one_row(dist.agg(F.max("g_mean").alias("m"), F.max("g_sd").alias("s")))
    # ``dist`` has one row per language; AQE broadcasts it by its measured size.
    joined = titles.join(dist.select("language", "mean", "sd"), "language", "left").withColumns(
        {"_gm": whole["m"], "_gs": whole["s"]})
    mean = F.coalesce("mean", "_gm", F.lit(6.4))
    sd = F.greatest(F.coalesce("sd", "_gs", F.lit(1.0)), F.lit(1e-6))
    shrunk = F.coalesce(
        S.shrink_rating(F.col("imdb_rating"), F.col("imdb_votes"), mean),
        S.shrink_rating(F.col("tmdb_rating"), F.col("tmdb_votes"), mean, 400.0))
    votes = F.coalesce(F.nullif("imdb_votes", F.lit(0)), F.nullif("tmdb_votes", F.lit(0)), F.lit(0))
    quality = S.clamp(F.lit(0.85) * (F.lit(0.5) + 0.18 * (shrunk - mean) / sd) + F.lit(0.15) * S.vote_confidence(votes))
    return joined.withColumn("quality", F.when(shrunk.isNull(), F.lit(0.5)).otherwise(quality)).drop("mean", "sd", "_gm", "_gs")


# --- floors -------------------------------------------------------------------------


def floor_lookup(titles: DataFrame, floors: DataFrame, default: int = dims.VOTE_FLOOR_DEFAULT,
                 scale: float = 1.0) -> DataFrame:
    """Adds ``floor``: the language's scaled constant or the default, rounded half to even."""
    scaled = floors.select("language", F.bround(F.col("floor") * F.lit(float(scale))).cast("int").alias("floor"))
    return titles.join(scaled, "language", "left").withColumn(
        "floor", F.coalesce("floor", F.lit(int(round(default * scale)))))


def prune_by_language(titles: DataFrame, floors: DataFrame, events: DataFrame, scale: float = 1.0) -> DataFrame:
    """Titles that stay: no vote count, at or above their floor, or with any event."""
    tagged = floor_lookup(titles, floors, scale=scale)
    touched = events.select("item_id").distinct().withColumn("_touched", F.lit(True))
    return tagged.join(touched, "item_id", "left").filter(
        F.col("imdb_votes").isNull() | (F.col("imdb_votes") >= F.col("floor")) | F.col("_touched")
    ).drop("floor", "_touched")


def prune_counts(titles: DataFrame, floors: DataFrame, events: DataFrame, scale: float = 1.0) -> DataFrame:
    """Dry run: rows before and after."""
    tagged = floor_lookup(titles, floors, scale=scale)
    touched = events.select("item_id").distinct().withColumn("_touched", F.lit(True))
    stays = F.coalesce(F.col("imdb_votes").isNull() | (F.col("imdb_votes") >= F.col("floor")) | F.col("_touched"), F.lit(False))
    return tagged.join(touched, "item_id", "left").agg(
        F.count("*").alias("before"), F.count_if(stays).alias("after"))


def enrichment_floor(floors: DataFrame, default: int = dims.VOTE_FLOOR_DEFAULT, scale: float = 1.0) -> DataFrame:
    return floors.agg(F.min(F.bround(F.col("floor") * F.lit(float(scale))).cast("int")).alias("f")).select(
        F.least(F.coalesce("f", F.lit(int(round(default * scale)))), F.lit(int(round(default * scale)))).alias("lowest"))


def pending_enrichment(titles: DataFrame, floors: DataFrame, events: DataFrame, scale: float = 1.0,
                       limit: int | None = None) -> DataFrame:
    """Titles worth asking about, most voted first; the API id only where it is surely a film's."""
    touched = events.select("item_id").distinct().withColumn("_touched", F.lit(True))
    out = (
        titles.filter(F.col("enriched_at").isNull())
        .withColumn("lowest", enrichment_floor(floors, scale=scale).scalar())
        .join(touched, "item_id", "left")
        .filter(F.col("imdb_votes").isNull() | (F.col("imdb_votes") >= F.col("lowest")) | F.col("_touched"))
        .select("imdb_id", F.when(F.col("movielens_id").isNotNull(), F.col("tmdb_id")).alias("tmdb_id"), "imdb_votes")
        .orderBy(F.desc_nulls_last("imdb_votes"), "imdb_id")
    )
    return out.limit(limit) if limit else out


# --- rebuilds and merges ------------------------------------------------------------


def assign_item_ids(titles: DataFrame) -> DataFrame:
    """Zero-based position by votes; a display id only, the stable id stays the key."""
    return global_index(titles.drop("item_id"), [F.desc_nulls_last("imdb_votes"), F.asc("imdb_id")], "item_id")


def id_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old id to new id through the stable id."""
    return old.filter(F.col("imdb_id").isNotNull()).select(F.col("item_id").alias("old_id"), "imdb_id").join(
        new.select(F.col("item_id").alias("new_id"), "imdb_id"), "imdb_id").select("old_id", "new_id")


def remap_ids(df: DataFrame, mapping: DataFrame, column: str = "item_id") -> DataFrame:
    """Rewrite a table's ids; ``unmapped`` marks rows the caller must refuse."""
    return (
        df.join(mapping.withColumnRenamed("old_id", column), column, "left")
        .withColumn("unmapped", F.col("new_id").isNull() & F.col(column).isNotNull())
        .withColumn(column, F.col("new_id")).drop("new_id")
    )


def remap_id_lists(df: DataFrame, mapping: DataFrame, key: str, column: str) -> DataFrame:
    """Rewrite an array of ids in order; ids without a new one leave the list."""
    pieces = df.select(key, F.posexplode(column).alias("_pos", "old_id")).join(mapping, "old_id")
    lists = pieces.groupBy(key).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_pos", "new_id"))), lambda x: x["new_id"]).alias("_ids"))
    return df.join(lists, key, "left").withColumn(
        column, F.coalesce("_ids", F.array().cast("array<bigint>"))).drop("_ids")


def orphans(events: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Referenced items that the new catalogue lacks."""
    return events.select("item_id").filter(F.col("item_id").isNotNull()).distinct().join(
        id_map(old, new).select(F.col("old_id").alias("item_id")), "item_id", "left_anti")


CARRIED = ("tmdb_id", "overview", "tagline", "language", "popularity", "tmdb_rating", "tmdb_votes",
           "poster_path", "keywords")


def carry_enrichment(new: DataFrame, old: DataFrame) -> DataFrame:
    """After a rebuild: fetched fields by stable id, genres as the union of both."""
    cols = [c for c in CARRIED if c in old.columns and c in new.columns]
    fetched = old.filter(F.col("enriched_at").isNotNull()).select(
        "imdb_id", F.struct(*cols, "genres", "enriched_at", "keywords_at").alias("_o"))
    out = new.join(fetched, "imdb_id", "left")
    hit = F.col("_o").isNotNull()
    return out.withColumns({
        **{c: F.coalesce(F.col(f"_o.{c}"), F.col(c)) for c in cols},
        "genres": F.when(hit, S.distinct_union(F.col("genres"), F.col("_o.genres"))).otherwise(F.col("genres")),
        "enriched_at": F.when(hit, F.col("_o.enriched_at")).otherwise(F.col("enriched_at")),
        "keywords_at": F.when(hit, F.col("_o.keywords_at")).otherwise(F.col("keywords_at")),
    }).drop("_o")


def dedupe_last(batch: DataFrame, key: str, order: str) -> DataFrame:
    """Last row per key; ``max_by`` combines map-side, so a hot key never meets in one window."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def merge_enrichment(titles: DataFrame, batch: DataFrame, now: Column, order: str = "seq") -> DataFrame:
    """Batch upsert: new prose and language win, votes stay, an empty keyword list never overwrites.

    A row with ``answered`` false was a failed call and changes nothing.
    """
    if "answered" in batch.columns:
        batch = batch.filter(F.col("answered"))
    last = dedupe_last(batch, "imdb_id", order)
    cols = [c for c in CARRIED if c in last.columns and c in titles.columns and c != "keywords"]
    out = titles.join(last.select("imdb_id", F.struct(*[c for c in last.columns if c != "imdb_id"]).alias("_b")),
                      "imdb_id", "left")
    hit = F.col("_b").isNotNull()
    return out.withColumns({
        **{c: F.coalesce(F.col(f"_b.{c}"), F.col(c)) for c in cols},
        "keywords": F.when(F.size(F.col("_b.keywords")) > 0, F.col("_b.keywords")).otherwise(F.col("keywords")),
        "keywords_at": F.when(hit & F.col("_b.keywords_fetched"), now).otherwise(F.col("keywords_at")),
        "genres": F.when(hit, S.distinct_union(F.col("genres"), F.col("_b.genres"))).otherwise(F.col("genres")),
        "enriched_at": F.when(hit, now).otherwise(F.col("enriched_at")),
    }).drop("_b")


def merge_keywords(titles: DataFrame, batch: DataFrame, now: Column, order: str = "seq") -> DataFrame:
    """Keyword backfill by item; stamped even when the list is empty."""
    last = dedupe_last(batch, "item_id", order)
    empty = F.array().cast("array<string>")
    return titles.join(last.select("item_id", F.coalesce("keywords", empty).alias("_k")), "item_id", "left").withColumns({
        "keywords": F.coalesce("_k", "keywords"),
        "keywords_at": F.when(F.col("_k").isNotNull(), now).otherwise(F.col("keywords_at")),
    }).drop("_k")


def stamp_existing_keywords(titles: DataFrame, now: Column) -> DataFrame:
    """Keywords stored before the marker existed count as fetched; ``stamped`` tells which."""
    due = F.col("keywords_at").isNull() & (F.coalesce(F.size("keywords"), F.lit(0)) > 0)
    return titles.withColumn("stamped", due).withColumn(
        "keywords_at", F.when(due, now).otherwise(F.col("keywords_at")))


def keyword_targets(titles: DataFrame, top: int) -> DataFrame:
    """Among the ``top`` most voted: those without keywords. Rank first, filter second."""
    return (
        titles.filter(F.col("tmdb_id").isNotNull()).select("item_id", "tmdb_id", "kind", "imdb_votes", "keywords_at")
        .orderBy(F.desc_nulls_last("imdb_votes"), "item_id").limit(top)
        .filter(F.col("keywords_at").isNull()).select("item_id", "tmdb_id", "kind")
    )


def resolve_or_insert(titles: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing id by stable id, then by API id, else a new one above the highest.

    Rows naming the same new title share one id; ``inserted`` marks the row that adds it.
    """
    by_imdb = titles.filter(F.col("imdb_id").isNotNull()).groupBy("imdb_id").agg(F.min("item_id").alias("_i"))
    by_tmdb = titles.filter(F.col("tmdb_id").isNotNull()).groupBy("tmdb_id").agg(F.min("item_id").alias("_t"))
    found = incoming.join(by_imdb, "imdb_id", "left").join(by_tmdb, "tmdb_id", "left").withColumn(
        "_found", F.coalesce("_i", "_t")).drop("_i", "_t")
    key = F.coalesce("imdb_id", F.concat(F.lit("tmdb:"), F.col("tmdb_id").cast("string")), F.concat(F.lit("row:"), "row_id"))
    found = found.withColumn("_key", key)
    fresh = found.filter(F.col("_found").isNull()).groupBy("_key").agg(F.min("row_id").alias("_first"))
    numbered = global_index(fresh, [F.asc("_first"), F.asc("_key")], "_n").withColumnRenamed("_key", "_k")
    top = titles.agg(F.coalesce(F.max("item_id"), F.lit(-1)).alias("_max"))
    out = found.join(numbered, F.col("_found").isNull() & (F.col("_key") == F.col("_k")), "left").withColumn(
        "_max", top.scalar())
    return out.withColumns({
        "item_id": F.coalesce("_found", F.col("_max") + 1 + F.col("_n")),
        "inserted": F.col("_found").isNull() & (F.col("row_id") == F.col("_first")),
        "quality": S.quality_prior(F.col("tmdb_rating"), F.col("tmdb_votes"), weight=400.0),
    }).drop("_found", "_key", "_k", "_n", "_first", "_max")


# --- reports ------------------------------------------------------------------------


def language_histogram(titles: DataFrame, top: int = 25) -> DataFrame:
    return titles.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(top)


def offered_languages(titles: DataFrame, current_year: int, years: int = 6, least: int = 20) -> DataFrame:
    return (
        titles.filter(F.col("poster_path").isNotNull() & (F.col("year") >= current_year - years) & (F.col("language") != "xx"))
        .groupBy("language").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
        .orderBy(F.desc("n"), "language")
    )


def counts(titles: DataFrame, events: DataFrame, impressions: DataFrame) -> DataFrame:
    """One row of totals; each table is aggregated once."""
    def distinct_items(kind):
        return F.count_distinct(F.when(F.col("kind") == kind, F.col("item_id")))

    t = titles.agg(F.count("*").alias("titles"), F.count("enriched_at").alias("enriched"))
    e = events.agg(distinct_items("rate").alias("ratings"), distinct_items("skip").alias("skips"), F.count("*").alias("events"))
    i = impressions.agg(F.count("*").alias("impressions"))
    log = one_row(e)
    return t.withColumns({**{c: log[c] for c in e.columns}, "impressions": i.scalar()})


def column_stats(titles: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population sd per column, NaN and NULL ignored."""
    aggs = []
    for c in columns:
        v = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        aggs += [F.avg(v).alias(f"{c}_mean"), F.stddev_pop(v).alias(f"{c}_sd")]
    return titles.agg(*aggs)


def coverage(catalogue: DataFrame, embedded: DataFrame, fused: DataFrame) -> DataFrame:
    """How much of the catalogue each artefact covers; stale below 0.995."""
    flags = (
        catalogue.select("item_id").distinct()
        .join(embedded.select("item_id").distinct().withColumn("_e", F.lit(1)), "item_id", "left")
        .join(fused.select("item_id").distinct().withColumn("_f", F.lit(1)), "item_id", "left")
    )
    out = flags.agg(F.count("*").alias("catalogue"), F.count("_e").alias("embedded"), F.count("_f").alias("fused"))
    return out.withColumn("stale", F.coalesce(F.try_divide("fused", "catalogue"), F.lit(0.0)) < 0.995)


def integrity_report(titles: DataFrame, events: DataFrame, space: DataFrame) -> DataFrame:
    """One row per check with the number of offending rows."""
    def one(name, df):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")

    def doubled(col):
        return titles.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("c")).filter("c > 1")

    ids = titles.select("item_id")
    return (
        one("event-without-title", events.select("item_id").distinct().join(ids, "item_id", "left_anti"))
        .unionByName(one("duplicate-item-id", doubled("item_id")))
        .unionByName(one("duplicate-stable-id", doubled("imdb_id")))
        .unionByName(one("vector-without-title", space.select("item_id").join(ids, "item_id", "left_anti")))
        .unionByName(one("title-without-vector", ids.join(space.select("item_id"), "item_id", "left_anti")))
        .unionByName(one("missing-stable-id", titles.filter(F.col("imdb_id").isNull())))
    )


# --- pools and feeds ----------------------------------------------------------------


def recognisable_pool(titles: DataFrame, quantile: float = dims.POOL_QUANTILE, least: int = dims.POOL_MIN,
                      min_titles: int = dims.POOL_MIN_TITLES, cap: int | None | str = "by-language", languages=()) -> DataFrame:
    """Titles people plausibly know: per language the top vote quantile, topped up.

    ``cap`` bounds a language's pool: a number, None for no bound, or ``by-language`` for the
    documented sizes of priority and other languages.

    The vote rule is a threshold per language found from a (language, votes) histogram
    that combines map-side; the rank filter below it is cut before its shuffle, so one
    dominant language never lands whole in a task.
    """
    voted = titles.filter(F.col("imdb_votes") > 0).withColumn("language", F.coalesce("language", F.lit("xx")))
    if languages:
        voted = voted.filter(F.col("language").isin(*languages))
    bins = voted.groupBy("language", "imdb_votes").agg(F.count("*").alias("n"))
    rule = bins.groupBy("language").agg(
        F.sum("n").alias("titles"), F.expr(f"percentile(imdb_votes, {quantile}, n)").alias("floor"))
    at_floor = bins.join(rule, "language").filter(F.col("titles") >= min_titles).groupBy("language", "floor").agg(
        F.sum(F.when(F.col("imdb_votes") >= F.col("floor"), F.col("n")).otherwise(0)).alias("above"))
    unbounded = 2**31 - 1
    if cap == "by-language":
        most = dims.POOL_CAP_PRIORITY
        room = F.when(F.col("language").isin(*dims.PRIORITY_LANGUAGES), most).otherwise(dims.POOL_CAP_OTHER)
    else:
        most = unbounded if cap is None else cap
        room = F.lit(most)
    limits = at_floor.withColumn("want", F.least(F.when(F.col("above") < least, F.lit(least)).otherwise(F.col("above")), room))
    ranked = top_per_key(voted, ["language"], [F.desc("imdb_votes"), F.asc("item_id")], most, "_rn")
    return ranked.join(limits.select("language", "want"), "language").filter(F.col("_rn") <= F.col("want")).drop("_rn", "want")


def feed_candidates(titles: DataFrame, events: DataFrame, current_year: int, years: int = 2, min_quality: float = 0.0,
                    kind: str | None = None, exclude_seen: bool = True) -> DataFrame:
    keep = (F.col("year") >= current_year - max(years, 0)) & (F.col("quality") >= min_quality) & F.col("poster_path").isNotNull()
    if kind in ("movie", "tv"):
        keep &= F.col("kind") == kind
    out = titles.filter(keep)
    return exclude_items(out, events) if exclude_seen else out


def allocate_largest_remainder(weights: DataFrame, limit: int) -> DataFrame:
    """Whole slots per language: floors, then one each to the largest remainders.

    ``weights`` is a request's (language, weight, ord) list, so it is one small frame.
    """
    live = weights.filter(F.col("weight") > 0)
    exact = live.withColumn("exact", F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(1))) * limit)
    base = exact.withColumn("base", F.floor("exact").cast("long"))
    ranked = base.withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col("exact") - F.col("base")), "ord")))
    left = F.lit(limit) - F.sum("base").over(Window.partitionBy(F.lit(1)))
    return ranked.withColumn("quota", F.col("base") + F.when(F.col("rn") <= left, 1).otherwise(0)).filter(
        F.col("quota") > 0).select("language", "quota", "ord")


def allocate_rounded(weights: DataFrame, limit: int) -> DataFrame:
    live = weights.filter(F.col("weight") > 0)
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(1)))
    return live.select("language", F.greatest(F.lit(1), F.bround(share * limit).cast("int")).alias("quota"))


def allocate_round_robin(pools: DataFrame, k: int, cap: int) -> DataFrame:
    """k slots dealt one at a time, largest pool first, each language capped."""
    order = pools.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("available"), "language")))
    slots = order.select("language", "ord", F.explode(F.sequence(F.lit(1), F.least(F.lit(cap), "available"))).alias("round"))
    dealt = slots.orderBy("round", "ord").limit(k)
    return dealt.groupBy("language").agg(F.count("*").alias("quota"))


def rotate_window(ranked: DataFrame, page: int) -> DataFrame:
    """From each language's top 3×quota rows: start at page×quota, wrap, take quota.

    ``ranked`` carries ``rn`` (1-based) and ``quota``.
    """
    pool = ranked.filter(F.col("rn") <= 3 * F.col("quota"))
    sizes = pool.groupBy("language").agg(F.max("rn").alias("n"))
    place = F.pmod(F.col("rn") - 1 - F.col("start"), F.col("n"))
    return (
        pool.join(sizes, "language").withColumn("start", F.pmod(F.lit(page) * F.col("quota"), F.col("n")))
        .withColumn("place", place + 1).filter(F.col("place") <= F.col("quota")).drop("start", "n")
    )


def interleave(df: DataFrame, group: str, rank: str) -> DataFrame:
    """Round-robin order: rank within the group, larger groups first, then the group's order."""
    sizes = df.groupBy(group).agg(F.count("*").alias("group_size"))
    return df.join(sizes, group).orderBy(rank, F.desc("group_size"), group)


def feed(titles: DataFrame, events: DataFrame, weights: DataFrame, current_year: int, limit: int = 60, page: int = 0,
         years: int = 2, min_quality: float = 0.0, kind: str | None = None) -> DataFrame:
    """A language-balanced set of titles to rate."""
    quota = allocate_largest_remainder(weights, limit)
    cands = feed_candidates(titles, events, current_year, years, min_quality, kind)
    w = Window.partitionBy("language").orderBy(F.desc("quality"), "item_id")
    ranked = cands.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 3 * limit).join(quota, "language")
    picked = rotate_window(ranked, page)
    sizes = picked.groupBy("language").agg(F.count("*").alias("group_size"))
    return picked.join(sizes, "language").orderBy("place", F.desc("group_size"), "ord").limit(limit)


def external_only(hits: DataFrame, titles: DataFrame) -> DataFrame:
    """External hits whose id the catalogue lacks."""
    known = titles.filter(F.col("tmdb_id").isNotNull()).select("tmdb_id")
    return hits.filter(F.col("tmdb_id").isNotNull()).join(known, "tmdb_id", "left_anti")


def unrated_external(hits: DataFrame, titles: DataFrame, events: DataFrame) -> DataFrame:
    """External hits minus those a user has already rated through the catalogue."""
    rated = events.filter(F.col("kind") == "rate").select("user_id", "item_id").distinct().join(
        titles.filter(F.col("tmdb_id").isNotNull()).select("item_id", "tmdb_id"), "item_id").select("user_id", "tmdb_id")
    return hits.join(rated, ["user_id", "tmdb_id"], "left_anti")
