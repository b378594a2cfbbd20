"""Scalar expressions built from Spark columns only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Bounded, NULL staying NULL (``least`` and ``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def shrink_rating(rating: Column, votes: Column, mean: Column | float, weight: float = 2500.0) -> Column:
    """Rating pulled towards ``mean`` by ``weight`` pseudo-votes; NULL when unrated."""
    mean = mean if isinstance(mean, Column) else F.lit(mean)
    return F.when(votes > 0, (rating * votes + mean * F.lit(weight)) / (votes + F.lit(weight)))


def vote_confidence(votes: Column) -> Column:
    return F.log1p(votes.cast("double")) / F.lit(math.log1p(1_000_000))


def quality_prior(rating: Column, votes: Column, mean: float = 6.4, weight: float = 2500.0) -> Column:
    shrunk = shrink_rating(rating, votes, mean, weight)
    score = clamp(F.lit(0.85) * shrunk / 10.0 + F.lit(0.15) * vote_confidence(votes))
    return F.when(rating.isNull() | votes.isNull() | (votes <= 0), F.lit(mean / 10.0)).otherwise(score)


def derive_kind(title_type: Column) -> Column:
    series = title_type.startswith("tv") & (title_type != "tvMovie")
    return F.when(series, F.lit("tv")).otherwise(F.lit("movie"))


def split_genres(genres: Column) -> Column:
    return F.split(F.coalesce(genres, F.lit("")), ",")


def padded_id(raw: Column) -> Column:
    """``tt`` plus the id padded to seven digits; longer ids stay whole."""
    padded = F.when(F.length(raw) >= 7, raw).otherwise(F.lpad(raw, 7, "0"))
    return F.concat(F.lit("tt"), padded)


def distinct_union(a: Column, b: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


def verdict_to_reward(verdict: Column) -> Column:
    """Word or number to 0..1; an unknown word gives NULL (the caller's error row)."""
    key = F.lower(F.trim(verdict))
    number = key.try_cast("double")
    scaled = clamp(F.when(number > 1, number / 10.0).otherwise(number))
    return F.coalesce(dims.lookup(dims.VERDICTS, key), scaled)


def display_scale(reward: Column) -> Column:
    return clamp(reward * 10.0, 0.0, 10.0)


def display_band(sd: Column) -> Column:
    return F.when(sd.isNull() | F.isnan(sd), F.lit(10.0)).otherwise(
        F.least(F.greatest(sd, F.lit(0.0)) * 10.0, F.lit(10.0))
    )


def rating_reward(rating: Column) -> Column:
    return clamp((rating - 0.5) / 4.5)


def confidence(rating: Column, signal: str = "watched", threshold: float = dims.POSITIVE_THRESHOLD) -> Column:
    if signal == "liked":
        return F.lit(1.0) + 2.0 * (rating - threshold)
    return F.lit(dims.WATCH_CONFIDENCE) + F.lit(dims.LIKE_CONFIDENCE) * rating_reward(rating)


def label_weight(weak: Column, age_days: Column, half_life: float = dims.HALF_LIFE_DAYS) -> Column:
    base = F.when(weak, F.lit(dims.SKIP_WEIGHT)).otherwise(F.lit(1.0))
    decayed = base * F.exp(F.lit(-math.log(2.0)) * age_days / half_life) if half_life > 0 else base
    return F.greatest(decayed, F.lit(1e-3))


def ridge_like_probability(score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-(score - dims.LIKE_AT) * 5.0))


def credible_interval(mean: Column, sd: Column) -> tuple[Column, Column]:
    half = F.lit(1.645) * sd
    return display_scale(mean - half), display_scale(mean + half)


def popularity_bonus(votes: Column) -> Column:
    heat = F.log1p(F.coalesce(votes, F.lit(0)).cast("double")) / math.log1p(500_000)
    return F.lit(0.06) * F.least(F.lit(1.0), heat)


def year_bonus(wanted: Column, year: Column) -> Column:
    both = (F.coalesce(wanted, F.lit(0)) != 0) & (F.coalesce(year, F.lit(0)) != 0)
    return F.when(both, F.when(wanted == year, 0.10).otherwise(0.03)).otherwise(0.0)


def self_information(popularity: Column, total: Column) -> Column:
    return -F.log2((F.coalesce(popularity, F.lit(0)) + 1) / F.greatest(total, F.lit(1)))


def _present(names: Column) -> Column:
    return F.filter(F.coalesce(names, F.array().cast("array<string>")),
                    lambda x: x.isNotNull() & (x != ""))


def _blank_null(text: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(text, F.lit(""))), F.lit(""))


def item_card(overview: int = 900, keywords: int = 18, cast: int = 5, directors: int = 2) -> Column:
    """The prose card of a title, from the catalogue columns. A card is defined by how much of
    each it takes; encoders read cards of one size."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("original_title", F.lit("")), F.lit("Untitled"))
    original = F.col("original_title")
    series = F.when(F.col("kind") == "tv", F.lit("series")).otherwise(F.lit("film"))
    lang = F.nullif(F.nullif(dims.language_label(F.col("language")), F.lit("unknown-language")), F.lit(""))
    bits = F.concat_ws(
        ", ",
        F.nullif(F.col("year"), F.lit(0)).cast("string"),
        F.coalesce(F.concat(lang, F.lit("-language "), series), series),
        F.concat(F.nullif(F.col("runtime"), F.lit(0)).cast("string"), F.lit(" min")),
    )
    head = F.concat(
        title,
        F.when((original != "") & (original != title), F.concat(F.lit(" ("), original, F.lit(")")))
        .otherwise(F.lit("")),
        F.lit(" — "), bits, F.lit("."),
    )

    def listed(names: Column, prefix: str, sep: str) -> Column:
        return F.when(F.size(names) > 0, F.concat(F.lit(prefix), F.array_join(names, sep)))

    credits = F.concat_ws(
        ". ",
        listed(F.slice(_present(F.col("directors")), 1, directors), "Directed by ", " and "),
        listed(F.slice(_present(F.col("cast_names")), 1, cast), "starring ", ", "),
    )
    genres = listed(F.array_distinct(_present(F.col("genres"))), "Genre: ", ", ")
    themes = listed(F.array_distinct(F.slice(_present(F.col("keywords")), 1, keywords)), "Themes: ", ", ")
    tagline = F.regexp_replace(_blank_null(F.col("tagline")), r"\.+$", "")
    dot = F.lit(".")
    return F.concat_ws(
        "\n", head, F.concat(F.nullif(credits, F.lit("")), dot), F.concat(genres, dot),
        F.concat(themes, dot), F.concat(tagline, dot), F.substring(_blank_null(F.col("overview")), 1, overview),
    )


def describing_terms() -> Column:
    """Terms that describe a title, from the catalogue columns."""
    decade = F.floor(F.nullif(F.col("year"), F.lit(0)) / 10).cast("long") * 10
    runtime = F.nullif(F.col("runtime"), F.lit(0))
    keywords = F.slice(F.coalesce(F.col("keywords"), F.array().cast("array<string>")), 1, 20)
    stop = F.array(*[F.lit(s) for s in dims.STOP_TERMS])
    return F.concat(
        F.transform(_present(F.col("genres")), F.lower),
        F.filter(F.transform(_present(keywords), F.lower), lambda k: ~F.array_contains(stop, k)),
        F.transform(
            _present(F.slice(F.coalesce(F.col("directors"), F.array().cast("array<string>")), 1, 2)),
            lambda d: F.concat(F.lit("dir: "), d)),
        F.array_compact(F.array(
            F.concat(F.lit("lang: "), F.nullif(F.col("language"), F.lit(""))),
            F.concat(decade.cast("string"), F.lit("s")),
            F.when(F.col("kind") == "tv", F.lit("series")),
            F.when(runtime >= 150, F.lit("long runtime")).when(runtime <= 95, F.lit("short runtime")),
        )),
    )


def card_key(text: Column, model: str, width: int) -> Column:
    return F.sha1(F.concat(F.lit(f"{model}\x00{width}\x00"), text))


def title_label(title: Column, year: Column) -> Column:
    return F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(title, F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(title)


def match_label(title: Column, original: Column, year: Column, language: Column, kind: Column) -> Column:
    tail = F.concat_ws(
        ", ", F.nullif(year, F.lit(0)).cast("string"), F.nullif(language, F.lit("")),
        F.when(kind == "tv", F.lit("series")),
    )
    return F.concat(
        title,
        F.when((original != "") & (original != title), F.concat(F.lit(" ("), original, F.lit(")"))).otherwise(F.lit("")),
        F.when(tail != "", F.concat(F.lit(" ["), tail, F.lit("]"))).otherwise(F.lit("")),
    )


def split_year(query: Column) -> tuple[Column, Column]:
    """Trailing 19xx/20xx: the title without it, and the year."""
    trimmed = F.trim(query)
    year = F.nullif(F.regexp_extract(trimmed, dims.TRAILING_YEAR, 1), F.lit("")).try_cast("int")
    return F.trim(F.regexp_replace(trimmed, dims.TRAILING_YEAR, "")), year


def strip_edition(title: Column) -> Column:
    """All trailing edition markers, in one pass through a repeated group."""
    return F.trim(F.regexp_replace(title, f"(?i)({dims.EDITION_MARKER})+$", ""))


def hash_order(seed: int | str, *cols: Column) -> Column:
    """The seeded order every draw uses; the same in any engine with md5."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[c.cast("string") for c in cols]))
