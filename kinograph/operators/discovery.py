"""Saying in words what a model has learned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import cut, one_row
from . import taste as K


def term_counts(titles: DataFrame) -> DataFrame:
    """How common each describing term is, over the whole catalogue."""
    return titles.select(F.explode(S.describing_terms()).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def log_odds_terms(poles: DataFrame, background: DataFrame, keys: tuple = ("user_id", "axis"), strength: float = 500.0, top: int = 8) -> DataFrame:
    """Terms that set the ``a`` pole apart from ``b``: weighted log-odds against an informative prior.

    ``poles``: keys, term, a, b (counts). Reversing a and b gives the other pole's terms.
    """
    keys = list(keys)
    whole = one_row(background.agg(F.greatest(F.sum("n"), F.lit(1)).alias("t")))
    sums = poles.groupBy(*keys).agg(F.sum("a").alias("_na"), F.sum("b").alias("_nb"))
    x = poles.join(background.select("term", F.col("n").alias("_bg")), "term").join(sums, keys).withColumn(
        "_p", F.lit(strength) * F.col("_bg") / whole["t"]).filter((F.col("a") + F.col("b") >= 3) & (F.col("_p") > 0))
    ya, yb, p = F.col("a") + F.col("_p"), F.col("b") + F.col("_p"), F.lit(strength)
    delta = F.log(ya / (F.col("_na") + p - ya)) - F.log(yb / (F.col("_nb") + p - yb))
    z = x.withColumn("z", delta / F.sqrt(1.0 / ya + 1.0 / yb))
    w = Window.partitionBy(*keys).orderBy(F.desc("z"), F.desc("term"))
    return z.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(*keys, "term", "z", "rank")


def axis_spread(space: DataFrame) -> DataFrame:
    """Population sd per latent axis."""
    return space.select(F.posexplode("vec").alias("axis", "x")).groupBy("axis").agg(F.stddev_pop(F.col("x").cast("double")).alias("spread"))


def axis_strength(directions: DataFrame, space: DataFrame, top: int = 6) -> DataFrame:
    """Each user's most influential axes: |weight| · spread."""
    j = directions.join(axis_spread(space), "axis").withColumn("strength", F.abs("weight") * F.col("spread"))
    w = Window.partitionBy("user_id").orderBy(F.desc("strength"), "axis")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).drop("spread")


def axis_poles(space: DataFrame, axes: DataFrame, size: int = 400) -> DataFrame:
    """The ``size`` lowest and highest items of each named axis; group limits run before the shuffle."""
    long = space.select("item_id", F.posexplode("vec").alias("axis", "x")).join(axes.select("axis").distinct(), "axis", "left_semi")
    low = Window.partitionBy("axis").orderBy("x", "item_id")
    high = Window.partitionBy("axis").orderBy(F.desc("x"), F.desc("item_id"))
    a = long.withColumn("_r", F.row_number().over(low)).filter(F.col("_r") <= size).select("axis", "item_id", F.lit("low").alias("pole"))
    b = long.withColumn("_r", F.row_number().over(high)).filter(F.col("_r") <= size).select("axis", "item_id", F.lit("high").alias("pole"))
    return a.unionByName(b)


def describe_axes(models: DataFrame, space: DataFrame, titles: DataFrame, n_latent: int, top: int = 6, pole: int = 400,
                  examples: int = 4, terms: int = 8) -> DataFrame:
    """Per user and axis: both poles' terms and best-known examples, liked end first."""
    axes = cut(axis_strength(K.taste_direction(models, n_latent), space, top))
    ends = cut(axis_poles(space, axes, pole).join(titles, "item_id"))
    words = ends.select("axis", "pole", F.explode(S.describing_terms()).alias("term")).groupBy("axis", "term").agg(
        F.count_if(F.col("pole") == "high").alias("high"), F.count_if(F.col("pole") == "low").alias("low"))
    background = cut(term_counts(titles))
    # Poles do not depend on the user: rank both directions once per axis.
    up = log_odds_terms(words.select("axis", "term", F.col("high").alias("a"), F.col("low").alias("b")), background, ("axis",), top=terms).withColumn("pole", F.lit("high"))
    down = log_odds_terms(words.select("axis", "term", F.col("low").alias("a"), F.col("high").alias("b")), background, ("axis",), top=terms).withColumn("pole", F.lit("low"))
    said = up.unionByName(down).groupBy("axis", "pole").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    w = Window.partitionBy("axis", "pole").orderBy(F.desc_nulls_last("imdb_votes"), "item_id")
    shown = ends.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= examples).groupBy("axis", "pole").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", S.title_label(F.col("title"), F.col("year")).alias("t")))), lambda x: x["t"]).alias("examples"))
    both = said.join(shown, ["axis", "pole"], "full")
    liked = F.when(F.col("weight") >= 0, "high").otherwise("low")
    out = axes.withColumn("pole", liked).join(both, ["axis", "pole"], "left").withColumnsRenamed({"terms": "liked_terms", "examples": "liked_examples"})
    flip = F.when(F.col("pole") == "high", "low").otherwise("high")
    return out.withColumn("pole", flip).join(both, ["axis", "pole"], "left").withColumnsRenamed({"terms": "other_terms", "examples": "other_examples"}).drop("pole")


def taste_summary(described: DataFrame) -> DataFrame:
    """One sentence per axis."""
    def listed(c, n):
        text = F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n), ", ")
        return F.when(text == "", F.lit("—")).otherwise(text)

    return described.select("user_id", "rank", F.format_string(
        "axis %3d (influence %.3f): pulls towards [%s] and away from [%s]", F.col("axis"), F.col("strength"), listed("liked_terms", 5), listed("other_terms", 4)).alias("line"))
