"""Models as they were at any moment, from moments that labels enter and leave.

A label lives from the event that states it to the event that replaces it. Its birth adds to its
user's moments of [1, x, y] and its death takes them out again, so a model at any moment is a sum over
the changes before it; nothing is fitted twice. Weights fade by half-lives: all fading labels of a user share
one factor, so they are summed at the weight of a fixed day and scaled when asked. A label that has
faded to the least weight leaves the fading sum and enters a fixed one.

Sums up to a moment are taken in levels: changes fold into segments, segments into groups of ``FAN``,
groups into larger ones, and only what stands earlier in the same group is added at each level. No task walks all
of a user's past.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions import kernels as N
from ..session import bounded_batches, cut, running_totals
from . import blocks as B
from . import taste as K

SEGMENT, FAN = 64, 64
LEAST_WEIGHT = 1e-3
#: The day at whose weight fading labels are summed.
_DAY_ZERO = "2000-01-01"


def label_lives(events: DataFrame, space: DataFrame) -> DataFrame:
    """Labels with the time they hold: user_id, item_id, starts, ends (null: still), reward, weak.

    A stated verdict holds until the next one on the item; a skip or dismissal until the next one, or
    until the item is first rated. Events of one moment go by event id, so all but the last of them hold for
    no time. Rows without a time are left out.
    """
    said = events.filter((F.col("kind") == "rate") & F.col("ts").isNotNull())
    pair = Window.partitionBy("user_id", "item_id").orderBy("ts", "event_id")
    stated = said.filter(F.col("value").isNotNull()).select(
        "user_id", "item_id", F.col("ts").alias("starts"), F.lead("ts").over(pair).alias("ends"), (F.col("value") / 10.0).alias("reward"), F.lit(False).alias("weak"))
    first = said.groupBy("user_id", "item_id").agg(F.min("ts").alias("_first"))
    pushed = events.filter(F.col("kind").isin("skip", "dismiss") & F.col("ts").isNotNull()).select(
        "user_id", "item_id", F.col("ts").alias("starts"), F.lead("ts").over(pair).alias("_next"))
    pushed = pushed.join(first, ["user_id", "item_id"], "left").select(
        "user_id", "item_id", "starts", F.least("_next", "_first").alias("ends"), F.lit(dims.SKIP_REWARD).alias("reward"), F.lit(True).alias("weak"))
    lives = stated.unionByName(pushed).filter(F.col("ends").isNull() | (F.col("ends") > F.col("starts")))
    return lives.join(space.select("item_id"), "item_id", "left_semi")


def label_changes(lives: DataFrame, negatives: DataFrame | None = None, half_life: float = dims.HALF_LIFE_DAYS) -> DataFrame:
    """What each birth and death changes: user_id, item_id, ts, fades, w, y, cnt, verdicts, labels.

    ``negatives`` are the items every user's model counts as weakly disliked; a user who labels one
    takes it out for as long as the label holds. ``half_life`` 0 keeps all weights.
    """
    base = F.when(F.col("weak"), dims.SKIP_WEIGHT).otherwise(1.0)
    said = F.when(F.col("weak"), 0.0).otherwise(1.0)

    def change(ts: Column, fades: bool, w: Column, sign: float) -> Column:
        return F.struct(ts.cast("timestamp_ntz").alias("ts"), F.lit(fades).alias("fades"), w.alias("w"), F.col("reward").alias("y"),
                        F.lit(sign).alias("cnt"), (said * sign).alias("verdicts"), F.lit(sign).alias("labels"))

    starts, ends = F.col("starts"), F.col("ends")
    if half_life > 0:
        day = F.datediff(F.to_date("starts"), F.lit(_DAY_ZERO).cast("date"))
        grown = base * F.exp(F.lit(math.log(2.0) / half_life) * day)
        # The first day on which the label would weigh less than the least; it changes as that day begins.
        left = F.floor(F.lit(half_life / math.log(2.0)) * F.log(base / LEAST_WEIGHT)).cast("int") + 1
        floors = F.to_timestamp_ntz(F.date_add(F.to_date("starts"), left).cast("string"), F.lit("yyyy-MM-dd")) - F.expr("INTERVAL '0.000001' SECOND")
        floored = ends.isNull() | (floors < ends)
        least = F.lit(LEAST_WEIGHT)
        still = lambda s, sign: s.withField("cnt", F.lit(0.0)).withField("verdicts", F.lit(0.0)).withField("labels", F.lit(0.0))
        changes = F.array(
            change(starts, True, grown, 1.0),
            F.when(floored, still(change(floors, True, -grown, 1.0), 1)), F.when(floored, still(change(floors, False, least, 1.0), 1)),
            F.when(ends.isNotNull() & ~floored, change(ends, True, -grown, -1.0)), F.when(ends.isNotNull() & floored, change(ends, False, -least, -1.0)))
    else:
        changes = F.array(change(starts, False, base, 1.0), F.when(ends.isNotNull(), change(ends, False, -base, -1.0)))
    out = lives.select("user_id", "item_id", F.explode(F.array_compact(changes)).alias("c")).select("user_id", "item_id", "c.*")
    if negatives is None:
        return out
    known = lives.join(negatives.select("item_id").distinct(), "item_id", "left_semi")
    back = lambda ts, sign: F.struct(ts.cast("timestamp_ntz").alias("ts"), F.lit(sign * dims.NEGATIVE_WEIGHT).alias("w"), F.lit(sign).alias("cnt"))
    taken = known.select("user_id", "item_id", F.explode(F.array_compact(F.array(back(starts, -1.0), F.when(ends.isNotNull(), back(ends, 1.0))))).alias("c"))
    return out.unionByName(taken.select(
        "user_id", "item_id", "c.ts", F.lit(False).alias("fades"), "c.w", F.lit(dims.NEGATIVE_REWARD).alias("y"), "c.cnt",
        F.lit(0.0).alias("verdicts"), F.lit(0.0).alias("labels")))


def earlier_sums(parts: DataFrame, keys: list[str], fan: int | None = None) -> DataFrame:
    """(keys, level, g, packed): at each level the sum of what stands earlier in the same group of
    ``fan``. What stands before place s is the sum over levels of the rows with g = s // fan^level.

    ``parts`` has keys, g and packed (null: nothing); a place that is asked for must have a row. A task holds one
    sum at a time.
    """
    fan = fan or FAN
    fields = [parts.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("g", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("packed", T.ArrayType(T.DoubleType()))])

    bounded_batches(parts.sparkSession)

    def sums(batches):
        at, total = None, None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                *key, g, packed = row
                if (group := (*key, g // fan)) != at:
                    if at is not None:
                        yield (*at, True, total)
                    at, total = group, None
                yield (*key, g, False, total)
                if packed is not None and len(packed):
                    total = np.asarray(packed) if total is None else total + np.asarray(packed)
        if at is not None:
            yield (*at, True, total)

    def walk(batches):
        return B.in_batches(sums(batches), schema.names)

    now, found, level = parts.select(*keys, F.col("g").cast("long"), "packed"), None, 0
    while True:
        group = F.floor(F.col("g") / fan).alias("_group")
        dealt = now.select("*", group)
        done = cut(B.spread(dealt, *keys, "_group").sortWithinPartitions(*keys, "g").drop("_group").mapInPandas(walk, schema))
        own = done.filter("not whole").select(*keys, F.lit(level).alias("level"), "g", "packed")
        found = own if found is None else found.unionByName(own)
        now = done.filter("whole").select(*keys, "g", "packed")
        if not (now.agg(F.max("g")).first()[0] or 0):
            return found
        level += 1


def predict_as_of(changes: DataFrame, asked: DataFrame, features: DataFrame, negatives: DataFrame | None = None, penalty: float | None = dims.PENALTY,
                  half_life: float = dims.HALF_LIFE_DAYS, least: int = 3) -> DataFrame:
    """Each of ``asked`` (user_id, ask_id, item_id, ts) with the mean and sd that the model of all
    earlier changes gives: user_id, ask_id, mean, sd, verdicts. Changes of the asked moment itself
    are not known yet. Rows whose user had fewer than ``least`` verdicts, or whose item has no features, are
    left out. Other columns are not read."""
    shared, extra = None, 0.0
    if negatives is not None:
        block, extra = B.one_moment(K._negative_rows(negatives, features))
        shared = block if len(block) else None
    kind = asked.schema["ask_id"].dataType
    none = {c: F.lit(None).cast("double") for c in ("w", "y")}
    zero = {c: F.lit(0.0) for c in ("cnt", "verdicts", "labels")}
    known = features.select("item_id", "vec")
    rows = changes.select("user_id", "item_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(None).cast(kind).alias("ask_id"), "fades", "w", "y", "cnt", "verdicts", "labels").unionByName(
        asked.select("user_id", "item_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "ask_id").withColumns(
            {"fades": F.lit(None).cast("boolean"), **none, **zero})).join(known.select("item_id"), "item_id", "left_semi")
    is_change = F.col("w").isNotNull()
    placed = running_totals(rows.withColumn("_change", is_change.cast("int")), ["user_id"],
                            [F.asc("ts"), F.asc("_change"), F.asc("ask_id"), F.asc("item_id"), F.asc("fades"), F.asc("w"), F.asc("y")],
                            {"_passed": F.col("_change"), "_n": F.col("cnt"), "_verdicts": F.col("verdicts")})
    placed = cut(placed.withColumn("seg", F.floor(F.col("_passed") / SEGMENT).cast("long")).select(
        "user_id", "item_id", "ts", "fades", "w", "y", "cnt", "seg", F.col("before").alias("place"), F.col("_n").alias("n"),
        # Never null: pandas would turn 64-bit ids beside nulls into floats.
        F.coalesce("ask_id", F.lit(0).cast(kind)).alias("ask_id"),
        F.col("_verdicts").cast("long").alias("verdicts")))
    moved = placed.filter("w is not null")
    parts = B.moments(moved.join(known, "item_id").select("user_id", "fades", "seg", "w", "y", "cnt", "vec"), ["user_id", "fades", "seg"])
    # A place needs a row for both sums, also where none of its own changes adds to them.
    places = placed.select("user_id", "seg").distinct().withColumn("fades", F.explode(F.array(F.lit(True), F.lit(False))))
    parts = places.join(parts.select("user_id", "fades", "seg", "packed"), ["user_id", "fades", "seg"], "left").withColumnRenamed("seg", "g")
    before = cut(earlier_sums(parts, ["user_id", "fades"]))
    live = placed.filter("w is null").select("user_id", "seg").distinct()
    starts = None
    for (level,) in sorted(before.select("level").distinct().collect()):
        rows_of = before.filter((F.col("level") == level) & F.col("packed").isNotNull()).drop("level")
        some = live.withColumn("g", F.floor(F.col("seg") / FAN**level).cast("long")).join(rows_of, ["user_id", "g"]).select("user_id", "seg", "fades", "packed")
        starts = some if starts is None else starts.unionByName(some)
    schema = T.StructType([asked.schema["user_id"], T.StructField("ask_id", kind), T.StructField("mean", T.DoubleType()), T.StructField("sd", T.DoubleType()),
                           T.StructField("verdicts", T.LongType())])
    rate = math.log(2.0) / half_life if half_life > 0 else 0.0
    origin = np.datetime64(_DAY_ZERO)

    def run(rp, sp):
        if rp.empty or not rp["w"].isna().any():
            return pd.DataFrame([], columns=schema.names)
        rp = rp.sort_values("place", ignore_index=True)
        aug = N.augmented(B._stack(rp["vec"]), rp["y"].fillna(0.0).to_numpy(float))
        sums = {True: np.zeros((aug.shape[1],) * 2), False: np.zeros((aug.shape[1],) * 2)}
        for fades, packed in zip(sp["fades"], sp["packed"]):
            sums[bool(fades)] += N.unpack(np.asarray(packed), aug.shape[1])
        day = (rp["ts"].to_numpy().astype("datetime64[D]") - origin).astype(float)
        out, model, known_at = [], None, None
        changed = 0
        for a, w, fades, ask, n, verdicts, d in zip(aug, rp["w"], rp["fades"], rp["ask_id"], rp["n"], rp["verdicts"], day):
            if w == w:  # a change
                sums[bool(fades)] += w * np.outer(a, a)
                changed += 1
                continue
            if verdicts < least:
                continue
            if known_at != (changed, d):
                moment = sums[True] * math.exp(-rate * d) + sums[False]
                model, known_at = N.posterior(moment if shared is None else moment + shared, n + extra, penalty), (changed, d)
            mean, cov, _, beta, _, y_mean = model
            phi = a[:-1]
            out.append((rp["user_id"].iloc[0], ask, float(phi @ mean + y_mean), float(np.sqrt(max(phi @ cov @ phi + 1.0 / beta, 1e-12))), int(verdicts)))
        return pd.DataFrame(out, columns=schema.names)

    whole = placed.join(live, ["user_id", "seg"], "left_semi").join(known, "item_id")
    left, right = B.spread(whole.toDF(*whole.columns), "user_id", "seg"), B.spread(starts.toDF(*starts.columns), "user_id", "seg")
    return left.groupBy("user_id", "seg").cogroup(right.groupBy("user_id", "seg")).applyInPandas(run, schema)
