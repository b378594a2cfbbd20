"""The verdict log: current state, labels, reports and attribution, per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims, schemas
from ..functions import scalar as S
from ..session import running_totals

NATURAL_KEY = ("user_id", "item_id", "kind", "value", "source", "ts", "context")


def field(name: str) -> Column:
    return F.get_json_object("context", f"$.{name}")


def newest() -> Column:
    return F.struct("ts", "event_id")


def age_days(as_of: Column) -> Column:
    return F.datediff(as_of, F.col("ts")).cast("double")


# --- writing ------------------------------------------------------------------------


def append_events(incoming: DataFrame, now: Column) -> DataFrame:
    """Rows ready to append: id from the natural key, missing ts stamped with ``now``."""
    stamped = incoming.withColumn("ts", F.coalesce("ts", now)).withColumn("context", F.coalesce("context", F.lit("{}")))
    return stamped.withColumn("event_id", F.xxhash64(*NATURAL_KEY)).select(*schemas.EVENTS.names)


def append_impressions(picks: DataFrame, policy: str, now: Column) -> DataFrame:
    """A produced slate as impression rows."""
    return picks.withColumns({"ts": now, "policy": F.lit(policy)}).withColumn(
        "impression_id", F.xxhash64("slate_id", "item_id", "position")).select(*schemas.IMPRESSIONS.names)


def upsert_meta(writes: DataFrame, order: Column | None = None) -> DataFrame:
    """Current value per key: the last write wins, a NULL value drops the key."""
    last = writes.groupBy("key").agg(F.max_by(F.struct("value"), order if order is not None else F.col("written_at")).alias("_v"))
    return last.select("key", F.col("_v.value").alias("value")).filter(F.col("value").isNotNull())


def get_meta(meta: DataFrame, keys: DataFrame, default: str) -> DataFrame:
    return keys.join(meta, "key", "left").withColumn("value", F.coalesce("value", F.lit(default)))


# --- current state ------------------------------------------------------------------


def latest_rating(events: DataFrame) -> DataFrame:
    """Newest rating per user and item. ``max_by`` combines map-side, so no user is a hot window."""
    return (
        events.filter((F.col("kind") == "rate") & F.col("value").isNotNull())
        .groupBy("user_id", "item_id").agg(F.max_by(F.struct("value", "ts", "context"), newest()).alias("_r"))
        .select("user_id", "item_id", "_r.*")
    )


def active_watchlist(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("kind") == "watchlist").groupBy("user_id", "item_id")
        .agg(F.max_by("context", newest()).alias("context"))
        .filter(F.coalesce(field("active"), F.lit("false")) == "true").select("user_id", "item_id")
    )


def consumed(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind").isin(*dims.CONSUMED_KINDS)).select("user_id", "item_id").distinct()


def excluded(events: DataFrame, watchlist: bool = True) -> DataFrame:
    """What a slate leaves out: consumed items and, by default, the saved ones."""
    gone = consumed(events)
    return gone.union(active_watchlist(events)).distinct() if watchlist else gone


def already_asked(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind").isin(*dims.ASKED_KINDS)).select("user_id", "item_id").distinct()


def library_shelves(events: DataFrame, titles: DataFrame) -> DataFrame:
    """Rated, else watched, else saved: one aggregation decides each item's shelf."""
    saved = F.max_by(F.when(F.col("kind") == "watchlist", field("active")),
                     F.when(F.col("kind") == "watchlist", newest()))
    state = events.filter(F.col("kind").isin("rate", "seen", "watchlist")).groupBy("user_id", "item_id").agg(
        F.bool_or(F.col("kind") == "rate").alias("r"), F.bool_or(F.col("kind") == "seen").alias("w"), saved.alias("s"))
    shelf = F.when(F.col("r"), "rated").when(F.col("w"), "watched").when(F.col("s") == "true", "saved")
    return (
        state.select("user_id", "item_id", shelf.alias("shelf")).filter(F.col("shelf").isNotNull())
        .join(titles.select("item_id", "title"), "item_id")
    )


def forget_items(events: DataFrame, items: DataFrame) -> DataFrame:
    """The log without any event of the given (user, item) pairs."""
    return events.join(items.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")


def clear_source(events: DataFrame, source: str) -> DataFrame:
    return events.filter(~F.col("source").eqNullSafe(F.lit(source)))


def undo_last(events: DataFrame, source: str = "web") -> DataFrame:
    """The log without each user's newest verdict from ``source``."""
    last = events.filter((F.col("source") == source) & F.col("kind").isin("rate", "unseen")).groupBy("user_id").agg(F.max(newest()).alias("_n"))
    # By user and time too: ids are hashes, and one that two rows share must not take the other row along.
    return events.join(last.select("user_id", "_n.ts", "_n.event_id"), ["user_id", "ts", "event_id"], "left_anti").select(events.columns)


# --- labels -------------------------------------------------------------------------


def weak_negatives(events: DataFrame, as_of: Column) -> DataFrame:
    """Pushed away and never rated, with the age of the newest push."""
    pushed = events.filter(F.col("kind").isin("skip", "dismiss"))
    rated = events.filter(F.col("kind") == "rate").select("user_id", "item_id").distinct()
    return pushed.join(rated, ["user_id", "item_id"], "left_anti").groupBy("user_id", "item_id").agg(
        F.min(age_days(as_of)).alias("age"))


def build_labels(events: DataFrame, space: DataFrame, as_of: Column) -> DataFrame:
    """Training labels: latest verdicts and weak negatives on items the space holds."""
    said = latest_rating(events).select(
        "user_id", "item_id", (F.col("value") / 10.0).alias("reward"), age_days(as_of).alias("age"), F.lit(False).alias("weak"))
    pushed = weak_negatives(events, as_of).select(
        "user_id", "item_id", F.lit(dims.SKIP_REWARD).alias("reward"), "age", F.lit(True).alias("weak"))
    return said.unionByName(pushed).join(space.select("item_id"), "item_id", "left_semi")


def label_weights(labels: DataFrame, half_life: float = dims.HALF_LIFE_DAYS) -> DataFrame:
    return labels.withColumn("weight", S.label_weight(F.col("weak"), F.col("age"), half_life))


def liked_titles(labels: DataFrame, titles: DataFrame, min_reward: float = 0.7, limit: int = 60) -> DataFrame:
    """Each user's best-liked titles; Spark limits each group before the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.desc("reward"), "item_id")
    return (
        labels.filter(F.col("reward") >= min_reward).withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= limit)
        .join(titles.select("item_id", "title", "year"), "item_id", "left")
        .select("user_id", "item_id", "reward", "rank",
                F.coalesce(S.title_label(F.col("title"), F.col("year")), F.col("item_id").cast("string")).alias("label"))
    )


def guards(events: DataFrame, impressions_usable: DataFrame | None = None) -> DataFrame:
    """Per user: how much evidence there is and which steps it allows."""
    said = events.filter((F.col("kind") == "rate") & F.col("value").isNotNull()).groupBy("user_id").agg(
        F.count_distinct("item_id").alias("verdicts"))
    out = said if impressions_usable is None else said.join(
        impressions_usable.groupBy("user_id").agg(F.count("*").alias("usable")), "user_id", "left")
    usable = F.coalesce(F.col("usable"), F.lit(0)) if impressions_usable is not None else F.lit(0)
    return out.withColumns({
        "usable": usable.cast("long"), "can_fit": F.col("verdicts") >= 3, "can_audit": F.col("verdicts") >= 8,
        "can_off_policy": usable >= 30,
    })


# --- sequences ----------------------------------------------------------------------


def first_verdict_sequence(events: DataFrame, space: DataFrame) -> DataFrame:
    """Per user, first verdict per item in time order, with ``step`` and the mean of all earlier rewards."""
    first = (
        events.filter((F.col("kind") == "rate") & F.col("value").isNotNull())
        .groupBy("user_id", "item_id").agg(F.min_by(F.struct("value", "ts", "event_id"), newest()).alias("_f"))
        .select("user_id", "item_id", "_f.ts", "_f.event_id", (F.col("_f.value") / 10.0).alias("reward"))
        .join(space.select("item_id"), "item_id", "left_semi")
    )
    seq = running_totals(first, ["user_id"], [F.asc("ts"), F.asc("event_id")], {"_sum": F.col("reward")})
    return seq.select("user_id", "item_id", "ts", "reward", F.col("before").alias("step"),
                      F.try_divide("_sum", "before").alias("earlier_mean"))


def running_mean_control(sequence: DataFrame) -> DataFrame:
    return sequence.filter(F.col("step") > 0).withColumn("control_error", F.abs(F.col("earlier_mean") - F.col("reward")))


def trailing_mean(curve: DataFrame, value: str, window: int, keys: tuple = ("user_id",)) -> DataFrame:
    """Mean of the last ``window`` steps. Each step is dealt to the steps that see it, so
    the averaging is a plain aggregation and a long curve needs no window task."""
    dealt = curve.select(*keys, "step", F.col(value).alias("_v"),
                         F.explode(F.sequence(F.col("step"), F.col("step") + window - 1)).alias("_t"))
    return (
        dealt.groupBy(*keys, F.col("_t").alias("step"))
        .agg(F.avg("_v").alias("smooth"), F.max(F.col("step") == F.col("_t")).alias("_own"))
        .filter("_own").drop("_own")
    )


# --- reports ------------------------------------------------------------------------


def rated_by_language(events: DataFrame, titles: DataFrame, top: int = 12) -> DataFrame:
    n = (
        events.filter(F.col("kind") == "rate").select("user_id", "item_id").distinct()
        .join(titles.select("item_id", "language"), "item_id").groupBy("user_id", "language").agg(F.count("*").alias("n"))
    )
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "language")
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def _latest_per_user(df: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def recent_verdicts(events: DataFrame, titles: DataFrame, limit: int = 8) -> DataFrame:
    rates = events.filter(F.col("kind") == "rate").join(titles.select("item_id"), "item_id", "left_semi")
    return _latest_per_user(rates, limit).join(titles.select("item_id", "title", "year"), "item_id").withColumn("verdict", field("verdict"))


def history(events: DataFrame, titles: DataFrame, limit: int = 30) -> DataFrame:
    known = events.join(titles.select("item_id"), "item_id", "left_semi")
    return _latest_per_user(known, limit).join(titles.select("item_id", "title", "year", "language"), "item_id")


def rated_titles(events: DataFrame, titles: DataFrame, limit: int = 200) -> DataFrame:
    """Latest verdict per title, most recently changed first."""
    last = (
        events.filter(F.col("kind") == "rate").groupBy("user_id", "item_id")
        .agg(F.max_by(F.struct("value", "context", "ts", "event_id"), newest()).alias("_r")).select("user_id", "item_id", "_r.*")
        .join(titles.select("item_id"), "item_id", "left_semi")
    )
    return _latest_per_user(last, limit).join(titles, "item_id").withColumn("verdict", field("verdict"))


def last_slate_item(queries: DataFrame, impressions: DataFrame) -> DataFrame:
    """A bare number is a 1-based position in the user's latest slate; NULL when out of range."""
    last = impressions.groupBy("user_id").agg(
        F.max_by("slate_id", F.struct("ts", "impression_id")).alias("slate_id"))
    shown = impressions.join(last, ["user_id", "slate_id"]).select("user_id", (F.col("position") + 1).alias("_pos"), "item_id")
    text = F.trim(F.col("query"))
    pos = F.when(text.rlike(r"^\d+$"), text.try_cast("int"))
    return queries.withColumn("_pos", pos).join(shown, ["user_id", "_pos"], "left").drop("_pos")


# --- accepting ----------------------------------------------------------------------


def accept_verdicts(incoming: DataFrame, titles: DataFrame, sealed: DataFrame) -> DataFrame:
    """Incoming verdicts as event columns plus ``reason``; NULL reason means accepted."""
    known = titles.select("item_id", F.lit(True).alias("_known"))
    held = sealed.select("user_id", "item_id").distinct().withColumn("_sealed", F.lit(True))
    unseen = F.col("verdict") == "unseen"
    reward = dims.lookup(dims.VERDICTS, F.col("verdict"))
    out = incoming.join(known, "item_id", "left").join(held, ["user_id", "item_id"], "left")
    context = F.to_json(F.struct(
        F.nullif("slate_id", F.lit("")).alias("slate_id"),
        F.when(F.col("slate_id") != "", F.col("position")).alias("position"), F.col("verdict")))
    return out.withColumns({
        "reason": F.when(F.col("_known").isNull(), "unknown title").when(F.col("_sealed"), "sealed case")
        .when(~unseen & reward.isNull(), "unknown verdict"),
        "kind": F.when(unseen, "unseen").otherwise("rate"),
        "value": F.when(~unseen, reward * 10.0),
        "source": F.lit("web"),
        "context": F.when(unseen, F.lit('{"answer":"unseen"}')).otherwise(context),
    }).drop("_known", "_sealed")


def library_actions(actions: DataFrame, titles: DataFrame) -> DataFrame:
    """save / remove / watched as events; watched also leaves the watchlist."""
    def event(kind, context):
        return F.struct(F.lit(kind).alias("kind"), F.lit(context).alias("context"))

    off = event("watchlist", '{"active":false}')
    rows = (
        F.when(F.col("action") == "save", F.array(event("watchlist", '{"active":true}')))
        .when(F.col("action") == "remove", F.array(off))
        .when(F.col("action") == "watched", F.array(event("seen", '{"from":"library"}'), off))
    )
    return actions.join(titles.select("item_id"), "item_id", "left_semi").withColumn("_e", F.explode(rows)).withColumns({
        "kind": F.col("_e.kind"), "context": F.col("_e.context"), "source": F.lit("web"), "value": F.lit(None).cast("double"),
    }).drop("_e")


def request_events(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """One request event per job with a catalogued item, never written twice. Requests for
    an item while one is open count as the oldest open one."""
    logged = events.filter(F.col("kind") == "request").select(field("job").alias("job_id")).filter("job_id is not null").distinct()
    slot = F.when(F.col("open"), F.lit("open")).otherwise(F.col("job_id"))
    return (
        jobs.filter(F.col("item_id").isNotNull()).groupBy("user_id", "item_id", slot.alias("_slot"))
        .agg(F.min_by(F.struct("job_id", "ts"), F.struct("ts", "job_id")).alias("_j")).select("user_id", "item_id", "_j.*")
        .join(logged, "job_id", "left_anti")
        .withColumns({"kind": F.lit("request"), "value": F.lit(None).cast("double"), "source": F.lit("agent"),
                      "context": F.to_json(F.struct(F.col("job_id").alias("job")))})
    )


# --- attribution --------------------------------------------------------------------


def _verdicts(events: DataFrame) -> DataFrame:
    return events.filter((F.col("kind") == "rate")).select(
        "user_id", "item_id", F.col("ts").alias("verdict_ts"), "value", field("slate_id").alias("_slate"))


def attribute_exact(impressions: DataFrame, events: DataFrame) -> DataFrame:
    """Impressions joined to the verdicts stamped with their slate."""
    v = _verdicts(events).filter(F.col("_slate").isNotNull() & F.col("value").isNotNull()).withColumnRenamed("_slate", "slate_id")
    return impressions.join(v, ["user_id", "item_id", "slate_id"]).select(
        "user_id", "item_id", "slate_id", "impression_id", "propensity", (F.col("value") / 10.0).alias("reward"))


def attribute_temporal(impressions: DataFrame, events: DataFrame, last_touch: bool = False) -> DataFrame:
    """Unstamped verdicts credited to earlier impressions of the item, for slates no
    stamped verdict claims. ``last_touch`` keeps only the latest impression per verdict."""
    v = _verdicts(events)
    claimed = impressions.join(
        v.filter(F.col("_slate").isNotNull()).withColumnRenamed("_slate", "slate_id"),
        ["user_id", "item_id", "slate_id"], "left_semi").select("slate_id").distinct()
    loose = v.filter(F.col("_slate").isNull() & F.col("value").isNotNull()).drop("_slate")
    rows = impressions.join(claimed, "slate_id", "left_anti").join(loose, ["user_id", "item_id"]).filter(
        F.col("verdict_ts") >= F.col("ts"))
    if last_touch:
        rows = rows.groupBy("user_id", "item_id", "verdict_ts", "value").agg(
            F.max_by(F.struct("slate_id", "impression_id", "propensity"), F.struct("ts", "impression_id")).alias("_i")
        ).select("user_id", "item_id", "value", "_i.*")
    return rows.select("user_id", "item_id", "slate_id", "impression_id", "propensity", (F.col("value") / 10.0).alias("reward"))


def usable_impressions(impressions: DataFrame, events: DataFrame, last_touch: bool = False) -> DataFrame:
    """What an off-policy estimate may use: both attributions, positive propensity."""
    return attribute_exact(impressions, events).unionByName(
        attribute_temporal(impressions, events, last_touch)).filter(F.col("propensity") > 0)


# --- transfer -----------------------------------------------------------------------


def export_rows(events: DataFrame, titles: DataFrame, strict: bool = True) -> DataFrame:
    """Events keyed on the stable id; with ``strict`` events of missing titles stay, with a NULL id."""
    return events.join(titles.select("item_id", "imdb_id", "title", "year"), "item_id", "left" if strict else "inner").select(
        "user_id", "imdb_id", "title", F.col("year").cast("long").alias("year"), "kind", "value", "source",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "context")


def import_outcomes(lines: DataFrame, titles: DataFrame, events: DataFrame) -> DataFrame:
    """Each exported line as an event with its outcome: imported, duplicate or missing."""
    ids = titles.filter(F.col("imdb_id").isNotNull()).select("imdb_id", "item_id")
    rows = lines.join(ids, "imdb_id", "left").withColumns({
        "ts": F.col("ts").cast("timestamp_ntz"), "context": F.coalesce("context", F.lit("{}")),
        "source": F.coalesce("source", F.lit("import"))})
    missing = rows.filter(F.col("item_id").isNull()).withColumn("outcome", F.lit("missing"))
    found = rows.filter(F.col("item_id").isNotNull())
    # NULL-safe grouping of the whole natural key counts repeats inside the batch once.
    once = found.groupBy(*NATURAL_KEY).agg(F.count("*").alias("copies"))
    have = events.select(*NATURAL_KEY).distinct().withColumn("_have", F.lit(True)).alias("h")
    o = once.alias("o")
    cond = F.lit(True)
    for c in NATURAL_KEY:
        cond = cond & F.col(f"o.{c}").eqNullSafe(F.col(f"h.{c}"))
    marked = o.join(have, cond, "left").select("o.*", F.coalesce("_have", F.lit(False)).alias("_have"))
    # Every copy after the first, and every copy of a row the log holds, is a duplicate.
    split = marked.select(*NATURAL_KEY, F.explode(F.array(
        F.struct(F.lit("imported").alias("outcome"), F.when(F.col("_have"), 0).otherwise(1).alias("n")),
        F.struct(F.lit("duplicate").alias("outcome"), (F.col("copies") - F.when(F.col("_have"), 0).otherwise(1)).alias("n")),
    )).alias("_x")).select(*NATURAL_KEY, "_x.*").filter("n > 0")
    gone = missing.groupBy(*NATURAL_KEY, "outcome").agg(F.count("*").alias("n")).select(*NATURAL_KEY, "outcome", "n")
    return split.unionByName(gone)


def import_events(lines: DataFrame, titles: DataFrame, events: DataFrame) -> DataFrame:
    """The rows to append; running it again yields none."""
    return import_outcomes(lines, titles, events).filter(F.col("outcome") == "imported").drop("outcome", "n")


def import_counts(lines: DataFrame, titles: DataFrame, events: DataFrame) -> DataFrame:
    return import_outcomes(lines, titles, events).groupBy("outcome").agg(F.sum("n").alias("n"))


def export_totals(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("lines"), F.count_if(F.col("imdb_id").isNull()).alias("without_title"))
