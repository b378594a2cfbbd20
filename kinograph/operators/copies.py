"""Which copy of a film to take: label scoring, the decision rule, job state and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as X

_LANGS = r"(?i)\b(" + "|".join(dict.fromkeys(dims.PRIORITY_LANGUAGES.values())) + r")\b"
_YEAR = r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?=[^0-9]|$)"
_MARKS = r"(?i)(?:^|[ ._(\[-])(?:(?:19|20)[0-9]{2}|s[0-9]{1,2}e[0-9]{1,3}|[0-9]{3,4}p|x26[45]|h\.?26[45]|hevc|bluray|web-?dl|webrip|hdtv|dvdrip|hdcam|camrip|cam|telesync)(?:[ ._)\]-]|$).*$"
GB = 1024 ** 3


def named_language(label: Column, wanted: Column) -> Column:
    """Languages a label names; a copy that carries the wanted one is the wanted one."""
    named = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(label, F.lit(_LANGS), F.lit(1)), F.lower)))
    return F.when(F.array_contains(named, F.lower(wanted)), F.lower(wanted)).otherwise(F.array_join(named, ","))


def parse_label(label: Column) -> dict[str, Column]:
    """What a file label claims, as columns."""
    def found(pattern):
        return F.nullif(F.regexp_extract(label, pattern, 1), F.lit(""))

    no_ext = F.regexp_replace(label, r"\.[A-Za-z0-9]{2,4}$", "")
    cut = F.regexp_replace(no_ext, _MARKS, "")
    return {
        "label_title": F.regexp_replace(F.when(cut == "", no_ext).otherwise(cut), r"[._]+", " "),
        "label_year": found(_YEAR).try_cast("int"),
        "label_size": F.lower(found(r"(?i)\b([0-9]{3,4}p)\b")),
        "label_codec": F.upper(found(r"(?i)\b(x26[45]|h\.?26[45]|hevc)\b")),
        "label_ext": F.lower(found(r"\.([A-Za-z0-9]{2,4})$")),
        "label_episode": label.rlike(r"(?i)\bs[0-9]{1,2}e[0-9]{1,3}\b"),
        "label_cam": label.rlike(r"(?i)\b(hd)?cam(rip)?\b|\btelesync\b|\bhdts\b"),
    }


def score_candidates(targets: DataFrame, candidates: DataFrame, wrong: DataFrame | None = None) -> DataFrame:
    """Score of every candidate label for its target; zero with a reason when refused.

    targets(target_id, title, alt_titles, year, language); candidates(target_id,
    candidate_id, source, label, size, ext).
    """
    t = targets.select("target_id", F.col("title").alias("t_title"), F.coalesce("alt_titles", F.array().cast("array<string>")).alias("t_alt"),
                       F.col("year").alias("t_year"), F.col("language").alias("t_language"))
    j = candidates.join(t, "target_id").withColumns(parse_label(F.col("label")))
    ext = F.coalesce(F.nullif(F.lower(F.regexp_replace(F.coalesce("ext", F.lit("")), r"^\.+", "")), F.lit("")), "label_ext")
    j = j.withColumn("ext", ext).withColumn("got", X.normalise_label(F.regexp_replace("label_title", _LANGS, " ")))
    # A target has a handful of names: similarity runs on the exploded names, then the best stays.
    names = t.select("target_id", F.posexplode(F.filter(F.concat(F.array("t_title"), "t_alt"), lambda x: x.isNotNull() & (x != ""))).alias("_i", "_n")).withColumn(
        "_n", X.normalise_label(F.col("_n")))
    main = names.filter("_i = 0").select("target_id", F.col("_n").alias("wanted"))
    sims = (
        j.select("target_id", "got").distinct().join(names, "target_id")
        .withColumn("_s", X.similarity(F.col("got"), F.col("_n"))).groupBy("target_id", "got").agg(F.max("_s").alias("sim"))
    )
    j = j.join(sims, ["target_id", "got"], "left").join(main, "target_id", "left")
    year_off = (F.coalesce("t_year", F.lit(0)) != 0) & F.col("label_year").isNotNull() & (F.abs(F.col("label_year") - F.col("t_year")) > 1)
    why = (
        F.when(F.col("label").rlike(dims.EXTRAS_PATTERN), "sample, trailer or extra")
        .when((F.col("ext") != "") & ~F.col("ext").isin(*dims.VIDEO_EXTS), F.concat(F.lit("not a video ("), "ext", F.lit(")")))
        .when(F.col("label_episode"), "looks like an episode")
        .when(F.coalesce("sim", F.lit(0.0)) < 0.85, F.concat(F.lit("title '"), "got", F.lit("' is not '"), "wanted", F.lit("'")))
        .when(year_off, F.concat(F.lit("year "), F.col("label_year").cast("string"), F.lit(" is not "), F.col("t_year").cast("string")))
    )
    points = (
        F.col("sim") * 10 + F.when((F.coalesce("t_year", F.lit(0)) != 0) & F.col("label_year").isNotNull(), 2.0).otherwise(-1.0)
        + F.coalesce(dims.lookup(dims.RESOLUTION_RANK, F.coalesce("label_size", F.lit(""))), F.lit(1.0))
        + F.when(F.regexp_replace(F.coalesce("label_codec", F.lit("")), r"[XH]\.?265", "HEVC") == "HEVC", 0.5).otherwise(0.0)
        + F.when(F.coalesce("t_language", F.lit("")) == "", 0.0).when(F.contains(F.lower("label"), F.lower("t_language")), 2.0).otherwise(-1.0)
        - F.when(F.col("label_cam"), 5.0).otherwise(0.0)
    )
    out = j.withColumns({
        "why": why, "score": F.when(why.isNull(), points).otherwise(0.0),
        "title": F.when(why.isNull(), F.when(F.col("sim") >= 0.97, F.col("wanted")).otherwise(F.col("got"))),
        "year": F.when(why.isNull(), F.col("label_year")),
        "lang": F.when(why.isNull(), named_language(F.col("label"), F.col("t_language"))),
    })
    if wrong is not None:
        w = wrong.select("target_id", "label").distinct().withColumn("_w", F.lit(True))
        out = out.join(w, ["target_id", "label"], "left").withColumns({
            "score": F.when(F.col("_w"), 0.0).otherwise(F.col("score")),
            "why": F.when(F.col("_w"), "called the wrong file earlier").otherwise(F.col("why"))}).drop("_w")
    return out.select("target_id", "candidate_id", "source", "label", "size", "ext", "score", "why", "title", "year", "lang", "t_year", "t_language")


def _clash(prefix: str = "") -> Column:
    """First thing the copies disagree on; silence agrees. Extremes replace a collected set."""
    def differs(c):
        return F.min(F.nullif(f"{prefix}{c}", F.lit(""))) != F.max(F.nullif(f"{prefix}{c}", F.lit("")))

    year = F.min(F.col(f"{prefix}year")) != F.max(F.col(f"{prefix}year"))
    return F.when(differs("title"), "title").when(year, "year").when(differs("lang"), "language")


def decide(scored: DataFrame, max_gb: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, picks, offers). One row per target in ``decisions``: nothing, paused with
    a reason, or pick. ``picks`` are the copies to try, best first by (score, candidate_id);
    ``offers`` what a pause shows."""
    usable = scored.filter(F.col("score") > 0)
    fits = usable.filter(~((F.coalesce("size", F.lit(0)) != 0) & (F.col("size") > max_gb * GB)))
    best = F.struct(F.col("score"), (-F.col("candidate_id")).alias("_o"))
    details = F.struct("candidate_id", "label", "score", "title", "year", "lang", "size", "t_year", "t_language")
    top = fits.groupBy("target_id").agg(F.max_by(details, best).alias("top"))
    small = usable.groupBy("target_id").agg(F.min_by(details, F.struct(F.coalesce("size", F.lit(0)), "candidate_id")).alias("small"))
    near = fits.join(top, "target_id")
    clash = near.filter(F.col("score") >= F.col("top.score") - dims.CLOSE).groupBy("target_id").agg(_clash().alias("clash"))
    d = (
        scored.select("target_id").distinct().join(small, "target_id", "left").join(top, "target_id", "left").join(clash, "target_id", "left")
    )
    silent = F.when((F.coalesce("top.t_year", F.lit(0)) != 0) & F.col("top.year").isNull(), "silent year").when(
        (F.coalesce("top.t_language", F.lit("")) != "") & (F.col("top.lang") != F.lower("top.t_language")), "silent language")
    reason = (
        F.when(F.col("small").isNull(), "nothing usable").when(F.col("top").isNull(), "over cap")
        .when(F.col("top.score") < dims.AUTO_PICK, "low score").when(silent.isNotNull(), silent)
        .when(F.col("clash").isNotNull(), F.concat(F.lit("disagree on "), "clash"))
    )
    decisions = d.select(
        "target_id", F.when(F.col("small").isNull(), "nothing").when(reason.isNotNull(), "paused").otherwise("pick").alias("outcome"),
        F.coalesce(reason, F.lit("clear")).alias("reason"), F.col("top.label").alias("label"), F.col("top.score").alias("score"),
        F.when(F.col("top").isNull(), F.col("small.candidate_id")).alias("_small"))
    go = decisions.filter(F.col("outcome") == "pick").select("target_id")

    def agrees(c):
        a, b = F.nullif(c, F.lit("")), F.nullif(f"top.{c}", F.lit(""))
        return a.isNull() | b.isNull() | (a == b)

    same_year = F.col("year").isNull() | F.col("top.year").isNull() | (F.col("year") == F.col("top.year"))
    picks = near.join(go, "target_id", "left_semi").filter(agrees("title") & agrees("lang") & same_year).select(
        "target_id", "candidate_id", "label", "score")
    w = Window.partitionBy("target_id").orderBy(F.desc("score"), "candidate_id")
    paused = decisions.filter(F.col("outcome") == "paused").select("target_id", "reason", "_small")
    shown = near.join(paused, "target_id").filter(
        ~F.col("reason").startswith("disagree") | (F.col("score") >= F.col("top.score") - dims.CLOSE)
    ).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= dims.OFFER).select("target_id", "candidate_id", "label", "score", "rank")
    over = usable.join(paused.filter("_small is not null"), "target_id").filter(F.col("candidate_id") == F.col("_small")).select(
        "target_id", "candidate_id", "label", "score", F.lit(1).alias("rank"))
    return decisions.drop("_small"), picks, shown.unionByName(over)


def replay_decisions(scored: DataFrame, judged: DataFrame, max_gb: float) -> DataFrame:
    """Decisions over logged cases against what people said: judged(target_id, label, right)."""
    decisions, _, _ = decide(scored, max_gb)
    said = judged.groupBy("target_id", "label").agg(F.bool_or(~F.col("right")).alias("_wrong"), F.bool_or("right").alias("_right"))
    outcome = (
        F.when(F.col("outcome") != "pick", F.col("outcome")).when(F.col("_wrong"), "wrong").when(F.col("_right"), "right").otherwise("unlabelled")
    )
    return decisions.join(said, ["target_id", "label"], "left").withColumn("outcome", outcome).drop("_wrong", "_right")


def replay_totals(replayed: DataFrame, baseline_wrong: int | None = None) -> DataFrame:
    out = replayed.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("right", "wrong", "paused", "unlabelled", "nothing")])
    return out.withColumn("worse", F.lit(False) if baseline_wrong is None else F.col("wrong") > baseline_wrong)


# --- job state ----------------------------------------------------------------------


def fold_jobs(lines: DataFrame) -> DataFrame:
    """Current state per job from its log lines. Every part is an order-aware aggregate
    (latest by line, or a comparison of latest lines), so long logs combine map-side."""
    line, kind = F.col("line"), F.col("kind")

    def last(value, when):
        return F.max_by(F.when(when, value), F.when(when, line))

    def at(when):
        return F.max(F.when(when, line))

    state, offer, choice, filed, wrong = (kind == k for k in ("state", "offer", "choice", "filed", "wrong"))
    g = lines.groupBy("job_id").agg(
        F.min_by("at", line).alias("created"), F.max_by("at", line).alias("updated"),
        F.min_by(F.col("request"), line).alias("request"),
        F.coalesce(last(F.col("state"), state), F.lit("queued")).alias("state"), last(F.col("reason"), state).alias("reason"),
        last(F.col("folder"), kind == "target").alias("folder"), last(F.col("imdb_id"), kind == "target").alias("imdb_id"),
        last(F.col("item_id"), kind == "target").alias("item_id"), last(F.col("film"), (kind == "target") & F.col("film").isNotNull()).alias("film"),
        last(F.col("candidates"), kind == "plan").alias("candidates"), last(F.col("candidates"), kind == "pick").alias("pick"),
        last(F.col("candidates"), offer).alias("offer"), at(offer).alias("_offer"), at(state & (F.col("state") != "paused")).alias("_moved"),
        last(F.col("candidate"), choice).alias("choice"), at(choice).alias("_choice"),
        last(F.struct("path", "label", "source"), filed).alias("filed"), at(filed).alias("_filed"), at(wrong).alias("_wrong"),
        F.count_if(wrong).alias("wrong"), last(F.col("label"), kind == "confirm").alias("confirmed"),
        F.bool_or(kind == "verdict").alias("verdict"), F.bool_or(offer).alias("asked"),
        F.count_if(kind == "join").alias("joins"), F.count_if(kind == "log").alias("notes"))

    def standing(name, mark, cleared):
        return F.when(F.col(cleared).isNull() | (F.col(mark) > F.col(cleared)), F.col(name))

    return g.withColumns({
        "offer": standing("offer", "_offer", "_moved"), "choice": standing("choice", "_choice", "_filed"), "filed": standing("filed", "_filed", "_wrong"),
    }).drop("_offer", "_moved", "_choice", "_filed", "_wrong")


def job_measures(jobs: DataFrame) -> DataFrame:
    resolved = F.coalesce(F.col("folder"), F.lit("")) != ""
    out = jobs.agg(
        F.count("*").alias("jobs"), (F.count("filed") + F.coalesce(F.sum("wrong"), F.lit(0))).alias("filed"),
        F.coalesce(F.sum("wrong"), F.lit(0)).alias("wrong"), F.count_if(resolved).alias("_asked"),
        F.count_if(resolved & F.col("asked")).alias("_paused"), F.count_if(F.col("state") == "failed").alias("failed"))
    return out.select("jobs", "filed", "wrong", F.try_divide("wrong", F.col("filed")).alias("wrong_rate"),
                      F.try_divide("_paused", F.col("_asked")).alias("pause_rate"), "failed")


def expire_paused(jobs: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """A pause nobody answered within a day is over."""
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.to_timestamp("updated"))
    gone = (F.col("state") == "paused") & (age > hours * 3600)
    return jobs.withColumns({"state": F.when(gone, "cancelled").otherwise(F.col("state")),
                             "reason": F.when(gone, "no choice within a day").otherwise(F.col("reason"))})


def mark_interrupted(builds: DataFrame, as_of: Column, seconds: int = 30) -> DataFrame:
    """Running without a heartbeat reads as interrupted; derived, never written back."""
    beat = F.coalesce("heartbeat_at", "updated_at")
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.to_timestamp(beat))
    dead = (F.col("status") == "running") & (F.coalesce(age, F.lit(seconds + 1)) > seconds)
    return builds.withColumns({"interrupted": dead, "status": F.when(dead, "interrupted").otherwise(F.col("status"))})
