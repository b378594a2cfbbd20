"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import copies, events as E, itemspace
from ..session import scratch


def file_stream(spark: SparkSession, path: str, schema: T.StructType, per_batch: int = 1, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def _existing(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def run_batches(stream: DataFrame, sink, checkpoint: str, mode: str = "append"):
    """Process everything available through ``sink(batch, id)`` and stop."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(sink).start()
    )
    query.awaitTermination()
    return query


def _unseen(rows: DataFrame, have: DataFrame) -> DataFrame:
    """The rows whose natural key ``have`` lacks; nulls match nulls."""
    a, b = rows.alias("a"), have.select(*E.NATURAL_KEY).alias("b")
    same = F.lit(True)
    for c in E.NATURAL_KEY:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same, "left_anti")


def event_sink(log: str, late: str, schema: T.StructType, delay_days: int):
    """A batch function that adds new events once.

    Rows older than the newest day of earlier batches minus the delay go to the side table. The rest
    are checked against the log days at or after that mark only, which partition pruning keeps
    small; the newest day itself is kept beside the log, one row a batch, so no batch reads the log for
    it. Both tables are written by batch in overwrite mode and checked against other batches alone, so a
    retried batch replaces its own first attempt and a repeat adds nothing to either.
    """
    stored = T.StructType([*schema.fields, T.StructField("day", T.DateType()), T.StructField("batch", T.LongType())])
    aside = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    marks = T.StructType([T.StructField("newest", T.DateType()), T.StructField("batch", T.LongType())])

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = _existing(spark, f"{log}-marks", marks).filter(F.col("batch") < batch_id).agg(F.max("newest").alias("d")).head()["d"]
        rows = batch.dropDuplicates([c for c in E.NATURAL_KEY]).withColumn("day", F.to_date("ts"))
        have = _existing(spark, log, stored).filter(F.col("batch") != batch_id)
        fresh, seen = rows, have
        if newest is not None:
            mark = F.lit(newest - dt.timedelta(days=delay_days))
            fresh, seen = rows.filter(F.col("day") >= mark), have.filter(F.col("day") >= mark)
            kept_aside = _existing(spark, late, aside).filter(F.col("batch") != batch_id)
            _unseen(rows.filter(F.col("day") < mark).drop("day"), kept_aside).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        _unseen(fresh, seen).write.mode("overwrite").partitionBy("day").parquet(f"{log}/batch={batch_id}")
        rows.agg(F.greatest(F.max("day"), F.lit(newest)).alias("newest")).filter("newest is not null").write.mode("overwrite").parquet(f"{log}-marks/batch={batch_id}")
    return sink


def stream_events_within(stream: DataFrame, log: str, checkpoint: str, delay: str = "30 days"):
    """Ingest events into the log, each natural key once among those less than ``delay`` apart, from the
    state store alone: keys leave it as the watermark passes them, and the log is never read. Rows
    older than the watermark are dropped."""
    once = stream.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", delay).dropDuplicatesWithinWatermark(list(E.NATURAL_KEY)).drop("_at")
    return run_batches(once, _changes(log), checkpoint)


def stream_events(stream: DataFrame, log: str, late: str, checkpoint: str, delay_days: int = 30):
    """Ingest events into the log, each natural key once."""
    return run_batches(stream, event_sink(log, late, stream.schema, delay_days), checkpoint)


#: Batches of a change log after which it is folded into one table of current rows.
COMPACT_EVERY = 20


def _current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest change per key: of the newest fold, and of the batches after it."""
    log = spark.read.parquet(path)
    upto = log.filter("fold = 1").agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("b")).scalar()
    live = log.filter(((F.col("fold") == 1) & (F.col("batch") == upto)) | ((F.col("fold") == 0) & (F.col("batch") > upto)))
    rest = [c for c in log.columns if c not in (*keys, "batch", "fold")]
    return live.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def _changes(path: str, keys: list[str] | None = None, every: int = COMPACT_EVERY):
    def sink(batch: DataFrame, batch_id: int) -> None:
        # Overwriting the batch's own folder makes a retry harmless.
        if keys is None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            return
        batch.write.mode("overwrite").parquet(f"{path}/fold=0/batch={batch_id}")
        if (batch_id + 1) % every == 0:
            _current(batch.sparkSession, path, keys).write.mode("overwrite").parquet(f"{path}/fold=1/batch={batch_id}")
    return sink


def keep_current(stream: DataFrame, path: str, checkpoint: str, keys: list[str], every: int = COMPACT_EVERY) -> DataFrame:
    """Run an update-mode aggregate and return its current rows. Every ``every`` batches the
    change log is folded, so a read takes one fold and fewer than that many batches."""
    run_batches(stream, _changes(path, keys, every), checkpoint, "update")
    return _current(stream.sparkSession, path, keys)


def stream_latest_verdict(events: DataFrame) -> DataFrame:
    """One state row per (user, item), never expired; an older row cannot overwrite a newer."""
    return events.filter((F.col("kind") == "rate") & F.col("value").isNotNull()).groupBy("user_id", "item_id").agg(
        F.max_by("value", E.newest()).alias("value"), F.max("ts").alias("ts"))


def stream_watchlist(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind") == "watchlist").groupBy("user_id", "item_id").agg(
        (F.max_by(F.coalesce(E.field("active"), F.lit("false")), E.newest()) == "true").alias("active"))


def stream_attribution(impressions: DataFrame, events: DataFrame, interval: str = "30 days", delay: str = "30 days") -> DataFrame:
    """Impressions joined to verdicts that follow within ``interval``; both sides' state is bounded by it."""
    i = impressions.withColumn("its", F.col("ts").cast("timestamp")).withWatermark("its", delay).select(
        F.col("user_id").alias("iu"), F.col("item_id").alias("ii"), "slate_id", "impression_id", "propensity", "its")
    v = events.filter((F.col("kind") == "rate") & F.col("value").isNotNull()).withColumn("vts", F.col("ts").cast("timestamp")).withWatermark("vts", delay).select(
        F.col("user_id").alias("vu"), F.col("item_id").alias("vi"), E.field("slate_id").alias("stamp"), (F.col("value") / 10.0).alias("reward"), "vts")
    span = F.expr(f"vts BETWEEN its AND its + INTERVAL {interval}")
    return i.join(v, (F.col("iu") == F.col("vu")) & (F.col("ii") == F.col("vi")) & span & (F.col("stamp").isNull() | (F.col("stamp") == F.col("slate_id")))).select(
        F.col("iu").alias("user_id"), F.col("ii").alias("item_id"), "slate_id", "impression_id", "propensity", "reward", F.col("stamp").isNotNull().alias("stamped"))


def settle_attribution(joined: DataFrame) -> DataFrame:
    """Of the streamed pairs: unstamped ones count only for slates no stamped verdict claims."""
    claimed = joined.filter("stamped").select("slate_id").distinct()
    loose = joined.filter("not stamped").join(claimed, "slate_id", "left_anti").select(*joined.columns)
    return joined.filter("stamped").unionByName(loose).filter(F.col("propensity") > 0)


def stream_job_state(lines: DataFrame) -> DataFrame:
    """Current job state from its lines; the batch fold is made of mergeable aggregates."""
    return copies.fold_jobs(lines)


def new_item_sink(space: str, schema: T.StructType, encoder, art):
    def sink(batch: DataFrame, batch_id: int) -> None:
        # A retried batch must not see its own first attempt.
        have = _existing(batch.sparkSession, space, T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())]))
        have = have.filter(F.col("batch") < batch_id)
        itemspace.place_new_items(batch, have, encoder, art).write.mode("overwrite").parquet(f"{space}/batch={batch_id}")
    return sink


def stream_new_items(stream: DataFrame, space: str, checkpoint: str, encoder, art, schema: T.StructType):
    """New catalogue rows to vectors: card, cache-free encode, project, append."""
    return run_batches(stream, new_item_sink(space, schema, encoder, art), checkpoint)


def stream_event_counts(events: DataFrame, width: str = "1 day", delay: str = "30 days") -> DataFrame:
    """Tumbling counts per kind and source."""
    t = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return t.groupBy(F.window("at", width).alias("w"), "kind", "source").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), "kind", "source", "n")


def land_stream(df: DataFrame, name: str, files: int = 4) -> str:
    """A frame as a folder of files for a stream to pick up."""
    path = scratch(df.sparkSession, name)
    df.repartition(files).write.parquet(path)
    return path


def land_in_order(df: DataFrame, name: str, by: str, files: int = 4) -> str:
    """As ``land_stream``, in slices of the number ``by`` (SQL), the least first, so that a stream meets them in order."""
    path = scratch(df.sparkSession, name)
    cuts = df.selectExpr(f"percentile_approx({by}, array({', '.join(str(k / files) for k in range(1, files))})) AS c").first()["c"] or []
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges, edges[1:]):
        part = df if low is None else df.filter(F.expr(by) > F.lit(low))
        (part if high is None else part.filter(F.expr(by) <= F.lit(high))).repartition(1).write.mode("append").parquet(path)
    return path
