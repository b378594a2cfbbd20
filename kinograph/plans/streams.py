"""Streaming queries: the given tables land as several files and are streamed to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import itemspace as I
from ..session import cut, rocksdb_state, scratch
from ..streaming import jobs as J
from ..streaming import streams as W
from . import roles as R
from .events import LATEST, LOOSE, WATCH, micros
from .matching import FOLD
from .registry import query
from .roles import sql
from .sources import parsed_jobs
from .vectors import _blocks


def _stream(spark, df, name, files=4):
    path = W.land_stream(df, name, files)
    return W.file_stream(spark, path, spark.read.parquet(path).schema)


@query("stream_events", sql("SELECT user_id, item_id, kind, epoch_us(ts) AS ts FROM log", "log"))
def _(spark, d):
    """Every event arrives twice; the log holds it once."""
    ev = R.events(spark, d)
    log, late = scratch(spark, "log"), scratch(spark, "late")
    W.stream_events(_stream(spark, ev.unionByName(ev), "twice"), log, late, scratch(spark, "cp"), delay_days=60)
    return spark.read.parquet(log).select("user_id", "item_id", "kind", micros("ts").alias("ts"))


@query("stream_events_within", sql("SELECT user_id, item_id, kind, epoch_us(ts) AS ts FROM log", "log"))
def _(spark, d):
    """Every event arrives twice; the state store lets the first through."""
    ev = R.events(spark, d)
    log = scratch(spark, "log")
    W.stream_events_within(_stream(spark, ev.unionByName(ev), "twice"), log, scratch(spark, "cp"), "60 days")
    return spark.read.parquet(log).select("user_id", "item_id", "kind", micros("ts").alias("ts"))


@query("stream_latest_verdict", sql(f"WITH {LATEST} SELECT user_id, item_id, value FROM lr", "log"))
def _(spark, d):
    agg = W.stream_latest_verdict(_stream(spark, R.events(spark, d), "events"))
    return W.keep_current(agg, scratch(spark, "latest"), scratch(spark, "cp"), ["user_id", "item_id"]).select("user_id", "item_id", "value")


@query("stream_watchlist", sql(f"WITH {WATCH} SELECT * FROM wl", "log"))
def _(spark, d):
    agg = W.stream_watchlist(_stream(spark, R.events(spark, d), "events"))
    return W.keep_current(agg, scratch(spark, "watch"), scratch(spark, "cp"), ["user_id", "item_id"]).filter("active").select("user_id", "item_id")


AFTER = LOOSE.replace("AND e.value IS NOT NULL)", "AND e.value IS NOT NULL AND e.ts >= i.ts)")


@query("stream_attribution", sql(f"WITH {AFTER} SELECT user_id, item_id, slate_id, reward FROM ex WHERE propensity > 0 UNION ALL SELECT user_id, item_id, slate_id, reward FROM lo WHERE propensity > 0", "log", "impressions"))
def _(spark, d):
    """With an interval over the whole log the stream equals the batch join on verdicts that
    follow their impression."""
    imp, ev = R.impressions(spark, d), R.events(spark, d)
    joined = W.stream_attribution(_stream(spark, imp, "imp"), _stream(spark, ev, "ev"), "60 days", "60 days")
    path = scratch(spark, "pairs")
    W.run_batches(joined, W._changes(path), scratch(spark, "cp"))
    return W.settle_attribution(spark.read.parquet(path).drop("batch")).select("user_id", "item_id", "slate_id", "reward")


@query("stream_job_state", f"WITH {FOLD} SELECT job_id, state, wrong, asked FROM fo")
def _(spark, d):
    lines = parsed_jobs(spark, d)
    agg = W.stream_job_state(_stream(spark, lines, "lines"))
    return W.keep_current(agg, scratch(spark, "jobs"), scratch(spark, "cp"), ["job_id"]).select("job_id", "state", "wrong", "asked")


WATCHED = """WITH jl AS (SELECT o_custkey AS job, o_orderdate AS t, o_orderstatus AS s, substr(o_orderpriority, 1, 1) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
  jk AS (SELECT job, n, epoch_ms(CAST(t AS TIMESTAMP)) AS t, CASE WHEN n = 1 THEN 'request' WHEN p = '1' THEN 'state' WHEN p = '2' THEN 'offer' WHEN p = '4' THEN 'wrong' ELSE 'other' END AS kind,
    CASE s WHEN 'F' THEN 'paused' WHEN 'O' THEN 'downloading' ELSE 'failed' END AS state FROM jl WHERE job % 10 <> 3),
  jg AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY job ORDER BY n), (SELECT max(t) - 36 * 3600000 FROM jk)) - t AS gap, max(CASE WHEN kind = 'state' THEN n END) OVER (PARTITION BY job) AS said FROM jk),
  js AS (SELECT job, coalesce(max(CASE WHEN n = said THEN state END), 'queued') AS state, coalesce(max(gap) FILTER (n >= said), 0) AS longest, arg_max(gap, n) AS silent, max(t) AS updated,
    count(*) FILTER (kind = 'wrong') AS wrong, bool_or(kind = 'offer') AS asked FROM jg GROUP BY 1)
SELECT 'job-' || job AS job_id, CASE WHEN state = 'paused' AND longest > 86400000 THEN 'cancelled' ELSE state END AS state,
  CASE WHEN state = 'paused' AND longest > 86400000 THEN 'cancelled' WHEN state = 'downloading' AND silent > 30000 THEN 'interrupted' ELSE state END AS status,
  CASE WHEN state = 'paused' AND longest > 86400000 THEN 'no choice within a day' WHEN state <> 'queued' THEN 'r' END AS reason, updated, wrong, asked FROM js"""


def _standing(df):
    return df.select("job_id", "state", "status", "reason", F.unix_millis("updated").alias("updated"), "wrong", "asked")


@query("watch_jobs", WATCHED)
def _(spark, d):
    """The lines in order of time; at the end the watermark stands 36 hours before the newest."""
    lines = parsed_jobs(spark, d).select("job_id", "line", "at", "kind", "state", "reason")
    path = W.land_in_order(cut(lines), "lines", "unix_seconds(to_timestamp(at))")
    stream = W.file_stream(spark, path, lines.schema)
    with rocksdb_state(spark):
        return _standing(W.keep_current(J.watch_jobs(stream, delay="36 hours"), scratch(spark, "jobs"), scratch(spark, "cp"), ["job_id"]))


@query("job_standing", WATCHED)
def _(spark, d):
    lines = cut(parsed_jobs(spark, d))
    until = lines.agg((F.max(F.to_timestamp("at")) - F.expr("INTERVAL 36 HOURS")).alias("u")).scalar()
    return _standing(J.job_standing(lines, until))


@query("stream_event_counts", sql("SELECT epoch_us(date_trunc('day', ts)) AS start, kind, source, count(*) AS n FROM log GROUP BY 1, 2, 3", "log"))
def _(spark, d):
    agg = W.stream_event_counts(_stream(spark, R.events(spark, d), "events"), delay="60 days")
    out = W.keep_current(agg, scratch(spark, "counts"), scratch(spark, "cp"), ["start", "kind", "source"])
    return out.select(F.unix_micros("start").alias("start"), "kind", "source", "n")


@query("stream_new_items", sql("SELECT item_id, 192 AS width FROM titles", "titles"))
def _(spark, d):
    """The catalogue arrives twice; each item is placed once."""
    content, factors = _blocks(spark, d)
    _space, art = I.fuse_space(content, factors)
    t = R.titles(spark, d)
    path = scratch(spark, "space")
    schema = content.schema
    W.stream_new_items(_stream(spark, t.unionByName(t), "titles"), path, scratch(spark, "cp"), I.hashed_encoder(), art, schema)
    return cut(spark.read.parquet(path)).select("item_id", F.size("vec").alias("width"))
