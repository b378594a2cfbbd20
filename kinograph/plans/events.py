"""Verdict-log queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import events as E
from ..session import scratch
from . import catalogue, roles as R
from .registry import query
from .roles import sql


def micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


LATEST = """lr AS (SELECT user_id, item_id, value, ts, context FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM log WHERE kind = 'rate' AND value IS NOT NULL) WHERE rn = 1)"""
WATCH = """wl AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM log WHERE kind = 'watchlist') WHERE rn = 1 AND json_extract_string(context, '$.active') = 'true')"""
NEG = f"""ng AS (SELECT user_id, item_id, CAST(min(date_diff('day', ts, TIMESTAMP '{R.AS_OF}')) AS DOUBLE) AS age FROM log l WHERE kind IN ('skip', 'dismiss')
  AND NOT EXISTS (SELECT 1 FROM log r WHERE r.kind = 'rate' AND r.user_id = l.user_id AND r.item_id = l.item_id) GROUP BY 1, 2)"""
LABELS = f"""{LATEST}, {NEG}, labels0 AS (SELECT user_id, item_id, value / 10.0 AS reward, CAST(date_diff('day', ts, TIMESTAMP '{R.AS_OF}') AS DOUBLE) AS age, false AS weak FROM lr
  UNION ALL SELECT user_id, item_id, 0.25, age, true FROM ng),
  lab AS (SELECT * FROM labels0 WHERE item_id IN (SELECT item_id FROM space))"""


@query("latest_rating", sql(f"WITH {LATEST} SELECT user_id, item_id, value, epoch_us(ts) AS ts FROM lr", "log"))
def _(spark, d):
    return E.latest_rating(R.events(spark, d)).select("user_id", "item_id", "value", micros("ts").alias("ts"))


@query("active_watchlist", sql(f"WITH {WATCH} SELECT * FROM wl", "log"))
def _(spark, d):
    return E.active_watchlist(R.events(spark, d))


@query("excluded", sql(f"WITH {WATCH} SELECT DISTINCT user_id, item_id FROM log WHERE kind IN ('rate','skip','seen','dismiss','request') UNION SELECT user_id, item_id FROM wl", "log"))
def _(spark, d):
    return E.excluded(R.events(spark, d))


@query("already_asked", sql("SELECT DISTINCT user_id, item_id FROM log WHERE kind IN ('rate','skip','seen','dismiss','unseen')", "log"))
def _(spark, d):
    return E.already_asked(R.events(spark, d))


@query("library_shelves", sql(f"""WITH {WATCH}, r AS (SELECT DISTINCT user_id, item_id FROM log WHERE kind = 'rate'),
  w AS (SELECT DISTINCT user_id, item_id FROM log WHERE kind = 'seen' EXCEPT SELECT * FROM r), s AS (SELECT * FROM wl EXCEPT SELECT * FROM w EXCEPT SELECT * FROM r)
SELECT user_id, item_id, shelf, title FROM (SELECT *, 'rated' AS shelf FROM r UNION ALL SELECT *, 'watched' FROM w UNION ALL SELECT *, 'saved' FROM s) JOIN titles USING (item_id)""", "titles", "log"))
def _(spark, d):
    return E.library_shelves(R.events(spark, d), R.titles(spark, d)).orderBy("user_id", "shelf", F.lower("title"), "item_id")


@query("forget_items", sql("SELECT event_id FROM log l WHERE NOT EXISTS (SELECT 1 FROM log f WHERE f.user_id = l.user_id AND f.item_id = l.item_id AND f.kind = 'dismiss')", "log"))
def _(spark, d):
    ev = R.events(spark, d)
    return E.forget_items(ev, ev.filter(F.col("kind") == "dismiss")).select("event_id")


@query("clear_source", sql("SELECT event_id FROM log WHERE source <> 'import'", "log"))
def _(spark, d):
    return E.clear_source(R.events(spark, d), "import").select("event_id")


@query("undo_last", sql("""SELECT event_id FROM log WHERE event_id NOT IN (SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM log WHERE source = 'web' AND kind IN ('rate', 'unseen')) WHERE rn = 1)""", "log"))
def _(spark, d):
    return E.undo_last(R.events(spark, d)).select("event_id")


@query("weak_negatives", sql(f"WITH {NEG} SELECT * FROM ng", "log"))
def _(spark, d):
    return E.weak_negatives(R.events(spark, d), R.as_of())


@query("build_labels", sql(f"WITH {LABELS} SELECT * FROM lab", "log", "space"))
def _(spark, d):
    return E.build_labels(R.events(spark, d), R.space(spark, d), R.as_of())


@query("label_weight", sql(f"WITH {LABELS} SELECT user_id, item_id, weak, round(greatest(CASE WHEN weak THEN 0.5 ELSE 1.0 END * exp(-ln(2.0) * age / 1100.0), 1e-3), 9) AS weight FROM lab", "log", "space"))
def _(spark, d):
    labels = E.label_weights(E.build_labels(R.events(spark, d), R.space(spark, d), R.as_of()))
    return labels.select("user_id", "item_id", "weak", F.round("weight", 9).alias("weight"))


@query("liked_titles", sql(f"""WITH {LABELS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY reward DESC, item_id) AS rank FROM lab WHERE reward >= 0.4)
SELECT user_id, k.item_id, reward, rank, title || CASE WHEN year IS NOT NULL THEN ' (' || year || ')' ELSE '' END AS label FROM k JOIN titles USING (item_id) WHERE rank <= 5""", "titles", "log", "space"))
def _(spark, d):
    labels = E.build_labels(R.events(spark, d), R.space(spark, d), R.as_of())
    return E.liked_titles(labels, R.titles(spark, d), 0.4, 5).withColumn("rank", F.col("rank").cast("long"))


@query("guards", sql("""SELECT user_id, count(DISTINCT item_id) AS verdicts, count(DISTINCT item_id) >= 3 AS can_fit, count(DISTINCT item_id) >= 8 AS can_audit
FROM log WHERE kind = 'rate' AND value IS NOT NULL GROUP BY 1""", "log"))
def _(spark, d):
    return E.guards(R.events(spark, d)).select("user_id", "verdicts", "can_fit", "can_audit")


SEQ = """f AS (SELECT user_id, item_id, ts, event_id, value / 10.0 AS reward FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, event_id) AS rn
    FROM log WHERE kind = 'rate' AND value IS NOT NULL) WHERE rn = 1 AND item_id IN (SELECT item_id FROM space)),
  seq AS (SELECT *, row_number() OVER w - 1 AS step, avg(reward) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
    FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query("first_verdict_sequence", sql(f"WITH {SEQ} SELECT user_id, item_id, step, reward FROM seq", "log", "space"))
def _(spark, d):
    return E.first_verdict_sequence(R.events(spark, d), R.space(spark, d)).select("user_id", "item_id", "step", "reward")


@query("running_mean_control", sql(f"WITH {SEQ} SELECT user_id, step, round(earlier, 9) AS earlier_mean, round(abs(earlier - reward), 9) AS control_error FROM seq WHERE step > 0", "log", "space"))
def _(spark, d):
    out = E.running_mean_control(E.first_verdict_sequence(R.events(spark, d), R.space(spark, d)))
    return out.select("user_id", "step", F.round("earlier_mean", 9).alias("earlier_mean"), F.round("control_error", 9).alias("control_error"))


@query("trailing_mean", sql(f"WITH {SEQ} SELECT user_id, step, round(avg(reward) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) AS smooth FROM seq", "log", "space"))
def _(spark, d):
    seq = E.first_verdict_sequence(R.events(spark, d), R.space(spark, d))
    return E.trailing_mean(seq, "reward", 5).select("user_id", "step", F.round("smooth", 9).alias("smooth"))


@query("rated_by_language", sql("""WITH n AS (SELECT user_id, language, count(DISTINCT item_id) AS n FROM log JOIN titles USING (item_id) WHERE log.kind = 'rate' GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, language) AS rank FROM n) WHERE rank <= 12""", "titles", "log"))
def _(spark, d):
    return E.rated_by_language(R.events(spark, d), R.titles(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query("recent_verdicts", sql("""SELECT user_id, rank, title, year, json_extract_string(context, '$.verdict') AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
  FROM log WHERE kind = 'rate') e JOIN titles USING (item_id) WHERE rank <= 8""", "titles", "log"), floats=("year",))
def _(spark, d):
    return E.recent_verdicts(R.events(spark, d), R.titles(spark, d)).select("user_id", F.col("rank").cast("long").alias("rank"), "title", "year", "verdict")


@query("history", sql("""SELECT user_id, rank, title, language, e.kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM log) e
  JOIN titles USING (item_id) WHERE rank <= 30""", "titles", "log"))
def _(spark, d):
    return E.history(R.events(spark, d), R.titles(spark, d)).select("user_id", F.col("rank").cast("long").alias("rank"), "title", "language", "kind")


@query("rated_titles", sql(f"""WITH {LATEST} SELECT user_id, item_id, title, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rank FROM lr)
  JOIN titles USING (item_id) WHERE rank <= 20""", "titles", "log"))
def _(spark, d):
    return E.rated_titles(R.events(spark, d), R.titles(spark, d), 20).select("user_id", "item_id", "title", "value", F.col("rank").cast("long").alias("rank"))


@query("last_slate_item", sql("""WITH last AS (SELECT user_id, slate_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, impression_id DESC) AS rn FROM impressions) WHERE rn = 1),
  q AS (SELECT o_orderkey, o_custkey AS user_id, substr(o_orderpriority, 1, 1) AS query FROM orders)
SELECT o_orderkey, q.user_id, CAST(i.item_id AS DOUBLE) AS item_id FROM q LEFT JOIN (SELECT i.* FROM impressions i JOIN last USING (user_id, slate_id)) i ON i.user_id = q.user_id AND i.position + 1 = CAST(q.query AS INTEGER)""", "impressions"))
def _(spark, d):
    q = R.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.substring("o_orderpriority", 1, 1).alias("query"))
    return E.last_slate_item(q, R.impressions(spark, d)).select("o_orderkey", "user_id", F.col("item_id").cast("double").alias("item_id"))


def incoming_verdicts(spark, d):
    """Order lines as verdicts coming in from a page."""
    words = F.when(F.col("l_quantity") > 40, "love").when(F.col("l_quantity") > 30, "like").when(F.col("l_quantity") > 20, "unseen").when(
        F.col("l_quantity") > 10, "hate").otherwise("wow")
    return R.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("user_id"), (F.col("l_partkey") * 2).alias("item_id"), words.alias("verdict"),
        F.when(F.col("l_linestatus") == "F", "s1").alias("slate_id"), F.col("l_linenumber").alias("position"))


@query("accept_verdicts", sql("""WITH inc AS (SELECT l_orderkey AS row_id, l_linenumber AS line, l_suppkey AS user_id, l_partkey * 2 AS item_id, l_quantity AS q,
    CASE WHEN l_quantity > 40 THEN 'love' WHEN l_quantity > 30 THEN 'like' WHEN l_quantity > 20 THEN 'unseen' WHEN l_quantity > 10 THEN 'hate' ELSE 'wow' END AS verdict,
    l_linestatus = 'F' AS s, l_linenumber FROM lineitem),
  sealed AS (SELECT DISTINCT user_id, item_id FROM log WHERE kind = 'seen')
SELECT row_id, line, item_id, CASE WHEN t.item_id IS NULL THEN 'unknown title' WHEN sealed.item_id IS NOT NULL THEN 'sealed case' WHEN verdict = 'wow' THEN 'unknown verdict' END AS reason,
  CASE WHEN verdict = 'unseen' THEN 'unseen' ELSE 'rate' END AS kind, CASE verdict WHEN 'love' THEN 10.0 WHEN 'like' THEN 7.5 WHEN 'hate' THEN 0.0 END::DOUBLE AS value,
  CASE WHEN verdict = 'unseen' THEN '{"answer":"unseen"}' ELSE '{' || CASE WHEN s THEN '"slate_id":"s1","position":' || l_linenumber || ',' ELSE '' END || '"verdict":"' || verdict || '"}' END AS context
FROM inc LEFT JOIN (SELECT item_id FROM titles) t USING (item_id) LEFT JOIN sealed USING (user_id, item_id)""", "titles", "log"))
def _(spark, d):
    sealed = R.events(spark, d).filter(F.col("kind") == "seen")
    return E.accept_verdicts(incoming_verdicts(spark, d), R.titles(spark, d), sealed).select("row_id", "line", "item_id", "reason", "kind", "value", "context")


@query("library_actions", sql("""WITH a AS (SELECT o_orderkey AS row_id, o_orderkey % 3000 AS item_id, CASE o_orderstatus WHEN 'F' THEN 'save' WHEN 'O' THEN 'remove' ELSE 'watched' END AS action FROM orders)
SELECT row_id, item_id, 'watchlist' AS kind, CASE WHEN action = 'save' THEN '{"active":true}' ELSE '{"active":false}' END AS context FROM a WHERE item_id IN (SELECT item_id FROM titles)
UNION ALL SELECT row_id, item_id, 'seen', '{"from":"library"}' FROM a WHERE action = 'watched' AND item_id IN (SELECT item_id FROM titles)""", "titles"))
def _(spark, d):
    acts = R.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.pmod("o_orderkey", F.lit(3000)).alias("item_id"),
        F.when(F.col("o_orderstatus") == "F", "save").when(F.col("o_orderstatus") == "O", "remove").otherwise("watched").alias("action"))
    return E.library_actions(acts, R.titles(spark, d)).select("row_id", "item_id", "kind", "context")


@query("request_events", sql("""WITH j AS (SELECT 'job-' || o_orderkey AS job_id, o_custkey % 50 AS user_id, CASE WHEN o_totalprice > 100000 THEN o_orderkey % 60 END AS item_id, o_orderdate AS ts, o_orderstatus = 'O' AS open FROM orders),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, CASE WHEN open THEN 'open' ELSE job_id END ORDER BY ts, job_id) AS rn FROM j WHERE item_id IS NOT NULL)
SELECT job_id, user_id, item_id, 'request' AS kind, '{"job":"' || job_id || '"}' AS context FROM p WHERE rn = 1"""))
def _(spark, d):
    jobs = R.table(spark, d, "orders").select(
        F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("job_id"), F.pmod("o_custkey", F.lit(50)).alias("user_id"),
        F.when(F.col("o_totalprice") > 100000, F.pmod("o_orderkey", F.lit(60))).alias("item_id"), F.col("o_orderdate").alias("ts"),
        (F.col("o_orderstatus") == "O").alias("open"))
    return E.request_events(jobs, R.events(spark, d)).select("job_id", "user_id", "item_id", "kind", "context")


EXACT = "ex AS (SELECT i.user_id, i.item_id, i.slate_id, impression_id, propensity, e.value / 10.0 AS reward FROM impressions i JOIN log e ON e.user_id = i.user_id AND e.item_id = i.item_id AND json_extract_string(e.context, '$.slate_id') = i.slate_id WHERE e.kind = 'rate' AND e.value IS NOT NULL)"
LOOSE = EXACT + """, lo AS (SELECT i.user_id, i.item_id, i.slate_id, impression_id, propensity, e.value / 10.0 AS reward FROM impressions i JOIN log e ON e.user_id = i.user_id AND e.item_id = i.item_id
  WHERE e.kind = 'rate' AND e.value IS NOT NULL AND e.ts >= i.ts AND json_extract_string(e.context, '$.slate_id') IS NULL AND i.slate_id NOT IN (SELECT slate_id FROM ex))"""


@query("attribute_exact", sql(f"WITH {EXACT} SELECT * FROM ex", "log", "impressions"))
def _(spark, d):
    return E.attribute_exact(R.impressions(spark, d), R.events(spark, d))


@query("attribute_temporal", sql(f"WITH {LOOSE} SELECT * FROM lo", "log", "impressions"))
def _(spark, d):
    return E.attribute_temporal(R.impressions(spark, d), R.events(spark, d))


@query("attribute_last_touch", sql(f"""WITH {LOOSE.replace('e.value / 10.0 AS reward FROM impressions i JOIN log e ON e.user_id = i.user_id AND e.item_id = i.item_id' + chr(10), 'e.value / 10.0 AS reward, e.event_id, i.ts AS its FROM impressions i JOIN log e ON e.user_id = i.user_id AND e.item_id = i.item_id' + chr(10))}
SELECT user_id, item_id, slate_id, impression_id, propensity, reward FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY its DESC, impression_id DESC) AS rn FROM lo) WHERE rn = 1""", "log", "impressions"))
def _(spark, d):
    return E.attribute_temporal(R.impressions(spark, d), R.events(spark, d), last_touch=True)


@query("usable_impressions", sql(f"WITH {LOOSE} SELECT user_id, count(*) AS usable FROM (SELECT * FROM ex UNION ALL SELECT * FROM lo) WHERE propensity > 0 GROUP BY 1", "log", "impressions"))
def _(spark, d):
    return E.usable_impressions(R.impressions(spark, d), R.events(spark, d)).groupBy("user_id").agg(F.count("*").alias("usable"))


@query("append_events", sql("SELECT user_id, item_id, kind, epoch_us(ts) AS ts FROM log UNION ALL SELECT user_id, item_id, kind, epoch_us(TIMESTAMP '2024-02-01 00:00:00') FROM log WHERE kind = 'seen'", "log"))
def _(spark, d):
    path = scratch(spark, "event-log")
    ev = R.events(spark, d).drop("event_id")
    E.append_events(ev, R.as_of()).write.mode("append").parquet(path)
    late = ev.filter(F.col("kind") == "seen").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    E.append_events(late, R.as_of()).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("user_id", "item_id", "kind", micros("ts").alias("ts"))


@query("append_impressions", sql("SELECT slate_id, item_id, position, score, propensity, explored, 'thompson:movie' AS policy FROM impressions", "impressions"))
def _(spark, d):
    path = scratch(spark, "impressions")
    picks = R.impressions(spark, d).drop("ts", "policy", "impression_id")
    E.append_impressions(picks, "thompson:movie", R.as_of()).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("slate_id", "item_id", "position", "score", "propensity", "explored", "policy")


@query("upsert_meta", sql("""SELECT key, value FROM (SELECT event_type || ':' || user_id AS key, CASE WHEN value > 3 THEN CAST(event_id AS VARCHAR) END AS value,
  row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND value IS NOT NULL"""))
def _(spark, d):
    writes = R.table(spark, d, "events").select(
        F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("key"),
        F.when(F.col("value") > 3, F.col("event_id").cast("string")).alias("value"), F.struct("ts", "event_id").alias("written_at"))
    return E.upsert_meta(writes)


@query("export_events", sql("SELECT user_id, imdb_id, title, log.kind, value, source, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, context FROM log JOIN titles USING (item_id)", "titles", "log"))
def _(spark, d):
    from ..sources import logs

    path = scratch(spark, "export")
    logs.write_export(E.export_rows(R.events(spark, d), R.titles(spark, d)), path)
    return logs.read_export(spark, path).select("user_id", "imdb_id", "title", "kind", "value", "source", "ts", "context")


IMPORT = f"""{catalogue.REBUILT}, o AS (SELECT CASE WHEN r.item_id IS NULL THEN 'missing' WHEN l.source = 'web' THEN 'duplicate' ELSE 'imported' END AS outcome, l.user_id, r.item_id, l.kind, l.ts
  FROM log l JOIN titles t ON t.item_id = l.item_id LEFT JOIN rebuilt r ON r.imdb_id = t.imdb_id)"""


def _import_case(spark, d):
    """The whole log exported, then imported after a rebuild where web verdicts are already present."""
    from ..operators import catalogue as C

    new = catalogue.rebuilt(spark, d)
    lines = E.export_rows(R.events(spark, d), R.titles(spark, d))
    have = C.remap_ids(R.events(spark, d).filter(F.col("source") == "web"), C.id_map(R.titles(spark, d), new)).filter(~F.col("unmapped"))
    return lines, new, have


@query("import_events", sql(f"WITH {IMPORT} SELECT user_id, item_id, kind, epoch_us(ts) AS ts FROM o WHERE outcome = 'imported'", "titles", "log"))
def _(spark, d):
    return E.import_events(*_import_case(spark, d)).select("user_id", "item_id", "kind", micros("ts").alias("ts"))


@query("import_counts", sql(f"WITH {IMPORT} SELECT outcome, count(*) AS n FROM o GROUP BY 1", "titles", "log"))
def _(spark, d):
    return E.import_counts(*_import_case(spark, d))


@query("verdict_to_reward", sql("""WITH w AS (SELECT event_id, CASE WHEN value > 100 THEN ' Love ' WHEN value > 60 THEN 'meh' WHEN value > 30 THEN 'so-so' ELSE CAST(round(value, 2) AS VARCHAR) END AS verdict FROM events)
SELECT event_id, CASE WHEN verdict = ' Love ' THEN 1.0 WHEN verdict = 'meh' THEN 0.4 WHEN verdict = 'so-so' THEN NULL ELSE round(least(greatest(CASE WHEN CAST(verdict AS DOUBLE) > 1 THEN CAST(verdict AS DOUBLE) / 10.0 ELSE CAST(verdict AS DOUBLE) END, 0.0), 1.0), 6) END::DOUBLE AS reward FROM w"""))
def _(spark, d):
    word = F.when(F.col("value") > 100, " Love ").when(F.col("value") > 60, "meh").when(F.col("value") > 30, "so-so").otherwise(F.round("value", 2).cast("string"))
    return R.table(spark, d, "events").select("event_id", F.round(S.verdict_to_reward(word), 6).alias("reward"))


@query("display_scale", sql("SELECT event_id, least(greatest(value / 20 * 10.0, 0.0), 10.0) AS shown, least(greatest(value / 50, 0.0) * 10.0, 10.0) AS band FROM events"))
def _(spark, d):
    return R.table(spark, d, "events").select("event_id", S.display_scale(F.col("value") / 20).alias("shown"), S.display_band(F.col("value") / 50).alias("band"))
