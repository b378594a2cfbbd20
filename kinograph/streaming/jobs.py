"""Jobs watched while their log streams in: state per job, with event-time timers.

A pause that nobody answers ends by itself, and a running job that falls silent reads as interrupted,
both as soon as the watermark passes their time, without another line of the job.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_OUT = "job_id string, state string, status string, reason string, updated_ms long, wrong long, asked boolean"
_KEPT = "jobs binary"
#: The state before any line says one, and what an unanswered pause becomes.
FIRST, OVER, REASON = "queued", "cancelled", "no choice within a day"
#: Groups the jobs are dealt to: a call to the state store takes far longer than a job, so a group's jobs share theirs.
GROUPS = 1024


class JobWatch(StatefulProcessor):
    """The standing of a group of jobs, kept in one value; the group's timer is the first moment at which a job's silence
    would mean something."""

    def __init__(self, running: tuple[str, ...], pause_ms: int, beat_ms: int):
        self.running, self.pause_ms, self.beat_ms = running, pause_ms, beat_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("jobs", _KEPT)

    def _limit(self, state: str) -> int | None:
        return self.pause_ms if state == "paused" else self.beat_ms if state in self.running else None

    def _jobs(self) -> dict:
        """job_id -> (line, state, reason, updated, wrong, asked, over, due): ``due`` is the moment of the job's timer."""
        return json.loads(zlib.decompress(self.kept.get()[0])) if self.kept.exists() else {}

    def _keep(self, jobs: dict) -> None:
        self.kept.update((zlib.compress(json.dumps(jobs, separators=(",", ":")).encode(), 1),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if (first := min((now[7] for now in jobs.values() if now[7] is not None), default=None)) is not None:
            self.handle.registerTimer(first)

    @staticmethod
    def _rows(said: list) -> pd.DataFrame:
        """Rows of (job, its standing, whether by silence)."""
        return pd.DataFrame([(job, now[1], "interrupted" if silent else now[1], now[2], now[3], now[4], now[5]) for job, now, silent in said],
                            columns=["job_id", "state", "status", "reason", "updated_ms", "wrong", "asked"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        jobs, said = self._jobs(), {}
        lines = pd.concat(list(rows), ignore_index=True).sort_values("line", kind="stable")
        given = (lines[c].astype(object).where(lines[c].notna(), None) for c in ("job_id", "line", "at_ms", "kind", "state", "reason"))
        for job, line, at, kind, state, reason in zip(*given):
            line, at = int(line), int(at)
            now = jobs.get(job)
            said[job] = True
            if now is None:
                now = (-1, FIRST, None, at, 0, False, False)
            last, was, why, updated, wrong, asked, over = now[:7]
            if line <= last:  # a line seen before, or one that newer lines have overtaken
                jobs.setdefault(job, now)
                continue
            if was == "paused" and at - updated > self.pause_ms:
                was, why, over = OVER, REASON, True
            if kind == "state":
                was, why, over = state, reason, False
            jobs[job] = (line, was, why, at, wrong + (kind == "wrong"), asked or kind == "offer", over)
        for job in said:
            now = jobs[job][:7]
            limit = self._limit(now[1])
            jobs[job] = (*now, None if limit is None else now[3] + limit)
        self._keep(jobs)
        yield self._rows([(job, jobs[job], False) for job in said])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        jobs, said = self._jobs(), []
        reached = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        for job, now in jobs.items():
            if now[7] is None or now[7] > reached:
                continue
            # A pause ends; a silent job reads as interrupted, never written: the next line goes on from the state it had.
            paused = now[1] == "paused"
            jobs[job] = (now[0], OVER, REASON, *now[3:6], True, None) if paused else (*now[:7], None)
            said.append((job, jobs[job], not paused))
        if said:
            self._keep(jobs)
            yield self._rows(said)

    def close(self) -> None:
        pass


def watch_jobs(lines: DataFrame, running: tuple[str, ...] = ("downloading",), pause_hours: float = 24, beat_seconds: float = 30,
               delay: str = "1 hour", at: str = "at") -> DataFrame:
    """A stream of job lines (job_id, line, at, kind, state, reason) to each job's standing whenever a
    line or the clock changes it: job_id, state, status, reason, updated, wrong, asked.

    Lines of a job count in the order of ``line``; one at or below the last counted is dropped. A job is
    paused for ``pause_hours`` at most; ``status`` says interrupted while one of the ``running`` states has
    been silent for ``beat_seconds``. Lines up to ``delay`` late still undo what they answer; later ones are
    dropped with the watermark. Lines without a time are left out. Run it in update mode with the
    RocksDB state store; jobs are dealt to ``GROUPS`` groups by hash, and state is one row per group.
    """
    given = lines.filter(F.col("job_id").isNotNull()).select("job_id", F.col("line").cast("long").alias("line"), F.to_timestamp(at).alias("_at"), "kind", "state", "reason").filter(
        "_at is not null").withColumn("at_ms", F.unix_millis("_at")).withWatermark("_at", delay)
    watch = JobWatch(running, int(pause_hours * 3_600_000), int(beat_seconds * 1000))
    dealt = given.withColumn("_group", F.pmod(F.xxhash64("job_id"), F.lit(GROUPS)))
    return dealt.groupBy("_group").transformWithStateInPandas(watch, _OUT, "Update", "EventTime").select(
        "job_id", "state", "status", "reason", F.timestamp_millis("updated_ms").alias("updated"), "wrong", "asked")


def job_standing(lines: DataFrame, until: Column, running: tuple[str, ...] = ("downloading",), pause_hours: float = 24, beat_seconds: float = 30,
                 at: str = "at") -> DataFrame:
    """The batch twin: each job's standing at the moment ``until``, the time the stream's watermark has reached.

    All parts are aggregates that combine map-side but one: the longest silence after the last
    state line, a window over the job's lines.
    """
    given = lines.filter(F.col("job_id").isNotNull()).select("job_id", F.col("line").cast("long").alias("line"), F.to_timestamp(at).alias("_at"), "kind", "state", "reason").filter("_at is not null")
    order = Window.partitionBy("job_id").orderBy("line")
    gap = F.unix_millis(F.coalesce(F.lead("_at").over(order), until.cast("timestamp"))) - F.unix_millis("_at")
    said = F.max(F.when(F.col("kind") == "state", F.col("line"))).over(Window.partitionBy("job_id"))
    rows = given.withColumns({"gap": gap, "said": said})
    after = F.col("line") >= F.coalesce("said", F.lit(-1))
    out = rows.groupBy("job_id").agg(
        F.max_by(F.when(F.col("kind") == "state", F.struct("state", "reason")), F.when(F.col("kind") == "state", F.col("line"))).alias("_s"),
        F.max_by("_at", "line").alias("updated"), F.max_by("gap", "line").alias("_silent"), F.max(F.when(after, F.col("gap"))).alias("_gap"),
        F.count_if(F.col("kind") == "wrong").alias("wrong"), F.bool_or(F.col("kind") == "offer").alias("asked"))
    state = F.coalesce(F.col("_s.state"), F.lit(FIRST))
    over = (state == "paused") & (F.col("_gap") > int(pause_hours * 3_600_000))
    dead = state.isin(*running) & (F.col("_silent") > int(beat_seconds * 1000))
    return out.select("job_id", F.when(over, OVER).otherwise(state).alias("state"),
                      F.when(over, OVER).when(dead, "interrupted").otherwise(state).alias("status"),
                      F.when(over, REASON).otherwise(F.col("_s.reason")).alias("reason"), "updated", "wrong", "asked")
