"""Live updates: debounced jobs, renames and deletes from a stream of file events.

Rules run on event time. A burst of events on a path becomes one job when the
path has been quiet for ``quiet`` milliseconds, or ``most`` after its first
event; the last kind wins. State lives in the checkpoint, so a restart loses
nothing, and there is no queue that could overflow: the source's rate limits
give the backpressure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodeview.operators import index

QUIET_MS, MOST_MS, GRACE_MS = 250, 2000, 1000
JOB = "path string, job string, first_ms long, last_ms long, n_events long"
EVENTS = "event_id long, path string, inode long, device long, kind string, size long, mtime_ms double, ts timestamp"


def _job(kind: str) -> str:
    return "delete" if kind == "unlink" else "upsert"


class Burst:
    """The pending job of a path, and the rule that ends it."""

    def __init__(self, quiet: int, most: int, first: int, last: int, kind: str, n: int, grace: int = 0):
        self.quiet, self.most, self.first, self.last, self.kind, self.n, self.grace = quiet, most, first, last, kind, n, grace

    @property
    def due(self) -> int:
        """When the job is given out; a delete waits ``grace`` for an add that takes it back or has taken the file elsewhere."""
        if self.kind == "unlink" and self.grace:
            return self.last + self.grace + self.quiet
        return min(self.last + self.quiet, self.first + self.most)

    def take(self, ms: int, kind: str) -> bool:
        """Add an event unless the burst was over before it."""
        if ms > self.due:
            return False
        self.last, self.kind, self.n = max(self.last, ms), kind, self.n + 1
        return True

    def row(self, path: str) -> tuple:
        return path, _job(self.kind), self.first, self.last, self.n


def fold(events: list[tuple[int, int, str]], quiet: int, most: int) -> Iterator[Burst]:
    """Bursts of one path's (ms, event id, kind), in order."""
    now: Burst | None = None
    for ms, _, kind in sorted(events):
        if kind == "error":
            continue
        if now is None or not now.take(ms, kind):
            if now is not None:
                yield now
            now = Burst(quiet, most, ms, ms, kind, 1)
    if now is not None:
        yield now


def debounce_batch(events: DataFrame, quiet: int = QUIET_MS, most: int = MOST_MS) -> DataFrame:
    """The rule over a table. Paths are sorted within tasks and streamed, so a frequent path needs no memory of its own."""
    rows = events.filter("kind <> 'error'").select("path", F.unix_millis("ts").alias("ms"), "event_id", "kind").repartition("path").sortWithinPartitions("path", "ms", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, now = None, None
        for b in batches:
            out = []
            for p, ms, kind in zip(b["path"], b["ms"], b["kind"], strict=True):
                if now is not None and p == path and now.take(int(ms), kind):
                    continue
                if now is not None:
                    out.append(now.row(path))
                path, now = p, Burst(quiet, most, int(ms), int(ms), kind, 1)
            yield pd.DataFrame(out, columns=["path", "job", "first_ms", "last_ms", "n_events"])
        if now is not None:
            yield pd.DataFrame([now.row(path)], columns=["path", "job", "first_ms", "last_ms", "n_events"])

    return rows.mapInPandas(run, JOB)


class Debouncer(StatefulProcessor):
    """One burst of state per path; its timer is set to when the burst is due."""

    def __init__(self, quiet: int = QUIET_MS, most: int = MOST_MS, grace: int = 0):
        self.quiet, self.most, self.grace = quiet, most, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("burst", "first long, last long, kind string, n long")

    def _emit(self, key: Any, burst: Burst) -> pd.DataFrame:
        return pd.DataFrame([burst.row(key[0])], columns=["path", "job", "first_ms", "last_ms", "n_events"])

    def _load(self) -> Burst | None:
        return Burst(self.quiet, self.most, *self.state.get(), self.grace) if self.state.exists() else None

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = self._load()
        events = sorted((int(ms), int(e), k) for b in rows for ms, e, k in zip(b["ms"], b["event_id"], b["kind"], strict=True))
        for ms, _, kind in events:
            if now is None or not now.take(ms, kind):
                if now is not None:  # due before this event, though its timer has yet to fire
                    yield self._emit(key, now)
                now = Burst(self.quiet, self.most, ms, ms, kind, 1, self.grace)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now is not None:
            self.state.update((now.first, now.last, now.kind, now.n))
            self.handle.registerTimer(now.due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = self._load()
        if now is not None:
            self.state.clear()
            yield self._emit(key, now)

    def close(self) -> None:
        pass


def debounced(events: DataFrame, quiet: int = QUIET_MS, most: int = MOST_MS, late: str = "5 seconds", grace: int = 0) -> DataFrame:
    """Jobs from a stream of events; needs the RocksDB state store."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # ticks only move the time on; the filter names ts so that it stays behind the watermark
    told = events.withWatermark("ts", late).filter("NOT (kind IN ('error', 'tick') AND ts IS NOT NULL)")
    rows = told.select("path", "event_id", "kind", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("path").transformWithStateInPandas(Debouncer(quiet, most, grace), JOB, "Append", "EventTime")


def apply_jobs(jobs: DataFrame, files: DataFrame, blobs: DataFrame, present: DataFrame, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Tables after a batch of jobs: deletes go with their texts, upserts of paths that exist (rows ``present``) are merged with their new texts.

    A path whose last job is a delete is not brought back by an earlier upsert of the batch.
    """
    last = index.latest_by(jobs.select("path", "job", "last_ms"), "path", "last_ms")
    left, said = index.delete_paths(files, blobs, last.filter("job = 'delete'"))
    now = present.join(last.filter("job = 'upsert'").select("path"), "path", "left_semi")
    fresh = (blobs.limit(0) if texts is None else texts).join(now.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return index.upsert_files(left, now.select(*files.columns)), index.upsert_blobs(said, fresh)


def subscribed(jobs: DataFrame, path_prefix: str = "", kinds: Sequence[str] = ("upsert", "delete")) -> DataFrame:
    """The jobs below a path, of some kinds, of a stream or a table."""
    return jobs.filter(F.startswith("path", F.lit(path_prefix)) & F.col("job").isin(list(kinds)))


def run(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second", late: str = "0 seconds") -> StreamingQuery:
    """Debounce a stream and hand each batch of jobs to ``apply``; the checkpoint is a folder that executors share.

    Deletes wait for the grace time, so the job of a file's new path comes before that of its old one: renames are met
    when the new path is applied.
    """
    return debounced(events, late=late, grace=GRACE_MS).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def event_files(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """A stream of events from JSON files as they come."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).json(path)
