"""Status transitions of a snapshot stream that do not depend on the order in which snapshots arrive.

Two ways with the same result. ``status_changes_keyed`` keeps the versions of each job in the state
store (``transformWithState`` on RocksDB, jobs in buckets): a version that arrives late is put between its neighbours, and
the one after it is answered again under the next revision. ``transitions_by_batch`` stays on joins and
windows: it keeps the last status of each job in a table, and only for jobs with late rows does it read
their versions again and rewrite their events. The second suits backfills, the first many small triggers.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from jobtide.dims import COLLECTION_SECONDS
from jobtide.operators.ordered import OrderedScan
from jobtide.operators.stats import latest_rows
from jobtide.operators.transitions import transition_rows
from jobtide.session import remove, scratch
from jobtide.sources.sinks import drop_batch

LATE = "10 minutes"
FINISHED = ("Succeeded", "Failed")

EVER_US = 1 << 60
NEVER_US = -1 << 63
SEEN = ["ts_us", "status", "submission_us", "start_us"]
CHANGES = "job_id string, ts_us bigint, prev_status string, status string, submission_us bigint, start_us bigint, revision int"
#: Rows of a job, and of a bucket, that are sorted at once. More rows of one trigger are taken in turns; late ones among them are corrected.
ROWS_AT_ONCE = 10_000
BUCKET_ROWS_AT_ONCE = 100_000
#: States of a stream without a bound on lateness. A checkpoint belongs to one number.
STATE_BUCKETS = 1 << 13

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# -- versions in the state store ----------------------------------------------------------------------


def _fresh(rows: Iterable[tuple]) -> dict:
    """(submission, start) by (time, status), in that order; of equal ones the least."""
    fresh = {}
    for at, *times in sorted(rows):
        fresh.setdefault(at, tuple(times))
    return fresh


def _answers(fresh: dict, last: tuple | None, known: dict) -> Iterator[tuple]:
    """What ``fresh`` versions say: each with the status before it, and a known one after it that now has another before it.

    (version, times, status before, status it was told before, revision). ``known`` is needed of a job with versions up to ``last``.
    """
    order = sorted([*known, *fresh]) if known else [*([last] if last else []), *fresh]
    for at in fresh:
        i = bisect_left(order, at)
        before = order[i - 1][1] if i else None
        yield at, fresh[at], before, None, 0
        after = order[i + 1] if i + 1 < len(order) else None
        if after in known:
            *times, was, revision = known[after]
            if was != at[1]:
                yield after, tuple(times), at[1], was, revision + 1


def _told(job_id, at, times, before, was, revision) -> tuple | None:
    """A row of CHANGES: a change, and one that is no longer one, is told."""
    changes, changed = before is not None and before != at[1], was is not None and was != at[1]
    return (job_id, at[0], before, at[1], *times, revision) if changes or changed else None


def _joined(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= BUCKET_ROWS_AT_ONCE:
            yield pd.concat(held)
            held, size = [], 0
    if held:
        yield pd.concat(held)


class BucketVersions(StatefulProcessor):
    """Versions of the jobs of a bucket: the newest of each job, and a log of all, to which a trigger adds one entry.

    Only a trigger with late rows reads the log; of a version that is there twice the later one holds. A call of
    the state store costs more than the work on a job, so a bucket makes three calls for all its jobs.
    """

    def init(self, handle) -> None:
        self._newest = handle.getValueState("newest", "jobs string")
        self._log = handle.getListState("log", "versions string")

    def _logged(self) -> dict:
        versions: dict = {}
        for (entry,) in self._log.get():
            self._enter(versions, json.loads(entry))
        return versions

    @staticmethod
    def _enter(versions: dict, entry: list) -> None:
        for job_id, ts_us, status, *value in entry:
            versions.setdefault(job_id, {})[(ts_us, status)] = value

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, versions = self._newest.get(), None
        newest = {job_id: (ts_us, status) for job_id, ts_us, status in json.loads(held[0])} if held else {}
        for some in _joined(rows):
            jobs, entry, told = {}, [], []
            times = ([None if us == NEVER_US else us for us in some[c].tolist()] for c in ("submission_us", "start_us"))
            for job_id, *row in zip(some["job_id"].tolist(), zip(some["ts_us"].tolist(), some["status"].tolist()), *times):
                jobs.setdefault(job_id, []).append(row)
            for job_id, own in jobs.items():
                fresh, last, known = _fresh(own), newest.get(job_id), {}
                if last and min(fresh) <= last:
                    versions = self._logged() if versions is None else versions
                    known = versions[job_id]
                    fresh = {at: times for at, times in fresh.items() if at not in known}
                for at, times, before, was, revision in _answers(fresh, last, known):
                    entry.append([job_id, *at, *times, before, revision])
                    told.append(_told(job_id, at, times, before, was, revision))
                newest[job_id] = max([*([last] if last else []), *list(fresh)[-1:]])
            if entry:
                self._log.appendValue((json.dumps(entry),))
                if versions is not None:
                    self._enter(versions, entry)
            yield pd.DataFrame(list(filter(None, told)), columns=[c.split()[0] for c in CHANGES.split(", ")], dtype=object)
        self._newest.update((json.dumps([[job_id, *at] for job_id, at in newest.items()]),))

    def close(self) -> None:
        pass


class JobVersions(StatefulProcessor):
    """Versions of one job by (time, status), each with the status before it and how often it was answered, which leave in time."""

    def __init__(self, finished_us: int | None, idle_us: int | None):
        self._finished_us, self._idle_us = finished_us, idle_us

    def init(self, handle) -> None:
        self._handle = handle
        value = "submission_us bigint, start_us bigint, prev_status string, revision int"
        self._versions = handle.getMapState("versions", "ts_us bigint, status string", value)
        self._newest = handle.getValueState("newest", "ts_us bigint, status string, timer_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = iter(rows)
        while some := list(islice(rows, ROWS_AT_ONCE)):
            yield from self._take(key[0], some)
        if self._newest.exists():
            ts_us, status, timer_ms = self._newest.get()
            if timer_ms is None:
                self._set_timer(ts_us, status, ts_us // 1000 + 1)

    def _take(self, job_id: str, rows: list) -> Iterator[Row]:
        fresh = _fresh(map(_numbers, rows))
        last = self._newest.get() if self._newest.exists() else None
        known, newest, timer_ms = {}, (last[0], last[1]) if last else None, last[2] if last else None
        if newest and min(fresh) <= newest:
            known = {(k[0], k[1]): v for k, v in self._versions.iterator()}
            fresh = {k: v for k, v in fresh.items() if k not in known}
        for at, times, before, was, revision in _answers(fresh, newest, known):
            self._versions.updateValue(at, (*times, before, revision))
            if told := _told(job_id, at, times, before, was, revision):
                yield Row(*(c.split()[0] for c in CHANGES.split(", ")))(*told)
        if fresh and (newest is None or max(fresh) > newest):
            self._newest.update((*max(fresh), timer_ms))

    def _set_timer(self, ts_us: int, status: str, at_ms: int | None) -> None:
        if at_ms is not None:
            self._handle.registerTimer(at_ms)
        self._newest.update((ts_us, status, at_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """No row behind the watermark comes any more: of older versions only the last can still be a neighbour."""
        now_ms = timerValues.getCurrentWatermarkInMs()
        order = sorted((k[0], k[1]) for k in self._versions.keys())
        old = [at for at in order if at[0] // 1000 < now_ms]
        for at in old[:-1]:
            self._versions.removeKey(at)
        ts_us, status = order[-1]
        keep_us = self._finished_us if status in FINISHED else self._idle_us
        if len(old) < len(order):
            self._set_timer(ts_us, status, max(ts_us // 1000, now_ms) + 1)
        elif keep_us is None:
            self._set_timer(ts_us, status, None)
        elif (ts_us + keep_us) // 1000 < now_ms:
            self._versions.clear()
            self._newest.clear()
        else:
            self._set_timer(ts_us, status, max((ts_us + keep_us) // 1000, now_ms) + 1)
        return iter(())

    def close(self) -> None:
        pass


def _numbers(row) -> tuple:
    """Times as integers; a missing time is NULL, however the rows were transferred."""
    whole = lambda x: None if x is None or x != x else int(x)
    return (int(row.ts_us), row.status), whole(row.submission_us), whole(row.start_us)


def status_changes_keyed(
    snapshots: DataFrame, late: str | None = None, finished_us: int | None = None, idle_us: int | None = None
) -> DataFrame:
    """Changes of status with the revision of each; :func:`newest_changes` keeps the newest of them.

    Expects job_id, ts_us, status, submission_us and start_us. A snapshot may arrive in any order: it is
    compared with the versions before and after it, and if the one after it told something else before,
    that one is told again under a higher revision (also if it is no change any more). A snapshot that is
    repeated with its time and status tells nothing; snapshots of one time are ordered by status.

    ``late`` bounds the state: rows further behind the newest event are dropped, and versions that no
    row can get between any more are removed; each job has a state of its own for that. Without it no row is late, all versions
    stay and jobs share the state of a bucket. How long a finished or silent job is remembered needs it, and takes LATE if none is given; a later change of a
    forgotten job counts as its first snapshot. The query must be started within :func:`rocksdb`.
    """
    late = late or (LATE if finished_us is not None or idle_us is not None else None)
    rows = snapshots.select("job_id", *SEEN)
    if late:
        rows = rows.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)
        return rows.groupBy("job_id").transformWithState(JobVersions(finished_us, idle_us), CHANGES, "append", "EventTime")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(NEVER_US)) for c in ("submission_us", "start_us")})  # frames have no missing integers
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(STATE_BUCKETS)))
    return rows.groupBy("bucket").transformWithStateInPandas(BucketVersions(), CHANGES, "append", "None")


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB, which versions per key need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def newest_changes(changes: DataFrame) -> DataFrame:
    """The last word on each version; what turned out to be no change is left out."""
    last = F.max_by(F.struct("prev_status", "submission_us", "start_us"), "revision").alias("last")
    rows = changes.groupBy("job_id", "ts_us", "status").agg(last).select("job_id", "ts_us", "status", "last.*")
    return rows.filter(F.col("prev_status").isNotNull() & (F.col("prev_status") != F.col("status")))


def keyed_transitions(changes: DataFrame, scheduler_name: str = "unknown", efficiency: Column | None = None) -> DataFrame:
    """Transitions named by the stored changes of :func:`status_changes_keyed`."""
    return transition_rows(newest_changes(changes), scheduler_name, efficiency)


# -- joins and windows, batch by batch ----------------------------------------------------------------


def _or_ever(limit_us: int | None) -> int:
    return EVER_US if limit_us is None else limit_us


KNOWN = "job_id string, ts_us bigint, status string"
VERSIONS = f"{KNOWN}, submission_us bigint, start_us bigint"


def transition_batch(
    snapshots: DataFrame, batch_id: int, out: str, scheduler_name: str = "unknown",
    finished_us: int | None = None, idle_us: int | None = None,
) -> None:
    """Write the transitions of one batch and the last statuses for the next one.

    Polls list every live job, so the table of last statuses is about as large as a batch. Where a
    row is older than what is known of its job, the job's versions are read from all batches and its
    events written anew; :func:`batch_transitions` takes a job's events from there on. Other jobs are
    compared with their last status only, so a batch in order reads no history. A retried batch reads
    the same predecessor and replaces its own output.
    """
    spark = snapshots.sparkSession
    if batch_id == 0:
        known = spark.createDataFrame([], KNOWN)
    else:
        known = spark.read.schema(KNOWN).parquet(f"{out}/last/batch_id={batch_id - 1}")
    at, last = F.struct("ts_us", "status"), F.struct(F.col("last_us").alias("ts_us"), F.col("last_status").alias("status"))
    met = known.select("job_id", F.col("ts_us").alias("last_us"), F.col("status").alias("last_status"))
    fresh = snapshots.select("job_id", *SEEN).join(met, "job_id", "left")
    fresh = fresh.select("job_id", *SEEN, F.coalesce(at < last, F.lit(False)).alias("__late"), F.coalesce(at == last, F.lit(False)).alias("__again"))
    fresh = fresh.filter(~F.col("__again")).drop("__again")
    held = scratch(spark, "batch")
    try:
        fresh.write.parquet(f"{held}/fresh")
        fresh = spark.read.schema(fresh.schema).parquet(f"{held}/fresh")
        fresh.drop("__late").write.mode("overwrite").parquet(f"{out}/versions/batch_id={batch_id}")
        fresh.filter("__late").select("job_id").distinct().write.mode("overwrite").parquet(f"{out}/rewritten/batch_id={batch_id}")
        late = spark.read.schema("job_id string").parquet(f"{out}/rewritten/batch_id={batch_id}")
        rows, before = fresh.drop("__late"), known
        if not late.isEmpty():
            before = known.join(late, "job_id", "left_anti")
            versions = spark.read.schema(f"{VERSIONS}, batch_id bigint").parquet(f"{out}/versions").filter(F.col("batch_id") < batch_id)
            rows.unionByName(versions.drop("batch_id").join(late, "job_id", "left_semi")).write.parquet(f"{held}/rows")
            rows = spark.read.schema(rows.schema).parquet(f"{held}/rows")
        rows = rows.withColumn("__fresh", F.lit(1)).unionByName(before.withColumn("__fresh", F.lit(0)), allowMissingColumns=True)

        # Equal statuses at one time tell nothing, and a known row tells nothing again.
        changes = OrderedScan(rows, ["job_id"], ["ts_us", "status", "__fresh"]).previous(prev_status="status").result()
        events = transition_rows(changes.filter("__fresh = 1"), scheduler_name)
        events.write.mode("overwrite").parquet(f"{out}/events/batch_id={batch_id}")

        seen = fresh.select("job_id", "ts_us", "status").unionByName(known)
        newest = latest_rows(seen, ["job_id"], [F.col("ts_us").desc(), F.col("status").desc()])
        keep_us = F.when(F.col("status").isin(*FINISHED), _or_ever(finished_us)).otherwise(_or_ever(idle_us))
        now_us = seen.select(F.max("ts_us")).scalar()
        newest.filter(F.col("ts_us") + keep_us >= now_us).write.mode("overwrite").parquet(f"{out}/last/batch_id={batch_id}")
    finally:
        remove(spark, held)
    drop_batch(spark, f"{out}/last", batch_id - 2)


def batch_transitions(spark: SparkSession, out: str) -> DataFrame:
    """The events that :func:`transition_batch` left, for each job from its last rewriting batch on."""
    events = spark.read.parquet(f"{out}/events")
    rewritten = spark.read.schema("job_id string, batch_id bigint").parquet(f"{out}/rewritten")
    rewritten = rewritten.groupBy("job_id").agg(F.max("batch_id").alias("__from"))
    return events.join(rewritten, "job_id", "left").filter(F.col("batch_id") >= F.coalesce("__from", F.lit(0))).drop("batch_id", "__from")


def transitions_by_batch(
    snapshots: DataFrame,
    out: str,
    checkpoint: str,
    scheduler_name: str = "unknown",
    seconds: int = COLLECTION_SECONDS,
    once: bool = False,
    finished_us: int | None = None,
    idle_us: int | None = None,
) -> StreamingQuery:
    def write(df: DataFrame, batch_id: int) -> None:
        transition_batch(df, batch_id, out, scheduler_name, finished_us, idle_us)

    writer = snapshots.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    timed = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")
    return timed.start()
