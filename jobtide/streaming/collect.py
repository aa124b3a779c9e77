"""The collector as a file stream: job versions, cluster states, gauges, scheduling events, bad rows, audit.

A poll belongs together by its ``snapshot_ts``, however its files are spread over triggers. A batch reads
its own objects only: of each poll it writes what they add to it (sums and counts that add up over
batches), the job versions, and which jobs lost a pod for memory. Readers merge these parts, which are a
row per poll and batch, and look the pods of a job's newest version up; so the cost of a batch does not
grow with the age of the day or of a job, and results do not depend on files, triggers or their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobtide import schemas
from jobtide.dims import COLLECTION_SECONDS
from jobtide.operators.cluster import POLL_SUMS, gauges_long, merged_sums, poll_sums, states_of_sums
from jobtide.operators.manifests import defective, killed_jobs, normalized_jobs, readable
from jobtide.session import remove, scratch
from jobtide.sources import sinks, tables
from jobtide.sources.snapshots import objects, with_event_time
from jobtide.streaming.transitions import batch_transitions, transition_batch

KILLS = "snapshot_ts timestamp, namespace string, job_name string"
QUARANTINE = "snapshot_ts timestamp, job_id string, name string, namespace string, defect string"
TOTALS = "jobs_collected bigint, errors bigint, collected_us bigint"
_KINDS = ["job", "workload", "node", "pod", "event"]


def collect_batch(polls: DataFrame, batch_id: int, out: str) -> None:
    """Write one micro-batch. Every write replaces an earlier attempt of the same batch.

    Beside its own objects a batch reads the last status of each job, and the versions of jobs that it
    has late versions of (see :func:`transition_batch`).
    """
    spark = polls.sparkSession
    polls.persist()
    held = scratch(spark, "manifests")
    try:
        jobs, workloads, nodes, pods, events = (objects(polls, k) for k in _KINDS)
        normalized_jobs(jobs).write.parquet(held)
        flat = spark.read.schema(f"snapshot_ts timestamp, {schemas.JOBS}, defect string").parquet(held)
        seen, failed = Observation(f"jobs {batch_id}"), Observation(f"errors {batch_id}")
        parts = {
            "partials": poll_sums(nodes, jobs, workloads, with_event_time(events)),
            "kills": killed_jobs(pods, ["snapshot_ts", "namespace"]),
            "quarantine": defective(flat).observe(failed, F.count(F.lit(1)).alias("errors")),
        }
        for name, rows in parts.items():
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        told = [F.count(F.lit(1)).alias("jobs_collected"), F.max(F.unix_micros("snapshot_ts")).alias("collected_us")]
        sinks.upsert_jobs(readable(flat).observe(seen, *told), f"{out}/jobs", batch_id)
        totals = [(seen.get["jobs_collected"], failed.get["errors"], seen.get["collected_us"])]
        spark.createDataFrame(totals, TOTALS).coalesce(1).write.mode("overwrite").parquet(f"{out}/totals/batch_id={batch_id}")
    finally:
        polls.unpersist()
        remove(spark, held)
    versions = spark.read.schema(f"snapshot_ts timestamp, {schemas.JOBS}").parquet(f"{out}/jobs/batch_id={batch_id}")
    times = [F.unix_micros(c).alias(n) for c, n in (("snapshot_ts", "ts_us"), ("submission_time", "submission_us"), ("start_time", "start_us"))]
    transition_batch(versions.select("job_id", "status", *times), batch_id, f"{out}/transitions")


def collected_jobs(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of each job; a job is killed if a pod of its poll was killed for memory."""
    kills = spark.read.schema(KILLS).parquet(f"{out}/kills").distinct()
    kills = kills.select("snapshot_ts", "namespace", F.col("job_name").alias("name"), F.lit(True).alias("__killed"))
    jobs = tables.scan_current_jobs(spark, f"{out}/jobs").join(kills, ["snapshot_ts", "namespace", "name"], "left")
    return jobs.withColumn("oom_killed", F.coalesce("__killed", "oom_killed")).drop("__killed")


def _merged(spark: SparkSession, out: str) -> DataFrame:
    return merged_sums(spark.read.schema(POLL_SUMS).parquet(f"{out}/partials"))


def collected_states(spark: SparkSession, out: str) -> DataFrame:
    states = states_of_sums(_merged(spark, out)).withColumn("id", F.unix_micros("timestamp"))
    return sinks.conform(states, schemas.CLUSTER_STATES, sinks.STATE_DEFAULTS)


def collected_metrics(spark: SparkSession, out: str) -> DataFrame:
    """Four gauges for each collected state."""
    gauges = gauges_long(collected_states(spark, out)).withColumn("id", F.xxhash64("metric_name", "timestamp"))
    return sinks.conform(gauges, schemas.METRICS, sinks.METRIC_DEFAULTS)


def collected_audit(spark: SparkSession, out: str) -> DataFrame:
    return _merged(spark, out).select(
        "snapshot_ts",
        (F.col("jobs_seen") - F.col("errors")).alias("jobs_collected"),
        (F.col("node_count") > 0).cast("bigint").alias("states_collected"),
        "errors",
        F.unix_micros("snapshot_ts").alias("collected_us"),
    )


def collected_totals(spark: SparkSession, out: str) -> DataFrame:
    """Jobs and errors of each batch as its own writes counted them; no pass over the objects is made for them."""
    return spark.read.schema(TOTALS).parquet(f"{out}/totals")


def collected_quarantine(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(QUARANTINE).parquet(f"{out}/quarantine")


def collected_events(spark: SparkSession, out: str) -> DataFrame:
    """Scheduling events as the last batch that had to say something about their job left them."""
    events = batch_transitions(spark, f"{out}/transitions").withColumn("timestamp", F.timestamp_micros("timestamp_us"))
    events = events.withColumn("id", F.xxhash64("job_id", "timestamp", "event_type"))
    return sinks.conform(events, schemas.SCHEDULING_EVENTS, sinks.EVENT_DEFAULTS)


def _newest(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Of rows written by several batches, those of the newest batch of each key."""
    rows = spark.read.schema(f"{schema}, batch_id bigint").parquet(path)
    newest = rows.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, [*keys, "batch_id"], "left_semi").drop("batch_id")


def _trigger(writer, seconds: int, once: bool):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")


def collect_stream(
    polls: DataFrame, out: str, checkpoint: str, seconds: int = COLLECTION_SECONDS, once: bool = False
) -> StreamingQuery:
    writer = polls.writeStream.foreachBatch(lambda df, batch: collect_batch(df, batch, out))
    return _trigger(writer.option("checkpointLocation", checkpoint), seconds, once).start()


def append_stream(
    rows: DataFrame, out: str, checkpoint: str, seconds: int = COLLECTION_SECONDS, once: bool = False
) -> StreamingQuery:
    """Append rows as they are (cluster states, alerts, transitions)."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", out)
    return _trigger(writer.option("checkpointLocation", checkpoint), seconds, once).start()


def update_stream(
    rows: DataFrame, out: str, checkpoint: str, seconds: int = COLLECTION_SECONDS, once: bool = False,
    told: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Keep each batch's changed aggregates in a folder of its own; :func:`updated` reads the newest of each key.

    ``told`` makes further rows of what a batch changed (alerts), which are written in the same trigger;
    :func:`told_rows` reads those that still hold.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        if told is not None:
            changed = df.sparkSession.read.schema(df.schema).parquet(f"{out}/batch_id={batch_id}")
            told(changed).write.mode("overwrite").parquet(f"{out}-told/batch_id={batch_id}")

    writer = rows.writeStream.outputMode("update").foreachBatch(write)
    return _trigger(writer.option("checkpointLocation", checkpoint), seconds, once).start()


def updated(spark: SparkSession, out: str, schema: str, keys: list[str]) -> DataFrame:
    return _newest(spark, out, schema, keys)


def told_rows(spark: SparkSession, out: str, schema: str, told_schema: str, keys: list[str]) -> DataFrame:
    """What was told of the newest state of each key. What an older state told stays in its batch's folder."""
    newest = spark.read.schema(f"{schema}, batch_id bigint").parquet(out).groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    told = spark.read.schema(f"{told_schema}, batch_id bigint").parquet(f"{out}-told")
    return told.join(newest, [*keys, "batch_id"], "left_semi").drop("batch_id")


def compact_updates(spark: SparkSession, out: str, schema: str, keys: list[str], upto: int, told_schema: str | None = None) -> None:
    """Put the newest rows of the batches up to ``upto``, and what they told, into the folders of that batch.

    To be run while no batch is written and no reader reads.
    """
    whole = {out: spark.read.schema(f"{schema}, batch_id bigint").parquet(out).filter(F.col("batch_id") <= upto)}
    newest = whole[out].groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    if told_schema:
        whole[f"{out}-told"] = spark.read.schema(f"{told_schema}, batch_id bigint").parquet(f"{out}-told").filter(F.col("batch_id") <= upto)
    batches = [r[0] for r in whole[out].select("batch_id").distinct().collect() if r[0] < upto]
    held = {path: scratch(spark, "compact") for path in whole}
    for path, rows in whole.items():
        rows.join(newest, [*keys, "batch_id"], "left_semi").drop("batch_id").write.parquet(held[path])
    for path, rows in whole.items():
        spark.read.schema(rows.drop("batch_id").schema).parquet(held[path]).write.mode("overwrite").parquet(f"{path}/batch_id={upto}")
        for batch in batches:
            sinks.drop_batch(spark, path, batch)
        remove(spark, held[path])


def status_totals(jobs: DataFrame) -> DataFrame:
    """Running totals per status, refreshed as a whole on every trigger."""
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"))


def refresh_stream(rows: DataFrame, out: str, checkpoint: str, seconds: int = 60, once: bool = False) -> StreamingQuery:
    """Keep the newest whole result of an aggregation in a folder per refresh; :func:`refreshed` reads it."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return _trigger(rows.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint), seconds, once).start()


def refreshed(spark: SparkSession, out: str, schema=None) -> DataFrame:
    if schema is None:
        refreshes = spark.read.parquet(out)
    else:
        refreshes = spark.read.schema(schema.add("batch_id", "long")).parquet(out)
    newest = refreshes.select(F.max("batch_id")).scalar()
    return refreshes.filter(F.col("batch_id") == newest).drop("batch_id")


def status_refresh(
    jobs: DataFrame, out: str, checkpoint: str, seconds: int = 60, once: bool = False
) -> StreamingQuery:
    """Keep the newest totals in a folder per refresh."""
    return refresh_stream(status_totals(jobs).coalesce(1), out, checkpoint, seconds, once)
