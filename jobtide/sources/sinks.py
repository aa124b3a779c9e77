"""Writers. A batch with a number replaces its own earlier attempt, so a retry adds nothing twice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide import schemas
from jobtide.dims import RETENTION_DAYS
from jobtide.operators.stats import latest_rows, metrics_summary, training_dataset
from jobtide.session import remove
from jobtide.sources.buckets import BUCKETS, BucketTable
from jobtide.sources.tables import forget_files, index_batch

# What a missing field becomes on insert.
JOB_DEFAULTS = {
    "cpu_request": 0.0, "memory_request": 0.0, "cpu_limit": 0.0, "memory_limit": 0.0, "priority": 0,
    "user_name": "unknown", "queue_name": "default", "status": "Unknown", "job_type": "generic",
    "restart_count": 0, "oom_killed": False,
}
STATE_DEFAULTS = {
    "total_cpu_capacity": 0.0, "total_memory_capacity": 0.0, "available_cpu": 0.0, "available_memory": 0.0,
    "pending_jobs_count": 0, "running_jobs_count": 0, "queue_length": 0, "node_count": 0,
    "avg_cpu_utilization": 0.0, "avg_memory_utilization": 0.0,
}
EVENT_DEFAULTS = {"scheduler_name": "unknown"}
METRIC_DEFAULTS = {"metric_type": "gauge"}

MICROS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"  # text formats would drop the microseconds
TEXT = {"timestampFormat": MICROS_FORMAT, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def conform(df: DataFrame, schema: str, defaults: Mapping[str, object], extra: Sequence[str] = ()) -> DataFrame:
    """The columns of ``schema`` in order; missing columns and NULLs take their default."""
    columns = list(extra)
    for field in T.StructType.fromDDL(schema).fields:
        value: Column = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def _with_id(df: DataFrame, identity: Column) -> DataFrame:
    """Ids come from the row itself, so a recomputed task writes the same ones."""
    return df if "id" in df.columns else df.withColumn("id", identity)


def _append(df: DataFrame, path: str, batch_id: int | None, partition: str | None = None, indexed: str | None = None) -> None:
    """``indexed`` names the time by which scans find the files of a numbered batch."""
    writer = df.write
    if partition:
        writer = writer.partitionBy(partition)
    if batch_id is None:
        writer.mode("append").parquet(path)
    else:
        writer.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if indexed:
            index_batch(df.sparkSession, path, indexed, batch_id)


def drop_batch(spark: SparkSession, path: str, batch_id: int) -> None:
    """Remove one numbered batch folder which no reader needs any more."""
    if batch_id >= 0:
        remove(spark, f"{path}/batch_id={batch_id}")


def upsert_jobs(jobs: DataFrame, path: str, batch_id: int) -> None:
    """Append this batch's versions. Readers take the newest one per job; see :func:`compact_jobs`."""
    stamp = F.col("snapshot_ts") if "snapshot_ts" in jobs.columns else F.lit(None).cast("timestamp")
    rows = conform(jobs, schemas.JOBS, JOB_DEFAULTS, [stamp.alias("snapshot_ts")])
    _append(rows, path, batch_id, indexed="submission_time")


def compact_jobs(spark: SparkSession, path: str, new_path: str) -> None:
    """Write the current versions to a new folder; the old one stays as it is for running readers."""
    versions = spark.read.schema(f"snapshot_ts timestamp, {schemas.JOBS}, batch_id bigint").parquet(path)
    newest = [F.col("snapshot_ts").desc_nulls_last(), F.col("batch_id").desc()]
    current = latest_rows(versions, ["job_id"], newest).drop("batch_id")
    current.write.mode("errorifexists").parquet(f"{new_path}/batch_id=0")


def job_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> BucketTable:
    """The current version of each job, replaced in place: what :func:`upsert_jobs` keeps as versions."""
    return BucketTable(spark, path, f"snapshot_ts timestamp, {schemas.JOBS}", ["job_id"], ["snapshot_ts"], buckets)


def replace_jobs(jobs: DataFrame, path: str, batch_id: int, buckets: int = BUCKETS) -> None:
    stamp = F.col("snapshot_ts") if "snapshot_ts" in jobs.columns else F.lit(None).cast("timestamp")
    rows = conform(jobs, schemas.JOBS, JOB_DEFAULTS, [stamp.alias("snapshot_ts")])
    job_table(jobs.sparkSession, path, buckets).upsert(rows, batch_id)


def apply_retention(spark: SparkSession, path: str, days: int = RETENTION_DAYS, as_of: date | None = None) -> list[date]:
    """Remove the dates of a dated table that lie more than ``days`` before ``as_of`` (default: its newest date).

    Only folders are looked at, below the table or below its numbered batches. Returns the dates that went.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for pattern in ("date=*", "batch_id=*/date=*"):
        for status in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")) or []:
            name = status.getPath().getName().removeprefix("date=")
            if name != "__HIVE_DEFAULT_PARTITION__":
                found.append((date.fromisoformat(name), status.getPath()))
    newest = as_of or max((day for day, _ in found), default=None)
    old = [(day, folder) for day, folder in found if day < newest - timedelta(days=days)]
    for _, folder in old:
        files.delete(folder, True)
    forget_files(spark, path, [folder.toUri().getPath() for _, folder in old])
    return sorted({day for day, _ in old})


def append_cluster_states(states: DataFrame, path: str, batch_id: int | None = None) -> None:
    rows = conform(_with_id(states, F.unix_micros("timestamp")), schemas.CLUSTER_STATES, STATE_DEFAULTS)
    _append(rows.withColumn("date", F.to_date("timestamp")), path, batch_id, "date", indexed="timestamp")


def append_scheduling_events(events: DataFrame, path: str, batch_id: int | None = None) -> None:
    identity = F.xxhash64("job_id", "timestamp", "event_type")
    rows = conform(_with_id(events, identity), schemas.SCHEDULING_EVENTS, EVENT_DEFAULTS)
    _append(rows.withColumn("date", F.to_date("timestamp")), path, batch_id, "date")


def append_metrics(metrics: DataFrame, path: str, batch_id: int | None = None) -> None:
    rows = conform(_with_id(metrics, F.xxhash64("metric_name", "timestamp")), schemas.METRICS, METRIC_DEFAULTS)
    _append(rows.withColumn("date", F.to_date("timestamp")), path, batch_id, "date")


def write_training_csv(jobs: DataFrame, states: DataFrame, path: str) -> str | None:
    """Training rows as CSV with a header; nothing is written when either input is empty."""
    if jobs.isEmpty() or states.isEmpty():
        return None
    training_dataset(jobs, states).write.options(header=True, **TEXT).csv(path)
    return path


def write_metrics_summary_csv(jobs: DataFrame, states: DataFrame, path: str) -> str:
    metrics_summary(jobs, states).coalesce(1).write.option("header", True).csv(path)
    return path


def write_evaluation_results(flat: DataFrame, path: str) -> None:
    """One row per scenario and algorithm, as JSON and as CSV."""
    flat.write.options(**TEXT).json(f"{path}/json")
    flat.write.options(header=True, **TEXT).csv(f"{path}/csv")


def write_benchmark_json(comparison: DataFrame, path: str) -> None:
    """Rows as JSON; values JSON has no type for become text."""
    plain = (T.NumericType, T.BooleanType, T.StringType, T.ArrayType, T.StructType, T.MapType)
    columns = [
        F.col(f.name) if isinstance(f.dataType, plain) else F.col(f.name).cast("string").alias(f.name)
        for f in comparison.schema.fields
    ]
    comparison.select(*columns).write.json(path)


def write_trajectories(steps: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet keeps arrays and structs; CSV holds them as JSON text."""
    if not csv:
        steps.write.parquet(path)
        return
    nested = (T.ArrayType, T.StructType, T.MapType)
    columns = [
        F.to_json(f.name, TEXT).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in steps.schema.fields
    ]
    steps.select(*columns).write.options(header=True, **TEXT).csv(path)
