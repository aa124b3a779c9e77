"""Table statistics, recent rows, current rows and table quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobtide.functions.clock import MICROS_PER_MINUTE, retained, since
from jobtide.operators.cluster import latest


def _share_of(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def job_statistics(jobs: DataFrame) -> DataFrame:
    """Counts by outcome and the mean wait. Waits are summed as whole microseconds, so the mean is exact."""
    status, wait_us = F.col("status"), F.col("start_us") - F.col("submission_us")
    return jobs.agg(
        F.count("*").alias("total_jobs"),
        _share_of(status == "Succeeded").alias("succeeded_jobs"),
        _share_of(status == "Failed").alias("failed_jobs"),
        _share_of(status == "Running").alias("running_jobs"),
        _share_of(F.coalesce("oom_killed", F.lit(False))).alias("oom_jobs"),
        F.try_divide(F.sum(wait_us) / float(MICROS_PER_MINUTE), F.count(wait_us)).alias("avg_wait_time_minutes"),
    )


def cluster_statistics(states: DataFrame, as_of_us: Column | None = None, hours: int = 24) -> DataFrame:
    as_of_us = as_of_us if as_of_us is not None else latest(states, "ts_us")
    return states.filter(since(F.col("ts_us"), as_of_us, hours)).agg(
        F.count("*").alias("total_records"),
        F.avg("avg_cpu_utilization").alias("avg_cpu_util"),
        F.avg("avg_memory_utilization").alias("avg_mem_util"),
        F.max("running_jobs_count").alias("max_concurrent_jobs"),
    )


# The reported metrics and the statistic each one shows.
JOB_SUMMARY = {
    "total_jobs": "total_jobs",
    "succeeded_jobs": "succeeded_jobs",
    "failed_jobs": "failed_jobs",
    "oom_jobs": "oom_jobs",
    "avg_wait_time_minutes": "avg_wait_time_minutes",
}
CLUSTER_SUMMARY = {
    "avg_cpu_utilization": "avg_cpu_util",
    "avg_memory_utilization": "avg_mem_util",
    "max_concurrent_jobs": "max_concurrent_jobs",
}


def metrics_summary(jobs: DataFrame, states: DataFrame, as_of_us: Column | None = None) -> DataFrame:
    """Eight (metric, value) rows."""

    def rows(stats: DataFrame, names: dict[str, str]) -> DataFrame:
        wide = stats.select(*[F.col(c).cast("double").alias(name) for name, c in names.items()])
        return wide.unpivot([], list(names), "metric", "value")

    return rows(job_statistics(jobs), JOB_SUMMARY).unionByName(
        rows(cluster_statistics(states, as_of_us), CLUSTER_SUMMARY)
    )


def recent_jobs(jobs: DataFrame, limit: int = 100) -> DataFrame:
    return jobs.orderBy(F.col("submission_us").desc_nulls_last(), "job_id").limit(limit)


def cluster_history(states: DataFrame, as_of_us: Column | None = None, hours: int = 24) -> DataFrame:
    as_of_us = as_of_us if as_of_us is not None else latest(states, "ts_us")
    return states.filter(since(F.col("ts_us"), as_of_us, hours)).orderBy("ts_us", "id")


def latest_rows(versions: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """The newest version of each key. Spark cuts each map task's groups to one row before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*newest_first)
    return versions.withColumn("__rank", F.row_number().over(window)).filter("__rank = 1").drop("__rank")


def retention(df: DataFrame, days: int, as_of_us: Column | None = None, time_us: str = "ts_us") -> DataFrame:
    as_of_us = as_of_us if as_of_us is not None else latest(df, time_us)
    return df.filter(retained(F.col(time_us), as_of_us, days))


def orphan_events(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Scheduling events whose job is not in the job table."""
    return events.join(jobs.select("job_id"), "job_id", "left_anti")


def training_dataset(jobs: DataFrame, states: DataFrame, rows_per_segment: int | None = None) -> DataFrame:
    """Jobs with the cluster state nearest to their submission: one row per submitted job."""
    from jobtide.functions.clock import execution_minutes, wait_minutes
    from jobtide.operators.asof import asof_nearest

    taken = [
        "job_id", "name", "cpu_request", "memory_request", "priority", "job_type", "status",
        "oom_killed", "submission_us", "start_us", "completion_us",
    ]
    shown = [
        "available_cpu", "available_memory", "avg_cpu_utilization", "avg_memory_utilization",
        "queue_length", "running_jobs_count",
    ]
    near = asof_nearest(
        jobs.select(*taken), states, "job_id", "submission_us", "ts_us", "id", shown,
        rows_per_segment=rows_per_segment,
    )
    return near.select(
        "job_id",
        F.col("name").alias("job_name"),
        F.col("cpu_request").alias("job_cpu_request"),
        F.col("memory_request").alias("job_memory_request"),
        F.col("priority").alias("job_priority"),
        "job_type",
        F.col("available_cpu").alias("cluster_cpu_available"),
        F.col("available_memory").alias("cluster_memory_available"),
        F.col("avg_cpu_utilization").alias("cluster_cpu_utilization"),
        F.col("avg_memory_utilization").alias("cluster_memory_utilization"),
        F.col("queue_length").alias("cluster_queue_length"),
        F.col("running_jobs_count").alias("cluster_running_jobs"),
        F.col("status").alias("job_status"),
        F.when(F.col("status") == "Succeeded", 1).otherwise(0).alias("execution_success"),
        F.coalesce("oom_killed", F.lit(False)).cast("int").alias("oom_occurred"),
        F.timestamp_micros("submission_us").alias("submission_timestamp"),
        wait_minutes(F.col("submission_us"), F.col("start_us")).alias("wait_time_minutes"),
        execution_minutes(F.col("start_us"), F.col("completion_us")).alias("execution_time_minutes"),
    )
