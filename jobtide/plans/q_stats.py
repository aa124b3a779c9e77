"""Training rows, table statistics, current rows and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions.clock import since
from jobtide.operators import stats
from jobtide.operators.cluster import latest
from jobtide.operators.transitions import status_transitions as transitions
from jobtide.plans.registry import query
from jobtide.plans.views import oracle, view

_NEAREST = """
with firsts as (select ts_us, min(id) as id from cluster_states group by ts_us),
before as (select j.job_id, s.id, j.submission_us - s.ts_us as d
           from jobs j asof join firsts s on j.submission_us >= s.ts_us),
later as (select j.job_id, s.id, s.ts_us - j.submission_us as d
          from jobs j asof join firsts s on j.submission_us <= s.ts_us),
best as (select job_id, arg_min(id, {'d': d, 'id': id}) as id
         from (select * from before union all select * from later) group by job_id)
select j.job_id, j.name as job_name, j.cpu_request as job_cpu_request, j.memory_request as job_memory_request,
  j.priority as job_priority, j.job_type, s.available_cpu as cluster_cpu_available,
  s.available_memory as cluster_memory_available, s.avg_cpu_utilization as cluster_cpu_utilization,
  s.avg_memory_utilization as cluster_memory_utilization, s.queue_length as cluster_queue_length,
  s.running_jobs_count as cluster_running_jobs, j.status as job_status,
  cast(j.status = 'Succeeded' as int) as execution_success, cast(j.oom_killed as int) as oom_occurred,
  make_timestamp(j.submission_us) as submission_timestamp,
  round((j.start_us - j.submission_us) / 6e7, 6) as wait_time_minutes,
  round((j.completion_us - j.start_us) / 6e7, 6) as execution_time_minutes
from jobs j join best b on j.job_id = b.job_id join cluster_states s on s.id = b.id
"""


# DuckDB reads braces as a struct here, and views.oracle fills braces only inside the views.
@query(oracle(_NEAREST, "jobs", "cluster_states"))
def training_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.training_dataset(view(spark, sf_dir, "jobs"), view(spark, sf_dir, "cluster_states"))
    return rows.withColumns(
        {
            "submission_timestamp": F.col("submission_timestamp").cast("timestamp_ntz"),
            "wait_time_minutes": F.round("wait_time_minutes", 6),
            "execution_time_minutes": F.round("execution_time_minutes", 6),
        }
    )


_JOB_STATS = """
  count(*) as total_jobs, cast(sum(case when status = 'Succeeded' then 1 else 0 end) as bigint) as succeeded_jobs,
  cast(sum(case when status = 'Failed' then 1 else 0 end) as bigint) as failed_jobs,
  cast(sum(case when status = 'Running' then 1 else 0 end) as bigint) as running_jobs,
  cast(sum(case when oom_killed then 1 else 0 end) as bigint) as oom_jobs,
  round(sum(start_us - submission_us) / 6e7 / count(start_us), 6) as avg_wait_time_minutes
"""
_CLUSTER_STATS = """
  count(*) as total_records, round(avg(avg_cpu_utilization), 6) as avg_cpu_util,
  round(avg(avg_memory_utilization), 6) as avg_mem_util, max(running_jobs_count) as max_concurrent_jobs
"""
_LAST_DAY = "ts_us > (select max(ts_us) from cluster_states) - 86400000000"


@query(oracle(f"select {_JOB_STATS} from jobs", "jobs"))
def job_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stats.job_statistics(view(spark, sf_dir, "jobs"))
    return df.withColumn("avg_wait_time_minutes", F.round("avg_wait_time_minutes", 6))


@query(oracle(f"select {_CLUSTER_STATS} from cluster_states where {_LAST_DAY}", "cluster_states"))
def cluster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stats.cluster_statistics(view(spark, sf_dir, "cluster_states"))
    return df.withColumns({c: F.round(c, 6) for c in ("avg_cpu_util", "avg_mem_util")})


@query(
    oracle(
        f"""with j as (select {_JOB_STATS} from jobs),
        c as (select {_CLUSTER_STATS} from cluster_states where {_LAST_DAY})
        select 'total_jobs' as metric, cast(total_jobs as double) as value from j
        union all select 'succeeded_jobs', succeeded_jobs from j
        union all select 'failed_jobs', failed_jobs from j
        union all select 'oom_jobs', oom_jobs from j
        union all select 'avg_wait_time_minutes', avg_wait_time_minutes from j
        union all select 'avg_cpu_utilization', avg_cpu_util from c
        union all select 'avg_memory_utilization', avg_mem_util from c
        union all select 'max_concurrent_jobs', max_concurrent_jobs from c""",
        "jobs",
        "cluster_states",
    )
)
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stats.metrics_summary(view(spark, sf_dir, "jobs"), view(spark, sf_dir, "cluster_states"))
    return df.withColumn("value", F.round("value", 6))


@query(
    oracle(
        "select job_id, status, submission_us from jobs order by submission_us desc nulls last, job_id limit 100",
        "jobs",
    )
)
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.recent_jobs(view(spark, sf_dir, "jobs").select("job_id", "status", "submission_us"))


@query(oracle(f"select id, ts_us, queue_length from cluster_states where {_LAST_DAY} order by ts_us, id", "cluster_states"))
def cluster_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cluster_history(view(spark, sf_dir, "cluster_states").select("id", "ts_us", "queue_length"))


@query(
    oracle(
        """select job_id, name, status, submission_us from jobs
        where submission_us > (select max(submission_us) from jobs) - 72 * 3600000000""",
        "jobs",
    )
)
def jobs_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = view(spark, sf_dir, "jobs").select("job_id", "name", "status", "submission_us")
    return jobs.filter(since(F.col("submission_us"), latest(jobs, "submission_us"), 72))


@query(
    oracle(
        """select id, ts_us from cluster_states
        where ts_us >= (select max(ts_us) from cluster_states) - 7 * 86400000000""",
        "cluster_states",
    )
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.retention(view(spark, sf_dir, "cluster_states").select("id", "ts_us"), 7)


@query(
    oracle(
        """select job_id, ts_us, status from job_snapshots
        qualify row_number() over (partition by job_id order by ts_us desc, status desc) = 1""",
        "job_snapshots",
    )
)
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = view(spark, sf_dir, "job_snapshots").select("job_id", "ts_us", "status")
    return stats.latest_rows(versions, ["job_id"], [F.col("ts_us").desc(), F.col("status").desc()])


TRANSITIONS_SQL = """
with changes as (
  select *, lag(status) over (partition by job_id order by ts_us, status) as prev from job_snapshots),
named as (
  select *, case when prev = 'Suspended' and status = 'Pending' then 'admitted'
                 when prev = 'Pending' and status = 'Running' then 'scheduled'
                 when prev = 'Running' and status = 'Succeeded' then 'completed'
                 when prev = 'Running' and status = 'Failed' then 'failed'
                 when prev = 'Pending' and status = 'Failed' then 'rejected' end as event_type
  from changes)
select ts_us as timestamp_us, job_id, event_type, 'unknown' as scheduler_name,
  round((start_us - submission_us) / 6e7, 6) as queue_wait_time, cast(0.8 as double) as resource_efficiency,
  concat('{"prev_status":"', prev, '","new_status":"', status, '"}') as decision_metadata
from named where event_type is not null
"""


@query(oracle(TRANSITIONS_SQL, "job_snapshots"))
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transitions(view(spark, sf_dir, "job_snapshots"))
    return rows.withColumn("queue_wait_time", F.round("queue_wait_time", 6))


@query(
    oracle(
        """select event_id, job_id from (select event_id, concat('job-', event_id) as job_id from e) t
        where job_id not in (select job_id from jobs)""",
        "e",
        "jobs",
    )
)
def orphan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error events have no job."""
    events = view(spark, sf_dir, "e").select("event_id", F.concat(F.lit("job-"), "event_id").alias("job_id"))
    return stats.orphan_events(events, view(spark, sf_dir, "jobs")).select("event_id", "job_id")
