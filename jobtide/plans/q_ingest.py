"""Manifests, quantities, node and pod predicates, cluster state rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions import quantities as q
from jobtide.functions import status as st
from jobtide.operators import cluster, manifests
from jobtide.plans import objects
from jobtide.plans.registry import query
from jobtide.plans.views import oracle, view

_COLLECTED = """case when event_id % 13 = 0 then 'Unknown' when status <> 'Pending' then status
             when event_id % 2 = 0 then 'Suspended' else 'Pending' end"""


@query(
    oracle(
        f"""select job_id, name, namespace, submission_us,
          case when event_id % 13 <> 0 then start_us end as start_us,
          case when event_id % 13 <> 0 then completion_us end as completion_us,
          cpu_request, memory_request, cpu_limit, memory_limit,
          case when user_id % 3 <> 0 then priority else 0 end as priority,
          case when user_id % 5 <> 0 then user_name else 'unknown' end as user_name,
          case when user_id % 4 <> 0 then queue_name else 'default' end as queue_name,
          {_COLLECTED} as status, job_type,
          cast(case when event_id % 13 <> 0 and status = 'Failed' then event_id % 3 + 1 else 0 end as int) as restart_count,
          (oom_killed and event_id % 11 <> 0) as oom_killed,
          (user_id % 3 <> 0 or user_id % 5 <> 0 or user_id % 4 <> 0 or job_type <> 'generic' or event_id % 2 = 0) as has_metadata
        from jobs where event_id % 17 <> 0""",
        "jobs",
    )
)
def normalize_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = manifests.normalize_jobs(objects.job_manifests(spark, sf_dir), objects.pod_snapshots(spark, sf_dir))
    times = {"submission_us": "submission_time", "start_us": "start_time", "completion_us": "completion_time"}
    jobs = jobs.withColumns({us: F.unix_micros(t) for us, t in times.items()})
    jobs = jobs.withColumn("has_metadata", F.col("metadata").isNotNull())
    return jobs.drop("snapshot_ts", "metadata", *times.values())


@query(oracle("select job_id, 'quantity' as defect from jobs where event_id % 17 = 0", "jobs"))
def quarantine_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.quarantined_jobs(objects.job_manifests(spark, sf_dir)).select("job_id", "defect")


@query(
    oracle(
        """select event_id, round(case when event_id % 17 = 0 then null else cpu_request end, 6) as cpu,
          round(case event_id % 5 when 0 then k * 0.25 when 1 then k * 1e9 / 1073741824
                when 2 then k * 1e6 / 1073741824 when 3 then 0.0 else null end, 6) as memory
        from (select j.*, e.k from jobs j join e on e.event_id = j.event_id) t""",
        "jobs",
    )
)
def parse_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = view(spark, sf_dir, "jobs")
    event, k = F.col("event_id"), F.get_json_object("metadata", "$.k").cast("int")
    memory = (
        F.when(event % 5 == 0, F.concat((k * 256).cast("string"), F.lit("Mi")))
        .when(event % 5 == 1, F.concat(k.cast("string"), F.lit("G")))
        .when(event % 5 == 2, F.concat(k.cast("string"), F.lit("M")))
        .when(event % 5 == 3, F.concat(k.cast("string"), F.lit("k")))
        .otherwise(F.concat(F.lit("x"), k.cast("string"), F.lit("Gi")))
    )
    return jobs.select(
        "event_id",
        F.round(q.parse_cpu(objects.cpu_text(F.col("cpu_request"), event)), 6).alias("cpu"),
        F.round(q.parse_memory(memory), 6).alias("memory"),
    )


@query(
    oracle(
        """select job_id, (oom_killed and event_id % 11 <> 0) as any_oom,
          (oom_killed and event_id % 11 <> 0 and event_id % 2 = 0) as current_oom from jobs""",
        "jobs",
    )
)
def job_oom_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both pod rules: killed now or before, and killed now."""
    pods = objects.pod_snapshots(spark, sf_dir)
    jobs = view(spark, sf_dir, "jobs").select("job_id", "name", "namespace")
    flagged = manifests.with_oom_flag(jobs, pods).withColumnRenamed("oom_killed", "any_oom")
    now = pods.withColumn(
        "container_statuses",
        F.transform("container_statuses", lambda c: F.struct(c["state"].alias("state"), c["state"].alias("last_state"))),
    )
    return manifests.with_oom_flag(flagged, now).select("job_id", "any_oom", F.col("oom_killed").alias("current_oom"))


@query(
    oracle(
        """select job_id, case when status = 'Pending' and event_id % 2 = 0 then 'Suspended'
            when event_id % 13 = 0 then 'Pending' else status end as monitor_status from jobs""",
        "jobs",
    )
)
def job_status_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objects.job_manifests(spark, sf_dir)
    rule = st.job_status_monitor(F.col("status"), F.col("spec"))
    return found.select(F.col("metadata.uid").alias("job_id"), rule.alias("monitor_status"))


_NODE_SUMS = """
  coalesce(sum(case when usable then 8.0 * (1 + node_id % 3) end), 0) as cpu_total,
  coalesce(sum(case when usable then 8.0 * (1 + node_id % 3) - 0.5 * (nk % 8) end), 0) as cpu_available,
  coalesce(sum(case when usable then 32.0 * (1 + node_id % 3) end), 0) as memory_total,
  coalesce(sum(case when usable then 32.0 * (1 + node_id % 3) - nk % 8 end), 0) as memory_available
"""
_NODES = """n as (
  select s_suppkey as node_id, s_nationkey as nk, s_nationkey % 5 as snapshot_id, s_suppkey % 10 <> 0 as ready,
    s_suppkey % 10 <> 0 and s_suppkey % 7 <> 0 as usable from supplier)"""


@query(
    f"""with {_NODES}, s as (select snapshot_id, {_NODE_SUMS},
          count(*) filter (where ready) as ready_nodes, count(*) as node_count from n group by snapshot_id)
    select cast(snapshot_id as bigint) as snapshot_id, cast(cpu_total as double) as cpu_total,
      cast(cpu_available as double) as cpu_available, cast(memory_total as double) as memory_total,
      cast(memory_available as double) as memory_available, ready_nodes, node_count,
      round(cast(greatest(cpu_total - cpu_available, 0) as double) / greatest(cpu_total, 1), 6) as avg_cpu_utilization,
      round(cast(greatest(memory_total - memory_available, 0) as double) / greatest(memory_total, 1), 6) as avg_memory_utilization
    from s"""
)
def cluster_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster.cluster_resources(objects.node_manifests(spark, sf_dir))
    rows = rows.withColumns({c: F.round(c, 6) for c in ("avg_cpu_utilization", "avg_memory_utilization")})
    return rows.withColumn("snapshot_id", F.unix_seconds("snapshot_ts")).drop("snapshot_ts")


@query(
    f"""with {_NODES} select concat('node-', node_id) as name, cast(snapshot_id as bigint) as snapshot_id,
      ready, usable as schedulable from n"""
)
def schedulable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.node_manifests(spark, sf_dir).select(
        "name",
        F.unix_seconds("snapshot_ts").alias("snapshot_id"),
        st.node_ready(F.col("conditions")).alias("ready"),
        st.node_schedulable(F.col("taints"), F.col("conditions")).alias("schedulable"),
    )


@query(
    oracle(
        """select namespace, cast(sum(case when status = 'Running' and event_id % 13 <> 0
             then user_id % 3 + 1 else 0 end) as bigint) as running_jobs from jobs group by namespace""",
        "jobs",
    )
)
def running_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objects.job_manifests(spark, sf_dir).withColumn("namespace", F.col("metadata.namespace"))
    return cluster.running_jobs(found, ["namespace"])


_OOM = "(reason like '%OOM%' or message like '%OutOfMemory%')"


@query(
    oracle(
        f"""select namespace, count(*) filter (where {_OOM}) as oom_events, count(*) as total_events,
          round(count(*) filter (where {_OOM}) / greatest(count(*), 1), 6) as oom_rate
        from cluster_events where event_us > (select max(event_us) from cluster_events) - 24 * 3600000000
        group by namespace""",
        "cluster_events",
    )
)
def recent_oom_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = cluster.recent_oom_rate(view(spark, sf_dir, "cluster_events"), hours=24, by=["namespace"])
    return rates.withColumn("oom_rate", F.round("oom_rate", 6))


_PENDING_WORKLOAD = "(event_id % 5 = 0 or event_id % 7 = 0 or event_id % 2 <> 0)"
_DAY = "submission_us - submission_us % 86400000000"


@query(
    oracle(
        f"""select job_id, name, namespace, cpu_request, memory_request,
          case when user_id % 3 <> 0 then priority else 0 end as priority, submission_us as arrival_us,
          cast(case when event_id % 2 = 0 then event_id % 90 else 30 end as double) as estimated_duration, job_type
        from jobs where status = 'Pending' and event_id % 2 = 0 and event_id % 17 <> 0
        union all
        select concat('wl-', event_id), concat('wl-', name), namespace,
          case when event_id % 4 <> 0 then cpu_request else 1 end,
          case when event_id % 4 <> 0 then memory_request else 1 end,
          case when event_id % 3 <> 0 then priority else 0 end, {_DAY}, 30, 'workload'
        from jobs where {_PENDING_WORKLOAD}""",
        "jobs",
    )
)
def all_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = manifests.all_pending(objects.job_manifests(spark, sf_dir), objects.workload_manifests(spark, sf_dir))
    queue = queue.withColumn("arrival_us", F.unix_micros("arrival_time"))
    return queue.drop("arrival_time", "labels", "annotations")


STATE_COLUMNS = [
    "pending_jobs_count", "running_jobs_count", "queue_length", "node_count", "total_cpu_capacity", "available_cpu",
    "total_memory_capacity", "available_memory", "avg_cpu_utilization", "avg_memory_utilization",
]
STATES_SQL = f"""
  with days as (
    select {_DAY} as day_us, cast(sum(case when status = 'Running' and event_id % 13 <> 0 then user_id % 3 + 1 else 0 end) as int) as running,
      cast(count(*) filter (where status = 'Pending' and event_id % 2 = 0 and event_id % 17 <> 0)
         + count(*) filter (where {_PENDING_WORKLOAD}) as int) as pending
    from jobs group by 1), {_NODES},
  dn as (select 1704067200000000 + node_id % 30 * 86400000000 as day_us, {_NODE_SUMS}, cast(count(*) filter (where ready) as int) as node_count from n group by 1)
  select cast(dn.day_us as bigint) as day_us, coalesce(pending, 0) as pending_jobs_count, coalesce(running, 0) as running_jobs_count,
    coalesce(pending, 0) as queue_length, node_count, cast(cpu_total as double) as total_cpu_capacity, cast(cpu_available as double) as available_cpu,
    cast(memory_total as double) as total_memory_capacity, cast(memory_available as double) as available_memory,
    round(cast(greatest(cpu_total - cpu_available, 0) as double) / greatest(cpu_total, 1), 9) as avg_cpu_utilization,
    round(cast(greatest(memory_total - memory_available, 0) as double) / greatest(memory_total, 1), 9) as avg_memory_utilization
  from dn left join days on days.day_us = dn.day_us"""


@query(oracle(STATES_SQL, "jobs"))
def cluster_state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes polled on each day, with that day's jobs and workloads."""
    jobs, workloads = objects.job_manifests(spark, sf_dir), objects.workload_manifests(spark, sf_dir)
    rows = cluster.cluster_state_rows(objects.daily_nodes(spark, sf_dir), jobs, workloads)
    rows = rows.withColumns({c: F.round(c, 9) for c in ("avg_cpu_utilization", "avg_memory_utilization")})
    return rows.select(F.unix_micros("timestamp").alias("day_us"), *STATE_COLUMNS)


@query(
    oracle(
        """select job_id, case when user_id % 3 <> 0 then cast(priority as varchar) end as label_priority,
          case when job_type <> 'generic' then job_type end as type_annotation
        from jobs where event_id % 17 <> 0""",
        "jobs",
    )
)
def unpack_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = manifests.normalize_jobs(objects.job_manifests(spark, sf_dir))
    parsed = manifests.unpack_metadata(F.col("metadata"))
    rows = jobs.select("job_id", parsed.alias("m"))
    return rows.select(
        "job_id",
        F.try_element_at("m.labels", F.lit("priority")).alias("label_priority"),
        F.try_element_at("m.annotations", F.lit("example.org/job-type")).alias("type_annotation"),
    )


@query(
    oracle(
        """select id, ts_us, metric_name, 'gauge' as metric_type, metric_value from (
          select id, ts_us, 'cluster_cpu_utilization' as metric_name, avg_cpu_utilization as metric_value from cluster_states
          union all select id, ts_us, 'cluster_memory_utilization', avg_memory_utilization from cluster_states
          union all select id, ts_us, 'cluster_running_jobs', running_jobs_count from cluster_states
          union all select id, ts_us, 'cluster_oom_rate', queue_length / 32.0 from cluster_states) t""",
        "cluster_states",
    )
)
def gauges_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = view(spark, sf_dir, "cluster_states").withColumn("oom_rate", F.col("queue_length") / 32.0)
    key = F.struct("id", "ts_us").alias("at")
    long = cluster.gauges_long(states.select("*", key), "at")
    return long.select("at.id", "at.ts_us", "metric_name", "metric_type", "metric_value")
