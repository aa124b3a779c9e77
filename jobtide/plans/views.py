"""Telemetry tables derived from the given TPC-H-like tables.

Each view is one SQL text which Spark runs here and an oracle database can run as a CTE.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.operators.ordered import OrderedScan
from jobtide.session import durable

TABLES = ("events", "supplier", "orders")

SPARK_TERMS = {
    "@US@": "unix_micros(cast(ts as timestamp))",
    "@K@": "cast(get_json_object(props, '$.k') as int)",
}
ORACLE_TERMS = {
    "@US@": "epoch_us(ts)",
    "@K@": "cast(json_extract_string(props, '$.k') as int)",
}

VIEWS = {
    "e": "select event_id, user_id, event_type, value, props, @US@ as us, @K@ as k from {events}",
    "jobs": """
        select concat('job-', event_id) as job_id, concat(event_type, '-', event_id) as name,
          concat('ns-', user_id % 3) as namespace, us as submission_us,
          case when event_type <> 'signup'
               then us + cast(round(value * 100) as bigint) * 600000 end as start_us,
          case when event_type in ('purchase', 'click')
               then us + cast(round(value * 100) as bigint) * 600000
                    + (user_id % 60 + 1) * 60000000 end as completion_us,
          cast((user_id % 16 + 1) * 0.25 as double) as cpu_request, cast(k * 0.25 as double) as memory_request,
          cast((user_id % 16 + 1) * 0.5 as double) as cpu_limit, cast(k * 0.5 as double) as memory_limit,
          cast(user_id % 10 as int) as priority, concat('u', user_id) as user_name,
          concat('q', user_id % 4) as queue_name,
          case event_type when 'purchase' then 'Succeeded' when 'click' then 'Failed'
                          when 'view' then 'Running' else 'Pending' end as status,
          case event_id % 6 when 0 then 'spark' when 1 then 'ml' when 2 then 'batch'
                            when 3 then 'etl' when 4 then 'realtime' else 'generic' end as job_type,
          cast(case when event_type = 'click' then event_id % 3 else 0 end as int) as restart_count,
          (event_type = 'click' and event_id % 7 = 0) as oom_killed, props as metadata,
          event_id, user_id
        from {e} where event_type <> 'error'""",
    "cluster_states": """
        select event_id as id, us as ts_us, cast(64 as double) as total_cpu_capacity,
          cast(256 as double) as total_memory_capacity,
          cast(64 - user_id % 64 as double) as available_cpu, cast(256 - 2 * k as double) as available_memory,
          cast(user_id % 20 as int) as pending_jobs_count, cast(event_id % 50 as int) as running_jobs_count,
          cast(user_id % 20 as int) as queue_length, 8 as node_count,
          cast(user_id % 64 as double) / 64 as avg_cpu_utilization,
          cast(k as double) / 128 as avg_memory_utilization
        from {e} where event_type = 'error'""",
    "job_snapshots": """
        select job_id, submission_us as ts_us, 'Suspended' as status, submission_us, cast(null as bigint) as start_us from {jobs}
        union all select job_id, submission_us + 1, 'Pending', submission_us, cast(null as bigint) from {jobs}
        union all select job_id, start_us + 2, 'Running', submission_us, start_us from {jobs} where start_us is not null
        union all select job_id, completion_us + 3, status, submission_us, start_us from {jobs} where completion_us is not null""",
    "metric_samples": """
        select concat('sched-', user_id % 4) as scheduler, us as ts_us, event_id,
          cast(user_id % 60 as int) as jobs_pending, cast(event_id % 100 as int) as jobs_succeeded,
          cast(event_id % 9 as int) as jobs_failed, cast(k % 8 as int) as oom_incidents,
          cast(user_id % 64 as double) / 64 as cpu_utilization, cast(k as double) / 128 as memory_utilization
        from {e}""",
    "node_snapshots": """
        select s_suppkey as node_id, s_nationkey % 5 as snapshot_id,
          concat(cast(8 * (1 + s_suppkey % 3) * 1000 as int), 'm') as cpu_capacity,
          concat(cast(32 * (1 + s_suppkey % 3) as int), 'Gi') as memory_capacity,
          concat(cast(8 * (1 + s_suppkey % 3) * 1000 - 500 * (s_nationkey % 8) as int), 'm') as cpu_allocatable,
          concat(cast(1024 * (32 * (1 + s_suppkey % 3) - s_nationkey % 8) as int), 'Mi') as memory_allocatable,
          s_suppkey % 10 <> 0 as ready, s_suppkey % 7 = 0 as no_schedule
        from {supplier}""",
    "steps": """
        select user_id % 5 as scenario, case user_id % 3 when 0 then 'DQN' when 1 then 'PPO' else 'A2C' end as algorithm,
          user_id as episode, event_id, us,
          row_number() over (partition by user_id order by us, event_id) as step, value / 100 as reward,
          event_type <> 'view' as is_admit, event_type not in ('view', 'error') as admit_ok,
          cast(k % 12 as int) as queue_length, k
        from {e}""",
    "cluster_events": """
        select event_id, concat('ns-', user_id % 3) as namespace, us as event_us,
          case when event_id % 8 = 0 then 'OOMKilling' when event_id % 8 = 1 then 'Failed' else 'Scheduled' end as reason,
          case when event_id % 8 = 1 and k % 2 = 0 then 'OutOfMemory: killed' else event_type end as message
        from {e}""",
    "placements": """
        select concat('run-', user_id % 7) as run_id, job_id, job_type, cast(user_id % 16 as int) as node_id,
          cpu_request, memory_request, priority, submission_us, start_us, completion_us, status, oom_killed
        from {jobs}""",
    "pending_queue": """
        select cast(user_id % 5 as bigint) as snapshot_id, job_id, submission_us as arrival_us,
          cpu_request * 4 as cpu_request, memory_request, priority, job_type,
          cast(10 + event_id % 120 as double) as estimated_duration
        from {jobs} where status = 'Pending'""",
    "nodes": """
        select cast(snapshot_id as bigint) as snapshot_id, cast(node_id as bigint) as node_id,
          cast(8 * (1 + node_id % 3) as double) as cpu_total, cast(32 * (1 + node_id % 3) as double) as memory_total,
          cast(node_id % 8 as double) as cpu_used, cast(node_id % 32 as double) as memory_used
        from {node_snapshots}""",
}

# The same rows in one pass over the jobs.
SPARK_VIEWS = {
    "job_snapshots": """
        select job_id, snap.ts_us, snap.status, submission_us, snap.start_us from (
          select job_id, submission_us, explode(filter(array(
            named_struct('ts_us', submission_us, 'status', 'Suspended', 'start_us', cast(null as bigint)),
            named_struct('ts_us', submission_us + 1, 'status', 'Pending', 'start_us', cast(null as bigint)),
            named_struct('ts_us', start_us + 2, 'status', 'Running', 'start_us', start_us),
            named_struct('ts_us', completion_us + 3, 'status', status, 'start_us', start_us)
          ), s -> s.ts_us is not null)) as snap from {jobs})""",
}

DEPENDS = {name: re.findall(r"\{(\w+)\}", text) for name, text in VIEWS.items()}


def _fill(text: str, terms: dict[str, str]) -> str:
    for mark, term in terms.items():
        text = text.replace(mark, term)
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold times without a zone
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, sf_dir, name)
    if name == "steps":
        return _steps(spark, sf_dir)
    inputs = {dep: view(spark, sf_dir, dep) for dep in DEPENDS[name]}
    return spark.sql(_fill(SPARK_VIEWS.get(name, VIEWS[name]), SPARK_TERMS), **inputs)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``steps`` text, but numbered by a scan that splits a busy episode."""
    base = view(spark, sf_dir, "e").withColumn("episode", F.col("user_id"))
    numbered = durable(OrderedScan(base, ["episode"], ["us", "event_id"]).row_number("step").result())
    text = VIEWS["steps"].replace(
        "row_number() over (partition by user_id order by us, event_id) as step", "step"
    )
    return spark.sql(text, e=numbered)


def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for dep in DEPENDS[name]:
                visit(dep)
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def oracle(body: str, *names: str) -> str:
    """``body`` with the named views in front of it as CTEs."""
    ctes = []
    for name in _closure(names):
        text = _fill(VIEWS[name], ORACLE_TERMS)
        text = text.format(**{dep: dep for dep in DEPENDS[name]})
        ctes.append(f"{name} as ({text})")
    body = body.strip()
    if body.lower().startswith("with "):
        return "with " + ",\n".join(ctes) + ",\n" + body[5:]
    return "with " + ",\n".join(ctes) + "\n" + body
