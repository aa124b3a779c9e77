"""Monitor samples, alerts, summaries and scheduler comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.operators import monitor
from jobtide.plans import objects
from jobtide.plans.registry import query
from jobtide.plans.views import oracle, view

_GAUGES = ["jobs_pending", "jobs_succeeded", "jobs_failed", "oom_incidents", "cpu_utilization", "memory_utilization"]
_LONG = "long as (" + " union all ".join(
    f"select scheduler, ts_us, event_id, '{g}' as metric, cast({g} as double) as value from metric_samples" for g in _GAUGES
) + ")"
_LAST = "{'ts_us': ts_us, 'event_id': event_id}"
_SCHEDULERS = ["sched-0", "sched-1", "sched-2", "sched-3"]


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "metric_samples")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.metrics_to_long(_samples(spark, sf_dir), ["scheduler", "ts_us", "event_id"], _GAUGES)


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "e")
    return events.select(
        F.concat(F.lit("sched-"), F.col("user_id") % 4).alias("scheduler"),
        (F.col("event_type") != "error").alias("accepted"),
    )


_SUBMISSIONS = "subs as (select concat('sched-', user_id % 4) as scheduler, event_type <> 'error' as accepted from e)"


@query(
    oracle(
        """select namespace, count(*) filter (where s = 'Pending') as jobs_pending,
          count(*) filter (where s = 'Running') as jobs_running, count(*) filter (where s = 'Succeeded') as jobs_succeeded,
          count(*) filter (where s = 'Failed') as jobs_failed, count(*) as jobs_total
        from (select namespace, case when status = 'Pending' and event_id % 2 = 0 then 'Suspended'
                when event_id % 13 = 0 then 'Pending' else status end as s from jobs) t group by namespace""",
        "jobs",
    )
)
def job_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objects.job_manifests(spark, sf_dir).withColumn("namespace", F.col("metadata.namespace"))
    return monitor.job_state_counts(found, ["namespace"])


@query(
    oracle(
        """select namespace, 2 * count(*) filter (where status = 'Running') as pods_running,
          2 * count(*) filter (where status = 'Pending') as pods_pending,
          2 * count(*) filter (where status = 'Failed') as pods_failed,
          2 * count(*) filter (where status = 'Succeeded') as pods_succeeded,
          count(*) filter (where oom_killed and event_id % 11 <> 0 and event_id % 2 = 0) as oom_incidents
        from jobs group by namespace""",
        "jobs",
    )
)
def pod_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.pod_state_counts(objects.pod_snapshots(spark, sf_dir), ["namespace"])


@query(
    """select cast(s_nationkey % 5 as bigint) as snapshot_id, count(*) as node_count,
      case when count(*) filter (where s_suppkey % 10 <> 0) = 0 then 1.0::double else 0.5::double end as cpu_utilization,
      case when count(*) filter (where s_suppkey % 10 <> 0) = 0 then 1.0::double else 0.5::double end as memory_utilization
    from supplier group by 1"""
)
def monitor_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = objects.node_manifests(spark, sf_dir).withColumn("snapshot_id", F.unix_seconds("snapshot_ts"))
    return monitor.monitor_utilization(nodes, ["snapshot_id"])


@query(oracle(f"with {_LONG} select scheduler, event_id, metric, value from long", "metric_samples"))
def monitor_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir).drop("ts_us")


@query(
    oracle(
        f"""with {_LONG} select scheduler, metric, count(*) as samples, round(avg(value), 6) as average,
          arg_max(value, {_LAST}) as latest from long group by scheduler, metric""",
        "metric_samples",
    )
)
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monitor.metric_summary(_samples(spark, sf_dir), _GAUGES, ["ts_us", "event_id"], ["scheduler"])
    return rows.withColumn("average", F.round("average", 6))


@query(oracle(f"with {_LONG} select metric, round(avg(value), 6) as average from long group by metric", "metric_samples"))
def metric_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monitor.metric_averages(_samples(spark, sf_dir), _GAUGES)
    return rows.withColumn("average", F.round("average", 6))


@query(oracle(f"with {_LONG} select metric, arg_max(value, {_LAST}) as latest from long group by metric", "metric_samples"))
def metric_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.metric_latest(_samples(spark, sf_dir), _GAUGES, ["ts_us", "event_id"])


_ALERTS = """alerts as (
  select scheduler, event_id, ts_us, 'high_oom_rate' as type, 'warning' as severity,
    concat('High OOM rate detected: ', oom_incidents, ' incidents') as message
  from metric_samples where oom_incidents > 5
  union all select scheduler, event_id, ts_us, 'queue_congestion', 'warning',
    concat('Queue congestion: ', jobs_pending, ' pending jobs') from metric_samples where jobs_pending > 50)"""


@query(oracle(f"with {_ALERTS} select event_id, ts_us, type, severity, message from alerts", "metric_samples"))
def threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.threshold_alerts(_samples(spark, sf_dir), ["event_id", "ts_us"])


@query(
    oracle(
        f"""with {_ALERTS}, {_LONG},
        t as (select scheduler, (max(ts_us) - min(ts_us)) / 1e6 as duration_s, count(*) as total_samples from long group by scheduler),
        f as (select scheduler, {", ".join(f"round(avg({g}), 6) as average_{g}, arg_max({g}, {_LAST}) as latest_{g}" for g in _GAUGES)}
          from metric_samples group by scheduler),
        a as (select scheduler, count(*) as n from alerts group by scheduler)
        select f.*, duration_s, total_samples, coalesce(n, 0) as events_detected
        from t join f on f.scheduler = t.scheduler left join a on a.scheduler = t.scheduler""",
        "metric_samples",
    )
)
def monitor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = monitor.threshold_alerts(_samples(spark, sf_dir), ["scheduler"])
    rows = monitor.monitor_summary(_samples(spark, sf_dir), alerts, _GAUGES, ["scheduler"], ["ts_us", "event_id"])
    return rows.withColumns({f"average_{g}": F.round(f"average_{g}", 6) for g in _GAUGES})


_COMPARISON = f"""with {_SUBMISSIONS},
s as (select scheduler, count(*) filter (where accepted) as submitted from subs group by scheduler),
f as (select scheduler, (max(ts_us) - min(ts_us)) / 1e6 as duration_s, arg_max(jobs_succeeded, {_LAST}) as succeeded,
  arg_max(jobs_failed, {_LAST}) as failed, arg_max(oom_incidents, {_LAST}) as oom_incidents,
  avg(jobs_pending) as avg_queue_length, avg(cpu_utilization) as cpu_utilization,
  avg(memory_utilization) as memory_utilization from metric_samples group by scheduler),
c as (select f.scheduler, round(succeeded / (duration_s / 3600), 6) as throughput,
  round(succeeded / greatest(coalesce(submitted, 0), 1) * 100, 6) as success_rate,
  round(failed / greatest(coalesce(submitted, 0), 1) * 100, 6) as failure_rate,
  round(avg_queue_length, 6) as avg_queue_length, oom_incidents, round(cpu_utilization, 6) as cpu_utilization,
  round(memory_utilization, 6) as memory_utilization from f left join s on s.scheduler = f.scheduler)
"""


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monitor.scheduler_comparison(_samples(spark, sf_dir), _submissions(spark, sf_dir), ["ts_us", "event_id"])
    doubles = [c for c in monitor.COMPARISON_METRICS if c != "oom_incidents"]
    return rows.withColumns({c: F.round(c, 6) for c in doubles})


@query(oracle(_COMPARISON + "select * from c", "metric_samples", "e"))
def scheduler_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparison(spark, sf_dir)


@query(
    oracle(
        _COMPARISON
        + ", l as ("
        + " union all ".join(
            f"select scheduler, '{m}' as metric, cast({m} as double) as value from c" for m in monitor.COMPARISON_METRICS
        )
        + ") select metric, "
        + ", ".join(f"max(value) filter (where scheduler = '{s}') as \"{s}\"" for s in _SCHEDULERS)
        + " from l group by metric",
        "metric_samples",
        "e",
    )
)
def comparison_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.comparison_matrix(_comparison(spark, sf_dir), "scheduler", _SCHEDULERS)


@query(
    oracle(
        f"""with {_SUBMISSIONS} select scheduler, count(*) filter (where accepted) as submitted,
        count(*) filter (where not accepted) as failed from subs group by scheduler""",
        "e",
    )
)
def submission_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.submission_audit(_submissions(spark, sf_dir), ["scheduler"])
