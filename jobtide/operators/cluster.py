"""Cluster state rows from node, job and event snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions import quantities as q
from jobtide.functions import status as st
from jobtide.functions.clock import since
from jobtide.functions.encoding import at_least_one
from jobtide.operators.manifests import all_pending, in_queue, pending_workloads, unreadable_job, workload_job_info


def latest(df: DataFrame, time_us: str) -> Column:
    """The newest time of a table, as a scalar subquery."""
    return df.select(F.max(time_us)).scalar()


def resource_sums(nodes: DataFrame, by: Sequence[str] = ("snapshot_ts",)) -> DataFrame:
    """Capacity and allocatable over the schedulable nodes of a snapshot. The sums of parts add up to the whole."""

    def total(column: str, name: str, parse) -> Column:
        text = F.coalesce(F.try_element_at(F.col(column), F.lit(name)), F.lit("0"))
        usable = st.node_schedulable(F.col("taints"), F.col("conditions"))
        return F.coalesce(F.sum(F.when(usable, parse(text))), F.lit(0.0))

    return nodes.groupBy(*by).agg(
        total("capacity", "cpu", q.parse_cpu).alias("cpu_total"),
        total("allocatable", "cpu", q.parse_cpu).alias("cpu_available"),
        total("capacity", "memory", q.parse_memory).alias("memory_total"),
        total("allocatable", "memory", q.parse_memory).alias("memory_available"),
        F.count_if(st.node_ready(F.col("conditions"))).alias("ready_nodes"),
        F.count("*").alias("node_count"),
    )


def with_utilization(sums: DataFrame) -> DataFrame:
    def used_share(total_name: str, free_name: str) -> Column:
        used = F.greatest(F.col(total_name) - F.col(free_name), F.lit(0.0))
        return used / at_least_one(F.col(total_name))

    return sums.withColumns(
        {
            "avg_cpu_utilization": used_share("cpu_total", "cpu_available"),
            "avg_memory_utilization": used_share("memory_total", "memory_available"),
        }
    )


def cluster_resources(nodes: DataFrame, by: Sequence[str] = ("snapshot_ts",)) -> DataFrame:
    """Capacity, allocatable and utilisation over the schedulable nodes of a snapshot."""
    return with_utilization(resource_sums(nodes, by))


def running_jobs(manifests: DataFrame, by: Sequence[str] = ("snapshot_ts",)) -> DataFrame:
    """Active pods of all jobs."""
    active = F.coalesce(F.col("status")["active"], F.lit(0))
    return manifests.groupBy(*by).agg(F.sum(active).alias("running_jobs"))


def oom_counts(events: DataFrame, as_of_us: Column, hours: int = 1, by: Sequence[str] = (), time_us: str = "event_us") -> DataFrame:
    """Out-of-memory events and all events after ``as_of - hours``."""
    recent = events.filter(since(F.col(time_us), as_of_us, hours))
    is_oom = st.oom_event(F.col("reason"), F.col("message"))
    return recent.groupBy(*by).agg(F.count_if(is_oom).alias("oom_events"), F.count("*").alias("total_events"))


def oom_share() -> Column:
    return F.col("oom_events") / F.greatest("total_events", F.lit(1))


def recent_oom_rate(
    events: DataFrame,
    as_of_us: Column | None = None,
    hours: int = 1,
    by: Sequence[str] = (),
    time_us: str = "event_us",
) -> DataFrame:
    """Share of out-of-memory events among those after ``as_of - hours``."""
    as_of_us = as_of_us if as_of_us is not None else latest(events, time_us)
    return oom_counts(events, as_of_us, hours, by, time_us).withColumn("oom_rate", oom_share())


def cluster_state_rows(
    nodes: DataFrame,
    manifests: DataFrame,
    workloads: DataFrame,
    oom_rates: DataFrame | None = None,
) -> DataFrame:
    """One row per snapshot of nodes; pending counts the readable records of the queue.

    Every input is reduced to its snapshots before they are joined.
    """
    key = "snapshot_ts"
    pending = all_pending(manifests, workloads, keep=[key]).groupBy(key)
    pending = pending.agg(F.count("*").cast("int").alias("pending_jobs_count"))
    rows = cluster_resources(nodes).join(running_jobs(manifests), key, "left").join(pending, key, "left")
    rate: Column = F.lit(0.0)
    if oom_rates is not None:
        rows = rows.join(oom_rates.select(key, "oom_rate"), key, "left")
        rate = F.coalesce("oom_rate", F.lit(0.0))
    return _states(rows, rate)


def _states(rows: DataFrame, rate: Column, key: str = "snapshot_ts") -> DataFrame:
    queued = F.coalesce("pending_jobs_count", F.lit(0))
    return rows.select(
        F.col(key).alias("timestamp"),
        F.col("cpu_total").alias("total_cpu_capacity"),
        F.col("memory_total").alias("total_memory_capacity"),
        F.col("cpu_available").alias("available_cpu"),
        F.col("memory_available").alias("available_memory"),
        queued.alias("pending_jobs_count"),
        F.coalesce("running_jobs", F.lit(0)).cast("int").alias("running_jobs_count"),
        queued.alias("queue_length"),
        F.col("ready_nodes").cast("int").alias("node_count"),
        "avg_cpu_utilization",
        "avg_memory_utilization",
        F.to_json(
            F.struct(rate.alias("oom_rate"), F.col(key).cast("double").alias("collection_time"))
        ).alias("metadata"),
    )


POLL_SUMS = (
    "snapshot_ts timestamp, cpu_total double, cpu_available double, memory_total double, memory_available double, ready_nodes bigint, "
    "node_count bigint, running_jobs bigint, pending_jobs_count bigint, oom_events bigint, total_events bigint, jobs_seen bigint, errors bigint"
)
_SUMMED = [field.split()[0] for field in POLL_SUMS.split(", ")][1:]


def poll_sums(nodes: DataFrame, manifests: DataFrame, workloads: DataFrame, events: DataFrame) -> DataFrame:
    """What a part of the objects of some polls adds to their states: counts and sums that add up over parts.

    ``events`` carry ``event_us``; those of the hour before a poll count for it. Every kind is read once.
    """
    key = "snapshot_ts"
    meta, spec = F.col("metadata"), F.col("spec")
    jobs = manifests.groupBy(key).agg(
        F.sum(F.coalesce(F.col("status")["active"], F.lit(0))).alias("running_jobs"),
        F.count_if(in_queue(meta, spec)).alias("pending_jobs_count"),
        F.count("*").alias("jobs_seen"),
        F.count_if(unreadable_job(meta, spec)).alias("errors"),
    )
    queued = workload_job_info(pending_workloads(workloads), keep=[key]).groupBy(key).agg(F.count("*").alias("pending_jobs_count"))
    parts = [resource_sums(nodes), jobs, queued, oom_counts(events, F.unix_micros(key), by=[key])]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return merged_sums(rows)


def merged_sums(parts: DataFrame) -> DataFrame:
    """One row per poll from any number of parts."""
    kinds = dict(field.split() for field in POLL_SUMS.split(", "))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast(kinds[c]).alias(c) for c in _SUMMED]
    return parts.groupBy("snapshot_ts").agg(*sums)


def states_of_sums(sums: DataFrame) -> DataFrame:
    """Cluster states of the polls that hold nodes."""
    rows = with_utilization(sums.filter("node_count > 0"))
    return _states(rows, F.when(F.col("total_events") > 0, oom_share()).otherwise(0.0))


# Gauge names of the cluster snapshot.
GAUGES = {
    "avg_cpu_utilization": "cluster_cpu_utilization",
    "avg_memory_utilization": "cluster_memory_utilization",
    "running_jobs_count": "cluster_running_jobs",
    "oom_rate": "cluster_oom_rate",
}


def gauges_long(states: DataFrame, time: str = "timestamp") -> DataFrame:
    """Four gauge rows per snapshot; the oom rate comes from its own column or the metadata."""
    if "oom_rate" not in states.columns:
        rate = F.get_json_object("metadata", "$.oom_rate").try_cast("double")
        states = states.withColumn("oom_rate", rate)
    wide = states.select(time, *[F.col(c).cast("double").alias(name) for c, name in GAUGES.items()])
    long = wide.unpivot([time], list(GAUGES.values()), "metric_name", "metric_value")
    return long.withColumn("metric_type", F.lit("gauge"))


def node_balance(nodes: DataFrame, by: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    """Totals, ratios and the spread of cpu use over the nodes of a snapshot."""
    share = F.try_divide("cpu_used", "cpu_total")
    sums = nodes.groupBy(*by).agg(
        F.count("*").alias("nodes"),
        F.sum("cpu_total").alias("cpu_total"),
        F.sum("cpu_used").alias("cpu_used"),
        F.sum("memory_total").alias("memory_total"),
        F.sum("memory_used").alias("memory_used"),
        F.stddev_pop(share).alias("cpu_utilization_std"),
    )
    cpu, memory = F.try_divide("cpu_used", "cpu_total"), F.try_divide("memory_used", "memory_total")
    return sums.withColumns(
        {
            "cpu_utilization": cpu,
            "memory_utilization": memory,
            "cpu_available_ratio": F.try_divide(F.col("cpu_total") - F.col("cpu_used"), "cpu_total"),
            "memory_available_ratio": F.try_divide(F.col("memory_total") - F.col("memory_used"), "memory_total"),
        }
    )


def cluster_balance(nodes: DataFrame, running: DataFrame, pending: DataFrame, by: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    """Node totals of a snapshot with its running and pending jobs (one row each in the two inputs)."""
    rows = node_balance(nodes, by)
    for jobs, name in ((running, "running_jobs"), (pending, "pending_jobs")):
        counts = jobs.groupBy(*by).agg(F.count("*").alias(name))
        rows = rows.join(counts, list(by), "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows
