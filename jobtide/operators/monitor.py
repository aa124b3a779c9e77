"""Monitor samples: state counts, alerts, summaries and scheduler comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions import status as st
from jobtide.functions.encoding import at_least_one

# A sample above these limits raises an alert.
OOM_LIMIT, PENDING_LIMIT = 5, 50


def job_state_counts(jobs: DataFrame, by: Sequence[str], status: Column | None = None) -> DataFrame:
    """Counts of four states; suspended jobs only count in the total."""
    status = status if status is not None else st.job_status_monitor(F.col("status"), F.col("spec"))
    named = jobs.withColumn("__status", status)
    counts = [
        F.count_if(F.col("__status") == name).alias(f"jobs_{name.lower()}")
        for name in ("Pending", "Running", "Succeeded", "Failed")
    ]
    return named.groupBy(*by).agg(*counts, F.count("*").alias("jobs_total"))


def pod_state_counts(pods: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = [
        F.count_if(F.col("phase") == name).alias(f"pods_{name.lower()}")
        for name in ("Running", "Pending", "Failed", "Succeeded")
    ]
    oom = F.count_if(st.pod_oom_current(F.col("container_statuses"))).alias("oom_incidents")
    return pods.groupBy(*by).agg(*counts, oom)


def monitor_utilization(nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each ready node counts as one unit with half of it free."""
    ready = F.count_if(st.node_ready(F.col("conditions"))).cast("double")
    sums = nodes.groupBy(*by).agg(F.count("*").alias("node_count"), ready.alias("ready"))
    share = 1.0 - F.col("ready") * 0.5 / at_least_one(F.col("ready"))
    return sums.select(*by, "node_count", share.alias("cpu_utilization"), share.alias("memory_utilization"))


def metrics_to_long(wide: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(metric, value) rows; NULL values are dropped."""
    doubles = wide.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return doubles.unpivot(list(ids), list(metrics), "metric", "value").filter(F.col("value").isNotNull())


def threshold_alerts(samples: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per sample and exceeded limit. Works on batches and on streams."""

    def alert(condition: Column, name: str, message: Column) -> Column:
        return F.when(
            condition,
            F.struct(F.lit(name).alias("type"), F.lit("warning").alias("severity"), message.alias("message")),
        )

    oom, pending = F.col("oom_incidents"), F.col("jobs_pending")
    alerts = F.array(
        alert(oom > OOM_LIMIT, "high_oom_rate", F.format_string("High OOM rate detected: %d incidents", oom)),
        alert(pending > PENDING_LIMIT, "queue_congestion", F.format_string("Queue congestion: %d pending jobs", pending)),
    )
    found = F.explode(F.filter(alerts, lambda a: a.isNotNull()))
    return samples.select(*ids, found.alias("alert")).select(*ids, "alert.*")


def newest(value: str | Column, order: Sequence[str]) -> Column:
    """The value at the highest order, which is one number or two whole numbers.

    Two are packed into one decimal: a number as order keeps the aggregation hash-based.
    """
    first, *rest = [F.col(c) for c in order]
    for other in rest:
        first = first.cast("decimal(38, 0)") * F.lit("1" + "0" * 19).cast("decimal(20, 0)") + other.cast("decimal(20, 0)")
    return F.max_by(value, first.cast("decimal(38, 0)") if rest else first)


def metric_summary(wide: DataFrame, metrics: Sequence[str], order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Samples, average and latest value per metric. Wide rows are aggregated once, only the result is unpivoted."""
    figures = {"samples": lambda m: F.count(m), "average": lambda m: F.avg(m), "latest": lambda m: newest(m, order)}
    columns = [figure(F.col(m).cast("double")).alias(f"{name}_{m}") for m in metrics for name, figure in figures.items()]
    rows = (wide.groupBy(*by) if by else wide).agg(*columns)
    items = [F.struct(F.lit(m).alias("metric"), *[F.col(f"{name}_{m}").alias(name) for name in figures]) for m in metrics]
    long = rows.select(*by, F.explode(F.array(*items)).alias("item")).select(*by, "item.*")
    return long.filter(F.col("samples") > 0)


def metric_averages(wide: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    rows = (wide.groupBy(*by) if by else wide).agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])
    return metrics_to_long(rows, by, metrics).withColumnRenamed("value", "average")


def metric_latest(wide: DataFrame, metrics: Sequence[str], order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    rows = (wide.groupBy(*by) if by else wide).agg(*[newest(F.col(m).cast("double"), order).alias(m) for m in metrics])
    return metrics_to_long(rows, by, metrics).withColumnRenamed("value", "latest")


def monitor_summary(
    wide: DataFrame, alerts: DataFrame, metrics: Sequence[str], by: Sequence[str], order: Sequence[str], time_us: str = "ts_us"
) -> DataFrame:
    """Duration in seconds, collected values, raised alerts, and average and latest value of each metric per run."""
    totals = wide.groupBy(*by).agg(
        ((F.max(time_us) - F.min(time_us)) / 1e6).alias("duration_s"),
        sum((F.count(m) for m in metrics), F.lit(0)).alias("total_samples"),
        *[F.avg(m).alias(f"average_{m}") for m in metrics],
        *[newest(m, order).alias(f"latest_{m}") for m in metrics],
    )
    raised = alerts.groupBy(*by).agg(F.count("*").alias("events_detected"))
    joined = totals.join(raised, list(by), "left")
    return joined.withColumn("events_detected", F.coalesce("events_detected", F.lit(0)))


COMPARISON_METRICS = [
    "throughput", "success_rate", "failure_rate", "avg_queue_length",
    "oom_incidents", "cpu_utilization", "memory_utilization",
]


def scheduler_comparison(
    samples: DataFrame, submissions: DataFrame, order: Sequence[str], key: str = "scheduler", time_us: str = "ts_us"
) -> DataFrame:
    """Seven figures per scheduler from its wide samples and its accepted submissions."""
    figures = samples.groupBy(key).agg(
        ((F.max(time_us) - F.min(time_us)) / 1e6).alias("duration_s"),
        newest("jobs_succeeded", order).alias("succeeded"),
        newest("jobs_failed", order).alias("failed"),
        newest("oom_incidents", order).alias("oom_incidents"),
        F.avg("jobs_pending").alias("avg_queue_length"),
        F.avg("cpu_utilization").alias("cpu_utilization"),
        F.avg("memory_utilization").alias("memory_utilization"),
    )
    submitted = submissions.groupBy(key).agg(F.count_if("accepted").alias("submitted"))
    joined = figures.join(submitted, key, "left")
    jobs = at_least_one(F.coalesce("submitted", F.lit(0)))
    return joined.select(
        key,
        F.try_divide("succeeded", F.col("duration_s") / 3600.0).alias("throughput"),
        (F.col("succeeded") / jobs * 100).alias("success_rate"),
        (F.col("failed") / jobs * 100).alias("failure_rate"),
        "avg_queue_length",
        "oom_incidents",
        "cpu_utilization",
        "memory_utilization",
    )


def comparison_matrix(comparison: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """One row per metric and one column per scheduler."""
    long = metrics_to_long(comparison, [key], COMPARISON_METRICS)
    return long.groupBy("metric").pivot(key, list(values)).agg(F.first("value"))


def submission_audit(submissions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return submissions.groupBy(*by).agg(
        F.count_if("accepted").alias("submitted"), F.count_if(~F.col("accepted")).alias("failed")
    )


def collection_audit(batches: DataFrame) -> DataFrame:
    """Totals over the per-batch audit rows which the collector writes."""
    return batches.agg(
        F.coalesce(F.sum("jobs_collected"), F.lit(0)).alias("jobs_collected"),
        F.coalesce(F.sum("states_collected"), F.lit(0)).alias("states_collected"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
        F.max("collected_us").alias("last_collection_us"),
    )
