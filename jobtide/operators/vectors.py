"""Fixed and variable width state vectors of the waiting queue and the cluster."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobtide.functions.encoding import cluster_features, cluster_features_history, job_features, job_features_unclamped

JOB_WIDTH = 6
CLUSTER_WIDTH = 7


def priority_order() -> list[Column]:
    """Higher priority first, then earlier arrival, then id."""
    return [F.col("priority").desc(), F.col("arrival_us").asc(), F.col("job_id").asc()]


def queue_top_k(queue: DataFrame, k: int, by: Sequence[str] = ("snapshot_id",), order: Sequence[Column] | None = None) -> DataFrame:
    """The first ``k`` jobs of each snapshot. Map tasks keep at most ``k`` rows per snapshot."""
    window = Window.partitionBy(*by).orderBy(*(order or priority_order()))
    return queue.withColumn("queue_rank", F.row_number().over(window)).filter(F.col("queue_rank") <= k)


def _float_vector(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("float"))


def pad(values: Column, width: int) -> Column:
    """Zeros up to ``width``."""
    return F.concat(values, F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(values), F.lit(0))))


def pad_queue(
    queue: DataFrame, slots: Sequence[str], k: int, by: Sequence[str] = ("snapshot_id",), snapshots: DataFrame | None = None
) -> DataFrame:
    """Exactly ``k`` rows per snapshot: ranked jobs first, empty slots with zeros after them.

    ``snapshots`` lists the snapshots, so that one with an empty queue gets its slots too; without it
    the queue's own are taken.
    """
    ranked = queue_top_k(queue, k, by)
    item = F.struct(F.col("queue_rank").alias("slot"), *[F.col(c).cast("double").alias(c) for c in slots])
    rows = ranked.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("slots"))
    if snapshots is not None:
        none = F.array().cast(rows.schema["slots"].dataType)
        rows = snapshots.select(*by).distinct().join(rows, list(by), "left").withColumn("slots", F.coalesce("slots", none))

    def empty(slot: Column) -> Column:
        return F.struct(slot.cast("int").alias("slot"), *[F.lit(0.0).alias(c) for c in slots])

    free = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda slot: slot > F.size("slots"))
    rows = rows.withColumn("slot", F.explode(F.concat("slots", F.transform(free, empty))))
    return rows.select(*by, "slot.*")


def assemble(
    clusters: DataFrame,
    ranked: DataFrame,
    cluster_vector: Column,
    job_vector: Callable[[Column], Column],
    by: Sequence[str],
    slots: int | None,
) -> DataFrame:
    """Cluster slots followed by the vectors of the ranked jobs, padded when ``slots`` is given.

    ``ranked`` must hold a bounded number of jobs per snapshot, and ``clusters`` one row. The jobs of
    a snapshot are gathered where their ranking left them; one join brings in the cluster, and the
    job vectors are computed on the joined row.
    """
    attributes = [c for c in ranked.columns if c not in (*by, "queue_rank")]
    job = F.struct("queue_rank", *attributes)
    queues = ranked.groupBy(*by).agg(F.sort_array(F.collect_list(job)).alias("__queue"))
    queue = F.coalesce(F.flatten(F.transform("__queue", job_vector)), F.array().cast("array<double>"))
    vector = F.concat(cluster_vector, queue)
    if slots is not None:
        vector = pad(vector, CLUSTER_WIDTH + JOB_WIDTH * slots)
    return clusters.join(queues, list(by), "left").select(*by, _float_vector(vector).alias("state"))


def _live_cluster_vector() -> Column:
    return cluster_features(
        F.col("cpu_available"), F.col("cpu_total"), F.col("memory_available"), F.col("memory_total"),
        F.col("avg_cpu_utilization"), F.col("avg_memory_utilization"), F.col("running_jobs"), F.col("oom_rate"),
    )


def _live_job_vector(job: Column) -> Column:
    return job_features(
        job["cpu_request"], job["memory_request"], job["priority"], job["wait_min"], job["estimated_duration"],
        job["job_type"], F.col("cpu_total"), F.col("memory_total"),
    )


def _live_queue(queue: DataFrame, as_of_us: Column, k: int, by: Sequence[str]) -> DataFrame:
    wait = ((as_of_us - F.col("arrival_us")) / 6e7).alias("wait_min")
    attributes = ["cpu_request", "memory_request", "priority", "estimated_duration", "job_type"]
    return queue_top_k(queue, k, by).select(*by, "queue_rank", *attributes, wait)


def state_vector(
    queue: DataFrame, clusters: DataFrame, as_of_us: Column, k: int = 10, by: Sequence[str] = ("snapshot_id",)
) -> DataFrame:
    """7 + 6k floats per snapshot; unused slots are 0."""
    return assemble(clusters, _live_queue(queue, as_of_us, k, by), _live_cluster_vector(), _live_job_vector, by, k)


def _logged_cluster_vector() -> Column:
    return cluster_features_history(
        F.try_divide("cpu_available", "cpu_total"), F.try_divide("memory_available", "memory_total"),
        F.col("avg_cpu_utilization"), F.col("avg_memory_utilization"), F.col("running_jobs"), F.col("recent_cpu"), F.col("oom_events"),
    )


def _logged_job_vector(job_types: list[str] | None) -> Callable[[Column], Column]:
    """Cores, GiB, tenths of priority, hours waited, hours expected and the place of the job type."""

    def vector(job: Column) -> Column:
        return job_features_unclamped(
            job["cpu_request"] * 1000, job["memory_request"] * 1024, job["priority"], job["wait_min"] * 60,
            job["estimated_duration"] * 60, job["job_type"], job_types,
        )

    return vector


def state_vector_ragged(
    queue: DataFrame, clusters: DataFrame, as_of_us: Column, k: int = 50, by: Sequence[str] = ("snapshot_id",),
    job_types: list[str] | None = None,
) -> DataFrame:
    """The logged state: unclamped features, as many job slots as there are jobs, at most ``k``.

    ``clusters`` also holds recent_cpu (mean of the last samples) and oom_events.
    """
    return assemble(clusters, _live_queue(queue, as_of_us, k, by), _logged_cluster_vector(), _logged_job_vector(job_types), by, None)


def state_vector_padded(
    queue: DataFrame, clusters: DataFrame, as_of_us: Column, k: int = 50, by: Sequence[str] = ("snapshot_id",),
    job_types: list[str] | None = None,
) -> DataFrame:
    """The ragged vector padded to the longest possible queue."""
    return assemble(clusters, _live_queue(queue, as_of_us, k, by), _logged_cluster_vector(), _logged_job_vector(job_types), by, k)


def mean_queue_wait(queue: DataFrame, as_of_us: Column, by: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    """Mean minutes since arrival over all waiting jobs, summed as whole microseconds."""
    waited = F.sum(as_of_us - F.col("arrival_us"))
    return queue.groupBy(*by).agg(
        F.count("*").alias("queue_length"), (waited / 6e7 / F.count("*")).alias("avg_wait_min")
    )
