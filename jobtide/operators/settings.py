"""Logged data beside what is configured. The configuration tables have a fixed number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_scenario(evaluation: DataFrame, scenarios: DataFrame, name: str = "scenario") -> DataFrame:
    """Evaluated scenarios with their settings, and the completed jobs for each job that was to arrive."""
    settings = scenarios.select(F.col("scenario").alias(name), "duration", "arrival_rate")
    rows = evaluation.join(F.broadcast(settings), name)
    return rows.withColumn("completed_share", F.try_divide("throughput", F.col("arrival_rate") * F.col("duration")))


def outside_type(jobs: DataFrame, job_types: DataFrame, job_type: str = "job_type") -> DataFrame:
    """Jobs of each configured type, and how many ask for less or more than the type allows.

    Expects cpu_millis, memory_mb and priority; the lower bound belongs to the range, the upper one does not.
    Types without jobs are listed with zeros, jobs of unknown types are not counted.
    """
    bounds = {"cpu_millis": "cpu", "memory_mb": "memory", "priority": "priority"}
    wrong = {c: (F.col(c) < F.col(f"{b}_low")) | (F.col(c) >= F.col(f"{b}_high")) for c, b in bounds.items()}
    types = job_types.withColumnRenamed("name", "__type").drop("priority")
    counted = jobs.join(F.broadcast(types), F.col(job_type) == F.col("__type")).groupBy("__type").agg(
        F.count("*").alias("jobs"), *[F.count_if(w).alias(f"{c}_outside") for c, w in wrong.items()]
    )
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("jobs", *[f"{c}_outside" for c in bounds])]
    return job_types.select(F.col("name").alias("__type")).join(counted, "__type", "left").select(F.col("__type").alias("job_type"), *zeros)


def transition_counts(changes: DataFrame, transitions: DataFrame) -> DataFrame:
    """How often each configured transition was seen; expects prev_status and status of each change."""
    pairs = changes.groupBy("prev_status", F.col("status").alias("new_status")).agg(F.count("*").alias("seen"))
    rows = transitions.join(pairs, ["prev_status", "new_status"], "left")
    return rows.select("event_type", F.coalesce("seen", F.lit(0)).alias("seen"))


def class_load(placements: DataFrame, nodes: DataFrame, classes: Sequence[str] = ("cpu_cores", "memory_gb")) -> DataFrame:
    """Placed jobs of each class of nodes, and what they asked for on average for each of its cores and GB."""

    def share(asked: str, size: str) -> Column:
        return F.try_divide(F.sum(asked), F.sum(size).cast("double"))

    rows = placements.join(F.broadcast(nodes.select("node_id", *classes)), "node_id")
    return rows.groupBy(*classes).agg(
        F.count("*").alias("jobs"), share("cpu_request", "cpu_cores").alias("cores_per_core"), share("memory_request", "memory_gb").alias("gib_per_gb")
    )
