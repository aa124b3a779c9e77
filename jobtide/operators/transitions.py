"""Status transitions of jobs between snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.clock import wait_minutes
from jobtide.functions.status import event_type
from jobtide.operators.ordered import OrderedScan

RESOURCE_EFFICIENCY = 0.8  # fixed value: reported until real usage is known


def transition_rows(
    changes: DataFrame, scheduler_name: str = "unknown", efficiency: Column | None = None
) -> DataFrame:
    """Event rows for (prev_status, status) pairs that name a transition."""
    named = changes.withColumn("event_type", event_type(F.col("prev_status"), F.col("status")))
    pair = F.struct("prev_status", F.col("status").alias("new_status"))
    return named.filter(F.col("event_type").isNotNull()).select(
        F.col("ts_us").alias("timestamp_us"),
        "job_id",
        "event_type",
        F.lit(scheduler_name).alias("scheduler_name"),
        wait_minutes(F.col("submission_us"), F.col("start_us")).alias("queue_wait_time"),
        (efficiency if efficiency is not None else F.lit(RESOURCE_EFFICIENCY)).alias("resource_efficiency"),
        F.to_json(pair).alias("decision_metadata"),
    )


def status_transitions(
    snapshots: DataFrame,
    scheduler_name: str = "unknown",
    efficiency: Column | None = None,
    order: Sequence[str] = ("ts_us", "status"),
    rows_per_segment: int | None = None,
) -> DataFrame:
    """Compare each snapshot of a job with the one before it."""
    options = {"rows_per_segment": rows_per_segment} if rows_per_segment else {}
    scan = OrderedScan(snapshots, ["job_id"], order, **options).previous(prev_status="status")
    return transition_rows(scan.result(), scheduler_name, efficiency)
