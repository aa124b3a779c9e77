"""Rewards, action decoding and episode end conditions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.dims import REWARD_WEIGHTS
from jobtide.functions.encoding import at_least_one, at_most_one


def live_reward(
    queue_reduction: Column,
    utilization: Column,
    queue_length: Column,
    avg_wait_min: Column,
    admit_failed: Column,
    has_snapshot: Column,
    weights: Mapping[str, float | Column] = REWARD_WEIGHTS,
) -> Column:
    """Clipped to [-1, 1]; -1 without a snapshot; the wait only counts while jobs are queued."""
    waiting = F.when(queue_length > 0, at_most_one(avg_wait_min / 60.0)).otherwise(0.0)
    raw = (
        F.greatest(queue_reduction, F.lit(0)) * weights["throughput"]
        + utilization * weights["utilization"]
        - F.coalesce(waiting, F.lit(0.0)) * weights["wait_penalty"]
        - F.when(admit_failed, 1.0).otherwise(0.0) * weights["failure_penalty"]
    )
    return F.when(has_snapshot, F.greatest(F.least(raw, F.lit(1.0)), F.lit(-1.0))).otherwise(-1.0)


def immediate_reward(
    success: Column,
    completed: Column,
    elapsed_s: Column,
    cpu_utilization: Column,
    memory_utilization: Column,
    total_wait_s: Column,
    total_jobs: Column,
    weights: Mapping[str, float | Column] = REWARD_WEIGHTS,
) -> Column:
    avg_wait = total_wait_s / at_least_one(total_jobs)
    earned = (
        completed / at_least_one(elapsed_s) * weights["throughput"]
        + (cpu_utilization + memory_utilization) / 2.0 * weights["utilization"]
        - at_most_one(avg_wait / 3600.0) * weights["wait_penalty"]
    )
    return F.when(success, earned).otherwise(-1.0)


# Rewards of an action that names no job or node, and of one that does not fit.
INVALID_ACTION_REWARD = -0.1
UNFIT_ACTION_REWARD = -0.5


def placement_reward(
    valid: Column,
    fits: Column,
    wait_s: Column,
    node_cpu_utilization: Column,
    node_memory_utilization: Column,
    cpu_utilization_std: Column,
    priority: Column,
) -> Column:
    earned = (
        F.lit(0.1)
        - at_most_one(wait_s / 3600.0) * 0.2
        + (node_cpu_utilization + node_memory_utilization) / 2.0 * 0.3
        + (F.lit(1.0) - cpu_utilization_std) * 0.2
        + priority / 10.0 * 0.1
    )
    return F.when(~valid, INVALID_ACTION_REWARD).when(~fits, UNFIT_ACTION_REWARD).otherwise(earned)


def decode_action(action: Column, nodes: Column | int) -> Column:
    nodes = nodes if isinstance(nodes, Column) else F.lit(nodes)
    return F.struct(
        F.floor(action / nodes).cast("int").alias("job_idx"), (action % nodes).cast("int").alias("node_idx")
    )


def classify_action(action: Column, queue_length: Column, max_queue: int = 10) -> Column:
    return F.when((action >= queue_length) | (action == max_queue), "wait").otherwise("admit")


# Limits of one episode.
MIN_STEPS, MAX_STEPS, MAX_SECONDS = 20, 200, 600


def is_terminated(queue_length: Column, step: Column) -> Column:
    return (queue_length == 0) & (step > MIN_STEPS)


def is_truncated(step: Column, elapsed_s: Column) -> Column:
    return (step >= MAX_STEPS) | (elapsed_s > MAX_SECONDS)
