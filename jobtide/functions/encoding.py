"""Scalar features of jobs and clusters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.dims import JOB_TYPE_CODES, JOB_TYPES, UNKNOWN_JOB_TYPE_CODE


def at_most_one(x: Column) -> Column:
    return F.least(x, F.lit(1.0))


def at_least_one(x: Column) -> Column:
    return F.greatest(x, F.lit(1.0))


def encode_job_type(job_type: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in JOB_TYPE_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, job_type), F.lit(UNKNOWN_JOB_TYPE_CODE))


def encode_job_type_ordinal(job_type: Column, known: list[str] | None = None) -> Column:
    """Position in the configured list over its length; unknown is 0."""
    names = known or [row[0] for row in JOB_TYPES]
    position = F.array_position(F.array(*[F.lit(n) for n in names]), job_type)
    return F.greatest(F.coalesce(position, F.lit(0)) - 1, F.lit(0)) / float(len(names))


def cluster_utilization(cpu: Column, memory: Column) -> Column:
    return F.coalesce((cpu + memory) / 2.0, F.lit(0.0))


def job_features(
    cpu: Column,
    memory: Column,
    priority: Column,
    wait_min: Column,
    duration_min: Column,
    job_type: Column,
    cpu_total: Column,
    memory_total: Column,
) -> Column:
    """Six features clamped to one; a missing snapshot counts as 100 units of each resource."""
    cpu_scale, memory_scale = F.coalesce(cpu_total, F.lit(100.0)), F.coalesce(memory_total, F.lit(100.0))
    return F.array(
        at_most_one(F.coalesce(F.try_divide(cpu, cpu_scale), F.lit(1.0))),
        at_most_one(F.coalesce(F.try_divide(memory, memory_scale), F.lit(1.0))),
        at_most_one(priority / 10.0),
        at_most_one(wait_min / 60.0),
        at_most_one(duration_min / 120.0),
        encode_job_type(job_type),
    )


def job_features_unclamped(
    cpu_millicores: Column,
    memory_mb: Column,
    priority: Column,
    wait_s: Column,
    duration_s: Column,
    job_type: Column,
    job_types: list[str] | None = None,
) -> Column:
    return F.array(
        cpu_millicores / 1000.0,
        memory_mb / 1024.0,
        priority / 10.0,
        wait_s / 3600.0,
        duration_s / 3600.0,
        encode_job_type_ordinal(job_type, job_types),
    )


def _ratios(cpu_available: Column, cpu_total: Column, memory_available: Column, memory_total: Column) -> list[Column]:
    return [cpu_available / at_least_one(cpu_total), memory_available / at_least_one(memory_total)]


def cluster_features(
    cpu_available: Column,
    cpu_total: Column,
    memory_available: Column,
    memory_total: Column,
    cpu_utilization: Column,
    memory_utilization: Column,
    running_jobs: Column,
    oom_rate: Column,
) -> Column:
    """Four resource slots and three history slots of the live state."""
    return F.array(
        *_ratios(cpu_available, cpu_total, memory_available, memory_total),
        cpu_utilization,
        memory_utilization,
        at_most_one(running_jobs / 100.0),
        cpu_utilization,
        oom_rate,
    )


def cluster_features_history(
    cpu_available_ratio: Column,
    memory_available_ratio: Column,
    cpu_utilization: Column,
    memory_utilization: Column,
    running_jobs: Column,
    recent_cpu: Column,
    oom_events: Column,
    total_jobs: Column | None = None,
) -> Column:
    """The logged variant: oom events over 100, or over the job count when that is given."""
    oom = oom_events / 100.0
    if total_jobs is not None:
        oom = F.when(total_jobs > 0, F.try_divide(oom_events, total_jobs)).otherwise(0.0)
    return F.array(
        cpu_available_ratio,
        memory_available_ratio,
        cpu_utilization,
        memory_utilization,
        running_jobs / 100.0,
        F.coalesce(recent_cpu, F.lit(0.0)),
        oom,
    )
