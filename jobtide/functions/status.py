"""Job, pod, node and event predicates, and the two status rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.dims import TRANSITIONS


def _positive(count: Column) -> Column:
    return F.coalesce(count, F.lit(0)) > 0


def is_suspended(spec: Column) -> Column:
    return F.coalesce(spec["suspend"], F.lit(False))


def job_status(status: Column, spec: Column) -> Column:
    """Collector rule: the outcome counts win over the suspend flag."""
    return (
        F.when(status.isNull(), "Unknown")
        .when(_positive(status["succeeded"]), "Succeeded")
        .when(_positive(status["failed"]), "Failed")
        .when(_positive(status["active"]), "Running")
        .when(is_suspended(spec), "Suspended")
        .otherwise("Pending")
    )


def job_status_monitor(status: Column, spec: Column) -> Column:
    """Monitor rule: the suspend flag wins."""
    return (
        F.when(is_suspended(spec), "Suspended")
        .when(_positive(status["succeeded"]), "Succeeded")
        .when(_positive(status["failed"]), "Failed")
        .when(_positive(status["active"]), "Running")
        .otherwise("Pending")
    )


def event_type(prev_status: Column, new_status: Column) -> Column:
    """Name of a status transition, NULL for the ones that are not events."""
    names = F.create_map(*[F.lit(x) for a, b, name in TRANSITIONS for x in (f"{a}>{b}", name)])
    return F.try_element_at(names, F.concat(prev_status, F.lit(">"), new_status))


def workload_pending(spec: Column, status: Column) -> Column:
    return is_suspended(spec) | ~F.coalesce(status["admitted"], F.lit(False))


def _any(items: Column, test) -> Column:
    return F.coalesce(F.exists(items, test), F.lit(False))


def node_ready(conditions: Column) -> Column:
    return _any(
        conditions,
        lambda c: F.coalesce((c["type"] == "Ready") & (c["status"] == "True"), F.lit(False)),
    )


def node_schedulable(taints: Column, conditions: Column) -> Column:
    blocked = _any(taints, lambda t: F.coalesce(t["effect"].isin("NoSchedule", "NoExecute"), F.lit(False)))
    return ~blocked & node_ready(conditions)


def _oom_killed(state: Column) -> Column:
    return F.coalesce(state["terminated"]["reason"] == "OOMKilled", F.lit(False))


def pod_oom(container_statuses: Column) -> Column:
    """Killed for memory now or in the previous run of a container."""
    return _any(container_statuses, lambda c: _oom_killed(c["state"]) | _oom_killed(c["last_state"]))


def pod_oom_current(container_statuses: Column) -> Column:
    return _any(container_statuses, lambda c: _oom_killed(c["state"]))


def oom_event(reason: Column, message: Column) -> Column:
    return F.coalesce(reason.contains("OOM"), F.lit(False)) | F.coalesce(
        message.contains("OutOfMemory"), F.lit(False)
    )
