"""Which queued job fits on which node, and the one-shot choices made from that."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.operators.skew import join_lookup
from jobtide.operators.vectors import queue_top_k


def can_fit(cpu_available: Column, memory_available: Column, cpu_request: Column, memory_request: Column) -> Column:
    return (cpu_available >= cpu_request) & (memory_available >= memory_request)


def node_options(
    queue: DataFrame,
    nodes: DataFrame,
    k: int = 10,
    by: Sequence[str] = ("snapshot_id",),
    normalised_waste: bool = False,
) -> DataFrame:
    """Nodes with the fitting ones among the first ``k`` queued jobs of their snapshot as ``options``.

    The queue becomes one row per snapshot with at most ``k`` jobs; each node row meets exactly
    that row. The work is nodes times ``k``, and a snapshot with many nodes is split freely.
    """
    job = F.struct("queue_rank", "job_id", "cpu_request", "memory_request")
    heads = queue_top_k(queue, k, by).groupBy(*by).agg(F.sort_array(F.collect_list(job)).alias("jobs"))
    cpu, memory = F.col("cpu_total") - F.col("cpu_used"), F.col("memory_total") - F.col("memory_used")
    free = nodes.select(
        *by, "node_id", "cpu_total", "memory_total", cpu.alias("cpu_free"), memory.alias("memory_free")
    )
    cpu, memory = F.col("cpu_free"), F.col("memory_free")

    def option(j: Column) -> Column:
        cpu_left, memory_left = cpu - j["cpu_request"], memory - j["memory_request"]
        if normalised_waste:
            cpu_left, memory_left = F.try_divide(cpu_left, "cpu_total"), F.try_divide(memory_left, "memory_total")
        waste = (cpu_left + memory_left).alias("waste")
        return F.struct((j["queue_rank"] - 1).alias("job_idx"), j["job_id"].alias("job_id"), waste)

    fitting = F.filter("jobs", lambda j: can_fit(cpu, memory, j["cpu_request"], j["memory_request"]))
    options = join_lookup(free, heads, by).select(*by, "node_id", F.transform(fitting, option).alias("options"))
    return options.filter(F.size("options") > 0)


def fit_candidates(
    queue: DataFrame,
    nodes: DataFrame,
    k: int = 10,
    by: Sequence[str] = ("snapshot_id",),
    normalised_waste: bool = False,
) -> DataFrame:
    """Every fitting (job, node) pair among the first ``k`` queued jobs of a snapshot."""
    options = node_options(queue, nodes, k, by, normalised_waste)
    pairs = options.select(*by, "node_id", F.explode("options").alias("o"))
    return pairs.select(*by, "o.job_idx", "o.job_id", "node_id", "o.waste")


def _choose(options: DataFrame, by: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """The least option by ``rank``, first of each node and then of the snapshot."""

    def ranked(o: Column) -> Column:
        return F.struct(*[F.col("node_id") if name == "node_id" else o[name].alias(name) for name in rank])

    own = options.select(*by, F.array_min(F.transform("options", ranked)).alias("own"))
    return own.groupBy(*by).agg(F.min("own").alias("best")).select(*by, "best.*")


def best_fit(
    queue: DataFrame,
    nodes: DataFrame,
    k: int = 10,
    by: Sequence[str] = ("snapshot_id",),
    normalised_waste: bool = False,
) -> DataFrame:
    """The pair that leaves least over; among equals the first job, then the first node.

    ``k = 1`` only places the head of the queue.
    """
    options = node_options(queue, nodes, k, by, normalised_waste)
    best = _choose(options, by, ["waste", "job_idx", "node_id", "job_id"])
    return best.select(*by, "job_idx", "job_id", "node_id", "waste")


def first_fit(queue: DataFrame, nodes: DataFrame, k: int = 10, by: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    """The first fitting node of the first job that fits anywhere. ``k = 1`` only tries the head."""
    first = _choose(node_options(queue, nodes, k, by), by, ["job_idx", "node_id", "job_id"])
    return first.select(*by, "job_idx", "job_id", "node_id")
