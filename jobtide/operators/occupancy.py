"""Resource use and queue length over time, rebuilt from job start and end times."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.encoding import at_least_one
from jobtide.operators.ordered import OrderedScan, cut_prefix_sums


def change_points(df: DataFrame, by: Sequence[str], begin: Column, end: Column, amounts: Mapping[str, Column]) -> DataFrame:
    """Net change of each amount per instant: added at ``begin``, taken away at ``end``.

    An interval that never began changes nothing; one that has not ended is never taken away.
    The sum per instant combines on the map side, so a busy instant costs no more than others.
    """

    def edge(at: Column, sign: int) -> Column:
        return F.struct(at.cast("bigint").alias("us"), *[(a * sign).alias(n) for n, a in amounts.items()])

    edges = df.filter(begin.isNotNull()).select(*by, F.explode(F.array(edge(begin, 1), edge(end, -1))).alias("edge"))
    edges = edges.select(*by, "edge.*").filter(F.col("us").isNotNull())
    return edges.groupBy(*by, "us").agg(*[F.sum(n).alias(n) for n in amounts])


#: Change points of a cut of the time line.
POINTS_PER_CUT = 500_000
MILLICORES, BYTES = 1_000, 1 << 30


def _cut_us(df: DataFrame, times: Sequence[str], points_per_cut: int) -> int:
    """Width of cuts that hold about so many change points each, and at least one cut per core of a large table."""
    first, last, n = df.agg(F.min(F.least(*times)), F.max(F.greatest(*times)), 2 * F.count("*")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    cuts = max(1, -(-n // points_per_cut), min(cores, n // 10_000))
    return 1 if first is None else int(last - first) // cuts + 1


def occupancy_history(
    placements: DataFrame,
    by: Sequence[str] = (),
    cpu_total: float | None = None,
    memory_total: float | None = None,
    points_per_cut: int = POINTS_PER_CUT,
) -> DataFrame:
    """Running jobs, cpu (cores) and memory (GiB) in use after every start or end.

    Amounts are added up as whole millicores and bytes, so that results do not depend on the order of sums.
    """
    whole = lambda c, unit: F.round(F.col(c) * unit).cast("bigint")
    amounts = {"cpu": whole("cpu_request", MILLICORES), "memory": whole("memory_request", BYTES), "jobs": F.lit(1).cast("bigint")}
    changes = change_points(placements, by, F.col("start_us"), F.col("completion_us"), amounts)
    cut_us = _cut_us(placements.filter("start_us is not null"), ["start_us", "completion_us"], points_per_cut)
    sums = {"__cpu": "cpu", "__memory": "memory", "running_jobs": "jobs"}
    history = cut_prefix_sums(changes, by, "us", sums, cut_us)
    cores, gib = (F.col("__cpu") / float(MILLICORES)).alias("cpu_used"), (F.col("__memory") / float(BYTES)).alias("memory_used")
    history = history.select(*by, "us", cores, gib, "running_jobs")
    if cpu_total:
        history = history.withColumn("cpu_utilization", F.col("cpu_used") / cpu_total)
    if memory_total:
        history = history.withColumn("memory_utilization", F.col("memory_used") / memory_total)
    return history


def queue_length_history(jobs: DataFrame, by: Sequence[str] = (), points_per_cut: int = POINTS_PER_CUT) -> DataFrame:
    """Waiting jobs after every submission or start."""
    changes = change_points(jobs, by, F.col("submission_us"), F.col("start_us"), {"change": F.lit(1).cast("bigint")})
    cut_us = _cut_us(jobs.filter("submission_us is not null"), ["submission_us", "start_us"], points_per_cut)
    return cut_prefix_sums(changes, by, "us", {"queue_length": "change"}, cut_us).select(*by, "us", "queue_length")


def first_tick_after(time: Column, tick: int) -> Column:
    """Number of the first tick strictly after ``time``."""
    return F.floor(time / tick).cast("bigint") + 1


def first_tick_from(time: Column, tick: int) -> Column:
    """Number of the first tick at or after ``time``."""
    return F.ceil(time / tick).cast("bigint")


def last_event(placements: DataFrame) -> Column:
    """The newest time of a log, as a scalar subquery."""
    times = [F.max(c) for c in ("submission_us", "start_us", "completion_us") if c in placements.columns]
    return placements.select(F.greatest(*times)).scalar()


#: Ticks of a block by which ranges and asked ticks meet.
BLOCK_TICKS = 8_640


def active_ranges(placements: DataFrame, tick_us: int, by: Sequence[str] = (), until_us: Column | None = None) -> DataFrame:
    """The ticks of a regular clock at which each job is active (start < tick < end), as one range of tick numbers.

    A started job without an end is active at every tick up to ``until_us`` (default: the last event
    of the log). Jobs that are active at no tick are left out. The range follows from a job's own times.
    """
    until_us = until_us if until_us is not None else last_event(placements)
    started = placements.filter(F.col("start_us").isNotNull()).withColumn("__until", until_us)
    first = first_tick_after(F.col("start_us"), tick_us)
    after = F.coalesce(first_tick_from(F.col("completion_us"), tick_us), first_tick_after(F.col("__until"), tick_us))
    ranges = started.select(*by, "job_id", first.alias("first_tick"), (after - 1).alias("last_tick"))
    return ranges.filter(F.col("first_tick") <= F.col("last_tick"))


def active_at(ranges: DataFrame, asked: DataFrame, by: Sequence[str] = (), block_ticks: int = BLOCK_TICKS) -> DataFrame:
    """(job, tick) rows for the tick numbers in ``asked`` (column ``tick``): who is active then.

    A range is listed under each block of ticks that it touches, and an asked tick looks its block up.
    """
    block = lambda tick: F.floor(F.col(tick) / F.lit(block_ticks)).cast("bigint")
    listed = ranges.withColumn("__block", F.explode(F.sequence(block("first_tick"), block("last_tick"))))
    looked = asked.select("tick").distinct().withColumn("__block", block("tick"))
    met = listed.join(looked, "__block").filter(F.col("tick").between(F.col("first_tick"), F.col("last_tick")))
    return met.select(*by, "job_id", "tick")


def active_at_tick(placements: DataFrame, tick_us: int, by: Sequence[str] = (), until_us: Column | None = None) -> DataFrame:
    """(job, tick) rows of all ticks: :func:`active_ranges` written out, which is as long as jobs run."""
    ranges = active_ranges(placements, tick_us, by, until_us)
    rows = ranges.select(*by, "job_id", F.explode(F.sequence("first_tick", "last_tick")).alias("tick"))
    return rows.select(*by, "job_id", (F.col("tick") * tick_us).alias("tick_us"))


def tick_changes(placements: DataFrame, tick_us: int, by: Sequence[str] = ()) -> DataFrame:
    """Change points moved to the ticks at which they become visible."""
    return change_points(
        placements,
        by,
        first_tick_after(F.col("start_us"), tick_us) * tick_us,
        first_tick_from(F.col("completion_us"), tick_us) * tick_us,
        {"cpu": F.col("cpu_request"), "memory": F.col("memory_request"), "jobs": F.lit(1)},
    )


def run_metrics(
    placements: DataFrame,
    cpu_total: float,
    memory_total: float,
    tick_us: int,
    by: Sequence[str] = ("run_id",),
) -> DataFrame:
    """Throughput, success rate, mean wait, mean utilisation and oom rate per run.

    The mean utilisation is the mean over the ticks from the run's first submission to its last
    event. How many ticks a job covers follows from its own times, so one aggregation suffices
    and no history is expanded. Jobs still running cover the ticks up to the end of the run.
    """
    start, end, submit = F.col("start_us"), F.col("completion_us"), F.col("submission_us")
    begins = first_tick_after(start, tick_us)
    covered = F.greatest(first_tick_from(end, tick_us) - begins, F.lit(0))
    unfinished = start.isNotNull() & end.isNull()

    def shares(name: str, amount: Column) -> list[Column]:
        return [
            F.coalesce(F.sum(amount * covered), F.lit(0.0)).alias(f"{name}_done"),
            F.coalesce(F.sum(F.when(unfinished, amount)), F.lit(0.0)).alias(f"{name}_open"),
            F.coalesce(F.sum(F.when(unfinished, amount * begins)), F.lit(0.0)).alias(f"{name}_open_from"),
        ]

    sums = placements.groupBy(*by).agg(
        F.count("*").alias("jobs"),
        F.count_if(F.col("status") == "Succeeded").alias("completed"),
        F.count_if(F.coalesce("oom_killed", F.lit(False))).alias("oom"),
        F.coalesce(F.sum(start - submit), F.lit(0)).alias("wait_us"),
        F.min(submit).alias("from_us"),
        F.max(F.greatest(submit, start, end)).alias("to_us"),
        *shares("cpu", F.col("cpu_request")),
        *shares("memory", F.col("memory_request")),
    )
    first, last = first_tick_after(F.col("from_us"), tick_us), F.floor(F.col("to_us") / tick_us).cast("bigint")
    ticks = F.greatest(last - first + 1, F.lit(0))

    def mean_share(name: str, total: float) -> Column:
        tick_sum = F.col(f"{name}_done") + F.col(f"{name}_open") * (last + 1) - F.col(f"{name}_open_from")
        return F.coalesce(F.try_divide(tick_sum, ticks * total), F.lit(0.0))

    jobs = at_least_one(F.col("jobs"))
    return sums.select(
        *by,
        F.try_divide("completed", (F.col("to_us") - F.col("from_us")) / 3.6e9).alias("throughput_per_hour"),
        (F.col("completed") / jobs).alias("success_rate"),
        (F.col("wait_us") / 1e6 / jobs).alias("avg_wait_time_s"),
        mean_share("cpu", cpu_total).alias("cpu_utilization"),
        mean_share("memory", memory_total).alias("memory_utilization"),
        (F.col("oom") / jobs).alias("oom_rate"),
    )


def outcome_totals(placements: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    return placements.groupBy(*by).agg(
        F.count_if(F.col("status") == "Succeeded").alias("completed_jobs"),
        F.count_if(F.col("status") == "Failed").alias("failed_jobs"),
        (F.sum(F.col("start_us") - F.col("submission_us")) / 1e6).alias("total_wait_s"),
        (
            F.sum(F.when(F.col("status") == "Succeeded", F.col("completion_us") - F.col("start_us"))) / 1e6
        ).alias("total_execution_s"),
        F.count_if(F.coalesce("oom_killed", F.lit(False))).alias("oom_events"),
    )


def node_states(nodes: DataFrame, placements: DataFrame, at_us: Column, run: Column | None = None) -> DataFrame:
    """Use of every node at one instant: jobs with start <= at < end count as running."""
    running = placements.filter(
        (F.col("start_us") <= at_us) & (F.col("completion_us").isNull() | (F.col("completion_us") > at_us))
    )
    if run is not None:
        running = running.filter(run)
    used = running.groupBy("node_id").agg(
        F.sum("cpu_request").alias("cpu_used"),
        F.sum("memory_request").alias("memory_used"),
        F.count("*").alias("running_jobs"),
    )
    joined = nodes.select("node_id", "cpu_total", "memory_total").join(used, "node_id", "left")
    cpu, memory = F.coalesce("cpu_used", F.lit(0.0)), F.coalesce("memory_used", F.lit(0.0))
    return joined.select(
        "node_id",
        F.try_divide(cpu, F.col("cpu_total")).alias("cpu_utilization"),
        F.try_divide(memory, F.col("memory_total")).alias("memory_utilization"),
        F.coalesce("running_jobs", F.lit(0)).alias("running_jobs"),
        (F.col("cpu_total") - cpu).alias("cpu_available"),
        (F.col("memory_total") - memory).alias("memory_available"),
    )


def running_totals(
    steps: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, str | Column], **options
) -> DataFrame:
    """Cumulative counters (completed jobs, waits, oom events) at each step."""
    return OrderedScan(steps, keys, order, **options).running_sum(**totals).result()
