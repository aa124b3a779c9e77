"""Use of cluster resources over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.operators import cluster, occupancy
from jobtide.plans.registry import query
from jobtide.plans.views import oracle, view

TICK_US = 600_000_000  # ten minutes
CPU_TOTAL, MEMORY_TOTAL = 288.0, 1152.0


@query(
    oracle(
        """with d as (
          select start_us as us, cpu_request as c, memory_request as m, 1 as j from placements where start_us is not null
          union all select completion_us, -cpu_request, -memory_request, -1 from placements
            where start_us is not null and completion_us is not null),
        g as (select us, sum(c) as c, sum(m) as m, sum(j) as j from d group by us)
        select us, sum(c) over w as cpu_used, sum(m) over w as memory_used, cast(sum(j) over w as bigint) as running_jobs,
          round((sum(c) over w) / 288, 6) as cpu_utilization, round((sum(m) over w) / 1152, 6) as memory_utilization
        from g window w as (order by us rows unbounded preceding)""",
        "placements",
    )
)
def occupancy_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = occupancy.occupancy_history(
        view(spark, sf_dir, "placements"), cpu_total=CPU_TOTAL, memory_total=MEMORY_TOTAL
    )
    return rows.withColumns({c: F.round(c, 6) for c in ("cpu_utilization", "memory_utilization")})


@query(
    oracle(
        """with d as (
          select run_id, submission_us as us, 1 as c from placements
          union all select run_id, start_us, -1 from placements where start_us is not null),
        g as (select run_id, us, sum(c) as c from d group by run_id, us)
        select run_id, us, cast(sum(c) over (partition by run_id order by us rows unbounded preceding) as bigint) as queue_length
        from g""",
        "placements",
    )
)
def queue_length_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupancy.queue_length_history(view(spark, sf_dir, "placements"), ["run_id"])


@query(
    oracle(
        f"""with b as (select run_id, count(*) as jobs, count(*) filter (where status = 'Succeeded') as completed,
            count(*) filter (where oom_killed) as oom, coalesce(sum(start_us - submission_us), 0) as wait_us,
            min(submission_us) as from_us,
            max(greatest(submission_us, coalesce(start_us, 0), coalesce(completion_us, 0))) as to_us
          from placements group by run_id),
        t as (select run_id, unnest(range(from_us // {TICK_US} + 1, to_us // {TICK_US} + 1)) * {TICK_US} as tick from b),
        h as (select t.run_id, t.tick, coalesce(sum(p.cpu_request), 0) as cpu, coalesce(sum(p.memory_request), 0) as mem
          from t left join placements p on p.run_id = t.run_id and p.start_us < t.tick
            and (p.completion_us is null or p.completion_us > t.tick) group by t.run_id, t.tick),
        m as (select run_id, sum(cpu) / (count(*) * 288) as cpu, sum(mem) / (count(*) * 1152) as mem from h group by run_id)
        select b.run_id, round(completed / ((to_us - from_us) / 3.6e9), 6) as throughput_per_hour,
          round(completed / greatest(jobs, 1), 6) as success_rate, round(wait_us / 1e6 / greatest(jobs, 1), 4) as avg_wait_time_s,
          round(m.cpu, 6) as cpu_utilization, round(m.mem, 6) as memory_utilization, round(oom / greatest(jobs, 1), 6) as oom_rate
        from b join m on m.run_id = b.run_id""",
        "placements",
    )
)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = occupancy.run_metrics(view(spark, sf_dir, "placements"), CPU_TOTAL, MEMORY_TOTAL, TICK_US)
    places = {c: 4 if c == "avg_wait_time_s" else 6 for c in rows.columns if c != "run_id"}
    return rows.withColumns({c: F.round(c, n) for c, n in places.items()})


@query(
    oracle(
        """select run_id, count(*) filter (where status = 'Succeeded') as completed_jobs,
          count(*) filter (where status = 'Failed') as failed_jobs, round(sum(start_us - submission_us) / 1e6, 4) as total_wait_s,
          round(sum(completion_us - start_us) filter (where status = 'Succeeded') / 1e6, 4) as total_execution_s,
          count(*) filter (where oom_killed) as oom_events from placements group by run_id""",
        "placements",
    )
)
def outcome_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = occupancy.outcome_totals(view(spark, sf_dir, "placements"))
    return rows.withColumns({c: F.round(c, 4) for c in ("total_wait_s", "total_execution_s")})


_ACTIVE = f"""with log as (select max(greatest(submission_us, start_us, completion_us)) as until from placements),
  active as (select job_id, unnest(range(start_us // {TICK_US} + 1,
    coalesce((completion_us + {TICK_US} - 1) // {TICK_US}, until // {TICK_US} + 1))) as tick
    from placements, log where start_us is not null)"""


@query(
    oracle(
        f"""with log as (select max(greatest(submission_us, start_us, completion_us)) as until from placements)
        select job_id, unnest(range(start_us // {TICK_US} + 1,
          coalesce((completion_us + {TICK_US} - 1) // {TICK_US}, until // {TICK_US} + 1))) * {TICK_US} as tick_us
        from placements, log where start_us is not null""",
        "placements",
    )
)
def active_at_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (job, tick) rows."""
    return occupancy.active_at_tick(view(spark, sf_dir, "placements"), TICK_US)


@query(
    oracle(
        f"""{_ACTIVE} select job_id, min(tick) as first_tick, max(tick) as last_tick, count(*) as ticks from active group by job_id""",
        "placements",
    )
)
def active_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (job, tick) rows run-length encoded; the oracle writes every tick out and counts."""
    rows = occupancy.active_ranges(view(spark, sf_dir, "placements"), TICK_US)
    return rows.withColumn("ticks", F.col("last_tick") - F.col("first_tick") + 1)


_ASKED_SECONDS = 6 * 3600


@query(
    oracle(
        f"""{_ACTIVE} select job_id, tick * {TICK_US} as tick_us from active where tick * {TICK_US} % {_ASKED_SECONDS * 1_000_000} = 0""",
        "placements",
    )
)
def active_at_asked_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is active at the ticks of every sixth hour."""
    placements, asked_us = view(spark, sf_dir, "placements"), _ASKED_SECONDS * 1_000_000
    step = asked_us // TICK_US
    ranges = occupancy.active_ranges(placements, TICK_US)
    ends = ranges.agg(F.ceil(F.min("first_tick") / step).alias("a"), F.floor(F.max("last_tick") / step).alias("b")).filter("a <= b")
    asked = ends.select(F.explode(F.sequence("a", "b")).alias("number")).select((F.col("number") * step).alias("tick"))
    return occupancy.active_at(ranges, asked).select("job_id", (F.col("tick") * TICK_US).alias("tick_us"))


@query(
    oracle(
        """with r as (select user_id % 5 as snapshot_id, count(*) as n from jobs where status = 'Running' group by 1),
        p as (select snapshot_id, count(*) as n from pending_queue group by 1)
        select nodes.snapshot_id, coalesce(any_value(r.n), 0) as running_jobs, coalesce(any_value(p.n), 0) as pending_jobs,
          count(*) as nodes, sum(cpu_total) as cpu_total, sum(cpu_used) as cpu_used,
          sum(memory_total) as memory_total, sum(memory_used) as memory_used,
          round(stddev_pop(cpu_used / cpu_total), 6) as cpu_utilization_std,
          round(sum(cpu_used) / sum(cpu_total), 6) as cpu_utilization, round(sum(memory_used) / sum(memory_total), 6) as memory_utilization,
          round((sum(cpu_total) - sum(cpu_used)) / sum(cpu_total), 6) as cpu_available_ratio,
          round((sum(memory_total) - sum(memory_used)) / sum(memory_total), 6) as memory_available_ratio
        from nodes left join r on r.snapshot_id = nodes.snapshot_id left join p on p.snapshot_id = nodes.snapshot_id
        group by nodes.snapshot_id""",
        "nodes",
        "jobs",
        "pending_queue",
    )
)
def cluster_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = view(spark, sf_dir, "jobs").filter("status = 'Running'").withColumn("snapshot_id", (F.col("user_id") % 5).cast("bigint"))
    rows = cluster.cluster_balance(view(spark, sf_dir, "nodes"), running, view(spark, sf_dir, "pending_queue"))
    shares = [c for c in rows.columns if c.endswith(("_std", "_ratio", "_utilization"))]
    return rows.withColumns({c: F.round(c, 6) for c in shares})


@query(
    oracle(
        """with middle as (select cast(round((min(us) + max(us)) / 2) as bigint) as t from e),
        n as (select distinct node_id, cast(8 * (1 + node_id % 3) as double) as cpu_total, cast(32 * (1 + node_id % 3) as double) as memory_total from placements),
        u as (select node_id, sum(cpu_request) as c, sum(memory_request) as m, count(*) as j from placements, middle
          where start_us <= t and (completion_us is null or completion_us > t) group by node_id)
        select n.node_id, round(coalesce(c, 0) / cpu_total, 6) as cpu_utilization, round(coalesce(m, 0) / memory_total, 6) as memory_utilization,
          coalesce(j, 0) as running_jobs, cpu_total - coalesce(c, 0) as cpu_available, memory_total - coalesce(m, 0) as memory_available
        from n left join u on u.node_id = n.node_id""",
        "placements",
        "e",
    )
)
def node_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes half way through the log."""
    placements = view(spark, sf_dir, "placements")
    node = F.col("node_id")
    nodes = placements.select(
        "node_id",
        (8 * (1 + node % 3)).cast("double").alias("cpu_total"),
        (32 * (1 + node % 3)).cast("double").alias("memory_total"),
    ).distinct()
    middle = view(spark, sf_dir, "e").select(F.round((F.min("us") + F.max("us")) / 2).cast("bigint")).scalar()
    rows = occupancy.node_states(nodes, placements, middle)
    return rows.withColumns({c: F.round(c, 6) for c in ("cpu_utilization", "memory_utilization")})


@query(
    oracle(
        """select run_id, job_id, cast(sum(cast(status = 'Succeeded' as int)) over w as bigint) as completed,
          cast(sum(coalesce(start_us - submission_us, 0)) over w as bigint) as total_wait_us,
          cast(sum(cast(oom_killed as int)) over w as bigint) as oom
        from placements window w as (partition by run_id order by submission_us, job_id rows unbounded preceding)""",
        "placements",
    )
)
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = {
        "completed": (F.col("status") == "Succeeded").cast("bigint"),
        "total_wait_us": F.coalesce(F.col("start_us") - F.col("submission_us"), F.lit(0)),
        "oom": F.col("oom_killed").cast("bigint"),
    }
    rows = occupancy.running_totals(
        view(spark, sf_dir, "placements"), ["run_id"], ["submission_us", "job_id"], totals
    )
    return rows.select("run_id", "job_id", *totals)


@query(
    oracle(
        """select node_id, cpu_total * 1000 as cpu_capacity, memory_total * 1024 as memory_capacity,
          cpu_total * 1000 - cpu_used * 1000 as cpu_available, memory_total * 1024 - memory_used * 1024 as memory_available,
          round(cpu_used / cpu_total, 6) as cpu_utilization, round(memory_used / memory_total, 6) as memory_utilization from nodes""",
        "nodes",
    )
)
def capacity_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobtide.functions.quantities import capacity_units as units

    used_cpu, used_memory = F.col("cpu_used") * 1000, F.col("memory_used") * 1024
    columns = units(F.col("cpu_total"), F.col("memory_total"), used_cpu, used_memory)
    rows = view(spark, sf_dir, "nodes").select("node_id", *[c.alias(n) for n, c in columns.items()])
    return rows.withColumns({c: F.round(c, 6) for c in ("cpu_utilization", "memory_utilization")})
