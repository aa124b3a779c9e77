"""Logged data beside the configured scenarios, job types, transitions and node classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide import dims
from jobtide.operators import settings
from jobtide.operators.ordered import OrderedScan
from jobtide.plans import q_episodes, q_stats
from jobtide.plans.registry import ORACLES, query
from jobtide.plans.views import oracle, view


def _values(rows: list[tuple]) -> str:
    shown = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join(f"({', '.join(map(shown, row))})" for row in rows)


_SCENARIOS = [(i, name, duration, rate) for i, (name, duration, rate, *_) in enumerate(dims.SCENARIOS)]


@query(
    f"""select s.scenario, algorithm, duration, arrival_rate::double as arrival_rate, round(throughput / (arrival_rate * duration), 6) as completed_share
    from ({ORACLES["scenario_evaluation"]}) t join (values {_values(_SCENARIOS)}) s(number, scenario, duration, arrival_rate) on t.scenario = s.number"""
)
def scenario_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(name) for _, name, *_ in _SCENARIOS])
    rows = q_episodes.scenario_evaluation(spark, sf_dir).withColumn("scenario", F.get(names, F.col("scenario").cast("int")))
    rows = settings.with_scenario(rows, dims.dim_scenarios(spark))
    return rows.select("scenario", "algorithm", "duration", "arrival_rate", F.round("completed_share", 6).alias("completed_share"))


_TYPES = [row[:5] + row[7:9] for row in dims.JOB_TYPES]


@query(
    oracle(
        f"""with types(job_type, cpu_low, cpu_high, memory_low, memory_high, priority_low, priority_high) as (values {_values(_TYPES)}),
        asked as (select ['{"', '".join(t[0] for t in _TYPES)}', 'unknown'][event_id % 6 + 1] as job_type, cpu_request * 1000 as cpu, memory_request * 1024 as memory, priority from jobs)
        select t.job_type, count(a.job_type) as jobs, count(*) filter (where cpu < cpu_low or cpu >= cpu_high) as cpu_millis_outside,
          count(*) filter (where memory < memory_low or memory >= memory_high) as memory_mb_outside,
          count(*) filter (where priority < priority_low or priority >= priority_high) as priority_outside
        from types t left join asked a on a.job_type = t.job_type group by t.job_type""",
        "jobs",
    )
)
def outside_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(t[0]) for t in _TYPES], F.lit("unknown"))
    jobs = view(spark, sf_dir, "jobs").select(
        F.get(names, (F.col("event_id") % 6).cast("int")).alias("job_type"), (F.col("cpu_request") * 1000).alias("cpu_millis"),
        (F.col("memory_request") * 1024).alias("memory_mb"), "priority",
    )
    return settings.outside_type(jobs, dims.dim_job_types(spark))


@query(f"select event_type, count(*) as seen from ({oracle(q_stats.TRANSITIONS_SQL, 'job_snapshots')}) t group by event_type")
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = OrderedScan(view(spark, sf_dir, "job_snapshots"), ["job_id"], ["ts_us", "status"]).previous(prev_status="status")
    return settings.transition_counts(scan.result(), dims.dim_transitions(spark)).filter("seen > 0")


_NODES = [(i, cores, memory) for i, (cores, memory) in enumerate((c, m) for n, c, _, m, _ in dims.NODE_CLASSES for _ in range(n))]


@query(
    oracle(
        f"""with types(node_id, cpu_cores, memory_gb) as (values {_values(_NODES)})
        select cpu_cores, memory_gb, count(*) as jobs, round(sum(cpu_request) / sum(cpu_cores), 6) as cores_per_core, round(sum(memory_request) / sum(memory_gb), 6) as gib_per_gb
        from placements join types using (node_id) group by cpu_cores, memory_gb""",
        "placements",
    )
)
def class_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settings.class_load(view(spark, sf_dir, "placements"), dims.dim_node_types(spark))
    return rows.withColumns({c: F.round(c, 6) for c in ("cores_per_core", "gib_per_gb")})
