"""Writers and readers: tables written to the shared folder and read back, and the collector."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions.clock import hour_of_day as hours
from jobtide.operators import cluster, monitor, stats
from jobtide.operators.transitions import status_transitions
from jobtide.plans import objects, q_episodes, q_ingest, q_monitor, q_stats  # noqa: F401 (their oracles are used)
from jobtide.plans.registry import ORACLES, query
from jobtide.plans.views import oracle, view
from jobtide.session import scratch
from jobtide.sources import sinks, snapshots, tables
from jobtide.streaming import collect


def _job_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job view with times as the job table has them."""
    times = {"submission_time": "submission_us", "start_time": "start_us", "completion_time": "completion_us"}
    jobs = view(spark, sf_dir, "jobs")
    return jobs.withColumns({time: F.timestamp_micros(us) for time, us in times.items()}).drop(*times.values())


def _state_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "cluster_states").withColumn("timestamp", F.timestamp_micros("ts_us"))


@query(
    oracle(
        """select job_id, submission_us, start_us, status, cpu_request, oom_killed from jobs
        where submission_us > (select max(submission_us) from jobs) - 48 * 3600000000""",
        "jobs",
    )
)
def scan_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two days of the job table."""
    path, jobs = scratch(spark, "jobs"), _job_table(spark, sf_dir)
    for batch in range(2):  # found by the index that the writer keeps
        sinks.upsert_jobs(jobs.filter(F.xxhash64("job_id") % 2 == 0) if batch else jobs.filter(F.xxhash64("job_id") % 2 != 0), path, batch)
    jobs = tables.scan_jobs(spark, path, hours=48)
    return jobs.select("job_id", "submission_us", "start_us", "status", "cpu_request", "oom_killed")


@query(oracle("select job_id, status, priority, user_name, submission_us from jobs", "jobs"))
def upsert_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of versions: new, then final, then a stale one that must not win."""
    path, jobs = scratch(spark, "versions"), _job_table(spark, sf_dir)

    def version(minutes: int, status: str | None) -> DataFrame:
        stamp = F.timestamp_micros(F.unix_micros("submission_time") + minutes * 60_000_000)
        return jobs.withColumns({"snapshot_ts": stamp, "status": F.lit(status) if status else F.col("status")})

    for batch, rows in enumerate([version(1, "Suspended"), version(9, None), version(5, "Unknown")]):
        sinks.upsert_jobs(rows, path, batch)
    return tables.scan_current_jobs(spark, path).select("job_id", "status", "priority", "user_name", "submission_us")


@query(ORACLES["upsert_jobs"])
def replace_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of ``upsert_jobs`` put into a table that holds each job once; the second one comes twice."""
    path, jobs = scratch(spark, "replaced"), _job_table(spark, sf_dir)

    def version(minutes: int, status: str | None) -> DataFrame:
        stamp = F.timestamp_micros(F.unix_micros("submission_time") + minutes * 60_000_000)
        return jobs.withColumns({"snapshot_ts": stamp, "status": F.lit(status) if status else F.col("status")})

    for batch, rows in ((0, version(1, "Suspended")), (1, version(9, None)), (1, version(99, "Unknown")), (2, version(5, "Unknown"))):
        sinks.replace_jobs(rows, path, batch, buckets=16)
    return tables.scan_job_table(spark, path).select("job_id", "status", "priority", "user_name", "submission_us")


@query(
    oracle(
        """select id, ts_us from cluster_states
        where ts_us // 86400000000 >= (select max(ts_us) // 86400000000 from cluster_states) - 7""",
        "cluster_states",
    )
)
def apply_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table of states by date still holds after dates more than a week before the newest were removed."""
    path = scratch(spark, "states")
    sinks.append_cluster_states(_state_table(spark, sf_dir), path)
    sinks.apply_retention(spark, path, days=7)
    return tables.scan_cluster_states(spark, path).select("id", "ts_us")


@query(oracle("select job_id, status from jobs", "jobs"))
def compact_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions compacted into a new folder."""
    path, new_path = scratch(spark, "versions"), scratch(spark, "compacted")
    jobs = _job_table(spark, sf_dir).withColumn("snapshot_ts", F.col("submission_time"))
    sinks.upsert_jobs(jobs.withColumn("status", F.lit("Pending")), path, 0)
    sinks.upsert_jobs(jobs, path, 1)
    sinks.compact_jobs(spark, path, new_path)
    return tables.scan_job_versions(spark, new_path).select("job_id", "status")


@query(
    oracle(
        """select id, ts_us, available_cpu, queue_length, node_count,
          ts_us > (select max(ts_us) from cluster_states) - 24 * 3600000000 as last_day from cluster_states""",
        "cluster_states",
    )
)
def append_cluster_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by date and read back, with a mark on what a scan of the last day returns."""
    path = scratch(spark, "states")
    sinks.append_cluster_states(_state_table(spark, sf_dir), path)
    day = tables.scan_cluster_states(spark, path, hours=24).select("id", F.lit(True).alias("last_day"))
    states = tables.scan_cluster_states(spark, path).join(day, "id", "left")
    columns = ["id", "ts_us", "available_cpu", "queue_length", "node_count"]
    return states.select(*columns, F.coalesce("last_day", F.lit(False)).alias("last_day"))


@query(
    oracle(
        f"""select timestamp_us, job_id, event_type, scheduler_name, resource_efficiency
        from ({q_stats.TRANSITIONS_SQL}) t""",
        "job_snapshots",
    )
)
def append_scheduling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "events")
    events = status_transitions(view(spark, sf_dir, "job_snapshots"))
    sinks.append_scheduling_events(events.withColumn("timestamp", F.timestamp_micros("timestamp_us")), path, 0)
    return spark.read.parquet(path).select(
        F.unix_micros("timestamp").alias("timestamp_us"), "job_id", "event_type", "scheduler_name", "resource_efficiency"
    )


@query(
    oracle(
        """select ts_us, 'cluster_cpu_utilization' as metric_name, avg_cpu_utilization as metric_value, 'gauge' as metric_type from cluster_states
        union all select ts_us, 'cluster_memory_utilization', avg_memory_utilization, 'gauge' from cluster_states
        union all select ts_us, 'cluster_running_jobs', running_jobs_count, 'gauge' from cluster_states
        union all select ts_us, 'cluster_oom_rate', queue_length / 32.0, 'gauge' from cluster_states""",
        "cluster_states",
    )
)
def append_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "metrics")
    states = _state_table(spark, sf_dir).withColumn("oom_rate", F.col("queue_length") / 32.0)
    sinks.append_metrics(cluster.gauges_long(states).drop("metric_type"), path)
    return spark.read.parquet(path).select(
        F.unix_micros("timestamp").alias("ts_us"), "metric_name", "metric_value", "metric_type"
    )


@query(ORACLES["training_dataset"])
def write_training_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported file with its types put back."""
    jobs, states = view(spark, sf_dir, "jobs"), view(spark, sf_dir, "cluster_states")
    schema = stats.training_dataset(jobs, states).schema
    path = sinks.write_training_csv(jobs, states, scratch(spark, "training"))
    rows = spark.read.option("header", True).schema(schema).csv(path)
    return rows.withColumns(
        {
            "submission_timestamp": F.col("submission_timestamp").cast("timestamp_ntz"),
            "wait_time_minutes": F.round("wait_time_minutes", 6),
            "execution_time_minutes": F.round("execution_time_minutes", 6),
        }
    )


@query(ORACLES["metrics_summary"])
def write_metrics_summary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, states = view(spark, sf_dir, "jobs"), view(spark, sf_dir, "cluster_states")
    path = sinks.write_metrics_summary_csv(jobs, states, scratch(spark, "summary"))
    rows = spark.read.option("header", True).schema("metric string, value double").csv(path)
    return rows.withColumn("value", F.round("value", 6))


@query(f"select t.*, f.format from ({ORACLES['results_flat']}) t, (values ('json'), ('csv')) f(format)")
def write_evaluation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat, path = q_episodes.results_flat(spark, sf_dir), scratch(spark, "evaluation")
    sinks.write_evaluation_results(flat, path)
    columns = flat.columns
    as_json = spark.read.schema(flat.schema).json(f"{path}/json").select(*columns, F.lit("json").alias("format"))
    as_csv = spark.read.schema(flat.schema).option("header", True).csv(f"{path}/csv")
    return as_json.unionByName(as_csv.select(*columns, F.lit("csv").alias("format")))


@query(ORACLES["scheduler_comparison"])
def write_benchmark_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    comparison, path = q_monitor.scheduler_comparison(spark, sf_dir), scratch(spark, "comparison")
    sinks.write_benchmark_json(comparison, path)
    return spark.read.schema(comparison.schema).json(path)


_STATE = ["k / 128", "queue_length / 12", "reward", "(k % 7) / 7", "(k % 3) / 3"]


@query(
    oracle(
        "select event_id, f.format, "
        + ", ".join(f"round(cast(cast({x} as float) as double), 4) as s{i}" for i, x in enumerate(_STATE))
        + " from steps, (values ('parquet'), ('csv')) f(format)",
        "steps",
    )
)
def write_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All elements of the states, from the Parquet files and from the CSV files."""
    path, csv = scratch(spark, "trajectories"), scratch(spark, "trajectories")
    steps = q_episodes.logged_states(spark, sf_dir).select("event_id", "state")
    sinks.write_trajectories(steps, path)
    sinks.write_trajectories(steps, csv, csv=True)
    rows = spark.read.schema("event_id bigint, state string").option("header", True).csv(csv)
    rows = rows.withColumn("state", F.from_json("state", "array<float>")).withColumn("format", F.lit("csv"))
    rows = rows.unionByName(spark.read.schema(steps.schema).parquet(path).withColumn("format", F.lit("parquet")))
    elements = [F.round(F.col("state")[i].cast("double"), 4).alias(f"s{i}") for i in range(len(_STATE))]
    return rows.select("event_id", "format", *elements)


@query(oracle("select namespace, reason, message, event_us from cluster_events", "cluster_events"))
def read_cluster_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from JSON files; those without a first time carry an event time."""
    path, events = scratch(spark, "events"), view(spark, sf_dir, "cluster_events")
    when, early = F.timestamp_micros("event_us"), F.col("event_id") % 2 == 0
    lines = events.select(
        "namespace", "reason", "message",
        F.when(early, when).alias("first_timestamp"), F.when(~early, when).alias("event_time"),
    )
    lines.write.options(**sinks.TEXT).json(path)
    return snapshots.read_cluster_events(spark, path).select("namespace", "reason", "message", "event_us")


@query(oracle("select event_id, round((us % 86400000000) / 3.6e9, 6) as hour from e", "e"))
def hour_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "e").select("event_id", F.round(hours(F.col("us")), 6).alias("hour"))


_COLUMNS = ["job_id", "name", "namespace", "cpu_request", "memory_request", "priority", "status", "job_type", "oom_killed"]


def _collected(spark: SparkSession, kinds: dict[str, DataFrame]) -> str:
    """Run the collector over polls of these objects, each kind in files of its own; where it wrote."""
    path, out, checkpoint = (scratch(spark, name) for name in ("polls", "collected", "checkpoint"))
    lines = [
        rows.select(F.lit(kind).alias("kind"), "snapshot_ts", F.struct(*[c for c in rows.columns if c != "snapshot_ts"]).alias(kind))
        for kind, rows in kinds.items()
    ]
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lines).write.options(**sinks.TEXT).json(path)
    polls = snapshots.read_polls(spark, path, max_files=MAX_FILES)
    collect.collect_stream(polls, out, checkpoint, once=True).awaitTermination()
    return out


#: Files of one trigger; None: all there are. Results do not depend on it.
MAX_FILES: int | None = None


def _daily(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A poll a day: its jobs, workloads, pods and nodes, and the events of its last hours."""
    return {
        "job": objects.job_manifests(spark, sf_dir, files=False),
        "workload": objects.workload_manifests(spark, sf_dir, files=False),
        "pod": objects.pod_snapshots(spark, sf_dir, files=False),
        "node": objects.daily_nodes(spark, sf_dir, files=False),
        "event": objects.daily_events(spark, sf_dir),
    }


@query(f"select {', '.join(_COLUMNS)} from ({ORACLES['normalize_jobs']}) t")
def collect_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job table that the collector leaves behind."""
    out = _collected(spark, _daily(spark, sf_dir))
    return collect.collected_jobs(spark, out).select(*_COLUMNS)


_RATES = """rates as (
  select event_us - event_us % 86400000000 as day_us, count(*) as total_events,
    count(*) filter (where reason like '%OOM%' or message like '%OutOfMemory%') as oom_events
  from cluster_events where event_us % 86400000000 < 3600000000 group by 1)"""
_COLLECTED_STATES = f"""collected as (
  select s.*, coalesce(oom_events, 0) / greatest(coalesce(total_events, 0), 1) as oom_rate
  from ({q_ingest.STATES_SQL}) s left join rates r on r.day_us = s.day_us)"""


@query(oracle(f"with {_RATES}, {_COLLECTED_STATES} select * replace (round(oom_rate, 6) as oom_rate) from collected", "jobs", "cluster_events"))
def collect_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster states that the collector leaves behind, with the rates of their events."""
    out = _collected(spark, _daily(spark, sf_dir))
    rows = collect.collected_states(spark, out)
    rate = F.round(F.get_json_object("metadata", "$.oom_rate").cast("double"), 6).alias("oom_rate")
    rows = rows.withColumns({c: F.round(c, 9) for c in ("avg_cpu_utilization", "avg_memory_utilization")})
    return rows.select(F.unix_micros("timestamp").alias("day_us"), *q_ingest.STATE_COLUMNS, rate)


_GAUGE_SQL = {
    "cluster_cpu_utilization": "avg_cpu_utilization",
    "cluster_memory_utilization": "avg_memory_utilization",
    "cluster_running_jobs": "running_jobs_count",
    "cluster_oom_rate": "oom_rate",
}


@query(
    oracle(
        f"with {_RATES}, {_COLLECTED_STATES} "
        + " union all ".join(
            f"select day_us, '{name}' as metric_name, round(cast({c} as double), 6) as metric_value from collected"
            for name, c in _GAUGE_SQL.items()
        ),
        "jobs",
        "cluster_events",
    )
)
def collect_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collect.collected_metrics(spark, _collected(spark, _daily(spark, sf_dir)))
    return rows.select(F.unix_micros("timestamp").alias("day_us"), "metric_name", F.round("metric_value", 6).alias("metric_value"))


@query(oracle("select job_id, 'quantity' as defect from jobs where event_id % 17 = 0", "jobs"))
def collect_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.collected_quarantine(spark, _collected(spark, _daily(spark, sf_dir))).select("job_id", "defect")


@query(
    oracle(
        """select count(*) filter (where event_id % 17 <> 0) as jobs_collected,
          (select count(distinct s_suppkey % 30) from supplier) as states_collected,
          count(*) filter (where event_id % 17 = 0) as errors,
          greatest(max(submission_us - submission_us % 86400000000),
            (select max(event_us - event_us % 86400000000) from cluster_events),
            (select max(1704067200000000 + s_suppkey % 30 * 86400000000) from supplier)) as last_collection_us
        from jobs""",
        "jobs",
        "cluster_events",
    )
)
def collect_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over the audit that the collector leaves behind."""
    audit = collect.collected_audit(spark, _collected(spark, _daily(spark, sf_dir)))
    return monitor.collection_audit(audit)


@query(
    oracle(
        """select count(*) filter (where event_id % 17 <> 0) as jobs_collected, count(*) filter (where event_id % 17 = 0) as errors,
          max(submission_us - submission_us % 86400000000) filter (where event_id % 17 <> 0) as last_collection_us from jobs""",
        "jobs",
    )
)
def collection_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a collection of jobs, from what its writes counted on the way."""
    totals = collect.collected_totals(spark, _collected(spark, {"job": objects.job_manifests(spark, sf_dir, files=False)}))
    sums = [F.sum("jobs_collected").alias("jobs_collected"), F.sum("errors").alias("errors"), F.max("collected_us").alias("last_collection_us")]
    return totals.agg(*sums)


@query(oracle(f"select timestamp_us, job_id, event_type from ({q_stats.TRANSITIONS_SQL}) t", "job_snapshots"))
def collect_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scheduling events that the collector leaves behind, from polls of every change of a job."""
    rows = collect.collected_events(spark, _collected(spark, {"job": objects.job_versions(spark, sf_dir)}))
    return rows.select(F.unix_micros("timestamp").alias("timestamp_us"), "job_id", "event_type")
