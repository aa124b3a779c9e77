"""The stream operators, run over the whole event table until everything available is processed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.plans import q_arrivals  # noqa: F401 (its oracles are used)
from jobtide.plans.q_stats import TRANSITIONS_SQL
from jobtide.plans.registry import ORACLES, query
from jobtide.plans.views import SPARK_TERMS, SPARK_VIEWS, VIEWS, oracle, table
from jobtide.session import scratch
from jobtide.streaming import collect, monitor, transitions


#: Files of one trigger; None: all there are. Results do not depend on it, nor on the order of the files.
MAX_FILES: int | None = None


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A telemetry view over the events as a stream. The table may be one file or a folder of any number."""
    if name == "events":
        reader = spark.readStream.schema(table(spark, sf_dir, "events").schema)
        reader = reader.option("maxFilesPerTrigger", MAX_FILES) if MAX_FILES else reader
        return reader.parquet(f"{sf_dir}/events.parque[t]")  # a pattern, since a stream's path may not be a file
    text = SPARK_VIEWS.get(name, VIEWS[name])
    for mark, term in SPARK_TERMS.items():
        text = text.replace(mark, term)
    inputs = {dep: _view(spark, sf_dir, dep) for dep in re.findall(r"\{(\w+)\}", text)}
    return spark.sql(text, **inputs)


def _place(spark: SparkSession, name: str) -> tuple[str, str]:
    base = scratch(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


def _run(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    out, checkpoint = _place(spark, name)
    collect.append_stream(rows, out, checkpoint, once=True).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query(oracle(TRANSITIONS_SQL, "job_snapshots"))
def status_transitions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last statuses in a table between batches."""
    out, checkpoint = _place(spark, "transitions")
    snapshots = _view(spark, sf_dir, "job_snapshots")
    transitions.transitions_by_batch(snapshots, out, checkpoint, once=True).awaitTermination()
    rows = transitions.batch_transitions(spark, out)
    return rows.withColumn("queue_wait_time", F.round("queue_wait_time", 6))


@query(oracle(TRANSITIONS_SQL, "job_snapshots"))
def status_transitions_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each job in the state store."""
    with transitions.rocksdb(spark):
        changes = _run(spark, transitions.status_changes_keyed(_view(spark, sf_dir, "job_snapshots")), "transitions")
    rows = transitions.keyed_transitions(changes)
    return rows.withColumn("queue_wait_time", F.round("queue_wait_time", 6))


@query(
    oracle(
        """select id, ts_us, total_cpu_capacity, available_cpu, queue_length from cluster_states""", "cluster_states"
    )
)
def append_states_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _view(spark, sf_dir, "cluster_states")
    return _run(spark, rows, "states").select("id", "ts_us", "total_cpu_capacity", "available_cpu", "queue_length")


@query(oracle("select status, count(*) as jobs from jobs group by status", "jobs"))
def status_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest refresh of the totals."""
    out, checkpoint = _place(spark, "status")
    collect.status_refresh(_view(spark, sf_dir, "jobs"), out, checkpoint, once=True).awaitTermination()
    return collect.refreshed(spark, out)


_WINDOWS = """w as (
  select event_us, reason, message, unnest(range(event_us // 60000000 - 59, event_us // 60000000 + 1)) * 60000000 as window_start_us
  from cluster_events)"""


@query(
    oracle(
        f"""with {_WINDOWS} select window_start_us, count(*) filter (where reason like '%OOM%' or message like '%OutOfMemory%') as oom_events,
          count(*) as total_events,
          round(count(*) filter (where reason like '%OOM%' or message like '%OutOfMemory%') / count(*), 6) as oom_rate
        from w group by window_start_us""",
        "cluster_events",
    )
)
def oom_rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sliding rate as a batch."""
    from jobtide.plans.views import view

    rows = monitor.oom_rates(monitor.oom_slides(view(spark, sf_dir, "cluster_events")))
    return rows.withColumn("oom_rate", F.round("oom_rate", 6))


def _updated(spark: SparkSession, rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    out, checkpoint = _place(spark, name)
    collect.update_stream(rows, out, checkpoint, once=True).awaitTermination()
    return collect.updated(spark, out, _ddl(rows), keys)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)


TICKS = "event_us bigint, reason string, message string"


@query(ORACLES["oom_rate_windows"])
def oom_rate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sliding rate as it comes out of the stream; a poll after the last event closes the last windows.

    The files of the table may come in any order of time, so the delay is as long as the table.
    """
    delay_days = 400
    out, checkpoint = _place(spark, "rates")
    ticks = scratch(spark, "ticks")
    spark.createDataFrame([], TICKS).write.parquet(ticks)

    def run() -> None:
        events = _view(spark, sf_dir, "cluster_events").select("event_us", "reason", "message")
        polls = spark.readStream.schema(TICKS).parquet(ticks)
        rates = monitor.oom_rate_stream(events.unionByName(polls), f"{delay_days} days")
        collect.append_stream(rates, out, checkpoint, once=True).awaitTermination()

    run()
    last = table(spark, sf_dir, "events").agg(F.unix_micros(F.max("ts").cast("timestamp"))).first()[0] or 0
    closing = last + (delay_days * 24 + 2) * 3_600_000_000
    spark.createDataFrame([(closing, None, None)], TICKS).write.mode("append").parquet(ticks)
    run()
    rows = spark.read.schema("window_start_us bigint, oom_events bigint, total_events bigint, oom_rate double").parquet(out)
    return rows.withColumn("oom_rate", F.round("oom_rate", 6))


@query(ORACLES["burst_sessions"])
def burst_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions merged in the state store, as the last trigger left them."""
    out, checkpoint = _place(spark, "bursts")
    rows = monitor.burst_stream(_view(spark, sf_dir, "jobs").select("job_id", "submission_us"), "60 seconds")
    collect.refresh_stream(rows, out, checkpoint, once=True).awaitTermination()
    return collect.refreshed(spark, out, rows.schema).filter("arrivals >= 2")


_WINDOW_ROWS = """w as (
  select ts_us // 30000000 * 30000000 as window_start_us, scheduler,
    arg_max(oom_incidents, {'t': ts_us, 'e': event_id}) as oom_incidents, arg_max(jobs_pending, {'t': ts_us, 'e': event_id}) as jobs_pending
  from metric_samples group by 1, 2)"""


@query(oracle(f"with {_WINDOW_ROWS} select * from w", "metric_samples"))
def monitor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, as the last batch that changed them left them."""
    return _updated(spark, _sampled(spark, sf_dir), "monitor", ["window_start_us", "scheduler"])


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _view(spark, sf_dir, "metric_samples")
    return monitor.monitor_stream(samples, ["scheduler"], monitor.ALERT_GAUGES, order=["ts_us", "event_id"])


@query(
    oracle(
        f"""with {_WINDOW_ROWS}
        select window_start_us, scheduler, 'high_oom_rate' as type, 'warning' as severity,
          concat('High OOM rate detected: ', oom_incidents, ' incidents') as message from w where oom_incidents > 5
        union all select window_start_us, scheduler, 'queue_congestion', 'warning',
          concat('Queue congestion: ', jobs_pending, ' pending jobs') from w where jobs_pending > 50""",
        "metric_samples",
    )
)
def alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as the triggers raised them, of the windows as they stand."""
    out, checkpoint = _place(spark, "alerts")
    rows, keys = _sampled(spark, sf_dir), ["window_start_us", "scheduler"]
    alerts = lambda windows: monitor.window_alerts(windows, ["scheduler"])
    collect.update_stream(rows, out, checkpoint, once=True, told=alerts).awaitTermination()
    schema = "window_start_us bigint, scheduler string, type string, severity string, message string"
    return collect.told_rows(spark, out, _ddl(rows), schema, keys)
