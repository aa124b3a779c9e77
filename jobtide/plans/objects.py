"""Nested cluster objects derived from the telemetry views.

They are written as JSON lines to the shared folder and read back by the snapshot readers, so a
query over them starts from files like the ones a collector leaves behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.plans.views import view
from jobtide.session import scratch
from jobtide.sources import snapshots
from jobtide.sources.sinks import TEXT

DAY_US = 86_400_000_000


def _day(us: str) -> Column:
    return F.timestamp_micros(F.col(us) - F.pmod(F.col(us), F.lit(DAY_US)))


def _files(df: DataFrame, read: Callable[[SparkSession, str], DataFrame], files: bool, **fields: Column) -> DataFrame:
    """The objects as read back from files, or without ``files`` as they would be written."""
    lines = df.select(*[c.alias(name) for name, c in fields.items()])
    if not files:
        return lines
    spark = df.sparkSession
    path = scratch(spark, "objects")
    lines.write.options(**TEXT).json(path)
    return read(spark, path)


def _map(*pairs: tuple[str, Column]) -> Column:
    """Entries whose value is NULL are left out."""
    entries = F.create_map(*[x for key, value in pairs for x in (F.lit(key), value)])
    return F.map_filter(entries, lambda _, value: value.isNotNull())


def _resources(cpu: Column, memory: Column) -> Column:
    return _map(("cpu", cpu), ("memory", memory))


def cpu_text(cores: Column, event_id: Column) -> Column:
    millis = F.concat((cores * 1000).cast("int").cast("string"), F.lit("m"))
    return F.when(event_id % 17 == 0, "100n").when(event_id % 3 == 0, cores.cast("string")).otherwise(millis)


def memory_text(gib: Column, event_id: Column) -> Column:
    def whole(factor: int, unit: str) -> Column:
        return F.concat((gib * factor).cast("bigint").cast("string"), F.lit(unit))

    return (
        F.when(event_id % 4 == 0, whole(1024, "Mi"))
        .when(event_id % 4 == 1, whole(1024**2, "Ki"))
        .when(event_id % 4 == 2, F.concat(gib.cast("string"), F.lit("Gi")))
        .otherwise(whole(1024**3, ""))
    )


def job_manifests(spark: SparkSession, sf_dir: str, files: bool = True) -> DataFrame:
    jobs = view(spark, sf_dir, "jobs")
    event, user, status = F.col("event_id"), F.col("user_id"), F.col("status")
    container = F.struct(
        F.lit("main").alias("name"),
        F.struct(
            _resources(cpu_text(F.col("cpu_request"), event), memory_text(F.col("memory_request"), event)).alias("requests"),
            _resources(cpu_text(F.col("cpu_limit"), event), memory_text(F.col("memory_limit"), event)).alias("limits"),
        ).alias("resources"),
    )
    labels = _map(
        ("priority", F.when(user % 3 != 0, F.col("priority").cast("string"))),
        ("user", F.when(user % 5 != 0, F.col("user_name"))),
        ("queue", F.when(user % 4 != 0, F.col("queue_name"))),
    )
    kind = F.when(F.col("job_type") != "generic", F.col("job_type"))
    annotations = _map(("example.org/job-type", kind), ("estimated-duration", F.when(event % 2 == 0, (event % 90).cast("string"))))
    return _files(
        jobs,
        snapshots.read_job_snapshots,
        files,
        snapshot_ts=_day("submission_us"),
        metadata=F.struct(
            F.col("job_id").alias("uid"),
            "name",
            "namespace",
            F.timestamp_micros("submission_us").alias("creationTimestamp"),
            labels.alias("labels"),
            annotations.alias("annotations"),
        ),
        spec=F.struct(
            F.when(status == "Pending", event % 2 == 0).otherwise(False).alias("suspend"),
            F.struct(F.struct(F.array(container).alias("containers")).alias("spec")).alias("template"),
        ),
        status=F.when(
            event % 13 != 0,
            F.struct(
                F.when(status == "Running", user % 3 + 1).cast("int").alias("active"),
                F.when(status == "Succeeded", 1).alias("succeeded"),
                F.when(status == "Failed", event % 3 + 1).cast("int").alias("failed"),
                F.timestamp_micros("start_us").alias("startTime"),
                F.timestamp_micros("completion_us").alias("completionTime"),
            ),
        ),
    )


def workload_manifests(spark: SparkSession, sf_dir: str, files: bool = True) -> DataFrame:
    jobs = view(spark, sf_dir, "jobs")
    event = F.col("event_id")
    requests = F.when(
        event % 4 != 0, _resources(cpu_text(F.col("cpu_request"), F.lit(1)), memory_text(F.col("memory_request"), event))
    )
    container = F.struct(F.struct(requests.alias("requests")).alias("resources"))
    pod_set = F.struct(F.struct(F.struct(F.array(container).alias("containers")).alias("spec")).alias("template"))
    return _files(
        jobs,
        snapshots.read_workload_snapshots,
        files,
        snapshot_ts=_day("submission_us"),
        metadata=F.struct(
            F.concat(F.lit("wl-"), event).alias("uid"), F.concat(F.lit("wl-"), "name").alias("name"), "namespace"
        ),
        spec=F.struct(
            (event % 5 == 0).alias("suspend"),
            F.when(event % 3 != 0, F.col("priority")).alias("priority"),
            F.array(pod_set).alias("podSets"),
        ),
        status=F.when(event % 7 != 0, F.struct((event % 2 == 0).alias("admitted"))),
    )


def _terminated(reason: Column) -> Column:
    return F.struct(F.when(reason.isNotNull(), F.struct(reason.alias("reason"))).alias("terminated"))


def pod_snapshots(spark: SparkSession, sf_dir: str, files: bool = True) -> DataFrame:
    """Two pods per job; of a job killed for memory one container shows it now or in its last run."""
    jobs = view(spark, sf_dir, "jobs").withColumn("pod", F.explode(F.array(F.lit(0), F.lit(1))))
    killed = F.col("oom_killed") & (F.col("pod") == 0)
    now = F.when(killed & (F.col("event_id") % 2 == 0), "OOMKilled").when(F.col("pod") == 1, "Completed")
    last = F.when(killed & (F.col("event_id") % 2 == 1), "OOMKilled")
    container = F.struct(_terminated(now).alias("state"), _terminated(last).alias("last_state"))
    return _files(
        jobs,
        snapshots.read_pod_snapshots,
        files,
        snapshot_ts=_day("submission_us"),
        namespace=F.col("namespace"),
        labels=F.create_map(F.lit("job-name"), F.col("name")),
        phase=F.col("status"),
        container_statuses=F.when(F.col("event_id") % 11 != 0, F.array(container)),
    )


def node_manifests(spark: SparkSession, sf_dir: str, files: bool = True) -> DataFrame:
    nodes = view(spark, sf_dir, "node_snapshots")
    ready = F.when(F.col("ready"), "True").otherwise("False")
    taint = F.struct(F.lit("dedicated").alias("key"), F.lit("NoSchedule").alias("effect"))
    return _files(
        nodes,
        snapshots.read_node_snapshots,
        files,
        snapshot_ts=F.timestamp_micros(F.col("snapshot_id").cast("bigint") * 1_000_000),
        name=F.concat(F.lit("node-"), F.col("node_id")),
        capacity=_resources(F.col("cpu_capacity"), F.col("memory_capacity")),
        allocatable=_resources(F.col("cpu_allocatable"), F.col("memory_allocatable")),
        taints=F.when(F.col("no_schedule"), F.array(taint)),
        conditions=F.array(F.struct(F.lit("Ready").alias("type"), ready.alias("status"))),
    )


FIRST_DAY_US = 1_704_067_200_000_000


def daily_nodes(spark: SparkSession, sf_dir: str, files: bool = True) -> DataFrame:
    """Every node in the poll of one of thirty days."""
    number = F.substring("name", 6, 20).cast("bigint")
    day = F.timestamp_micros(F.lit(FIRST_DAY_US) + number % 30 * DAY_US)
    return node_manifests(spark, sf_dir, files).withColumn("snapshot_ts", day)


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster events as seen by the poll at the start of their day: what is newer than an hour before it counts."""
    events = view(spark, sf_dir, "cluster_events")
    day = F.col("event_us") - F.pmod(F.col("event_us"), F.lit(DAY_US))
    # A poll looks back one hour; the first hour of a day is put before the poll of that day.
    seen = F.timestamp_micros(2 * day - F.col("event_us"))
    return events.select(_day("event_us").alias("snapshot_ts"), "namespace", "reason", "message", seen.alias("first_timestamp"), F.lit(None).cast("timestamp").alias("event_time"))


def job_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for every snapshot of the status view."""
    rows = view(spark, sf_dir, "job_snapshots")
    status = F.col("status")
    container = F.struct(F.lit("main").alias("name"), F.struct(_resources(F.lit("1"), F.lit("1Gi")).alias("requests")).alias("resources"))
    return rows.select(
        F.timestamp_micros("ts_us").alias("snapshot_ts"),
        F.struct(
            F.col("job_id").alias("uid"), F.col("job_id").alias("name"), F.lit("ns").alias("namespace"),
            F.timestamp_micros("submission_us").alias("creationTimestamp"),
        ).alias("metadata"),
        F.struct(
            (status == "Suspended").alias("suspend"),
            F.struct(F.struct(F.array(container).alias("containers")).alias("spec")).alias("template"),
        ).alias("spec"),
        F.struct(
            F.when(status == "Running", 1).alias("active"), F.when(status == "Succeeded", 1).alias("succeeded"),
            F.when(status == "Failed", 1).alias("failed"), F.timestamp_micros("start_us").alias("startTime"),
        ).alias("status"),
    )
