"""Nested job and workload manifests as flat rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions import quantities as q
from jobtide.functions import status as st

DEFAULT_MINUTES = 30.0


def label(labels: Column, name: str, default: str) -> Column:
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(default))


def annotation(annotations: Column, name: str, default: str) -> Column:
    """An annotation by its name, with or without a domain in front ("example.org/job-type")."""
    named = F.map_filter(annotations, lambda key, _: (key == name) | key.endswith(f"/{name}"))
    return F.coalesce(F.try_element_at(F.map_values(named), F.lit(1)), F.lit(default))


def pack_metadata(labels: Column, annotations: Column) -> Column:
    """JSON of labels and annotations, NULL when both are empty."""
    filled = (F.coalesce(F.size(labels), F.lit(0)) > 0) | (F.coalesce(F.size(annotations), F.lit(0)) > 0)
    both = F.struct(labels.alias("labels"), annotations.alias("annotations"))
    return F.when(filled, F.to_json(both, {"ignoreNullFields": "false"}))


def unpack_metadata(metadata: Column) -> Column:
    return F.from_json(metadata, "labels map<string, string>, annotations map<string, string>")


def killed_jobs(pods: DataFrame, keys: Sequence[str] = ("namespace",)) -> DataFrame:
    """One row per job with a pod that was killed for memory."""
    killed = pods.filter(st.pod_oom(F.col("container_statuses")))
    name = F.try_element_at("labels", F.lit("job-name")).alias("job_name")
    return killed.select(*keys, name).filter(F.col("job_name").isNotNull()).distinct()


def with_oom_flag(
    jobs: DataFrame, pods: DataFrame, keys: Sequence[str] = ("namespace",), name: str = "name"
) -> DataFrame:
    """Left join with the killed jobs, which are few and unique, so rows never multiply.

    Nothing after the join needs its partitioning, so adaptive execution may broadcast the killed
    jobs or split a job with very many rows.
    """
    flags = killed_jobs(pods, keys).withColumnRenamed("job_name", name).withColumn("__killed", F.lit(True))
    joined = jobs.drop("oom_killed").join(flags, [*keys, name], "left")
    return joined.withColumn("oom_killed", F.coalesce("__killed", F.lit(False))).drop("__killed")


def _containers(spec: Column) -> Column:
    return F.coalesce(spec["template"]["spec"]["containers"], spec["containers"])


def _unreadable(containers: Column) -> Column:
    """Some quantity of the first container cannot be read."""
    resources = q.first_container(containers)["resources"]
    bad = F.lit(False)
    for kind in ("requests", "limits"):
        cpu, memory = q.quantity(resources, kind, "cpu"), q.quantity(resources, kind, "memory")
        bad = bad | q.cpu_unreadable(cpu) | q.memory_unreadable(memory)
    return bad


def normalized_jobs(manifests: DataFrame) -> DataFrame:
    """Every manifest as a flat row; ``defect`` says what cannot be read of it."""
    meta, spec, status = F.col("metadata"), F.col("spec"), F.col("status")
    containers = _containers(spec)
    priority = label(meta["labels"], "priority", "0")
    return manifests.select(
        "snapshot_ts",
        meta["uid"].alias("job_id"),
        meta["name"].alias("name"),
        meta["namespace"].alias("namespace"),
        meta["creationTimestamp"].alias("submission_time"),
        status["startTime"].alias("start_time"),
        status["completionTime"].alias("completion_time"),
        *[c.alias(name) for name, c in q.container_resources(containers).items()],
        priority.try_cast("int").alias("priority"),
        label(meta["labels"], "user", "unknown").alias("user_name"),
        label(meta["labels"], "queue", "default").alias("queue_name"),
        st.job_status(status, spec).alias("status"),
        annotation(meta["annotations"], "job-type", "generic").alias("job_type"),
        F.coalesce(status["failed"], F.lit(0)).alias("restart_count"),
        F.lit(False).alias("oom_killed"),
        pack_metadata(meta["labels"], meta["annotations"]).alias("metadata"),
        F.when(_unreadable(containers), "quantity")
        .when(priority.try_cast("int").isNull(), "priority")
        .alias("defect"),
    )


def normalize_jobs(
    manifests: DataFrame, pods: DataFrame | None = None, pod_keys: Sequence[str] = ("namespace",)
) -> DataFrame:
    """The job table of readable manifests; unreadable ones go to :func:`quarantined_jobs`."""
    jobs = readable(normalized_jobs(manifests))
    return with_oom_flag(jobs, pods, pod_keys) if pods is not None else jobs


def unreadable_job(meta: Column, spec: Column) -> Column:
    """Whether a manifest goes to :func:`quarantined_jobs`."""
    return F.coalesce(_unreadable(_containers(spec)), F.lit(False)) | label(meta["labels"], "priority", "0").try_cast("int").isNull()


def in_queue(meta: Column, spec: Column) -> Column:
    """Whether a manifest is a record of :func:`all_pending`: suspended and readable."""
    readable = ~_unreadable(_containers(spec)) & label(meta["labels"], "priority", "0").try_cast("int").isNotNull()
    return st.is_suspended(spec) & readable & _minutes(meta).try_cast("double").isNotNull()


def _minutes(meta: Column) -> Column:
    return annotation(meta["annotations"], "estimated-duration", str(DEFAULT_MINUTES))


def quarantined_jobs(manifests: DataFrame) -> DataFrame:
    return defective(normalized_jobs(manifests))


def readable(flat: DataFrame) -> DataFrame:
    return flat.filter(F.col("defect").isNull()).drop("defect")


def defective(flat: DataFrame) -> DataFrame:
    return flat.filter(F.col("defect").isNotNull()).select("snapshot_ts", "job_id", "name", "namespace", "defect")


def pending_jobs(manifests: DataFrame) -> DataFrame:
    return manifests.filter(st.is_suspended(F.col("spec")))


def pending_workloads(workloads: DataFrame) -> DataFrame:
    return workloads.filter(st.workload_pending(F.col("spec"), F.col("status")))


def _empty_map(labels: Column) -> Column:
    return F.coalesce(labels, F.create_map().cast("map<string, string>"))


def job_info(manifests: DataFrame, as_of: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Queue record of a job; a missing creation time becomes ``as_of`` (default: the snapshot).

    Columns of ``keep`` stay beside the record.
    """
    meta, spec = F.col("metadata"), F.col("spec")
    resources = q.container_resources(_containers(spec))
    now = as_of if as_of is not None else F.col("snapshot_ts")
    rows = manifests.select(
        meta["uid"].alias("job_id"),
        meta["name"].alias("name"),
        meta["namespace"].alias("namespace"),
        resources["cpu_request"].alias("cpu_request"),
        resources["memory_request"].alias("memory_request"),
        label(meta["labels"], "priority", "0").try_cast("int").alias("priority"),
        F.coalesce(meta["creationTimestamp"], now).alias("arrival_time"),
        _minutes(meta).try_cast("double").alias("estimated_duration"),
        annotation(meta["annotations"], "job-type", "generic").alias("job_type"),
        _empty_map(meta["labels"]).alias("labels"),
        _empty_map(meta["annotations"]).alias("annotations"),
        *keep,
        _unreadable(_containers(spec)).alias("bad"),
    )
    readable = ~F.col("bad") & F.col("priority").isNotNull() & F.col("estimated_duration").isNotNull()
    return rows.filter(readable).drop("bad")


def workload_job_info(workloads: DataFrame, as_of: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Queue record of a workload, from the first container of its first pod set."""
    meta, spec = F.col("metadata"), F.col("spec")
    pod_set = F.try_element_at(spec["podSets"], F.lit(1))
    resources = q.first_container(pod_set["template"]["spec"]["containers"])["resources"]
    cpu = q.parse_cpu(q.quantity(resources, "requests", "cpu", "1"))
    memory = q.parse_memory(q.quantity(resources, "requests", "memory", "1Gi"))
    rows = workloads.select(
        F.coalesce(meta["uid"], F.lit("")).alias("job_id"),
        F.coalesce(meta["name"], F.lit("")).alias("name"),
        meta["namespace"].alias("namespace"),
        cpu.alias("cpu_request"),
        memory.alias("memory_request"),
        F.coalesce(spec["priority"], F.lit(0)).alias("priority"),
        (as_of if as_of is not None else F.col("snapshot_ts")).alias("arrival_time"),
        F.lit(DEFAULT_MINUTES).alias("estimated_duration"),
        F.lit("workload").alias("job_type"),
        _empty_map(meta["labels"]).alias("labels"),
        _empty_map(meta["annotations"]).alias("annotations"),
        *keep,
    )
    return rows.filter(F.col("cpu_request").isNotNull() & F.col("memory_request").isNotNull())


def all_pending(
    manifests: DataFrame, workloads: DataFrame, distinct_jobs: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """Pending jobs and pending workloads of all namespaces, duplicates kept unless asked otherwise.

    Records that cannot be read are not in the queue.
    """
    jobs, others = pending_jobs(manifests), pending_workloads(workloads)
    both = job_info(jobs, keep=keep).unionByName(workload_job_info(others, keep=keep))
    return both.dropDuplicates(["namespace", "name"]) if distinct_jobs else both
