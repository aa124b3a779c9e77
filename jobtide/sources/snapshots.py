"""JSON-lines snapshots of cluster objects, as batches or as file streams.

All namespaces are read in one scan; the namespace is a column. A poll may be any number of files, read
by any number of triggers: the collector joins what belongs to one ``snapshot_ts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide import schemas


def _read(spark: SparkSession, path: str, schema: str, stream: bool, max_files: int | None) -> DataFrame:
    """``max_files`` bounds the files of one trigger of a stream; without it a trigger takes all there are."""
    if stream:
        reader = spark.readStream.schema(schema)
        return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(path)
    return spark.read.schema(schema).json(path)


def read_job_snapshots(
    spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None
) -> DataFrame:
    return _read(spark, path, schemas.JOB_MANIFEST, stream, max_files)


def read_workload_snapshots(
    spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None
) -> DataFrame:
    return _read(spark, path, schemas.WORKLOAD_MANIFEST, stream, max_files)


def read_node_snapshots(
    spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None
) -> DataFrame:
    return _read(spark, path, schemas.NODE_SNAPSHOT, stream, max_files)


def read_pod_snapshots(
    spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None
) -> DataFrame:
    return _read(spark, path, schemas.POD_SNAPSHOT, stream, max_files)


def read_cluster_events(
    spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None
) -> DataFrame:
    """Events with ``event_us``: the first time seen, or else the event time."""
    return with_event_time(_read(spark, path, schemas.CLUSTER_EVENT, stream, max_files))


def with_event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("event_us", F.unix_micros(F.coalesce("first_timestamp", "event_time")))


def poll_schema() -> str:
    """One row per object of a poll: ``kind`` says which of the nested columns is filled."""
    def nested(ddl: str) -> str:
        return T.StructType.fromDDL(ddl).simpleString()

    return (
        "kind string, snapshot_ts timestamp, "
        f"job {nested(schemas.JOB_MANIFEST)}, workload {nested(schemas.WORKLOAD_MANIFEST)}, "
        f"node {nested(schemas.NODE_SNAPSHOT)}, pod {nested(schemas.POD_SNAPSHOT)}, event {nested(schemas.CLUSTER_EVENT)}"
    )


def read_polls(
    spark: SparkSession, path: str, stream: bool = True, max_files: int | None = None
) -> DataFrame:
    return _read(spark, path, poll_schema(), stream, max_files)


def objects(polls: DataFrame, kind: str) -> DataFrame:
    """The objects of one kind, as the matching reader would return them."""
    rows = polls.filter(F.col("kind") == kind)
    fields = [f for f in polls.schema[kind].dataType.names if f != "snapshot_ts"]
    return rows.select("snapshot_ts", *[F.col(f"{kind}.{f}").alias(f) for f in fields])
