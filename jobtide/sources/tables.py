"""Telemetry tables stored as Parquet. Times gain a microsecond twin that the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide import schemas
from jobtide.functions.clock import MICROS_PER_HOUR, micros
from jobtide.operators.stats import latest_rows
from jobtide.session import remove, scratch


INDEX = "file string, first_us bigint, last_us bigint"


def index_batch(spark: SparkSession, path: str, time: str, batch_id: int) -> None:
    """Note the range of ``time`` in each file of a numbered batch; files without a time have no range."""
    rows = spark.read.schema(f"{time} timestamp").parquet(f"{path}/batch_id={batch_id}")
    us = F.unix_micros(time)
    files = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"))
    files.coalesce(1).write.mode("overwrite").parquet(f"{path}/_index/batch_id={batch_id}")


def _index(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_index")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(f"{INDEX}, batch_id bigint").parquet(f"{path}/_index")


def forget_files(spark: SparkSession, path: str, folders: list[str]) -> None:
    """Take the files below removed folders out of the index, which becomes one part. Not beside a writer."""
    index = _index(spark, path)
    if index is None or not folders:
        return
    gone = F.lit(False)
    for folder in folders:
        gone = gone | F.contains("file", F.lit(f"{folder}/"))
    last = index.agg(F.max("batch_id")).first()[0]
    batches = [r[0] for r in index.select("batch_id").distinct().collect() if r[0] < last]
    held = scratch(spark, "index")
    index.filter(~gone).drop("batch_id").write.parquet(held)
    spark.read.schema(INDEX).parquet(held).coalesce(1).write.mode("overwrite").parquet(f"{path}/_index/batch_id={last}")
    for batch in batches:
        remove(spark, f"{path}/_index/batch_id={batch}")
    remove(spark, held)


def _scan(spark: SparkSession, path: str, schema: str, time: str, hours: int | None, as_of: str | None) -> DataFrame:
    """Rows strictly newer than ``as_of - hours`` (default: than the newest row), compared on the stored column.

    Where the writer kept an index of its files, only those that reach into the hours are opened, and the
    table's folders are not listed; otherwise the files are skipped by their own statistics.
    """
    index = _index(spark, path) if hours is not None else None
    if index is None:
        return _recent(spark.read.schema(schema).parquet(path), time, hours, as_of)
    end = index.agg(F.max("last_us")).first()[0] if as_of is None else spark.range(1).select(F.unix_micros(F.lit(as_of).cast("timestamp"))).first()[0]
    if end is None:
        return spark.read.schema(schema).parquet(path)
    cutoff = end - hours * MICROS_PER_HOUR
    files = [r["file"] for r in index.filter(F.col("last_us") > cutoff).select("file").collect()]
    rows = spark.read.schema(schema).parquet(*sorted(files)) if files else spark.createDataFrame([], schema)
    return rows.filter(F.col(time) > F.timestamp_micros(F.lit(cutoff)))


def _recent(df: DataFrame, time: str, hours: int | None, as_of: str | None) -> DataFrame:
    """Rows strictly newer than ``as_of - hours``, compared on the stored column so files can be skipped."""
    if hours is None:
        return df
    if as_of is None:
        newest = df.agg(F.max(time)).first()[0]
        if newest is None:
            return df
        end = F.lit(newest)
    else:
        end = F.lit(as_of).cast("timestamp")
    cutoff = F.timestamp_micros(F.unix_micros(end) - F.lit(hours * MICROS_PER_HOUR))
    return df.filter(F.col(time) > cutoff)


def _twins(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumns({twin: micros(F.col(time)) for time, twin in names.items()})


JOB_TIMES = {
    "submission_time": "submission_us",
    "start_time": "start_us",
    "completion_time": "completion_us",
}


def scan_jobs(
    spark: SparkSession, path: str, hours: int | None = None, as_of: str | None = None
) -> DataFrame:
    return _twins(_scan(spark, path, schemas.JOBS, "submission_time", hours, as_of), JOB_TIMES)


def scan_job_versions(spark: SparkSession, path: str) -> DataFrame:
    """Every version the upsert sink has appended."""
    schema = f"snapshot_ts timestamp, {schemas.JOBS}, batch_id bigint"
    return spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(path)


def scan_current_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each job; of equally new ones the later batch counts."""
    versions = scan_job_versions(spark, path)
    newest = [F.col("snapshot_ts").desc_nulls_last(), F.col("batch_id").desc()]
    return _twins(latest_rows(versions, ["job_id"], newest), JOB_TIMES)


def scan_job_table(spark: SparkSession, path: str) -> DataFrame:
    """The jobs of a table kept by :func:`jobtide.sources.sinks.replace_jobs`: a row each, nothing to rank."""
    from jobtide.sources.sinks import job_table

    return _twins(job_table(spark, path).read(), JOB_TIMES)


def scan_cluster_states(
    spark: SparkSession, path: str, hours: int | None = None, as_of: str | None = None
) -> DataFrame:
    return _twins(_scan(spark, path, schemas.CLUSTER_STATES, "timestamp", hours, as_of), {"timestamp": "ts_us"})
