"""Fitting pairs of queued jobs and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.operators import placement
from jobtide.operators.ordered import OrderedScan
from jobtide.plans.registry import query
from jobtide.plans.views import oracle, view

_PAIRS = """top as (
  select * from (select *, row_number() over (partition by snapshot_id order by priority desc, arrival_us, job_id) as r from pending_queue) t
  where r <= 10),
pairs as (
  select t.snapshot_id, cast(r - 1 as int) as job_idx, job_id, node_id,
    cpu_total - cpu_used - cpu_request + memory_total - memory_used - memory_request as waste
  from top t join nodes n on n.snapshot_id = t.snapshot_id
    and cpu_total - cpu_used >= cpu_request and memory_total - memory_used >= memory_request)"""
_BEST = "{'w': waste, 'j': job_idx, 'n': node_id}"
_FIRST = "{'j': job_idx, 'n': node_id}"


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "pending_queue"), view(spark, sf_dir, "nodes")


@query(oracle(f"with {_PAIRS} select * from pairs", "pending_queue", "nodes"))
def fit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.fit_candidates(*_inputs(spark, sf_dir))


def _best_sql(condition: str) -> str:
    body = f"""with {_PAIRS} select snapshot_id, arg_min(job_idx, {_BEST}) as job_idx, arg_min(job_id, {_BEST}) as job_id,
      arg_min(node_id, {_BEST}) as node_id, min(waste) as waste from pairs {condition} group by snapshot_id"""
    return oracle(body, "pending_queue", "nodes")


def _first_sql(condition: str) -> str:
    body = f"""with {_PAIRS} select snapshot_id, arg_min(job_idx, {_FIRST}) as job_idx, arg_min(job_id, {_FIRST}) as job_id,
      arg_min(node_id, {_FIRST}) as node_id from pairs {condition} group by snapshot_id"""
    return oracle(body, "pending_queue", "nodes")


@query(_best_sql(""))
def best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.best_fit(*_inputs(spark, sf_dir))


@query(_best_sql("where job_idx = 0"))
def best_fit_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.best_fit(*_inputs(spark, sf_dir), k=1)


@query(_first_sql(""))
def first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.first_fit(*_inputs(spark, sf_dir))


@query(_first_sql("where job_idx = 0"))
def first_fit_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.first_fit(*_inputs(spark, sf_dir), k=1)


@query(
    oracle(
        """select snapshot_id, job_id, priority, arrival_us,
          row_number() over (order by priority desc, arrival_us, job_id) as position from pending_queue""",
        "pending_queue",
    )
)
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = view(spark, sf_dir, "pending_queue").select("snapshot_id", "job_id", "priority", "arrival_us")
    """The whole queue in order, each row with its position."""
    ordered = queue.withColumn("__low", -F.col("priority"))
    return OrderedScan(ordered, [], ["__low", "arrival_us", "job_id"]).row_number("position").result().drop("__low")
