"""Quantities, status rules, predicates, rewards and encodings on hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from jobtide.functions import clock, encoding, quantities, rewards, status
from jobtide.functions.hashing import normal, uniform


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, cores",
    [("500m", 0.5), ("2", 2.0), ("0.25", 0.25), ("", 0.0), ("0", 0.0), (None, 0.0), ("100n", None), ("1e3m", 1.0), ("m", None)],
)
def test_cpu(spark, text, cores):
    column = F.lit(text).cast("string")
    assert one(spark, quantities.parse_cpu(column)) == cores
    assert one(spark, quantities.cpu_unreadable(column)) == (cores is None)


@pytest.mark.parametrize(
    "text, gib",
    [
        ("2Gi", 2.0), ("512Mi", 0.5), ("1G", 1e9 / 2**30), ("1048576", 2**20 / 2**30), ("1Ti", 1024.0), ("1K", 1000 / 2**30),
        ("1k", 0.0), ("2Pi", 0.0), ("500m", 0.0), ("", 0.0), ("0", 0.0), (None, 0.0), ("xGi", None), ("Mi", None),
    ],
)
def test_memory(spark, text, gib):
    column = F.lit(text).cast("string")
    found = one(spark, quantities.parse_memory(column))
    assert found == (None if gib is None else pytest.approx(gib))
    assert one(spark, quantities.memory_unreadable(column)) == (gib is None)


def _status(spark, rule, succeeded=None, failed=None, active=None, suspend=None, missing=False):
    counts = F.struct(*[F.lit(v).cast("int").alias(n) for n, v in (("succeeded", succeeded), ("failed", failed), ("active", active))])
    counts = F.when(F.lit(not missing), counts)
    return one(spark, rule(counts, F.struct(F.lit(suspend).cast("boolean").alias("suspend"))))


def test_status_precedence(spark):
    assert _status(spark, status.job_status, succeeded=1, suspend=True) == "Succeeded"
    assert _status(spark, status.job_status_monitor, succeeded=1, suspend=True) == "Suspended"
    assert _status(spark, status.job_status, succeeded=0, failed=2, active=1) == "Failed"
    assert _status(spark, status.job_status, active=1, suspend=True) == "Running"
    assert _status(spark, status.job_status, suspend=True) == "Suspended"
    assert _status(spark, status.job_status) == "Pending"
    assert _status(spark, status.job_status, missing=True) == "Unknown"
    assert _status(spark, status.job_status_monitor, missing=True) == "Pending"


def test_transitions_named(spark):
    pairs = spark.createDataFrame(
        [("Suspended", "Pending"), ("Pending", "Failed"), ("Running", "Pending"), (None, "Running")], "a string, b string"
    )
    names = [r[0] for r in pairs.select(status.event_type(F.col("a"), F.col("b"))).collect()]
    assert names == ["admitted", "rejected", None, None]


def test_nodes_without_conditions_or_taints(spark):
    taints = "array<struct<key: string, effect: string>>"
    conditions = "array<struct<type: string, status: string>>"
    rows = spark.createDataFrame(
        [
            (1, None, None),
            (2, None, [("Ready", "True")]),
            (3, [("a", "NoExecute")], [("Ready", "True")]),
            (4, [("a", "PreferNoSchedule")], [("MemoryPressure", "False"), ("Ready", "True")]),
            (5, [], [("Ready", "Unknown")]),
        ],
        f"id int, taints {taints}, conditions {conditions}",
    )
    found = rows.select(
        "id", status.node_ready(F.col("conditions")), status.node_schedulable(F.col("taints"), F.col("conditions"))
    ).collect()
    assert [tuple(r) for r in found] == [(1, False, False), (2, True, True), (3, True, False), (4, True, True), (5, False, False)]


def test_oom_event_is_case_sensitive(spark):
    rows = spark.createDataFrame(
        [("OOMKilling", None), ("x", "OutOfMemory: y"), ("oom", "outofmemory"), (None, None)], "r string, m string"
    )
    assert [r[0] for r in rows.select(status.oom_event(F.col("r"), F.col("m"))).collect()] == [True, True, False, False]


def test_cutoff_is_strict(spark):
    hour = clock.MICROS_PER_HOUR
    rows = spark.createDataFrame([(9 * hour,), (9 * hour + 1,)], "us bigint")
    assert rows.filter(clock.since(F.col("us"), F.lit(10 * hour), 1)).count() == 1
    assert rows.filter(clock.retained(F.col("us"), F.lit(9 * hour + 24 * hour), 1)).count() == 2


def _live(spark, reduction=0, util=0.0, queue=0, wait=0.0, failed=False, snapshot=True):
    return one(
        spark,
        rewards.live_reward(F.lit(reduction), F.lit(util), F.lit(queue), F.lit(wait), F.lit(failed), F.lit(snapshot)),
    )


def test_live_reward(spark):
    assert _live(spark, reduction=10) == 1.0
    assert _live(spark, reduction=-3) == 0.0
    assert _live(spark, queue=0, wait=600.0) == 0.0
    assert _live(spark, queue=2, wait=30.0) == pytest.approx(-0.1)
    assert _live(spark, queue=2, wait=600.0, failed=True) == pytest.approx(-0.3)
    assert _live(spark, util=0.5, snapshot=False) == -1.0


def test_immediate_and_placement_reward(spark):
    lit = F.lit
    assert one(spark, rewards.immediate_reward(lit(False), lit(1), lit(1), lit(1.0), lit(1.0), lit(0), lit(1))) == -1.0
    earned = rewards.immediate_reward(lit(True), lit(50), lit(100), lit(0.4), lit(0.6), lit(7200), lit(4))
    assert one(spark, earned) == pytest.approx(0.4 * 0.5 + 0.3 * 0.5 - 0.2 * 0.5)
    placed = lambda valid, fits: rewards.placement_reward(
        lit(valid), lit(fits), lit(1800), lit(0.5), lit(0.7), lit(0.1), lit(8)
    )
    assert one(spark, placed(False, True)) == -0.1
    assert one(spark, placed(True, False)) == -0.5
    assert one(spark, placed(True, True)) == pytest.approx(0.1 - 0.1 + 0.18 + 0.18 + 0.08)


def test_actions(spark):
    assert tuple(one(spark, rewards.decode_action(F.lit(37), 16))) == (2, 5)
    kinds = [one(spark, rewards.classify_action(F.lit(a), F.lit(q))) for a, q in ((0, 1), (1, 1), (10, 20), (9, 20))]
    assert kinds == ["admit", "wait", "wait", "admit"]
    assert one(spark, rewards.is_terminated(F.lit(0), F.lit(20))) is False
    assert one(spark, rewards.is_truncated(F.lit(200), F.lit(0))) is True


def test_encodings(spark):
    assert one(spark, encoding.encode_job_type(F.lit("etl"))) == 0.5
    assert one(spark, encoding.encode_job_type(F.lit("other"))) == 0.2
    assert one(spark, encoding.encode_job_type(F.lit(None).cast("string"))) == 0.2
    assert one(spark, encoding.encode_job_type_ordinal(F.lit("cron_job"))) == 0.8
    assert one(spark, encoding.encode_job_type_ordinal(F.lit("other"))) == 0.0
    assert one(spark, encoding.cluster_utilization(F.lit(None).cast("double"), F.lit(1.0))) == 0.0


def test_hashed_draws_look_random(spark):
    draws = spark.range(20000).select(uniform(3, F.col("id")).alias("u"), normal(4, F.col("id")).alias("n"))
    row = draws.agg(F.avg("u"), F.stddev_pop("u"), F.avg("n"), F.stddev_pop("n"), F.min("u"), F.max("u")).first()
    assert row[0] == pytest.approx(0.5, abs=0.01) and row[1] == pytest.approx(math.sqrt(1 / 12), abs=0.01)
    assert row[2] == pytest.approx(0.0, abs=0.03) and row[3] == pytest.approx(1.0, abs=0.02)
    assert 0 < row[4] and row[5] < 1
