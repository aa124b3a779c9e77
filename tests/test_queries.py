"""Every registered query against its oracle SQL on the smallest given tables."""

import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from jobtide.plans import q_streams, q_tables
from tests.oracle import compare, database

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are missing")


@pytest.fixture(scope="module")
def db():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    sql = oracle_sql().get(name)
    if sql is None:
        assert queries()[name](spark, SF_DIR).count() > 0
    else:
        assert compare(spark, db, name, queries()[name], sql, SF_DIR) is None


STREAMS = ["append_states_stream", "status_refresh", "status_transitions_stream", "status_transitions_keyed", "monitor_stream", "alert_stream", "oom_rate_stream", "burst_sessions_stream", "collect_events"]
DAILY = ["collect_stream", "collect_states", "collect_gauges", "collect_quarantine", "collect_audit"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with the events as a folder of parts."""
    path = tmp_path_factory.mktemp("folder")
    for name in os.listdir(SF_DIR):
        if name != "events.parquet":
            os.symlink(f"{SF_DIR}/{name}", path / name)
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    events.repartition(2, F.xxhash64("ts")).write.parquet(str(path / "events.parquet"))  # every part reaches over the whole time
    return str(path)


@pytest.mark.parametrize("files", [1, 1000])
@pytest.mark.parametrize("name", STREAMS)
def test_streams_do_not_depend_on_files_or_triggers(spark, db, folder, monkeypatch, name, files):
    monkeypatch.setattr(q_streams, "MAX_FILES", files)
    monkeypatch.setattr(q_tables, "MAX_FILES", files)
    assert compare(spark, db, name, queries()[name], oracle_sql()[name], folder) is None


@pytest.mark.parametrize("files", [1, 1000])
def test_collector_does_not_depend_on_files_or_triggers(spark, db, folder, monkeypatch, files):
    """One run of the collector answers all queries of its daily polls."""
    monkeypatch.setattr(q_tables, "MAX_FILES", files)
    out = q_tables._collected(spark, q_tables._daily(spark, folder))
    monkeypatch.setattr(q_tables, "_collected", lambda *_: out)
    monkeypatch.setattr(q_tables, "_daily", lambda *_: {})
    for name in DAILY:
        assert compare(spark, db, name, queries()[name], oracle_sql()[name], folder) is None


def test_active_at_tick_writes_every_tick_out(spark):
    """A row for each job and tick, as many as the ranges hold."""
    rows = queries()["active_at_tick"](spark, SF_DIR)
    assert rows.columns == ["job_id", "tick_us"]
    assert rows.count() == queries()["active_ranges"](spark, SF_DIR).agg(F.sum("ticks")).first()[0]


def test_entry(spark):
    rows = entry(spark)
    assert len(rows.columns) == 18 and rows.count() > 0
