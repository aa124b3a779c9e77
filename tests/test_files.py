"""Readers, writers and streams on files."""

import json
import os
import random
import shutil
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobtide.operators import cluster, stats
from jobtide.operators.transitions import status_transitions
from jobtide.plans import q_tables
from jobtide.session import scratch
from jobtide.sources import sinks, snapshots, tables
from jobtide.streaming import collect, monitor, transitions

START = datetime(2024, 1, 1)
SNAPSHOTS = "job_id string, ts_us bigint, status string, submission_us bigint, start_us bigint"


def poll(minute, jobs, oom=()):
    """One poll as JSON lines: (name, suspend, active, succeeded) jobs, one node, one pod per oom job."""
    when = (START + timedelta(minutes=minute)).isoformat() + "Z"
    lines = []
    for name, suspend, active, succeeded in jobs:
        lines.append({
            "kind": "job", "snapshot_ts": when,
            "job": {
                "metadata": {"uid": name, "name": name, "namespace": "ns", "creationTimestamp": START.isoformat() + "Z",
                             "labels": {"priority": "3" if name != "bad" else "x"}},
                "spec": {"suspend": suspend, "template": {"spec": {"containers": [
                    {"name": "m", "resources": {"requests": {"cpu": "500m", "memory": "1Gi"}}}]}}},
                "status": {"active": active, "succeeded": succeeded},
            },
        })
    lines.append({
        "kind": "node", "snapshot_ts": when,
        "node": {"name": "n", "capacity": {"cpu": "8", "memory": "16Gi"}, "allocatable": {"cpu": "6", "memory": "8Gi"},
                 "conditions": [{"type": "Ready", "status": "True"}]},
    })
    killed = [{"state": {}, "last_state": {"terminated": {"reason": "OOMKilled"}}}]
    for name in oom:
        pod = {"namespace": "ns", "labels": {"job-name": name}, "phase": "Running", "container_statuses": killed}
        lines.append({"kind": "pod", "snapshot_ts": when, "pod": pod})
    return "\n".join(json.dumps(line) for line in lines)


def test_collector_end_to_end(spark, tmp_path):
    source, out = tmp_path / "polls", str(tmp_path / "out")
    source.mkdir()

    def run():
        polls = snapshots.read_polls(spark, str(source), max_files=1)
        collect.collect_stream(polls, out, str(tmp_path / "cp"), once=True).awaitTermination()

    (source / "1.json").write_text(poll(0, [("a", True, 0, 0), ("b", False, 1, 0), ("bad", False, 0, 0)]))
    run()
    (source / "2.json").write_text(poll(10, [("a", False, 2, 0), ("b", False, 0, 1)], oom=["b"]))
    run()

    jobs = {r["job_id"]: r for r in collect.collected_jobs(spark, out).collect()}
    assert {k: (r["status"], r["oom_killed"], r["cpu_request"]) for k, r in jobs.items()} == {
        "a": ("Running", False, 0.5),
        "b": ("Succeeded", True, 0.5),
    }

    def states():
        rows = collect.collected_states(spark, out).orderBy("timestamp").collect()
        return [(r["timestamp"], r["pending_jobs_count"], r["running_jobs_count"], r["avg_cpu_utilization"]) for r in rows]

    assert [r[1:] for r in states()] == [(1, 1, 0.25), (0, 2, 0.25)]
    gauges = collect.collected_metrics(spark, out)
    assert gauges.count() == 8 and gauges.select("metric_name").distinct().count() == 4
    audit = collect.collected_audit(spark, out)
    assert tuple(audit.agg(F.sum("jobs_collected"), F.sum("states_collected"), F.sum("errors")).first()) == (4, 2, 1)
    assert [r["job_id"] for r in collect.collected_quarantine(spark, out).collect()] == ["bad"]

    sinks.compact_jobs(spark, f"{out}/jobs", f"{out}/jobs2")
    assert tables.scan_current_jobs(spark, f"{out}/jobs2").count() == 2
    assert tables.scan_job_versions(spark, f"{out}/jobs2").count() == 2

    events = collect.collected_events(spark, out).orderBy("job_id").collect()
    assert [(r["job_id"], r["event_type"]) for r in events] == [("b", "completed")]

    # a repeated batch replaces itself
    again, before = snapshots.read_polls(spark, str(source / "2.json"), stream=False), states()
    collect.collect_batch(again, 1, out)
    assert states() == before
    assert [(r["job_id"], r["event_type"]) for r in collect.collected_events(spark, out).collect()] == [("b", "completed")]
    # an older poll in a later batch does not win, but is put in its place
    (source / "0.json").write_text(poll(-5, [("a", True, 0, 0), ("b", True, 0, 0)]))
    run()
    assert {r["job_id"]: r["status"] for r in collect.collected_jobs(spark, out).collect()} == {"a": "Running", "b": "Succeeded"}
    assert [r[1:3] for r in states()] == [(2, 0), (1, 1), (0, 2)]


def test_a_batch_reads_no_earlier_objects(spark, tmp_path):
    """Everything but the last statuses may be gone, and a batch in order of time is written all the same."""
    source, out = tmp_path / "polls", str(tmp_path / "out")
    source.mkdir()
    for minute, status in enumerate([(True, 0, 0), (False, 1, 0), (False, 0, 1)]):
        (source / f"{minute}.json").write_text(poll(minute, [("a", *status)]))
        collect.collect_stream(snapshots.read_polls(spark, str(source)), out, str(tmp_path / "cp"), once=True).awaitTermination()
        for name in ("partials", "kills", "quarantine", "jobs", "transitions/versions"):
            assert [n for n in os.listdir(f"{out}/{name}") if n.startswith("batch_id")] == [f"batch_id={minute}"]
            shutil.rmtree(f"{out}/{name}")
    assert [r["event_type"] for r in collect.collected_events(spark, out).orderBy("timestamp").collect()] == ["completed"]


def test_collector_does_not_depend_on_triggers(spark, tmp_path):
    """The same polls, a line a file: one file a trigger, or all files in one."""
    source = tmp_path / "polls"
    source.mkdir()
    polls = [poll(0, [("a", True, 0, 0), ("b", False, 1, 0)], oom=["b"]), poll(10, [("a", False, 1, 0), ("b", False, 0, 1)], oom=["b"])]
    event = {"kind": "event", "snapshot_ts": "2024-01-01T00:10:00Z", "event": {"reason": "OOMKilling", "event_time": "2024-01-01T00:09:00Z"}}
    lines = [line for text in polls for line in text.split("\n")] + [json.dumps(event)]
    for i, line in enumerate(reversed(lines)):  # pods and later polls first
        (source / f"{i}.json").write_text(line)
    found = []
    for files in (1, 1000):
        out = str(tmp_path / f"out{files}")
        stream = snapshots.read_polls(spark, str(source), max_files=files)
        collect.collect_stream(stream, out, str(tmp_path / f"cp{files}"), once=True).awaitTermination()
        jobs = collect.collected_jobs(spark, out).select("job_id", "status", "oom_killed").orderBy("job_id").collect()
        states = collect.collected_states(spark, out).select("timestamp", "pending_jobs_count", "running_jobs_count", "metadata")
        rows = [
            jobs,
            states.orderBy("timestamp").collect(),
            collect.collected_events(spark, out).select("job_id", "event_type", "timestamp").orderBy("job_id").collect(),
            collect.collected_metrics(spark, out).select("timestamp", "metric_name", "metric_value").orderBy("timestamp", "metric_name").collect(),
            collect.collected_audit(spark, out).select("snapshot_ts", "jobs_collected", "states_collected").orderBy("snapshot_ts").collect(),
        ]
        found.append([list(map(tuple, r)) for r in rows])
    assert found[0] == found[1]
    assert found[0][0] == [("a", "Running", False), ("b", "Succeeded", True)]
    assert [json.loads(r[3])["oom_rate"] for r in found[0][1]] == [0.0, 1.0]
    assert [r[:2] for r in found[0][2]] == [("b", "completed")]


def test_collector_reads_and_writes_objects_once(spark, tmp_path):
    """Objects go into the polls without files of their own, and the sums of a poll read each kind once."""
    written = lambda: {name for name in os.listdir(os.path.dirname(scratch(spark, "x")).removeprefix("file:")) if name.startswith("objects-")}
    spark.range(1).write.parquet(scratch(spark, "y"))
    before = written()
    rows = spark.createDataFrame([(1, START, 7, "click", 2.5, '{"k": 8}')], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(1, 1)], "s_suppkey bigint, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    assert len(q_tables._daily(spark, str(tmp_path))) == 5
    assert written() == before
    (tmp_path / "1.json").write_text(poll(0, [("a", True, 0, 0), ("b", False, 1, 0), ("bad", True, 0, 0)], oom=["b"]))
    polls = snapshots.read_polls(spark, str(tmp_path / "1.json"), stream=False)
    jobs, workloads, nodes, events = (snapshots.objects(polls, kind) for kind in ("job", "workload", "node", "event"))
    sums = cluster.poll_sums(nodes, jobs, workloads, snapshots.with_event_time(events))
    assert sums._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 4
    assert sums.select("running_jobs", "pending_jobs_count", "jobs_seen", "errors", "node_count").first()[:] == (1, 1, 3, 1, 1)


def test_readers(spark, tmp_path):
    (tmp_path / "e.json").write_text(
        "\n".join(
            [
                '{"namespace": "a", "reason": "OOM", "first_timestamp": "2024-01-01T00:00:01.000002Z", "event_time": "2024-01-02T00:00:00Z"}',
                '{"namespace": "a", "reason": "x", "event_time": "2024-01-02T00:00:00Z"}',
            ]
        )
    )
    seen = sorted(r["event_us"] for r in snapshots.read_cluster_events(spark, str(tmp_path)).collect())
    assert seen == [1704067201000002, 1704153600000000]


LIFE = [
    ("a", 10, "Suspended"), ("a", 20, "Pending"), ("a", 30, "Pending"), ("a", 40, "Running"), ("a", 50, "Succeeded"),
    ("b", 10, "Pending"), ("b", 25, "Failed"), ("b", 60, "Failed"), ("c", 35, "Running"), ("c", 45, "Suspended"), ("c", 55, "Pending"),
]


def write_polls(spark, path, rows):
    rows = [(job, ts * 1_000_000, status, 0, ts * 1_000_000 if status == "Running" else None) for job, ts, status in rows]
    spark.createDataFrame(rows, SNAPSHOTS).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("keyed", [False, True])
def test_stream_transitions_equal_batch(spark, tmp_path, keyed):
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))

    def run():
        stream = spark.readStream.schema(SNAPSHOTS).parquet(source)
        if keyed:
            with transitions.rocksdb(spark):
                collect.append_stream(transitions.status_changes_keyed(stream), out, checkpoint, once=True).awaitTermination()
        else:
            transitions.transitions_by_batch(stream, out, checkpoint, once=True).awaitTermination()

    write_polls(spark, source, [r for r in LIFE if r[1] <= 28])
    run()
    write_polls(spark, source, [r for r in LIFE if r[1] > 28])
    run()
    write_polls(spark, source, [("b", 25, "Failed"), ("a", 10, "Suspended")])  # known already
    run()
    rows = transitions.keyed_transitions(spark.read.parquet(out)) if keyed else transitions.batch_transitions(spark, out)
    wanted = whole(spark, LIFE)
    assert sorted(map(str, rows.select(wanted.columns).collect())) == sorted(map(str, wanted.collect()))
    assert sorted((r["job_id"], r["event_type"]) for r in wanted.collect()) == [
        ("a", "admitted"), ("a", "completed"), ("a", "scheduled"), ("b", "rejected"), ("c", "admitted"),
    ]


def whole(spark, life):
    rows = [(j, t * 1_000_000, s, 0, t * 1_000_000 if s == "Running" else None) for j, t, s in life]
    return status_transitions(spark.createDataFrame(rows, SNAPSHOTS))


@pytest.mark.parametrize("keyed", [False, True])
def test_order_of_snapshots_does_not_matter(spark, tmp_path, keyed, monkeypatch):
    """One row per file and trigger, dealt at random: late versions change what their neighbours told."""
    monkeypatch.setattr(transitions, "ROWS_AT_ONCE", 2)
    rng = random.Random(12)
    statuses = ["Suspended", "Pending", "Running", "Succeeded", "Failed"]
    life = [(j, t, rng.choice(statuses)) for j in "abc" for t in rng.sample(range(100), 7)] + [("a", 200, "Pending"), ("a", 200, "Running"), ("late", 3, "Pending"), ("late", 4, "Running")]
    parts = [[life[i] for i in range(k, len(life), 5)] for k in range(5)]
    parts[-1] += [life[0], life[1]]  # told twice
    out, checkpoint, source = (str(tmp_path / name) for name in ("out", "cp", "in"))
    for batch, part in enumerate(parts):
        write_polls(spark, source, rng.sample(part, len(part)))
        if keyed:
            stream = spark.readStream.schema(SNAPSHOTS).parquet(source)
            with transitions.rocksdb(spark):
                collect.append_stream(transitions.status_changes_keyed(stream), out, checkpoint, once=True).awaitTermination()
        else:
            rows = [(j, t * 1_000_000, s, 0, t * 1_000_000 if s == "Running" else None) for j, t, s in part]
            for _ in range(2 if batch == 3 else 1):  # a retry changes nothing
                transitions.transition_batch(spark.createDataFrame(rows, SNAPSHOTS), batch, out)
    if keyed:
        told = spark.read.parquet(out)
        assert told.agg(F.max("revision")).first()[0] > 0
        rows = transitions.keyed_transitions(told)
    else:
        rows = transitions.batch_transitions(spark, out)
    wanted = whole(spark, life)
    assert sorted(map(str, rows.select(wanted.columns).collect())) == sorted(map(str, wanted.collect()))


def test_jobs_share_the_calls_of_the_state_store(monkeypatch):
    """A trigger makes three calls for all jobs of a bucket, and one more if a row is late."""
    calls = []

    class State:
        def __init__(self, name, value):
            self.name, self.value = name, value

        def get(self):
            calls.append(self.name)
            return iter(self.value) if self.name == "log" else self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def appendValue(self, value):
            calls.append("append")
            self.value.append(value)

    class Handle:
        getValueState = staticmethod(lambda name, _: State(name, None))
        getListState = staticmethod(lambda name, _: State(name, []))

    bucket = transitions.BucketVersions()
    bucket.init(Handle)

    def trigger(*rows):
        calls.clear()
        columns = ["job_id", "ts_us", "status", "submission_us", "start_us"]
        frame = pd.DataFrame([(*row, 0, transitions.NEVER_US) for row in rows], columns=columns)
        return [row for told in bucket.handleInputRows((0,), [frame], None) for row in told.itertuples(index=False)]

    assert len(trigger(*[(f"j{i}", 10 + k, s) for i in range(200) for k, s in enumerate(("Pending", "Running"))])) == 200
    assert calls == ["newest", "append", "update"]
    assert len(trigger(*[(f"j{i}", 20, "Succeeded") for i in range(200)])) == 200
    assert calls == ["newest", "append", "update"]
    late = trigger(("j7", 15, "Failed"), ("j8", 11, "Running"))
    assert [(r.job_id, r.ts_us, r.prev_status, r.status, r.revision, r.start_us) for r in late] == [
        ("j7", 15, "Running", "Failed", 0, None), ("j7", 20, "Failed", "Succeeded", 1, None),
    ]
    assert calls == ["newest", "log", "append", "update"]


def test_a_batch_in_order_reads_no_history(spark, tmp_path):
    out = str(tmp_path)
    for batch, (ts, status) in enumerate([(10, "Pending"), (20, "Running"), (30, "Succeeded")]):
        rows = [(j, ts * 1_000_000, status, 0, None) for j in "ab"]
        transitions.transition_batch(spark.createDataFrame(rows, SNAPSHOTS), batch, out)
        shutil.rmtree(f"{out}/versions/batch_id={batch}")
        shutil.rmtree(f"{out}/events/batch_id={batch - 1}", ignore_errors=True)
    assert sorted((r["job_id"], r["event_type"]) for r in transitions.batch_transitions(spark, out).collect()) == [("a", "completed"), ("b", "completed")]


def test_state_of_old_versions_leaves(spark, tmp_path):
    """With a bound on lateness, versions nothing can get between leave, and finished jobs are forgotten."""
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))
    hour = 3600
    parts = [
        [("a", 1, "Pending"), ("a", 5, "Running"), ("done", 2, "Running"), ("done", 3, "Succeeded")], [("b", 2 * hour, "Pending")], [("b", 3 * hour, "Pending")],
        [("a", 3 * hour, "Succeeded"), ("done", 3 * hour, "Running")], [("b", 4 * hour, "Running"), ("a", 2, "Suspended")], [("b", 5 * hour, "Running")],
    ]
    for part in parts:
        write_polls(spark, source, part)
        stream = spark.readStream.schema(SNAPSHOTS).parquet(source)
        changes = transitions.status_changes_keyed(stream, late="30 minutes", finished_us=hour * 1_000_000)
        with transitions.rocksdb(spark):
            collect.append_stream(changes, out, checkpoint, once=True).awaitTermination()
    rows = transitions.keyed_transitions(spark.read.parquet(out)).collect()
    assert sorted((r["job_id"], r["event_type"]) for r in rows) == [("a", "completed"), ("a", "scheduled"), ("b", "scheduled"), ("done", "completed")]


def test_finished_jobs_leave_the_table(spark, tmp_path):
    out = str(tmp_path)
    day = 24 * 3600
    first = [("done", 10, "Succeeded"), ("slow", 10, "Running"), ("gone", 10, "Running")]
    later = [("slow", 2 * day, "Running"), ("new", 2 * day, "Pending")]
    end = [("slow", 9 * day, "Succeeded")]
    for batch, rows in enumerate([first, later, end]):
        df = spark.createDataFrame([(j, t * 1_000_000, s, 0, None) for j, t, s in rows], SNAPSHOTS)
        transitions.transition_batch(df, batch, out, finished_us=3600 * 1_000_000, idle_us=7 * day * 1_000_000)
    known = {r["job_id"] for r in spark.read.parquet(f"{out}/last/batch_id=1").collect()}
    assert known == {"slow", "gone", "new"}
    assert {r["job_id"] for r in spark.read.parquet(f"{out}/last/batch_id=2").collect()} == {"slow", "new"}
    assert spark.read.parquet(f"{out}/events").count() == 1


def test_window_streams_equal_batch(spark, tmp_path):
    """No window stays open and no row is late, however the rows are spread over triggers."""
    second = 1_000_000
    events = [(i * 7 * second, "OOMKilling" if i % 5 == 0 else "x", "") for i in range(2000)]
    path = str(tmp_path / "events")
    frame = spark.createDataFrame(events, "event_us bigint, reason string, message string")
    frame.repartition(4).write.parquet(path)
    batch = sorted(map(tuple, monitor.oom_rates(monitor.oom_slides(frame)).collect()))
    for files in (1, 1000):
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", files).parquet(path)
        out, checkpoint = str(tmp_path / f"out{files}"), str(tmp_path / f"cp{files}")
        collect.update_stream(monitor.oom_slides(stream), out, checkpoint, once=True).awaitTermination()
        slides = collect.updated(spark, out, "slide_us bigint, oom bigint, total bigint", ["slide_us"])
        assert sorted(map(tuple, monitor.oom_rates(slides).collect())) == batch
    some = next(r for r in batch if r[0] == 3600 * second)
    inside = [e for e in events if 3600 * second <= e[0] < 7200 * second]
    assert some[1:3] == (sum(e[1] == "OOMKilling" for e in inside), len(inside))


def test_rate_comes_out_of_the_stream(spark, tmp_path):
    """Late rows within the delay count, later ones do not, and a window comes out once, when it is closed."""
    minute, schema = 60_000_000, "event_us bigint, reason string, message string"
    path, out, checkpoint = (str(tmp_path / name) for name in ("events", "out", "cp"))
    parts = [
        [(m * minute, "OOMKilling" if m % 5 == 0 else "x", "") for m in range(0, 100, 2)],
        [(m * minute, "y", "OutOfMemory") for m in range(61, 100, 4)],  # late, in time
        [(400 * minute, None, None)],  # a poll without events
        [(5 * minute, "OOMKilling", "")],  # too late
        [(2000 * minute, None, None)],
    ]
    seen = 0
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        collect.append_stream(monitor.oom_rate_stream(stream, "1 hour"), out, checkpoint, once=True).awaitTermination()
        rows = spark.read.parquet(out).collect() if os.path.isdir(out) else []
        assert len(rows) >= seen and len({r["window_start_us"] for r in rows}) == len(rows)
        seen = len(rows)
    frame = spark.createDataFrame(parts[0] + parts[1], schema)
    wanted = monitor.oom_rates(monitor.oom_slides(frame))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, wanted.collect()))


def test_alerts_of_changed_windows_and_compaction(spark, tmp_path):
    """An alert is told in the trigger of its sample, and no longer holds once a later sample of the window is calm."""
    schema, second = "scheduler string, ts_us bigint, oom_incidents int, jobs_pending int", 1_000_000
    path, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))
    parts = [[("s", 1 * second, 9, 0), ("s", 40 * second, 0, 99)], [("s", 5 * second, 1, 0)], [("t", 2 * second, 8, 0)]]
    keys, alerts = ["window_start_us", "scheduler"], "window_start_us bigint, scheduler string, type string, severity string, message string"

    def told():
        rows = collect.told_rows(spark, out, "window_start_us bigint, scheduler string", alerts, keys).collect()
        return sorted((r["scheduler"], r["window_start_us"] // second, r["type"]) for r in rows)

    seen = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        rows = monitor.monitor_stream(spark.readStream.schema(schema).parquet(path), ["scheduler"], monitor.ALERT_GAUGES)
        collect.update_stream(rows, out, checkpoint, once=True, told=lambda w: monitor.window_alerts(w, ["scheduler"])).awaitTermination()
        seen.append(told())
    assert seen == [
        [("s", 0, "high_oom_rate"), ("s", 30, "queue_congestion")], [("s", 30, "queue_congestion")], [("s", 30, "queue_congestion"), ("t", 0, "high_oom_rate")],
    ]
    windows = "window_start_us bigint, scheduler string, oom_incidents int, jobs_pending int"
    before = sorted(map(tuple, collect.updated(spark, out, windows, keys).collect()))
    last = max(int(n.split("=")[1]) for n in os.listdir(out) if "=" in n)
    collect.compact_updates(spark, out, windows, keys, last, alerts)
    assert told() == seen[-1]
    assert [n for n in os.listdir(out) if "=" in n] == [f"batch_id={last}"]
    assert sorted(map(tuple, collect.updated(spark, out, windows, keys).collect())) == before


def test_sessions_of_a_stream_merge(spark, tmp_path):
    """An arrival that comes late joins two sessions; with a watermark closed sessions are appended."""
    schema, second = "job_id string, user string, submission_us bigint", 1_000_000
    path, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))
    parts = [[("a", "u", 0), ("b", "u", 8 * second), ("c", "v", 3 * second)], [("d", "u", 4 * second)], [("e", "u", 900 * second)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        rows = monitor.burst_stream(stream, "5 seconds", ["user"], watermark="1 minute")
        collect.append_stream(rows, out, checkpoint, once=True).awaitTermination()
    found = [tuple(r) for r in spark.read.parquet(out).orderBy("user").collect()]
    assert found == [("u", 0, 8 * second, 3), ("v", 3 * second, 3 * second, 1)]


def test_status_refresh(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("a", "Running")], [("b", "Running"), ("c", "Failed")]):
        spark.createDataFrame(rows, "job_id string, status string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("job_id string, status string").parquet(source)
        collect.status_refresh(stream, out, str(tmp_path / "cp"), once=True).awaitTermination()
    newest = spark.read.parquet(f"{out}/batch_id=1").collect()
    assert {r["status"]: r["jobs"] for r in newest} == {"Running": 2, "Failed": 1}


def test_table_writers(spark, tmp_path):
    states = spark.createDataFrame([(START, 4.0), (START + timedelta(days=1), None)], "timestamp timestamp, available_cpu double")
    path = str(tmp_path / "states")
    sinks.append_cluster_states(states, path)
    back = tables.scan_cluster_states(spark, path)
    assert [(r["available_cpu"], r["queue_length"]) for r in back.orderBy("timestamp").collect()] == [(4.0, 0), (0.0, 0)]
    assert tables.scan_cluster_states(spark, path, hours=24).count() == 1
    assert tables.scan_cluster_states(spark, path, hours=24, as_of="2024-01-01 12:00:00").count() == 2

    events = spark.createDataFrame([(START, "j", "admitted")], "timestamp timestamp, job_id string, event_type string")
    sinks.append_scheduling_events(events, str(tmp_path / "events"), 0)
    sinks.append_scheduling_events(events, str(tmp_path / "events"), 0)
    rows = spark.read.parquet(str(tmp_path / "events")).collect()
    assert len(rows) == 1 and rows[0]["scheduler_name"] == "unknown" and rows[0]["id"] is not None

    metrics = spark.createDataFrame([(START, "m", 1.0)], "timestamp timestamp, metric_name string, metric_value double")
    sinks.append_metrics(metrics, str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).first()["metric_type"] == "gauge"


def test_replaced_jobs(spark, tmp_path, monkeypatch):
    """A batch writes the buckets it touches only; a crash before the swap shows nothing, a retry and a repeat change nothing."""
    path, schema = str(tmp_path / "jobs"), "job_id string, submission_time timestamp, snapshot_ts timestamp, status string"

    def batch(ids, minute, status):
        return spark.createDataFrame([(f"j{i}", START, START + timedelta(minutes=minute), status) for i in ids], schema)

    def current():
        rows = tables.scan_job_table(spark, path).collect()
        assert len({r["job_id"] for r in rows}) == len(rows)
        return {r["job_id"]: r["status"] for r in rows}

    sinks.replace_jobs(batch(range(400), 0, "Pending"), path, 0, buckets=64)
    assert current() == {f"j{i}": "Pending" for i in range(400)}
    sinks.replace_jobs(batch([7], 5, "Running"), path, 1, buckets=64)
    assert [n for n in os.listdir(f"{path}/rows/batch_id=1") if n.startswith("bucket=")].__len__() == 1
    assert current() == {f"j{i}": "Running" if i == 7 else "Pending" for i in range(400)}

    table = sinks.job_table(spark, path, 64)
    crashed = sinks.conform(batch([7, 8], 9, "Failed"), sinks.schemas.JOBS, sinks.JOB_DEFAULTS, [F.col("snapshot_ts")])
    table.stage(crashed, 2)  # and no swap
    assert current()["j8"] == "Pending" and table.manifest()["batch_id"] == 1
    sinks.replace_jobs(batch([7, 8], 9, "Succeeded"), path, 2, buckets=64)  # the retry
    sinks.replace_jobs(batch([7, 8], 99, "Unknown"), path, 2, buckets=64)  # a repeat of a batch that is known
    sinks.replace_jobs(batch([7, 500], 1, "Unknown"), path, 3, buckets=64)  # an older version does not win
    after = current()
    assert (after["j7"], after["j8"], after["j500"], len(after)) == ("Succeeded", "Succeeded", "Unknown", 401)
    assert "Window" not in tables.scan_job_table(spark, path)._jdf.queryExecution().executedPlan().toString()
    table.vacuum()
    assert current() == after and len(table.versions()) == 1
    assert sinks.job_table(spark, str(tmp_path / "none")).read().count() == 0


def test_retention_removes_old_dates(spark, tmp_path):
    days = [(START + timedelta(days=d), float(d)) for d in range(0, 40, 3)] + [(None, -1.0)]
    states = spark.createDataFrame(days, "timestamp timestamp, available_cpu double")
    for name, batch in (("plain", None), ("numbered", 4)):
        path = str(tmp_path / name)
        sinks.append_cluster_states(states, path, batch)
        gone = sinks.apply_retention(spark, path, days=30)
        assert [d.day for d in gone] == [1, 4, 7]  # 1 January is day 0, the newest is day 39
        left = sorted(r["available_cpu"] for r in spark.read.parquet(path).collect())
        assert left == [-1.0, *[float(d) for d in range(9, 40, 3)]]
        assert sinks.apply_retention(spark, path, days=30) == []


def test_scans_open_the_files_of_their_hours(spark, tmp_path):
    """Of 1,000 files an index lets a scan open the few that reach into its hours; folders that went are forgotten."""
    path = str(tmp_path / "states")
    rows = spark.range(2000).select(F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 60_000_000 * 30).alias("timestamp"), F.col("id").cast("double").alias("available_cpu"))
    for batch, part in enumerate((rows.filter("available_cpu < 1000"), rows.filter("available_cpu >= 1000"))):
        sinks.append_cluster_states(part.repartitionByRange(500, "timestamp"), path, batch)
    assert len(spark.read.parquet(path).inputFiles()) >= 1000
    scan = tables.scan_cluster_states(spark, path, hours=24)
    assert len(scan.inputFiles()) <= 30 and sorted(r["available_cpu"] for r in scan.collect()) == [float(i) for i in range(1952, 2000)]
    early = tables.scan_cluster_states(spark, path, hours=10_000, as_of="2024-01-01 03:00:00")
    assert early.count() == 2000  # everything is newer than so long ago
    sinks.apply_retention(spark, path, days=3)
    assert tables.scan_cluster_states(spark, path, hours=10_000).count() == tables.scan_cluster_states(spark, path).count() < 300
    versions = str(tmp_path / "versions")
    sinks.upsert_jobs(spark.createDataFrame([("a", None)], "job_id string, submission_time timestamp"), versions, 0)
    assert tables.scan_jobs(spark, versions, hours=1).count() == 1 and tables.scan_jobs(spark, versions, hours=None).count() == 1


def test_scan_jobs_skips_files(spark, tmp_path):
    rows = [("a", START), ("b", START + timedelta(hours=5)), ("c", None)]
    jobs = sinks.conform(
        spark.createDataFrame(rows, "job_id string, submission_time timestamp"), sinks.schemas.JOBS, sinks.JOB_DEFAULTS
    )
    jobs.write.parquet(str(tmp_path / "jobs"))
    recent = tables.scan_jobs(spark, str(tmp_path / "jobs"), hours=2)
    assert [r["job_id"] for r in recent.collect()] == ["b"]
    assert "PushedFilters: [IsNotNull(submission_time), GreaterThan(submission_time" in recent._sc._jvm.PythonSQLUtils.explainString(
        recent._jdf.queryExecution(), "formatted"
    )


def test_exports(spark, tmp_path):
    minute = 60_000_000
    jobs = spark.createDataFrame(
        [("j", "n", 1.0, 2.0, 3, "ml", "Succeeded", True, 10 * minute, 11 * minute, 13 * minute)],
        "job_id string, name string, cpu_request double, memory_request double, priority int, job_type string, status string, "
        "oom_killed boolean, submission_us bigint, start_us bigint, completion_us bigint",
    )
    states = spark.createDataFrame(
        [(1, 9 * minute, 5.0, 6.0, 0.5, 0.25, 4, 2)],
        "id bigint, ts_us bigint, available_cpu double, available_memory double, avg_cpu_utilization double, "
        "avg_memory_utilization double, queue_length int, running_jobs_count int",
    )
    assert sinks.write_training_csv(jobs, states.limit(0), str(tmp_path / "none")) is None
    assert not (tmp_path / "none").exists()
    sinks.write_training_csv(jobs, states, str(tmp_path / "train"))
    row = spark.read.option("header", True).csv(str(tmp_path / "train")).first().asDict()
    assert len(row) == 18 and row["wait_time_minutes"] == "1.0" and row["execution_success"] == "1" and row["oom_occurred"] == "1"
    sinks.write_metrics_summary_csv(jobs, states, str(tmp_path / "summary"))
    assert spark.read.option("header", True).csv(str(tmp_path / "summary")).count() == 8

    flat = spark.createDataFrame([("s", "a", 1.0, START)], "scenario string, algorithm string, score double, at timestamp")
    sinks.write_evaluation_results(flat, str(tmp_path / "eval"))
    assert spark.read.json(str(tmp_path / "eval/json")).count() == 1
    sinks.write_benchmark_json(flat, str(tmp_path / "bench"))
    assert spark.read.json(str(tmp_path / "bench")).first()["at"].startswith("2024-01-01")
    steps = flat.withColumn("state", F.array(F.lit(0.5)))
    sinks.write_trajectories(steps, str(tmp_path / "t"))
    sinks.write_trajectories(steps, str(tmp_path / "tcsv"), csv=True)
    assert spark.read.parquet(str(tmp_path / "t")).first()["state"] == [0.5]
    assert spark.read.option("header", True).csv(str(tmp_path / "tcsv")).first()["state"] == "[0.5]"


def test_orphans(spark):
    events = spark.createDataFrame([("a", 1), ("x", 2)], "job_id string, id int")
    jobs = spark.createDataFrame([("a",), ("a",)], "job_id string")
    assert [r["id"] for r in stats.orphan_events(events, jobs).collect()] == [2]
