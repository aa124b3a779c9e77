"""Operators on small tables with hand-computed answers."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobtide import dims
from jobtide.operators import arrivals, augment, monitor, occupancy, placement, scoring, stats, trajectories, vectors
from jobtide.operators.cluster import cluster_resources, node_balance, recent_oom_rate
from jobtide.operators.manifests import all_pending, job_info, normalize_jobs, quarantined_jobs, workload_job_info
from jobtide.schemas import CLUSTER_EVENT, JOB_MANIFEST, NODE_SNAPSHOT, WORKLOAD_MANIFEST

JOBS = "job_id string, status string, oom_killed boolean, submission_us bigint, start_us bigint, completion_us bigint"


def test_statistics_of_nothing(spark):
    row = stats.job_statistics(spark.createDataFrame([], JOBS)).first()
    assert row["total_jobs"] == 0 and row["succeeded_jobs"] is None and row["avg_wait_time_minutes"] is None


def test_statistics_ignore_missing_times(spark):
    minute = 60_000_000
    rows = [("a", "Succeeded", True, 0, 2 * minute, None), ("b", "Failed", False, 0, None, None), ("c", "Running", None, minute, 5 * minute, None)]
    row = stats.job_statistics(spark.createDataFrame(rows, JOBS)).first()
    assert tuple(row) == (3, 1, 1, 1, 1, 3.0)


def test_recent_jobs_put_missing_times_last(spark):
    rows = [("a", None, None, None, None, None), ("b", None, None, 5, None, None), ("c", None, None, 9, None, None)]
    assert [r["job_id"] for r in stats.recent_jobs(spark.createDataFrame(rows, JOBS), 3).collect()] == ["c", "b", "a"]


def test_no_events_means_no_oom(spark):
    events = spark.createDataFrame([], CLUSTER_EVENT).withColumn("event_us", F.lit(None).cast("bigint"))
    assert recent_oom_rate(events, F.lit(0)).first()["oom_rate"] == 0.0


def test_tainted_nodes_leave_zero_capacity(spark):
    ready = [("Ready", "True")]
    when = datetime(2024, 1, 1)
    rows = [
        (when, "a", {"cpu": "4", "memory": "8Gi"}, {"cpu": "3000m", "memory": "6Gi"}, [("k", "NoSchedule")], ready),
        (when, "b", {"cpu": "4"}, {"cpu": "5"}, None, [("Ready", "False")]),
    ]
    row = cluster_resources(spark.createDataFrame(rows, NODE_SNAPSHOT)).first()
    assert row["cpu_total"] == 0.0 and row["avg_cpu_utilization"] == 0.0 and row["ready_nodes"] == 1


def test_monitor_without_ready_nodes(spark):
    rows = [(datetime(2024, 1, 1), "a", {}, {}, None, [("Ready", "False")])]
    row = monitor.monitor_utilization(spark.createDataFrame(rows, NODE_SNAPSHOT), ["snapshot_ts"]).first()
    assert row["cpu_utilization"] == 1.0 and row["node_count"] == 1


def test_alert_limits(spark):
    rows = spark.createDataFrame([(1, 5, 50), (2, 6, 50), (3, 5, 51), (4, None, None)], "id int, oom_incidents int, jobs_pending int")
    found = [(r["id"], r["type"]) for r in monitor.threshold_alerts(rows, ["id"]).collect()]
    assert sorted(found) == [(2, "high_oom_rate"), (3, "queue_congestion")]


def _manifest(uid, cpu="500m", memory="1Gi", labels=None, annotations=None, suspend=None, status=(None, None, None, None, None), created=True):
    containers = [("main", ({"cpu": cpu, "memory": memory}, None)), ("side", ({"cpu": "99"}, None))]
    when = datetime(2024, 1, 2)
    return (
        when,
        (uid, f"n-{uid}", "ns", when if created else None, labels, annotations),
        (suspend, ((containers,),), None),
        status,
    )


def test_manifest_defaults_and_quarantine(spark):
    rows = [
        _manifest("a", labels={"priority": "7", "user": "u"}, annotations={"x.org/job-type": "ml", "estimated-duration": "12"}, suspend=True),
        _manifest("b", status=(1, None, None, None, None)),
        _manifest("c", cpu="100n"),
        _manifest("d", labels={"priority": "high"}),
        _manifest("e", status=None, annotations={"job-type": "etl"}, created=False),
    ]
    manifests = spark.createDataFrame(rows, JOB_MANIFEST)
    jobs = {r["job_id"]: r for r in normalize_jobs(manifests).collect()}
    assert set(jobs) == {"a", "b", "e"}
    a, b, e = jobs["a"], jobs["b"], jobs["e"]
    assert (a["cpu_request"], a["memory_request"], a["cpu_limit"], a["priority"], a["user_name"], a["queue_name"]) == (0.5, 1.0, 0.0, 7, "u", "default")
    assert (a["status"], a["job_type"], b["status"], b["job_type"], b["metadata"], e["status"]) == ("Suspended", "ml", "Running", "generic", None, "Unknown")
    assert a["metadata"].startswith('{"labels":{"priority":"7"')
    assert {(r["job_id"], r["defect"]) for r in quarantined_jobs(manifests).collect()} == {("c", "quantity"), ("d", "priority")}
    infos = {r["job_id"]: r for r in job_info(manifests).collect()}
    assert infos["a"]["estimated_duration"] == 12.0 and infos["b"]["estimated_duration"] == 30.0
    assert infos["e"]["arrival_time"] == datetime(2024, 1, 2) and infos["b"]["labels"] == {}


def test_workloads(spark):
    when = datetime(2024, 1, 2)

    def workload(uid, requests, suspend, admitted, pods=True):
        pod_sets = [((([((requests,),)],),),)] if pods else None
        return (when, (uid, uid, "ns", None, None), (suspend, None, pod_sets), (admitted,))

    rows = [
        workload("w1", {"cpu": "2", "memory": "4Gi"}, False, None),
        workload("w2", None, False, False),
        workload("w3", None, None, True),
        workload("w4", None, True, True, pods=False),
    ]
    workloads = spark.createDataFrame(rows, WORKLOAD_MANIFEST)
    infos = {r["job_id"]: (r["cpu_request"], r["memory_request"], r["priority"]) for r in workload_job_info(workloads).collect()}
    assert infos == {"w1": (2.0, 4.0, 0), "w2": (1.0, 1.0, 0), "w3": (1.0, 1.0, 0), "w4": (1.0, 1.0, 0)}
    manifests = spark.createDataFrame([_manifest("a", suspend=True), _manifest("b")], JOB_MANIFEST)
    assert {r["job_id"] for r in all_pending(manifests, workloads).collect()} == {"a", "w1", "w2", "w4"}


def test_occupancy_against_recount(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        start = rng.randrange(5000) if rng.random() < 0.9 else None
        end = start + rng.randrange(1, 300) if start is not None and rng.random() < 0.9 else None
        rows.append((f"j{i}", start, end, rng.randrange(1, 5) * 0.25, 0.5))
    df = spark.createDataFrame(rows, "job_id string, start_us bigint, completion_us bigint, cpu_request double, memory_request double")
    history = occupancy.occupancy_history(df, cpu_total=100.0, points_per_cut=200).collect()
    times = {t for r in rows for t in r[1:3] if t is not None}
    assert {r["us"] for r in history} == times
    for r in history[:: max(1, len(history) // 200)]:
        active = [x for x in rows if x[1] is not None and x[1] <= r["us"] and (x[2] is None or x[2] > r["us"])]
        assert r["running_jobs"] == len(active) and r["cpu_used"] == pytest.approx(sum(x[3] for x in active))


def test_ticks_exclude_both_ends(spark):
    rows = [("a", 10, 30), ("b", 9, 31), ("c", 11, 19), ("d", None, 20), ("e", 10, None)]
    df = spark.createDataFrame(rows, "job_id string, start_us bigint, completion_us bigint")
    found = sorted(tuple(r) for r in occupancy.active_at_tick(df, 10).collect())
    assert found == [("a", 20), ("b", 10), ("b", 20), ("b", 30), ("e", 20), ("e", 30)]  # e runs to the end of the log
    later = occupancy.active_at_tick(df.filter("job_id = 'e'"), 10, until_us=F.lit(50)).collect()
    assert sorted(r["tick_us"] for r in later) == [20, 30, 40, 50]


def test_who_is_active_at_asked_ticks(spark):
    rng = random.Random(6)
    rows = [(f"j{i}", s := rng.randrange(5000), s + rng.choice([1, 5, 80, 3000]) if i % 7 else None) for i in range(300)] + [("none", None, 10)]
    df = spark.createDataFrame(rows, "job_id string, start_us bigint, completion_us bigint")
    asked = spark.createDataFrame([(t,) for t in (0, 3, 3, 41, 400, 499, 700)], "tick bigint")
    every = {(r["job_id"], r["tick_us"] // 10) for r in occupancy.active_at_tick(df, 10).collect()}
    for block in (1, 64, 8640):
        found = occupancy.active_at(occupancy.active_ranges(df, 10), asked, block_ticks=block).collect()
        assert sorted(map(tuple, found)) == sorted((j, t) for j, t in every if t in (0, 3, 41, 400, 499, 700))


def test_tick_changes_give_the_same_counts(spark):
    rng = random.Random(5)
    rows = [(f"j{i}", s := rng.randrange(500), s + rng.randrange(1, 80), 1.0, 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "job_id string, start_us bigint, completion_us bigint, cpu_request double, memory_request double")
    per_tick = {r["tick_us"]: r["count"] for r in occupancy.active_at_tick(df, 10).groupBy("tick_us").count().collect()}
    running = 0
    for r in sorted(occupancy.tick_changes(df, 10).collect(), key=lambda r: r["us"]):
        running += r["jobs"]
        assert per_tick.get(r["us"], 0) == running


QUEUE = "snapshot_id bigint, job_id string, arrival_us bigint, cpu_request double, memory_request double, priority int, job_type string, estimated_duration double"
CLUSTER = "snapshot_id bigint, cpu_total double, cpu_available double, memory_total double, memory_available double, avg_cpu_utilization double, avg_memory_utilization double, running_jobs int, oom_rate double, recent_cpu double, oom_events int"


@pytest.mark.parametrize("jobs", [0, 3, 10, 12])
def test_vector_width(spark, jobs):
    queue = spark.createDataFrame([(1, f"j{i:02}", 0, 1.0, 2.0, i % 3, "ml", 60.0) for i in range(jobs)], QUEUE)
    cluster = spark.createDataFrame([(1, 10.0, 4.0, 20.0, 5.0, 0.6, 0.75, 50, 0.1, 0.3, 20)], CLUSTER)
    now = F.lit(30 * 60_000_000)
    state = vectors.state_vector(queue, cluster, now).first()["state"]
    assert len(state) == 67 and state[:7] == pytest.approx([0.4, 0.25, 0.6, 0.75, 0.5, 0.6, 0.1])
    assert all(x == 0 for x in state[7 + 6 * min(jobs, 10) :])
    if jobs:
        assert state[7:13] == pytest.approx([0.1, 0.1, 0.2 if jobs > 2 else 0.0, 0.5, 0.5, 0.6])
    ragged = vectors.state_vector_ragged(queue, cluster, now, job_types=["x", "ml"]).first()["state"]
    assert len(ragged) == 7 + 6 * jobs and ragged[:7] == pytest.approx([0.4, 0.25, 0.6, 0.75, 0.5, 0.3, 0.2])
    if jobs:  # not clamped: cores, GiB, priority, hours, hours, type
        assert ragged[7:13] == pytest.approx([1.0, 2.0, 0.2 if jobs > 2 else 0.0, 0.5, 1.0, 0.5])
    assert len(vectors.state_vector_padded(queue, cluster, now, 50).first()["state"]) == 307


def test_top_k_is_limited_before_the_shuffle(spark):
    queue = spark.createDataFrame([(1, "a", 0, 1.0, 2.0, 1, "ml", 60.0)], QUEUE)
    assert "WindowGroupLimit" in vectors.queue_top_k(queue, 10)._jdf.queryExecution().toString()


def test_padded_queue(spark):
    queue = spark.createDataFrame([(1, "a", 0, 1.0, 2.0, 1, "ml", 60.0), (1, "b", 0, 3.0, 2.0, 5, "ml", 60.0)], QUEUE)
    rows = vectors.pad_queue(queue, ["cpu_request"], 4).orderBy("slot").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 3.0), (1, 2, 1.0), (1, 3, 0.0), (1, 4, 0.0)]
    known = spark.createDataFrame([(1,), (7,)], "snapshot_id bigint")
    rows = vectors.pad_queue(queue, ["cpu_request"], 2, snapshots=known).orderBy("snapshot_id", "slot").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 3.0), (1, 2, 1.0), (7, 1, 0.0), (7, 2, 0.0)]


def test_scores(spark):
    rows = [
        ("s", "a", "throughput", 1.0), ("s", "b", "throughput", 3.0),
        ("s", "a", "avg_wait_time", 5.0), ("s", "b", "avg_wait_time", 5.0),
        ("s", "a", "oom_rate", 0.0), ("s", "b", "oom_rate", 0.5), ("s", "c", "oom_rate", 0.25),
        ("t", "a", "throughput", 2.0),
    ]
    scores = scoring.normalized_scores(spark.createDataFrame(rows, "scenario string, algorithm string, metric string, value double"))
    found = {(r["scenario"], r["algorithm"]): r["score"] for r in scores.collect()}
    assert found == {("s", "a"): 0.5, ("s", "b"): 0.5, ("s", "c"): 0.5, ("t", "a"): 0.0}


def test_policy_without_admits(spark):
    rows = [("p", 1, 1.0, False, False), ("p", 1, 2.0, False, False), ("p", 2, 5.0, False, False)]
    steps = spark.createDataFrame(rows, "algorithm string, episode int, reward double, is_admit boolean, admit_ok boolean")
    row = trajectories.policy_evaluation(steps).first()
    assert (row["mean_reward"], row["std_reward"], row["mean_success_rate"], row["total_episodes"]) == (4.0, 1.0, 0.0, 2)


def test_fits_and_ties(spark):
    queue = spark.createDataFrame([(1, "a", 0, 2.0, 2.0, 9, "ml", 1.0), (1, "b", 0, 1.0, 1.0, 5, "ml", 1.0)], QUEUE)
    nodes = spark.createDataFrame(
        [(1, 7, 4.0, 4.0, 3.0, 0.0), (1, 8, 4.0, 4.0, 2.0, 2.0), (1, 9, 4.0, 4.0, 2.0, 2.0), (2, 1, 4.0, 4.0, 0.0, 0.0)],
        "snapshot_id bigint, node_id bigint, cpu_total double, memory_total double, cpu_used double, memory_used double",
    )
    pairs = placement.fit_candidates(queue, nodes)
    assert sorted((r["job_id"], r["node_id"], r["waste"]) for r in pairs.collect()) == [
        ("a", 8, 0.0), ("a", 9, 0.0), ("b", 7, 3.0), ("b", 8, 2.0), ("b", 9, 2.0),
    ]
    assert tuple(placement.best_fit(queue, nodes).first()) == (1, 0, "a", 8, 0.0)
    assert tuple(placement.first_fit(queue, nodes).first()) == (1, 0, "a", 8)
    assert tuple(placement.best_fit(queue, nodes.filter("node_id < 9"), k=1).first()) == (1, 0, "a", 8, 0.0)
    assert tuple(placement.first_fit(queue, nodes.filter("node_id = 7")).first()) == (1, 1, "b", 7)
    assert placement.first_fit(queue, nodes.filter("node_id = 7"), k=1).count() == 0
    assert placement.fit_candidates(queue, nodes, normalised_waste=True).agg(F.max("waste")).first()[0] == 0.75


def test_node_balance(spark):
    nodes = spark.createDataFrame([(1, 4.0, 4.0, 1.0, 2.0), (1, 4.0, 4.0, 3.0, 2.0)], "snapshot_id bigint, cpu_total double, memory_total double, cpu_used double, memory_used double")
    row = node_balance(nodes).first()
    assert (row["cpu_utilization"], row["cpu_utilization_std"], row["memory_available_ratio"]) == (0.5, 0.25, 0.5)


HOUR = 3_600_000_000


def test_patterns_pass_midnight(spark):
    jobs = spark.createDataFrame([(h, h * HOUR + 1) for h in range(24)], "hour_in int, submission_us bigint")
    found = {r["hour_in"]: r["pattern_order"] for r in arrivals.match_time_pattern(jobs, dims.dim_time_patterns(spark)).collect()}
    assert found == {h: 0 if 9 <= h < 18 else 1 if 18 <= h < 23 else 2 for h in range(24)}


def test_unmatched_hours_take_the_first_pattern(spark):
    patterns = spark.createDataFrame([(0, 3, 5, "a", 1.0), (1, 4, 8, "a", 1.0)], "pattern_order int, start_hour int, end_hour int, job_type string, share double")
    jobs = spark.createDataFrame([(h, h * HOUR) for h in (3, 4, 5, 8, 20)], "hour_in int, submission_us bigint")
    found = {r["hour_in"]: r["pattern_order"] for r in arrivals.match_time_pattern(jobs, patterns).collect()}
    assert found == {3: 0, 4: 0, 5: 1, 8: 0, 20: 0}


def test_burst_gap_is_inclusive(spark):
    second = 1_000_000
    times = [0, 5, 10, 16, 100, 104]
    jobs = spark.createDataFrame([(f"j{t}", t * second) for t in times], "job_id string, submission_us bigint")
    rows = arrivals.burst_sessions(jobs, 5.0, at_least=2).orderBy("first_us").collect()
    assert [(r["first_us"] // second, r["last_us"] // second, r["arrivals"]) for r in rows] == [(0, 10, 3), (100, 104, 2)]


@pytest.mark.parametrize("by", [[], ["user"]])
def test_sessions_reach_over_cuts(spark, by):
    """Against a plain pass, with cuts so short that runs reach over several of them."""
    rng = random.Random(11)
    rows = [(f"j{i}", rng.choice("ab"), rng.randrange(0, 4000) * 500_000) for i in range(900)] + [("x", "a", None), ("y", "a", -7_000_000), ("z", "a", 12_000_000)]
    jobs = spark.createDataFrame(rows, "job_id string, user string, submission_us bigint")
    wanted = []
    for user in "ab" if by else [None]:
        runs = []
        for us in sorted(r[2] for r in rows if r[2] is not None and user in (None, r[1])):
            if runs and us - runs[-1][1] <= 3_000_000:
                runs[-1] = (runs[-1][0], us, runs[-1][2] + 1)
            else:
                runs.append((us, us, 1))
        wanted += [(*([user] if by else []), *run) for run in runs]
    for cut in (7, None):
        found = arrivals.burst_sessions(jobs, 3.0, by=by, cut_s=cut).select(*by, "first_us", "last_us", "arrivals").collect()
        assert sorted(map(tuple, found)) == sorted(wanted)


def test_dimension_sizes(spark):
    assert dims.dim_templates(spark).count() == 6 and dims.dim_node_types(spark).count() == 16
    assert dims.dim_job_types(spark).count() == 5 and dims.dim_time_patterns(spark).count() == 15
    assert dims.dim_hourly_patterns(spark).select("band").distinct().count() == 4
    assert dims.dim_scenarios(spark).count() == 5 and dims.dim_transitions(spark).count() == 5


def test_augmentation(spark):
    steps = spark.range(4000).withColumn("state", F.array_repeat(F.lit(0.5).cast("float"), 67))
    noisy = augment.augment_noise(steps, ["id"])
    spread = noisy.select(F.explode("state").alias("x")).agg(F.avg("x"), F.stddev_pop("x"), F.count("*")).first()
    assert spread[0] == pytest.approx(0.5, abs=0.01) and spread[1] == pytest.approx(0.1, abs=0.005)
    assert noisy.count() == pytest.approx(2000, abs=150)
    odd = augment.augment_anomaly(steps, ["id"], rate=0.2)
    hits = odd.select(F.size(F.filter("state", lambda x: x != 0.5)).alias("n"), F.array_distinct("state").alias("v")).collect()
    assert {r["n"] for r in hits} == {1, 2, 3, 4} and {x for r in hits for x in r["v"]} == {0.0, 0.5, 1.0}
    again = augment.augment_noise(steps.repartition(7), ["id"])
    assert sorted(map(str, again.collect())) == sorted(map(str, noisy.collect()))
    union = augment.augment_union(steps, ["id"], rate=0.2)
    assert union.count() == 4000 + noisy.count() + odd.count()


def test_varied_jobs_keep_their_floor(spark):
    jobs = spark.range(500).select("id", F.lit(100).alias("cpu_request"), F.lit(10_000).alias("memory_request"), F.lit(10).alias("duration"))
    row = augment.noisy_attributes(jobs, ["id"]).agg(F.min("cpu_request"), F.min("duration"), F.stddev_pop("memory_request")).first()
    assert row[0] == 100 and row[1] == 10 and row[2] == pytest.approx(1000, rel=0.15)
