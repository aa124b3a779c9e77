"""Ordered scans, the nearest join and the lookup join against brute force, with one hot key."""

import random

import pytest
from pyspark.sql import functions as F

from jobtide.operators import asof, ordered, skew
from jobtide.operators.ordered import OrderedScan, trailing

SMALL = {"rows_per_segment": 200, "max_segments": 64}


@pytest.fixture(scope="module")
def rows():
    """A third of the rows belong to one key."""
    rng = random.Random(1)
    keys = ["hot" if rng.random() < 0.34 else f"k{rng.randrange(400)}" for _ in range(4000)]
    return [(k, rng.randrange(1000), i, rng.randrange(10)) for i, k in enumerate(keys)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "key string, ts bigint, id bigint, x int").repartition(5).cache()


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("keys", [["key"], []])
def test_neighbours_and_sums(table, rows, keys):
    scan = OrderedScan(table, keys, ["ts", "id"], **SMALL)
    assert scan.is_split and len(scan.cut_hashes) >= 1
    scan.previous(before="id").following(after="id").running_sum(total="x").row_number("n")
    found = {r["id"]: (r["before"], r["after"], r["total"], r["n"]) for r in scan.result().collect()}
    groups = by_key(rows).values() if keys else [sorted(rows, key=lambda r: (r[1], r[2]))]
    assert len(found) == len(rows)
    for group in groups:
        total = 0
        for i, row in enumerate(group):
            total += row[3]
            before = group[i - 1][2] if i else None
            after = group[i + 1][2] if i + 1 < len(group) else None
            assert found[row[2]] == (before, after, total, i + 1)


def test_no_task_sees_the_hot_key_whole(table):
    scan = OrderedScan(table, ["key"], ["ts", "id"], **SMALL)
    pieces = scan.df.filter("key = 'hot'").groupBy(ordered.SEG).count().collect()
    assert len(pieces) > 4 and max(p["count"] for p in pieces) < 600


def test_even_keys_are_not_cut(spark):
    even = spark.range(4000).select((F.col("id") % 1000).alias("key"), F.col("id").alias("ts"))
    assert not OrderedScan(even, ["key"], ["ts"], **SMALL).is_split


def test_segments_do_not_depend_on_partitions(table):
    results = []
    for n in (1, 7):
        scan = OrderedScan(table.repartition(n), ["key"], ["ts", "id"], **SMALL).running_sum(total="x")
        results.append(sorted((r["id"], r["total"]) for r in scan.result().collect()))
    assert results[0] == results[1]


def test_null_values_and_null_keys(spark):
    data = [(None if i % 3 else "a", i, None if i % 2 else i) for i in range(3000)]
    df = spark.createDataFrame(data, "key string, ts bigint, v bigint")
    scan = OrderedScan(df, ["key"], ["ts"], rows_per_segment=100).previous(p="v")
    found = {r["ts"]: r["p"] for r in scan.result().collect()}
    last = {}
    for key, ts, v in data:
        assert found[ts] == last.get(key)
        last[key] = v


@pytest.mark.parametrize("block", [20, 100_000])
def test_trailing_mean(table, rows, block):
    numbered = OrderedScan(table, ["key"], ["ts", "id"], **SMALL).row_number("n").result()
    out = trailing(numbered, ["key"], "n", 10, {"m": F.avg("x")}, block_rows=block).collect()
    found = {r["id"]: r["m"] for r in out}
    assert len(out) == len(rows)
    for group in by_key(rows).values():
        for i, row in enumerate(group):
            last = [r[3] for r in group[max(0, i - 9) : i + 1]]
            assert found[row[2]] == pytest.approx(sum(last) / len(last))


def nearest(job_us, states):
    return min(states, key=lambda s: (abs(s[1] - job_us), s[0]))[0] if states else None


@pytest.mark.parametrize("few,most", [(0, 100_000), (1 << 30, 100_000), (0, 3)])
@pytest.mark.parametrize("spread", [10, 5000])
def test_nearest_against_brute_force(spark, monkeypatch, few, most, spread):
    """Buckets that are shuffled or broadcast, and one time line for clustered states."""
    monkeypatch.setattr(asof, "MOST_STATES", most)
    monkeypatch.setattr(asof, "BUCKET_STATES", 5)
    rng = random.Random(spread)
    states = [(i, rng.randrange(spread) * 10) for i in range(700)]
    jobs = [(f"j{i}", rng.randrange(-100, spread * 10 + 100) if i % 50 else None) for i in range(2000)]
    jobs += [(f"hot{i}", 40) for i in range(1000)]
    found = asof.asof_nearest(
        spark.createDataFrame(jobs, "job string, us bigint"),
        spark.createDataFrame(states, "id bigint, ts bigint"),
        "job", "us", "ts", "id", ["ts"], rows_per_segment=150, broadcast_bytes=few,
    ).collect()
    assert len(found) == sum(us is not None for _, us in jobs)
    wanted = {job: nearest(us, states) for job, us in jobs if us is not None}
    assert {r["job"]: r["matched_state_id"] for r in found} == wanted
    times = dict(states)
    assert all(r["ts"] == times[r["matched_state_id"]] for r in found)
    assert all(r["matched_distance_us"] == abs(r["ts"] - r["us"]) for r in found)


def test_nearest_does_not_sort_jobs(spark):
    """Neither way sorts the jobs; gaps without states and jobs outside all states are answered from the neighbours."""
    rng = random.Random(4)
    times = [t for lo in (0, 5_000_000, 90_000_000) for t in rng.sample(range(lo, lo + 100_000), 300)]
    states = spark.createDataFrame(list(enumerate(times)), "id bigint, ts bigint")
    jobs = [(f"j{i}", rng.randrange(-10_000, 100_000_000)) for i in range(500)]
    frame = spark.createDataFrame(jobs, "job string, us bigint")
    for limit, how in ((0, "ShuffledHashJoin"), (1 << 30, "BroadcastHashJoin")):
        found = asof.asof_nearest(frame, states, "job", "us", "ts", "id", ["ts"], broadcast_bytes=limit)
        joins = [line for line in found._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in line]
        assert how in joins[0] and "job" not in "".join(joins[1:])  # the jobs are in the first join only
        assert {r["job"]: r["matched_state_id"] for r in found.collect()} == {job: nearest(us, list(enumerate(times))) for job, us in jobs}


@pytest.mark.parametrize("few", [0, 1 << 30])
def test_nearest_edges(spark, few):
    jobs = spark.createDataFrame([("a", 100), ("b", 0), ("c", 999), ("d", None)], "job string, us bigint")

    def run(states):
        df = spark.createDataFrame(states, "id bigint, ts bigint")
        rows = asof.asof_nearest(jobs, df, "job", "us", "ts", "id", [], broadcast_bytes=few).collect()
        return {r["job"]: r["matched_state_id"] for r in rows}

    assert run([(2, 110), (1, 90)]) == {"a": 1, "b": 1, "c": 2}
    assert run([(1, 110), (2, 90)]) == {"a": 1, "b": 2, "c": 1}
    assert run([(5, 100), (3, 100), (4, 100)]) == {"a": 3, "b": 3, "c": 3}
    assert run([]) == {}


def test_nearest_within_equal_keys(spark):
    rng = random.Random(9)
    states = [(i, rng.randrange(900), f"c{rng.randrange(3)}") for i in range(300)]
    jobs = [(f"j{i}", rng.randrange(900), f"c{rng.randrange(4)}") for i in range(3000)]
    found = asof.asof_nearest(
        spark.createDataFrame(jobs, "job string, us bigint, cluster string"),
        spark.createDataFrame(states, "id bigint, ts bigint, cluster string"),
        "job", "us", "ts", "id", [], by=["cluster"], rows_per_segment=100,
    ).collect()
    wanted = {}
    for job, us, cluster in jobs:
        match = nearest(us, [s for s in states if s[2] == cluster])
        if match is not None:
            wanted[job] = match
    assert {r["job"]: r["matched_state_id"] for r in found} == wanted


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_lookup_join_spreads_a_hot_key(spark, table, how):
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "key string, y int")
    plain = table.join(lookup, ["key"], how)
    spread = skew.join_lookup(table, lookup, ["key"], how, rows_per_slice=100)
    assert "__slice" in spread._jdf.queryExecution().analyzed().toString()
    assert sorted(map(str, spread.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("how", ["right", "full", "outer", "cross"])
def test_lookup_join_refuses_kinds_that_return_lookup_rows(spark, table, how):
    with pytest.raises(ValueError):
        skew.join_lookup(table, spark.createDataFrame([("hot", 1)], "key string, y int"), ["key"], how)


@pytest.mark.parametrize("unrolled", [0, 1000])
def test_search_among_points(spark, table, rows, monkeypatch, unrolled):
    monkeypatch.setattr(ordered, "UNROLLED_POINTS", unrolled)
    points = sorted({(r[0], r[1]) for r in rows[:300]})
    found = ordered.count_at_or_below(table, ["key", "ts"], points, "n").collect()
    assert all(r["n"] == sum(p <= (r["key"], r["ts"]) for p in points) for r in found)
    assert ordered.count_at_or_below(table, ["ts"], [], "n").agg(F.max("n")).first()[0] == 0
