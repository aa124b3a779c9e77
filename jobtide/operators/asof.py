"""Nearest-in-time join of jobs to cluster states."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobtide.operators.ordered import SEG, OrderedScan

#: States of a bucket on average, and at most before the states count as clustered and share one time line with the jobs.
BUCKET_STATES, MOST_STATES = 128, 100_000
#: Buckets of up to so many bytes (counted states times the width of their fields) are broadcast.
BROADCAST_BYTES = 64 << 20
FIELD_BYTES = 16


def asof_nearest(
    jobs: DataFrame,
    states: DataFrame,
    job_id: str,
    job_us: str,
    state_us: str,
    state_id: str,
    payload: Sequence[str],
    by: Sequence[str] = (),
    rows_per_segment: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Each job with the state closest to it in time, the lowest ``state_id`` among equals.

    Jobs without a time are dropped, and no state at all means no rows. ``by`` names equality
    columns present on both sides. Time is cut into buckets of equal width, each with the sorted
    states inside it, the last one before it and the first one after it; a job meets its bucket by an
    equi-join, which moves no job while the buckets are small and never sorts them, and searches it in
    place. With ``by``, or where very many states crowd into one bucket, jobs and states are laid
    out on one time line instead.
    """
    jobs, states = jobs.filter(F.col(job_us).isNotNull()), states.filter(F.col(state_us).isNotNull())
    if not by:
        at_us = F.col(state_us).cast("bigint")
        first, last, n = states.agg(F.min(at_us), F.max(at_us), F.count("*")).first()
        cut = _Cut(first or 0, max(1, -(-n // BUCKET_STATES)), ((last or 0) - (first or 0)) // max(1, -(-n // BUCKET_STATES)) + 1)
        most = states.groupBy(cut.bucket(at_us)).count().agg(F.max("count")).first()[0] or 0
        if most <= MOST_STATES:
            small = n * (len(payload) + 2) * FIELD_BYTES <= broadcast_bytes
            return _by_bucket(jobs, states, cut, most, small, job_us, state_us, state_id, payload)
    options = {"rows_per_segment": rows_per_segment} if rows_per_segment else {}
    return _scan(jobs, states, job_id, job_us, state_us, state_id, payload, by, options)


@dataclass(frozen=True)
class _Cut:
    """``n`` buckets of ``width`` from ``start`` on; times outside belong to the outer ones."""

    start: int
    n: int
    width: int

    def bucket(self, us: Column) -> Column:
        at = F.floor((us - self.start) / F.lit(self.width))
        return F.greatest(F.lit(0), F.least(F.lit(self.n - 1), at)).cast("bigint").alias("__bucket")


def _by_bucket(
    jobs: DataFrame, states: DataFrame, cut: _Cut, most: int, small: bool, job_us: str, state_us: str, state_id: str, payload: Sequence[str]
) -> DataFrame:
    at_us = F.col(state_us).cast("bigint")
    state = F.struct(at_us.alias("us"), F.col(state_id).alias("id"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(payload)])
    lines = states.groupBy(cut.bucket(at_us)).agg(F.sort_array(F.collect_list(state)).alias("all"))
    # Of states at the same instant only the one with the lowest id can be chosen, so times rise strictly.
    rising = F.filter("all", lambda x, i: (i == 0) | (F.get("all", i - 1)["us"] != x["us"]))
    lines = lines.select("__bucket", rising.alias("line"))
    edges = states.sparkSession.range(cut.n).withColumnRenamed("id", "__bucket")
    edges = edges.join(lines.select("__bucket", F.get("line", F.lit(0)).alias("head"), F.element_at("line", -1).alias("tail")), "__bucket", "left")
    # One row per bucket, with two states in it.
    order = Window.orderBy("__bucket")
    before = F.last("tail", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("head", True).over(order.rowsBetween(1, Window.unboundedFollowing))
    edges = edges.select("__bucket", before.alias("before"), after.alias("after"))
    whole = F.concat(F.array("before"), F.coalesce("line", F.array().cast(lines.schema["line"].dataType)), F.array("after"))
    buckets = edges.join(lines, "__bucket", "left").select("__bucket", F.filter(whole, lambda x: x.isNotNull()).alias("__line")).filter(F.size("__line") > 0)
    buckets = F.broadcast(buckets) if small else buckets.hint("shuffle_hash")

    us, line = F.col(job_us).cast("bigint"), F.col("__line")
    jumps = F.array(*[F.lit(1 << bit) for bit in reversed(range((most + 2).bit_length()))])
    at_or_before = F.aggregate(jumps, F.lit(0), lambda at, jump: F.when(F.get(line, at + jump - 1)["us"] <= us, at + jump).otherwise(at))

    def candidate(index: Column) -> Column:
        found = F.get(line, index)
        return F.when(found.isNotNull(), F.struct(F.abs(found["us"] - us).alias("distance"), found["id"].alias("id"), found.alias("state")))

    # Bound to a lambda variable, the position is searched once and not per use.
    nearest = F.transform(F.array(at_or_before), lambda n: F.least(candidate(n - 1), candidate(n)))
    met = jobs.withColumn("__bucket", cut.bucket(us)).join(buckets, "__bucket")
    return met.select(*jobs.columns, F.get(nearest, F.lit(0)).alias("__best")).select(
        *jobs.columns,
        F.col("__best.id").alias("matched_state_id"),
        F.col("__best.distance").alias("matched_distance_us"),
        *[F.col(f"__best.state.s{i}").alias(c) for i, c in enumerate(payload)],
    )


def _scan(
    jobs: DataFrame,
    states: DataFrame,
    job_id: str,
    job_us: str,
    state_us: str,
    state_id: str,
    payload: Sequence[str],
    by: Sequence[str],
    options: dict,
) -> DataFrame:
    """One scan up the time line finds the last state before a job, one scan down the first after it.

    States of other segments come in through the digest.
    """
    state = F.struct(
        F.col(state_us).alias("us"),
        F.col(state_id).alias("id"),
        *[F.col(c).alias(f"s{i}") for i, c in enumerate(payload)],
    )
    line_jobs = jobs.select(
        *by,
        F.col(job_us).cast("bigint").alias("__us"),
        F.lit(1).alias("__kind"),
        F.xxhash64(job_id).alias("__tie"),
        F.struct(*jobs.columns).alias("__job"),
    )
    line_states = states.select(
        *by,
        F.col(state_us).cast("bigint").alias("__us"),
        F.lit(0).alias("__kind"),
        (-F.col(state_id).cast("bigint")).alias("__tie"),
        state.alias("__state"),
    )
    line = line_jobs.unionByName(line_states, allowMissingColumns=True)
    scan = OrderedScan(line, by, ["__us", "__kind", "__tie"], **options)

    # States sort before jobs of the same instant and, among themselves, by falling id.
    up = scan.window(F.col("__us"), F.col("__kind"), F.col("__tie"))
    down = scan.window(F.col("__us").desc(), F.col("__kind"), F.col("__tie"))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    df = scan.df.withColumn("__before", F.last("__state", True).over(up.rowsBetween(*so_far)))
    df = df.withColumn("__after", F.last("__state", True).over(down.rowsBetween(*so_far)))
    found = ["__before", "__after"]

    if scan.is_split:
        has_state = F.col("__state").isNotNull()
        place = F.struct("__us", "__tie")
        digest = scan.digest(
            F.max_by("__state", F.when(has_state, place)).alias("__last"),
            F.min("__state").alias("__first"),
        )
        carries = digest.select(
            *by,
            SEG,
            F.last("__last", True).over(scan.between_segments()).alias("__earlier"),
            F.min("__first").over(scan.between_segments(descending=True)).alias("__later"),
        )
        df = scan.attach(df, carries)
        found += ["__earlier", "__later"]

    def candidate(name: str) -> Column:
        distance = F.abs(F.col(f"{name}.us") - F.col("__us")).alias("distance")
        ranked = F.struct(distance, F.col(f"{name}.id").alias("id"), F.col(name).alias("state"))
        return F.when(F.col(name).isNotNull(), ranked)

    best = F.least(*[candidate(name) for name in found])
    matched = df.filter(F.col("__kind") == 1).select("__job", best.alias("__best"))
    return matched.filter(F.col("__best").isNotNull()).select(
        "__job.*",
        F.col("__best.id").alias("matched_state_id"),
        F.col("__best.distance").alias("matched_distance_us"),
        *[F.col(f"__best.state.s{i}").alias(c) for i, c in enumerate(payload)],
    )
