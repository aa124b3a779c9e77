"""Arrival patterns: hour bands, job type shares, gaps and bursts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobtide.functions.clock import MICROS_PER_DAY, MICROS_PER_SECOND, whole_hour
from jobtide.operators.ordered import OrderedScan


def pattern_hours(patterns: DataFrame) -> DataFrame:
    """At most 24 rows: the first pattern that covers each hour. A range may pass midnight."""
    length = F.pmod(F.col("end_hour") - F.col("start_hour") + 23, F.lit(24))
    hours = F.transform(F.sequence(F.lit(0), length), lambda h: (F.col("start_hour") + h) % 24)
    spans = patterns.select("pattern_order", "start_hour", "end_hour").distinct()
    spans = spans.filter(F.col("start_hour") != F.col("end_hour"))
    return spans.select("pattern_order", F.explode(hours).alias("hour")).groupBy("hour").agg(
        F.min("pattern_order").alias("pattern_order")
    )


def match_time_pattern(jobs: DataFrame, patterns: DataFrame, time_us: str = "submission_us") -> DataFrame:
    """Adds the pattern of the hour of arrival; hours outside every pattern get the first one."""
    hours = F.broadcast(pattern_hours(patterns))
    joined = jobs.withColumn("hour", whole_hour(F.col(time_us))).join(hours, "hour", "left")
    return joined.withColumn("pattern_order", F.coalesce("pattern_order", F.lit(0)))


def band_hours(bands: DataFrame) -> DataFrame:
    """At most 24 rows: the first band that lists each hour."""
    hours = F.explode(F.sequence(F.col("first_hour"), F.col("end_hour") - 1))
    spans = bands.select("band_order", "band", "first_hour", "end_hour", "job_rate").distinct()
    return spans.withColumn("hour", hours).groupBy("hour").agg(
        F.min(F.struct("band_order", "band", "job_rate", (F.col("end_hour") - F.col("first_hour")).alias("hours"))).alias("b")
    ).select("hour", "b.band", "b.job_rate", F.col("b.hours").alias("band_hours"))


def match_hour_band(jobs: DataFrame, bands: DataFrame, time_us: str = "submission_us") -> DataFrame:
    """Adds band and configured rate; arrivals outside every band are dropped."""
    return jobs.withColumn("hour", whole_hour(F.col(time_us))).join(band_hours(bands), "hour")


def join_template_dim(jobs: DataFrame, templates: DataFrame, name: str = "template") -> DataFrame:
    """Adds the attributes of a job's template; the template table is configuration."""
    dim = templates.select(*[F.col(c).alias(name if c == "name" else f"template_{c}") for c in templates.columns])
    return jobs.join(dim, name)


def known_templates(weights: DataFrame, templates: DataFrame, name: str = "template") -> DataFrame:
    names = templates.select(F.col("name").alias(name))
    return weights.join(names, name, "left_semi")


def arrivals_sorted(jobs: DataFrame, time_us: str = "submission_us") -> DataFrame:
    """Jobs with their ``position`` in the order of arrival; rows without a time are left out."""
    arrived = jobs.filter(F.col(time_us).isNotNull())
    return OrderedScan(arrived, [], [time_us, "job_id"]).row_number("position").result()


def arrival_profile(jobs: DataFrame, patterns: DataFrame, time_us: str = "submission_us") -> DataFrame:
    """Observed against configured share of each job type per time pattern."""
    keys = ["pattern_order", "job_type"]
    counts = match_time_pattern(jobs, patterns, time_us).groupBy(*keys).agg(F.count("*").alias("arrivals"))
    # Over the counts, which are as few as there are job types.
    total = F.sum("arrivals").over(Window.partitionBy("pattern_order"))
    configured = patterns.select("pattern_order", "job_type", F.col("share").alias("configured_share"))
    profile = counts.withColumn("observed_share", F.col("arrivals") / total)
    return profile.join(configured, keys, "left").select(
        *keys, "arrivals", "observed_share", "configured_share"
    )


def band_rates(jobs: DataFrame, bands: DataFrame, time_us: str = "submission_us") -> DataFrame:
    """Observed against configured arrivals per hour of each band."""
    day = F.floor(F.col(time_us) / MICROS_PER_DAY)
    days = jobs.agg((F.max(day) - F.min(day) + 1).alias("days")).scalar()
    counts = match_hour_band(jobs, bands, time_us).groupBy("band", "job_rate", "band_hours")
    rows = counts.agg(F.count("*").alias("arrivals"))
    per_hour = F.try_divide("arrivals", F.col("band_hours") * days)
    return rows.select("band", "arrivals", per_hour.alias("observed_rate"), F.col("job_rate").alias("configured_rate"))


def interarrival(
    jobs: DataFrame, by: Sequence[str] = (), time_us: str = "submission_us", job_id: str = "job_id", **options
) -> DataFrame:
    """Seconds since the arrival before; NULL for the first one."""
    scan = OrderedScan(jobs.filter(F.col(time_us).isNotNull()), by, [time_us, job_id], **options)
    rows = scan.previous(__before=time_us).result()
    gap = (F.col(time_us) - F.col("__before")) / float(MICROS_PER_SECOND)
    return rows.withColumn("gap_s", gap).drop("__before")


#: Arrivals are cut into parts of so many gaps, and at least CUT_SECONDS.
CUT_GAPS, CUT_SECONDS = 1_000, 86_400


def burst_sessions(
    jobs: DataFrame, gap_s: float = 5.0, at_least: int = 1, by: Sequence[str] = (), time_us: str = "submission_us", cut_s: float | None = None
) -> DataFrame:
    """Runs of arrivals spaced at most ``gap_s`` apart, with at least that many arrivals each.

    Session windows run within cuts of the time line, so that a busy key, or no key at all, is spread
    over its cuts. A run can reach over a cut only if it comes within a gap of its edge: of the runs of a
    cut these are the first and the last at most, and only they are joined afterwards.
    """
    gap_us = int(gap_s * MICROS_PER_SECOND)
    cut_us = int((cut_s or max(CUT_SECONDS, CUT_GAPS * gap_s)) * MICROS_PER_SECOND)
    if cut_us <= 2 * gap_us:
        raise ValueError("a cut must be longer than two gaps")
    us = F.col(time_us).cast("bigint")
    rows = jobs.filter(us.isNotNull()).select(*by, us.alias("__us"), F.timestamp_micros(us).alias("__ts"), F.floor(us / F.lit(cut_us)).cast("bigint").alias("__cut"))
    window = F.session_window("__ts", f"{gap_us} microseconds").alias("__session")
    parts = rows.groupBy(*by, "__cut", window).agg(F.min("__us").alias("first_us"), F.max("__us").alias("last_us"), F.count("*").alias("arrivals"))
    open_ = (F.col("first_us") - F.col("__cut") * cut_us <= gap_us) | ((F.col("__cut") + 1) * cut_us - F.col("last_us") <= gap_us)
    parts = parts.select(*by, "__cut", "first_us", "last_us", "arrivals", open_.alias("__open"))
    edges = _joined(parts.filter("__open"), by, gap_us)
    whole = parts.filter(~F.col("__open")).select(*by, "first_us", "last_us", "arrivals").unionByName(edges)
    return whole.filter(F.col("arrivals") >= at_least)


def _joined(runs: DataFrame, by: Sequence[str], gap_us: int) -> DataFrame:
    """Runs that touch become one; at most two of a key and cut come in."""
    order = Window.partitionBy(*by).orderBy("first_us")
    apart = F.coalesce(F.col("first_us") - F.lag("last_us").over(order) > gap_us, F.lit(True))
    numbered = runs.withColumn("__opens", apart.cast("bigint")).withColumn("__run", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sums = [F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("arrivals").alias("arrivals")]
    return numbered.groupBy(*by, "__run").agg(*sums).drop("__run")
