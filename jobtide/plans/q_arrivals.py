"""Arrival patterns, gaps and bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide import dims
from jobtide.operators import arrivals
from jobtide.plans.registry import query
from jobtide.plans.views import oracle, view

_HOUR = "cast((submission_us // 3600000000) % 24 as int)"
_PATTERN = f"case when {_HOUR} between 9 and 17 then 0 when {_HOUR} between 18 and 22 then 1 else 2 end"
_BAND = f"case when {_HOUR} < 6 then 'night' when {_HOUR} < 9 then 'morning' when {_HOUR} < 18 then 'business' else 'evening' end"
_SHARES = "shares(pattern_order, job_type, share) as (values " + ", ".join(
    f"({i}, '{name}', {share})" for i, (_, _, shares) in enumerate(dims.TIME_PATTERNS) for name, share in shares.items()
) + ")"
_RATES = "rates(band, configured_rate, hours) as (values ('night', 2, 6), ('morning', 3, 3), ('business', 5, 9), ('evening', 4, 6))"
_TEMPLATES = [row[0] for row in dims.TEMPLATES]


@query(oracle(f"select job_id, {_HOUR} as hour, cast({_PATTERN} as int) as pattern_order from jobs", "jobs"))
def match_time_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = view(spark, sf_dir, "jobs").select("job_id", "submission_us")
    return arrivals.match_time_pattern(jobs, dims.dim_time_patterns(spark)).drop("submission_us")


@query(oracle(f"with {_RATES} select job_id, j.band, configured_rate as job_rate from (select job_id, {_BAND} as band from jobs) j join rates r on r.band = j.band", "jobs"))
def match_hour_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = view(spark, sf_dir, "jobs").select("job_id", "submission_us")
    return arrivals.match_hour_band(jobs, dims.dim_hourly_patterns(spark)).select("job_id", "band", "job_rate")


@query(
    oracle(
        f"""with {_SHARES},
        c as (select cast({_PATTERN} as int) as pattern_order, job_type, count(*) as arrivals from jobs group by 1, 2)
        select c.pattern_order, c.job_type, arrivals,
          round(arrivals / (sum(arrivals) over (partition by c.pattern_order)), 6) as observed_share,
          cast(s.share as double) as configured_share
        from c left join shares s on s.pattern_order = c.pattern_order and s.job_type = c.job_type""",
        "jobs",
    )
)
def arrival_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrivals.arrival_profile(view(spark, sf_dir, "jobs"), dims.dim_time_patterns(spark))
    return rows.withColumns({c: F.round(c, 6) for c in ("observed_share", "configured_share")})


@query(
    oracle(
        f"""with {_RATES}, d as (select max(submission_us // 86400000000) - min(submission_us // 86400000000) + 1 as days from jobs),
        c as (select {_BAND} as band, count(*) as arrivals from jobs group by 1)
        select c.band, arrivals, round(arrivals / (hours * days), 6) as observed_rate, configured_rate
        from c join rates r on r.band = c.band, d""",
        "jobs",
    )
)
def band_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrivals.band_rates(view(spark, sf_dir, "jobs"), dims.dim_hourly_patterns(spark))
    return rows.withColumn("observed_rate", F.round("observed_rate", 6))


@query(
    oracle(
        """select job_id, round((submission_us - lag(submission_us) over (order by submission_us, job_id)) / 1e6, 6) as gap_s from jobs""",
        "jobs",
    )
)
def interarrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = view(spark, sf_dir, "jobs").select("job_id", "submission_us")
    return arrivals.interarrival(jobs).select("job_id", F.round("gap_s", 6).alias("gap_s"))


@query(
    oracle(
        """with g as (select submission_us, job_id, case when submission_us - lag(submission_us) over w <= 60000000 then 0 else 1 end as opens
          from jobs window w as (order by submission_us, job_id)),
        s as (select submission_us, sum(opens) over (order by submission_us, job_id) as session from g)
        select min(submission_us) as first_us, max(submission_us) as last_us, count(*) as arrivals
        from s group by session having count(*) >= 2""",
        "jobs",
    )
)
def burst_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = view(spark, sf_dir, "jobs").select("job_id", "submission_us")
    return arrivals.burst_sessions(jobs, gap_s=60.0, at_least=2)


def _templated(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in [*_TEMPLATES, "no-such-template"]])
    jobs = view(spark, sf_dir, "jobs").select("job_id", "event_id")
    return jobs.withColumn("template", F.get(names, (F.col("event_id") % 7).cast("int")))


_TEMPLATED = "select job_id, case event_id % 7 " + " ".join(
    f"when {i} then '{n}'" for i, n in enumerate(_TEMPLATES)
) + " else 'no-such-template' end as template from jobs"
_TEMPLATE_ROWS = "dim(template, template_category, template_priority) as (values " + ", ".join(
    f"('{r[0]}', '{r[2]}', {r[8]})" for r in dims.TEMPLATES
) + ")"


@query(oracle(f"with t as ({_TEMPLATED}), {_TEMPLATE_ROWS} select job_id, t.template, template_category, template_priority from t join dim on dim.template = t.template", "jobs"))
def join_template_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrivals.join_template_dim(_templated(spark, sf_dir), dims.dim_templates(spark))
    return rows.select("job_id", "template", "template_category", "template_priority")


@query(oracle(f"with t as ({_TEMPLATED}) select job_id, template from t where template <> 'no-such-template'", "jobs"))
def known_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrivals.known_templates(_templated(spark, sf_dir), dims.dim_templates(spark))
    return rows.select("job_id", "template")


@query(oracle("select job_id, submission_us, row_number() over (order by submission_us, job_id) as position from jobs", "jobs"))
def arrivals_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs in order of arrival, each row with its position."""
    return arrivals.arrivals_sorted(view(spark, sf_dir, "jobs").select("job_id", "submission_us"))
