"""Episodes of a step log, evaluation of policies and scenarios, scores, augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.dims import ANOMALY_RATE, NOISE_SIGMA
from jobtide.operators import augment, scoring, trajectories
from jobtide.plans.registry import query
from jobtide.plans.views import oracle, view


@query(
    oracle(
        """select event_id, round(avg(cast(k as double) / 128) over (partition by episode order by step rows 9 preceding), 9) as recent_cpu
        from steps""",
        "steps",
    )
)
def recent_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = view(spark, sf_dir, "e").withColumn("cpu", F.col("k") / 128.0)
    rows = trajectories.recent_mean(samples, ["user_id"], ["us", "event_id"], "cpu", "recent_cpu")
    return rows.select("event_id", F.round("recent_cpu", 9).alias("recent_cpu"))


@query(
    oracle(
        """select event_id, k as cpu_state, queue_length, lead(k) over w as next_cpu_state, lead(queue_length) over w as next_queue_length
        from steps window w as (partition by episode order by step)""",
        "steps",
    )
)
def next_state_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = view(spark, sf_dir, "steps").withColumn("state", F.struct("k", "queue_length"))
    rows = trajectories.next_state_pairs(steps, ["episode"], ["step"])
    return rows.select(
        "event_id",
        F.col("k").alias("cpu_state"),
        "queue_length",
        F.col("next_state.k").alias("next_cpu_state"),
        F.col("next_state.queue_length").alias("next_queue_length"),
    )


@query(
    oracle(
        """select event_id, cast(coalesce(sum(cast(queue_length = 0 as int)) over
          (partition by episode order by step rows between unbounded preceding and 1 preceding), 0) as bigint) as episode_no from steps""",
        "steps",
    )
)
def episode_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = view(spark, sf_dir, "steps")
    rows = trajectories.episode_segmentation(steps, ["episode"], ["step"], F.col("queue_length") == 0)
    return rows.select("event_id", "episode_no")


@query(oracle("select event_id, step from steps where step % 10 = 0 and queue_length > 0", "steps"))
def sample_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.sample_every(view(spark, sf_dir, "steps"), 10).select("event_id", "step")


_TOTALS = """totals as (
  select algorithm, episode, sum(reward) as total_reward, count(*) as steps, count(*) filter (where is_admit) as admits,
    count(*) filter (where is_admit and admit_ok) as successful_admits from steps group by algorithm, episode)"""


@query(
    oracle(
        f"with {_TOTALS} select algorithm, episode, round(total_reward, 6) as total_reward, steps, admits, successful_admits from totals",
        "steps",
    )
)
def episode_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectories.episode_totals(view(spark, sf_dir, "steps"))
    return rows.withColumn("total_reward", F.round("total_reward", 6))


@query(
    oracle(
        f"""with {_TOTALS} select algorithm, round(avg(total_reward), 6) as mean_reward, round(stddev_pop(total_reward), 6) as std_reward,
          round(avg(steps), 6) as mean_episode_length, round(stddev_pop(steps), 6) as std_episode_length,
          round(coalesce(avg(case when admits > 0 then successful_admits / admits end), 0), 6) as mean_success_rate,
          count(*) as total_episodes from totals group by algorithm""",
        "steps",
    )
)
def policy_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectories.policy_evaluation(view(spark, sf_dir, "steps"))
    return rows.withColumns({c: F.round(c, 6) for c in rows.columns if c.startswith(("mean", "std"))})


_SCENARIOS = """ev as (
  select scenario, algorithm, episode, sum(reward) as reward, arg_max(k, step) as k, arg_max(queue_length, step) as q,
    max(step) as n, count(*) filter (where is_admit and admit_ok) / nullif(count(*) filter (where is_admit), 0) as ok from steps group by scenario, algorithm, episode),
sc as (
  select scenario, algorithm, avg(reward) as avg_reward, stddev_pop(reward) as std_reward, avg(n) as throughput, avg(ok) as success_rate,
    avg(coalesce(case when k % 3 <> 0 then q end, 0)) as avg_wait_time, avg(cast(k as double) / 128) as cpu_utilization,
    avg((k % 64) / 64) as memory_utilization from ev group by scenario, algorithm)"""
_FIGURES = ["avg_reward", "std_reward", "throughput", "success_rate", "avg_wait_time", "cpu_utilization", "memory_utilization"]


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    steps = view(spark, sf_dir, "steps").withColumns(
        {
            "completed_jobs": F.col("step"),
            "avg_wait_time": F.when(k % 3 != 0, F.col("queue_length").cast("double")),
            "cpu_utilization": k / 128.0,
            "memory_utilization": (k % 64) / 64.0,
        }
    )
    return trajectories.scenario_evaluation(steps)


@query(oracle(f"with {_SCENARIOS} select scenario, algorithm, " + ", ".join(f"round({c}, 6) as {c}" for c in _FIGURES) + " from sc", "steps"))
def scenario_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenarios(spark, sf_dir).withColumns({c: F.round(c, 6) for c in _FIGURES})


@query(
    oracle(
        """with c as (select algorithm, step // 10 * 10 as timestep, avg(reward) as m, stddev_pop(reward) as s from steps group by 1, 2)
        select algorithm, cast(timestep as bigint) as timestep, round(m, 6) as mean_reward, round(s, 6) as std_reward,
          round(m - s, 6) as band_low, round(m + s, 6) as band_high from c""",
        "steps",
    )
)
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = view(spark, sf_dir, "steps").withColumn("timestep", F.floor(F.col("step") / 10) * 10)
    rows = trajectories.learning_curve(steps)
    return rows.withColumns({c: F.round(c, 6) for c in ("mean_reward", "std_reward", "band_low", "band_high")})


@query(
    oracle(
        f"""with {_TOTALS} select algorithm, round(avg(total_reward), 6) as recent_reward from (
          select *, row_number() over (partition by algorithm order by episode desc) as r from totals) t
        where r <= 20 group by algorithm""",
        "steps",
    )
)
def last_n_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean total reward of the twenty newest episodes of each algorithm."""
    episodes = trajectories.episode_totals(view(spark, sf_dir, "steps"))
    newest = [F.col("episode").desc()]
    rows = trajectories.last_n_mean(episodes, ["algorithm"], newest, "total_reward", "recent_reward", n=20)
    return rows.withColumn("recent_reward", F.round("recent_reward", 6))


_LONG = ", r as (" + " union all ".join(
    f"select scenario, algorithm, '{c}' as metric, cast({c} as double) as value from sc" for c in _FIGURES
) + ")"
_ALGORITHMS = ["A2C", "DQN", "PPO"]


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _scenarios(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in _FIGURES})
    return wide.unpivot(["scenario", "algorithm"], _FIGURES, "metric", "value")


_SCORES = """, lim as (select *, min(value) over w as lo, max(value) over w as hi from r window w as (partition by scenario, metric)),
scores as (select scenario, algorithm, coalesce(avg(case when hi > lo then case when metric in ('avg_wait_time', 'oom_rate')
    then 1 - (value - lo) / (hi - lo) else (value - lo) / (hi - lo) end end), 0) as score from lim group by scenario, algorithm)"""


@query(oracle(f"with {_SCENARIOS}{_LONG}{_SCORES} select scenario, algorithm, round(score, 6) as score from scores", "steps"))
def normalized_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.normalized_scores(_results(spark, sf_dir), materialize=True).withColumn("score", F.round("score", 6))


@query(
    oracle(
        f"with {_SCENARIOS}{_LONG}{_SCORES} select scenario, "
        + ", ".join(f"round(max(score) filter (where algorithm = '{a}'), 6) as \"{a}\"" for a in _ALGORITHMS)
        + " from scores group by scenario",
        "steps",
    )
)
def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.score_matrix(scoring.normalized_scores(_results(spark, sf_dir), materialize=True), _ALGORITHMS)
    return rows.withColumns({a: F.round(a, 6) for a in _ALGORITHMS})


@query(oracle(f"with {_SCENARIOS} select scenario, algorithm, " + ", ".join(f"round({c}, 6) as {c}" for c in _FIGURES) + " from sc", "steps"))
def results_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.results_flat(_results(spark, sf_dir), _FIGURES)
    return rows.withColumns({c: F.round(c, 6) for c in _FIGURES})


@query(
    oracle(
        f"""with {_SCENARIOS}{_LONG} select scenario, algorithm, metric, round(value, 6) as value from r
        where metric in ('throughput', 'avg_wait_time', 'cpu_utilization', 'success_rate') and value is not null""",
        "steps",
    )
)
def results_for_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.results_for_plot(scoring.results_flat(_results(spark, sf_dir), _FIGURES))
    return rows.withColumn("value", F.round("value", 6))


def logged_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged steps with a short state vector each."""
    k, queue = F.col("k"), F.col("queue_length")
    state = F.array(*[x.cast("float") for x in (k / 128.0, queue / 12.0, F.col("reward"), (k % 7) / 7.0, (k % 3) / 3.0)])
    return view(spark, sf_dir, "steps").withColumn("state", state)


def _stored(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", F.transform("state", lambda x: F.round(x.cast("double"), 5)).alias("state"))


def _uniform_sql(seed: int, *parts: str) -> str:
    """The draws of ``functions.hashing`` in the words of the oracle database."""
    key = " || '-' || ".join([f"'{seed}'", *[f"({p})::varchar" for p in parts]])
    return f"((('0x' || substr(md5({key}), 1, 10))::bigint + 0.5) / {16**10}.0::double)"


def _normal_sql(seed: int, *parts: str) -> str:
    return f"(sqrt(-2.0::double * ln({_uniform_sql(seed, *parts)})) * cos(2.0::double * pi() * {_uniform_sql(seed + 1, *parts)}))"


_LOGGED = """logged as (select event_id, [cast(x as float) for x in [k / 128::double, queue_length / 12::double, reward::double, (k % 7) / 7::double, (k % 3) / 3::double]] as state from steps)"""
_NOISY = f"""noisy as (select event_id, list_transform(state, lambda x, i: cast(x + {NOISE_SIGMA} * {_normal_sql(2, "event_id", "i - 1")} as float)) as state
  from logged where {_uniform_sql(1, "event_id")} < 0.5)"""


def _odd_sql(rate: float) -> str:
    place = "('0x' || substr(md5('103-' || event_id::varchar || '-' || (i - 1)::varchar), 1, 10))::bigint"
    return f"""odd as (select event_id, list_transform(state, lambda x, i: case when list_contains(hit, i) then
      case when {_uniform_sql(104, "event_id", "i - 1")} < 0.5 then 0.0 else 1.0 end else x end) as state
    from (select event_id, state, list_transform(list_sort(list_transform(state, lambda x, i: {{'draw': {place}, 'at': i}}))
      [1:floor({_uniform_sql(102, "event_id")} * 4)::int + 1], lambda p: p['at']) as hit from logged where {_uniform_sql(101, "event_id")} < {rate}))"""


_SHOWN = "select event_id, list_transform(state, lambda x: round(x::double, 5)) as state from"


@query(oracle(f"with {_LOGGED}, {_NOISY} {_SHOWN} noisy", "steps"))
def augment_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(augment.augment_noise(logged_states(spark, sf_dir), ["event_id"]))


@query(oracle(f"with {_LOGGED}, {_odd_sql(0.1)} {_SHOWN} odd", "steps"))
def augment_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(augment.augment_anomaly(logged_states(spark, sf_dir), ["event_id"], rate=0.1))


@query(
    oracle(
        f"""with {_LOGGED}, {_NOISY}, {_odd_sql(ANOMALY_RATE)} select event_id, null::boolean as augmented, null::boolean as anomaly from logged
        union all select event_id, true, null from noisy union all select event_id, null, true from odd""",
        "steps",
    )
)
def augment_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = augment.augment_union(logged_states(spark, sf_dir), ["event_id"])
    return rows.select("event_id", "augmented", "anomaly")


_VARIED = ", ".join(
    f"greatest(trunc({name} * (1.0::double + {NOISE_SIGMA} * {_normal_sql(201 + 2 * i, 'event_id')}))::bigint, {least}) as {name}"
    for i, (name, least) in enumerate(augment.FLOORS.items())
)


@query(
    oracle(
        f"""with asked as (select event_id, (cpu_request * 1000)::bigint as cpu_request, (memory_request * 1024)::bigint as memory_request,
          (user_id % 60 + 1) * 60 as duration from jobs)
        select event_id, {_VARIED} from asked""",
        "jobs",
    )
)
def noisy_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = view(spark, sf_dir, "jobs").select(
        "event_id",
        (F.col("cpu_request") * 1000).cast("bigint").alias("cpu_request"),
        (F.col("memory_request") * 1024).cast("bigint").alias("memory_request"),
        ((F.col("user_id") % 60 + 1) * 60).alias("duration"),
    )
    return augment.noisy_attributes(jobs, ["event_id"])
