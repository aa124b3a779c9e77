"""State vectors, scalar features and rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions import encoding, rewards
from jobtide.operators import cluster, trajectories, vectors
from jobtide.plans.registry import query
from jobtide.plans.views import oracle, view

_CLUSTERS = """clusters as (
  select snapshot_id, sum(cpu_total) as cpu_total, sum(cpu_total) - sum(cpu_used) as cpu_available,
    sum(memory_total) as memory_total, sum(memory_total) - sum(memory_used) as memory_available,
    sum(cpu_used) / sum(cpu_total) as cpu_u, sum(memory_used) / sum(memory_total) as mem_u,
    (select count(*) from jobs where status = 'Running' and user_id % 5 = snapshot_id) as running_jobs,
    (select count(*) from jobs where oom_killed and user_id % 5 = snapshot_id) as oom_events,
    (select avg(cast(k as double) / 128) from (select user_id % 5 as s, k, row_number() over (partition by user_id % 5 order by us desc, event_id desc) as n from e) last
      where s = snapshot_id and n <= 10) as recent_cpu,
    snapshot_id / 32.0 as oom_rate from nodes group by snapshot_id)"""
_TYPES = "case job_type when 'spark' then 0 when 'ml' then 1 when 'batch' then 2 when 'etl' then 3 when 'realtime' then 4 else 0 end / 5"
_CODE = "case job_type when 'spark' then .8 when 'ml' then .6 when 'batch' then .4 when 'etl' then .5 when 'realtime' then .7 else .2 end"
_RANKED = """ranked as (
  select *, row_number() over (partition by snapshot_id order by priority desc, arrival_us, job_id) as r
  from pending_queue)"""


_LIVE_JOB = """[least(r.cpu_request / c.cpu_total, 1), least(r.memory_request / c.memory_total, 1),
        least(r.priority / 10, 1), least((now.t - r.arrival_us) / 6e7 / 60, 1), least(r.estimated_duration / 120, 1),
        cast({code} as double)]"""
_LIVE_CLUSTER = """[cpu_available / greatest(cpu_total, 1), memory_available / greatest(memory_total, 1),
          cpu_u, mem_u, least(running_jobs / 100, 1), cpu_u, cast(oom_rate as double)]"""
_LOGGED_JOB = """[cast(r.cpu_request as double), cast(r.memory_request as double), r.priority / 10, (now.t - r.arrival_us) / 3.6e9,
        r.estimated_duration / 60, cast({types} as double)]"""
_LOGGED_CLUSTER = """[cpu_available / cpu_total, memory_available / memory_total, cpu_u, mem_u, running_jobs / 100, recent_cpu, oom_events / 100]"""


def _vector_sql(k: int, padded: bool, logged: bool = False) -> str:
    job = _LOGGED_JOB.format(types=_TYPES) if logged else _LIVE_JOB.format(code=_CODE)
    cluster_slots = _LOGGED_CLUSTER if logged else _LIVE_CLUSTER
    width = f"{7 + 6 * k}" if padded else "7 + 6 * coalesce(q.n, 0)"
    return f"""with {_CLUSTERS}, {_RANKED},
    now as (select max(arrival_us) as t from pending_queue),
    job as (select r.snapshot_id, r.r, {job} as v
      from ranked r join clusters c on c.snapshot_id = r.snapshot_id, now where r.r <= {k}),
    q as (select snapshot_id, count(*) as n from job group by snapshot_id),
    item as (
      select snapshot_id, generate_subscripts(v, 1) - 1 as pos, unnest(v) as x from (
        select snapshot_id, {cluster_slots} as v from clusters) t
      union all
      select snapshot_id, 7 + 6 * (r - 1) + generate_subscripts(v, 1) - 1, unnest(v) from job),
    place as (select c.snapshot_id, unnest(range(0, {width})) as pos from clusters c left join q on q.snapshot_id = c.snapshot_id)
    select p.snapshot_id, cast(p.pos as int) as pos, round(cast(cast(coalesce(i.x, 0) as float) as double), 5) as x
    from place p left join item i on i.snapshot_id = p.snapshot_id and i.pos = p.pos"""


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = view(spark, sf_dir, "jobs").withColumn("snapshot_id", (F.col("user_id") % 5).cast("bigint"))
    rows = cluster.cluster_balance(view(spark, sf_dir, "nodes"), jobs.filter("status = 'Running'"), view(spark, sf_dir, "pending_queue"))
    samples = view(spark, sf_dir, "e").select((F.col("user_id") % 5).cast("bigint").alias("snapshot_id"), "us", "event_id", (F.col("k") / 128.0).alias("cpu"))
    recent = trajectories.last_n_mean(samples, ["snapshot_id"], [F.col("us").desc(), F.col("event_id").desc()], "cpu", "recent_cpu", n=10)
    killed = jobs.filter("oom_killed").groupBy("snapshot_id").agg(F.count("*").alias("oom_events"))
    rows = rows.join(recent, "snapshot_id", "left").join(killed, "snapshot_id", "left")
    return rows.select(
        "snapshot_id",
        "cpu_total",
        (F.col("cpu_total") - F.col("cpu_used")).alias("cpu_available"),
        "memory_total",
        (F.col("memory_total") - F.col("memory_used")).alias("memory_available"),
        F.col("cpu_utilization").alias("avg_cpu_utilization"),
        F.col("memory_utilization").alias("avg_memory_utilization"),
        "running_jobs",
        "recent_cpu",
        F.coalesce("oom_events", F.lit(0)).alias("oom_events"),
        (F.col("snapshot_id") / 32.0).alias("oom_rate"),
    )


def _positions(states: DataFrame) -> DataFrame:
    rows = states.select("snapshot_id", F.posexplode("state").alias("pos", "x"))
    return rows.withColumn("x", F.round(F.col("x").cast("double"), 5))


_KNOWN_TYPES = ["spark", "ml", "batch", "etl", "realtime"]


def _vector(spark: SparkSession, sf_dir: str, build, k: int, **options) -> DataFrame:
    queue = view(spark, sf_dir, "pending_queue")
    now = queue.select(F.max("arrival_us")).scalar()
    return _positions(build(queue, _clusters(spark, sf_dir), now, k, **options))


@query(oracle(_vector_sql(10, True), "nodes", "pending_queue", "jobs", "e"))
def state_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector(spark, sf_dir, vectors.state_vector, 10)


@query(oracle(_vector_sql(50, False, logged=True), "nodes", "pending_queue", "jobs", "e"))
def state_vector_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector(spark, sf_dir, vectors.state_vector_ragged, 50, job_types=_KNOWN_TYPES)


@query(oracle(_vector_sql(50, True, logged=True), "nodes", "pending_queue", "jobs", "e"))
def state_vector_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector(spark, sf_dir, vectors.state_vector_padded, 50, job_types=_KNOWN_TYPES)


@query(
    oracle(
        f"with {_RANKED} select snapshot_id, job_id, cast(r as int) as queue_rank from ranked where r <= 10",
        "pending_queue",
    )
)
def queue_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = view(spark, sf_dir, "pending_queue").select("snapshot_id", "job_id", "priority", "arrival_us")
    return vectors.queue_top_k(queue, 10).select("snapshot_id", "job_id", "queue_rank")


@query(
    oracle(
        f"""with {_RANKED}, known as (select snapshot_id from nodes union select snapshot_id + 5 from nodes),
        slots as (select snapshot_id, unnest(range(1, 51)) as slot from known)
        select s.snapshot_id, cast(s.slot as int) as slot, coalesce(r.cpu_request, 0) as cpu_request,
          coalesce(r.memory_request, 0) as memory_request, cast(coalesce(r.priority, 0) as double) as priority
        from slots s left join ranked r on r.snapshot_id = s.snapshot_id and r.r = s.slot""",
        "pending_queue",
        "nodes",
    )
)
def pad_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots from 5 on have no jobs waiting."""
    known = view(spark, sf_dir, "nodes").select("snapshot_id")
    known = known.unionByName(known.select((F.col("snapshot_id") + 5).alias("snapshot_id")))
    queue = view(spark, sf_dir, "pending_queue")
    return vectors.pad_queue(queue, ["cpu_request", "memory_request", "priority"], 50, snapshots=known)


@query(
    oracle(
        """with now as (select max(arrival_us) as t from pending_queue)
        select snapshot_id, count(*) as queue_length, round(sum(t - arrival_us) / 6e7 / count(*), 4) as avg_wait_min
        from pending_queue, now group by snapshot_id""",
        "pending_queue",
    )
)
def mean_queue_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = view(spark, sf_dir, "pending_queue")
    rows = vectors.mean_queue_wait(queue, queue.select(F.max("arrival_us")).scalar())
    return rows.withColumn("avg_wait_min", F.round("avg_wait_min", 4))


@query(
    oracle(
        f"""select event_id, cast({_CODE} as double) as type_code,
          round(case when event_id % 6 = 5 then 0 else (event_id % 6) / 5 end, 6) as type_ordinal,
          round(least(cpu_request / 64, 1), 6) as f0, round(least(memory_request / 100, 1), 6) as f1,
          round(least(priority / 10, 1), 6) as f2, round(least(coalesce((start_us - submission_us) / 6e7, 0) / 60, 1), 6) as f3,
          round(least((event_id % 200) / 120, 1), 6) as f4,
          round(cpu_request, 6) as u0, round(memory_request, 6) as u1, round(priority / 10, 6) as u2,
          round(coalesce((start_us - submission_us) / 6e7, 0) / 60, 6) as u3, round(event_id % 200 / 60, 6) as u4,
          round(case when event_id % 6 = 5 then 0 else (event_id % 6) / 5 end, 6) as u5
        from jobs""",
        "jobs",
    )
)
def job_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped and unclamped features of every job; no snapshot of memory, so its scale is 100."""
    jobs = view(spark, sf_dir, "jobs")
    wait = F.coalesce((F.col("start_us") - F.col("submission_us")) / 6e7, F.lit(0.0))
    minutes = (F.col("event_id") % 200).cast("double")
    live = encoding.job_features(
        F.col("cpu_request"), F.col("memory_request"), F.col("priority"), wait, minutes, F.col("job_type"),
        F.lit(64.0), F.lit(None).cast("double"),
    )
    raw = encoding.job_features_unclamped(
        F.col("cpu_request") * 1000, F.col("memory_request") * 1024, F.col("priority"), wait * 60, minutes * 60, F.col("job_type"), _KNOWN_TYPES
    )
    ordinal = encoding.encode_job_type_ordinal(F.col("job_type"), _KNOWN_TYPES)
    rows = jobs.select("event_id", "job_type", live.alias("f"), raw.alias("u"))
    return rows.select(
        "event_id",
        F.round(F.col("f")[5], 6).alias("type_code"),
        F.round(ordinal, 6).alias("type_ordinal"),
        *[F.round(F.col("f")[i], 6).alias(f"f{i}") for i in range(5)],
        *[F.round(F.col("u")[i], 6).alias(f"u{i}") for i in range(6)],
    )


@query(
    oracle(
        """with h as (select event_id, us, user_id, cast(k as double) / 128 as cpu, user_id % 64 / 64.0 as mem, k,
            avg(cast(k as double) / 128) over (partition by user_id order by us, event_id rows 9 preceding) as recent,
            row_number() over (partition by user_id order by us, event_id) as jobs from e)
        select event_id, round(1 - cpu, 9) as c0, round(1 - mem, 9) as c1, round(cpu, 9) as c2, round(mem, 9) as c3, round(k / 100, 9) as c4, round(recent, 9) as c5,
          round(k / 100, 6) as oom_scaled, round(k / jobs, 6) as oom_share from h""",
        "e",
    )
)
def cluster_features_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both variants of the history slots, with the mean of the last ten samples."""
    samples = view(spark, sf_dir, "e").withColumn("cpu", F.col("k") / 128.0)
    rows = trajectories.recent_mean(samples, ["user_id"], ["us", "event_id"], "cpu", "recent", position="jobs")
    memory = (F.col("user_id") % 64) / 64.0
    common = (
        1 - F.col("cpu"), 1 - memory, F.col("cpu"), memory, F.col("k"), F.col("recent"), F.col("k"),
    )
    rows = rows.select(
        "event_id",
        encoding.cluster_features_history(*common).alias("a"),
        encoding.cluster_features_history(*common, F.col("jobs")).alias("b"),
    )
    return rows.select(
        "event_id",
        *[F.round(F.col("a")[i], 9).alias(f"c{i}") for i in range(6)],
        F.round(F.col("a")[6], 6).alias("oom_scaled"),
        F.round(F.col("b")[6], 6).alias("oom_share"),
    )


@query(
    oracle(
        f"""with {_CLUSTERS} select snapshot_id, round(cpu_available / greatest(cpu_total, 1), 6) as c0,
          round(memory_available / greatest(memory_total, 1), 6) as c1, round(cpu_u, 6) as c2, round(mem_u, 6) as c3,
          round(least(running_jobs / 100, 1), 6) as c4, round(cpu_u, 6) as c5, round(cast(oom_rate as double), 6) as c6,
          round((cpu_u + mem_u) / 2, 6) as utilization from clusters""",
        "nodes",
        "jobs",
        "e",
    )
)
def cluster_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clusters(spark, sf_dir)
    vector = encoding.cluster_features(
        F.col("cpu_available"), F.col("cpu_total"), F.col("memory_available"), F.col("memory_total"),
        F.col("avg_cpu_utilization"), F.col("avg_memory_utilization"), F.col("running_jobs"), F.col("oom_rate"),
    )
    use = encoding.cluster_utilization(F.col("avg_cpu_utilization"), F.col("avg_memory_utilization"))
    rows = rows.select("snapshot_id", vector.alias("v"), F.round(use, 6).alias("utilization"))
    return rows.select("snapshot_id", *[F.round(F.col("v")[i], 6).alias(f"c{i}") for i in range(7)], "utilization")


_REDUCTION = """d as (select *, coalesce(greatest(lag(queue_length) over (partition by episode order by step) - queue_length, 0), 0) as reduction from steps)"""


@query(oracle(f"with {_REDUCTION} select event_id, cast(reduction as int) as queue_reduction from d", "steps"))
def queue_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectories.queue_delta(view(spark, sf_dir, "steps"), ["episode"], ["step"])
    return rows.select("event_id", "queue_reduction")


@query(
    oracle(
        f"""with {_REDUCTION} select event_id, round(case when k % 10 = 0 then -1 else
          greatest(least(.4 * reduction + .3 * (k / 128) - .2 * (case when queue_length > 0 then least(k / 60, 1) else 0 end)
            - .1 * (case when is_admit and not admit_ok then 1 else 0 end), 1), -1) end, 6) as reward from d""",
        "steps",
    )
)
def live_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = trajectories.queue_delta(view(spark, sf_dir, "steps"), ["episode"], ["step"])
    k = F.col("k")
    reward = rewards.live_reward(
        F.col("queue_reduction"), k / 128.0, F.col("queue_length"), k.cast("double"),
        F.col("is_admit") & ~F.col("admit_ok"), k % 10 != 0,
    )
    return steps.select("event_id", F.round(reward, 6).alias("reward"))


@query(
    oracle(
        """select event_id, round(case when not admit_ok then -1 else .4 * ((step // 2) / greatest(step * 10, 1))
          + .3 * ((k / 128 + (k % 64) / 64) / 2) - .2 * least(k * 500 / greatest(step, 1) / 3600, 1) end, 9) as reward from steps""",
        "steps",
    )
)
def immediate_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, step = F.col("k"), F.col("step")
    reward = rewards.immediate_reward(
        F.col("admit_ok"), F.floor(step / 2), step * 10, k / 128.0, (k % 64) / 64.0, k * 500, step
    )
    return view(spark, sf_dir, "steps").select("event_id", F.round(reward, 9).alias("reward"))


@query(
    oracle(
        """with b as (select snapshot_id, stddev_pop(cpu_used / cpu_total) as s from nodes group by snapshot_id)
        select job_id, round(case when estimated_duration % 7 = 0 then -.1 when estimated_duration % 5 = 0 then -.5 else
          .1 - .2 * least(estimated_duration * 60 / 3600, 1) + .3 * ((cpu_request / 64 + memory_request / 256) / 2)
          + .2 * (1 - s) + .1 * (priority / 10) end, 6) as reward
        from pending_queue p join b on b.snapshot_id = p.snapshot_id""",
        "pending_queue",
        "nodes",
    )
)
def placement_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = cluster.node_balance(view(spark, sf_dir, "nodes")).select("snapshot_id", "cpu_utilization_std")
    minutes = F.col("estimated_duration")
    reward = rewards.placement_reward(
        minutes % 7 != 0, minutes % 5 != 0, minutes * 60, F.col("cpu_request") / 64, F.col("memory_request") / 256,
        F.col("cpu_utilization_std"), F.col("priority"),
    )
    joined = view(spark, sf_dir, "pending_queue").join(spread, "snapshot_id")
    return joined.select("job_id", F.round(reward, 6).alias("reward"))


@query(
    oracle(
        """select event_id, cast(k // 16 as int) as job_idx, cast(k % 16 as int) as node_idx,
          case when k % 13 >= queue_length or k % 13 = 10 then 'wait' else 'admit' end as action_type,
          queue_length = 0 and step > 20 as terminated, step >= 200 or k > 95 as truncated from steps""",
        "steps",
    )
)
def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded and classified actions with the end conditions of their steps."""
    pair = rewards.decode_action(F.col("k"), 16)
    return view(spark, sf_dir, "steps").select(
        "event_id",
        pair["job_idx"].alias("job_idx"),
        pair["node_idx"].alias("node_idx"),
        rewards.classify_action(F.col("k") % 13, F.col("queue_length")).alias("action_type"),
        rewards.is_terminated(F.col("queue_length"), F.col("step")).alias("terminated"),
        rewards.is_truncated(F.col("step"), (F.col("k") - 95 + 600)).alias("truncated"),
    )
