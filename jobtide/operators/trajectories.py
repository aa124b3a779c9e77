"""Step logs of scheduling episodes: segmentation, pairs, totals and evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobtide.operators.monitor import newest
from jobtide.operators.ordered import OrderedScan, trailing


def recent_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, n: int = 10, block_rows: int = 100_000,
    position: str | None = None,
) -> DataFrame:
    """Mean of the last ``n`` samples including this one; ``position`` names a column for the number of the sample."""
    number = position or "__position"
    numbered = OrderedScan(df, keys, order).row_number(number).result()
    rows = trailing(numbered, keys, number, n, {out: F.avg(value)}, block_rows)
    return rows if position else rows.drop(number)


def next_state_pairs(steps: DataFrame, keys: Sequence[str], order: Sequence[str], state: str = "state") -> DataFrame:
    """The state of the following step beside each one; NULL at the end of an episode."""
    return OrderedScan(steps, keys, order).following(next_state=state).result()


def queue_delta(steps: DataFrame, keys: Sequence[str], order: Sequence[str], queue: str = "queue_length") -> DataFrame:
    """How much shorter the queue became since the step before, never below 0."""
    scan = OrderedScan(steps, keys, order).previous(__before=queue)
    reduction = F.coalesce(F.greatest(F.col("__before") - F.col(queue), F.lit(0)), F.lit(0))
    return scan.result().withColumn("queue_reduction", reduction).drop("__before")


def episode_segmentation(steps: DataFrame, keys: Sequence[str], order: Sequence[str], ended: Column) -> DataFrame:
    """Number episodes from 0; a step after one that ended starts the next episode."""
    flag = F.when(ended, 1).otherwise(0).cast("bigint")
    scan = OrderedScan(steps, keys, order).running_sum(__ends=flag)
    return scan.result().withColumn("episode_no", F.col("__ends") - flag).drop("__ends")


def sample_every(steps: DataFrame, n: int = 10, step: str = "step", queue: str = "queue_length") -> DataFrame:
    return steps.filter((F.col(step) % n == 0) & (F.col(queue) > 0))


def episode_totals(steps: DataFrame, by: Sequence[str] = ("algorithm", "episode")) -> DataFrame:
    return steps.groupBy(*by).agg(
        F.sum("reward").alias("total_reward"),
        F.count("*").alias("steps"),
        F.count_if("is_admit").alias("admits"),
        F.count_if(F.col("is_admit") & F.col("admit_ok")).alias("successful_admits"),
    )


def policy_evaluation(
    steps: DataFrame, by: Sequence[str] = ("algorithm",), episode: Sequence[str] = ("episode",)
) -> DataFrame:
    """Mean and population deviation over episodes; the success rate skips episodes without an admit."""
    rate = F.when(F.col("admits") > 0, F.try_divide("successful_admits", "admits"))
    return (
        episode_totals(steps, [*by, *episode])
        .groupBy(*by)
        .agg(
            F.avg("total_reward").alias("mean_reward"),
            F.stddev_pop("total_reward").alias("std_reward"),
            F.avg("steps").alias("mean_episode_length"),
            F.stddev_pop("steps").alias("std_episode_length"),
            F.coalesce(F.avg(rate), F.lit(0.0)).alias("mean_success_rate"),
            F.count("*").alias("total_episodes"),
        )
    )


# What the last step of an episode reports.
LAST_INFO = ["completed_jobs", "avg_wait_time", "cpu_utilization", "memory_utilization"]


def scenario_evaluation(
    steps: DataFrame,
    order: Sequence[str] = ("step",),
    by: Sequence[str] = ("scenario", "algorithm"),
    episode: Sequence[str] = ("episode",),
) -> DataFrame:
    """Rewards, the last reported figures and the share of successful admits of each episode, averaged.

    Throughput is the mean number of completed jobs. An episode without an admit has no success rate.
    """
    episodes = steps.groupBy(*by, *episode).agg(
        F.sum("reward").alias("reward"),
        F.try_divide(F.count_if(F.col("is_admit") & F.col("admit_ok")), F.count_if("is_admit")).alias("success_rate"),
        *[newest(name, order).alias(name) for name in LAST_INFO],
    )
    return episodes.groupBy(*by).agg(
        F.avg("reward").alias("avg_reward"),
        F.stddev_pop("reward").alias("std_reward"),
        F.avg("completed_jobs").alias("throughput"),
        F.avg("success_rate").alias("success_rate"),
        F.avg(F.coalesce("avg_wait_time", F.lit(0.0))).alias("avg_wait_time"),
        F.avg("cpu_utilization").alias("cpu_utilization"),
        F.avg("memory_utilization").alias("memory_utilization"),
    )


def learning_curve(evaluations: DataFrame, by: Sequence[str] = ("algorithm", "timestep"), reward: str = "reward") -> DataFrame:
    """Mean and deviation of the evaluation rewards at each timestep, with the band around the mean."""
    curve = evaluations.groupBy(*by).agg(
        F.avg(reward).alias("mean_reward"), F.stddev_pop(reward).alias("std_reward")
    )
    return curve.withColumns(
        {
            "band_low": F.col("mean_reward") - F.col("std_reward"),
            "band_high": F.col("mean_reward") + F.col("std_reward"),
        }
    )


def last_n_mean(
    episodes: DataFrame, by: Sequence[str], newest_first: Sequence[Column], value: str, out: str, n: int = 100
) -> DataFrame:
    """Mean over the newest ``n`` episodes. Map tasks keep at most ``n`` rows per key."""
    window = Window.partitionBy(*by).orderBy(*newest_first)
    newest = episodes.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= n)
    return newest.groupBy(*by).agg(F.avg(value).alias(out))
