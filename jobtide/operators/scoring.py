"""Normalised scores and table shapes of evaluation results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.session import durable

# Metrics for which less is better, and the metrics that are charted.
LOWER_IS_BETTER = ["avg_wait_time", "oom_rate"]
PLOT_METRICS = ["throughput", "avg_wait_time", "cpu_utilization", "success_rate"]


def min_max_normalize(results: DataFrame, by: Sequence[str] = ("scenario", "metric")) -> DataFrame:
    """Value scaled to 0..1 within its group; NULL where all values are equal.

    The limits are aggregated before the join back, so a large group is not gathered in one task.
    """
    limits = results.groupBy(*by).agg(F.min("value").alias("__low"), F.max("value").alias("__high"))
    span = F.col("__high") - F.col("__low")
    scaled = F.when(span > 0, F.try_divide(F.col("value") - F.col("__low"), span))
    score = F.when(F.col("metric").isin(LOWER_IS_BETTER), 1.0 - scaled).otherwise(scaled)
    return results.join(limits, list(by)).withColumn("normalized", score).drop("__low", "__high")


def normalized_scores(results: DataFrame, materialize: bool = False) -> DataFrame:
    """Mean normalised value per scenario and algorithm; 0 when no metric tells them apart.

    The results are read twice: ``materialize`` writes them once when they come from a shuffle.
    """
    results = durable(results) if materialize else results
    scored = min_max_normalize(results.filter(F.col("value").isNotNull()))
    return scored.groupBy("scenario", "algorithm").agg(
        F.coalesce(F.avg("normalized"), F.lit(0.0)).alias("score")
    )


def score_matrix(scores: DataFrame, algorithms: Sequence[str]) -> DataFrame:
    return scores.groupBy("scenario").pivot("algorithm", list(algorithms)).agg(F.first("score"))


def results_flat(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per scenario and algorithm with a column per metric."""
    return results.groupBy("scenario", "algorithm").pivot("metric", list(metrics)).agg(F.first("value"))


def results_for_plot(flat: DataFrame, metrics: Sequence[str] = PLOT_METRICS) -> DataFrame:
    """Long rows of the charted metrics that are present."""
    present = [m for m in metrics if m in flat.columns]
    doubles = flat.select("scenario", "algorithm", *[F.col(m).cast("double").alias(m) for m in present])
    long = doubles.unpivot(["scenario", "algorithm"], present, "metric", "value")
    return long.filter(F.col("value").isNotNull())
