"""Seeded augmentation of logged states. The same row always gets the same draw."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.dims import ANOMALY_RATE, NOISE_SIGMA
from jobtide.functions.hashing import draw, normal, uniform


def _keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def augment_noise(
    steps: DataFrame, keys: Sequence[str], probability: float = 0.5, sigma: float = NOISE_SIGMA, seed: int = 1
) -> DataFrame:
    """Copies of a share of the rows with normal noise on every element of the state."""
    chosen = steps.filter(uniform(seed, *_keys(keys)) < probability)
    noisy = F.transform("state", lambda x, i: (x + sigma * normal(seed + 1, *_keys(keys), i)).cast("float"))
    return chosen.withColumn("state", noisy).withColumn("augmented", F.lit(True))


def augment_anomaly(
    steps: DataFrame, keys: Sequence[str], rate: float = ANOMALY_RATE, seed: int = 101, most: int = 4
) -> DataFrame:
    """Copies of a few rows where one to ``most`` elements become 0 or 1."""
    chosen = steps.filter(uniform(seed, *_keys(keys)) < rate)
    count = (F.floor(uniform(seed + 1, *_keys(keys)) * most) + 1).cast("int")
    places = F.transform(
        "state",
        lambda x, i: F.struct(draw(seed + 2, *_keys(keys), i).alias("draw"), i.alias("at")),
    )
    rows = chosen.withColumn(
        "__hit", F.transform(F.slice(F.array_sort(places), F.lit(1), count), lambda p: p["at"])
    )
    extreme = lambda i: F.when(uniform(seed + 3, *_keys(keys), i) < 0.5, 0.0).otherwise(1.0)
    changed = F.transform(
        "state", lambda x, i: F.when(F.array_contains("__hit", i), extreme(i)).otherwise(x).cast("float")
    )
    return rows.withColumn("state", changed).drop("__hit").withColumn("anomaly", F.lit(True))


def augment_union(steps: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """The original rows with their noisy and anomalous copies."""
    plain = steps
    for flag in ("augmented", "anomaly"):
        if flag not in plain.columns:
            plain = plain.withColumn(flag, F.lit(None).cast("boolean"))
    noise = {k: v for k, v in options.items() if k in ("probability", "sigma")}
    rate = {k: v for k, v in options.items() if k == "rate"}
    return plain.unionByName(augment_noise(plain, keys, **noise)).unionByName(augment_anomaly(plain, keys, **rate))


# Smallest millicores, MB and seconds that a varied job may ask for.
FLOORS = {"cpu_request": 100, "memory_request": 256, "duration": 10}


def noisy_attributes(
    jobs: DataFrame,
    keys: Sequence[str],
    sigma: float = NOISE_SIGMA,
    floors: Mapping[str, int] = FLOORS,
    seed: int = 201,
) -> DataFrame:
    """What-if copies of jobs: whole-number attributes scaled by 1 + noise, not below a floor."""
    changed = {}
    for offset, (name, least) in enumerate(floors.items()):
        varied = F.col(name) * (F.lit(1.0) + sigma * normal(seed + 2 * offset, *_keys(keys)))
        changed[name] = F.greatest(varied.cast("bigint"), F.lit(least).cast("bigint"))
    return jobs.withColumns(changed)
