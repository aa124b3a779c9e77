"""Equi-joins in which one key may hold a large part of the left side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
HOT_SHARE = 0.01  # at most 100 keys can reach this share
ROWS_PER_SLICE = 1_000_000
MAX_SLICES = 1_024
KINDS = ("inner", "left", "leftouter", "left_outer", "semi", "leftsemi", "left_semi", "anti", "leftanti", "left_anti")


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int) -> dict[int, float]:
    """Hash and share of the keys that hold at least ``HOT_SHARE`` of the rows of a small sample."""
    sample = df.select(F.xxhash64(*keys).alias("h")).sample(False, min(1.0, SAMPLE_ROWS / rows), seed=5)
    counts = {row["h"]: row["count"] for row in sample.groupBy("h").count().collect()}
    total = sum(counts.values())
    return {h: n / total for h, n in counts.items() if n >= max(HOT_SHARE * total, 2)}


def join_lookup(
    left: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Join ``left`` with a side that has at most one row per key, spreading hot keys over slices.

    A hot key's rows are dealt out to slices by their content and its lookup row is repeated per
    slice. Without a hot key this is a plain join. Adaptive execution is free to do better, but
    unlike its skew handling this also holds when an aggregation on the same keys follows. Joins that
    return lookup rows without a match are refused, since a repeated row would come out repeatedly.
    """
    if how not in KINDS:
        raise ValueError(f"join kind {how!r}; known are {', '.join(KINDS)}")
    rows = left.count()
    if rows <= rows_per_slice:
        return left.join(lookup, list(keys), how)
    hot = hot_keys(left, keys, rows)
    if not hot:
        return left.join(lookup, list(keys), how)
    largest = max(hot.values()) * rows
    slices = int(min(MAX_SLICES, -(-largest // rows_per_slice)))
    is_hot = F.xxhash64(*keys).isin(list(hot))
    plain = [f.name for f in left.schema.fields if _hashable(f.dataType)]
    dealt: Column = F.pmod(F.xxhash64(*plain), F.lit(slices)).cast("int")
    spread = left.withColumn("__slice", F.when(is_hot, dealt).otherwise(0))
    repeated = F.when(is_hot, F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(F.array(F.lit(0)))
    copies = lookup.withColumn("__slice", F.explode(repeated))
    return spread.join(copies, [*keys, "__slice"], how).drop("__slice")


def _hashable(data_type) -> bool:
    return "map<" not in data_type.simpleString()
