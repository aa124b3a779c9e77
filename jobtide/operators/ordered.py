"""Ordered scans that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts every row of a key into one task. That is
kept as long as a small sample shows no key larger than a segment. Otherwise the global order
(hash of the keys, then the order columns) is cut at sampled split points into segments of similar
size. A window over (keys, segment) then never sees more than one segment of a key, and what a
later segment must know about the earlier ones travels in a digest with one row per cut key and
segment. There are at most ``max_segments`` segments and only keys hit by a split point enter the
digest, so it has at most twice that many rows and is broadcast.

The segment of a row depends on the row's own columns only, so recomputed tasks agree.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobtide.session import durable

SEG = "__segment"
KEY = "__key_hash"

ROWS_PER_SEGMENT = 1_000_000
MIN_ROWS_PER_SEGMENT = 1_000
MAX_SEGMENTS = 16_384
SAMPLES_PER_SEGMENT = 16
UNROLLED_POINTS = 256
HOT_SHARE = 0.5  # of a segment's samples: a key that may hold so much of a segment is worth cutting
FIRST_SAMPLES = 4_096  # enough for 256 segments


def segment_count(df: DataFrame, rows: int, rows_per_segment: int, max_segments: int) -> int:
    by_size = -(-rows // rows_per_segment)
    by_cores = min(df.sparkSession.sparkContext.defaultParallelism, rows // MIN_ROWS_PER_SEGMENT)
    return max(1, min(max(by_size, by_cores), max_segments))


def look(df: DataFrame, columns: Sequence[str], samples: int) -> tuple[int, list[tuple]]:
    """How many rows there are, and the ``samples`` of least hash, sorted: one pass for both."""
    seen = Observation()
    counted = df.select(*columns).observe(seen, F.count(F.lit(1)).alias("rows"))
    some = counted.withColumn("__draw", F.xxhash64(*columns)).orderBy("__draw").limit(samples).drop("__draw").collect()
    return seen.get["rows"], sorted(tuple(row) for row in some)


def split_points(df: DataFrame, columns: Sequence[str], rows: int, segments: int, sample: list[tuple]) -> list[tuple]:
    """At most ``segments - 1`` cut points of the order given by ``columns``, whose first is the key hash.

    ``sample`` is taken again where it is small for so many segments. No points are returned when no key is
    large enough to be worth cutting.
    """
    if segments <= 1:
        return []
    if len(sample) < min(rows, SAMPLES_PER_SEGMENT * segments):
        sample = look(df, columns, SAMPLES_PER_SEGMENT * segments)[1]
    hits = Counter(row[0] for row in sample)
    if max(hits.values(), default=0) < HOT_SHARE * len(sample) / segments:
        return []
    return list(dict.fromkeys(sample[i * len(sample) // segments] for i in range(1, segments)))


def constant_array(values: Sequence, element_type: str) -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{element_type}>")


def count_at_or_below(df: DataFrame, columns: Sequence[str], points: Sequence[tuple], out: str) -> DataFrame:
    """Adds how many of the sorted ``points`` are at or below the row: a binary search.

    Among few points each step is its own projection that reads the position of the step before, so
    the search stays in generated code. Many points are searched in one expression instead, since
    every step of the first form repeats the constants in the plan.
    """
    arrays = [
        constant_array([point[i] for point in points], df.schema[c].dataType.simpleString())
        for i, c in enumerate(columns)
    ]

    def reached(index: Column) -> Column:
        *front, (last, column) = list(zip(arrays, columns))
        found = F.get(last, index) <= F.col(column)
        for array, column in reversed(front):
            value = F.get(array, index)
            found = (value < F.col(column)) | ((value == F.col(column)) & found)
        return found

    def step(at: Column, jump: Column) -> Column:
        return F.when(reached(at + jump - 1), at + jump).otherwise(at)

    jumps = [F.lit(1 << bit) for bit in reversed(range(len(points).bit_length()))]
    if len(points) > UNROLLED_POINTS:
        return df.withColumn(out, F.aggregate(F.array(*jumps), F.lit(0), step))
    df = df.withColumn(out, F.lit(0))
    for jump in jumps:
        df = df.withColumn(out, step(F.col(out), jump))
    return df


class OrderedScan:
    """Rows of ``df`` ordered by ``order`` within ``keys``; every method adds columns.

    ``order`` must be a total order per key made of numbers, strings or booleans without NULLs.
    ``materialize`` writes the input once to the shared folder: use it when ``df`` is the result
    of a shuffle, since the input is read by the look at it, the digest and the scan.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        rows_per_segment: int = ROWS_PER_SEGMENT,
        max_segments: int = MAX_SEGMENTS,
        materialize: bool = False,
    ):
        if materialize:
            df = durable(df)
        self.keys, self.order = list(keys), list(order)
        hashed = df.withColumn(KEY, F.xxhash64(*self.keys) if self.keys else F.lit(0).cast("bigint"))
        columns = [KEY, *self.order]
        rows, sample = look(hashed, columns, FIRST_SAMPLES)
        points = split_points(hashed, columns, rows, segment_count(df, rows, rows_per_segment, max_segments), sample)
        self.cut_hashes = sorted({point[0] for point in points})
        self.is_split = bool(points)
        if self.is_split:
            skip = 0 if self.keys else 1  # without keys their hash is constant
            self.df = count_at_or_below(hashed, columns[skip:], [point[skip:] for point in points], SEG)
        else:
            self.df = hashed.withColumn(SEG, F.lit(0))

    # -- building blocks ---------------------------------------------------------------------

    def window(self, *order: Column):
        keys = [*self.keys, SEG] if self.is_split or not self.keys else self.keys
        return Window.partitionBy(*keys).orderBy(*(order or [F.col(c) for c in self.order]))

    def between_segments(self, descending: bool = False):
        """Strictly earlier (or later) segments of the same key; runs over the digest only."""
        seg = F.col(SEG).desc() if descending else F.col(SEG).asc()
        window = Window.partitionBy(*self.keys) if self.keys else Window.partitionBy(F.lit(0))
        return window.orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)

    def digest(self, *aggregates: Column) -> DataFrame:
        rows = self.df
        if self.keys:
            rows = rows.filter(F.col(KEY).isin(self.cut_hashes))
        return rows.groupBy(*self.keys, SEG).agg(*aggregates)

    def attach(self, df: DataFrame, carries: DataFrame) -> DataFrame:
        renamed = carries.select(
            *[F.col(k).alias(f"__d_{k}") for k in [*self.keys, SEG]],
            *[c for c in carries.columns if c not in [*self.keys, SEG]],
        )
        matches = [F.col(k).eqNullSafe(F.col(f"__d_{k}")) for k in [*self.keys, SEG]]
        condition = matches[0]
        for match in matches[1:]:
            condition = condition & match
        joined = df.join(F.broadcast(renamed), condition, "left")
        return joined.drop(*[f"__d_{k}" for k in [*self.keys, SEG]])

    def result(self) -> DataFrame:
        return self.df.drop(SEG, KEY)

    # -- scans -------------------------------------------------------------------------------

    def _neighbour(self, columns: dict[str, str | Column], forward: bool) -> OrderedScan:
        payload = F.struct(
            *[(c if isinstance(c, Column) else F.col(c)).alias(out) for out, c in columns.items()]
        )
        df = self.df.withColumn("__row", payload)
        near = (F.lead if forward else F.lag)("__row").over(self.window())
        df = df.withColumn("__near", near)
        if self.is_split:
            place = F.struct(*self.order)
            edge = (F.min_by if forward else F.max_by)(payload, place).alias("__edge")
            window = self.between_segments(descending=forward)
            carries = self.digest(edge).withColumn("__carry", F.last("__edge", True).over(window))
            df = self.attach(df, carries.drop("__edge"))
            df = df.withColumn("__near", F.coalesce("__near", "__carry")).drop("__carry")
        for out in columns:
            df = df.withColumn(out, F.col(f"__near.{out}"))
        self.df = df.drop("__row", "__near")
        return self

    def previous(self, **columns: str | Column) -> OrderedScan:
        """LAG by one row within the key."""
        return self._neighbour(columns, forward=False)

    def following(self, **columns: str | Column) -> OrderedScan:
        """LEAD by one row within the key."""
        return self._neighbour(columns, forward=True)

    def running_sum(self, **columns: str | Column) -> OrderedScan:
        """Inclusive cumulative sums within the key."""
        window = self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        exprs = {out: c if isinstance(c, Column) else F.col(c) for out, c in columns.items()}
        df = self.df.withColumns({out: F.sum(expr).over(window) for out, expr in exprs.items()})
        if self.is_split:
            digest = self.digest(*[F.sum(expr).alias(f"__t_{out}") for out, expr in exprs.items()])
            digest = digest.withColumns(
                {f"__c_{out}": F.sum(f"__t_{out}").over(self.between_segments()) for out in exprs}
            )
            df = self.attach(df, digest.drop(*[f"__t_{out}" for out in exprs]))
            totals = {}
            for out in exprs:
                carry = F.col(f"__c_{out}")
                totals[out] = F.coalesce(F.col(out) + carry, F.col(out), carry)
            df = df.withColumns(totals).drop(*[f"__c_{out}" for out in exprs])
        self.df = df
        return self

    def row_number(self, out: str) -> OrderedScan:
        self.running_sum(**{out: F.lit(1).cast("bigint")})
        return self


def cut_prefix_sums(df: DataFrame, keys: Sequence[str], time: str, sums: dict[str, str], cut_us: int) -> DataFrame:
    """Inclusive running sums of whole numbers within the keys, by a time that is unique per key.

    Two levels: sums within cuts of the time line, and the sums of the cuts before. What a row belongs to
    follows from its own time, so nothing is sampled, searched or written, and the rows are exchanged and
    sorted once. The cuts of a key are summed by themselves, a row for each.
    """
    cut = "__cut"
    placed = df.withColumn(cut, F.floor(F.col(time) / F.lit(cut_us)).cast("bigint"))
    own = Window.partitionBy(*keys, cut).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.withColumns({out: F.sum(column).over(own) for out, column in sums.items()})
    totals = placed.groupBy(*keys, cut).agg(*[F.sum(column).alias(f"__t_{out}") for out, column in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"__d_{k}") for k in [*keys, cut]], *[F.coalesce(F.sum(f"__t_{out}").over(earlier), F.lit(0)).alias(f"__c_{out}") for out in sums]
    )
    same = F.col(cut) == F.col(f"__d_{cut}")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"__d_{key}"))
    joined = rows.join(carried, same).withColumns({out: F.col(out) + F.col(f"__c_{out}") for out in sums})
    return joined.drop(cut, *[f"__d_{k}" for k in [*keys, cut]], *[f"__c_{out}" for out in sums])


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    size: int,
    aggregates: dict[str, Column],
    block_rows: int = 100_000,
) -> DataFrame:
    """Aggregates over the last ``size`` rows of each key, given a dense 1-based ``position``.

    Positions are cut into blocks; the last ``size - 1`` rows of a block are repeated as a lead-in
    of the next one, so a window never spans more than one block of a key.
    """
    zero_based = F.col(position).cast("bigint") - 1
    block = F.floor(zero_based / block_rows).cast("bigint")
    lead_in = (zero_based % block_rows) >= block_rows - (size - 1)
    rows = df.withColumn("__home", block).withColumn(
        "__block",
        F.explode(F.when(lead_in, F.array(block, block + 1)).otherwise(F.array(block))),
    )
    window = (
        Window.partitionBy(*keys, "__block").orderBy(position).rowsBetween(-(size - 1), Window.currentRow)
    )
    for out, aggregate in aggregates.items():
        rows = rows.withColumn(out, aggregate.over(window))
    return rows.filter(F.col("__home") == F.col("__block")).drop("__home", "__block")
