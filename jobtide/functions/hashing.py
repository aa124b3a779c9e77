"""Random-looking numbers that depend on row content only, never on partitioning or on the engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of a checksum that make a draw.
_DIGITS = 10


def draw(seed: int, *parts: Column) -> Column:
    """A whole number below ``16 ** 10`` from the checksum of ``seed-part-part``; a missing part is empty."""
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), *texts)), 1, _DIGITS), 16, 10).cast("bigint")


def uniform(seed: int, *parts: Column) -> Column:
    """A value strictly between 0 and 1."""
    return (draw(seed, *parts) + 0.5) / float(16**_DIGITS)


def normal(seed: int, *parts: Column) -> Column:
    """Standard normal by the Box-Muller transform of two uniforms."""
    radius = F.sqrt(-2.0 * F.log(uniform(seed, *parts)))
    return radius * F.cos(2.0 * math.pi * uniform(seed + 1, *parts))
