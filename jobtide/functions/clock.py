"""Time arithmetic on microseconds since the epoch. Nothing here reads the wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_MINUTE = 60 * MICROS_PER_SECOND
MICROS_PER_HOUR = 60 * MICROS_PER_MINUTE
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def micros(timestamp: Column) -> Column:
    return F.unix_micros(timestamp.cast("timestamp"))


def minutes_between(start_us: Column, end_us: Column) -> Column:
    """Minutes from start to end, NULL when either is missing."""
    return (end_us - start_us) / float(MICROS_PER_MINUTE)


def wait_minutes(submission_us: Column, start_us: Column) -> Column:
    return minutes_between(submission_us, start_us)


def execution_minutes(start_us: Column, completion_us: Column) -> Column:
    return minutes_between(start_us, completion_us)


def since(time_us: Column, as_of_us: Column, hours: int) -> Column:
    """Strictly after ``as_of - hours``."""
    return time_us > as_of_us - hours * MICROS_PER_HOUR


def retained(time_us: Column, as_of_us: Column, days: int) -> Column:
    return time_us >= as_of_us - days * MICROS_PER_DAY


def hour_of_day(time_us: Column) -> Column:
    """Fractional hour of the day on a UTC clock, or on a clock that starts at zero."""
    return F.pmod(time_us, F.lit(MICROS_PER_DAY)) / float(MICROS_PER_HOUR)


def whole_hour(time_us: Column) -> Column:
    return F.floor(F.pmod(time_us, F.lit(MICROS_PER_DAY)) / MICROS_PER_HOUR).cast("int")
