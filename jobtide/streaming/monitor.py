"""Monitor samples and out-of-memory rates over event-time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.dims import MONITOR_SECONDS
from jobtide.functions.status import oom_event
from jobtide.operators.monitor import newest, threshold_alerts


def _timed(rows: DataFrame, time_us: str, watermark: str | None) -> DataFrame:
    """Without a watermark no row is late and no window leaves the state.

    An endless stream needs one: it bounds the state, and rows older than it are dropped.
    """
    timed = rows.withColumn("ts", F.timestamp_micros(time_us))
    return timed.withWatermark("ts", watermark) if watermark else timed


def _window_us(window: str):
    return F.unix_micros(F.col(f"{window}.start")).alias("window_start_us")


def monitor_stream(
    samples: DataFrame,
    by: Sequence[str],
    gauges: Sequence[str],
    order: Sequence[str] = ("ts_us",),
    seconds: int = MONITOR_SECONDS,
    watermark: str | None = None,
) -> DataFrame:
    """The last sample of each window. Batches give the same rows as streams in update mode."""
    timed = _timed(samples, "ts_us", watermark)
    last = [newest(gauge, order).alias(gauge) for gauge in gauges]
    grouped = timed.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), *by).agg(*last)
    return grouped.select(_window_us("w"), *by, *gauges)


ALERT_GAUGES = ["oom_incidents", "jobs_pending"]


def window_alerts(windows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Alerts on the last sample of each window, from the newest state of the windows."""
    return threshold_alerts(windows, ["window_start_us", *by])


def oom_slides(events: DataFrame, slide: str = "1 minute", watermark: str | None = None) -> DataFrame:
    """Events and out-of-memory events per slide; each event counts once."""
    slides = _timed(events, "event_us", watermark).groupBy(F.window("ts", slide).alias("s"))
    counted = slides.agg(F.count_if(oom_event(F.col("reason"), F.col("message"))).alias("oom"), F.count("*").alias("total"))
    return counted.select(F.unix_micros(F.col("s.start")).alias("slide_us"), "oom", "total")


def oom_rates(slides: DataFrame, length: str = "1 hour", slide: str = "1 minute") -> DataFrame:
    """Share of out-of-memory events in a sliding window, from the counts of its slides."""
    timed = slides.withColumn("ts", F.timestamp_micros("slide_us"))
    rates = timed.groupBy(F.window("ts", length, slide).alias("w")).agg(
        F.sum("oom").alias("oom_events"), F.sum("total").alias("total_events")
    )
    rate = F.col("oom_events") / F.greatest("total_events", F.lit(1))
    return rates.select(_window_us("w"), "oom_events", "total_events", rate.alias("oom_rate"))


def oom_rate_stream(events: DataFrame, delay: str, length: str = "1 hour", slide: str = "1 minute") -> DataFrame:
    """The rate of :func:`oom_rates` as one stream of two aggregations under one watermark.

    Each slide is counted once; when the watermark closes it, its time feeds the windows that hold it, and a
    window comes out, for good, when it is closed itself. Events further than ``delay`` behind the newest are
    dropped. Rows without a reason move the clock and count nowhere, so that polls close windows in quiet times.
    """
    timed = _timed(events, "event_us", delay)
    real = F.col("reason").isNotNull()
    slides = timed.groupBy(F.window("ts", slide).alias("s")).agg(
        F.count_if(real & oom_event(F.col("reason"), F.col("message"))).alias("oom"), F.count_if(real).alias("total")
    )
    rates = slides.filter("total > 0").groupBy(F.window(F.window_time("s"), length, slide).alias("w")).agg(
        F.sum("oom").alias("oom_events"), F.sum("total").alias("total_events")
    )
    rate = F.col("oom_events") / F.col("total_events")
    return rates.select(_window_us("w"), "oom_events", "total_events", rate.alias("oom_rate"))


def burst_stream(arrivals: DataFrame, gap: str, by: Sequence[str] = (), time_us: str = "submission_us", watermark: str | None = None) -> DataFrame:
    """Sessions of arrivals as a stream; late arrivals join the sessions they touch.

    With a watermark closed sessions come out in append mode and leave the state; without one the whole
    table of sessions is kept, for complete mode.
    """
    timed = _timed(arrivals.filter(F.col(time_us).isNotNull()), time_us, watermark)
    window = F.session_window("ts", gap).alias("w")
    keys = list(by) or [F.pmod(F.col(time_us), F.lit(1)).alias("all")]  # streams of sessions need a key
    rows = timed.groupBy(window, *keys).agg(F.min(time_us).alias("first_us"), F.max(time_us).alias("last_us"), F.count("*").alias("arrivals"))
    return rows.select(*by, "first_us", "last_us", "arrivals")
