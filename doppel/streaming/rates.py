"""Windowed counts and audit totals on a stream of events.

An event more than `delay` older than the newest one seen is dropped; a window
is emitted once the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.functions.columns import col
from doppel.functions.normal import round_even


def _timed(events: DataFrame, ts: str, delay: str) -> DataFrame:
    return events.withColumn("_ts", col(ts).cast("timestamp")).withWatermark("_ts", delay)


def stream_request_rate(events: DataFrame, key: str, ts: str, window: str = "60 seconds", slide: str = "10 seconds",
                        delay: str = "10 seconds", max_requests: int = 60) -> DataFrame:
    """window_start, window_end, key, used, remaining."""
    counted = _timed(events, ts, delay).groupBy(F.window("_ts", window, slide).alias("_w"), col(key).alias(key)).agg(
        F.count(F.lit(1)).alias("used"))
    return counted.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), col(key), "used",
                          F.greatest(F.lit(0), F.lit(max_requests) - F.col("used")).cast("bigint").alias("remaining"))


def stream_audit_stats(log: DataFrame, ts: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Audit totals per window of a log with row_count, execution_time_ms and privacy_noise."""
    totals = _timed(log, ts, delay).groupBy(F.window("_ts", window).alias("_w")).agg(
        F.count(F.lit(1)).alias("total_events"), F.sum("row_count").alias("total_rows_generated"),
        F.avg("execution_time_ms").alias("ms"), F.avg(F.when(F.col("privacy_noise"), 1.0).otherwise(0.0)).alias("noise"))
    return totals.select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "total_events",
        F.col("total_rows_generated").cast("bigint").alias("total_rows_generated"),
        round_even(F.col("ms"), 2).alias("avg_execution_time_ms"), round_even(F.col("noise") * 100, 1).alias("privacy_noise_usage_pct"))
