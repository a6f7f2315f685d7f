"""Outcomes of both sides on streams: matched, then counted in sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltide.operators import metrics
from sqltide.streaming.flow import LATENESS


def matched_outcomes(source: DataFrame, target: DataFrame, within: str = "1 hour",
                     lateness: str = LATENESS) -> DataFrame:
    """Source events with their outcome on the target, by (conn_key, event_seq).

    An outcome counts if it comes at the event's ``ts`` or up to ``within`` later. An event
    without one comes out with ``presence`` lost once the watermark is past that time; both
    sides' state is freed then. Each of an event's attempts gives a row. Null keys match nothing,
    so such events are lost; rows without ``ts`` have no place in time and are left out.
    """
    left = source.where("ts IS NOT NULL").withWatermark("ts", lateness).select(
        F.col("conn_key"), F.col("event_seq"), F.col("ts"),
        F.col("exec_ms").alias("source_exec_ms"), F.col("error").alias("source_error"))
    right = target.where("ts IS NOT NULL").withWatermark("ts", lateness).select(
        F.col("conn_key").alias("t_conn"), F.col("event_seq").alias("t_seq"),
        F.col("ts").alias("t_ts"), F.col("exec_ms").alias("target_exec_ms"),
        F.col("error").alias("target_error"))
    joined = left.join(right, F.expr(
        "conn_key = t_conn AND event_seq = t_seq AND t_ts >= ts "
        f"AND t_ts <= ts + INTERVAL {within}"), "left_outer")
    presence = F.when(F.col("t_ts").isNull(), "lost").otherwise("both")
    return joined.withColumn("presence", presence).drop("t_conn", "t_seq", "t_ts")


def rolling_outcomes(matched: DataFrame, window: str = "1 minute", slide: str | None = None,
                     limit: float = metrics.ERROR_RATE_LIMIT,
                     slow_threshold: float = 2.0) -> DataFrame:
    """Error rate, lost and slow events and statements a second of both sides, per window.

    Windows are those of the source's time. ``error_rate`` is the share of failed among executed
    ones (0 without any). ``target_qps`` counts what the target executed.
    """
    rows = metrics.compare_results(matched, slow_threshold)
    both = F.col("presence") == "both"
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = rows.groupBy(span.alias("w")).agg(
        F.count(F.lit(1)).alias("source_n"), F.count_if(both).alias("attempts"),
        F.count_if(both & F.col("target_error").isNotNull()).alias("errors"),
        F.count_if(~both).alias("lost"),
        F.count_if(both & (F.col("diff_type") == "ERROR")).alias("diff_errors"),
        F.count_if(both & (F.col("diff_type") == "SLOW")).alias("diff_slow"))
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    rate = F.when(F.col("attempts") > 0, F.col("errors") / F.col("attempts")).otherwise(0.0)
    return counted.select(
        F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "attempts", "errors",
        rate.alias("error_rate"), (rate > limit).alias("alert"), "lost", "diff_errors",
        "diff_slow", (F.col("source_n") / seconds).alias("source_qps"),
        (F.col("attempts") / seconds).alias("target_qps"))
