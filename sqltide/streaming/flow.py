"""Stateless, windowed and delivery parts of the streaming pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltide.operators import decide, guard, replay
from sqltide.operators.decide import FilterOptions
from sqltide.operators.guard import GuardOptions

LATENESS = "30 seconds"


def stream_classify_guard(events: DataFrame, filter_opts: FilterOptions = FilterOptions(),
                          guard_opts: GuardOptions = GuardOptions()) -> DataFrame:
    """Classify, decide and guard row by row.

    ``tx_state`` comes from the sessionizer; without it every event counts as idle. The
    arrival counter needs a total order, so a share is taken by hash on a stream.
    """
    if 0 < guard_opts.replay_percentage < 100 and not guard_opts.stable_sampling:
        raise ValueError("sampling on a stream needs stable_sampling=True")
    if "stmt_class" not in events.columns:
        events = decide.with_class(events, filter_opts.builtin_functions)
    if "tx_state" not in events.columns:
        events = events.withColumn("tx_state", F.lit("idle"))
    return guard.apply_guard(decide.decide(events, filter_opts), guard_opts)


def stream_metrics(decided: DataFrame, window: str = "5 seconds", slide: str | None = None,
                   lateness: str = LATENESS) -> DataFrame:
    """Rolling counts by class and outcome, with errors if ``target_error`` is there."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    errors = F.count("target_error") if "target_error" in decided.columns else F.lit(0)
    return decided.withWatermark("ts", lateness).groupBy(
        span.alias("w"), "stmt_class", "action",
    ).agg(F.count(F.lit(1)).alias("n"), errors.cast("long").alias("errors")).select(
        F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"),
        "stmt_class", "action", "n", "errors")


def stream_sessions(segments: DataFrame, idle: str = "300 seconds",
                    lateness: str = LATENESS) -> DataFrame:
    """Connection lifetimes by silence."""
    return segments.withWatermark("ts", lateness).groupBy(
        "conn_key", F.session_window("ts", idle).alias("s"),
    ).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"),
          F.count(F.lit(1)).alias("segments")).drop("s")


def late_rows(query) -> int:
    """Rows a running query dropped because they were behind the watermark."""
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0))
        for p in query.recentProgress for op in p["stateOperators"])


def deliver_plan(events: DataFrame, path: str, checkpoint: str, lane_mode: str = "bounded",
                 dialect: str = "postgresql", trigger: dict | None = None):
    """Hand events over as ordered files per micro-batch; returns the started query.

    A batch that runs again after a failure overwrites its own folder, so files are
    complete and appear once. Rows of a lane are in order inside and across batches; the
    range layout splits a lane that fills most of a batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        text = "sql_out" if "sql_out" in batch.columns else "sql"
        planned = replay.apply_dialect(replay.assign_lane(batch, lane_mode), dialect, text)
        planned.repartitionByRange("lane", "pos").sortWithinPartitions("lane", "pos") \
            .write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (events.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
