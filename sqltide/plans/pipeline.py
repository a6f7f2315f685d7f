"""Whole pipelines, from captured messages to replay plan and metrics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltide.operators import decide, guard, metrics, replay, scan, sessions
from sqltide.operators.decide import FilterOptions
from sqltide.operators.guard import GuardOptions
from sqltide.operators.sessions import SessionOptions
from sqltide.streaming import flow
from sqltide.streaming.sessionize import stream_sessionize


@dataclass(frozen=True)
class ReplayOptions:
    guard: GuardOptions = field(default_factory=GuardOptions)
    lane_mode: str = "bounded"
    speed_factor: float = 1.0
    rate_limit_qps: float = 0.0
    dialect: str = "postgresql"


def capture_to_decisions(messages: DataFrame, session: SessionOptions = SessionOptions(),
                         rules: FilterOptions = FilterOptions()) -> DataFrame:
    """Messages to events with class, state and decision."""
    return decide.decide(sessions.sql_events(messages, session), rules)


def stream_replay(messages: DataFrame, path: str, checkpoint: str,
                  session: SessionOptions = SessionOptions(),
                  rules: FilterOptions = FilterOptions(),
                  opts: ReplayOptions = ReplayOptions(), trigger: dict | None = None):
    """A message stream to delivered, guarded events in lane order; returns the query."""
    events = stream_sessionize(messages, session).where(F.col("kind") == "event")
    guarded = flow.stream_classify_guard(events, rules, opts.guard).where(
        (F.col("action") == "keep") & (F.col("guard") != "block"))
    return flow.deliver_plan(guarded, path, checkpoint, opts.lane_mode, opts.dialect, trigger)


def plan_replay(events: DataFrame, opts: ReplayOptions = ReplayOptions()) -> DataFrame:
    """Guard, pace, limit, and shape kept events into an ordered plan.

    Blocked events leave before they use time or tokens. The guarded events are written
    once, as pacing and rate limit read their positions and times more than once.
    """
    guarded = guard.apply_guard(events, opts.guard)
    allowed = scan.cut(guarded.where(F.col("guard") != "block"))
    timed = replay.pace(allowed.select("pos", "ts"), opts.speed_factor)
    if opts.rate_limit_qps > 0:
        timed = replay.rate_limit(scan.cut(timed), opts.rate_limit_qps)
    else:
        timed = timed.withColumn("slot_ns", F.col("due_ns").cast("double"))
    planned = allowed.join(timed.drop("ts"), "pos")
    planned = replay.apply_dialect(
        replay.assign_lane(planned, opts.lane_mode), opts.dialect, "sql_out")
    return replay.lane_order(planned)


def metric_catalog(decided: DataFrame, attempts: DataFrame, times: DataFrame,
                   prefix: str = "sqltide") -> DataFrame:
    """Counters, gauges and histograms as (name, labels, value) rows."""
    counts = metrics.metric_rows(
        decide.classified_counts(decided), {f"{prefix}_classified_total": "n"},
        {"class": "stmt_class", "kept": "kept"})
    outcome = metrics.error_rate(attempts).withColumn("alert", F.col("alert").cast("double"))
    outcomes = metrics.metric_rows(outcome, {
        f"{prefix}_replay_total": "attempts", f"{prefix}_replay_errors_total": "errors",
        f"{prefix}_replay_error_rate": "error_rate", f"{prefix}_alert_replay_error_rate": "alert"})
    buckets = metrics.metric_rows(
        metrics.exec_histogram(times), {f"{prefix}_exec_time_seconds_bucket": "n"},
        {"side": "side", "le": "le"})
    p99 = metrics.p99_nearest_rank(times).withColumn(
        "alert", ((F.col("source_p99") > 0) & (
            F.col("target_p99") > metrics.P99_RATIO_LIMIT * F.col("source_p99"))).cast("double"))
    ranks = metrics.metric_rows(p99, {
        f"{prefix}_source_exec_p99_seconds": "source_p99",
        f"{prefix}_target_exec_p99_seconds": "target_p99",
        f"{prefix}_alert_target_p99": "alert"})
    return metrics.union_all([counts, outcomes, buckets, ranks])


def health_catalog(loss: DataFrame | None = None, parse_errors: DataFrame | None = None,
                   depth: DataFrame | None = None, lag: DataFrame | None = None,
                   speed: DataFrame | None = None, times: DataFrame | None = None,
                   prefix: str = "sqltide") -> DataFrame:
    """Capture, backlog, lag and throughput as (name, labels, value) rows of what is given.

    Takes the rows of ``capture_loss``, ``parse_error_counts``, ``queue_depth``, ``replay_lag``,
    ``throughput`` and ``exec_times``. Counters are totals, gauges the latest value in order of
    ``pos`` or ``ts`` (0 without rows). Times are summed as decimals, so the sum is the same in any order.
    """
    def firing(value, limit):
        return (F.col(value) > limit).cast("double")

    def gauge(rows, value, order, name, alert, limit):
        last = rows.agg(F.coalesce(F.max_by(value, order), F.lit(0)).alias(value))
        return metrics.metric_rows(last.withColumn("alert", firing(value, limit)), {
            f"{prefix}_{name}": value, f"{prefix}_alert_{alert}": "alert"})

    frames = []
    if loss is not None:
        totals = loss.agg(*[F.coalesce(F.sum(f"{c}_delta"), F.lit(0)).alias(c)
                            for c in ("received", "dropped")])
        frames += [metrics.metric_rows(totals, {f"{prefix}_packets_{c}_total": c
                                                for c in ("received", "dropped")}),
                   gauge(loss, "drop_rate", "ts", "packet_drop_rate", "packet_drop_rate",
                         metrics.DROP_RATE_LIMIT)]
    if parse_errors is not None:
        frames.append(metrics.metric_rows(
            parse_errors, {f"{prefix}_parse_errors_total": "parse_errors"}))
    if depth is not None:
        frames.append(gauge(depth, "depth", "pos", "queue_depth", "queue_depth", metrics.DEPTH_LIMIT))
    if lag is not None:
        frames.append(gauge(lag, "lag_s", "pos", "replay_lag_seconds", "replay_lag",
                            metrics.LAG_LIMIT_S))
    if speed is not None:
        sides = ("source", "target")
        last = speed.agg(*[F.coalesce(F.max_by("qps", F.when(F.col("side") == side, F.col("ts"))),
                                      F.lit(0)).alias(side) for side in sides])
        frames.append(metrics.metric_rows(last, {f"{prefix}_{side}_qps": side for side in sides}))
    if times is not None:
        sums = times.where(F.col("seconds") > 0).groupBy("side").agg(
            F.sum(F.col("seconds").cast("decimal(28,9)")).alias("sum"),
            F.count(F.lit(1)).alias("count"))
        frames.append(metrics.metric_rows(sums, {
            f"{prefix}_exec_time_seconds_{c}": c for c in ("sum", "count")}, {"side": "side"}))
    if not frames:
        raise ValueError("nothing to report")
    return metrics.union_all(frames)
