"""Replay plan: lanes, order, pace, rate, dialect, error policy, backlog and control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltide.functions.sqltext import is_transaction_control
from sqltide.operators import scan

LANE_MODES = ("bounded", "faithful", "serial")
POLICIES = ("skip", "retry", "abort")
OVERFLOW = ("drop_oldest", "drop_newest", "block")
RETRIES = 3
MAX_DELAY_NS = 30_000_000_000
SECOND = 1_000_000


def _one_of(value: str, allowed, default: str) -> str:
    name = (value or "").strip().lower() or default
    if name not in allowed:
        raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
    return name


def assign_lane(events: DataFrame, mode: str = "bounded") -> DataFrame:
    """Lane of each event: its connection, or one lane for all in serial mode."""
    serial = _one_of(mode, LANE_MODES, "bounded") == "serial"
    return events.withColumn("lane", F.lit("__serial__") if serial else F.col("conn_key"))


def lane_order(events: DataFrame, hot_rows: int = scan.HOT_ROWS,
               width: int = scan.RANGE_WIDTHS[0]) -> DataFrame:
    """Captured order inside each lane as ``lane_seq`` from 1."""
    return scan.running_by(
        events, ["lane"], "pos", {"lane_seq": scan.count_if(F.lit(True), inclusive=True)},
        hot_rows, width)


def laid_out(planned: DataFrame, files: int | None = None) -> DataFrame:
    """Rows of a lane next to each other and in order.

    Range partitioning lets a very long lane continue in the next partition.
    """
    keys = ["lane", "lane_seq"]
    ranged = planned.repartitionByRange(files, *keys) if files \
        else planned.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def pace(events: DataFrame, speed_factor: float = 1.0,
         widths=scan.RANGE_WIDTHS) -> DataFrame:
    """Delay before each event, from the gap to the previous event over all lanes.

    The gap is divided by ``speed_factor`` and capped at 30 s; a factor of 0 or less and
    gaps that are not positive give no delay. ``due_ns`` is the sum of delays so far.
    """
    if speed_factor <= 0:
        return events.withColumns({
            "delay_ns": F.lit(0).cast("long"), "due_ns": F.lit(0).cast("long")})
    rows = scan.running_all(events, "pos", {"__prev": scan.latest(F.col("ts"))}, widths,
                            keep_part=True)
    gap = (F.unix_micros("ts") - F.unix_micros("__prev")) * 1000
    delay = F.when(gap > 0, F.least(
        F.floor(gap / F.lit(float(speed_factor))), F.lit(MAX_DELAY_NS))).otherwise(0)
    rows = rows.withColumn("delay_ns", F.coalesce(delay, F.lit(0)).cast("long")).drop("__prev")
    return scan.running_all(
        rows, "pos", {"due_ns": scan.total(F.col("delay_ns"), inclusive=True)}, widths)


def rate_limit(events: DataFrame, qps: float, arrival: str = "due_ns",
               widths=scan.RANGE_WIDTHS) -> DataFrame:
    """Earliest send time under a token bucket of ``qps`` and burst 1, as ``slot_ns``.

    slot(i) = i/q + max over j <= i of (arrival(j) - j/q), so the queue is one running
    maximum. ``qps`` of 0 or less does not limit.
    """
    if qps <= 0:
        return events.withColumn("slot_ns", F.col(arrival).cast("double"))
    step = F.lit(1e9 / qps)
    rows = scan.running_all(
        events, "pos", {"__i": scan.count_if(F.lit(True))}, widths, keep_part=True,
    ).withColumn("__i", F.coalesce("__i", F.lit(0)))
    rows = scan.running_all(
        rows, "pos",
        {"__ahead": scan.highest(F.col(arrival) - F.col("__i") * step, inclusive=True)}, widths)
    return rows.withColumn("slot_ns", F.col("__i") * step + F.col("__ahead")) \
        .select(*events.columns, "slot_ns")


def apply_dialect(events: DataFrame, dialect: str = "postgresql",
                  sql: str = "sql") -> DataFrame:
    """Add ``send``: greenplum drops transaction control, other dialects send everything."""
    if (dialect or "").strip().lower() == "greenplum":
        return events.withColumn("send", ~is_transaction_control(F.col(sql)))
    return events.withColumn("send", F.lit(True))


def resolve_error_policy(attempts: DataFrame, policy: str = "skip",
                         retries: int = RETRIES) -> DataFrame:
    """Final outcome per event from its attempts (conn_key, event_seq, pos, attempt,
    target_error).

    ``outcome`` is ok, skipped, aborted or not_run; ``used`` counts attempts that the
    policy would have made; ``rollback`` tells that a ROLLBACK follows the event.
    """
    policy = _one_of(policy, POLICIES, "skip")
    allowed = 1 + retries if policy == "retry" else 1
    in_reach = F.col("attempt") <= allowed
    events = attempts.groupBy("conn_key", "event_seq").agg(
        F.min("pos").alias("pos"),
        F.min(F.when(in_reach & F.col("target_error").isNull(), F.col("attempt"))).alias("__ok"),
        F.count_if(in_reach).alias("__tried"))
    ok = F.col("__ok").isNotNull()
    used = F.coalesce(F.col("__ok").cast("long"), F.col("__tried"))
    if policy != "abort":
        return events.select(
            "conn_key", "event_seq", "pos",
            F.when(ok, "ok").otherwise("skipped").alias("outcome"),
            used.alias("used"), (~ok).alias("rollback"))
    stop = events.where(~ok).agg(F.min("pos").alias("__stop"))
    outcome = F.when(F.col("pos") > F.col("__stop"), "not_run").when(ok, "ok") \
        .otherwise("aborted")
    return events.crossJoin(F.broadcast(stop)).select(      # one row
        "conn_key", "event_seq", "pos", outcome.alias("outcome"),
        F.when(outcome == "not_run", F.lit(0)).otherwise(used).cast("long").alias("used"),
        F.lit(False).alias("rollback"))


def with_rollbacks(outcomes: DataFrame) -> DataFrame:
    """Statements as they reach the target: each event, and a ROLLBACK where one follows."""
    steps = F.when(F.col("rollback"), F.array(F.lit("event"), F.lit("rollback"))) \
        .otherwise(F.array(F.lit("event")))
    return outcomes.where(F.col("outcome") != "not_run") \
        .select("conn_key", "event_seq", "pos", F.posexplode(steps).alias("step", "sent"))


def bounded_backlog(events: DataFrame, capacity: int, policy: str = "drop_oldest",
                    width: int = 1 << 20) -> DataFrame:
    """What a queue of ``capacity`` without a consumer holds at the end."""
    policy = _one_of(policy, OVERFLOW, "drop_oldest")
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    if policy == "block":
        return events
    ends = scan.last_rows if policy == "drop_oldest" else scan.first_rows
    return ends(events, "pos", capacity, width=width)


def overflow_total(events: DataFrame, capacity: int, policy: str = "drop_oldest") -> DataFrame:
    """Number of events that ``bounded_backlog`` discards."""
    dropped = F.lit(0) if _one_of(policy, OVERFLOW, "drop_oldest") == "block" \
        else F.greatest(F.count(F.lit(1)) - capacity, F.lit(0))
    return events.agg(dropped.cast("long").alias("overflow_total"))


def queue_depth(flow: DataFrame, widths=scan.RANGE_WIDTHS) -> DataFrame:
    """Depth after each row of a flow (pos, kind produced or consumed), never below 0."""
    change = F.when(F.col("kind") == "produced", 1).when(F.col("kind") == "consumed", -1) \
        .otherwise(0).cast("long")
    rows = scan.running_all(flow, "pos", {"depth": scan.total(change, inclusive=True)}, widths)
    return rows.withColumn("depth", F.greatest("depth", F.lit(0)))


def replay_lag(events: DataFrame, processed: Column | None = None) -> DataFrame:
    """Seconds between capture and processing; rows without a capture time are left out."""
    now = F.current_timestamp() if processed is None else processed
    lag = (F.unix_micros(now) - F.unix_micros("ts")) / 1e6
    return events.where(F.col("ts").isNotNull()).withColumn("lag_s", lag)


def active_only(events: DataFrame, signals: DataFrame, width: int = SECOND) -> DataFrame:
    """Events captured while the latest control signal (ts, state) is active.

    The state before the first signal is active. As-of by union and one running value, so
    neither side is broadcast or joined by range. ``width`` is the span of one task's
    range in microseconds.
    """
    order = "__at"
    marks = signals.select(F.unix_micros("ts").alias(order), F.lit(0).alias("__kind"),
                           F.lower("state").alias("__state"))
    rows = events.select(F.unix_micros("ts").alias(order), F.lit(1).alias("__kind"),
                         F.lit(None).cast("string").alias("__state"), F.struct("*").alias("__row"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    both = scan.running_all(
        both, order, {"__active": scan.latest(F.col("__state"))}, (width, 1 << 12),
        ties=["__kind"])
    return both.where((F.col("__kind") == 1) & (F.coalesce("__active", F.lit("active")) == "active")) \
        .select("__row.*")


def control_edges(signals: DataFrame, widths=(86_400 * SECOND, 1 << 12)) -> DataFrame:
    """Signals that change the state; repeated ones are left out."""
    rows = scan.running_all(
        signals.withColumn("__at", F.unix_micros("ts")), "__at",
        {"before": scan.latest(F.lower("state"))}, widths)
    before = F.coalesce("before", F.lit("active"))
    return rows.where(F.lower("state") != before).select(
        "ts", before.alias("before"), F.lower("state").alias("after"))


def detect_failover(resolutions: DataFrame, hot_rows: int = scan.HOT_ROWS,
                    width: int = 86_400 * SECOND) -> DataFrame:
    """Moments when a host's address (host, ts, ip) changed to another non-empty one."""
    ip = F.coalesce("ip", F.lit(""))
    rows = scan.running_by(
        resolutions.withColumn("__at", F.unix_micros("ts")), ["host"], "__at",
        {"old_ip": scan.latest(F.when(ip != "", ip)), "__n": scan.count_if(F.lit(True))},
        hot_rows, width)
    old = F.coalesce("old_ip", F.lit(""))
    return rows.where((F.col("__n") > 0) & (ip != "") & (ip != old)).select(
        "host", "ts", old.alias("old_ip"), ip.alias("new_ip"))
