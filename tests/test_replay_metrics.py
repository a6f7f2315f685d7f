import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sqltide.operators import metrics, replay
from sqltide.operators.guard import GuardOptions
from sqltide.plans import pipeline

T0 = dt.datetime(2026, 1, 1)


def at(us):
    return T0 + dt.timedelta(microseconds=us)


def timed(spark, micros):
    return spark.createDataFrame([(i, at(u), f"c{i % 3}") for i, u in enumerate(micros)],
                                 "pos long, ts timestamp, conn_key string").repartition(3)


@pytest.mark.parametrize("factor", [1.0, 2.0, 0.5, 3.0, 0.0, -1.0])
def test_pace(spark, factor):
    rng = random.Random(1)
    micros, now = [], 0
    for _ in range(120):
        now += rng.choice([0, -5, 100_000, 7, 40_000_000])
        micros.append(now)
    prev, due, want = None, 0, []
    for u in micros:
        gap = 0 if prev is None else (u - prev) * 1000
        delay = min(int(gap / factor), 30_000_000_000) if factor > 0 and gap > 0 else 0
        prev, due = u, due + delay
        want.append((delay, due))
    got = replay.pace(timed(spark, micros), factor, widths=(16, 4)).orderBy("pos").collect()
    assert [(r.delay_ns, r.due_ns) for r in got] == want


def test_rate_limit_is_a_token_bucket_of_one(spark):
    rng = random.Random(2)
    arrivals, now = [], 0
    for _ in range(150):
        now += rng.choice([0, 0, 1_000_000, 300_000_000])
        arrivals.append(now)
    step, free, want = 1e9 / 8, 0.0, []
    for a in arrivals:
        slot = max(a, free)
        want.append(slot)
        free = slot + step
    df = spark.createDataFrame(list(enumerate(arrivals)), "pos long, due_ns long")
    got = replay.rate_limit(df, 8, widths=(16, 4)).orderBy("pos").collect()
    assert [r.slot_ns for r in got] == pytest.approx(want)
    assert [r.slot_ns for r in replay.rate_limit(df, 0).orderBy("pos").collect()] == arrivals


@pytest.mark.parametrize("mode", replay.LANE_MODES)
def test_lanes_keep_captured_order(spark, mode):
    df = replay.assign_lane(timed(spark, range(90)), mode)
    rows = replay.lane_order(df, hot_rows=10, width=16).collect()
    lanes = {}
    for r in sorted(rows, key=lambda r: r.pos):
        lanes[r.lane] = lanes.get(r.lane, 0) + 1
        assert r.lane_seq == lanes[r.lane]
    assert len(lanes) == (1 if mode == "serial" else 3)
    out = replay.laid_out(replay.lane_order(df), 4)
    parts = out.withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()) \
        .orderBy("i").collect()
    assert [(r.lane, r.lane_seq) for r in parts] == sorted((r.lane, r.lane_seq) for r in parts)
    with pytest.raises(ValueError):
        replay.assign_lane(df, "parallel")


def test_dialect(spark):
    df = spark.createDataFrame([(0, "BEGIN"), (1, "INSERT"), (2, "rollback to s")], "pos int, sql string")

    def sent(d):
        return [r.send for r in replay.apply_dialect(df, d).orderBy("pos").collect()]

    assert sent("GreenPlum ") == [False, True, False] and all(sent("postgresql")) and all(sent(""))


def test_error_policies(spark):
    tries = {1: [None], 2: ["e", None, "e"], 3: ["e"] * 6, 4: [None], 5: ["e", "e", "e", None]}
    df = spark.createDataFrame(
        [("c", e, e, i + 1, err) for e, errs in tries.items() for i, err in enumerate(errs)],
        "conn_key string, event_seq long, pos long, attempt int, target_error string")

    def run(policy):
        rows = replay.resolve_error_policy(df, policy).orderBy("pos").collect()
        return [(r.outcome, r.used, r.rollback) for r in rows]

    ok = ("ok", 1, False)
    assert run("skip") == [ok, ("skipped", 1, True), ("skipped", 1, True), ok, ("skipped", 1, True)]
    assert run("retry") == [ok, ("ok", 2, False), ("skipped", 4, True), ok, ("ok", 4, False)]
    assert run("abort") == [ok, ("aborted", 1, False)] + [("not_run", 0, False)] * 3
    sent = replay.with_rollbacks(replay.resolve_error_policy(df, "retry")).orderBy("pos", "step")
    assert [r.sent for r in sent.collect()] == ["event", "event", "event", "rollback", "event", "event"]
    assert replay.with_rollbacks(replay.resolve_error_policy(df, "abort")).count() == 2


def test_backlog_accounts_for_every_event(spark):
    df = spark.range(100).select(F.col("id").alias("pos"))
    for capacity in (1, 7, 99, 100, 500):
        for policy, want in (("drop_oldest", list(range(100))[-capacity:]),
                             ("drop_newest", list(range(100))[:capacity]), ("block", list(range(100)))):
            held = sorted(r.pos for r in replay.bounded_backlog(df, capacity, policy, width=16).collect())
            lost = replay.overflow_total(df, capacity, policy).first().overflow_total
            assert held == want and held and len(held) + lost == 100
        if capacity > 7:
            continue
    with pytest.raises(ValueError):
        replay.bounded_backlog(df, 5, "drop_some")


def test_depth_lag_control_failover(spark):
    flow = spark.createDataFrame(list(enumerate(["produced", "consumed", "consumed", "produced"])),
                                 "pos long, kind string")
    assert [r.depth for r in replay.queue_depth(flow).orderBy("pos").collect()] == [1, 0, 0, 0]
    df = spark.createDataFrame([(0, at(0)), (1, None)], "pos long, ts timestamp")
    lag = replay.replay_lag(df, F.lit("2026-01-01 00:01:00.5").cast("timestamp")).collect()
    assert [r.lag_s for r in lag] == [60.5]

    signals = spark.createDataFrame(
        [(at(10), "paused"), (at(15), "paused"), (at(20), "Active"), (at(30), "paused")],
        "ts timestamp, state string")
    kept = replay.active_only(timed(spark, [0, 9, 10, 19, 20, 29, 31]), signals, width=8)
    assert sorted(r.pos for r in kept.collect()) == [0, 1, 4, 5]
    edges = replay.control_edges(signals).orderBy("ts").collect()
    assert [(r.before, r.after) for r in edges] == [
        ("active", "paused"), ("paused", "active"), ("active", "paused")]

    seen = [("h", at(i), ip) for i, ip in enumerate(["a", "a", "", "b", None, "b", "a"])]
    seen += [("late", at(i), ip) for i, ip in enumerate(["", "x"])]
    moves = replay.detect_failover(
        spark.createDataFrame(seen, "host string, ts timestamp, ip string")).collect()
    assert sorted((r.host, r.old_ip, r.new_ip) for r in moves) == [
        ("h", "a", "b"), ("h", "b", "a"), ("late", "", "x")]


def test_plan_leaves_blocked_events_out_of_the_clock(spark):
    rows = [(0, 0, "INSERT INTO t VALUES (now())"), (1, 1000, "DROP TABLE t"), (2, 3000, "BEGIN"),
            (3, 4000, "SELECT 1")]
    df = spark.createDataFrame([(p, at(u), "c", s) for p, u, s in rows],
                               "pos long, ts timestamp, conn_key string, sql string")
    opts = pipeline.ReplayOptions(
        guard=GuardOptions(exclude_ddl=True, rewrite_time_functions=True), rate_limit_qps=500,
        dialect="greenplum")
    got = pipeline.plan_replay(df, opts).orderBy("pos").collect()
    assert [(r.pos, r.lane_seq, r.delay_ns, r.due_ns) for r in got] == [
        (0, 1, 0, 0), (2, 2, 3_000_000, 3_000_000), (3, 3, 1_000_000, 4_000_000)]
    assert [r.slot_ns for r in got] == [0, 3_000_000, 5_000_000]
    assert [r.send for r in got] == [True, False, True] and "timestamptz" in got[0].sql_out


# --- metrics ---------------------------------------------------------------------------------

def test_nearest_rank_over_recent_samples(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["source", "target"]), rng.choice([0.0, -1.0, rng.random()]))
            for i in range(300)]
    df = spark.createDataFrame(rows, "pos long, side string, seconds double")
    for q, window in ((0.99, 50), (0.5, 7), (0.0, 9), (1.0, 1000)):
        got = metrics.p99_nearest_rank(df, q, window).first()
        for side in ("source", "target"):
            last = sorted([s for _, d, s in rows if d == side and s > 0][-window:])
            assert got[f"{side}_p99"] == last[min(int(q * (len(last) - 1) + 0.5), len(last) - 1)]
    none = metrics.p99_nearest_rank(df.where("seconds > 5")).first()
    assert (none.source_p99, none.target_p99) == (0.0, 0.0)


def test_histogram_bounds_include_their_value(spark):
    df = spark.createDataFrame([(1, "source", 0.001), (2, "source", 0.0011), (3, "source", 99.0),
                                (4, "source", 0.0), (5, "target", -1.0)],
                               "pos long, side string, seconds double")
    got = {(r.side, r.le): r.n for r in metrics.exec_histogram(df).collect()}
    assert got["source", "0.0005"] == 0 and got["source", "0.001"] == 1
    assert got["source", "0.0025"] == 2 and got["source", "10"] == 2 and got["source", "+Inf"] == 3
    assert not any(side == "target" for side, _ in got)


def test_every_alert_is_strict(spark):
    edge = dict(lag_s=60.0, depth=100_000, error_rate=0.01, source_p99=1.0, target_p99=2.0, drop_rate=0.001)
    above = {k: v * 1.01 + (1 if k == "depth" else 0) for k, v in edge.items()} | {"source_p99": 1.0}
    no_source = above | {"source_p99": 0.0}
    cols = list(edge)
    df = spark.createDataFrame([(i, *[float(r[c]) for c in cols])
                                for i, r in enumerate([edge, above, no_source])], ["i", *cols])
    got = [[r[c] for c in r.asDict() if c.startswith("alert")]
           for r in metrics.alerts(df).orderBy("i").collect()]
    assert got == [[0.0] * 5, [1.0] * 5, [1.0, 1.0, 1.0, 0.0, 1.0]]


def test_error_rate_levels(spark):
    rows = [("c", 1, 1, "e"), ("c", 1, 2, None), ("c", 2, 1, None), ("c", 3, 1, "e")]
    df = spark.createDataFrame(rows, "conn_key string, event_seq long, attempt int, target_error string")
    r = metrics.error_rate(df).first()
    assert (r.attempts, r.errors, r.error_rate, r.alert) == (4, 2, 0.5, True)
    final = metrics.error_rate(df, level="final").first()
    assert (final.attempts, final.errors) == (3, 1)
    empty = metrics.error_rate(df.where("attempt > 9")).first()
    assert (empty.error_rate, empty.alert) == (0.0, False)


def test_comparison(spark):
    rows = [(1, 10.0, 25.0, None, None), (2, 10.0, 20.0, None, None), (3, 0.0, 99.0, None, None),
            (4, 5.0, 5.0, None, "boom"), (5, 5.0, 50.0, "x", "boom"), (6, 50.0, 5.0, "x", None)]
    df = spark.createDataFrame(rows, "pos long, source_exec_ms double, target_exec_ms double, "
                                     "source_error string, target_error string")
    got = metrics.compare_results(df, 2.0).orderBy("pos").collect()
    assert [r.diff_type for r in got] == ["SLOW", "NONE", "NONE", "ERROR", "SLOW", "NONE"]
    assert got[0].message == "target 25ms vs source 10ms (2.5x slower)"
    assert got[3].message == "target error: boom"
    wide = metrics.compare_results(df, 2.0, extended=True).orderBy("pos").collect()
    assert wide[5].diff_type == "ERROR"
    stored = metrics.diff_summary(metrics.compare_results(df, 2.0), max_diffs=2).collect()
    assert {r.diff_type: r.n for r in stored} == {"SLOW": 1, "ERROR": 1}
    s = df.select(F.lit("c").alias("conn_key"), F.col("pos").alias("event_seq"), F.lit("q").alias("sql"),
                  F.lit(T0).alias("ts"), F.col("source_exec_ms").alias("exec_ms"),
                  F.col("source_error").alias("error"))
    matched = metrics.match_results(s.where("event_seq < 4"), s.where("event_seq > 2").drop("sql", "ts"))
    assert {r.event_seq: r.presence for r in matched.collect()} == {
        1: "lost", 2: "lost", 3: "both", 4: "extra", 5: "extra", 6: "extra"}


def test_progress_and_staleness(spark):
    rows = [(at(1_000_000), "produced", None), (at(2_000_000), "replayed", 30), (at(3_000_000), "replayed", 20),
            (at(3_500_000), "skipped", None)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, lag_ms long")
    start, now = F.lit(T0), F.lit(at(10_000_000))
    r = metrics.progress(df, start, now, 9, 4).first()
    assert (r.produced, r.replayed, r.skipped, r.failed, r.current_lag_ms, r.kafka_lag) == (1, 2, 1, 0, 20, 5)
    assert (r.produce_rate, r.replay_rate, r.uptime_s) == (0.1, 0.2, 10.0)
    assert metrics.is_stale(df, start, now, 8.9).first().is_stale
    assert not metrics.is_stale(df, start, now, 9.0).first().is_stale
    assert metrics.is_stale(df.where("kind = 'skipped'"), start, now, 9.5).first().is_stale
    assert metrics.is_stale(df.where("false"), start, now, 9.5).first().is_stale is True
    assert metrics.is_stale(df.where("false"), start, now, 10.0).first().is_stale is False


@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_selection_equals_sorting(spark, q, monkeypatch):
    """Ties, values far apart, infinite ones, and few bins; no value reaches a single task."""
    rng = random.Random(8)
    values = {"source": [rng.lognormvariate(0, 4) for _ in range(500)] + [3.0] * 200 + [5e-324, 1e308],
              "target": [1.0 + k * 2.0 ** -50 for k in range(300)] + [float("inf")] * 3}
    rows = [(k, side, v) for side, vs in values.items() for k, v in enumerate([*vs, 0.0, -1.0])]
    df = spark.createDataFrame(rows, "pos long, side string, seconds double")
    want = {f"{s}_p99": sorted(v)[min(int(q * (len(v) - 1) + 0.5), len(v) - 1)]
            for s, v in values.items()}
    assert metrics.p99_nearest_rank(df, q).first().asDict() == want
    monkeypatch.setattr(metrics, "BINS", 3)
    assert metrics.p99_nearest_rank(df, q).first().asDict() == want
