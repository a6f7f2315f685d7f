import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from sqltide import schemas
from sqltide.operators import capture, decide, guard, sessions
from sqltide.operators.decide import FilterOptions
from sqltide.operators.guard import GuardOptions
from sqltide.operators.sessions import SessionOptions
from sqltide.plans import pipeline
from sqltide.sources import tables
from sqltide.streaming import flow, outcomes
from sqltide.streaming.lives import stream_connections
from sqltide.streaming.sessionize import stream_sessionize
from tests.model import random_messages, replay
from tests.test_sessions import frame, params
from sqltide.functions.params import zip_params


def write_parts(df_parts, path):
    for part in df_parts:
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)        # files are taken in order of their time


def run(stream, folder, **options):
    query = (stream.writeStream.format("parquet").option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out"), query


def message_stream(spark, rows, folder, parts=3):
    size = -(-len(rows) // parts)
    write_parts([frame(spark, rows[i:i + size]) for i in range(0, len(rows), size)], f"{folder}/in")
    return tables.read_messages(spark, f"{folder}/in", streaming=True, maxFilesPerTrigger=1)


@pytest.mark.parametrize("pooler", [False, True])
def test_stream_equals_batch(spark, tmp_path, pooler):
    rows = random_messages(21, 500)
    opts = SessionOptions(connection_pooler=pooler, max_copy_bytes=12, max_sql_length=60)
    out, _ = run(stream_sessionize(message_stream(spark, rows, tmp_path), opts), tmp_path)
    batch = sessions.annotate(frame(spark, rows), opts).where("is_event").collect()
    zipped = zip_params(F.col("param_oids"), F.col("param_formats"), F.col("param_values"))
    got = out.where("kind = 'event'").withColumn("params", F.when(F.col("extended"), zipped)).collect()
    assert sorted((r.pos, r.seq, r.tx_pos, r.tx_state, r.stmt_class) for r in got) == sorted(
        (r.pos, r.seq, r.tx_pos, r.tx_state, r.stmt_class) for r in batch)
    events, timings, errors, _ = replay(rows, pooler, 60, 12)
    assert sorted((r.pos, r.sql, params(r.params), r.copy_data and [bytes(c) for c in r.copy_data])
                  for r in got) == [(e[0], e[1], e[6], e[7] or None) if not e[7] == []
                                    else (e[0], e[1], e[6], []) for e in events]
    assert sorted((r.pos, r.seq, r.exec_ns) for r in out.where("kind = 'exec'").collect()) == timings
    assert out.where("kind = 'error'").count() == errors


def test_idle_connections_are_forgotten(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    base = dict.fromkeys(schemas.MESSAGES.fieldNames())

    def say(pos, conn, seconds):
        return base | dict(conn_key=conn, life=0, pos=pos, ts=t0 + dt.timedelta(seconds=seconds),
                           from_client=True, msg_type="Q", sql="SELECT 1")

    rows = [say(1, "a", 0), say(2, "b", 400), say(3, "b", 401), say(4, "a", 500), say(5, "b", 501)]
    stream = message_stream(spark, rows, tmp_path, parts=5)
    out, _ = run(stream_sessionize(stream, idle_seconds=300), tmp_path)
    assert {r.pos: r.seq for r in out.collect()} == {1: 1, 2: 1, 3: 2, 4: 1, 5: 3}


def statements(spark, folder, n=120):
    t0 = dt.datetime(2026, 1, 1)
    texts = ["SELECT now()", "INSERT INTO t VALUES (1)", "DROP TABLE t", "SELECT go(1)", "VACUUM"]
    rows = [(f"c{i % 4}", i, t0 + dt.timedelta(seconds=i), texts[i % 5], "u") for i in range(n)]
    df = spark.createDataFrame(rows, "conn_key string, pos long, ts timestamp, sql string, db_user string")
    write_parts([df.where(f"pos < {n // 2}"), df.where(f"pos >= {n // 2}")], f"{folder}/in")
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_classify_and_guard_need_no_state(spark, tmp_path):
    df, stream = statements(spark, tmp_path)
    opts = GuardOptions(exclude_ddl=True, rewrite_time_functions=True, replay_percentage=60,
                        stable_sampling=True)
    out, _ = run(flow.stream_classify_guard(stream, FilterOptions(mode="all"), opts), tmp_path)
    batch = decide.with_class(df).withColumn("tx_state", F.lit("idle"))
    want = guard.apply_guard(decide.decide(batch, FilterOptions(mode="all")), opts)
    cols = ["pos", "stmt_class", "action", "reason", "guard", "guard_rule", "sql_out"]
    assert sorted(map(str, out.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    with pytest.raises(ValueError):
        flow.stream_classify_guard(stream, guard_opts=GuardOptions(replay_percentage=60))


def test_windows_close_behind_the_watermark(spark, tmp_path):
    _, stream = statements(spark, tmp_path)
    out, query = run(flow.stream_metrics(flow.stream_classify_guard(stream), "5 seconds"), tmp_path)
    rows = out.collect()
    assert sum(r.n for r in rows) == 85 and all(r.n == 1 for r in rows)     # 119 s - 30 s
    assert flow.late_rows(query) == 0


def test_late_rows_are_counted(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    schema = "ts timestamp, stmt_class string, action string"
    parts = [[(t0 + dt.timedelta(seconds=s), "dml", "keep")] for s in (0, 300, 310, 1, 600)]
    write_parts([spark.createDataFrame(p, schema) for p in parts], f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out, query = run(flow.stream_metrics(stream), tmp_path)
    assert sorted((r.from_ts - t0).seconds for r in out.collect()) == [0, 300, 310]
    assert flow.late_rows(query) == 1


def test_sessions_by_silence(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [("a", t0), ("a", t0 + dt.timedelta(seconds=200)), ("a", t0 + dt.timedelta(seconds=900)),
            ("b", t0 + dt.timedelta(seconds=5000))]
    df = spark.createDataFrame(rows, "conn_key string, ts timestamp")
    write_parts([df], f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out, _ = run(flow.stream_sessions(stream), tmp_path)
    assert sorted((r.segments, (r.ended - r.started).seconds) for r in out.collect()) == [(1, 0), (2, 200)]


def test_plan_is_delivered_in_order_and_once(spark, tmp_path):
    df, stream = statements(spark, tmp_path)
    for _ in range(2):          # the second run finds nothing new
        flow.deliver_plan(stream, f"{tmp_path}/plan", f"{tmp_path}/pc", "bounded", "greenplum").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/plan")
    assert got.count() == 120 and got.select("batch").distinct().count() == 2
    for batch in (0, 1):
        rows = spark.read.parquet(f"{tmp_path}/plan/batch={batch}") \
            .withColumn("f", F.input_file_name()).withColumn("i", F.monotonically_increasing_id()) \
            .orderBy("f", "i").collect()
        assert [(r.lane, r.pos) for r in rows] == sorted((r.lane, r.pos) for r in rows)


def test_spool_is_a_cursor(spark, tmp_path):
    df, stream = statements(spark, tmp_path)
    tables.spool_events(stream, f"{tmp_path}/spool", f"{tmp_path}/sc").awaitTermination()
    reader = tables.read_spool(spark, f"{tmp_path}/spool", df.schema)
    out, _ = run(reader, tmp_path / "r1")
    assert out.count() == 120
    df.withColumn("pos", F.col("pos") + 1000).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    tables.spool_events(stream, f"{tmp_path}/spool", f"{tmp_path}/sc").awaitTermination()
    out, _ = run(reader, tmp_path / "r1")
    assert out.count() == 240 and out.select("pos").distinct().count() == 240


def test_messages_to_delivered_plan(spark, tmp_path):
    rows = random_messages(33, 300)
    opts = pipeline.ReplayOptions(guard=GuardOptions(exclude_ddl=True), dialect="greenplum")
    pipeline.stream_replay(message_stream(spark, rows, tmp_path), f"{tmp_path}/plan", f"{tmp_path}/pc",
                           opts=opts).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/plan").collect()
    batch = pipeline.capture_to_decisions(frame(spark, rows))
    want = guard.apply_guard(batch, opts.guard).where("action = 'keep' and guard <> 'block'").collect()
    assert sorted((r.pos, r.sql_out, r.db_user) for r in got) == sorted(
        (r.pos, r.sql_out, r.db_user) for r in want)
    assert {r.sql for r in got if not r.send} == {"BEGIN", "COMMIT", "ROLLBACK"}


def random_segments(seed, n=400):
    """Segments of few connections in order of time, with bare acknowledgements behind the end."""
    rng, t, rows, last = random.Random(seed), 0, [], {}
    for pos in range(1, n):
        t += rng.choice([0, 1, 2, 5, 40])
        port, to_server = 4000 + rng.randrange(5), rng.random() < 0.6
        server = 5432 if port < 4003 else 6000      # the first packet tells the client of the latter
        quiet = t - last.get(port, t) >= 60
        flags = "ACK" if quiet else rng.choice(["ACK", "ack", None, "FIN,ACK", "RST", "SYN"])
        size = rng.choice([0, 0, 7, None]) if not quiet else 9
        ends = ("10.0.0.1", port, "10.1.0.1", server)
        ends = ends if to_server else ends[2:] + ends[:2]
        rows.append((pos, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=t), *ends, pos * 10, size, flags, None))
        last[port] = t
    end = rows[-1][1] + dt.timedelta(hours=2)
    return [*rows, (n, end, "10.0.0.9", 9, "10.1.0.1", 5432, 0, 1, "ACK", None)]


@pytest.mark.parametrize("parts", [1, 4])
def test_lives_close_once_on_a_stream(spark, tmp_path, parts):
    rows = random_segments(5)
    size = -(-len(rows) // parts)
    write_parts([spark.createDataFrame(rows[i:i + size], schemas.SEGMENTS)
                 for i in range(0, len(rows), size)], f"{tmp_path}/in")
    segments = spark.readStream.schema(schemas.SEGMENTS).option("maxFilesPerTrigger", 1) \
        .parquet(f"{tmp_path}/in")
    out, _ = run(stream_connections(segments, idle_seconds=60), tmp_path)
    batch = capture.connection_sessions(
        capture.canonical_conn(spark.createDataFrame(rows, schemas.SEGMENTS)), idle_seconds=60)
    batch = batch.where("conn_key NOT LIKE '10.0.0.9:%'").fillna(0, ["bytes"])
    cols = ["started", "ended", "segments", "bytes", "end_reason"]
    client = F.regexp_extract("conn_key", r"(4\d{3})", 1).alias("client")
    got, want = (sorted(map(str, r.select(client, *cols).collect())) for r in (out, batch))
    assert got == want and len({r.end_reason for r in out.collect()}) == 3
    if parts == 1:
        assert {(r.conn_key, r.life) for r in out.collect()} == {
            (r.conn_key, r.life) for r in batch.collect()}


def test_nothing_closes_without_segments(spark, tmp_path):
    write_parts([spark.createDataFrame([], schemas.SEGMENTS)], f"{tmp_path}/in")
    segments = spark.readStream.schema(schemas.SEGMENTS).parquet(f"{tmp_path}/in")
    out, _ = run(stream_connections(segments), tmp_path)
    assert out.count() == 0


def test_outcomes_meet_and_lost_events_come_out(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)     # noqa: E731
    schema = "conn_key string, event_seq long, ts timestamp, exec_ms double, error string"
    source = [("a", 1, at(0), 5.0, None), ("a", 2, at(10), 5.0, None), ("a", 3, at(20), 5.0, None),
              (None, 4, at(30), 5.0, None), ("b", 1, at(65), 5.0, "same"), ("a", None, None, 1.0, None),
              ("z", 9, at(9000), 1.0, None)]
    target = [("a", 1, at(3), 50.0, None), ("a", 2, at(5), 5.0, None),      # the latter before its event
              ("a", 3, at(21), 5.0, "gone"), ("a", 3, at(22), 5.0, None), (None, 4, at(31), 5.0, None),
              ("b", 1, at(66), 5.0, "same"), ("z", 9, at(9001), 1.0, None)]
    sides = []
    for name, rows in (("s", source), ("t", target)):
        write_parts([spark.createDataFrame(rows[:4], schema), spark.createDataFrame(rows[4:], schema)],
                    f"{tmp_path}/{name}")
        sides.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}"))
    matched = outcomes.matched_outcomes(*sides, within="30 seconds")
    out, _ = run(outcomes.rolling_outcomes(matched, "1 minute"), tmp_path)
    got = [((r.from_ts - t0).seconds, r.attempts, r.errors, r.lost, r.diff_errors, r.diff_slow, r.alert)
           for r in out.orderBy("from_ts").collect()]
    assert got == [(0, 3, 1, 2, 1, 1, True), (60, 1, 1, 0, 0, 0, True)]
    first = out.orderBy("from_ts").first()
    assert (first.error_rate, first.source_qps, first.target_qps) == (1 / 3, 5 / 60, 3 / 60)
