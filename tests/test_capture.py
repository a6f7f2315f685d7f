import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sqltide.operators import capture

T0 = dt.datetime(2026, 1, 1)
SEGMENT = ("pos long, ts timestamp, src_ip string, src_port int, dst_ip string, dst_port int, "
           "tcp_seq long, len int, flags string, payload binary")


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_filter_reaches_the_scan(spark, tmp_path):
    rows = [(1, "a", 5000, "s", 5432), (2, "s", 5432, "a", 5000), (3, "a", 1, "s", 80),
            (4, "b", 5000, "x", 5432)]
    schema = "pos long, src_ip string, src_port int, dst_ip string, dst_port int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))

    def kept(**o):
        return sorted(r.pos for r in capture.capture_filter(df, **o).collect())

    assert kept() == [1, 2, 4]
    assert kept(source_host="s") == [1, 2]
    assert kept(source_host="s", source_port=80) == [3]
    plan = capture.capture_filter(df)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(EqualTo(src_port,5432),EqualTo(dst_port,5432))]" in plan


def test_connections_point_from_client_to_server(spark):
    rows = [
        (1, "10.0.0.1", 5000, "::ffff:10.0.0.9", 5432, "10.0.0.1:5000-10.0.0.9:5432", True),
        (2, "10.0.0.9", 5432, "10.0.0.1", 5000, "10.0.0.1:5000-10.0.0.9:5432", False),
        (3, "::1", 7000, "::2", 6000, "::1:7000-::2:6000", True),         # first packet decides
        (4, "::2", 6000, "::1", 7000, "::1:7000-::2:6000", False),
        (5, "10.0.0.9", 5432, "10.0.0.8", 5432, "10.0.0.9:5432-10.0.0.8:5432", True),
        (6, "10.0.0.8", 5432, "10.0.0.9", 5432, "10.0.0.9:5432-10.0.0.8:5432", False)]
    df = spark.createDataFrame([r[:5] for r in rows],
                               "pos long, src_ip string, src_port int, dst_ip string, dst_port int")
    got = capture.canonical_conn(df).orderBy("pos").collect()
    assert [(r.conn_key, r.from_client) for r in got] == [r[5:] for r in rows]
    assert got[1].conn.src_port == 5000 and got[1].conn.dst_ip == "10.0.0.9"


@pytest.mark.parametrize("split", [{}, dict(hot_rows=30, width=16, byte_width=40)])
def test_stream_is_put_together_again(spark, split):
    rng = random.Random(8)
    stream = bytes(rng.randrange(256) for _ in range(400))
    base, rows, cuts = 2**32 - 150, [], []
    start = 0
    while start < len(stream):
        size = rng.randint(1, 9)
        cuts.append((start, min(size, len(stream) - start)))
        start += size
    arrivals = cuts + rng.sample(cuts, 10) + [(s + 2, 6) for s, _ in rng.sample(cuts[:-3], 8)]
    arrivals = [c for _, c in sorted(enumerate(arrivals), key=lambda x: (x[1][0] // 30, rng.random()))]
    for pos, (s, n) in enumerate(arrivals):
        part = stream[s:s + n]
        rows.append(("c", True, pos, (base + s) % 2**32, len(part), bytearray(part)))
    rows.append(("c", True, len(rows), (base + 400) % 2**32, 0, None))
    schema = "conn_key string, from_client boolean, pos long, tcp_seq long, len int, payload binary"
    got = capture.order_segments(spark.createDataFrame(rows, schema), **split) \
        .orderBy("stream_seq", "pos").collect()
    assert b"".join(bytes(r.payload) for r in got) == stream
    assert sum(r.new_bytes for r in got) == len(stream) and sum(r.gap_bytes for r in got) == 0
    assert {"start", "next", "duplicate", "overlap"} <= {r.status for r in got}


def test_lives_on_the_same_ports_are_apart(spark):
    rows = [("c", True, 0, 1, 1000, 10), ("c", True, 1, 1, 1010, 5), ("c", True, 2, 2, 500, 5),
            ("c", True, 3, 2, 505, 5)]
    df = spark.createDataFrame(
        rows, "conn_key string, from_client boolean, pos long, life long, tcp_seq long, len int")
    got = capture.order_segments(df).orderBy("pos").collect()
    assert [r.status for r in got] == ["start", "next", "start", "next"]


def test_gaps_are_reported(spark):
    rows = [("c", True, 0, 100, 10), ("c", True, 1, 130, 5), ("c", True, 2, 135, 5)]
    df = spark.createDataFrame(rows, "conn_key string, from_client boolean, pos long, tcp_seq long, len int")
    got = capture.order_segments(df).orderBy("pos").collect()
    assert [(r.status, r.gap_bytes) for r in got] == [("start", 0), ("gap", 20), ("next", 0)]


@pytest.mark.parametrize("hot_rows", [10**6, 3])
def test_lives_of_a_connection(spark, hot_rows):
    rows = [  # seconds, flags, length, life
        (0, "SYN", 0, 0), (1, "ACK", 5, 0), (2, "FIN,ACK", 0, 0), (3, "FIN,ACK", 0, 0),
        (4, "ACK", 0, 0), (5, "SYN", 0, 1), (6, "ACK", 7, 1), (400, "ACK", 7, 2),
        (401, "RST", 0, 2), (402, "ACK", 3, 3), (702, "ACK", 0, 4)]
    df = spark.createDataFrame([("c", i, at(s), f, n) for i, (s, f, n, _) in enumerate(rows)],
                               "conn_key string, pos long, ts timestamp, flags string, len int")
    got = capture.assign_life(df, hot_rows=hot_rows, width=4).orderBy("pos").collect()
    assert [r.life for r in got] == [r[3] for r in rows]
    ends = {r.life: (r.end_reason, r.segments) for r in capture.connection_sessions(df).collect()}
    assert ends == {0: ("fin", 5), 1: ("idle", 2), 2: ("rst", 2), 3: ("idle", 1), 4: ("idle", 1)}


def test_loss_counts_from_totals(spark):
    rows = [(at(0), 1000, 1), (at(5), 3000, 3), (at(10), 500, 0), (at(15), 500, 1), (at(20), 0, 0)]
    df = spark.createDataFrame(rows, "ts timestamp, received long, dropped long")
    got = capture.capture_loss(df).orderBy("ts").collect()
    assert [r.received_delta for r in got] == [1000, 2000, 0, 0, 0]
    assert [r.dropped_delta for r in got] == [1, 2, 0, 1, 0]
    assert [r.alert for r in got] == [False, False, False, True, False]   # 0.001 is not above
    assert got[-1].drop_rate == 0.0
