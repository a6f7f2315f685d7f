import datetime as dt

import pytest
from pyspark.sql import functions as F

from sqltide import schemas
from sqltide.operators import scan
from sqltide.plans import pipeline
from sqltide.sources import codec, exports, kafka, tables

TS = dt.datetime(2024, 1, 2, 15, 4, 5)


def one_event(spark):
    row = ("c:1-s:2", 0, 7, TS.replace(microsecond=120_000), "COPY t FROM STDIN", 3, 4, True, "s1",
           [(23, bytearray(b"\x00\xff"), 1), (25, None, 0), (25, bytearray(b""), 0)],
           [bytearray(b"a\tb\n"), bytearray(b"")], 1_500_000, "db", None)
    return spark.createDataFrame([row], schemas.SQL_EVENTS)


def test_records_keep_every_field(spark):
    event = one_event(spark)
    decoded = codec.decode_events(kafka.kafka_frames(event))
    assert codec.good_events(decoded).collect() == event.collect()
    assert decoded.first().key == "c:1-s:2" and codec.corrupt_count(decoded).first()[0] == 0


@pytest.mark.parametrize("split", [{}, dict(hot_rows=10, width=8)])
def test_breaker(spark, split):
    good = codec.encode_events(one_event(spark)).first().value
    bad = ["", "{", "[]", "nope", '{"pos": "x"}', None, "{}"]
    values = [good] * 3 + bad[:2] + [good] + [bad[i % 7] for i in range(5)] + [good] + bad[:3]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)] + [(1, 0, good)],
                               "partition int, offset long, value string")
    decoded = codec.decode_events(df)
    assert codec.good_events(decoded).count() == 6 and codec.corrupt_count(decoded).first()[0] == 10
    state = {r.partition: (r.corrupt_records, r.longest_run, r.tripped)
             for r in codec.breaker_state(decoded, limit=5, **split).collect()}
    assert state == {0: (10, 5, True), 1: (0, 0, False)}
    taken = codec.consume_until_break(decoded, limit=5, **split)
    assert sorted((r.partition, r.offset) for r in taken.collect()) == [(0, i) for i in range(10)] + [(1, 0)]
    assert codec.consume_until_break(decoded, limit=6, **split).count() == len(values) + 1


def test_kafka_options(monkeypatch):
    plain = kafka.KafkaOptions(("a:1", "b:2"), "t")
    assert kafka.read_options(plain) == {
        "kafka.bootstrap.servers": "a:1,b:2", "kafka.security.protocol": "PLAINTEXT", "subscribe": "t",
        "startingOffsets": "earliest", "kafka.group.id": kafka.GROUP}
    monkeypatch.setenv("PW", 'p"w')
    secure = kafka.KafkaOptions(("a:1",), "t", sasl_mechanism="SCRAM-SHA-512", sasl_username="u",
                                sasl_password_env="PW", tls_enabled=True, tls_ca_file="/ca.pem",
                                tls_skip_verify=True)
    o = kafka.write_options(secure)
    assert o["kafka.security.protocol"] == "SASL_SSL" and o["kafka.sasl.mechanism"] == "SCRAM-SHA-512"
    assert 'username="u" password="p\\"w";' in o["kafka.sasl.jaas.config"]
    assert o["kafka.ssl.truststore.location"] == "/ca.pem" and o["topic"] == "t"
    for wrong in (dict(sasl_mechanism="gssapi", sasl_username="u", sasl_password="p"),
                  dict(sasl_mechanism="plain", sasl_username="u"), dict(sasl_mechanism="plain")):
        with pytest.raises(ValueError):
            kafka.connection_options(kafka.KafkaOptions(("a:1",), "t", **wrong))
    with pytest.raises(ValueError):
        kafka.connection_options(kafka.KafkaOptions((), "t"))


def test_error_log(spark, tmp_path):
    rows = [(TS, "k", "INSERT 1\n\n", "dup\nkey\r!"), (TS.replace(microsecond=123_400), "k", "X", None)]
    df = spark.createDataFrame(rows, "ts timestamp, conn_key string, sql string, error string")
    exports.error_export(df.coalesce(1), str(tmp_path / "log"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert lines == ["-- 2024-01-02T15:04:05Z conn=k error: dup key !", "INSERT 1;",
                     "-- 2024-01-02T15:04:05.1234Z conn=k error: unknown", "X;"]


def test_diff_log(spark):
    rows = [(TS, "k", "S" * 101, 1.25, 9.0, 'say "no"', "ERROR"), (TS, "k", "S" * 100, 1.0, 2.0, None, "SLOW"),
            (TS, "k", "x", 1.0, 1.0, None, "NONE")]
    df = spark.createDataFrame(rows, "ts timestamp, conn_key string, sql string, source_exec_ms double, "
                                     "target_exec_ms double, target_error string, diff_type string")
    assert sorted(r.value for r in exports.diff_records(df).collect()) == [
        "2024-01-02T15:04:05Z [ERROR] k: " + "S" * 100
        + '... (source=1.2ms target=9.0ms err="say \\"no\\"")',
        "2024-01-02T15:04:05Z [SLOW] k: " + "S" * 100 + ' (source=1.0ms target=2.0ms err="")']


def test_routing_is_limited(spark, tmp_path):
    df = spark.range(65).select(F.concat(F.lit("d"), "id").alias("database"), "id")
    with pytest.raises(ValueError):
        exports.route_by_database(df, str(tmp_path / "no"))
    exports.route_by_database(df.where("id < 64"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("database = 'd7'").first().id == 7
    assert len(list((tmp_path / "out").glob("database=*"))) == 64


def test_exposition(spark):
    rows = spark.sql("""SELECT 'a_total' name, map('k', 'x"y', 'b', 'z') labels, 3D value
                        UNION ALL SELECT 'rate', map(), 0.25D""")
    assert sorted(r.value for r in exports.metrics_exposition(rows).collect()) == [
        'a_total{b="z",k="x\\"y"} 3', "rate 0.25"]


def test_reading_messages_is_typed(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([], schemas.MESSAGES).write.parquet(path)
    assert tables.read_messages(spark, path).schema == schemas.MESSAGES
    assert tables.read_messages(spark, path, streaming=True).isStreaming


def test_cut_points_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    df = scan.cut(spark.range(5))
    assert all(f.startswith("file:" + folder) or f.startswith("file://" + folder) for f in df.inputFiles())
    assert df.count() == 5
