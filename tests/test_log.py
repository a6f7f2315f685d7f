import glob
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sqltide.sources import codec, log
from tests.test_sources import one_event


def segment(values):
    data = b""
    for key, value in values:
        data += log.frame(len(data), key, value)
    return data


def rows(data, width, size=None):
    size = len(data) if size is None else size
    return [row for begin in range(0, size, width) for row in log.Segment(
        pa.BufferReader(data), size).rows(begin, min(begin + width, size))]


def test_ranges_give_each_frame_and_gap_once():
    rng = random.Random(5)
    values = [(rng.choice(["k", None, ""]), rng.choice([None, "", "é" * rng.randrange(90)]))
              for _ in range(60)]
    values[20] = ("nested", segment([("a", "b")] * 3).decode("latin-1"))
    data = segment(values)
    whole = rows(data, len(data))
    assert [log.unframed(c) for *_, c in whole] == values
    for width in (1, 7, 64, 500):
        assert rows(data, width) == whole
    for _ in range(40):
        broken = bytearray(data)
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(data))
            broken[at:at + rng.choice([1, 1, 30, 300])] = os.urandom(1) * rng.choice([1, 5])
        broken = bytes(broken)
        first = rows(broken, len(broken))
        assert all(rows(broken, width) == first for width in (3, 50, 333))
        assert sum(size for _, size, _ in first) == len(broken)
        assert [p for p, *_ in first] == sorted({p for p, *_ in first})
        assert {c for *_, c in first if c is not None} <= {c for *_, c in whole}


def test_damage_takes_no_other_frame():
    values = [(str(i), "v" * 40) for i in range(20)]
    data = segment(values)
    places = [p for p, *_ in rows(data, len(data))]
    broken = bytearray(data)
    for i in (0, 7, 8, 19):
        broken[places[i] + log.HEAD.size + 10] ^= 1
    for width in (len(data), 100, places[7], places[8], places[9]):
        found = rows(bytes(broken), width)
        assert [int(log.unframed(c)[0]) for *_, c in found if c] == [
            i for i in range(20) if i not in (0, 7, 8, 19)]
        assert [p for p, _, c in found if c is None] == [places[i] for i in (0, 7, 19)]
    cut = rows(data[:places[5] + 9], 100, len(data))
    assert [p for p, *_ in cut] == places[:6] and cut[-1] == (places[5], len(data) - places[5], None)


def test_batch_keeps_events_and_nulls(spark, tmp_path):
    path = str(tmp_path / "log")
    event = one_event(spark)
    log.append_log(codec.encode_events(event), path)
    assert codec.good_events(codec.decode_events(log.read_log(spark, path))).collect() == event.collect()
    extra = spark.createDataFrame([(None, None, 1), ("", "", 2), ("k", "é\n", 3)],
                                  "key string, value string, place int")
    log.append_log(extra, "file:" + path)
    log.append_log(extra.where("false"), path)
    found = log.read_log(spark, path, range_bytes=10)
    assert {(r.key, r.value) for r in found.where("generation = 1").collect()} == {
        (None, None), ("", ""), ("k", "é\n")}
    assert found.where("gap").count() == 0 and found.count() == 4
    with pytest.raises(Exception, match="only appended"):
        extra.select("key", "value").write.format(log.NAME).mode("overwrite").save(path)
    assert log.read_log(spark, str(tmp_path / "none")).count() == 0


def test_damaged_and_missing_segments(spark, tmp_path):
    path = str(tmp_path / "log")
    log.append_log(spark.range(0, 400, 1, 2).select(
        F.col("id").cast("string").alias("key"), F.repeat(F.lit("x"), 100).alias("value")), path)
    first, second = sorted(glob.glob(f"{path}/segments/*.seg"))
    size = os.path.getsize(first)
    with open(first, "r+b") as file:
        file.seek(size // 2)
        file.write(b"!" * 300)
    broken = log.read_log(spark, path, range_bytes=1000).collect()
    assert sum(r.bytes for r in broken) == size + os.path.getsize(second)
    assert sum(r.gap for r in broken) == 1 and 395 <= len(broken) <= 399
    with open(second, "r+b") as file:
        file.truncate(0)
    gaps = log.read_log(spark, path, range_bytes=1000).where("gap").collect()
    assert sorted(r.place for r in gaps)[0] == 0 and len(gaps) == 2


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    records = lambda a, b: spark.range(a, b).select(
        F.col("id").cast("string").alias("key"), F.lit("v").alias("value"))

    def run():
        (log.read_log(spark, path, streaming=True, range_bytes=500).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", f"{out}-ck")
         .trigger(availableNow=True).start().awaitTermination())
        return sorted(int(r.key) for r in spark.read.parquet(out).collect())

    log.append_log(records(0, 100), path)
    log.append_log(records(100, 150), path)
    assert run() == list(range(150))
    assert run() == list(range(150))
    log.append_log(records(150, 155), path)
    assert run() == list(range(155))
    assert sorted(int(r.key) for r in log.read_log(spark, path).collect()) == list(range(155))


def test_repeated_batch_is_written_once(tmp_path):
    store = log._Log({"path": str(tmp_path / "log")})
    table = pa.RecordBatch.from_pydict({"key": ["a", "b"], "value": ["1", None]})
    for number, writer in ((0, "s"), (0, "s"), (1, "s"), (1, "s"), (0, "t")):
        store.publish([store.write(iter([table])), None, store.write(iter([]))], number, writer)
    assert len(store.generations()) == 3 and len(store.ranges(0, None)) == 3
    assert len(glob.glob(f"{tmp_path}/log/segments/*")) == 3
    assert [r.generation for r in store.ranges(1, 2)] == [1]
