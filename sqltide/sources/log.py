"""An event log of framed segments as a Spark data source, for batches and streams.

``df.write.format("sqltide_log")`` appends a generation: every task writes one segment, and a
single manifest makes all of them visible at once, so a lost executor or a repeated batch leaves
nothing half written.  One writer at a time appends to a log.  ``spark.read`` gives all
generations, ``spark.readStream`` those behind its cursor, the number of generations read.

A frame is a mark, its own byte place in the segment, a length, and a checksum over these and the
content.  Segments are read in ranges of ``rangeBytes``; a frame belongs to the range in which it
begins.  Where no frame holds, the reader searches for the next one that does and gives the bytes
between as one row with ``gap`` set, reported by the range of the frame before.  As a frame only
holds at the place it names, a log kept inside another one's values is never taken for its frames.

Rows are (generation, segment, place, bytes, gap, key, value).  Null keys and values stay null.
Missing or cut segments are gaps up to the length that the manifest states.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader,
                                    DataSourceStreamArrowWriter, DataSourceStreamReader,
                                    InputPartition, WriterCommitMessage)

NAME = "sqltide_log"
RANGE_BYTES = 64 << 20
SCHEMA = ("generation long, segment string, place long, bytes long, gap boolean, "
          "key string, value string")

MARK = b"\x89tide\r\n\x1a"
HEAD = struct.Struct("<8sQII")
SIZES = struct.Struct("<ii")
WINDOW = 4 << 20
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def file_system(path: str):
    """A file system of Arrow and the path within it; without a scheme it is local."""
    from pyarrow import fs

    if re.match(r"^[A-Za-z][\w+.-]*:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), os.path.abspath(path)


def frame(place: int, key: str | None, value: str | None) -> bytes:
    parts = [None if part is None else part.encode() for part in (key, value)]
    content = SIZES.pack(*[-1 if part is None else len(part) for part in parts])
    content += b"".join(part or b"" for part in parts)
    head = HEAD.pack(MARK, place, len(content), 0)[:-4]
    return head + struct.pack("<I", zlib.crc32(content, zlib.crc32(head))) + content


def unframed(content: bytes) -> tuple[str | None, str | None]:
    key, value = SIZES.unpack_from(content)
    middle = SIZES.size + max(key, 0)
    return (None if key < 0 else content[SIZES.size:middle].decode(),
            None if value < 0 else content[middle:middle + value].decode())


class Segment:
    """Frames of a segment's bytes, read through a window."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.window = file, size, 0, b""
        self.there = file.size()

    def bytes_at(self, place: int, length: int) -> bytes:
        skip = place - self.start
        if skip < 0 or skip + length > len(self.window):
            self.file.seek(min(place, self.there))
            self.start, self.window, skip = place, self.file.read(max(length, WINDOW)), 0
        return self.window[skip:skip + length]

    def content(self, place: int) -> bytes | None:
        """What the frame at ``place`` holds; None if there is no sound one."""
        head = self.bytes_at(place, HEAD.size)
        if len(head) < HEAD.size:
            return None
        mark, named, length, check = HEAD.unpack(head)
        if mark != MARK or named != place or place + HEAD.size + length > self.size:
            return None
        content = self.bytes_at(place + HEAD.size, length)
        sound = zlib.crc32(content, zlib.crc32(head[:-4])) == check
        return content if sound and length >= SIZES.size else None

    def search(self, place: int, stop: int) -> int | None:
        """The first sound frame from ``place`` on that begins before ``stop``."""
        while place < stop:
            block = self.bytes_at(place, min(WINDOW, stop - place + len(MARK) - 1))
            hit = block.find(MARK)
            if hit < 0:
                if len(block) < len(MARK):
                    return None
                place += len(block) - len(MARK) + 1
            elif self.content(place + hit) is not None:
                return place + hit
            else:
                place += hit + 1
        return None

    def rows(self, begin: int, end: int) -> Iterator[tuple[int, int, bytes | None]]:
        """(place, bytes, content) of the range's frames; gaps have no content."""
        place = begin if begin == 0 else self.search(begin, end)
        while place is not None and place < self.size:
            content = self.content(place)
            if content is None:
                after = self.search(place + 1, self.size)
                yield place, (after or self.size) - place, None
                place = after
            elif place < end:
                yield place, HEAD.size + len(content), content
                place += HEAD.size + len(content)
            else:
                return


@dataclass
class Range(InputPartition):
    generation: int
    segment: str
    begin: int
    end: int
    size: int


@dataclass
class Written(WriterCommitMessage):
    segment: str | None
    size: int


class _Log:
    """Folders and manifests of a log."""

    def __init__(self, options):
        if not options.get("path"):
            raise ValueError("a log needs a path")
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def at(self, *names: str):
        files, root = file_system(self.path)
        return files, "/".join([root.rstrip("/"), *names])

    def generations(self) -> list[tuple[int, str]]:
        from pyarrow import fs

        files, folder = self.at("manifest")
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted((int(i.base_name[:-5]), i.path) for i in found if re.fullmatch(
            r"\d+\.json", i.base_name))

    def manifest(self, path: str) -> dict:
        with self.at()[0].open_input_stream(path) as file:
            return json.loads(file.read())

    def ranges(self, start: int, end: int | None) -> list[Range]:
        return [Range(generation, segment, begin, min(begin + self.range_bytes, size), size)
                for generation, path in self.generations()
                if generation >= start and (end is None or generation < end)
                for segment, size in self.manifest(path)["segments"]
                for begin in range(0, size, self.range_bytes)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        files, path = self.at("segments", part.segment)
        try:
            file = files.open_input_file(path)
        except FileNotFoundError:
            file = pa.BufferReader(b"")
        rows, held = [], 0
        with file:
            for place, size, content in Segment(file, part.size).rows(part.begin, part.end):
                key, value = (None, None) if content is None else unframed(content)
                rows.append((part.generation, part.segment, place, size, content is None, key, value))
                held += len(content or b"")
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        segment, place, file = f"{uuid.uuid4().hex}.seg", 0, None
        try:
            for rows in batches:
                for key, value in zip(rows.column("key").to_pylist(), rows.column("value").to_pylist(),
                                      strict=True):
                    if file is None:
                        files, folder = self.at("segments")
                        files.create_dir(folder)
                        file = files.open_output_stream(f"{folder}/{segment}")
                    place += file.write(frame(place, key, value))
        finally:
            if file is not None:
                file.close()
        return Written(segment if place else None, place)

    def publish(self, messages, batch_id: int | None, writer: str) -> None:
        generations = self.generations()
        if batch_id is not None and any(
                (m := self.manifest(path)).get("writer") == writer and m.get("batch") == batch_id
                for _, path in reversed(generations)):
            self.discard(messages)
            return
        name = f"{generations[-1][0] + 1 if generations else 0:012d}"
        files, folder = self.at("manifest")
        files.create_dir(folder)
        hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with files.open_output_stream(hidden) as file:
            file.write(json.dumps({"writer": writer, "batch": batch_id, "segments": [
                [m.segment, m.size] for m in messages if m and m.segment]}).encode())
        files.move(hidden, f"{folder}/{name}.json")

    def discard(self, messages) -> None:
        for message in messages:
            if message and message.segment:
                files, path = self.at("segments", message.segment)
                files.delete_file(path)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class _Reader(DataSourceReader):
    def __init__(self, log: _Log):
        self.log = log

    def partitions(self):
        return self.log.ranges(0, None)

    def read(self, partition):
        return iter(()) if partition is None else self.log.read(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, log: _Log):
        self.log = log

    def initialOffset(self):
        return {"generation": 0}

    def latestOffset(self):
        found = self.log.generations()
        return {"generation": found[-1][0] + 1 if found else 0}

    def partitions(self, start, end):
        return self.log.ranges(start["generation"], end["generation"])

    def read(self, partition):
        return self.log.read(partition)


class _Writer(DataSourceArrowWriter):
    def __init__(self, log: _Log):
        self.log = log

    def write(self, iterator):
        return self.log.write(iterator)

    def commit(self, messages):
        self.log.publish(messages, None, "batch")

    def abort(self, messages):
        self.log.discard(messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, log: _Log, writer: str):
        self.log, self.writer = log, writer

    def write(self, iterator):
        return self.log.write(iterator)

    def commit(self, messages, batchId):
        self.log.publish(messages, batchId, self.writer)

    def abort(self, messages, batchId):
        self.log.discard(messages)


class EventLog(DataSource):
    """Options: ``path``; ``rangeBytes`` for readers; ``writer``, the name under which a stream's
    repeated batches are known, for stream writers."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(_Log(self.options))

    def streamReader(self, schema):
        return _StreamReader(_Log(self.options))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a log is only appended to")
        return _Writer(_Log(self.options))

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(_Log(self.options), self.options.get("writer", "stream"))


def append_log(records: DataFrame, path: str) -> None:
    """Appends records (key, value) as one generation."""
    records.sparkSession.dataSource.register(EventLog)
    records.select("key", "value").write.format(NAME).mode("append").save(path)


def stream_to_log(records: DataFrame, path: str, checkpoint: str, writer: str = "stream",
                  trigger: dict | None = None):
    """Appends each micro-batch of a stream once, also if it is run again."""
    records.sparkSession.dataSource.register(EventLog)
    return (records.select("key", "value").writeStream.format(NAME).outputMode("append")
            .option("path", path).option("writer", writer).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_log(spark: SparkSession, path: str, streaming: bool = False,
             range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records and gaps of a log; ``codec.decode_events`` reads events from ``value``."""
    spark.dataSource.register(EventLog)
    reader = spark.readStream if streaming else spark.read
    return reader.format(NAME).option("rangeBytes", range_bytes).load(path)
