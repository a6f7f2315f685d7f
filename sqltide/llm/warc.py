"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

The reader takes an archive in ranges of bytes, each by a task of its own; a record belongs to the
range it begins in.  Where a gzip member or record fails its checks (lengths, digests, form), it
searches on for the next place where a member with a version line, or a version line with a whole
header, begins, goes on from there, and logs the gap it left out as quarantined.  A header that has not
ended after ``MOST_HEADER`` = 1 MiB counts as damage; the writer's headers are longer only with a url
of that length.

The writer makes one record per page, the payload being the html in UTF-8, null as empty.  Of
pages with equal payloads of at least ``least`` bytes that with the largest id is a response and
the others revisit it; pages with a null id are always responses and nothing revisits them.  Of
repeated rows with the largest id each is a response.  Archives are named by partition, written
under a temporary name and moved, so a task that runs again replaces its own files.  An empty
table writes no archive.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltide.llm.shared import attach, checkpoint_ready, cut

REVISIT_FROM = 1000
#: Bytes of an archive before the next begins, and of a range that one task reads.
ARCHIVE, RANGE = 64 << 20, 32 << 20
#: Most tasks of a read.
TASKS = 50_000
DATE = "1970-01-01T00:00:00Z"
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: Longest header that is believed.
MOST_HEADER = 1 << 20
RECORDS = ("archive string, at long, type string, record string, url string, refers_to string, "
           "payload_length long, payload_digest string, payload binary")
GAPS = "archive string, begin long, end long, reason string"


def file_system(path: str):
    """A file system of Arrow and the path within it, for any scheme it knows; none is local."""
    from pyarrow import fs

    if re.match(r"^[A-Za-z][\w+.-]*:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), os.path.abspath(path)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None,
           declared: tuple[int, str] | None = None, date: str = DATE) -> bytes:
    """A response, or, where ``refers_to`` is given, a revisit that leaves the payload out.
    ``declared`` are the length and digest of a payload that isn't at hand."""
    length, of_payload = declared or (len(payload), digest(payload))
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {length}\r\n\r\n").encode()
    name = "" if page is None else page
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
             f"WARC-Record-ID: <urn:page:{name}>",
             f"WARC-Target-URI: {re.sub(r'\s', '%20', url) if url else f'urn:page:{name}'}",
             f"WARC-Date: {date}", f"WARC-Payload-Digest: {of_payload}",
             f"X-Payload-Length: {length}", f"WARC-Block-Digest: {digest(block)}",
             "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""])
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def planned(pages: DataFrame, least: int = REVISIT_FROM, id_col: str = "page_id",
            url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, url, payload, refers_to, length): payload is null for revisits."""
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("length", F.length("payload").cast("long")) \
        .withColumn("sum", F.unhex(F.sha2("payload", 256)))
    able = (F.col("length") >= least) & F.col("page").isNotNull()
    groups = cut(keyed.where(able).groupBy("sum").agg(
        F.max("page").alias("first"), F.count("*").alias("n")).where("n > 1"))
    met = attach(keyed, groups, ["sum"], "n", pages.count(), how="left")
    again = able & (F.col("first") != F.col("page"))
    sha1 = F.unhex(F.sha1("payload"))
    return met.select("page", "url", F.when(~F.coalesce(again, F.lit(False)), F.col("payload"))
                      .alias("payload"), F.when(again, F.col("first")).alias("refers_to"),
                      "length", sha1.alias("sha1"))


def write(plan: DataFrame, folder: str, compress: bool = True, most: int = ARCHIVE,
          level: int = 1) -> DataFrame:
    """Writes archives of a plan under ``folder``; (archive, bytes, records) of each."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = file_system(folder)
        part, number, out, size, count, done = TaskContext.get().partitionId(), 0, None, 0, 0, []
        spare = f"{place}/_{part}-{uuid.uuid4().hex}"

        def close():
            out.close()
            name = f"part-{part:05d}-{number:04d}.warc" + (".gz" if compress else "")
            files.move(spare, f"{place}/{name}")
            done.append((f"{folder}/{name}", size, count))

        for batch in batches:
            for page, url, payload, refers_to, length, sha1 in zip(*batch.columns, strict=True):
                declared = (length.as_py(), "sha1:" + base64.b32encode(sha1.as_py()).decode())
                data = record(page.as_py(), url.as_py(), payload.as_py() or b"",
                              refers_to.as_py(), declared)
                if compress:
                    packer = zlib.compressobj(level, wbits=31)
                    data = packer.compress(data) + packer.flush()
                if out is None:
                    files.create_dir(place, recursive=True)
                    out, size, count = files.open_output_stream(spare), 0, 0
                out.write(data)
                size += len(data)
                count += 1
                if size >= most:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[k] for d in done], t) for k, t in
             enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "bytes", "records"])

    return cut(plan.mapInArrow(written, "archive string, bytes long, records long"))


class Bytes:
    """A file by position; what was read last is held."""

    def __init__(self, file, size: int, step: int = 1 << 20):
        self.file, self.size, self.step = file, size, step
        self.begin, self.held = 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if at < self.begin or at + n > self.begin + len(self.held):
            self.file.seek(at)
            self.begin, self.held = at, self.file.read(max(n, min(self.step, self.size - at)))
        return self.held[at - self.begin:at - self.begin + n]

    def find(self, what: bytes, at: int) -> int:
        while at < self.size:
            piece = self.get(at, self.step)
            found = piece.find(what)
            if found >= 0:
                return at + found
            if at + len(piece) >= self.size:
                break
            at += len(piece) - len(what) + 1
        return self.size


class Damaged(Exception):
    """What a record fails on."""


def member(data: Bytes, at: int, first: int = 0) -> tuple[bytes, int]:
    """The content of the gzip member at a place and where it ends; ``first``: only so much."""
    unpack, out, here = zlib.decompressobj(wbits=31), [], at
    size = 0
    while not unpack.eof:
        piece = data.get(here, 1 << 16)
        if not piece:
            raise Damaged("member cut off")
        try:
            out.append(unpack.decompress(piece))
        except zlib.error as error:
            raise Damaged("member doesn't unpack") from error
        size += len(out[-1])
        here += len(piece)
        if first and size >= first:
            break
    return b"".join(out), here - len(unpack.unused_data)


def parsed(data: Bytes, at: int) -> tuple[dict, bytes, int]:
    """Header, block and end of the plain record at a place; raises where a check fails."""
    if not data.get(at, len(VERSION)) == VERSION:
        raise Damaged("no version line")
    head = data.get(at, 1 << 13)
    stop = head.find(b"\r\n\r\n")
    if stop < 0:
        head = data.get(at, MOST_HEADER)
        stop = head.find(b"\r\n\r\n")
    if stop < 0:
        raise Damaged("header doesn't end")
    header = {}
    for line in head[:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        header[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,15}", header.get("content-length", "")):
        raise Damaged("no length")
    begin = at + stop + 4
    end = begin + int(header["content-length"])
    if data.get(end, 4) != b"\r\n\r\n":
        raise Damaged("record cut off")
    block = data.get(begin, end - begin)
    if "warc-block-digest" in header and header["warc-block-digest"] != digest(block):
        raise Damaged("block digest differs")
    return header, block, end + 4


def inner(content: bytes) -> list[tuple[dict, bytes]]:
    """The records of a member."""
    import io

    data, at, out = Bytes(io.BytesIO(content), len(content), len(content)), 0, []
    while at < len(content):
        header, block, at = parsed(data, at)
        out.append((header, block))
    if not out:
        raise Damaged("member without a record")
    return out


def likely(data: Bytes, at: int, packed: bool) -> bool:
    """Whether a record may begin here: its version line, unpacked if need be."""
    try:
        return not packed or member(data, at, len(VERSION))[0].startswith(VERSION)
    except Damaged:
        return False


def following(data: Bytes, at: int, packed: bool) -> int:
    """The next place from ``at`` on where a record may begin."""
    mark = MAGIC if packed else VERSION
    at = data.find(mark, at)
    while at < data.size and not likely(data, at, packed):
        at = data.find(mark, at + 1)
    return at


def salvaged(data: Bytes, begin: int, end: int) -> Iterator[tuple]:
    """Records (place, header, block) that begin in [begin, end), and gaps (begin, end, reason)."""
    packed = data.get(0, 3) == MAGIC or (
        data.get(0, len(VERSION)) != VERSION and data.find(MAGIC, 0) < data.find(VERSION, 0))
    at = following(data, begin, packed) if begin else 0
    while at < min(end, data.size):
        try:
            if packed:
                content, after = member(data, at)
                found = inner(content)
            else:
                header, block, after = parsed(data, at)
                found = [(header, block)]
        except Damaged as damage:
            after = following(data, at + 1, packed)
            yield at, after, str(damage)
        else:
            for header, block in found:
                yield at, header, block
        at = after


def read(archives: DataFrame, span: int = RANGE, gaps: bool = False,
         tasks: int = TASKS) -> DataFrame:
    """Records of the archives (archive, bytes), or with ``gaps`` what was quarantined.

    Each range of ``span`` bytes is a task of its own, up to ``tasks`` of them; beyond that,
    neighbouring ranges share a task.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, place = file_system(path)
                with files.open_input_file(place) as file:
                    held, weight = [], 0
                    for item in salvaged(Bytes(file, size), begin, min(size, begin + span)):
                        if isinstance(item[1], dict) == gaps:
                            continue
                        row = (path, *item) if gaps else described(path, *item)
                        held.append(row)
                        weight += len(item[2])
                        if weight > 4 << 20:
                            yield table(held)
                            held, weight = [], 0
                    if held:
                        yield table(held)

    def described(path, at, header, block):
        head, _, payload = block.partition(b"\r\n\r\n")
        if header.get("warc-type") == "revisit" or not block.startswith(b"HTTP/"):
            payload = b"" if header.get("warc-type") == "revisit" else block
        name = lambda v: v.strip("<>") if v else None
        length = header.get("x-payload-length")
        declared = header.get("warc-payload-digest", "")
        whole = base64.b32decode(declared[5:]).hex() if declared.startswith("sha1:") \
            else hashlib.sha1(payload).hexdigest()
        return (path, at, header.get("warc-type"), name(header.get("warc-record-id")),
                header.get("warc-target-uri"), name(header.get("warc-refers-to")),
                int(length) if length else len(payload), whole, payload)

    def table(held):
        return pa.RecordBatch.from_arrays(
            [pa.array([h[k] for h in held], t) for k, t in enumerate(kinds)], names)

    text, whole = pa.string(), pa.int64()
    kinds = [text, whole, whole, text] if gaps else \
        [text, whole, text, text, text, text, whole, text, pa.binary()]
    schema = GAPS if gaps else RECORDS
    names = [c.split()[0] for c in schema.split(", ")]
    ranges = archives.where("bytes > 0").select(
        "archive", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1,
                                                 F.lit(span).cast("long"))).alias("begin"))
    number = archives.agg(F.sum(F.ceil(F.col("bytes") / span))).first()[0] or 1
    # A given number is kept by adaptive execution, which would merge these small rows otherwise.
    return ranges.repartitionByRange(min(number, tasks), "archive", "begin").mapInArrow(rows, schema)


def folder(spark: SparkSession) -> str:
    """A new folder for archives in the session's shared checkpoint folder."""
    checkpoint_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"


def page_of(name: str):
    """The id in a record's name, null if there is none."""
    return F.nullif(F.regexp_extract(name, "^urn:page:(-?\\d*)$", 1), F.lit("")).cast("long")
