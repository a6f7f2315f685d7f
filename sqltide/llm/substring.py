"""Substring dedup by difference-cover anchors.

Of each window of ``window`` consecutive words that also starts in a document with a smaller id,
all words go.  Let D be a difference cover modulo m: any two positions have a shift below m that
takes both, modulo m, into D.  So two equal windows have, at one common shift, equal anchors of
``window - m + 1`` words that both start at positions in D modulo m, and only these |D| / m of
all positions are hashed and compared at first.  Where an anchor occurs in two documents, it is
extended: the windows around it are hashed in full (128 bits) and met by their hash, the smallest
id of which wins.

Before that, documents with equal words meet by SHA-256: all but the one with the smallest id go
whole (from ``window`` words on), and only that one is searched.  Both meetings combine in the
sending task first, so of a hash each task sends one document's rows, however many hold it, and
hashes travel packed, many to a row.

A null text has no words.  A null id counts as larger than all others; rows of one id are one
document and don't remove each other's words.  Equal rows have equal results.  An empty table
gives no rows.  Columns other than id and text are not read, and come back from :func:`dedup`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltide.llm.shared import attach, cut
from sqltide.llm.vocabulary import slices
from sqltide.llm.words import ONE, TWO, ranges, window_hashes, word_hashes

WINDOW = 50
NO_ID = (1 << 63) - 1
#: Packed entries in a bucket, at about 12 bytes each.
PER_BUCKET = 1 << 19
BLOBS = "bucket int, key long, row long, blob binary"


def difference_cover(period: int) -> list[int]:
    """A small set with every difference modulo ``period``: by search for small periods, else a
    run and the multiples of its length."""
    everything = set(range(period))
    if period <= 31:
        for size in range(1, 7):
            for rest in combinations(range(1, period), size - 1):
                cover = (0, *rest)
                if {(a - b) % period for a in cover for b in cover} == everything:
                    return list(cover)
    run = int(period ** 0.5) + 1
    return sorted({*range(min(run, period)), *range(0, period, run), period - 1})


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, row, text): the id, null as the largest, and a hash that tells rows of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"),
                       F.xxhash64(text).alias("row"), text.alias("text"))


def summaries(rows: DataFrame) -> DataFrame:
    """(key, row, n_words, digest) of every row; the digest is of the words joined by spaces."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests = [], []
            for text in batch.column(2):
                words = text.as_py().encode().split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()),
                 pa.array(digests, pa.binary())], ["key", "row", "n_words", "digest"])

    return rows.mapInArrow(summed, "key long, row long, n_words long, digest binary")


def pack(arrays: list[np.ndarray]) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], "<u4").tobytes(),
                     *(a.tobytes() for a in arrays)])


def unpack(blob: bytes, types: list[str]) -> list[np.ndarray]:
    out, at = [], 4 * len(types)
    for kind, n in zip(types, np.frombuffer(blob, "<u4", len(types)), strict=True):
        out.append(np.frombuffer(blob, kind, int(n), at))
        at += out[-1].nbytes
    return out


class Sender:
    """Entries (hash, more, document, position) of a task.  Flushed: of each hash, the entries of
    one document go to its bucket; what the task's own documents settle comes back at once."""

    def __init__(self, buckets: int, keep: str, most: int = 1 << 19):
        self.buckets, self.keep, self.most = buckets, keep, most
        self._clear()

    def _clear(self) -> None:
        self.parts, self.keys, self.rows, self.held = [], [], [], 0

    def add(self, key: int, row: int, where: np.ndarray, one: np.ndarray,
            two: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((one, two, np.full(len(where), len(self.keys)), where))
        self.keys.append(key)
        self.rows.append(row)
        self.held += len(where)
        if self.held >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        one, two, doc, where = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        keys, rows = np.array(self.keys, "<i8"), np.array(self.rows, "<i8")
        self._clear()
        settled, send = meet(one, two, keys[doc], self.keep)
        yield marks(keys, rows, doc[settled], where[settled])
        bucket = (one[send] % np.uint64(self.buckets)).astype(np.int64)
        order = send[np.argsort(bucket, kind="stable")]
        bucket.sort()
        out = []
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:], strict=False):
            part = order[a:b]
            part = part[np.argsort(doc[part], kind="stable")]
            docs, counts = np.unique(doc[part], return_counts=True)
            out.append((int(bucket[a]), pack([
                np.diff(keys[docs], prepend=0), rows[docs] if self.keep == "least" else rows[:0],
                counts.astype("<u4"), where[part].astype("<u4"),
                (one[part] & np.uint64(0xFFFFFFFF)).astype("<u4"),
                (one[part] >> np.uint64(32)).astype("<u4" if self.keep == "least" else "<u2"),
                two[part] if len(two) else two])))
        yield batch([o[0] for o in out], [None] * len(out), [None] * len(out),
                    [o[1] for o in out])


def meet(one, two, key, keep: str) -> tuple[np.ndarray, np.ndarray]:
    """Entries settled here, and those that other tasks must see.

    ``shared``: entries whose hash two documents hold are settled; the first document's entries
    of each hash go on.  ``least``: entries of others than a hash's smallest document are
    settled; the smallest's go on.
    """
    order = np.lexsort((key, two, one)) if len(two) else np.lexsort((key, one))
    one, key = one[order], key[order]
    fresh = np.diff(one, prepend=~one[:1]) != 0
    if len(two):
        fresh |= np.diff(two[order], prepend=two[order][:1]) != 0
    first = np.flatnonzero(fresh)
    of = np.cumsum(fresh) - 1
    least = key == key[first][of]
    if keep == "least":
        return order[~least], order[least]
    last = np.append(first[1:], len(one)) - 1
    both = (key[first] != key[last])[of]
    return order[both], order[least]


def batch(bucket, key, row, blob) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(key, pa.int64()), pa.array(row, pa.int64()),
         pa.array(blob, pa.binary())], ["bucket", "key", "row", "blob"])


def marks(keys, rows, doc, where) -> pa.RecordBatch:
    """One row per document with the positions that are settled."""
    order = np.lexsort((where, doc))
    doc, where = doc[order], where[order].astype("<u4")
    edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
    docs = doc[edges[:-1]]
    return batch([None] * len(docs), keys[docs], rows[docs],
                 [where[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)])


def met(sent: DataFrame, buckets: int, keep: str) -> DataFrame:
    """(key, row, blob): positions that meeting in buckets, or the sender, has settled."""

    def settle(blobs: list[bytes]) -> pa.RecordBatch:
        wide = "<u4" if keep == "least" else "<u2"
        parts = [unpack(b, ["<i8", "<i8", "<u4", "<u4", "<u4", wide, "<u8"]) for b in blobs]
        keys = np.concatenate([np.cumsum(p[0]) for p in parts])
        rows = np.concatenate([p[1] for p in parts]) if keep == "least" else np.zeros(len(keys))
        doc = np.repeat(np.arange(len(keys)), np.concatenate([p[2] for p in parts]))
        where = np.concatenate([p[3] for p in parts])
        one = np.concatenate([p[4].astype("<u8") | p[5].astype("<u8") << np.uint64(32)
                              for p in parts])
        settled, _ = meet(one, np.concatenate([p[6] for p in parts]), keys[doc], keep)
        return marks(keys, rows.astype("<i8"), doc[settled], where[settled])

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for rows in batches:
            direct = rows.filter(rows.column(1).is_valid())
            if len(direct):
                yield direct
            for bucket, blob in zip(rows.column(0), rows.column(3), strict=True):
                bucket = bucket.as_py()
                if bucket is None:
                    continue
                if bucket != now and blobs:
                    yield settle(blobs)
                    blobs = []
                    pa.default_memory_pool().release_unused()
                now = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield settle(blobs)

    spread = F.coalesce("bucket", F.pmod(F.xxhash64("key", "row"), F.lit(buckets)).cast("int"))
    return (sent.repartition(buckets, spread).sortWithinPartitions("bucket")
            .mapInArrow(by_bucket, BLOBS).drop("bucket"))


def anchors(searched: DataFrame, window: int, buckets: int) -> DataFrame:
    """Hashes at cover positions of (key, text) rows, for :func:`met`."""
    period = max(1, window * 31 // 50)
    cover = np.array(difference_cover(period))
    length = window - period + 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets, "shared")
        none = np.zeros(0, "<u8")
        for rows in batches:
            keys, at = rows.column(0).to_pylist(), 0
            for texts in slices(rows.column(1)):
                hashes, bounds = word_hashes(texts)
                every = window_hashes(hashes, length) & np.uint64(0xFFFFFFFFFFFF)
                for k in range(len(texts)):
                    last = bounds[k + 1] - bounds[k] - length
                    where = (np.arange(0, last + 1, period)[:, None] + cover).ravel()
                    where = where[where <= last]
                    if len(where):
                        yield from sender.add(keys[at + k], 0, where,
                                              every[bounds[k] + where], none)
                at += len(texts)
        yield from sender.flush()

    return searched.mapInArrow(found, BLOBS)


def around(marked: DataFrame, window: int, buckets: int) -> DataFrame:
    """Full hashes of the windows around shared anchors of (key, row, text, blobs) rows."""
    period = max(1, window * 31 // 50)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets, "least")
        for rows in batches:
            keys, tags = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            blobs, at = rows.column(3), 0
            for texts in slices(rows.column(2)):
                hashes, bounds = word_hashes(texts)
                one = window_hashes(hashes, window)
                two = window_hashes(word_hashes(texts, kind=1)[0], window, TWO)
                for k in range(len(texts)):
                    anchor = np.frombuffer(b"".join(blobs[at + k].as_py()), "<u4").astype(int)
                    n = int(bounds[k + 1] - bounds[k]) - window + 1
                    near = np.zeros(max(n, 0) + 1, dtype=np.int64)
                    np.add.at(near, np.clip(anchor - period + 1, 0, max(n, 0)), 1)
                    np.add.at(near, np.clip(anchor + 1, 0, max(n, 0)), -1)
                    where = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                    if len(where):
                        yield from sender.add(keys[at + k], tags[at + k], where,
                                              one[bounds[k] + where], two[bounds[k] + where])
                at += len(texts)
        yield from sender.flush()

    return marked.mapInArrow(found, BLOBS)


def gathered(settled: DataFrame, keys: list[str]) -> DataFrame:
    """All marks of each document in one row; they are no more than its words."""
    return settled.groupBy(*keys).agg(F.collect_list("blob").alias("blobs"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            window: int = WINDOW) -> DataFrame:
    """(key, row, whole, blobs) of the rows that lose words: all of them, or those covered by the
    windows that start at the packed positions."""
    rows = rows_of(docs, id_col, text_col)
    known = cut(summaries(rows))
    long = known.where(F.col("n_words") >= window)
    groups = cut(long.groupBy("digest").agg(F.min("key").alias("keep"), F.count("*").alias("n")))
    total, words = long.agg(F.count("*"), F.sum("n_words")).first()
    status = cut(attach(long, groups, ["digest"], "n", total).select(
        "key", "row", (F.col("key") > F.col("keep")).alias("whole")).distinct())
    buckets = max(48, (words or 0) // 5 // PER_BUCKET)
    searched = status.where("not whole").select("key", "row")
    shared = met(anchors(rows.join(searched, ["key", "row"]).select("key", "text"), window, buckets),
                 buckets, "shared")
    marked = gathered(shared, ["key"]).join(searched, "key")
    windows = around(rows.join(marked, ["key", "row"]).select("key", "row", "text", "blobs"),
                     window, buckets)
    covered = gathered(met(windows, buckets, "least"), ["key", "row"])
    copies = status.where("whole").select("key", "row", F.lit(True).alias("whole"),
                                          F.expr("cast(array() as array<binary>)").alias("blobs"))
    return copies.unionByName(covered.select("key", "row", F.lit(False).alias("whole"), "blobs"))


def kept_text(text: Column, whole: Column, blobs: Column, window: int = WINDOW) -> Column:
    """Struct of n_words, n_removed and the words that stay, joined by one space."""

    @F.arrow_udf("n_words long, n_removed long, text string")
    def strip(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, gone, starts in batches:
            counts, removed, out = [], [], []
            for text, all_of_it, packed in zip(texts, gone, starts, strict=True):
                words = (text.as_py() or "").encode().split()
                counts.append(len(words))
                if all_of_it.as_py():
                    words = []
                elif packed.is_valid:
                    where = np.unique(np.frombuffer(b"".join(packed.as_py()), "<u4")).astype(int)
                    drop = np.zeros(len(words), dtype=bool)
                    drop[ranges(where, np.full(len(where), window))] = True
                    words = [w for w, d in zip(words, drop, strict=True) if not d]
                removed.append(counts[-1] - len(words))
                out.append(b" ".join(words).decode())
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(out, pa.string())], ["n_words", "n_removed", "text"])

    return strip(text, whole, blobs)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, text) of every row, the text being what is left."""
    rows = rows_of(docs, id_col, text_col)
    left = rows.join(repeats(docs, id_col, text_col, window), ["key", "row"], "left")
    return left.withColumn("left", kept_text(F.col("text"), F.col("whole"), F.col("blobs"), window)
                           ).select(F.expr(f"nullif(key, {NO_ID})").alias("id"), "left.*")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          window: int = WINDOW) -> DataFrame:
    """``docs`` with all columns; texts that lose words have the rest joined by one space."""
    found = repeats(docs, id_col, text_col, window).select(
        *[F.col(c).alias(f"met_{c}") for c in ("key", "row", "whole", "blobs")])
    text = F.coalesce(docs[text_col], F.lit(""))
    keyed = (F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)) == found["met_key"]) \
        & (F.xxhash64(text) == found["met_row"])
    met_docs = docs.join(found, keyed, "left")
    rest = F.when(found["met_key"].isNull(), docs[text_col]).otherwise(
        kept_text(docs[text_col], found["met_whole"], found["met_blobs"], window)["text"])
    return met_docs.select(*[rest.alias(c) if c == text_col else docs[c] for c in docs.columns])
