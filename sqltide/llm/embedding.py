"""Embedding near-dedup by spherical-cap filters.

A product code of ``BLOCKS`` random codebooks gives ``codewords ** BLOCKS`` filter directions: one
codeword of each block after a random rotation.  Each vector is list-decoded to the ``lists``
directions it is closest to, that is, to all whose cap reaches to it; the caps' height follows the
vector, so none is left without filters.  One height for all vectors was tried: product codes give
some vectors hundreds of directions and others none, so at equal traffic a pair just at 0.93 shares
a filter with probability 0.46 over 2,401 directions, where following heights give 0.99.  The code
grows with the rows, so that buckets don't, and the lists with the code, so that recall holds.
Vectors of a label that share a filter are compared in full, by cosine in double precision.

Equal vectors of a label meet first and are searched once.  A bucket of more than ``block``
vectors is split into blocks, and each pair of blocks is compared by itself.  Pairs are counted in
the first filter that they share and never leave their task: it puts out each vector's number of
links and a spanning forest.

Links below the threshold are never reported.  At the defaults and 64 components, a pair just at
0.93 shares a filter with probability 0.998 among 5,000 vectors of a label, 0.984 among 100,000, 0.958
among a million, 0.972 among 10 million and 0.986 among 100 million; a pair at 0.97 with at least 0.995
at all of these sizes, nearer ones all but surely.  A vector travels once for each of its filters:
10 up to half a million vectors of a label, 12 at a million, 48 at 100 million.

Null vectors, null labels, zero vectors, and vectors with null or non-finite components link with
nothing; so do vectors of different length.  Rows with a null id have a class of their own unless
linked, and null ids count as largest.  Repeated rows are vectors of their own.  An empty table
gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltide.llm.shared import attach, components, cut

BLOCKS, LISTS, BUCKET, BLOCK = 4, 10, 512, 1024
#: Buckets that are split are known by one of this many classes, so that their table has a bound.
SPLIT_CLASSES = 1 << 20
NO_ID = (1 << 63) - 1


@functools.lru_cache(maxsize=8)
def code(length: int, codewords: int) -> np.ndarray:
    """For each block, its directions: (BLOCKS, codewords, length), of a seeded random code."""
    rng = np.random.default_rng(length * 1_000_003 + codewords)
    turn = np.linalg.qr(rng.standard_normal((length, length)))[0]
    out = np.zeros((BLOCKS, codewords, length))
    for k, part in enumerate(np.array_split(np.arange(length), BLOCKS)):
        if len(part):
            words = rng.standard_normal((codewords, len(part)))
            out[k] = words / np.linalg.norm(words, axis=1, keepdims=True) @ turn[part]
    return out


def code_size(rows: int, lists: int = LISTS) -> tuple[int, int]:
    """Codewords of a block and filters of a vector, for the most rows of one label."""
    while True:
        codewords = max(4, int(np.ceil((rows * lists / BUCKET) ** (1 / BLOCKS))))
        grown = int(np.ceil(0.85 * codewords))
        if grown <= lists:
            return codewords, lists
        lists = grown


def best_sums(a, a_ids, b, b_ids, scale: int, most: int):
    """The ``most`` largest sums of one entry of each side, with ids ``a_id * scale + b_id``.

    Both sides are sorted from the largest, so the pair (i, j) can only be among them if
    (i + 1) * (j + 1) is at most ``most``.
    """
    i, j = np.divmod(np.arange(a.shape[1] * b.shape[1]), b.shape[1])
    near = (i + 1) * (j + 1) <= most
    i, j = i[near], j[near]
    sums, ids = a[:, i] + b[:, j], a_ids[:, i] * scale + b_ids[:, j]
    order = np.argsort(-sums, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(sums, order, 1), np.take_along_axis(ids, order, 1)


def decode(unit: np.ndarray, codewords: int, lists: int) -> np.ndarray:
    """The filters of unit vectors, each row's sorted by number."""
    sides = []
    for words in code(unit.shape[1], codewords):
        score = unit @ words.T
        order = np.argsort(-score, axis=1, kind="stable")[:, :lists]
        sides.append((np.take_along_axis(score, order, 1), order))
    (a, i), (b, j), (c, k), (d, m) = sides
    left = best_sums(a, i, b, j, codewords, lists)
    right = best_sums(c, k, d, m, codewords, lists)
    return np.sort(best_sums(*left, *right, codewords ** 2, lists)[1], axis=1)


def described(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(key, label, node, vector): ``node`` is a 64-bit hash of label and content, null where a
    vector can't link; ``vector`` is packed, as floats where that loses nothing."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, blobs = [], []
            for label, vector in zip(batch.column(1), batch.column(2), strict=True):
                values = vector.as_py()
                node = blob = None
                if label.is_valid and values and None not in values:
                    x = np.array(values, dtype="<f8")
                    if np.isfinite(x).all() and x.any():
                        x = x + 0.0  # one zero
                        with np.errstate(over="ignore"):
                            single = x.astype("<f4")
                        small = (single == x).all()
                        blob = b"fd"[not small:][:1] + (single if small else x).tobytes()
                        node = int.from_bytes(hashlib.blake2b(
                            label.as_py().encode() + b"\0" + blob, digest_size=8).digest(),
                            "little", signed=True)
                nodes.append(node)
                blobs.append(blob)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()),
                 pa.array(blobs, pa.binary())], ["key", "label", "node", "vector"])

    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"),
                          F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(packed, "key long, label string, node long, vector binary")


def unpacked(blobs) -> np.ndarray:
    return np.array([np.frombuffer(b, "<f4" if b[:1] == b"f" else "<f8", offset=1)
                     for b in blobs], dtype=np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def filter_kind(codewords: int) -> str:
    return "<u4" if codewords ** BLOCKS <= 1 << 32 else "<i8"


def filtered(nodes: DataFrame, codewords: int, lists: int) -> DataFrame:
    """(label, node, copies, vector) with the number of components and all filters, as array and
    packed."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256).to_pandas()
                for length, rows in part.groupby(part["vector"].str.len() * 2 + (
                        part["vector"].str[:1] == b"f"), sort=True):
                    found = decode(unit(unpacked(rows["vector"])), codewords, lists)
                    width = 4 if length % 2 else 8
                    out = rows.assign(
                        length=(len(rows["vector"].iloc[0]) - 1) // width,
                        at=list(found), filters=[f.tobytes() for f in found.astype(
                            filter_kind(codewords))])
                    yield pa.RecordBatch.from_pandas(out[FILTERED], preserve_index=False)

    return nodes.mapInArrow(listed, "label string, node long, copies long, vector binary, "
                                    "length long, at array<long>, filters binary")


FILTERED = ["label", "node", "copies", "vector", "length", "at", "filters"]


def fresh_pairs(lists: np.ndarray, i: np.ndarray, j: np.ndarray, here: int) -> np.ndarray:
    """Which pairs of rows have no filter below ``here`` in common."""
    out = np.ones(len(i), dtype=bool)
    step = max(1, (1 << 22) // lists.shape[1] ** 2)
    for at in range(0, len(i), step):
        one, two = lists[i[at:at + step]], lists[j[at:at + step]]
        same = (one[:, :, None] == two[:, None, :]).any(axis=2)
        out[at:at + step] = ~(same & (one < here)).any(axis=1)
    return out


def compare(node, copies, vectors, filters, block, here: int, apart: bool, least: float,
            kind: str):
    """A bucket, or two of its blocks (``apart``), of filter ``here``: (a, b, links) with each
    vector's links that no smaller filter has, and edges (a, b) that span their components."""
    x = unit(unpacked(vectors))
    linked = x @ x.T >= least
    np.fill_diagonal(linked, False)
    if apart:
        linked &= block[:, None] != block[None, :]
    if not linked.any():
        return None
    i, j = np.nonzero(np.triu(linked))
    seen = ~fresh_pairs(np.frombuffer(b"".join(filters), kind).reshape(len(node), -1), i, j, here)
    linked[i[seen], j[seen]] = linked[j[seen], i[seen]] = False
    links = linked @ copies
    root, fresh = np.arange(len(node)), np.ones(len(node), dtype=bool)
    for k in np.flatnonzero(links):
        if not fresh[k]:
            continue
        front = np.array([k])
        fresh[k] = False
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & fresh)
            fresh[front] = False
            root[front] = k
    kept = links > 0
    return node[root[kept]], node[kept], links[kept]


def compared(entries: DataFrame, bucket: list[str], least: float, kind: str) -> DataFrame:
    """(a, b, links) of all buckets; a partition goes through its own one by one."""

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            rows = batch if tail is None else pa.concat_batches([tail, batch])
            edges = borders(rows)
            tail = rows.slice(edges[-2])
            yield from results(rows, edges[:-1])
        if tail is not None:
            yield from results(tail, np.array([0, len(tail)]))

    def borders(rows):
        change = np.zeros(len(rows) - 1, dtype=bool)
        for k in range(len(bucket)):
            change |= differs(rows.column(k))
        return np.concatenate([[0], np.flatnonzero(change) + 1, [len(rows)]])

    def results(rows, edges):
        node, copies, block = (rows.column(k).to_numpy().astype(np.int64)
                               for k in range(len(bucket), len(bucket) + 3))
        vectors, filters = (rows.column(k).to_pylist() for k in (-2, -1))
        here, one, two = (rows.column(k).to_numpy() for k in (2, 3, 4))
        found = []
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                out = compare(node[a:b], copies[a:b], vectors[a:b], filters[a:b], block[a:b],
                              int(here[a]), bool(one[a] != two[a]), least, kind)
                if out:
                    found.append(out)
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)],
                ["a", "b", "links"])

    return (entries.select(*bucket, "node", "copies", "block", "vector", "filters")
            .repartition(*bucket).sortWithinPartitions(*bucket, "node")
            .mapInArrow(by_bucket, "a long, b long, links long"))


def differs(values: pa.Array) -> np.ndarray:
    """Where an entry differs from the one before it."""
    return pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(
        zero_copy_only=False)


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label", lists: int = LISTS,
                    block: int = BLOCK) -> DataFrame:
    """(id, n_links, component, kept) of every row."""
    rows = cut(described(vectors, id_col, vector_col, label_col))
    groups = cut(rows.where("node is not null").groupBy("label", "node", "vector").agg(
        F.count("*").alias("copies")))
    of_label = groups.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    codewords, lists = code_size(of_label, lists)
    nodes = cut(filtered(groups, codewords, lists))
    bucket = ["label", "length", "filter"]
    split_class = F.pmod(F.xxhash64(*bucket), F.lit(SPLIT_CLASSES)).alias("split_class")
    splits = cut(nodes.select("label", "length", F.explode("at").alias("filter"))
                 .groupBy(*bucket).agg(F.count("*").alias("size")).where(F.col("size") > block)
                 .groupBy(split_class).agg(F.ceil(F.max("size") / block).cast("int").alias("split")))
    sized = (nodes.select("label", "length", F.explode("at").alias("filter"), "node", "copies", "vector",
                          "filters")
             .withColumn("split_class", split_class)
             .join(F.broadcast(splits), "split_class", "left")
             .withColumn("split", F.coalesce("split", F.lit(1)))
             .withColumn("block", F.pmod(F.xxhash64("node"), "split").cast("int"))
             .withColumn("other", F.explode(F.expr("sequence(0, split - 1)")))
             .withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")))
    found = cut(compared(sized, [*bucket, "one", "two"], least, filter_kind(codewords)))
    links = found.groupBy(F.col("b").alias("node")).agg(F.sum("links").alias("links"))
    copies = groups.select("node", "copies").join(links, "node", "left").join(
        components(found.where("a <> b").select("a", "b")), "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("class"), "copies")
    named = attach(rows.where("node is not null").select("key", "node"), cut(copies), ["node"],
                   "copies", rows.count())
    smallest = named.groupBy("class").agg(F.min("key").alias("least"), F.count("*").alias("members"))
    out = attach(cut(named), cut(smallest), ["class"], "members", rows.count()).select(
        "key", "n_links", "least")
    alone = rows.where("node is null").select("key", F.lit(0).cast("long").alias("n_links"),
                                              F.col("key").alias("least"))
    number = lambda c: F.expr(f"nullif({c}, {NO_ID})")
    return out.unionByName(alone).select(
        number("key").alias("id"), "n_links", number("least").alias("component"),
        (F.col("key") == F.col("least")).alias("kept"))
