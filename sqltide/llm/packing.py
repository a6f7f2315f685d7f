"""Best-fit packing with bound-certified repacking.

Documents become token ids and an end id; longer ones are cut into full pieces and a rest.  The
pieces are dealt over partitions of about ``PER_PARTITION`` pieces, and each partition packs its
own by best-fit decreasing.  Lower bounds by dual feasible functions certify each partition's
number of sequences and that of the whole.  Then partitions exchange in rounds.  A partition that
meets its bound keeps all sequences but those with over a 64th of their room left; one with a gap
keeps only its full ones.  All others, however many, are dealt anew over pools of about
``PER_PARTITION`` pieces; each pool is packed anew unless its bound certifies it, and the better of
old and new stays.  Rounds end when the bound of the whole is met, after a round of a single pool,
or when two rounds in a row have each closed less than a hundredth of the gap to that bound.

A null text counts as empty and still has its end id.  Rows repeated with the same id, or with a
null id, are packed each on its own.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltide.llm.shared import cut
from sqltide.llm.vocabulary import encoder, slices

PER_PARTITION = 4096
#: Bytes of text encoded together: what a step costs whatever the number of its words weighs less.
TOGETHER = 1 << 21
PIECES = "id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", offset long, level int, part long, bin long, loose boolean"


def pieces(docs: DataFrame, path: str, end_id: int, most: int = 4096, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, crc of the ids, and the ids if wanted."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1), TOGETHER):
                flat, start = coder.encode(texts)
                keys = batch.column(0).slice(at, len(texts))
                at += len(texts)
                yield rows(keys, flat.astype("<u4"), start)

    def rows(keys, flat, start):
        owner, piece, begin, length, crc, ids = [], [], [], [], [], []
        for k, (a, b) in enumerate(zip(start, start[1:], strict=False)):
            whole = np.append(flat[a:b], np.uint32(end_id))
            for n, first in enumerate(range(0, len(whole), most)):
                part = whole[first:first + most]
                owner.append(k)
                piece.append(n)
                begin.append(first)
                length.append(len(part))
                crc.append(zlib.crc32(part.tobytes()))
                ids.append(part.astype(np.int32)) if with_ids else None
        columns = [keys.take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                   pa.array(begin, pa.int64()), pa.array(length, pa.int64()),
                   pa.array(crc, pa.int64())]
        names = ["id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(cut_up, PIECES + (", ids array<int>" if with_ids else ""))


def best_fit_decreasing(lengths: np.ndarray, room: int) -> np.ndarray:
    """The bin of each length: the longest first, each into the fullest bin that takes it."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    free, made = 0, 0  # bit r of free: a bin with r left is open
    for k in np.argsort(-lengths, kind="stable"):
        size = int(lengths[k])
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = open_bins[left].pop()
            if not open_bins[left]:
                free ^= 1 << left
        else:
            at, left = made, room
            made += 1
        bins[k] = at
        left -= size
        if left:
            if not open_bins[left]:
                free |= 1 << left
            open_bins[left].append(at)
    return bins


def lower_bound(lengths: np.ndarray, room: int) -> int:
    """No packing has fewer bins: the best of two families of dual feasible functions.

    The first counts lengths above ``room - e`` as whole bins and drops those under ``e``; the
    second rounds each length down to multiples of ``room / (k + 1)``, scaled by ``1 / k``.
    """
    return bound_of_counts(np.bincount(lengths, minlength=room + 1), room)


def bound_of_counts(count: np.ndarray, room: int) -> int:
    """The lower bound from the number of pieces of each length."""
    if not count.any():
        return 0
    number = np.concatenate([[0], np.cumsum(count)])
    weight = np.concatenate([[0], np.cumsum(count * np.arange(room + 1))])
    e = np.arange(0, room // 2 + 1)
    large = number[-1] - number[room - e + 1]
    middle = weight[room - e + 1] - weight[e]
    best = int((large + -(-middle // room)).max())
    size = np.arange(room + 1)
    for k in range(1, 21):
        exact = (k + 1) * size % room == 0
        scaled = np.where(exact, size * k, (k + 1) * size // room * room)
        best = max(best, -(-int((count * scaled).sum()) // (room * k)))
    return best


def pack(pieces: DataFrame, room: int = 4096, per_partition: int = PER_PARTITION) -> DataFrame:
    """``pieces`` with sequence_id and offset; each sequence is gapless and at most ``room``.

    Pieces are dealt by a row number that the cut keeps, so rows without an id and repeated rows
    spread like all others; which sequence a piece lands in depends on how the table is stored.
    """
    pieces = cut(pieces.withColumn("__row", F.monotonically_increasing_id()))
    count = np.zeros(room + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():
        count[r.length] = r["count"]
    least, parts = bound_of_counts(count, room), max(1, -(-int(count.sum()) // per_partition))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("__row"), F.lit(parts))).drop("__row")
    placed = cut(dealt.groupBy("part").applyInPandas(lambda rows: packed(rows, room), PLACED))
    settled, level, idle = [], 0, 0
    had = made = 0
    while parts > 1 and idle < 2:
        now = placed.agg(F.count_if(F.col("offset") == 0).alias("bins"),
                         F.count_if("loose").alias("loose"),
                         F.count_if(F.col("loose") & (F.col("offset") == 0)).alias("loose_bins")).first()
        if level:
            idle = idle + 1 if (had - now.bins) * 100 < made - least or had == now.bins else 0
            made -= had - now.bins
        else:
            made = now.bins
        if made <= least or now.loose_bins < 2 or idle == 2:
            break
        had, level = now.loose_bins, level + 1
        parts = -(-now.loose // per_partition)
        settled.append(placed.where("not loose"))
        pool = placed.where("loose").withColumn("pool", F.pmod(
            F.xxhash64("level", "part", "bin", F.lit(level)), F.lit(parts)))
        placed = cut(pool.groupBy("pool").applyInPandas(_at(level, room), PLACED))
    for rows in settled:
        placed = placed.unionByName(rows)
    number = F.shiftleft(F.col("level").cast("long"), 52) + F.shiftleft("part", 20) + F.col("bin")
    return placed.select("id", "piece", "start", "length", "ids_crc32",
                         number.alias("sequence_id"), "offset")


def _at(level: int, room: int):
    return lambda pool: repacked(pool, room, level)


def packed(rows: pd.DataFrame, room: int) -> pd.DataFrame:
    """A partition packed by best-fit decreasing; its order doesn't depend on how rows arrive."""
    rows = rows.sort_values(["length", "id", "piece", "ids_crc32"], ignore_index=True)
    return _placed(rows.assign(level=0), best_fit_decreasing(rows["length"].to_numpy(), room), room)


def repacked(pool: pd.DataFrame, room: int, level: int) -> pd.DataFrame:
    """Open sequences of several partitions: packed anew unless the bound certifies them, and
    as they were if that saves none."""
    pool = pool.sort_values(["length", "id", "piece", "ids_crc32"], ignore_index=True)
    lengths = pool["length"].to_numpy()
    old = pool.groupby(["level", "part", "bin"], sort=True).ngroup().to_numpy()
    bins, had = old, int(old.max()) + 1
    if had > lower_bound(lengths, room):
        new = best_fit_decreasing(lengths, room)
        if int(new.max()) + 1 < had:
            bins = new
    return _placed(pool.assign(part=pool["pool"], level=level).drop(columns="pool"), bins, room)


def _placed(rows: pd.DataFrame, bins: np.ndarray, room: int) -> pd.DataFrame:
    """Places within bins, and the bins marked for exchange: if the bound certifies their number,
    those with over a sixty-fourth of their room left, else all that aren't full."""
    lengths = rows["length"].to_numpy()
    left = room - np.bincount(bins, lengths).astype(np.int64)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.flatnonzero(np.diff(bins[order], prepend=-1))
    base = np.repeat((ends - lengths[order])[first], np.diff(first, append=len(order)))
    offset = np.empty(len(rows), dtype=np.int64)
    offset[order] = ends - lengths[order] - base
    loose = left > (room // 64 if len(left) <= lower_bound(lengths, room) else 0)
    return rows.assign(offset=offset, bin=bins, loose=loose[bins])
