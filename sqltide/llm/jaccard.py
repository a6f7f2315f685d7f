"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles, as 64-bit hashes; by ``percent``, two link
when ``100 * intersection >= percent * union``.  Equal sets meet by a 128-bit digest first and only
one of them is searched further.

Tokens fall into two classes: frequent ones, in about ``SHARE`` of all documents or more, of which
there can only be a bounded number, and rare ones.  All sets are ordered rare first, then by hash.
If two sets link, their prefixes of ``n - ceil(n * percent / 100) + 2`` tokens share two tokens:
so at least one rare one, or two frequent ones.  Rare prefix tokens are therefore indexed singly,
and frequent ones in combinations of two (singly in sets over ``LARGE``, whose combinations would
be many).  A list of the index never holds more than about ``LIST`` sets of a frequent
combination: longer ones are split into blocks, and all pairs of blocks become lists.

Lists give pairs in two rounds.  In the first each set is paired with the nearest of those before it
in each of its lists, and the nearest few of all lists are verified; their links join most copies into
components.  In the second, all other pairs of a list are verified whose sets lie in different
components and whose sizes, prefix tokens and parities allow a link.  The parities of a set are at
least ``BITS`` bits, and at least as many as it has tokens, each whether an odd number of its tokens
falls there: where two sets' bits differ, some token is in one set only, so sets whose bits differ in
more places than linked sets may differ in tokens can't link, and that shows before a pair leaves
its list.  Sets alike share thousands of lists; each set carries the first ``FIRSTS`` of its own, and
a list leaves a pair to an earlier one that both carry.  No pair that could change a component is
left out.

Null and empty texts have no shingles and link with nothing; so do sets too small to differ.
Texts of fewer words than a shingle are one shingle.  A null id counts as the largest, rows of one
id as one vertex.  Repeated rows link like copies.  An empty table gives no rows.  Other columns
are not read, and come back from :func:`representatives`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqltide.llm.shared import attach, components
from sqltide.llm.substring import NO_ID, pack, rows_of, unpack
from sqltide.llm.vocabulary import slices
from sqltide.llm.words import U, mix, window_hashes, word_hashes
from sqltide.operators.scan import cut

#: A token is frequent from this share of documents on.
SHARE = 1 / 4000
#: Sets over this size index frequent tokens singly; most sets in a list of a combination.
LARGE, LIST = 2000, 20_000
#: Bits of a set's parities, at least; lists of its own that a set carries.
BITS, FIRSTS = 512, 8
#: Tokens counted together in a task; packed entries in a bucket.
FLUSH, PER_BUCKET = 1 << 21, 1 << 18


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of a text's word hashes, sorted."""
    if not len(hashes):
        return hashes
    if len(hashes) < size:
        return window_hashes(np.append(hashes, U(len(hashes))), len(hashes) + 1)
    return np.unique(window_hashes(hashes, size))


def sets_of(batch: pa.Array, size: int) -> Iterator[np.ndarray]:
    for texts in slices(batch):
        hashes, bounds = word_hashes(texts, lower=True)
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield shingles(hashes[a:b], size)


def parities(tokens: np.ndarray) -> bytes:
    """For each of some places, whether an odd number of tokens falls there.  The places are
    ``BITS``, doubled until they are as many as the tokens, 2**24 at most."""
    places = BITS
    while places < min(len(tokens), 1 << 24):
        places *= 2
    return np.packbits(np.bincount((tokens >> U(40)).astype(np.int64) % places,
                                   minlength=places).astype(np.uint8) & 1).tobytes()


def folded(bits: list[bytes | None]) -> tuple[np.ndarray, dict]:
    """How many times ``BITS`` places each has, and for each such number the parities of all that
    have as many or more, on so many places: (row of each, words)."""
    sizes = np.array([len(b or b"") * 8 // BITS for b in bits], dtype=np.int64)
    tables = {}
    for width in np.unique(sizes[sizes > 0]):
        held = np.flatnonzero(sizes >= width)
        words = np.empty((len(held), width * BITS // 64), dtype="<u8")
        # Places are taken modulo a power of two, so halves laid on each other give fewer places.
        for size in np.unique(sizes[held]):
            rows = np.flatnonzero(sizes[held] == size)
            whole = np.frombuffer(b"".join(bits[k] for k in held[rows]), "<u8")
            words[rows] = np.bitwise_xor.reduce(
                whole.reshape(len(rows), size // width, width * BITS // 64), axis=1)
        place = np.zeros(len(bits), dtype=np.int64)
        place[held] = np.arange(len(held))
        tables[width] = place, words
    return sizes, tables


def differing(sizes: np.ndarray, tables: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many places the parities of each pair differ, on as many as both have."""
    apart = np.zeros(len(left), dtype=np.int64)
    both = np.minimum(sizes[left], sizes[right])
    for width, (place, words) in tables.items():
        some = np.flatnonzero(both == width)
        most = max(1, (1 << 19) // words.shape[1])
        for begin in range(0, len(some), most):
            part = some[begin:begin + most]
            apart[part] = np.bitwise_count(
                words[place[left[part]]] ^ words[place[right[part]]]).sum(axis=1, dtype=np.int64)
    return apart


def overlap_needed(n, m, percent: int):
    """Smallest intersection with which sets of these sizes link."""
    return -(-percent * (n + m) // (100 + percent))


def surveyed(rows: DataFrame, size: int) -> DataFrame:
    """(key, row, n, digest, bits) for every row, and (token, count) for tokens frequent in a flush."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, total = [], set(), 0
        for batch in batches:
            sizes, digests, bits = [], [], []
            for tokens in sets_of(batch.column(2), size):
                digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                sizes.append(len(tokens))
                digests.append(digest)
                bits.append(parities(tokens))
                if digest not in seen:
                    seen.add(digest)
                    held.append(tokens)
                    total += len(tokens)
                if total >= FLUSH:
                    yield frequent(held)
                    held, seen, total = [], set(), 0
            yield out(batch.column(0), batch.column(1), sizes, digests, bits, None, None)
        if held:
            yield frequent(held)

    def frequent(held):
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= max(2, len(held) * SHARE / 2)
        return out(None, None, None, None, None, tokens[often].view(np.int64), counts[often])

    def out(key, row, n, digest, bits, token, count):
        size = len(key if key is not None else token)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(size, t) if v is None else v if isinstance(v, pa.Array) else pa.array(v, t)
             for v, t in zip((key, row, n, digest, bits, token, count), kinds, strict=True)],
            ["key", "row", "n", "digest", "bits", "token", "count"])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return rows.mapInArrow(
        survey, "key long, row long, n long, digest binary, bits binary, token long, count long")


def prefix(tokens: np.ndarray, frequent: np.ndarray, percent: int):
    """The rare and the frequent tokens of a set's prefix."""
    n = len(tokens)
    most = min(n, n - -(-percent * n // 100) + 2)
    at = np.searchsorted(frequent, tokens)
    often = frequent[np.minimum(at, len(frequent) - 1)] == tokens if len(frequent) \
        else np.zeros(n, dtype=bool)
    rare = tokens[~often][:most]
    return rare, tokens[often][:most - len(rare)]


def signatures(tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray, percent: int,
               key: int, large: int, most: int) -> tuple[np.ndarray, int]:
    """A set's index entries; the first so many are single tokens, the rest combinations."""
    rare, often = prefix(tokens, frequent, percent)
    single = mix(rare ^ U(1))
    n = len(tokens)
    if 100 * n >= percent * large:
        single = np.concatenate([single, mix(often ^ U(2))])
    if n > large or len(often) < 2:
        return single, len(single)
    i, j = np.triu_indices(len(often), 1)
    pairs = mix(often[i] * U(0x9E3779B97F4A7C15) + often[j])
    df = counts[np.searchsorted(frequent, often)]
    blocks = -(-np.minimum(df[i], df[j]) // most)
    if (blocks > 1).any():
        pairs = np.concatenate([block_pairs(p, int(b), key) for p, b in
                                zip(pairs, blocks, strict=True)])
    return np.concatenate([single, pairs]), len(single)


def block_pairs(signature: np.uint64, blocks: int, key: int) -> np.ndarray:
    """The lists a set joins when a combination's list is split: its block with each block."""
    if blocks <= 1:
        return np.array([signature])
    mine = int(mix(np.array([key], np.int64).view(U))[0]) % blocks
    other = np.arange(blocks, dtype=np.int64)
    pair = np.minimum(other, mine) * blocks + np.maximum(other, mine)
    return mix(signature + mix(pair.astype(U) + U(3)))


def indexed(rows: DataFrame, sent, size: int, percent: int, buckets: int, large: int,
            most: int) -> DataFrame:
    """(bucket, blob) of packed entries of (key, row, text) rows; of equal sets in a flush only
    that with the smallest key is entered."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = {}, 0
        frequent, counts = sent.value
        for batch in batches:
            for key, tokens in zip(batch.column(0).to_pylist(), sets_of(batch.column(2), size),
                                   strict=True):
                if 100 * len(tokens) < percent * (len(tokens) + 1):
                    continue
                digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                if digest in held and held[digest][0] <= key:
                    continue
                marks, singles = signatures(tokens, frequent, counts, percent, key, large, most)
                held[digest] = (key, len(tokens), marks, singles)
                total += len(marks)
                if total >= FLUSH // 2:
                    yield flush(list(held.values()))
                    held, total = {}, 0
        if any(len(h[2]) for h in held.values()):
            yield flush(list(held.values()))

    def flush(held):
        keys = np.array([h[0] for h in held], "<i8")
        sizes = np.array([h[1] for h in held], "<u4")
        doc = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
        marks = np.concatenate([h[2] for h in held])
        kind = np.concatenate([np.arange(len(h[2])) >= h[3] for h in held])
        bucket = (marks % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        ids, blobs = [], []
        for a, b in zip(edges, edges[1:], strict=False):
            part = order[a:b]
            docs, each = np.unique(doc[part], return_counts=True)
            ids.append(int(bucket[part[0]]))
            blobs.append(pack([np.diff(keys[docs], prepend=0), sizes[docs], each.astype("<u4"),
                               marks[part], kind[part].astype("<u1")]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())],
                                          ["bucket", "blob"])

    return rows.mapInArrow(entries, "bucket int, blob binary")


def lists(packed: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(list, kind, key, n) of index lists with at least two sets that may link, by size."""

    def settle(blobs):
        parts = [unpack(b, ["<i8", "<u4", "<u4", "<u8", "<u1"]) for b in blobs]
        doc = np.repeat(np.arange(sum(len(p[0]) for p in parts)),
                        np.concatenate([p[2] for p in parts]))
        key = np.concatenate([np.cumsum(p[0]) for p in parts])[doc]
        n = np.concatenate([p[1] for p in parts]).astype(np.int64)[doc]
        mark, kind = (np.concatenate([p[k] for p in parts]) for k in (3, 4))
        order = np.lexsort((key, n, mark))
        mark, key, n, kind = mark[order], key[order], n[order], kind[order]
        near = (mark[1:] == mark[:-1]) & (100 * n[:-1] >= percent * n[1:])
        keep = np.append(near, False) | np.append(False, near)
        return pa.RecordBatch.from_arrays(
            [pa.array(mark[keep].view(np.int64), pa.int64()), pa.array(kind[keep], pa.int32()),
             pa.array(key[keep], pa.int64()), pa.array(n[keep], pa.int64())],
            ["list", "kind", "key", "n"])

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and blobs:
                    yield settle(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob.as_py())
        if blobs:
            yield settle(blobs)

    return (packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(by_bucket, "list long, kind int, key long, n long"))


def shared_at_most():
    """Prefix tokens that c single ones and f combinations of two stand for, at most."""
    return F.col("c") + F.when(F.col("f") > 0, F.ceil((1 + F.sqrt(1 + 8 * F.col("f"))) / 2)) \
        .otherwise(1)


def neighbours(index: DataFrame, drawn: DataFrame, percent: int, buckets: int,
               few: int = 3) -> DataFrame:
    """(a, b): each set with the ``few`` of those before it in its lists that are nearest to it."""
    alone = index.withColumns({"component": F.col("key"), "most": F.lit(1 << 30).cast("long"),
                               "firsts": F.lit(None).cast("array<long>")})
    found = compared(alone, drawn, percent, buckets, nearest=True).groupBy("a", "b").agg(
        F.min("apart").alias("apart"))
    best = Window.partitionBy("b").orderBy("apart", "a")
    return found.withColumn("place", F.row_number().over(best)).where(
        F.col("place") <= few).select("a", "b")


def remaining(index: DataFrame, known: DataFrame, drawn: DataFrame, percent: int,
              buckets: int) -> DataFrame:
    """(a, b) of all pairs in a list that lie in different components and may link.

    ``drawn`` has the parities (key, n, bits) of all sets.
    """
    own = index.groupBy("key").agg(F.sum(1 - F.col("kind")).alias("c"), F.sum("kind").alias("f"))
    most = own.select("key", shared_at_most().alias("most"))
    tagged = index.join(known.select(F.col("node").alias("key"), "component"), "key", "left") \
        .withColumn("component", F.coalesce("component", "key")).join(most, "key")
    spread = Window.partitionBy("list")
    open_lists = cut(tagged.withColumn(
        "mixed", F.min("component").over(spread) != F.max("component").over(spread))
        .where("mixed").drop("mixed"))
    # By size too: of an id with several sets, another may be in the earlier list.
    firsts = open_lists.groupBy("key", "n").agg(
        F.slice(F.sort_array(F.collect_set("list")), 1, FIRSTS).alias("firsts"))
    return compared(open_lists.join(firsts, ["key", "n"]), drawn, percent, buckets) \
        .select("a", "b").distinct()


def compared(entries: DataFrame, drawn: DataFrame, percent: int, buckets: int,
             nearest: bool = False) -> DataFrame:
    """(a, b, apart): the pairs of each list in different components that may link, with how many
    parities differ.

    ``entries`` are rows (list, key, n, component, most, firsts) of the index; ``most`` bounds the
    prefix tokens that a set can share.  A pair is left to any earlier list that ``firsts`` of both
    sets hold: whether it may link does not hang on the list.  ``nearest``: of each set's pairs,
    that with the fewest differing parities among those it comes last in.
    """
    # An id with several sets of one size has no parities of its own; null lets its pairs pass.
    only = drawn.groupBy("key", "n").agg(F.when(F.min("bits") == F.max("bits"), F.min("bits"))
                                         .alias("bits"))
    sketched = entries.join(only, ["key", "n"], "left")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            rows = batch if tail is None else pa.concat_batches([tail, batch])
            marks = rows.column(0).to_numpy()
            end = int(np.searchsorted(marks, marks[-1])) if len(marks) else 0
            tail = rows.slice(end)
            yield from paired(rows.slice(0, end))
        if tail is not None:
            yield from paired(tail)

    def paired(rows):
        if not len(rows):
            return
        mark, key, n, comp, most = (rows.column(k).to_numpy() for k in range(5))
        bare = rows.column(5).is_null().to_numpy(zero_copy_only=False)
        sizes, tables = folded(rows.column(5).to_pylist())
        firsts = [] if nearest else carried(rows.column(6))
        rest = n - np.minimum(n, n - -(-n * percent // 100) + 2)
        ends = np.searchsorted(mark, mark, side="right")
        # By size within the list: the last that is not too large for each.
        last = np.minimum(ends, np.searchsorted(
            _by_list(mark, n), _by_list(mark, 100 * n // percent), side="right"))
        begin, step = 0, 1 << 20
        counts = np.maximum(0, last - np.arange(len(mark)) - 1)
        sums = np.cumsum(counts)
        while begin < len(mark):
            base = sums[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sums, base + step, side="right")))
            size = counts[begin:end]
            left = np.repeat(np.arange(begin, end), size)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size)
            ok = (comp[left] != comp[right]) & (key[left] != key[right])
            # What either set has in lists at all must allow a link.
            ok &= np.minimum(most[left], most[right]) + np.maximum(rest[left], rest[right]) \
                >= overlap_needed(n[left], n[right], percent)
            left, right = left[ok], right[ok]
            apart = differing(sizes, tables, left, right)
            ok = (apart <= n[left] + n[right] - 2 * overlap_needed(n[left], n[right], percent)) \
                | bare[left] | bare[right]
            left, right, apart = left[ok], right[ok], apart[ok]
            begin = end
            if nearest and len(left):
                order = np.lexsort((left, apart, right))
                order = order[np.flatnonzero(np.diff(right[order], prepend=-1))]
                left, right, apart = left[order], right[order], apart[order]
            earlier = np.zeros(len(left), dtype=bool)
            for x in firsts:
                for y in firsts:
                    earlier |= (x[left] == y[right]) & (x[left] < mark[left])
            left, right, apart = left[~earlier], right[~earlier], apart[~earlier]
            if len(left):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in _once(key[left], key[right], apart)], ["a", "b", "apart"])

    def carried(held):
        """The k-th of the lists that each set carries, for each k; the largest number is none."""
        table = np.full((len(held), FIRSTS), np.iinfo(np.int64).max)
        sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(held)), sizes)
        table[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = \
            held.flatten().to_numpy()
        return list(table.T)

    return (sketched.select("list", "key", "n", "component", "most", "bits", "firsts")
            .repartition(buckets, "list").sortWithinPartitions("list", "n", "key")
            .mapInArrow(pairs, "a long, b long, apart long"))


def _by_list(mark: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sortable numbers: the list's place, then the size."""
    place = np.cumsum(np.diff(mark, prepend=mark[:1]) != 0)
    return (place << 32) + np.minimum(n, (1 << 32) - 1)


def _once(a, b, apart):
    """Equal pairs once, with how many parities differ at least."""
    order = np.lexsort((apart, b, a))
    a, b, apart = a[order], b[order], apart[order]
    fresh = np.flatnonzero((np.diff(a, prepend=a[:1] - 1) != 0) | (np.diff(b, prepend=b[:1]) != 0))
    return a[fresh], b[fresh], apart[fresh]


def verified(pairs: DataFrame, rows: DataFrame, searched: DataFrame, size: int,
             percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the whole sets of their texts."""

    @F.arrow_udf("boolean")
    def links(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left, right, strict=True):
            a, b = (np.frombuffer(x.as_py(), "<u8") for x in (a, b))
            both = len(a) + len(b) - len(np.union1d(a, b))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = cut(sets_for(rows.join(searched.join(wanted, "key"), ["key", "row"]).select(
        "key", "text"), size))
    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    return cut(pairs.join(left, "a").join(right, "b").where(
        links(F.col("x"), F.col("y"))).select("a", "b"))


def sets_for(rows: DataFrame, size: int) -> DataFrame:
    """(key, tokens) with the packed set of each (key, text) row."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t.tobytes() for t in sets_of(batch.column(1), size)],
                                           pa.binary())], ["key", "tokens"])

    return rows.mapInArrow(packed, "key long, tokens binary")


def classes(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id",
            text_col: str = "text", large: int = LARGE, most: int = LIST) -> DataFrame:
    """(key, row, n, component) of every row: its set's size and the smallest id it reaches."""
    rows = rows_of(docs, id_col, text_col)
    survey = cut(surveyed(rows, size))
    known = survey.where("digest is not null").select("key", "row", "n", "digest")
    full = known.where("n > 0")
    drawn = survey.where("digest is not null and n > 0").select("key", "n", "bits")
    groups = cut(full.groupBy("digest").agg(F.min("key").alias("keep"), F.count("*").alias("copies"),
                                            F.max("n").alias("n")))
    total, tokens = groups.agg(F.count("*"), F.sum("n")).first()
    often = (survey.where("token is not null").groupBy("token").agg(F.sum("count").alias("n"))
             .where(F.col("n") >= max(4, (total or 0) * SHARE / 2)).toPandas())
    frequent = often["token"].to_numpy(np.int64).view(U)
    order = np.argsort(frequent)
    sent = docs.sparkSession.sparkContext.broadcast(
        (frequent[order], often["n"].to_numpy(np.int64)[order]))
    members = cut(attach(full.select("key", "row", "digest"), groups.drop("n"), ["digest"],
                         "copies", known.count()))
    searched = cut(members.where("key = keep").select("key", "row").distinct())
    buckets = max(16, (tokens or 0) * (100 - percent) // 100 // PER_BUCKET)
    index = cut(lists(indexed(rows, sent, size, percent, buckets, large, most),
                      percent, buckets).join(searched.select("key").distinct(), "key", "left_semi"))
    edges = verified(cut(neighbours(index, drawn, percent, buckets)), rows, searched, size, percent)
    left = cut(remaining(index, components(edges), drawn, percent, buckets))
    if not left.isEmpty():
        edges = edges.unionByName(verified(left, rows, searched, size, percent))
    same_id = members.where("key <> keep").select(F.col("keep").alias("a"), F.col("key").alias("b"))
    found = components(edges.unionByName(same_id.distinct()))
    return known.join(found.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "row", "n", F.coalesce("component", "key").alias("component"))


def report(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, n, component) of every row; null ids come back as null."""
    number = lambda c: F.expr(f"nullif({c}, {NO_ID})")
    return classes(docs, size, percent, id_col, text_col).select(
        number("key").alias("id"), "n", number("component").alias("component"))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class, with all columns."""
    dropped = classes(docs, size, percent, id_col, text_col).where(
        "key <> component").select(F.col("key").alias("dropped")).distinct()
    key = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID))
    return docs.join(dropped, key == dropped["dropped"], "left_anti")
