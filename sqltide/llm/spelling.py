"""Spelling variant grouping by bidirectional FM-index search schemes.

Two words are near if one inserted, deleted or replaced letter parts them.  Then either they share
the left half of the first exactly and the error lies right of it, or they share its right half
and the error lies left of it.  So words are dealt to shards by halves: a word is indexed under
every beginning and end that can be the half of a word one letter shorter, equal or longer, and
asks under its own two halves.  A shard builds a bidirectional FM-index over its words, matches
the exact half from the middle outwards, and extends across the other half with one error.
Both schemes find disjoint pairs, so counts add up.

A half with more words than a shard holds is split: its words into blocks, and each of its
askers goes to every block.  No pairs travel, only each asker's count and best neighbour.

A word's form is its near word of largest count, of equal ones the smallest in code-point
order, if that has at least ``factor`` times the word's own count.  Counts grow by that factor
along forms, so roots are found by doubling in rounds that grow with the logarithm of the
logarithm of the largest count.

A null text has no words.  A null id counts as an empty one.  Repeated rows count each.  An empty
table gives no rows.  Other columns are not read.  Words of any length are handled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltide.llm.fm_index import BidirectionalIndex
from sqltide.operators.scan import MAX_BROADCAST_KEYS, cut

#: Letters of a word: ASCII ones and those from U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Index entries of a shard, about.
PER_SHARD = 1 << 15


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3,
               dropped: Column | None = None, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(word, n) of all words that are long and frequent enough, lower-cased in A-Z only.

    ``dropped`` gives, from columns id and run, a place whose letter is left out, or null.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0)))
        .alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if dropped is not None:
        runs = runs.withColumn("at", dropped)
        word = F.when(F.col("at").isNull(), word).otherwise(F.concat(
            F.substring("run", F.lit(1), F.col("at")),
            F.substring("run", F.col("at") + 2, F.length("run"))))
    return (runs.select(word.alias("word")).where(F.length("word") >= least_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count))


def entries(words: DataFrame) -> DataFrame:
    """(left, part, asks, word, n): the halves under which each word is found, and its own."""
    m = F.length("word")
    halves = [F.floor(k / 2).cast("int") for k in (m - 1, m, m + 1)]
    ends = [(k - F.floor(k / 2)).cast("int") for k in (m - 1, m, m + 1)]
    own = F.floor(m / 2).cast("int")
    lefts = F.transform(F.array_distinct(F.array(*halves)), lambda k: F.struct(
        F.lit(True).alias("left"), F.substring("word", F.lit(1), k).alias("part"),
        (k == own).alias("asks")))
    rights = F.transform(F.array_distinct(F.array(*ends)), lambda k: F.struct(
        F.lit(False).alias("left"), F.substring("word", m - k + 1, k).alias("part"),
        (k == m - own).alias("asks")))
    return words.select(F.explode(F.concat(lefts, rights)).alias("e"), "word", "n").select(
        "e.left", "e.part", "e.asks", "word", "n")


def sharded(found: DataFrame, per_shard: int) -> tuple[DataFrame, int]:
    """Entries with block, blocks and shard; halves of very many words are split into blocks."""
    sizes = found.groupBy("left", "part").agg(F.count("*").alias("size"))
    hot = cut(sizes.where(F.col("size") > per_shard).select(
        "left", "part", F.ceil(F.col("size") / per_shard).cast("int").alias("blocks")))
    total, few = sizes.agg(F.sum("size")).first()[0] or 0, hot.count()
    own = F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))).cast("int")
    met = found.withColumn("blocks", F.lit(1)) if not few else found.join(
        F.broadcast(hot) if few <= MAX_BROADCAST_KEYS else hot, ["left", "part"], "left").withColumn(
        "blocks", F.coalesce("blocks", F.lit(1)))
    # An asker goes to all blocks; in its own it is indexed as well.
    dealt = met.withColumn("own", own).withColumn("block", F.explode(F.when(
        F.col("asks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
    shards = max(1, -(-total // per_shard))
    return dealt.select(
        F.pmod(F.xxhash64("left", "part", "block"), F.lit(shards)).cast("int").alias("shard"),
        "left", "asks", (F.col("block") == F.col("own")).alias("kept"), "block", "blocks",
        F.xxhash64("word").alias("hash"), "word", "n"), shards


NEAR = "word string, n_near long, best_n long, best string"


def neighbours(words: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near ones."""
    dealt, shards = sharded(entries(words), per_shard)

    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if shard[a] != now and held:
                    yield searched(pa.Table.from_batches(held))
                    held = []
                now = shard[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield searched(pa.Table.from_batches(held))

    found = (dealt.repartition(shards, "shard").sortWithinPartitions("shard")
             .mapInArrow(by_shard, NEAR))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def searched(rows: pa.Table) -> pa.RecordBatch:
    """What the askers of a shard find among its words."""
    left, asks, kept, block, blocks, hashed, n = (
        rows.column(c).to_numpy() for c in ("left", "asks", "kept", "block", "blocks", "hash", "n"))
    every = rows.column("word").to_pylist()
    words = sorted(set(every))  # by code point, so a smaller place is a smaller word
    place = {w: k for k, w in enumerate(words)}
    at = np.fromiter(map(place.__getitem__, every), np.int64, len(every))
    count, code = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    count[at], code[at] = n, hashed
    indexed = np.zeros(len(words), dtype=bool)
    indexed[at[kept]] = True
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    letters, coded = np.unique(points, return_inverse=True)
    index = BidirectionalIndex(coded.astype(np.int64) + 1, np.array([len(w) for w in words]),
                               len(letters) + 1)
    asker, near = [], []
    for side in (True, False):
        mine = np.flatnonzero(asks & (left == side))
        q, w = index.one_error(at[mine], side)
        # Each neighbour counts in its own block only.
        ok = indexed[w] & (np.mod(code[w], blocks[mine[q]]) == block[mine[q]])
        asker.append(at[mine[q[ok]]])
        near.append(w[ok])
    asker, near = np.concatenate(asker), np.concatenate(near)
    order = np.lexsort((near, -count[near], asker))
    asker, near = asker[order], near[order]
    first = np.flatnonzero(np.diff(asker, prepend=-1))
    each = np.diff(first, append=len(asker))
    return pa.RecordBatch.from_arrays(
        [pa.array([words[k] for k in asker[first]], pa.string()), pa.array(each, pa.int64()),
         pa.array(count[near[first]], pa.int64()),
         pa.array([words[k] for k in near[first]], pa.string())],
        ["word", "n_near", "best_n", "best"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows: the last form that forms lead to."""
    known = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = cut(known.join(further, "root", "left"))
        if met.where("next is not null").isEmpty():
            return known
        known = met.select("word", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame, factor: int = 2, per_shard: int = PER_SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word (word, n)."""
    words = cut(words)
    near = cut(words.join(neighbours(words, per_shard), "word", "left"))
    has = F.col("best_n") >= factor * F.col("n")
    told = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                       F.when(has, F.col("best")).alias("form"),
                       F.when(has, F.col("best_n")).alias("form_n"))
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
