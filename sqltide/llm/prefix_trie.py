"""Conversation prefix trie, rolled up by centroid decomposition.

Each distinct sequence of the first d turns of a conversation is a node of depth d; the textless
root has depth 0.  A node's key is a sum over its turns of 128-bit digests that hold the place of
each turn, so all keys of a conversation are one running sum and need no concatenated texts.

Subtree totals come from a centroid decomposition of the parent edges.  A node weighs as many
conversations as pass through it, so the weight of a whole subtree is a plain grouping of the
rows.  In each round every component is split at its centroid, the deepest node under which more
than half of the component's weight lies: the totals of what lies under it, itself included, are
added to all nodes on the path from it to the component's top, which are just those with over
half of the weight; then its children's subtrees and the rest go on as components of at most half
the weight.  Every pair of a node and one above it is so parted, and counted, exactly once.  Rounds
therefore grow with the logarithm of the input, however deep a conversation is.  Components under
``LOCAL`` are decomposed further by the same steps inside a task, many to a partition.

Which child of a centroid a node lies under is told by the node's representative, its member with
the smallest id: that conversation's own row at the depth below the centroid names the child.

Turns are ordered by turn (null first), turns of one number by their digest.  Rows without a
conversation id are left out.  Null role or text counts as empty.  Repeated rows are turns of
their own.  An empty table gives no nodes.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltide.llm.shared import attach
from sqltide.operators.scan import Run, cut, running_by, total

#: Components up to this weight are decomposed inside a task.
LOCAL = 4096
#: Ids put into one text before it travels.
FLUSH = 1 << 17
WORD = "[^\\x20\\x09-\\x0D]+"
ROOT = hashlib.md5(b"0,0,0,0,0").digest()


def ordered(docs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, digest, words) of every turn, places from 1."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = docs.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 63))).alias("turn"),
        F.col(turn_col).isNotNull().alias("known"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    placed = running_by(cut(rows), ["conv"], "turn",
                        {"place": total(F.lit(1).cast("long"), inclusive=True)},
                        ties=("known", "digest"))
    return cut(placed.select("conv", "place", "digest", "words"))


def rebuilt(turns: DataFrame, shared: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``shared`` turns (at most ``most``) of conversation
    ``base`` in place of their own, both columns over ``conv``.

    Returns (conv, depth, digest, words) of all turns and (conv, length) of all conversations.
    """
    sizes = turns.groupBy("conv").agg(F.max("place").alias("had"))
    named = sizes.select("conv", "had", shared.alias("head"), base.alias("base"))
    firsts = sizes.select(F.col("conv").alias("base"), F.col("had").alias("base_had"))
    plans = cut(named.join(firsts, "base", "left").select(
        "conv", "had", "head", "base",
        F.least("head", F.coalesce("base_had", F.lit(0))).alias("taken")))
    heads = turns.where(F.col("place") <= most).select(
        F.col("conv").alias("base"), F.col("place").alias("depth"), "digest", "words")
    lent = plans.where("taken > 0").select("conv", "base", "taken").join(heads, "base").where(
        F.col("depth") <= F.col("taken")).select("conv", "depth", "digest", "words")
    many = plans.agg(F.sum("had")).first()[0] or 0
    own = attach(turns, plans.select("conv", "had", "head", "taken"), ["conv"], "had", many).where(
        F.col("place") > F.col("head")).select(
        "conv", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "digest", "words")
    lengths = plans.select("conv", (F.col("taken") + F.greatest(
        F.col("had") - F.col("head"), F.lit(0))).alias("length"))
    return own.unionByName(lent), lengths


def paths_of(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, depth, key, parent, words, under) of every turn; ``under`` counts the turns of the
    conversation from here on."""
    salted = F.md5(F.concat_ws(":", F.col("depth").cast("string"), "digest"))
    pieces = turns.withColumn("salted", salted).select("conv", "depth", "words", *[
        F.conv(F.substring("salted", 8 * k + 1, 8), 16, 10).cast("long").alias(f"w{k}")
        for k in range(4)])
    summed = running_by(cut(pieces), ["conv"], "depth", {
        f"s{k}": Run("sum", F.col(f"w{k}"), True) for k in range(4)})

    def key(depth: Column, sums: list[Column]) -> Column:
        return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"),
                                         *[s.cast("string") for s in sums])))

    keyed = summed.select(
        "conv", "depth", "words", key(F.col("depth"), [F.col(f"s{k}") for k in range(4)]).alias("key"),
        key(F.col("depth") - 1, [F.col(f"s{k}") - F.col(f"w{k}") for k in range(4)]).alias("parent"))
    many = lengths.agg(F.sum("length")).first()[0] or 0
    return cut(attach(keyed, lengths, ["conv"], "length", many).select(
        "conv", "depth", "key", "parent", "words",
        (F.col("length") - F.col("depth") + 1).alias("under")))


def nodes_of(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node: key, depth, parent, conv (smallest member), n_convs, n_children,
    parent_conv, size (weight of its subtree), leaf and saved (its own values)."""
    members = [F.min("conv").alias("conv"), F.count("*").alias("n_convs")]
    root = lengths.agg(*members, F.sum(F.col("length") + 1).alias("size")).where("n_convs > 0").select(
        F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("binary").alias("parent"), "conv", "n_convs",
        F.lit(0).cast("long").alias("words"), "size")
    inner = paths.groupBy("key").agg(
        *members, F.min("depth").alias("depth"), F.min("parent").alias("parent"),
        F.max("words").alias("words"), F.sum("under").alias("size"))
    plain = cut(inner.select(root.columns).unionByName(root))
    children = plain.where(F.col("parent").isNotNull()).groupBy("parent").agg(
        F.count("*").alias("n_children"))
    heads = cut(plain.join(children.withColumnRenamed("parent", "key"), "key", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))))
    above = heads.where("n_children > 0").select(
        F.col("key").alias("parent"), F.col("conv").alias("parent_conv"),
        F.col("n_children").alias("siblings"))
    below = attach(heads.where(F.col("parent").isNotNull()), above, ["parent"], "siblings",
                   heads.count()).drop("siblings")
    return cut(below.unionByName(
        heads.where(F.col("parent").isNull()).withColumn("parent_conv", F.lit(None).cast("long")))
        .withColumns({"leaf": (F.col("n_children") == 0).cast("long"),
                      "saved": (F.col("n_convs") - 1) * F.col("words")}))


def rolled_up(nodes: DataFrame, paths: DataFrame, local: int = LOCAL) -> DataFrame:
    """(key, leaf, saved): the totals of every node's subtree."""
    spines = cut(paths.join(nodes.select("conv").distinct(), "conv", "left_semi")
                 .select("conv", "key"))
    many = spines.count()
    open_ = nodes.select(
        "key", "depth", "parent", "conv", "n_convs", F.lit(ROOT).alias("top"), "size", "leaf",
        "saved", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("tokens"))
    state, settled = open_.columns, []
    while True:
        totals = open_.groupBy("top").agg(F.max("size").alias("total"), F.count("*").alias("rows"))
        n = open_.count()
        tagged = cut(attach(open_, totals, ["top"], "rows", n))
        settled.append(inside(tagged.where(F.col("total") <= local)))
        large = tagged.where(F.col("total") > local)
        heads = cut(large.where(2 * F.col("size") > F.col("total")).groupBy("top").agg(
            F.max_by(F.struct("key", "depth", "size"), "depth").alias("c"),
            F.max("rows").alias("n")))
        if heads.isEmpty():
            break
        met = cut(attach(large.drop("rows"), heads, ["top"], "n", n))
        on_path = 2 * F.col("size") > F.col("total")
        children = met.where(F.col("parent") == F.col("c.key")).select(
            "key", "n_convs", F.col("top").alias("of"))
        members = attach(spines, children, ["key"], "n_convs", many).select(
            "conv", "of", F.col("key").alias("child"))
        under = ~on_path & (F.col("depth") > F.col("c.depth"))
        dealt = cut(met.where(under).join(
            members, (F.col("top") == F.col("of")) & (met["conv"] == members["conv"]), "left")
            .select(*[met[c] for c in met.columns], "child"))
        # The centroid's own values and those of all nodes under it.
        given = dealt.where(F.col("child").isNotNull()).select("top", "n", "leaf", "saved").unionByName(
            met.where(F.col("key") == F.col("c.key")).select("top", "n", "leaf", "saved"))
        sums = given.groupBy("top").agg(F.sum("leaf").alias("more_leaves"),
                                        F.sum("saved").alias("more_tokens"), F.max("n").alias("n"))
        path = cut(attach(met.where(on_path).drop("n"), sums, ["top"], "n", n).withColumns({
            "leaves": F.col("leaves") + F.col("more_leaves"),
            "tokens": F.col("tokens") + F.col("more_tokens")}))
        settled.append(path.where(F.col("key") == F.col("c.key")).select(
            "key", F.col("leaves").alias("leaf"), F.col("tokens").alias("saved")))
        rest = path.where(F.col("key") != F.col("c.key")).withColumn(
            "size", F.col("size") - F.col("c.size"))
        open_ = cut(rest.select(state).unionByName(
            met.where(~on_path & ~under).select(state)).unionByName(
            dealt.withColumn("top", F.coalesce("child", "top")).select(state)))
    out = settled[0]
    for rows in settled[1:]:
        out = out.unionByName(rows)
    return out


def inside(rows: DataFrame) -> DataFrame:
    """(key, leaf, saved) of components that fit into a task, each decomposed to the end."""
    columns = ["top", "key", "parent", "size", "leaf", "saved", "leaves", "tokens"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            part = batch if tail is None else pa.concat_batches([tail, batch])
            tops, last = part.column(0).to_pylist(), 0
            for k in range(1, len(tops)):
                if tops[k] != tops[k - 1]:
                    yield done(part.slice(last, k - last))
                    last = k
            tail = part.slice(last)
        if tail is not None and len(tail):
            yield done(tail)

    def done(part: pa.RecordBatch) -> pa.RecordBatch:
        key, parent, size, leaf, saved, leaves, tokens = (
            part.column(k).to_pylist() for k in range(1, 8))
        place = {k: i for i, k in enumerate(key)}
        above = [place.get(p, -1) for p in parent]
        decompose(above, size, [(leaf, leaves), (saved, tokens)])
        return pa.RecordBatch.from_arrays(
            [pa.array(key, pa.binary()), pa.array(leaves, pa.int64()), pa.array(tokens, pa.int64())],
            ["key", "leaf", "saved"])

    return (rows.repartition("top").sortWithinPartitions("top", "depth").select(columns)
            .mapInArrow(settle, "key binary, leaf long, saved long"))


def decompose(above: list[int], size: list[int], values: list[tuple[list[int], list[int]]]) -> None:
    """Adds to each total of ``values`` (own, total) what a node's subtree holds.

    Nodes come by depth; ``above`` is the parent's place or -1, ``size`` a subtree's weight.
    """
    stack = [list(range(len(above)))]
    while stack:
        nodes = stack.pop()
        half = size[nodes[0]] / 2
        path = [x for x in nodes if size[x] > half]
        centroid = path[-1]
        parts: dict[int, list[int]] = {}
        under, rest = {}, []
        for x in nodes:
            if x == centroid:
                continue
            child = x if above[x] == centroid else under.get(above[x])
            if child is None:
                rest.append(x)
            else:
                under[x] = child
                parts.setdefault(child, []).append(x)
        for own, totals in values:
            given = own[centroid] + sum(own[x] for x in under)
            for x in path:
                totals[x] += given
        for x in path[:-1]:
            size[x] -= size[centroid]
        stack += [rest] * bool(rest)
        stack += parts.values()


def digests(ends: DataFrame) -> DataFrame:
    """(key, sha256) of the conversations (key, conv) that end at a node, their ids in order.

    Ids of a range become texts first; a node's texts then pass one after the other through one
    running hash, so no list of a node's conversations is ever held.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        n = 0
        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(key, []).append(conv)
            n += len(batch)
            if n >= FLUSH:
                yield texts(held)
                held, n = {}, 0
        if held:
            yield texts(held)

    def texts(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(held, pa.binary()), pa.array([v[0] for v in held.values()], pa.int64()),
             pa.array([",".join(map(str, v)) for v in held.values()], pa.string())],
            ["key", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if key != now:
                    if now is not None:
                        out.append((now, running.hexdigest()))
                    now, running = key, hashlib.sha256(ids.as_py().encode())
                else:
                    running.update(b"," + ids.as_py().encode())
            yield told(out)
        if now is not None:
            yield told([(now, running.hexdigest())])

    def told(out):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()),
                                           pa.array([h for _, h in out], pa.string())], ["key", "ends"])

    parts = ends.repartitionByRange("conv").sortWithinPartitions("conv").mapInArrow(
        joined, "key binary, first long, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(
        hashed, "key binary, ends string")


def trie(turns: DataFrame, lengths: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row per node of (conv, depth, digest, words) turns of (conv, length) conversations.

    conv (its smallest member), depth, parent_conv, n_convs, n_children, n_leaves and
    saved_tokens of the subtree, and ends_sha256 of the members that end here.
    """
    lengths = cut(lengths)
    paths = paths_of(turns, lengths)
    nodes = nodes_of(paths, lengths)
    totals = rolled_up(nodes, paths, local)
    ends = paths.where("under = 1").select("key", "conv").unionByName(
        lengths.where("length = 0").select(F.lit(ROOT).alias("key"), "conv"))
    named = nodes.select("key", "conv", "depth", "parent_conv", "n_convs", "n_children")
    return named.join(totals, "key").join(digests(ends), "key", "left").select(
        "conv", "depth", "parent_conv", "n_convs", F.col("n_children").cast("long"),
        F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
