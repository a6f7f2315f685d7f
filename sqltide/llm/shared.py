"""Cut points, joins against skewed groups and connected components, used by several operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group counts as heavy from this share of all rows on, so there are at most 1/HEAVY of them.
HEAVY = 1 / 1000


def checkpoint_ready(spark: SparkSession) -> None:
    """Points checkpoints to the session's shared folder; a local one only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="sqltide-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut there."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int,
           how: str = "inner") -> DataFrame:
    """``rows`` joined with their group's single row in ``groups``, safe for hot groups.

    Groups with at least ``HEAVY * total`` rows, of which there can be no more than
    ``1 / HEAVY``, are sent to every task; all others are shuffled.  ``total`` is the number of
    rows, ``size`` the column of ``groups`` with the rows of each group.
    """
    heavy = F.col(size) >= max(2, int(total * HEAVY))
    few = groups.where(heavy).withColumn("__few", F.lit(True))
    renamed = few.select(*[F.col(k).alias(f"__{k}") for k in keys],
                         *[F.col(c).alias(f"__few_{c}") for c in groups.columns if c not in keys],
                         "__few")
    met = rows.join(F.broadcast(renamed), [F.col(k) == F.col(f"__{k}") for k in keys], "left")
    values = [c for c in groups.columns if c not in keys]
    hot = met.where("__few").select(*rows.columns, *[F.col(f"__few_{c}").alias(c) for c in values])
    cold = met.where("__few is null").select(*rows.columns)
    return hot.unionByName(cold.join(groups.where(~heavy), keys, how).select(
        *rows.columns, *values))


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) reduced, in each partition by itself, to b > a pairs that join as much."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := over.get(top, top)) != top:
                top = up
            while (up := over.get(x, x)) != top:
                over[x], x = top, up
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    over[max(a, b)] = min(a, b)
        nodes = list(over)
        for at in range(0, len(nodes), 100_000):
            part = nodes[at:at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([root(n) for n in part], pa.int64()), pa.array(part, pa.int64())],
                ["a", "b"])

    return edges.select("a", "b").mapInArrow(reduced, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node they reach.

    Partitions first reduce their own edges; then large and small stars alternate, each a
    grouping and a join, until nothing changes, which takes a logarithmic number of rounds.  A
    round is cut, so a lost executor costs one round.
    """
    pairs = cut(forest(edges).where("a <> b").distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(
            F.col("least").alias("a"), "b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("least"))
        small = (large.join(down, "b").select(F.col("least").alias("a"), F.col("a").alias("b"))
                 .unionByName(down.select(F.col("least").alias("a"), "b"))
                 .where("a <> b").distinct())
        pairs = cut(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = pairs.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node")
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
