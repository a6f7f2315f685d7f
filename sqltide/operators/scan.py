"""Running values over ordered rows that stay balanced when one key holds most rows.

A window partitioned by a key puts the whole key into one task. The functions here
split the order column of hot keys into ranges of bounded size, compute the running
value inside each range, and add what the earlier ranges carry over:

1. windows inside (key, range), one shuffle;
2. one summary row per (key, range), pre-aggregated before its shuffle;
3. a window over the summary rows, split the same way, joined back on (key, range).

Keys below ``HOT_ROWS`` rows keep the plain window, so ordinary data pays one shuffle.
The order column must be integral and unique within a key: a range of width ``w`` then
holds at most ``w`` rows.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOT_ROWS = 4_000_000
RANGE_WIDTHS = (1 << 16, 1 << 12)
MAX_BROADCAST_KEYS = 10_000
MAX_BROADCAST_RANGES = 1_000_000

_PART = "__part"


@dataclass(frozen=True)
class Run:
    """A running value: what it folds, and whether the current row counts."""

    kind: str
    value: Column
    inclusive: bool

    def over(self, window) -> Column:
        frame = window.rowsBetween(Window.unboundedPreceding, 0 if self.inclusive else -1)
        if self.kind == "sum":
            return F.sum(self.value).over(frame)
        if self.kind == "max":
            return F.max(self.value).over(frame)
        return F.last(self.value, ignorenulls=True).over(frame)

    def fold(self, order: Column) -> Column:
        if self.kind == "sum":
            return F.sum(self.value)
        if self.kind == "max":
            return F.max(self.value)
        return F.max_by(self.value, F.when(self.value.isNotNull(), order))

    def join(self, near: Column, far: Column) -> Column:
        if self.kind == "sum":
            return F.when(near.isNull(), far).when(far.isNull(), near).otherwise(near + far)
        if self.kind == "max":
            return F.greatest(near, far)
        return F.coalesce(near, far)


def total(value: Column, inclusive: bool = False) -> Run:
    return Run("sum", value, inclusive)


def count_if(condition: Column, inclusive: bool = False) -> Run:
    return Run("sum", F.when(condition, 1).otherwise(0).cast("long"), inclusive)


def highest(value: Column, inclusive: bool = False) -> Run:
    return Run("max", value, inclusive)


def latest(value: Column, inclusive: bool = False) -> Run:
    """Last non-null value in order."""
    return Run("last", value, inclusive)


# --- materialising -----------------------------------------------------------------------

def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder for cut points: the session's setting, a temporary one only locally."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="sqltide-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later passes read only the columns they need, and lost executors cost no recomputing.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- running values ------------------------------------------------------------------------

def _plain(df: DataFrame, keys, order: str, specs: dict[str, Run], ties=()) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(order, *ties) if keys \
        else Window.orderBy(order, *ties)
    return df.withColumns({name: run.over(window) for name, run in specs.items()})


def _range_of(order: str, width: int) -> Column:
    return F.expr(f"`{order}` DIV {width}")


def _ranged(df: DataFrame, keys, order: str, specs: dict[str, Run], part: Column,
            widths, ties=(), keep_part: bool = False) -> DataFrame:
    columns = [c for c in df.columns if c != _PART]
    base = df if _PART in df.columns else df.withColumn(_PART, part)
    near = _plain(base, [*keys, _PART], order, specs, ties)
    sort_key = F.struct(order, *ties) if ties else F.col(order)
    folded = base.groupBy(*keys, _PART).agg(
        *[run.fold(sort_key).alias(f"__fold_{name}") for name, run in specs.items()])
    carried = {
        f"__far_{name}": Run(run.kind, F.col(f"__fold_{name}"), False)
        for name, run in specs.items()}
    if widths:
        far = _ranged(folded.withColumnRenamed(_PART, "__at"), keys, "__at", carried,
                      _range_of("__at", widths[0]), widths[1:])
        far = far.drop(_PART).withColumnRenamed("__at", _PART)
    else:
        far = _plain(folded, keys, _PART, carried)
    far = far.select(*keys, _PART, *carried)
    joined = near.join(far, [*keys, _PART], "left")
    return joined.select(*columns, *([_PART] if keep_part else []), *[
        run.join(F.col(name), F.col(f"__far_{name}")).alias(name)
        for name, run in specs.items()])


def running(df: DataFrame, keys, order: str, specs: dict[str, Run], split: bool = False,
            width: int = RANGE_WIDTHS[0], ties=()) -> DataFrame:
    """Add running values per key; ``ties`` are further order columns.

    Without ``split`` a key is one window partition. With it, keys are cut into ranges of
    ``width``; the rows are written first, as both passes read them.
    """
    if not split:
        return _plain(df, keys, order, specs, ties)
    return _ranged(
        cut(df), keys, order, specs, _range_of(order, width), RANGE_WIDTHS[1:], ties)


def running_all(df: DataFrame, order: str, specs: dict[str, Run],
                widths=RANGE_WIDTHS, ties=(), keep_part: bool = False) -> DataFrame:
    """Add running values over all rows in ``order``, never through a single task.

    With ``keep_part`` the rows stay marked with their range, so that a next pass over the
    same order needs no shuffle of its own.
    """
    return _ranged(df, [], order, specs, _range_of(order, widths[0]), widths[1:], ties, keep_part)


def find_hot(df: DataFrame, keys, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys above ``hot_rows`` rows, or ``None`` if there are none.

    The count is pre-aggregated and reads the key columns only. The result is marked for
    broadcast if it is small, and joins by shuffle otherwise.
    """
    counts = df.groupBy(*keys).count().where(F.col("count") > hot_rows)
    found = counts.limit(MAX_BROADCAST_KEYS + 1).count()
    if found == 0:
        return None
    hot = cut(counts.select(*keys))
    return F.broadcast(hot) if found <= MAX_BROADCAST_KEYS else hot


def by_heat(df: DataFrame, keys, hot: DataFrame | None, run) -> DataFrame:
    """Apply ``run(frame, split)`` to the rows of ordinary and of hot keys, and unite them.

    Only rows of hot keys pay for being split.
    """
    if hot is None:
        return run(df, False)
    ordinary = run(df.join(hot, keys, "left_anti"), False)
    return ordinary.unionByName(run(df.join(hot, keys, "left_semi"), True))


def running_by(df: DataFrame, keys, order: str, specs: dict[str, Run],
               hot_rows: int = HOT_ROWS, width: int = RANGE_WIDTHS[0],
               ties=()) -> DataFrame:
    """Running values per key that stay balanced when a key is hot."""
    return by_heat(
        df, keys, find_hot(df, keys, hot_rows),
        lambda part, split: running(part, keys, order, specs, split, width, ties)
        .select(*df.columns, *specs))


# --- ends of an order ------------------------------------------------------------------------

def last_rows(df: DataFrame, order: str, n: int, keys=(), few_keys: bool = False,
              width: int = 1 << 20) -> DataFrame:
    """The ``n`` rows with the highest ``order`` per key.

    Ranges are counted first; only those that can hold a wanted row are sorted, so a
    task ranks at most ``n + width`` rows. There are at most ``n`` such ranges per key;
    with no keys, or a fixed few, that bounds the list enough to broadcast it.
    """
    keys = list(keys)
    ranged = df.withColumn(_PART, _range_of(order, width))
    later = Window.partitionBy(*keys).orderBy(F.col(_PART).desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    wanted = (ranged.groupBy(*keys, _PART).count()
              .withColumn("__later", F.coalesce(F.sum("count").over(later), F.lit(0)))
              .where(F.col("__later") < n).select(*keys, _PART))
    if (few_keys or not keys) and n <= MAX_BROADCAST_RANGES:
        wanted = F.broadcast(wanted)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return (ranged.join(wanted, [*keys, _PART], "left_semi")
            .withColumn("__rank", rank).where(F.col("__rank") <= n).select(*df.columns))


def first_rows(df: DataFrame, order: str, n: int, keys=(), few_keys: bool = False,
               width: int = 1 << 20) -> DataFrame:
    """The ``n`` rows with the lowest ``order`` per key; see ``last_rows``."""
    turned = df.withColumn("__turned", -F.col(order))
    return last_rows(turned, "__turned", n, keys, few_keys, width).select(*df.columns)
