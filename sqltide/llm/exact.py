"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes in groups.

Only DataFrame functions.  Texts are compared after each run of ``[\\x20\\x09-\\x0D]`` has become
one space.  A null text counts as empty, and empty texts equal one another.  Rows with a null id
sort after all others; a group of such rows only keeps all of them.  Rows repeated with the same
id share one decision and count one by one in the size of their group.  An empty table gives no
rows.  Other columns are not read by :func:`groups_of` and come back untouched from
:func:`dedup`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltide.llm.shared import attach, cut

SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, digest, text): 128-bit group key, SHA-256, normalised text."""
    return (docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
            .select("id", F.unhex(F.md5("text")).alias("key"),
                    F.unhex(F.sha2("text", 256)).alias("digest"), "text"))


def groups_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for every row of ``docs``.

    The text itself is part of the grouping key, so bytes are compared inside each hash group and
    colliding texts part; copies collapse before the shuffle, so a hot text moves once per task.
    Rows meet their group by (key, digest).  Where two texts share both, which the grouping
    shows, rows of that key meet it by text instead.
    """
    rows = hashed(docs, id_col, text_col)
    groups = cut(rows.groupBy("key", "digest", "text")
                 .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
                 .drop("text"))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    clashes = cut(groups.groupBy("key", "digest").agg(F.count("*").alias("n")).where("n > 1"))
    narrow = rows.select("id", "key", "digest")
    if clashes.isEmpty():
        met = attach(narrow, groups, ["key", "digest"], "group_size", total)
    else:
        texts = (rows.join(clashes.select("key", "digest"), ["key", "digest"], "left_semi"))
        parted = (texts.groupBy("key", "digest", "text")
                  .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")))
        apart = attach(texts, parted, ["key", "digest", "text"], "group_size", total)
        plain = groups.join(clashes.select("key", "digest"), ["key", "digest"], "left_anti")
        met = attach(narrow, plain, ["key", "digest"], "group_size", total).unionByName(
            apart.select("id", "key", "digest", "keep_id", "group_size"))
    return met.select("id", "keep_id", "group_size",
                      F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = groups_of(docs, id_col, text_col).where("kept").select(
        F.col("id").alias("kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["kept_id"]), "left_semi")
