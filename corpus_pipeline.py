"""A corpus made ready for training: each stage works on all documents that the one before kept.

Toxic documents go, exact copies go, one document of each group of near copies stays, repeated
passages go from all but the first document, and what is left is packed into sequences.  All
stages but the last return the columns of the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltide.llm import exact, jaccard, packing, substring, toxicity
from sqltide.llm.queries import tokenizer, toxicity_model
from sqltide.operators.scan import cut

#: SQL has no merge-based tokens, fitted scores or best-fit packing.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half."""
    model = toxicity_model(spark, docs, sf_dir)
    return docs.where(toxicity.score(F.col("text"), model) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, that with the smallest id."""
    return exact.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that reach one another by five-word shingles and a Jaccard similarity of 0.8
    or more, that with the smallest id."""
    return jaccard.representatives(docs, size=5, percent=80)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that an earlier document has."""
    return substring.dedup(docs, window=50)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 4096 tokens."""
    pieces = packing.pieces(docs, tokenizer("word_bpe_49k.json"), end_id=1, most=4096)
    return packing.pack(pieces, room=4096).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and reread by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = cut(docs)
    return docs
