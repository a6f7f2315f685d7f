"""The operators' registered queries, each over its whole table, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltide.llm import (bpe, embedding, exact, jaccard, langid, licenses, oracle_sql, packing,
                         prefix_trie, secrets, spelling, substring, toxicity, warc)


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file, as installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.json")
    coded = table(spark, sf_dir, "documents").select(
        "doc_id", bpe.encode(F.col("text"), path).alias("ids"))
    read = coded.withColumn("text", bpe.decode(F.col("ids"), path))
    return read.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(table(spark, sf_dir, "documents"), size=3, percent=90).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"))


def remainder(key: str, of: int):
    """crc32 of an id's decimal digits, modulo ``of``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Fitted to the labels that aren't held out."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("id", 5) != 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(spark, docs, sf_dir)
    return toxicity.scored(docs, model, score_col="score").select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(warc.planned(table(spark, sf_dir, "pages")), warc.folder(spark))
    return warc.read(archives).select(
        warc.page_of("record").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        "payload_digest", F.col("type").alias("record_type"),
        warc.page_of("refers_to").alias("refers_to"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(table(spark, sf_dir, "documents"),
                            tokenizer("word_bpe_49k.json"), end_id=1, most=4096)
    return packing.pack(pieces, room=4096).withColumnRenamed("id", "doc_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, remainder("id", 3) != 1)
    return docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"),
                       langid.predict(F.col("text"), model).alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups_of(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = found.select("id", "spans", F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
                        .alias("base"))
    counted = lambda kind: F.size(F.filter(
        "base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return base.select(
        F.col("id").alias("doc_id"), *[counted(k) for k in secrets.BASE],
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered(table(spark, sf_dir, "conversations"))
    own, lengths = prefix_trie.rebuilt(
        turns, shared=remainder("conv", 4), base=F.col("conv") - F.col("conv") % 20, most=3)
    return prefix_trie.trie(own, lengths).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary"))
    dropped = F.when(h % 97 == 0, (h % F.length("run")).cast("int"))
    return spelling.variants(spelling.vocabulary(
        table(spark, sf_dir, "documents"), least_length=5, least_count=3, dropped=dropped))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_license_scan": op2_license_scan,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_toxicity": op4_toxicity,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_secret_scan": op11_secret_scan,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES = {
    "op6_warc": r"""
        with p as (
            select page_id, encode(coalesce(html, '')) as payload from pages),
        g as (
            select page_id, payload, octet_length(payload) as n,
                   max(page_id) over (partition by payload) as first
            from p)
        select page_id, n as payload_bytes, sha1(payload) as payload_digest,
               case when n >= 1000 and first <> page_id then 'revisit' else 'response' end
                   as record_type,
               case when n >= 1000 and first <> page_id then first end as refers_to
        from g""",
    "op10_exact_dedup": r"""
        with t as (
            select doc_id,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm
            from documents)
        select doc_id, min(doc_id) over (partition by norm) as keep_id,
               count(*) over (partition by norm) as group_size,
               doc_id = min(doc_id) over (partition by norm) as kept,
               sha256(norm) as text_sha256
        from t""",
    "op11_secret_scan": oracle_sql.secret_scan(),
    "op12_conversation_trie": oracle_sql.conversation_trie(),
    "op13_spelling_variants": oracle_sql.spelling_variants(),
}
