"""The registered queries of this subpackage: thin wrappers that read a whole table and call an operator."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, bpe, bytebpe, mixing, phrases, quality, reshard, secretscan, simhash, tokencount, urlfilter, vecdedup
from .shared import new_path, table

ORACLES: dict[str, str] = {"op2_mix_to_weights": mixing.ORACLE, "op5_url_redirect_filter": urlfilter.ORACLE, "op12_phrase_collocations": phrases.ORACLE}


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        (quality.fold(F.col("doc_id")) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), keep_ids=False, keep_decoded=False)


def op5_url_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op6_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 hash shards to 24 of near equal bytes; the rows are read back from the shards' new files.

    The table has no shards yet: the old ones are dealt by a hash of the text, and all are written.
    """
    docs = table(spark, sf_dir, "documents")
    path = new_path(spark, "reshard-files")
    old = reshard.hash_layout(F.xxhash64("text"), 16)
    reshard.rewrite_affected(docs, old, 24, path, has_files=False)
    kept = T.StructType([docs.schema["doc_id"], docs.schema["text"], T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    placed = spark.read.schema(kept).parquet(path) if docs.take(1) else spark.createDataFrame([], kept)
    return placed.select(
        "doc_id", reshard.row_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), old.alias("old_shard"),
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode_documents(table(spark, sf_dir, "documents"), keep_ids=False, keep_decoded=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}
