"""The operators over their whole tables, as the contract's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontamination import contamination
from tidemark.llm.hard_negatives import hard_negatives
from tidemark.llm.kd_sharding import kd_shards
from tidemark.llm.learned_ann import nearest
from tidemark.llm.mixing import mix
from tidemark.llm.oracle import ORACLE_SQL
from tidemark.llm.packing import pack
from tidemark.llm.phrase_dedup import without_repeats
from tidemark.llm.quality import quality_features
from tidemark.llm.secret_scan import digest, secret_spans
from tidemark.llm.simhash_dedup import simhash_groups
from tidemark.llm.token_alignment import align_tokens
from tidemark.llm.token_counts import token_counts
from tidemark.llm.token_store import read_store, write_store


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_store(spark, write_store(documents(spark, sf_dir)))


def op3_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_learned_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 100 == 0)


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_features(documents(spark, sf_dir))


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(documents(spark, sf_dir), 8)


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secret_spans(documents(spark, sf_dir)))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = align_tokens(documents(spark, sf_dir), whole_groups=False)
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return groups.select("doc_id", *numbers, F.col("groups").cast("string").alias("groups_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_token_store, op3_phrase_dedup, op4_simhash_dedup, op5_learned_ann,
    op6_quality_cascade, op7_kd_sharding, op8_entropy_mixing, op9_packing, op10_secret_scan,
    op11_decontamination, op12_token_alignment, op13_hard_negatives)}

__all__ = ["ORACLE_SQL", "QUERIES"]
