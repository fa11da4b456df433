"""From raw documents to packed training sequences, a stage at a time.

STAGES: (name, function); a function takes (spark, docs, sf_dir) and returns the next stage's
documents, the last one the packed pieces with their token ids. Each stage's result is written and
read again.

Null texts, and texts that a quality rule rejects, go in the first stage; a null doc_id, repeated rows,
ties, very long texts and an empty table pass as the operators say. Columns that documents have besides doc_id, text and
source stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import stored
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.packing import pack
from tidemark.llm.quality import good_documents
from tidemark.llm.secret_scan import without_secrets
from tidemark.llm.simhash_dedup import one_of_each_group


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = pack(docs)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "width", "ids")


STAGES = [
    ("quality rules", good), ("SimHash near-dedup", distinct), ("secret scans", clean),
    ("mixing to target weights", mixed), ("packing", packed),
]

#: The rates of the mix solve a system of equations, and packing follows from them: no SQL says it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
