"""The training-data pipeline over the documents table.

Each stage takes the rows its predecessor kept and returns them with the columns of ``documents``; the last one returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.bpe import Bpe
from pagemill.llm.common import bounded_batches
from pagemill.llm.decontam import keep_clean
from pagemill.llm.minhash_forest import keep_one
from pagemill.llm.quality import keep_good
from pagemill.llm.suffix_dedup import cut_texts
from pagemill.session import durable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    bounded_batches(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    bounded_batches(spark)
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that also start elsewhere; no document goes."""
    bounded_batches(spark)
    return cut_texts(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` of every document."""
    bounded_batches(spark)
    ids = Bpe(spark, public_tokenizers.path("byte_bpe_50k.json")).encode(F.col("text"))
    coded = docs.select("doc_id", "lang", "source", ids.alias("ids"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages),
          ("benchmark decontamination", decontamination), ("BPE encoding", token_ids)]

#: A trained classifier and suffix arrays are beyond SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage keeps is stored before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
