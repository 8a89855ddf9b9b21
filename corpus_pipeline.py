"""A corpus pipeline of five stages over documents: each works on all rows that the one before it kept.

Stages but the last return the columns of documents. Every stage is one operator of segmill.llm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.llm import bpe, decontam, lines, quality, simhash
from segmill.llm.common import discard, materialize

VOCAB = "byte_bpe_multi_50k.tiktoken"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the good labels keeps."""
    return quality.filter_docs(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are similar to an earlier one; what is emptied by that goes."""
    return lines.filter_docs(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 and more)."""
    return simhash.filter_docs(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.filter_docs(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and whether they decode to the text."""
    path, pattern = public_tokenizers.path(VOCAB), public_tokenizers.PATTERN
    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    both = bpe.round_trip(hashed, path, pattern, keep=["doc_id", "text_hash"])
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.xxhash64(F.col("decoded").cast("string")) == F.col("text_hash")).alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontam_stage),
    ("byte-level bpe", bpe_stage),
]

#: SQL cannot express the classifier, the tiling or the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written to the shared folder, read again by the next and then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            kept = materialize(kept, f"stage{n}")
            if n:
                discard(docs)
        docs = kept
    return docs
