"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, byte-level BPE."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, common, decontaminate, lines, neardup, quality
from gaugeworks.llm.queries import RANKS, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity passes their language's quantile go. Null and empty texts are judged by their end alone; rows of equal doc_id and text are judged alike; columns of any name stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar lines one stays; rows of equal doc_id and text are one document. No row goes: a text may be left empty, a null one stays null."""
    return _counted(lines.clean(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row of that of least doc_id stays; so of all texts left without words by the stage before. Rows without doc_id stay."""
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go from the texts, and documents that are mostly such. Null and empty texts stay; repeated rows are treated alike."""
    return _counted(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` for each row: token ids as little-endian unsigned 32-bit integers, none for null and empty texts."""
    out = bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("byte-level BPE", bpe_stage),
]

#: Statistical models and signatures: SQL can't express these stages; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder as Parquet and read again, and deleted when the next one is written."""
    common.ensure_checkpoint_dir(spark)
    shared = spark.sparkContext.getCheckpointDir()
    docs, path = table(spark, sf_dir, "documents"), ""
    for i, (_, stage) in enumerate(STAGES):
        last, path = path, f"{shared}/corpus-{uuid.uuid4().hex}-{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            common.drop(spark, last)
        docs = spark.read.parquet(path)
    return docs
