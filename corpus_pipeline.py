"""The corpus pipeline: each stage takes all that its predecessor kept, written as Parquet and reread."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from faultloom.llm.byte_bpe import encode_documents
from faultloom.llm.decontaminate import drop_contaminated
from faultloom.llm.shared import Scratch
from faultloom.llm.simhash_dedup import drop_near_copies
from faultloom.llm.suffix_dedup import PASSAGE, cut_repeats
from faultloom.llm.toxicity import drop_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model finds toxic go; it learns from the labelled rows among ``docs``."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that of the smallest id."""
    return drop_near_copies(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start more than once are cut out of the texts: passages of over 50 words."""
    return cut_repeats(docs, law=PASSAGE)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, one row per document that is left."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("byte_level_bpe", encoded),
]

#: SQL cannot express the learned, byte-level and fingerprint stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = scratch.table(docs)
    return docs
