"""The corpus pipeline: quality, near duplicates, decontamination, secrets, tokens.

Each stage takes what the one before kept, written as Parquet and read again, and all but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import byte_bpe, jaccard_join, quality_gam, secret_scan, string_tiling
from quillspark.llm.common import read, texts, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learnt from labels, doesn't reject."""
    return quality_gam.accepted(docs, quality_gam.learnt(docs, read(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id."""
    return jaccard_join.deduplicated(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return string_tiling.clean(docs, read(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    return secret_scan.without_secrets(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: packed ids of every text, their number, and whether they decode to the text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = byte_bpe.transcoded(texts(docs), path, public_tokenizers.PATTERN, give=("ids", "exact"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "exact")


STAGES: list[tuple[str, Stage]] = [
    ("quality_gam", good),
    ("jaccard_join", distinct),
    ("string_tiling", clean),
    ("secret_scan", redacted),
    ("byte_bpe", encoded),
]
#: A fitted model, components and tokens aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
