"""A corpus pipeline of five operators: each stage works on what its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; between stages it is written as Parquet in the shared folder
and read again.  All but the last return the columns of `docs`; the last returns the token ids' digests of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import bpe, compression, decontamination, jaccard, pii
from gristmill.llm.common import materialise, read

#: Near duplicates here: shingles of five words, a Jaccard similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80
#: Neither trees nor compressors can be written as SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject."""
    return compression.keep_good(docs, read(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id."""
    return jaccard.keep_one(docs, SHINGLE, PERCENT)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage similar to a benchmark item."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", one_of_each_group),
    ("benchmark decontamination", uncontaminated),
    ("pii", redacted),
    ("byte-level bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i}")
    return docs
