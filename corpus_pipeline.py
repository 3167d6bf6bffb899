"""A training corpus from raw documents: five stages, each one operator of staylens.llm.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as
the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from staylens.llm import bpe, decontaminate, minhash, quality_rules, secret_scan
from staylens.llm.common import stored, table
from staylens.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return minhash.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go when benchmark passages cover a twentieth of their words or more."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; found secrets are replaced by a mark, n_chars follows."""
    return secret_scan.redact(docs, length="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of ids and of the decoded bytes."""
    out, c = bpe.round_trip(docs, **tokenizer(), keep=["doc_id", "lang", "source"], with_ids=True)
    return out.select("doc_id", "lang", "source", f"{c}.n_tokens", f"{c}.ids", f"{c}.ids_sha256",
                      f"{c}.decoded_sha256")


STAGES = [
    ("quality_rules", quality),
    ("minhash_dedup", near_dedup),
    ("decontaminate", benchmark_free),
    ("secret_scan", secrets),
    ("byte_bpe", tokens),
]

#: Learned rules, sketches and BPE are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
