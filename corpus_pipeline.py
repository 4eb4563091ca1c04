"""The corpus pipeline: language ID, exact and near dedup, mixing, BPE encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspan.llm import bpe_reuse, exact_dedup, language_id, mixing, near_dedup
from larkspan.llm.queries import VOCABULARY, remainder
from larkspan.plans.registry import table
from larkspan.session import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with confidence; learned from three quarters of the labelled ones."""
    return language_id.accepted_rows(docs, language_id.train(docs.where(remainder(4) != 2)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id."""
    return near_dedup.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix of the sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts and the digest of what they decode to: doc_id, n_tokens, ids, decoded_sha256."""
    return bpe_reuse.encode_decoded(docs, VOCABULARY)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe_encoding", encode)]

#: Language ID, near dedup and BPE have no SQL counterpart; the run is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
