"""Corpus preparation: documents in, packed training sequences out.

``STAGES`` lists the steps in order; each takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next step's documents. All but the last return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import bound_batches, documents, materialize
from vigil.llm.lang_id import keep_identified
from vigil.llm.line_dedup import dedup_lines
from vigil.llm.mixing import mix_sources
from vigil.llm.packing import pack_documents
from vigil.llm.simhash import drop_near_duplicates

MIX_ALPHA, MIX_SEED, CAPACITY = 0.5, 17, 2048


def _columns(like: DataFrame, df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are given a language; those without text or a letter go."""
    bound_batches(spark)
    return _columns(docs, keep_identified(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the smallest document only; ``n_chars`` follows the text."""
    bound_batches(spark)
    kept = _columns(docs, dedup_lines(docs, min_chars=10))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    bound_batches(spark)
    return _columns(docs, drop_near_duplicates(docs, shingle=3, limit=2))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, globally shuffled."""
    bound_batches(spark)
    return _columns(docs, mix_sources(docs, alpha=MIX_ALPHA, seed=MIX_SEED))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of ``CAPACITY`` tokens."""
    bound_batches(spark)
    return pack_documents(docs, capacity=CAPACITY, tokenizer="word_bpe_49k.json", with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SimHash components and byte-pair ids have no SQL form; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
