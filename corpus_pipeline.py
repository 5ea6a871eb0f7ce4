"""Documents to training tokens: five stages, each of one operator, each written as Parquet and read by the next.

All stages but the last return the columns of ``documents``. Toxic documents go, then those that the trusted text's
language model finds too surprising, then all but one of each group of near duplicates (word shingles of five,
similarity 0.8); sources are mixed to their weights (documents leave or repeat); the rest is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, jaccard_join, kn_quality, source_mix, toxicity
from tidelog.llm.shared import bounded_batches, materialize, table

#: No stage can be stated in SQL: two of them train models, one follows hashes of its own, one merges bytes.
ORACLE_SQL = None

#: One executor goes through all stages and keeps what its JVM has grown to, so that here batches, runs and blocks are smaller than the operators' own. Results are the same.
BATCH_BYTES, RUN_CHARS, BLOCK_CHARS = 2_000_000, 3_000_000, 12_000_000


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic. Null and empty texts score as one empty sentence; without labels nothing goes; repeated rows share a fate."""
    bounded_batches(spark, BATCH_BYTES)
    model = toxicity.train_all(docs, table(spark, sf_dir, "labels"), fit_rows=4000, fit_words=5_000_000)
    return toxicity.keep_clean(docs, model)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that surprise the model of trusted text beyond their language's limit. Texts without characters stay; a null text comes out empty; without labels nothing goes."""
    bounded_batches(spark, BATCH_BYTES)
    own = docs.columns
    scored = kn_quality.kn_quality(docs, table(spark, sf_dir, "labels"), carry=tuple(own), block_chars=BLOCK_CHARS).where("kept")
    return scored.select(*[F.col("text" if c == "text" else f"own_{c}").alias(c) for c in own])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id. Documents without words all stay; of rows that repeat id and text one stays."""
    bounded_batches(spark, BATCH_BYTES)
    return jaccard_join.one_of_each(docs, jaccard_join.jaccard_join(docs, k=5, num=80))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their weights: documents leave or repeat. Documents without words leave; a null source is one source."""
    return source_mix.mixed(docs, weights=(3, 1, 2), share=1.0, most=2.0)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row; a null text has none."""
    bounded_batches(spark, BATCH_BYTES)
    return bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, run_chars=RUN_CHARS)


STAGES = [("toxicity", clean), ("quality classifier", good), ("n-gram Jaccard join", distinct), ("mixing sources", mixed), ("byte-level BPE", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, n_tokens, ids."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
