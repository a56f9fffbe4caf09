"""Corpus cleaning pipeline: toxicity, near-duplicates, benchmark leaks, personal data, token ids.

``run(spark, sf_dir)`` applies ``STAGES`` in order to ``documents``. The rows
that a stage returns are written as Parquet in the shared checkpoint folder
and read again as the next stage's documents. All stages but the last return
the columns of ``documents``; every stage works on all that its predecessor
kept. Stages take null texts and ids, empty texts, repeated rows, empty tables
and further columns, as their operators define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import bpe_exact, decontaminate, minhash_tensor, surrogates, toxicity
from revlens.llm.frames import checkpoint_dir, read
from revlens.llm.queries import piece_model


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score accepts; learned from the labelled rows of ``documents``."""
    return toxicity.accepted(docs, read(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a similarity of 0.8 or more."""
    return minhash_tensor.one_of_each(docs, words=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans of benchmark items; documents mostly made of them go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with keyed surrogates for personal data."""
    return surrogates.replace(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and decoded_sha256 (of the ids' text) of every document that is left."""
    return bpe_exact.token_rows(docs, piece_model())


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_near_duplicates), ("decontamination", without_benchmark),
          ("pii", with_surrogates), ("sentencepiece", token_ids)]

#: stages learn, hash, draw and tokenise, which SQL does not express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
