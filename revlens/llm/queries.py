"""Registered queries of the corpus operators: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import (bpe_exact, bwt_dedup, byte_bpe, conversation_repair, decontaminate, fingerprints, minhash_tensor, part_codes, ppm,
                         secret_scan, surrogates, token_counts, toxicity)
from revlens.llm.frames import read
from revlens.llm.oracle import CODES_SQL, REPAIR_SQL

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}

#: DuckDB SQL of the queries that SQL can express
SQL: dict[str, str] = {"op11_conversation_repair": REPAIR_SQL, "op13_part_codes": CODES_SQL}


def register(fn: QueryFn) -> QueryFn:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def piece_model() -> str:
    """The public merge-type vocabulary file; its place is a parameter of the operators."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@register
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents"), piece_model())


@register
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_exact.report(read(spark, sf_dir, "documents"), piece_model())


@register
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(read(spark, sf_dir, "documents"))


@register
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_tensor.report(read(spark, sf_dir, "documents"))


@register
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_report(read(spark, sf_dir, "documents"))


@register
def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.report(read(spark, sf_dir, "documents"))


@register
def op2_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read(spark, sf_dir, "documents"), across=True)


@register
def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.report(read(spark, sf_dir, "documents"))


@register
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(read(spark, sf_dir, "conversations"))


@register
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return byte_bpe.report(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register
def op13_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.report(read(spark, sf_dir, "embeddings"))
