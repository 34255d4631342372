"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import bytepair, centroids, decontaminate, langid, media, neardup, oracles, packing, quality, substrings, tokenfile, tokens, vecdup, whitening

IDS = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), PIECES)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(_table(spark, sf_dir, "documents"))


def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents"))


def op4_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdup.grouped(_table(spark, sf_dir, "embeddings"))


def op6_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), IDS, PATTERN)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(_table(spark, sf_dir, "documents"), IDS, PATTERN)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepair.digests(_table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(_table(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """For near-duplicates, vectors and repeats. The others tokenize, train or write files, which SQL can't express;
    their tests hold them against the tokenizer libraries, held-out rows and exact round trips."""
    return oracles.oracle_sql()
