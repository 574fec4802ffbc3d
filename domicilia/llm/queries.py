"""The package's registered queries and their checking SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from domicilia.llm.embedding_dedup import EmbeddingDedup
from domicilia.llm.masked_lm import MaskedLM
from domicilia.llm.merkle import ORACLE as MERKLE_SQL
from domicilia.llm.merkle import MerkleManifest
from domicilia.llm.mixing import TARGETS, Mixing
from domicilia.llm.near_dedup import NearDedup
from domicilia.llm.nearest import NearestNeighbours
from domicilia.llm.packing import Packing
from domicilia.llm.quality import QualityClassifier
from domicilia.llm.secrets import SecretScan
from domicilia.llm.substring_dedup import SubstringDedup
from domicilia.llm.tables import read
from domicilia.llm.token_count import TokenCount
from domicilia.llm.token_files import TokenFiles
from domicilia.llm.whitening import Whitening


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mixing(TARGETS).run(read(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearestNeighbours().run(read(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Packing(public_tokenizers.path("byte_bpe_50k.json")).run(read(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDedup().run(read(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SecretScan().run(read(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MaskedLM().run(read(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QualityClassifier().run(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SubstringDedup().run(read(spark, sf_dir, "documents"), with_text=False)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TokenCount(public_tokenizers.path("byte_bpe_50k.json")).run(read(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EmbeddingDedup().run(read(spark, sf_dir, "embeddings"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TokenFiles(public_tokenizers.path("word_bpe_49k.json")).run(read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MerkleManifest().run(read(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Whitening().run(read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_nearest_neighbours,
        op3_best_fit_packing,
        op4_minhash_near_dedup,
        op5_secret_scan,
        op6_lm_scoring,
        op7_quality_classifier,
        op8_substring_dedup,
        op9_token_counts,
        op10_embedding_near_dedup,
        op11_token_files,
        op12_merkle_manifest,
        op13_embedding_whitening,
    )
}

ORACLE_SQL: dict[str, str] = {"op12_merkle_manifest": MERKLE_SQL}
