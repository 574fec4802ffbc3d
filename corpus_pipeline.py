"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, as Parquet; all but the last return the columns of
documents. The quality stage drops rejected texts; near-duplicates leave one document of
each group; secrets are masked in the text; mixing draws documents towards the target
weights; packing returns the place of each piece of every remaining document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domicilia.llm.mixing import TARGETS, Mixing, TopicModel, described
from domicilia.llm.near_dedup import NearDedup
from domicilia.llm.packing import Packing
from domicilia.llm.quality import QualityClassifier
from domicilia.llm.secrets import SecretScan
from domicilia.llm.tables import read, ship, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, those with empty texts included.

    All of them where it could not be fitted: without a trusted positive or a text to learn from.
    """
    ship(spark)
    classifier = QualityClassifier()
    model = classifier.model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.fitted:
        return docs
    scored = classifier.scored(docs, model, score="__score")
    return scored.filter(F.col("__score") >= classifier.threshold).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest id.

    Rows of one id count each for itself, so only those with equal or linked texts are dropped.
    Documents without words and those without id are in no group and stay.
    """
    ship(spark)
    known, key = docs.filter("doc_id IS NOT NULL"), "doc_id"
    if not known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        # Numbers in the order of ids; stored, so that they stay as they are.
        ordered = known.orderBy("doc_id", F.xxhash64("text"), "text")
        known, key = store(ordered.withColumn("__row", F.monotonically_increasing_id())), "__row"
    kept = NearDedup().run(known, doc_id=key).filter("kept").select(F.col("doc_id").alias(key))
    return known.join(kept, key, "left_semi").select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and the number of characters brought up to date."""
    ship(spark)
    masked = SecretScan().redacted(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn towards the target weights; those without words change no weight and stay.

    Rows without id draw like an empty id and rows of one id alike. Other columns of `docs` pass unchanged.
    """
    ship(spark)
    rows = described(docs, TopicModel().fit(docs), topic="__topic", tokens="__tokens")
    drawn = Mixing(TARGETS).weighted(rows, tokens="__tokens", columns={"topic": "__topic"}, prefix="__")
    return drawn.filter("__sampled OR __tokens = 0").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of every document in sequences of 2048 tokens, rows without id or of one id each for itself."""
    ship(spark)
    return Packing(public_tokenizers.path("byte_bpe_50k.json")).run(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each result stored in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
