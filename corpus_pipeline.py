"""Corpus cleaning: each stage works on all that the one before it kept.

Documents that the quality classifier rejects go; of equal texts one stays; of near-duplicate
texts one stays; secrets are replaced in the text; what is left is packed into sequences. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm import exact, minhash, packing, quality, queries, secrets
from veilwright.session import scratch_scope, staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects; it is fitted on the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.drop_rejected(docs, queries.quality_model(docs, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret; ``n_chars`` follows the text."""
    out = secrets.redact_secrets(docs, secrets.secret_findings(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.WORD_BPE)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("secret_scans", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier, the forest and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch_scope(spark):  # a stage's own tables go once its result is written
            docs = staged(stage(spark, docs, sf_dir), name, lasting=True, release=True)
    return docs
