"""The queries of this subpackage, each an operator on a whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embeddings, exact, lines, minhash, packing, quality, secrets, urls

#: Where the vocabulary files of the public tokenizers lie on every machine.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.NbSvm:
    return quality.fit(docs, labels.where(~held_out()))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "secret")


def op2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), hash_all=True)


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null")
    ids = turns.select("conv_id").distinct()
    chosen = ids.where("conv_id % 2 = 0").select(F.expr("conv_id div 2").alias("pair_id"), F.col("conv_id").alias("chosen_id"))
    rejected = ids.where("conv_id % 2 = 1").select(F.expr("conv_id div 2").alias("pair_id"), F.col("conv_id").alias("rejected_id"))
    out = chat.preference_pairs(turns, chosen.join(rejected, "pair_id"))
    show = lambda m: F.array_join(F.transform(m, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumns({m: show(m) for m in ("chosen_mask", "rejected_mask")})


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.quality_scores(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.fuzzy_lines(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    outcomes = table(spark, sf_dir, "labels").where("quality is not null").select(F.col("doc_id").alias("page_id"), F.coalesce(bad, F.lit(0)).alias("bad"))
    return urls.filter_urls(table(spark, sf_dir, "pages"), outcomes, urls.RULES)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), BYTE_BPE, keep=False)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_exact": op2_exact,
    "op3_preferences": op3_preferences,
    "op4_embeddings": op4_embeddings,
    "op5_quality": op5_quality,
    "op6_lines": op6_lines,
    "op7_urls": op7_urls,
    "op8_bpe": op8_bpe,
    "op9_packing": op9_packing,
    "op10_minhash": op10_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact": exact.EXACT_SQL,
    "op3_preferences": chat.CHAT_SQL,
    "op7_urls": urls.URLS_SQL,
}
