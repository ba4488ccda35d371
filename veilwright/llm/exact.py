"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .filters import marked, maybe_in

#: Code points of the normalised text that the second step hashes.
PREFIX = 64


def normalised(text: Column) -> Column:
    """``text`` without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _bodies(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the normalised text, the code points of the original, and a hash of length and prefix."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumns({"_n_raw": F.length(text).cast("long"), "_body": normalised(text)})
    return rows.withColumn("_open_hash", F.xxhash64(F.length("_body"), F.xxhash64(F.substring("_body", 1, PREFIX))))


def _open(bodies: DataFrame) -> DataFrame:
    """(h): of the texts that share their length with another, then their prefix too."""
    lengths = bodies.select(F.length("_body").alias("n"), F.xxhash64(F.substring("_body", 1, PREFIX)).alias("p"))
    counted = staged(lengths.groupBy("n", "p").agg(F.count("*").alias("c")), "prefixes")
    same_length = counted.groupBy("n").agg(F.sum("c").alias("c")).where("c > 1").select("n")
    same_prefix = counted.where("c > 1").join(same_length, "n", "left_semi")
    return staged(same_prefix.select(F.xxhash64("n", "p").alias("h")), "open-hashes")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row of ``docs``.

    Texts are equal if they are once ASCII white space is deleted. Of equal texts the one with
    the most code points stays, then the smallest id. Rows whose length nobody shares are done
    after the first step, rows whose length and prefix hash nobody shares after the second;
    only the rest is hashed in full. ``hash_all`` hashes every row for callers that store the
    digest; otherwise ``text_sha256`` is null where it was not needed.

    Null texts are empty, and all empty texts are one group. Null ids order last; of rows that
    repeat the same id the group counts each, and each is kept if its id is. Other columns are
    ignored.

    The first two steps move numbers only. What they leave is marked in a filter of fixed size
    that the second reading of the texts consults, so that texts are never shuffled.
    """
    body = _bodies(docs, text_col).select(F.col(id_col).alias("id"), "_n_raw", "_body", "_open_hash")
    digest = F.sha2("_body", 256)
    read = marked(body, "_open_hash", _open(body), "h", "open").withColumnRenamed("_n_raw", "n_raw")
    rows = staged(read.select("id", "n_raw", "open", (digest if hash_all else F.when(F.col("open"), digest)).alias("sha")), "hashed")
    best = F.min(F.struct((-F.col("n_raw")).alias("short"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    groups = rows.where("open").groupBy("sha").agg(best.alias("best"), F.count("*").alias("size"))
    groups = staged(groups.where("size > 1").select("sha", F.col("best.id").alias("keep"), "size"), "groups")
    out = rows.join(groups, (rows["sha"] == groups["sha"]) & rows["open"], "left").select(rows["id"], rows["sha"], "keep", "size")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    Rows are told apart by their texts: one that repeats another's id, or has none, is kept or
    dropped by its own. Of equal texts the row with the most code points stays, then the
    smallest id (null last); of rows that still tie, the one whose columns hash lowest. Whole
    rows that repeat are one. Only rows that stay, and few others, are shuffled.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    bodies = _bodies(docs.toDF(*names), names[docs.columns.index(text_col)])
    key = F.col(names[docs.columns.index(id_col)])
    rows = marked(bodies, "_open_hash", _open(bodies), "h")
    rank = F.struct((-F.col("_n_raw")).alias("short"), key.isNull().alias("none"), key.alias("id"), F.xxhash64(*names).alias("row"))
    rest = rows.where("_maybe").select(*names, F.sha2("_body", 256).alias("_sha"), rank.alias("_rank"))
    best = staged(rest.groupBy("_sha").agg(F.min("_rank").alias("_rank")).select("_sha", "_rank", F.xxhash64("_sha", "_rank").alias("_key")), "exact-best")
    stay = maybe_in(rest.withColumn("_key", F.xxhash64("_sha", "_rank")), "_key", best, "_key").withColumn("_text_rank", F.to_json("_rank"))
    kept = stay.join(best.select(F.col("_sha"), F.to_json("_rank").alias("_text_rank")), ["_sha", "_text_rank"], "left_semi")
    kept = kept.dropDuplicates(["_sha"]).select(*names)
    return rows.where("not _maybe").select(*names).unionByName(kept).toDF(*docs.columns)


#: The same result in one statement over ``documents``.
EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents
), k AS (SELECT doc_id, length(raw) AS n_raw, sha256(body) AS text_sha256 FROM t)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_raw DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_raw DESC, doc_id) AS kept,
  text_sha256
FROM k
"""
