"""A membership filter of bounded size that can always be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each key, and its 64-bit words at most: rows of two numbers, 16 MB.
BITS_PER_KEY = 16
MOST_WORDS = 1 << 20
#: With more keys a filter of MOST_WORDS would let most rows pass, so none is made.
MOST_KEYS = MOST_WORDS * 32


def filter_words(keys: int) -> int:
    """Words of a filter for so many keys: a power of two."""
    return min(MOST_WORDS, max(1 << 10, 1 << max(0, keys * BITS_PER_KEY // 64).bit_length()))


def _slot(h: Column, words: int) -> Column:
    return F.shiftrightunsigned(h, 6) % words


def _bit(h: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({h} & 63 as int))")


def marked(df: DataFrame, key: str | Column, keys: DataFrame, key_col: str, flag: str = "_maybe") -> DataFrame:
    """``df`` with a flag: false only where ``key`` is surely not in ``keys[key_col]``.

    ``keys`` is a written table: it is counted first and the filter sized by that, up to
    MOST_WORDS. Beyond MOST_KEYS the flag is true for all rows. An exact join must follow where
    false positives matter; the filter only saves that join's shuffle.
    """
    n = keys.count()
    if n > MOST_KEYS:
        return df.withColumn(flag, F.lit(True))
    words = filter_words(n)
    hashes = keys.select(F.xxhash64(key_col).alias("_h"))
    bits = hashes.select(_slot(F.col("_h"), words).alias("_slot"), _bit("_h").alias("_b")).groupBy("_slot").agg(F.bit_or("_b").alias("_bits"))
    hit = df.withColumn("_h", F.xxhash64(key)).withColumn("_slot", _slot(F.col("_h"), words)).join(F.broadcast(bits), "_slot", "left")
    return hit.withColumn(flag, F.coalesce(F.col("_bits").bitwiseAND(_bit("_h")) != 0, F.lit(False))).drop("_slot", "_h", "_bits")


def maybe_in(df: DataFrame, key: str | Column, keys: DataFrame, key_col: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``keys[key_col]``; none that is in it is lost."""
    return marked(df, key, keys, key_col).where("_maybe").drop("_maybe")


def without(df: DataFrame, key: str, keys: DataFrame, key_col: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``keys[key_col]``; only those that may be are shuffled."""
    rows = marked(df, key, keys, key_col)
    sure, rest = rows.where("not _maybe").drop("_maybe"), rows.where("_maybe").drop("_maybe")
    return sure.unionByName(rest.join(keys.select(F.col(key_col).alias(key)).distinct(), key, "left_anti").select(*sure.columns))
