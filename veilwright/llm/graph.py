"""Distributed connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Alternations of the two star steps are logarithmic in the longest path; this only stops a bug.
MAX_ROUNDS = 60


def _mark(edges: DataFrame):
    """How many edges there are, and 128 bits of hash of their set; each edge occurs once."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): each node that an edge names, with the smallest node it reaches.

    Large-star and small-star alternate until the edges no longer change. A node's edges are
    never gathered: minima are pre-aggregated before the shuffle, and the joins back to the
    edges read written tables, so that AQE can split a hub over many tasks. Self-loops, nulls
    and repeated edges are allowed; nulls are ignored. Each round is written to the scratch
    folder, so a lost executor costs one round at most.
    """
    loops = edges.where(F.col(src) == F.col(dst)).select(F.col(src).alias("node")).distinct()
    pairs = edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    current = staged(pairs.distinct(), "edges")
    mark = _mark(current)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct(), "large")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = staged(small.union(low).distinct(), "edges")
        mark, before = _mark(current), mark
        if mark == before:
            break
    else:
        raise RuntimeError("connected components did not settle")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    known = stars.union(roots)
    return known.union(loops.join(known, "node", "left_anti").select("node", F.col("node").alias("component")))
