"""From band entries to linked components without pairing whole buckets."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_scope, staged
from .filters import maybe_in
from .graph import connected_components

#: Entries with their facts that are paired at a time, about.
OPEN_ROWS = 300_000


def linked_components(entries: DataFrame, facts: DataFrame, confirm: Callable[[DataFrame], DataFrame], percent: int, tag: str, finer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) for each node that a confirmed link names; the component is its smallest node.

    ``entries`` has (h, rep, ord): node ``rep``, of rank ``ord``, is in bucket ``h``. ``facts`` has for each node a lower
    and an upper bound ``lo`` and ``hi`` of its set's size, and 64-bit words of a sketch: two
    sketches differ in no more bits than the sets do in members. ``confirm`` gives those of the
    pairs (a, b) whose full sets overlap enough. Each bucket's node of lowest rank, the original
    where copies come later, is first compared with the others. Buckets whose nodes are then in one component are done; in the others, all
    pairs across components are compared too. So every pair that shares a bucket is compared
    unless its nodes are already joined, and a bucket of like nodes costs one comparison each.
    Pairs whose sizes or sketches rule out ``percent`` of overlap for certain are left out first.
    ``finer`` gives narrower facts, with sketches of any width, of the nodes (node) that are left
    when buckets' first nodes have been compared. What is left is paired some buckets at a time.
    """
    words = lambda facts: [c for c in facts.columns if c not in ("rep", "lo", "hi")]
    possible = lambda facts: f"100 * hi_a >= {percent} * lo_b and 100 * hi_b >= {percent} * lo_a and " + " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in words(facts)) + f" <= (hi_a + hi_b) * {100 - percent} / {100 + percent}"
    of = lambda side: facts.select(*[F.col(c).alias(f"{c}_{side}") for c in facts.columns])
    buckets = entries.groupBy("h").agg(F.min_by("rep", "ord").alias("center"), F.count("*").alias("n")).where("n > 1").select("h", "center")
    buckets = staged(buckets, f"{tag}-buckets", release=True)
    shared = staged(maybe_in(entries, "h", buckets, "h").join(buckets, "h").select("h", "rep", "center"), f"{tag}-shared", release=True)
    stars = staged(shared.where("rep <> center").select(F.least("center", "rep").alias("a"), F.greatest("center", "rep").alias("b")).distinct(), f"{tag}-stars", release=True)
    near = stars.join(of("a"), F.col("a") == F.col("rep_a")).join(of("b"), F.col("b") == F.col("rep_b")).where(possible(facts)).select("a", "b")
    links = staged(confirm(staged(near, f"{tag}-near", release=True)), f"{tag}-links", release=True)
    parts = staged(connected_components(links, "a", "b"), f"{tag}-parts")
    # a bucket's center has met all others, so pairs are left only where those are of several components
    placed = shared.where("rep <> center").join(parts, shared["rep"] == parts["node"], "left").select("h", "rep", F.coalesce("component", "rep").alias("part"))
    placed = staged(placed, f"{tag}-placed", release=True)
    mixed = placed.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("h")
    left = staged(placed.join(staged(mixed, f"{tag}-mixed"), "h", "left_semi"), f"{tag}-open", release=True)
    if finer:
        facts = finer(left.select(F.col("rep").alias("node")).distinct())
    passes, found = max(1, -(-left.count() // OPEN_ROWS)), []
    for k in range(passes):
        with scratch_scope(left.sparkSession):
            wide = staged(left.where(F.pmod(F.xxhash64("h"), F.lit(passes)) == k).join(facts, "rep"), f"{tag}-wide", release=True)
            one, two = (wide.select("h", *[F.col(c).alias(f"{c}_{side}") for c in ("part", *facts.columns)]) for side in "ab")
            pairs = one.join(two, "h").where("rep_a < rep_b and part_a <> part_b").where(possible(facts)).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
            found.append(staged(pairs.distinct(), f"{tag}-found", lasting=True, release=True))
    rest = functools.reduce(DataFrame.union, found)
    rest = staged(rest.distinct().join(stars, ["a", "b"], "left_anti"), f"{tag}-rest", release=True)
    if rest.isEmpty():
        return parts
    more = staged(confirm(rest), f"{tag}-more", release=True)
    if more.isEmpty():
        return parts
    return staged(connected_components(links.union(more), "a", "b"), f"{tag}-parts")
