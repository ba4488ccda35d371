"""MinHash near-dedup by min-max hashing: both extremes under each permutation are kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .banding import linked_components
from .filters import maybe_in, without
from .words import WordHashes, bounded_batches, held, mix, shingle_sets, slices

WORDS = 5
THRESHOLD = 0.8
#: 100 permutations give 200 values, in 40 bands of 5: a pair at similarity 0.8 is missed with probability (1 - 0.8**5)**40 = 1e-7.
BANDS, ROWS = 40, 5
#: 1024 bits.
SKETCH_WORDS = 16
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def signatures(value: np.ndarray, n: np.ndarray, bands: int, rows: int, seed: int = 7) -> np.ndarray:
    """Band hashes (texts x bands) from minima and maxima of half as many permutations as values.

    Under a permutation, the minima of two sets agree with the probability of their Jaccard
    similarity, and so do the maxima: each evaluation gives two unbiased samples.
    """
    perms = -(-bands * rows // 2)
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, perms, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, perms, np.uint64)
    full = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[full]
    sig = np.zeros((2 * perms, len(n)), np.uint64)
    if len(full):
        v = np.empty_like(value)
        for p in range(perms):
            np.multiply(value, a[p], out=v)
            v += b[p]
            sig[2 * p, full] = np.minimum.reduceat(v, starts)
            sig[2 * p + 1, full] = np.maximum.reduceat(v, starts)
    out = np.empty((len(n), bands), np.uint64)
    for j in range(bands):
        h = np.full(len(n), j + 1, np.uint64)
        for r in range(rows):
            h = mix(h + sig[j * rows + r])
        out[:, j] = h
    return out


def parity_sketch(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS 64-bit words for each set: bit i is the parity of its members that hash to i.

    The sketches of two sets differ in no more bits than the sets do in members, so a pair whose
    sketches differ in more bits than its similarity allows can be left out for certain.
    """
    out = np.zeros((len(n), SKETCH_WORDS), np.uint64)
    at = value >> np.uint64(64 - 10)
    np.bitwise_xor.at(out, (np.repeat(np.arange(len(n)), n), (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
    return out


def _features(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = held("hashes", WordHashes)
        for batch in batches:
            at = pa.array(range(batch.num_rows), pa.int64())
            for own, texts in slices(at, batch.column(1)):
                value, n = shingle_sets(texts, words, cache)
                sig = signatures(value, n, bands, rows)
                keys = _set_keys(value, n)
                offsets = pa.array(np.arange(0, len(n) * bands + 1, bands, dtype=np.int32))
                sketch = parity_sketch(value, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(own[0], len(own)), batch.column(2).slice(own[0], len(own)), pa.array(n), pa.array(keys[0]), pa.array(keys[1]), pa.ListArray.from_arrays(offsets, pa.array(sig.astype(np.int64).ravel()))]
                    + [pa.array(sketch[:, i]) for i in range(SKETCH_WORDS)],
                    names=["id", "row_hash", "n", "k1", "k2", "bands", *SKETCH],
                )

    return run


def _set_keys(value: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """128 bits that name each set, in two 64-bit words."""
    doc, keys = np.repeat(np.arange(len(n)), n), []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.zeros(len(n), np.uint64)
        np.add.at(total, doc, mix(value ^ np.uint64(salt)))
        keys.append(total.astype(np.int64))
    return keys


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = held("hashes", WordHashes)
        for batch in batches:
            for _, texts in slices(batch.column(0), batch.column(1)):
                value, n = shingle_sets(texts, words, cache)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(n), *map(pa.array, _set_keys(value, n)), pa.ListArray.from_arrays(offsets, pa.array(value.astype(np.int64)))], names=["n", "k1", "k2", "items"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a").join(right, "b")
        .withColumn("i", both)
        .where(100 * F.col("i") >= percent * (F.size("x") + F.size("y") - F.col("i")))
        .select("a", "b")
    )


def row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept, row_hash): near-duplicate components by word shingles.

    Texts with equal shingle sets are one class, named by its content, so that copies cost one
    row from there on. Classes that share a band are candidates; each pair is confirmed on full
    shingle sets unless its classes are already joined (see ``linked_components``).

    Null texts are empty; empty texts and rows with a null id link with nothing and are kept
    (a null id has a null component). Rows that repeat an id are returned each, by their own
    texts. Other columns are ignored.
    """
    percent = round(100 * threshold)
    source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), row_hash(id_col, text_col).alias("row_hash"))
    schema = "id long, row_hash long, n long, k1 long, k2 long, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH)
    features = staged(source.mapInArrow(_features(words, bands, rows), schema), "features")
    key = ["n", "k1", "k2"]
    classes = features.where("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("first"), F.any_value("bands").alias("bands"), *[F.any_value(c).alias(c) for c in SKETCH])
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes", release=True)  # numbered once written
    entries = classes.select(F.explode("bands").alias("h"), F.col("node").alias("rep"), F.col("first").alias("ord"))

    def confirm(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        nodes = staged(classes.select("node", *key, "first").join(nodes, "node", "left_semi"), "nodes")
        texts = maybe_in(source, "id", nodes, "first").join(nodes.select(F.col("first").alias("id")), "id", "left_semi").select("id", "text")
        sets = texts.mapInArrow(_sets(words), "n long, k1 long, k2 long, items array<long>").join(nodes, key).select("node", "items")
        return _linked(pairs, staged(sets.dropDuplicates(["node"]), "sets", release=True), percent)

    facts = classes.select(F.col("node").alias("rep"), F.col("n").alias("lo"), F.col("n").alias("hi"), *SKETCH)
    parts = linked_components(entries, facts, confirm, percent, "minhash")
    joined = staged(classes.select("node", *key, "first").join(parts, "node"), "joined")
    smallest = staged(joined.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    grouped = joined.select(*key, "component").join(smallest, "component").select(*key, "component_id")
    alone = classes.join(parts, "node", "left_anti").select(*key, F.col("first").alias("component_id"))
    out = features.drop("bands", *SKETCH).join(staged(grouped.unionByName(alone), "named"), key, "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), "row_hash"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` does not keep, all columns kept.

    A row goes by its id and text, so another text with the same id stays. Only rows that may
    go are shuffled.
    """
    gone = near_duplicates(docs, id_col, text_col, **options).where("not kept").select("row_hash").distinct()
    rows = docs.withColumn("_row_hash", row_hash(id_col, text_col))
    return without(rows, "_row_hash", staged(gone, "near-dropped", release=True), "row_hash").select(*docs.columns)
