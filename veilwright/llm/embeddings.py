"""Embedding near-dedup: random-hyperplane sign hashes, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .graph import connected_components

THRESHOLD = 0.95
#: A pair at the threshold is missed by all tables with at most this probability.
MISS = 1e-4
#: Classes of a bucket that are compared in one step, about.
TILE = 1000


def plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a table's hash, and tables.

    Bits follow the logarithm of the number of vectors, so that unrelated vectors share a
    bucket with few others at any size; the number of tables then follows from ``miss``.
    """
    bits = min(30, max(4, math.ceil(math.log2(max(n, 2))) - 2))
    same = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(miss) / math.log(1 - same**bits))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors that can link, and the vectors, for each dimension in a batch.

    Left out are null, empty and zero vectors and those with a null or non-finite component.
    """
    n = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten()  # leaves out what null lists may hold
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(n) - n
    for dim in np.unique(n[n > 0]):
        at = np.flatnonzero(n == dim)
        x = values[starts[at][:, None] + np.arange(dim)]
        good = np.isfinite(x).all(axis=1) & x.any(axis=1)
        if good.any():
            yield at[good], x[good] + 0.0


def _features(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            bad = np.ones(batch.num_rows, bool)
            for at, x in _matrices(batch.column(1)):
                bad[at], dim = False, x.shape[1]
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))
                side = (x / np.abs(x).max(axis=1, keepdims=True)) @ planes[dim] > 0
                code = side.reshape(len(at), tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                code += (np.arange(tables, dtype=np.int64) + np.int64(dim) * 4096) << np.int64(32)
                yield _batch(batch.column(0).take(pa.array(at)), x, code)
            if bad.any():
                yield _batch(batch.column(0).filter(pa.array(bad)), None, None)

    return run


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _batch(ids: pa.Array, x: np.ndarray | None, code: np.ndarray | None) -> pa.RecordBatch:
    if x is None:
        rest = [pa.nulls(len(ids), t) for t in (pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int64()))]
    else:
        rest = [pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in x], pa.binary()), _lists(x), _lists(code)]
    return pa.RecordBatch.from_arrays([ids, *rest], names=["id", "key", "vector", "codes"])


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def _compare(rows: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, copies): of each node ``a`` how many vectors it links with, and one node ``b`` of its component here.

    The rows are those of one pair of tiles of one bucket. A pair counts in the first table in
    which its codes agree, so that no other bucket counts it too.
    """
    x, tile, codes, table = rows["vector"], rows["tile"], rows["codes"], rows["table"]
    low, high = np.flatnonzero(tile == tile.min()), np.flatnonzero(tile == tile.max())
    same = tile.min() == tile.max() and rows["lone"]
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    i, j = np.nonzero(unit[low] @ unit[high].T >= threshold - 1e-9)
    i, j = low[i], high[j]
    if same:
        i, j = i[i < j], j[i < j]
    linked = _cosines(x[i], x[j]) >= threshold
    i, j = i[linked], j[linked]
    first = ~(codes[i, :table] == codes[j, :table]).any(axis=1) if table else np.ones(len(i), bool)
    i, j = i[first], j[first]
    if not len(i):
        return (np.zeros(0, np.int64),) * 3
    near = np.zeros(len(x), np.int64)
    np.add.at(near, i, rows["copies"][j])
    np.add.at(near, j, rows["copies"][i])
    parent = np.arange(len(x))
    while True:  # the least place that links reach
        before = parent.copy()
        least = np.minimum(parent[i], parent[j])
        np.minimum.at(parent, i, least)
        np.minimum.at(parent, j, least)
        parent = parent[parent]
        if (parent == before).all():
            break
    at = np.flatnonzero(near)
    return rows["node"][at], rows["node"][parent[at]], near[at]


def _tiles(tables: int, threshold: float):
    """Compares the rows of each (code, low, high), which come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(found: list) -> pa.RecordBatch:
            a, b, near = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else ((), (), ())))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(near)], names=["a", "b", "near"])

        def groups(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            rows = rows.combine_chunks()
            column = lambda name: rows.column(name).combine_chunks()
            flat = {n: column(n).to_numpy(zero_copy_only=False) for n in ("code", "low", "high", "tile", "node", "copies")}
            codes = column("codes").flatten().to_numpy().reshape(-1, tables)
            vectors = column("vector")
            starts, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            change = np.ones(rows.num_rows + 1, bool)
            change[1:-1] = (np.diff(flat["code"]) != 0) | (np.diff(flat["low"]) != 0) | (np.diff(flat["high"]) != 0)
            ends = np.flatnonzero(change)
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                if e - s > 1:
                    own = {k: v[s:e] for k, v in flat.items()} | {"codes": codes[s:e], "vector": values[starts[s] : starts[e]].reshape(e - s, -1)}
                    own |= {"table": int(own["code"][0] >> 32) % 4096, "lone": own["low"][0] == own["high"][0]}
                    if own["lone"] or own["tile"].min() != own["tile"].max():
                        yield _compare(own, threshold)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            last = [rows.column(n)[-1].as_py() for n in ("code", "low", "high")]
            # what belongs to the last group waits for the next batch
            tail = np.ones(rows.num_rows, bool)
            for name, value in zip(("code", "low", "high"), last, strict=True):
                tail &= rows.column(name).to_numpy() == value
            cut = int(np.flatnonzero(~tail).max(initial=-1)) + 1
            if cut:
                yield done([f for f in groups(rows.slice(0, cut)) if len(f[0])])
                held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield done([f for f in groups(pa.Table.from_batches(held)) if len(f[0])])

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    miss: float = MISS,
    seed: int = 11,
) -> DataFrame:
    """(id, n_links, component_id, kept): links at a cosine of ``threshold`` or more.

    Equal vectors are one class with a count, named by its content, so copies cost one row from
    there on. The classes of a table's bucket are dealt to tiles of about TILE, and each two
    tiles are compared in one step: candidates from a matrix product, then cosines in double
    precision. What comes out is a row for each class and step, with the number of vectors that
    it links with, and no pairs.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing
    (0 links, own component, kept); so do rows with a null id (null component). Vectors of
    different dimensions never link. Other columns are ignored.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bits, tables = plan(source.count(), threshold, miss)
    features = staged(source.mapInArrow(_features(bits, tables, seed), "id long, key binary, vector array<double>, codes array<long>"), "signs")
    good = features.where("key is not null and id is not null")
    classes = good.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.any_value("codes").alias("codes"), F.any_value("vector").alias("vector"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")  # numbered once written
    entries = classes.select("node", F.explode("codes").alias("code"))
    buckets = entries.groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
    buckets = staged(buckets.select("code", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "vector-buckets")
    placed = staged(entries.join(buckets, "code").select("node", "code", "tiles", F.pmod(F.xxhash64("node", "code"), "tiles").cast("int").alias("tile")), "vector-places")
    # a bucket of one tile is compared with itself; of several, each two tiles and each by itself
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = other.select("node", "code", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    full = dealt.join(classes.select("node", "vector", "codes", "copies"), "node")
    ordered = full.repartition("code", "low", "high").sortWithinPartitions("code", "low", "high")
    names = ["code", "low", "high", "tile", "node", "copies", "codes", "vector"]
    found = staged(ordered.select(*names).mapInArrow(_tiles(tables, threshold), "a long, b long, near long"), "vector-links", release=True)
    parts = staged(connected_components(found.select("a", "b"), "a", "b"), "vector-parts")
    degree = found.groupBy(F.col("a").alias("node")).agg(F.sum("near").alias("near"))
    own = classes.select("node", "key", "first", "copies").join(degree, "node", "left").join(parts, "node", "left")
    own = staged(own.select("key", "first", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"), "component"), "vector-own")
    smallest = staged(own.where("component is not null").groupBy("component").agg(F.min("first").alias("part")), "vector-smallest")
    named = staged(own.join(smallest, "component", "left").select("key", "links", F.coalesce("part", "first").alias("part")), "vector-named")
    out = features.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    component = F.coalesce("part", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
