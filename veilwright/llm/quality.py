"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators for a linear SVM."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import maybe_in
from .words import bounded_batches, held, mix, released, slices

#: N-grams are hashed to this many indicators.
BITS = 18
#: Labelled rows of each class that the support vector machine is fitted on, at most. Log-count ratios use all.
SAMPLE = 2500
CUT = 0.7
CACHE_CHUNKS = 150_000
LETTERS = 40

#: What shares of a text's tokens are other signs, digits, capitals, or words equal to one of the two tokens before: indicators of their own.
KINDS, STEPS = 4, 9

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\s+")


class ChunkTokens(dict):
    """32-bit hashes of the tokens of a chunk between white space, as bytes.

    Runs of letters are lower-cased, with a mark token before one written in capitals, and taken
    in successive pieces of LETTERS, as scripts without spaces have whole texts in one run, and so
    are runs of other signs; digits count by their number only. The two lowest bits tell letters
    (0), other signs (1), digits (2) and marks (3) apart.
    """

    def __missing__(self, chunk: bytes) -> bytes:
        out = []
        for token in _TOKEN.findall(chunk.decode("utf-8", "replace")):
            kind = 0 if token[0].isalpha() else 2 if token[0].isdigit() else 1
            if kind == 0 and len(token) > 1 and token.isupper():
                out.append(("^", 3))
            whole = f"0{len(token)}" if kind == 2 else token.lower()
            out += [(whole[k : k + LETTERS], kind) for k in range(0, len(whole), LETTERS)]
        value = np.array([xxhash.xxh32_intdigest(t.encode()) & ~3 | kind for t, kind in out], "<u4").tobytes()
        if len(chunk) < 64:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = value
        return value


def indicators(texts: list[bytes], cache: ChunkTokens, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indicators of each text, in order of texts, and how many each has.

    Hashed unigrams and bigrams are numbered below 2**bits; from there on come KINDS shares of
    the text's tokens in STEPS steps each, one indicator for each kind.
    """
    parts = [b"".join(map(cache.__getitem__, t.split())) for t in texts]
    n = np.array([len(p) // 4 for p in parts], np.int64)
    token = np.frombuffer(b"".join(parts), "<u4").astype(np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
    shift, wide = np.uint64(64 - bits), np.uint64(bits + 1)
    one = mix(token + np.uint64(1)) >> shift
    inside = doc[1:] == doc[:-1]
    two = (mix((token[:-1] << np.uint64(32)) + token[1:]) >> shift)[inside]
    key = np.unique(np.concatenate([(doc << wide) + one, (doc[1:][inside] << wide) + two]))
    kind = token & np.uint64(3)
    again = np.zeros(len(token), bool)
    for lag in (1, 2):
        again[lag:] |= (token[lag:] == token[:-lag]) & (doc[lag:] == doc[:-lag]) & (kind[lag:] == 0)
    extra = []
    for k, hit in enumerate((kind == 1, kind == 2, kind == 3, again)):
        share = np.bincount(doc[hit].astype(np.int64), minlength=len(texts)) / np.maximum(n, 1)
        step = np.minimum(np.ceil(share * (STEPS - 1)), STEPS - 1).astype(np.uint64)
        extra.append((np.arange(len(texts), dtype=np.uint64) << wide) + np.uint64((1 << bits) + k * STEPS) + step)
    key = np.sort(np.concatenate([key, *extra]))
    return (key & np.uint64((2 << bits) - 1)).astype(np.int32), np.bincount((key >> wide).astype(np.int64), minlength=len(texts)).astype(np.int64)


def table_size(bits: int) -> int:
    return (1 << bits) + KINDS * STEPS


def scales(index: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """What each indicator of each text counts: n-grams less in longer texts, shares always 1."""
    return np.where(index < 1 << bits, np.repeat(1 / np.sqrt(np.maximum(n, 1)), n), 1.0)


@dataclass
class NbSvm:
    """Weights over hashed indicators and the logistic map from margins to probabilities."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int = BITS

    def scores(self, index: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins(self.weights, self.bias, index, n, self.bits) + self.shift, -30, 30)))


def margins(weights: np.ndarray, bias: float, index: np.ndarray, n: np.ndarray, bits: int = BITS) -> np.ndarray:
    total = np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        total[full] = np.add.reduceat(weights[index] * scales(index, n, bits), (np.cumsum(n) - n)[full])
    return total + bias


def dual_coordinate_descent(index: np.ndarray, n: np.ndarray, y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, bits: int = BITS, epochs: int = 25, seed: int = 3) -> tuple[np.ndarray, float]:
    """A linear hinge-loss model over rows of indicators, each scaled by ``ratio`` and its share in the row.

    The rows lie one after the other in ``index``, ``n`` to each. One dual variable at a time is
    moved to its best value in 0..cost; the bias is the weight of a constant feature.
    """
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(n))
    values = (ratio[index] * scales(index, n, bits)).astype(np.float32)
    ends = np.cumsum(n)
    starts = ends - n
    norms = np.array([values[s:e] @ values[s:e] + 1 for s, e in zip(starts, ends, strict=True)])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(n)):
            at, own = index[starts[i] : ends[i]], values[starts[i] : ends[i]]
            grad = y[i] * (w[at] @ own + bias) - 1
            new = min(max(alpha[i] - grad / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * own
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of label 1 by margin, by damped Newton steps."""
    a, b, t = 1.0, 0.0, (y > 0).astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def log_count_ratios(sums: np.ndarray) -> np.ndarray:
    """Of smoothed shares of indicators in the good and the bad class; 0 for one that neither has.

    One count in all is added to each indicator, split between the classes as their totals are.
    """
    totals = np.maximum(sums.sum(axis=1, keepdims=True), 1)
    shares = (sums + totals / totals.sum()) / totals
    return np.log(shares[1]) - np.log(shares[0])


def _counts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sums = held("tokens", ChunkTokens), np.zeros((2, table_size(bits)), np.int64)
        for batch in batches:
            for labels, texts in slices(batch.column(0), batch.column(1)):
                index, n = indicators(texts, cache, bits)
                y = np.repeat(np.array(labels), n)
                for c in (0, 1):
                    sums[c] += np.bincount(index[y == c], minlength=table_size(bits))
        at = np.flatnonzero(sums.sum(axis=0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["i", "bad", "good"])

    return run


def _rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = held("tokens", ChunkTokens)
        for batch in batches:
            for labels, texts in slices(batch.column(0), batch.column(1)):
                index, n = indicators(texts, cache, bits)
                items = [r.astype("<i4").tobytes() for r in np.split(index, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), pa.array(items, pa.binary())], names=["y", "items"])

    return run


def _sample(taken: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, and the rows one after the other with the length of each, in an order that no partitioning sways."""
    labels, items = taken.column("y").to_numpy(), taken.column("items").to_pylist()
    order = sorted(range(len(items)), key=lambda i: (labels[i], items[i]))
    n = np.array([len(items[i]) // 4 for i in order], np.int64)
    return np.where(labels[order] == 1, 1.0, -1.0), np.frombuffer(b"".join([items[i] for i in order]), "<i4"), n


def _chosen(index: np.ndarray, n: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return index[np.repeat(keep, n)], n[keep]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, bits: int = BITS) -> NbSvm:
    """Fits on the texts of ``docs`` that ``labels`` marks 0 or 1.

    Log-count ratios come from all labelled texts. The support vector machine sees at most
    ``sample`` texts of each class, those whose ids hash lowest: three in four fit the weights,
    the rest the probabilities. The driver gets the counts of table_size(bits) indicators and the
    sample's rows. Null and other labels, and null ids, are ignored; of several labels for an id
    the lowest counts. With only one class the model gives that class for any text.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("long").alias("y"))
    source = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # one plan at every size: both sides are dealt by id, and only texts that may be labelled
    known = maybe_in(source, "id", marked, "id").join(marked.hint("merge"), "id").select("y", "text")
    counts = known.mapInArrow(_counts(bits), "i int, bad long, good long").groupBy("i").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    sums = np.zeros((2, table_size(bits)))
    at = counts.column("i").to_numpy()
    sums[0][at], sums[1][at] = counts.column("bad").to_numpy(), counts.column("good").to_numpy()
    ratio = log_count_ratios(sums)
    few = [marked.where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(sample) for c in (0, 1)]
    picked = F.broadcast(few[0].union(few[1]))  # at most 2 * sample rows
    y, index, n = _sample(source.join(picked, "id").select("y", "text").mapInArrow(_rows(bits), "y long, items binary").toArrow())
    del counts, sums, at
    if len(set(y)) < 2:
        return NbSvm(np.zeros(table_size(bits), np.float32), 0.0, 1.0, 0.0 if not len(y) else 5.0 * y[0], bits)
    fitting = np.arange(len(y)) % 4 > 0 if len(y) >= 40 else np.ones(len(y), bool)
    share = np.array([(y[fitting] == c).mean() for c in (-1, 1)])
    cost = np.where(y[fitting] < 0, 0.5 / share[0], 0.5 / share[1])
    w, bias = dual_coordinate_descent(*_chosen(index, n, fitting), y[fitting], ratio, cost, bits)
    weights = (w * ratio).astype(np.float32)
    rest = ~fitting if len(y) >= 40 else fitting
    slope, shift = logistic(margins(weights, bias, *_chosen(index, n, rest), bits), y[rest])
    del index, n, w, ratio
    released()
    return NbSvm(weights, bias, slope, shift, bits)


def _scored(model: NbSvm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = held("tokens", ChunkTokens)
        for batch in batches:
            for ids, texts in slices(batch.column(0), batch.column(1)):
                index, n = indicators(texts, cache, model.bits)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(model.scores(index, n))], names=["id", "score"])

    return run


def quality_scores(docs: DataFrame, model: NbSvm, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(id, score, predicted) for each row: the probability of label 1, and 1 where it reaches ``cut``.

    The whole text alone is read. Null texts are empty, and an empty text gets the score of a
    text without n-grams. Null and repeated ids are returned as they are; other columns are
    ignored.
    """
    source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(_scored(model), "id long, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _passing(model: NbSvm, column: int, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = held("tokens", ChunkTokens)
        for batch in batches:
            at = pa.array(range(batch.num_rows), pa.int64())
            keep = [model.scores(*indicators(texts, cache, model.bits)) >= cut for _, texts in slices(at, batch.column(column))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return run


def drop_rejected(docs: DataFrame, model: NbSvm, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose text scores ``cut`` or more, with all columns; texts are not shuffled."""
    return bounded_batches(docs).mapInArrow(_passing(model, docs.columns.index(text_col), cut), docs.schema)
