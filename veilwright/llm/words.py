"""Word and shingle hashing on whole texts, shared by the operators that read Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Texts are worked on in slices of about this many bytes, so that arrays stay small whatever the batch holds.
SLICE_BYTES = 2 << 20
CACHE_WORDS = 150_000


class WordHashes(dict):
    """64-bit hashes of words (bytes); forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: Rows of an Arrow batch at most. Texts may be long, and a batch is held whole on both sides.
BATCH_ROWS = 1000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches were cut to BATCH_ROWS if they were larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


_held: dict = {}


def released() -> None:
    """Gives what this process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def held(kind, make):
    """What ``make`` gave in this worker process for ``kind``, kept from task to task; one kind at a time.

    A function that is sent to workers has to call this rather than name a module's variable, of
    which each task would get its own copy.
    """
    if kind not in _held:
        if _held:
            _held.clear()
            released()  # else what the last kind held stays with the process
        _held[kind] = make()
    return _held[kind]


def slices(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts as bytes (null: empty), about SLICE_BYTES at a time."""
    ids, texts = ids.to_pylist(), texts.cast(pa.large_binary()).to_pylist()
    begin = size = 0
    for i, text in enumerate(texts):
        if text is None:
            texts[i] = b""
        else:
            size += len(text)
        if size >= SLICE_BYTES:
            yield ids[begin : i + 1], texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield ids[begin:], texts[begin:]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each bit of the input sways each bit of the result."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingle_sets(texts: list[bytes], width: int, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and how many each text has.

    Words are what ASCII white space parts, A-Z lower-cased. A text of fewer words than
    ``width`` is one shingle, its whole sequence; a text without words has none.
    """
    words: list[bytes] = []
    counts = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.lower().split()
        counts[i] = len(own)
        words += own
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    ends = np.cumsum(counts)
    n_shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), n_shingles)
    first = np.cumsum(n_shingles) - n_shingles
    at = np.arange(len(doc)) - first[doc] + (ends - counts)[doc]
    value = np.zeros(len(doc), np.uint64)
    short = counts[doc] < width
    for j in range(width):
        inside = at + j < ends[doc]
        word = hashes[np.minimum(at + j, max(len(hashes) - 1, 0))] if len(hashes) else value
        value = np.where(inside, mix(value + word + np.uint64(j + 1)), value)
    value = np.where(short, mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), value)
    order = np.lexsort((value, doc)) if len(texts) > 1 else np.argsort(value)
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[keep], np.bincount(doc[keep], minlength=len(texts)).astype(np.int64)
