"""Best-two-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .words import bounded_batches, held, slices

CAPACITY = 4096
END = 1
#: Pieces packed together. A group leaves about one sequence short, out of more than a thousand.
GROUP = 4096
#: A sequence with more room than this share is taken apart once more, with those of other groups.
LOOSE = 0.01
#: Chunks and their parts that a worker remembers, about 200 bytes each.
CACHE_CHUNKS, CACHE_PARTS = 300_000, 600_000

#: Latin letters whose lower case is one letter too.
_PLAIN = re.compile("([a-zÀ-ÖØ-öø-\u012f\u0131-ɏ]+)([,.!?;:*$%&#|]+)")


class ChunkIds(dict):
    """Little-endian 32-bit token ids of a chunk of text between ASCII white space, as bytes.

    The tokenizer's normaliser and splitter never look across white space, so the ids of a text
    are those of its chunks in order. Letters and a run of ASCII punctuation behind them are
    also split from each other, so frequent words are encoded once whatever follows them.
    """

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.parts: dict[str, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        text = chunk.decode()
        split = _PLAIN.fullmatch(text)
        value = self[chunk] = self._part(split[1]) + self._part(split[2]) if split else self._part(text)
        return value

    def _part(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            if len(self.parts) >= CACHE_PARTS:
                self.parts.clear()
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            found = self.parts[text] = np.array(ids, "<u4").tobytes()
        return found

    def ids(self, text: bytes) -> bytes:
        """A-Z are lower-cased first, as the tokenizer would, unless a special token's ``<|`` occurs."""
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


def _pieces(path: str, capacity: int, end: int):
    step, tail = 4 * capacity, np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held(("ids", path), lambda: ChunkIds(path)).ids
        for batch in batches:
            for ids, texts in slices(batch.column(0), batch.column(1)):
                rows = []
                for key, text in zip(ids, texts, strict=True):
                    body = encode(text) + tail
                    for k, at in enumerate(range(0, len(body), step)):
                        part = body[at : at + step]
                        rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32"])

    return run


def best_two_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and the filled length of each bin.

    A bin takes the longest item that fits until none does. If room is left, its smallest item
    goes back for two waiting ones whose sum is nearer to the room that it would free.
    """
    stacks: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        stacks.setdefault(n, []).append(i)
    have = 0
    for n in stacks:
        have |= 1 << n
    bins, offsets, fill = [0] * len(lengths), [0] * len(lengths), []

    def longest(room: int) -> int:
        return (have & ((2 << room) - 1)).bit_length() - 1

    def take(n: int) -> int:
        nonlocal have
        item = stacks[n].pop()
        if not stacks[n]:
            have ^= 1 << n
        return item

    while have:
        own, room = [], capacity
        while room and (n := longest(room)) > 0:
            own.append((n, take(n)))
            room -= n
        if room and len(own) > 1:
            small = own[-1][0]
            gap, best, pair = room + small, small, None
            a = longest(gap - 1)
            while a > 0 and 2 * a > best and best < gap:
                b = longest(min(a, gap - a))
                if b == a and len(stacks[a]) < 2:
                    b = longest(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                a = longest(a - 1)
            if pair:
                n, item = own.pop()
                own += [(m, take(m)) for m in pair]
                stacks[n].append(item)
                have |= 1 << n
        at = 0
        for n, item in own:
            bins[item], offsets[item] = len(fill), at
            at += n
        fill.append(at)
    return bins, offsets, fill


def _packed(capacity: int, first: bool):
    least = (1 - LOOSE) * capacity

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "id", "piece"], ascending=False, ignore_index=True)
        bins, offsets, fill = best_two_fit(group["length"].tolist(), capacity)
        out = group[["id", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"] = group["g"].astype("int64") * (1 << 32) + np.array(bins, np.int64) * 2 + int(not first)
        out["offset"] = np.array(offsets, np.int64)
        out["loose"] = np.array(fill)[bins] < least if first else False
        return out

    return run


_PIECE = "id long, piece int, start long, length long, ids_crc32 long"


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    group: int = GROUP,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document.

    A document is its token ids and ``end``; only one longer than ``capacity`` is cut. Pieces
    are dealt evenly to groups of about ``group`` by a hash, whatever their documents, and each
    group is packed on its own. The sequences that a group could not fill are taken apart and
    packed once more together with those of other groups.

    Null and empty texts are the single id ``end``. Rows that repeat an id are packed each; a
    null id is kept as such. An empty table gives no rows. Other columns are ignored. The path
    must exist on every executor.
    """
    source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = staged(source.mapInArrow(_pieces(tokenizer, capacity, end), _PIECE), "pieces")
    packed = staged(_grouped(pieces, group, True, capacity), "packed")
    loose = packed.where("loose").select("id", "piece", "start", "length", "ids_crc32")
    again = _grouped(staged(loose, "loose"), group, False, capacity)
    out = packed.where("not loose").union(again).withColumnRenamed("id", id_col)
    return out.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _grouped(pieces: DataFrame, group: int, first: bool, capacity: int) -> DataFrame:
    groups = max(1, round(pieces.count() / group))
    dealt = F.pmod(F.xxhash64("id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)) if groups > 1 else F.lit(0)
    schema = _PIECE + ", sequence_id long, offset long, loose boolean"
    return pieces.withColumn("g", dealt.cast("long")).groupBy("g").applyInPandas(_packed(capacity, first), schema)
