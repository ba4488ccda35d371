"""Byte-level BPE encoding and decoding over a memory-mapped word lexicon."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_root, staged
from .lexicon import Lexicon, build
from .words import bounded_batches, slices

#: Words compiled into the lexicon, each with and without a space before it.
LEXICON_WORDS = 50_000
#: What each half of a worker's three caches holds at most, in bytes of Python objects, about.
CACHE_BYTES = 80 << 20

_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Where a run of white space goes on across a single space, a text cannot be cut at its spaces.
_ACROSS = re.compile(r"\s \s")
_coders: dict[tuple[str, str | None], Coder] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, and its byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Encodes and decodes as the tokenizer of a byte-level BPE file does."""

    def __init__(self, path: str, lexicon: str | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.tokens = {i: t for t, i in vocab.items()}
        self.single = [vocab[bytes([b])] for b in range(256)]
        #: Of each pair of ids, the rank of its merge above the id that it gives.
        self.merges = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            a, b = raw(left), raw(right)
            self.merges[vocab[a] << _ID | vocab[b]] = rank << _ID | vocab[a + b]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t.encode() for t, i in self.special.items()}
        self._decimal = {i: b"%d" % i for i in self.tokens}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self._words = _Cache(self._word_coded)
        self._bare = _Cache(self._chunk_coded)
        self._spaced = _Cache(self._spaced_coded)

    def merge(self, word: bytes) -> list[int]:
        """Exact merges of one word: always the leftmost of the pairs of lowest rank."""
        ids = [self.single[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self.merges.get
        found = [get(a << _ID | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found)) != _NONE:
            i, new = found.index(best), best & _IDS
            ids[i : i + 2] = [new]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << _ID | new, _NONE)
            if i < len(found):
                found[i] = get(new << _ID | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for words of any length."""
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(f >> _ID, i, ids[i], ids[i + 1], f & _IDS) for i in range(n - 1) if (f := get(ids[i] << _ID | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (f := get(ids[x] << _ID | ids[after[x]])) is not None:
                    heapq.heappush(heap, (f >> _ID, x, ids[x], ids[after[x]], f & _IDS))
        return [i for i in ids if i >= 0]

    def word(self, word: str) -> list[int]:
        """The lexicon's ids, or exact merges for a word that it lacks."""
        raw = word.encode()
        ids = self.lexicon.get(raw) if self.lexicon else None
        return self.merge(raw) if ids is None else ids

    def encode(self, text: str) -> list[int]:
        joined = self.code(text)[0]
        return list(map(int, joined.split(b","))) if joined else []

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.tokens[i] for i in ids]).decode("utf-8", "replace")

    def code(self, text: str) -> tuple[bytes, bytes]:
        """Decimal ids joined by commas, and the bytes that these ids stand for.

        Special tokens' strings stand for themselves wherever they occur. The bytes are those of
        the ids' tokens, looked up once for each word that is remembered.
        """
        out: list[tuple[bytes, bytes]] = []
        for part in self._special.split(text) if self._special else [text]:
            if not part:
                continue
            if part in self.special:
                out.append(self._coded([self.special[part]]))
            elif _ACROSS.search(part):
                out.append(self._chunk_coded(part))
            else:
                first, *rest = part.split(" ")
                if first:
                    out.append(self._bare[first])
                out += map(self._spaced.__getitem__, rest)
        return _joined(out)

    def _chunk_coded(self, chunk: str) -> tuple[bytes, bytes]:
        return _joined(list(map(self._words.__getitem__, _SPLIT.findall(chunk))))

    def _spaced_coded(self, chunk: str) -> tuple[bytes, bytes]:
        """Of a space and ``chunk``, whose first word is remembered apart from what follows it."""
        if chunk.isalpha() and chunk.isascii():
            return self._word_coded(" " + chunk)
        first, *rest = _SPLIT.findall(" " + chunk)
        if not rest:
            return self._word_coded(first)
        known = self._spaced[first[1:]] if first[0] == " " else self._words[first]
        return _joined([known, *map(self._words.__getitem__, rest)])

    def _word_coded(self, word: str) -> tuple[bytes, bytes]:
        return self._coded(self.word(word))

    def _coded(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b",".join([self._decimal[i] for i in ids]), b"".join([self.tokens[i] for i in ids])


def _joined(coded: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    if not coded:
        return b"", b""
    return b",".join([ids for ids, _ in coded]), b"".join([raw for _, raw in coded])


#: Bits of an id in a pair or a merge.
_ID = 24
_IDS = (1 << _ID) - 1
_NONE = 1 << 60


class _Cache(dict):
    """What ``make`` gives for a text; long texts are not kept.

    When it has taken CACHE_BYTES it becomes the older half, from which what is asked for again
    is taken over, and the half before that goes: frequent words stay.
    """

    def __init__(self, make):
        self.make, self.room, self.older = make, CACHE_BYTES, {}

    def __missing__(self, text: str) -> tuple[bytes, bytes]:
        value = self.older.get(text) or self.make(text)
        if len(text) < 64:
            size = 320 + len(text) + len(value[0]) + len(value[1])
            if size > self.room:
                self.older = dict(self)
                self.clear()
                self.room = CACHE_BYTES
            self.room -= size
            self[text] = value
        return value


def coder(path: str, lexicon: str | None = None) -> Coder:
    """One coder for each worker process."""
    if (path, lexicon) not in _coders:
        _coders.clear()
        _coders[path, lexicon] = Coder(path, SparkFiles.get(lexicon) if lexicon else None)
    return _coders[path, lexicon]


def frequent_words(docs: DataFrame, text_col: str = "text", limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent runs of letters over all texts, at most ``limit``.

    All words of a frequency are taken or none, so that only a histogram of frequencies and the
    words above the cut reach the driver, whatever the size of the corpus.
    """
    words = docs.select(F.explode(F.split(F.col(text_col).cast("string"), r"[^\p{L}]+")).alias("word")).where("word <> '' and length(word) <= 40")
    counts = staged(words.groupBy("word").count().where("count > 1"), "word-counts")
    total, cut = 0, None
    for row in counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).limit(limit).collect():
        total += row["n"]
        if total > limit:
            break
        cut = row["count"]
    return [] if cut is None else [r["word"] for r in counts.where(F.col("count") >= cut).select("word").collect()]


def ship_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", limit: int = LEXICON_WORDS) -> str:
    """Compiles the frequent words into a file in the scratch folder, which every executor fetches; its name there.

    At most ``limit`` words reach the driver and the file (about 2 MB for 50,000). An executor
    that starts later fetches the file too; one whose content was shipped before is not again.
    """
    own = Coder(tokenizer)
    words = {form for w in frequent_words(docs, text_col, limit) for form in (w, " " + w)}
    data = build((w.encode(), own.merge(w.encode())) for w in words)
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    spark = docs.sparkSession
    if any(str(path).endswith(f"/{name}") for path in spark.sparkContext.listFiles):
        return name
    path = f"{scratch_root(spark)}/veilwright/{uuid.uuid4().hex}/{name}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    spark.sparkContext.addFile(path)
    return name


def _coded(tokenizer: str, lexicon: str | None, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer, lexicon)
        for batch in batches:
            for ids, texts in slices(batch.column(0), batch.column(1)):
                rows = []
                for text in texts:
                    joined, raw = own.code(text.decode("utf-8", "replace"))
                    back = raw.decode("utf-8", "replace").encode()
                    n = joined.count(b",") + 1 if joined else 0
                    full = [list(map(int, joined.split(b","))) if joined else [], back.decode()] if keep else [None, None]
                    rows.append((n, hashlib.sha256(joined).hexdigest(), hashlib.sha256(back).hexdigest(), *full))
                n, a, b, full, back = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(full, pa.list_(pa.int32())), pa.array(back, pa.string())],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"],
                )

    return run


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LEXICON_WORDS, keep: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, ids, decoded) for each row of ``docs``.

    The corpus' frequent words are compiled into a lexicon first; words that it lacks are merged
    exactly. Special tokens' strings in a text become their ids. ``keep=False`` leaves out the
    last two columns' values and returns the digests only.

    Null texts are empty: no ids, and the digests of nothing. Very long words are merged with a
    heap, in n log n steps. Null and repeated ids are returned as they are; other columns are
    ignored. The tokenizer's path must exist on every executor.
    """
    source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    name = ship_lexicon(source, tokenizer, "text", limit)
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"
    out = source.mapInArrow(_coded(tokenizer, name, keep), schema).withColumnRenamed("id", id_col)
    return out if keep else out.drop("ids", "decoded")
