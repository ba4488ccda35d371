"""A minimal acyclic transducer from words to token ids, in one file that readers map into memory."""

from __future__ import annotations

import mmap
import struct
import zlib
from collections.abc import Iterable

import numpy as np

_MAGIC = b"VWLX0002"
#: Bits for each word in the table that is asked before the automaton.
_SCREEN = 16


class _Node:
    __slots__ = ("arcs", "count", "final", "number")

    def __init__(self):
        self.arcs: dict[int, _Node] = {}
        self.final = False
        self.count = 0
        self.number = -1

    def key(self):
        return self.final, tuple((b, id(n)) for b, n in self.arcs.items())


def build(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file for (word, ids) pairs; words need not be sorted but must differ.

    Words are added in order and every finished state is replaced by an equal one if there is
    any, so that suffixes are shared and the automaton is the smallest for its words. An arc's
    output is the number of words that come before those behind it: the sum along a word's path
    is its rank, which says where its ids start.
    """
    entries = sorted(entries)
    root, known = _Node(), {}
    path: list[tuple[_Node, int, _Node]] = []

    def finish(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            key = child.key()
            if key in known:
                parent.arcs[byte] = known[key]
            else:
                known[key] = child

    before = b""
    for word, _ in entries:
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        finish(same)
        node = path[-1][2] if path else root
        for byte in word[same:]:
            node.arcs[byte] = child = _Node()
            path.append((node, byte, child))
            node = child
        node.final = True
        before = word
    finish(0)

    order: list[_Node] = []
    stack: list[tuple[_Node, bool]] = [(root, False)]
    while stack:  # children before parents
        node, done = stack.pop()
        if done:
            if node.number < 0:
                node.number = len(order)
                node.count = int(node.final) + sum(c.count for c in node.arcs.values())
                order.append(node)
        elif node.number < 0:
            stack.append((node, True))
            stack += [(c, False) for c in node.arcs.values()]
    first, labels, targets, outputs = [0], bytearray(), [], []
    for node in order:
        rank = int(node.final)
        for byte, child in node.arcs.items():
            labels.append(byte)
            targets.append(child.number)
            outputs.append(rank)
            rank += child.count
        first.append(len(labels))
    final = bytes(n.final for n in order)
    starts, ids = [0], []
    for _, own in entries:
        ids += own
        starts.append(len(ids))
    screen = bytearray(max(1, len(entries) * _SCREEN // 8))
    for word, _ in entries:
        at = zlib.crc32(word) % (8 * len(screen))
        screen[at >> 3] |= 1 << (at & 7)
    parts = [np.array(x, "<u4").tobytes() for x in (first, targets, outputs, starts, ids)] + [final, bytes(screen), bytes(labels)]
    head = _MAGIC + struct.pack("<9Q", root.number, *map(len, parts))
    return head + b"".join(parts)


class Lexicon:
    """Words of a file made by ``build``; pages are shared by the processes that map the same file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self._map[:8] != _MAGIC:
            raise ValueError("not a lexicon file")
        self._root, *sizes = struct.unpack("<9Q", self._map[8:80])
        at, view, parts = 80, memoryview(self._map), []
        for n in sizes:
            parts.append(view[at : at + n])
            at += n
        self._first, self._targets, self._outputs, self._starts, self._ids = (p.cast("I") for p in parts[:5])
        self._final, self._screen = parts[5:7]
        self._labels = at - sizes[7]
        self.states, self.words = len(self._final), len(self._starts) - 1

    def get(self, word: bytes) -> list[int] | None:
        """The word's ids, or None if the lexicon lacks it, which the screen mostly tells at once."""
        bit = zlib.crc32(word) % (8 * len(self._screen))
        if not self._screen[bit >> 3] >> (bit & 7) & 1:
            return None
        node, rank, base, first, find = self._root, 0, self._labels, self._first, self._map.find
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[node], base + first[node + 1])
            if arc < 0:
                return None
            rank += self._outputs[arc - base]
            node = self._targets[arc - base]
        if not self._final[node]:
            return None
        return self._ids[self._starts[rank] : self._starts[rank + 1]].tolist()
