"""From a token tagger's scores to spans: windows, the best legal tags, ranges in the text.

Tag 0 is outside; label ``i`` begins with tag ``2 i + 1`` and goes on with tag ``2 i + 2``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import regex

from ..errors import PrivacyError

# Tokens in a window, tokens that neighbouring windows share, tokens in a text.
WINDOW, OVERLAP, MAX_TOKENS = 256, 64, 8_192

_WORDLIKE = regex.compile(r"[\p{Alphabetic}\p{N}]")


def windows(n: int) -> Iterator[tuple[slice, slice]]:
    """(tokens that a window sees, tokens whose scores are taken from it); the latter tile ``n`` tokens.

    Neighbours share OVERLAP tokens and each has the half that is further from its edge.
    """
    if n > MAX_TOKENS:
        raise PrivacyError("internal_error", "limit_exceeded", "/text")
    starts = range(0, max(n - OVERLAP, 1), WINDOW - OVERLAP)
    bounds = [0, *(s + OVERLAP // 2 for s in starts[1:]), n]
    for s, own, following in zip(starts, bounds, bounds[1:], strict=False):
        if following > own:
            yield slice(s, min(s + WINDOW, n)), slice(own, following)


#: Scores of so many tokens, about, are worked on at a time.
_PADDED = 262_144


def best_tags(scores: np.ndarray) -> list[int]:
    """The tags of the best path in which a label goes on only after its own begin or itself.

    ``scores`` is (tokens, tags), any logits. Of equal paths that with the lower tags wins, from
    the last token backwards.
    """
    return best_tags_of([scores])[0]


def best_tags_of(many: list[np.ndarray]) -> list[list[int]]:
    """``best_tags`` of each of ``many`` texts' scores, all of as many tags, a token of all texts at a time.

    Texts of like length go together, so that few places are padding.
    """
    many = [np.asarray(scores, np.float32) for scores in many]
    out: list[list[int]] = [[] for _ in many]
    order = sorted((i for i, scores in enumerate(many) if len(scores)), key=lambda i: -len(many[i]))
    at = 0
    while at < len(order):
        size = max(1, _PADDED // len(many[order[at]]))
        group = order[at : at + size]
        for i, tags in zip(group, _paths([many[i] for i in group]), strict=True):
            out[i] = tags
        at += size
    return out


def _paths(group: list[np.ndarray]) -> list[list[int]]:
    """The best path of each text; the longest comes first and none is empty."""
    sizes = np.array([len(scores) for scores in group])
    flat = np.concatenate(group)
    if not np.isfinite(flat).all():
        raise PrivacyError("internal_error", "invalid_output")
    level = flat - flat.max(axis=1, keepdims=True)
    level -= np.log(np.exp(level).sum(axis=1, keepdims=True))
    tag = np.arange(flat.shape[1])
    label, going_on = (tag + 1) // 2, (tag > 0) & (tag % 2 == 0)
    barred = np.where(going_on & (label[:, None] != label), -np.inf, 0).astype(np.float32)
    first = np.cumsum(sizes) - sizes
    came_from = np.zeros((sizes[0], len(group), len(tag)), np.min_scalar_type(len(tag)))
    total = np.where(going_on, -np.inf, level[first]).astype(np.float32)
    # texts that still have a token at a place are the leading ones
    open_at = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    for i in range(1, sizes[0]):
        n = open_at[i]
        paths = total[:n, :, None] + barred
        came_from[i, :n] = paths.argmax(axis=1)
        total[:n] = paths.max(axis=1) + level[first[:n] + i]
    tags = np.zeros((sizes[0], len(group)), np.int64)
    last = total.argmax(axis=1)
    rows = np.arange(len(group))
    for i in range(sizes[0] - 1, -1, -1):
        n = open_at[i]
        ends = sizes[:n] == i + 1
        tags[i, :n] = np.where(ends, last[:n], came_from[i + 1, rows[:n], tags[i + 1, :n]] if i + 1 < sizes[0] else 0)
    return [tags[:size, k].tolist() for k, size in enumerate(sizes.tolist())]


def tagged_spans(text: str, tokens: list[tuple[int, int]], tags: list[int], labels: list[str]) -> list[tuple[str, int, int]]:
    """(label, start, end) of the runs in ``tags``, without what is no letter or number at their ends."""
    runs: list[list[int]] = []
    before = -1
    for (start, end), tag in zip(tokens, tags, strict=True):
        label = (tag + 1) // 2 - 1
        if tag and tag % 2 == 0 and label == before:
            runs[-1][2] = end
        elif tag:
            runs.append([label, start, end])
        before = label
    out = []
    for label, start, end in runs:
        while end > start and not _WORDLIKE.match(text[end - 1]):
            end -= 1
        if end > start:
            out.append((labels[label], start, end))
    return out
