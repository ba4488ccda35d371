"""Findings of one text: detection, selection among overlaps, and rewriting."""

from __future__ import annotations

import base64
import functools
import hashlib
import hmac
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

import regex

from .. import registry
from ..config import ScanConfig, Strategy, TransformConfig
from ..errors import PrivacyError, invalid_finding
from . import network

_WORD = regex.compile(r"[\p{L}\p{N}_]")
_ENTITY = regex.compile(r"[A-Za-z0-9_-]+")


@dataclass(frozen=True)
class Finding:
    """A located match; ranges are code points, zero-based and end-exclusive."""

    entity_type: str
    matched_text: str
    start: int
    end: int
    confidence: float | None = None
    detector_name: str = ""
    detector_version: str | None = registry.VERSION
    byte_start: int | None = None
    byte_end: int | None = None

    @property
    def denied(self) -> bool:
        return self.entity_type == registry.DENYLIST and self.detector_name == registry.DENY_DETECTOR


def byte_offsets(text: str, points: Iterable[int]) -> dict[int, int]:
    """UTF-8 offsets of code point offsets, in one pass over the text."""
    if text.isascii():
        return {p: p for p in points}
    out, at, size = {}, 0, 0
    for p in sorted(set(points)):
        size += len(text[at:p].encode())
        out[p] = size
        at = p
    return out


def utf16_range(text: str, start: int, end: int) -> tuple[int, int]:
    units = lambda s: len(s.encode("utf-16-le")) // 2
    first = units(text[:start])
    return first, first + units(text[start:end])


@functools.lru_cache(256)
def _deny_pattern(phrase: str, sensitive: bool) -> regex.Pattern:
    return regex.compile(regex.escape(phrase, special_only=True), 0 if sensitive else regex.I)


def denied_spans(text: str, rules) -> list[tuple[int, int]]:
    """Distinct occurrences of the phrases, overlapping ones included."""
    spans = set()
    for rule in rules:
        for m in _deny_pattern(rule.phrase, rule.case_sensitive).finditer(text, overlapped=True):
            inside = (m.start() and _WORD.match(text[m.start() - 1])) or _WORD.match(text, m.end())
            if rule.boundary == "substring" or not inside:
                spans.add(m.span())
    return sorted(spans)


@dataclass(frozen=True)
class Scanner:
    """The detectors that a configuration selects, fixed before any text is seen."""

    labels: tuple[str, ...]
    format: str = "text"
    deny: tuple = ()

    @classmethod
    def of(cls, config: ScanConfig = ScanConfig()) -> Scanner:
        return cls(tuple(config.active()), config.format, config.deny)

    def __call__(self, text: str) -> list[Finding]:
        found = set()
        for label in self.labels:
            detector = registry.DETECTORS[label]
            if detector.needs and not any(c in text for c in detector.needs):
                continue
            scan = detector.scan
            if label == "EMAIL" and self.format != "text":
                scan = network.env_emails if self.format == "env" else network.sql_emails
            found.update((start, -end, detector.ordinal, label) for start, end in scan(text))
        out = [Finding(label, text[start:-end], start, -end, None, registry.DETECTORS[label].name) for start, end, _, label in sorted(found)]
        if self.deny:
            out += [Finding(registry.DENYLIST, text[s:e], s, e, None, registry.DENY_DETECTOR) for s, e in denied_spans(text, self.deny)]
            out.sort(key=lambda f: (f.start, -f.end, f.entity_type))
        return out


def validate(text: str, findings: Sequence[Finding]) -> None:
    """Raises for the first finding that does not describe ``text``."""
    bytes_at = byte_offsets(text, [p for f in findings for p in (f.start, f.end) if f.byte_start is not None and 0 <= p <= len(text)])
    size = len(text.encode()) if bytes_at else 0
    for i, f in enumerate(findings):
        if not _ENTITY.fullmatch(f.entity_type or ""):
            raise invalid_finding(i, "invalid_value", "entity_type")
        if f.byte_start is not None:
            if f.byte_start >= f.byte_end:
                raise invalid_finding(i, "empty_value", "byte_range")
            if f.byte_end > size:
                raise invalid_finding(i, "out_of_bounds", "byte_range")
        if f.start >= f.end:
            raise invalid_finding(i, "empty_value", "codepoint_range")
        if f.start < 0 or f.end > len(text):
            raise invalid_finding(i, "out_of_bounds", "codepoint_range")
        if f.byte_start is not None and (bytes_at[f.start], bytes_at[f.end]) != (f.byte_start, f.byte_end):
            raise invalid_finding(i, "inconsistent_ranges", "codepoint_range")
        if text[f.start : f.end] != f.matched_text:
            raise invalid_finding(i, "matched_text_mismatch", "matched_text")
        if f.confidence is not None and not 0.0 <= f.confidence <= 1.0:
            raise invalid_finding(i, "invalid_confidence", "confidence")


@dataclass(frozen=True)
class Policy:
    """Which findings a transformation touches."""

    config: TransformConfig

    @functools.cached_property
    def _patterns(self) -> dict[str, list[regex.Pattern]]:
        return {e: [regex.compile(p, 0 if case else regex.I) for p, case in rules] for e, rules in self.config.allow_regex.items()}

    def eligible(self, f: Finding) -> bool:
        """Explicitly denied phrases always; others if included and not allowed."""
        if f.denied:
            return True
        if self.config.entities is not None and f.entity_type not in self.config.entities:
            return False
        if f.matched_text in self.config.allow_exact.get(f.entity_type, ()):
            return False
        return not any(p.fullmatch(f.matched_text) for p in self._patterns.get(f.entity_type, ()))


def _by_confidence(left: Finding, right: Finding) -> int:
    if left.confidence is None or right.confidence is None:
        return 0
    return (left.confidence < right.confidence) - (left.confidence > right.confidence)


def _by_name(left: Finding, right: Finding) -> int:
    a, b = ((f.detector_name, f.detector_version is not None, f.detector_version or "") for f in (left, right))
    return (a > b) - (a < b)


def duplicate_order(left: Finding, right: Finding) -> int:
    """Below zero if ``left`` is the better of two findings of one label and range."""
    return (right.denied - left.denied) or _by_confidence(left, right) or _by_name(left, right)


def overlap_order(left: Finding, right: Finding) -> int:
    """Below zero if ``left`` is preferred: it contains, is longer, surer, earlier, or first by name."""
    over = left.start <= right.start and left.end >= right.end
    under = right.start <= left.start and right.end >= left.end
    if over != under:
        return -1 if over else 1
    size = (right.end - right.start) - (left.end - left.start)
    if size:
        return size
    places = (left.start, left.entity_type), (right.start, right.entity_type)
    return _by_confidence(left, right) or (places[0] > places[1]) - (places[0] < places[1]) or _by_name(left, right)


def resolve(findings: list[Finding]) -> list[Finding]:
    """Findings without overlaps, the preferred ones first come; ``findings`` are in source order."""
    if all(a.end <= b.start for a, b in zip(findings, findings[1:], strict=False)):
        return findings
    kinds: dict[int, set[bool]] = {}
    for f in findings:
        kinds.setdefault(f.end - f.start, set()).add(f.confidence is not None)
    if any(len(k) == 2 for k in kinds.values()):
        return _resolve_by_pairs(findings)
    starts: list[int] = []
    taken: dict[int, Finding] = {}
    for f in sorted(findings, key=functools.cmp_to_key(overlap_order)):
        i = bisect_right(starts, f.start)
        before = i and taken[starts[i - 1]].end > f.start
        after = bisect_left(starts, f.start) < len(starts) and starts[bisect_left(starts, f.start)] < f.end
        if not before and not after:
            insort(starts, f.start)
            taken[f.start] = f
    return [taken[s] for s in starts]


def _resolve_by_pairs(findings: list[Finding]) -> list[Finding]:
    """Where confidences of equal lengths are partly absent, preference is no order; take the best of each turn."""
    left, out = list(findings), []
    while left:
        best = functools.reduce(lambda a, b: b if overlap_order(b, a) < 0 else a, left)
        out.append(best)
        left = [f for f in left if f is not best and (f.end <= best.start or best.end <= f.start)]
    return sorted(out, key=lambda f: (f.start, f.end, f.entity_type))


def select(findings: Sequence[Finding], policy: Policy) -> list[Finding]:
    """The disjoint findings to transform; a conflict if they leave part of an eligible one uncovered."""
    eligible = [(i, f) for i, f in enumerate(findings) if policy.eligible(f)]
    best: dict[tuple, Finding] = {}
    for _, f in eligible:
        key = f.entity_type, f.start, f.end
        if key not in best or duplicate_order(f, best[key]) < 0:
            best[key] = f
    social = {(f.start, f.end) for _, f in eligible if f.entity_type == "SSN" and f.detector_name == registry.DETECTORS["SSN"].name}
    kept = [f for f in best.values() if f.entity_type != registry.PERSON or (f.start, f.end) not in social]
    chosen = resolve(sorted(kept, key=lambda f: (f.start, f.end, f.entity_type)))
    for i in uncovered([(f.start, f.end) for _, f in eligible], [(f.start, f.end) for f in chosen]):
        raise PrivacyError("review_conflict", path=f"/findings/{eligible[i][0]}", index=eligible[i][0])
    return chosen


def uncovered(required: Sequence[tuple[int, int]], chosen: Sequence[tuple[int, int]]) -> list[int]:
    """Indexes of required ranges that no run of adjoining chosen ranges contains."""
    runs: list[list[int]] = []
    for s, e in chosen:
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(e, runs[-1][1])
        else:
            runs.append([s, e])
    ends = [r[1] for r in runs]
    out = []
    for i, (s, e) in enumerate(required):
        k = bisect_right(ends, s)
        if k == len(runs) or runs[k][0] > s or runs[k][1] < e:
            out.append(i)
    return out


def merge(text: str, findings: Sequence[Finding], policy: Policy) -> list[Finding]:
    """Eligible findings with overlapping ones joined; the preferred one names the joined range."""
    out: list[Finding] = []
    for f in sorted((f for f in findings if policy.eligible(f)), key=lambda f: (f.start, f.end)):
        if not out or out[-1].end <= f.start:
            out.append(f)
            continue
        last = out[-1]
        better = f.denied if f.denied != last.denied else not last.denied and overlap_order(f, last) < 0
        start, end = last.start, max(last.end, f.end)
        out[-1] = replace(f if better else last, start=start, end=end, matched_text=text[start:end], byte_start=None, byte_end=None)
    return out


def masked(value: str, s: Strategy) -> str:
    shown = min(s.count, max(len(value) - 1, 0)) if s.direction else 0
    hidden = s.character * (len(value) - shown)
    return value[:shown] + hidden if s.direction == "first" else hidden + value[len(value) - shown :]


@dataclass(frozen=True)
class Rewritten:
    text: str
    rows: list[dict]


def rewrite(text: str, chosen: Sequence[Finding], config: TransformConfig, keys: dict | None = None, token: Callable[[int, Finding], tuple[str, str]] | None = None) -> Rewritten:
    """``text`` with each finding replaced, and an audit row for each that holds no source value.

    ``keys`` maps (key_ref, key_version) to (version, 32 bytes); ``token`` gives the envelope and
    version for the i-th finding.
    """
    bytes_at = byte_offsets(text, [p for f in chosen for p in (f.start, f.end)])
    parts, rows, at, out, out_bytes = [], [], 0, 0, 0
    for i, f in enumerate(chosen):
        keep = text[at : f.start]
        parts.append(keep)
        out, out_bytes = out + len(keep), out_bytes + len(keep.encode())
        s = config.strategy(f.entity_type)
        row = dict.fromkeys(("key_ref", "key_version", "token_ref", "token_version"))
        if s.kind == "redact":
            new = f"[{f.entity_type}]"
        elif s.kind == "remove":
            new = ""
        elif s.kind == "mask":
            new = masked(f.matched_text, s)
        elif s.kind == "pseudonymize":
            if (s.key_ref, s.key_version) not in (keys or {}):
                raise PrivacyError("key_provider_required", path=config.strategy_path(f.entity_type))
            version, key = keys[s.key_ref, s.key_version]
            new = base64.b64encode(hmac.digest(key, f.matched_text.encode(), hashlib.sha256)).decode()
            row |= {"key_ref": s.key_ref, "key_version": version}
        else:
            if token is None:
                raise PrivacyError("token_provider_required", path=config.strategy_path(f.entity_type))
            new, version = token(i, f)
            row |= {"token_ref": s.token_ref, "token_version": version}
        parts.append(new)
        size = len(new.encode())
        rows.append(row | {
            "entity_type": f.entity_type, "source_start": f.start, "source_end": f.end, "source_byte_start": bytes_at[f.start], "source_byte_end": bytes_at[f.end],
            "output_start": out, "output_end": out + len(new), "output_byte_start": out_bytes, "output_byte_end": out_bytes + size,
            "confidence": f.confidence, "detector_name": f.detector_name, "detector_version": f.detector_version, "strategy": s.kind, "replacement": new,
        })
        out, out_bytes, at = out + len(new), out_bytes + size, f.end
    parts.append(text[at:])
    return Rewritten("".join(parts), rows)
