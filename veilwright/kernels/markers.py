"""Aliases of the form ``[[LABEL_CODE]]``: issue, recognition, and restoration of a growing text."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable
from dataclasses import dataclass, field

import regex

from ..config import SPACE

#: Crockford's base 32 alphabet; codes have six of its characters.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
CODE_LENGTH, MAX_LABEL, MAX_ATTEMPTS = 6, 32, 32
MAX_INTERIOR = 75
#: Separates these codes from other uses of the same key; callers that share codes elsewhere pass their own.
DOMAIN = b"veilwright-alias-code\0"

_LABEL = regex.compile(r"[A-Z][A-Z0-9_]{0,31}")
_MARKER = regex.compile(r"\[\[(?P<inner>(?=[A-Za-z0-9]*_)[A-Za-z][A-Za-z0-9_]{0,%d})\]\]" % (MAX_INTERIOR - 1))
_WORD = regex.compile(r"[A-Za-z0-9_]+")
_FOLD = str.maketrans("ilo", "110", "") | str.maketrans("ILO", "110")
_LOWER_WORDS = regex.compile("[" + regex.escape(SPACE) + "]+")


def identity_key(value: str) -> str:
    """Runs of white space become one space and each character is lower-cased by itself."""
    return " ".join("".join(c.lower() for c in w) for w in _LOWER_WORDS.split(value) if w)


def marker(label: str, code: str) -> str:
    return f"[[{label}_{code}]]"


def code(namespace: bytes, operation: bytes, label: str, counter: int, attempt: int, domain: bytes = DOMAIN) -> str:
    """A code drawn from the operation's random id; it says nothing about the value."""
    message = domain + namespace + label.encode() + b"\0" + counter.to_bytes(8, "big") + attempt.to_bytes(4, "big")
    bits = int.from_bytes(hmac.digest(operation, message, hashlib.sha256)[:4], "big") >> 2
    return "".join(CROCKFORD[(bits >> 5 * i) & 31] for i in reversed(range(CODE_LENGTH)))


def canonical(inner: str) -> str | None:
    """The marker that a text between brackets stands for: any case, I and L for 1, O for 0."""
    label, _, tail = inner[: -CODE_LENGTH - 1].upper(), inner[-CODE_LENGTH - 1 : -CODE_LENGTH], inner[-CODE_LENGTH:]
    if len(inner) < CODE_LENGTH + 2 or _ != "_" or not _LABEL.fullmatch(label):
        return None
    tail = tail.translate(_FOLD).upper()
    return marker(label, tail) if all(c in CROCKFORD for c in tail) else None


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    marker: str | None


def marker_spans(text: str) -> list[Span]:
    return [Span(*m.span(), canonical(m["inner"])) for m in _MARKER.finditer(text)]


def bare_words(text: str) -> list[Span]:
    """Words that would be markers had they their brackets."""
    return [Span(*m.span(), c) for m in _WORD.finditer(text) if len(m[0]) <= MAX_INTERIOR and (c := canonical(m[0]))]


def occurrences(text: str) -> list[tuple[int, int, str | None, bool]]:
    """(start, end, canonical marker, bracketed) of all marker-like spans, in order."""
    out, at = [], 0
    for s in [*marker_spans(text), None]:
        stop = s.start if s else len(text)
        out += [(b.start + at, b.end + at, b.marker, False) for b in bare_words(text[at:stop])]
        if s:
            out.append((s.start, s.end, s.marker, True))
            at = s.end
    return out


class StreamFailure(Exception):
    """A marker that cannot be restored; what was delivered before stays delivered."""

    def __init__(self, kind: str, start: int):
        self.kind, self.start = kind, start
        super().__init__(f"{kind} at {start}")


_PENDING = regex.compile(r"(?:\[\[[A-Za-z][A-Za-z0-9_]*+\]?|\[\[?|[A-Za-z0-9_]+)\Z")


@dataclass
class ProgressiveRestore:
    """Restores a text that arrives in pieces, emitting all that no later piece can change.

    Held back is only an open bracket or a word at the end, of bounded length. ``value_of`` gives
    a marker's value or None; ``why`` names the failure of an unknown one.
    """

    value_of: Callable[[str], str | None]
    why: Callable[[str], str] = lambda marker: "unknown"
    carry: str = ""
    seen: int = 0
    delivered: dict = field(default_factory=lambda: {"bytes": 0, "code_points": 0, "utf16": 0, "markers": 0})
    #: The carry begins within a word already too long to be a marker.
    inside: bool = False

    def feed(self, piece: str) -> str:
        return self._advance(self.carry + piece, False)

    def finish(self) -> str:
        """The rest; an open marker at the end is damaged."""
        if self.carry.startswith("[[") and len(self.carry) > 2:
            raise StreamFailure("damaged", self.seen)
        return self._advance(self.carry, True)

    def _advance(self, text: str, last: bool) -> str:
        cut = len(text)
        if not last and (pending := _PENDING.search(text, max(0, len(text) - MAX_INTERIOR - 4))):
            cut = pending.start()
            while cut and text[cut].isascii() and (text[cut].isalnum() or text[cut] == "_") and (text[cut - 1].isascii() and (text[cut - 1].isalnum() or text[cut - 1] == "_")):
                cut -= 1
            if text[cut] == "[" and len(text) - cut - 2 > MAX_INTERIOR + 1:
                raise StreamFailure("damaged", self.seen + cut)
        head, out, at, inside = text[:cut], [], 0, self.inside
        if len(text) - cut > MAX_INTERIOR and cut < len(text) and text[cut] != "[":
            head, cut, inside_next = text, len(text), True
        else:
            inside_next = False
        count = 0
        for start, end, name, bracketed in occurrences(head):
            if not bracketed:
                if inside and start == 0:
                    continue
                if inside_next and end == len(head):
                    continue
                if self.value_of(name) is not None:
                    raise StreamFailure("unbracketed", self.seen + start)
                continue
            value = None if name is None else self.value_of(name)
            if value is None:
                raise StreamFailure("damaged" if name is None else self.why(name), self.seen + start)
            out += [head[at:start], value]
            at, count = end, count + 1
        done = "".join([*out, head[at:]])
        self.seen, self.carry, self.inside = self.seen + cut, text[cut:], inside_next
        for name, size in (("bytes", len(done.encode())), ("code_points", len(done)), ("utf16", len(done.encode("utf-16-le")) // 2), ("markers", count)):
            self.delivered[name] += size
        return done
