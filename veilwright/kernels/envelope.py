"""The text form of reversible tokens."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import regex

from ..config import blank
from ..errors import PrivacyError

#: Fixed value: how a token begins, before its version and the length of its body.
PREFIX = "DFTOKENv"


@dataclass(frozen=True)
class Token:
    envelope: str
    token_ref: str
    version: str
    payload: bytes
    start: int
    end: int


def _encoded(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def envelope(token_ref: str, version: str, payload: bytes) -> str:
    body = ".".join(map(_encoded, (token_ref.encode(), version.encode(), payload)))
    return f"{PREFIX}1({len(body)}):{body}"


def _decoded(part: str) -> bytes:
    if not regex.fullmatch(r"[A-Za-z0-9_-]+", part) or len(part) % 4 == 1:
        raise PrivacyError("invalid_token")
    raw = base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))
    if _encoded(raw) != part:
        raise PrivacyError("invalid_token")
    return raw


_START = regex.compile(r"(?P<version>[0-9]{1,20})\(")
_LENGTH = regex.compile(r"(?P<length>0|[1-9][0-9]{0,19})\):")


def parse_tokens(text: str) -> list[Token]:
    """All tokens in order; anything else that begins like one is an error."""
    out, at = [], 0
    while (start := text.find(PREFIX, at)) >= 0:
        head = _START.match(text, start + len(PREFIX))
        if not head:
            raise PrivacyError("invalid_token")
        if head["version"] != "1":
            raise PrivacyError("unsupported_token_version")
        size = _LENGTH.match(text, head.end())
        if not size:
            raise PrivacyError("invalid_token")
        end = size.end() + int(size["length"])
        parts = text[size.end() : end].split(".")
        if end > len(text) or len(parts) != 3:
            raise PrivacyError("invalid_token")
        ref, version, payload = map(_decoded, parts)
        try:
            names = ref.decode(), version.decode()
        except UnicodeDecodeError:
            raise PrivacyError("invalid_token") from None
        if any(map(blank, names)):
            raise PrivacyError("invalid_token")
        out.append(Token(text[start:end], *names, payload, start, end))
        at = end
    return out
