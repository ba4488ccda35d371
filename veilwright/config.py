"""Typed configuration, parsed strictly: unknown or misfit fields are errors with a JSON pointer."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from typing import Any

import regex

from .errors import PrivacyError, invalid_config
from .registry import DETECTORS, LOCALES

MAX_PATTERNS, MAX_PATTERN, MAX_PATTERN_TOTAL = 100, 1024, 10 * 1024
_TYPES = {str: "string", dict: "object", list: "array", bool: "boolean"}
#: What counts as white space at the ends of names: the Unicode property, without the separators U+001C to U+001F.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def pointer(segment: str) -> str:
    return segment.replace("~", "~0").replace("/", "~1")


def blank(text: str) -> bool:
    return not text.strip(SPACE)


def _need(value: Any, kind: type, path: str) -> Any:
    if not isinstance(value, kind):
        raise invalid_config("invalid_type", path, f"must be a {_TYPES[kind]}")
    return value


def _fields(value: Any, known: tuple[str, ...], path: str, required: tuple[str, ...] = ()) -> dict:
    _need(value, dict, path)
    for name in sorted(value):
        if name not in known:
            raise invalid_config("unknown_field", f"{path}/{pointer(name)}")
    for name in required:
        if name not in value:
            raise invalid_config("missing_field", f"{path}/{name}")
    return value


def _names(value: Any, path: str) -> list[str]:
    return [_need(v, str, f"{path}/{i}") for i, v in enumerate(_need(value, list, path))]


@dataclass(frozen=True)
class DenyRule:
    phrase: str
    case_sensitive: bool = True
    boundary: str = "word"

    def __post_init__(self):
        if blank(self.phrase):
            raise invalid_config("empty_value", "/deny")


@dataclass(frozen=True)
class ScanConfig:
    locale: str | None = None
    detect_uuid: bool = False
    format: str = "text"
    entities: tuple[str, ...] | None = None
    deny: tuple[DenyRule, ...] = ()

    def __post_init__(self):
        if self.entities is not None:
            if not self.entities:
                raise invalid_config("empty_value", "/entities")
            for i, name in enumerate(self.entities):
                if name not in DETECTORS:
                    raise invalid_config("invalid_value", f"/entities/{i}", "unsupported entity type")
                if name in self.entities[:i]:
                    raise invalid_config("duplicate_value", f"/entities/{i}")
        if self.locale is not None and self.locale.strip(SPACE).lower() not in LOCALES:
            raise invalid_config("invalid_value", "/locale", "unsupported locale")
        if self.format not in ("text", "env", "sql"):
            raise invalid_config("invalid_value", "/format")

    def active(self) -> list[str]:
        """Labels whose detectors run, in order."""
        on = {"default"} | ({LOCALES[self.locale.strip(SPACE).lower()]} if self.locale else set()) | ({"uuid"} if self.detect_uuid else set())
        return [d.label for d in DETECTORS.values() if d.activation in on and (self.entities is None or d.label in self.entities)]


@dataclass(frozen=True)
class Strategy:
    kind: str
    character: str = "*"
    direction: str | None = None
    count: int = 0
    key_ref: str | None = None
    key_version: str | None = None
    token_ref: str | None = None


@dataclass(frozen=True)
class TransformConfig:
    default: Strategy
    entities: frozenset[str] | None = None
    overrides: dict[str, Strategy] = field(default_factory=dict)
    allow_exact: dict[str, frozenset[str]] = field(default_factory=dict)
    #: (pattern, case_sensitive) by entity; a value is allowed if a pattern matches all of it.
    allow_regex: dict[str, tuple[tuple[str, bool], ...]] = field(default_factory=dict)

    def strategy(self, entity: str) -> Strategy:
        return self.overrides.get(entity, self.default)

    def strategy_path(self, entity: str) -> str:
        return f"/overrides/{pointer(entity)}" if entity in self.overrides else "/default"


@dataclass(frozen=True)
class ScanAndTransformConfig:
    transform: TransformConfig
    scan: ScanConfig = ScanConfig()


def parse_deny(value: Any) -> tuple[DenyRule, ...]:
    rules = []
    for i, item in enumerate(_need(value, list, "/deny")):
        path = f"/deny/{i}"
        _fields(item, ("phrase", "case_sensitive", "boundary"), path, ("phrase",))
        phrase = _need(item["phrase"], str, f"{path}/phrase")
        if blank(phrase):
            raise invalid_config("empty_value", f"{path}/phrase")
        sensitive = _need(item.get("case_sensitive", True), bool, f"{path}/case_sensitive")
        boundary = _need(item.get("boundary", "word"), str, f"{path}/boundary")
        if boundary not in ("word", "substring"):
            raise invalid_config("invalid_value", f"{path}/boundary")
        rules.append(DenyRule(phrase, sensitive, boundary))
    return tuple(rules)


def parse_scan(value: Any) -> ScanConfig:
    _fields(value, ("locale", "detect_uuid", "format", "entities", "deny"), "")
    return ScanConfig(
        locale=_need(value["locale"], str, "/locale") if "locale" in value else None,
        detect_uuid=_need(value.get("detect_uuid", False), bool, "/detect_uuid"),
        format=_need(value.get("format", "text"), str, "/format"),
        entities=tuple(_names(value["entities"], "/entities")) if "entities" in value else None,
        deny=parse_deny(value.get("deny", [])),
    )


def _name(value: Any, path: str) -> str:
    if blank(_need(value, str, path)):
        raise invalid_config("empty_value", path)
    return value


def parse_strategy(value: Any, path: str) -> Strategy:
    _need(value, dict, path)
    if "strategy" not in value:
        raise invalid_config("missing_field", f"{path}/strategy")
    kind = _need(value["strategy"], str, f"{path}/strategy")
    if kind in ("redact", "remove"):
        _fields(value, ("strategy",), path)
        return Strategy(kind)
    if kind == "mask":
        _fields(value, ("strategy", "character", "reveal"), path)
        character = _need(value.get("character", "*"), str, f"{path}/character")
        if len(character) != 1 or character in SPACE or unicodedata.category(character) == "Cc":
            raise invalid_config("invalid_value", f"{path}/character")
        if "reveal" not in value:
            return Strategy(kind, character)
        reveal = _fields(value["reveal"], ("direction", "count"), f"{path}/reveal", ("direction", "count"))
        direction = _need(reveal["direction"], str, f"{path}/reveal/direction")
        count = reveal["count"]
        if isinstance(count, bool) or not isinstance(count, int) or count < 0:
            raise invalid_config("invalid_value", f"{path}/reveal/count")
        if direction not in ("first", "last"):
            raise invalid_config("invalid_value", f"{path}/reveal/direction")
        return Strategy(kind, character, direction, count)
    if kind == "pseudonymize":
        _fields(value, ("strategy", "key_ref", "key_version"), path, ("key_ref",))
        version = _name(value["key_version"], f"{path}/key_version") if "key_version" in value else None
        return Strategy(kind, key_ref=_name(value["key_ref"], f"{path}/key_ref"), key_version=version)
    if kind == "tokenize":
        _fields(value, ("strategy", "token_ref"), path, ("token_ref",))
        return Strategy(kind, token_ref=_name(value["token_ref"], f"{path}/token_ref"))
    raise invalid_config("invalid_value", f"{path}/strategy")


def parse_transform(value: Any) -> TransformConfig:
    _fields(value, ("default", "entities", "overrides", "allow"), "", ("default",))
    default = parse_strategy(value["default"], "/default")
    entities = None
    if "entities" in value:
        names = _names(value["entities"], "/entities")
        if not names:
            raise invalid_config("empty_value", "/entities")
        for i, name in enumerate(names):
            if blank(name):
                raise invalid_config("empty_value", f"/entities/{i}")
        entities = frozenset(names)
    overrides = {k: parse_strategy(v, f"/overrides/{pointer(k)}") for k, v in _need(value.get("overrides", {}), dict, "/overrides").items()}
    allow = _fields(value.get("allow", {}), ("exact", "regex"), "/allow")
    exact = {k: frozenset(_names(v, f"/allow/exact/{pointer(k)}")) for k, v in _need(allow.get("exact", {}), dict, "/allow/exact").items()}
    patterns: dict[str, tuple[tuple[str, bool], ...]] = {}
    count = total = 0
    for entity, rules in _need(allow.get("regex", {}), dict, "/allow/regex").items():
        base, own = f"/allow/regex/{pointer(entity)}", []
        for i, rule in enumerate(_need(rules, list, base)):
            path = f"{base}/{i}"
            _fields(rule, ("pattern", "case_sensitive"), path, ("pattern",))
            pattern = _need(rule["pattern"], str, f"{path}/pattern")
            size = len(pattern.encode())
            count, total = count + 1, total + size
            if size > MAX_PATTERN or count > MAX_PATTERNS or total > MAX_PATTERN_TOTAL:
                raise invalid_config("limit_exceeded", f"{path}/pattern")
            try:
                regex.compile(pattern)
            except regex.error:
                raise invalid_config("invalid_regex", f"{path}/pattern") from None
            own.append((pattern, _need(rule.get("case_sensitive", True), bool, f"{path}/case_sensitive")))
        patterns[entity] = tuple(own)
    return TransformConfig(default, entities, overrides, exact, patterns)


def parse_scan_and_transform(value: Any) -> ScanAndTransformConfig:
    _fields(value, ("scan", "transform"), "", ("transform",))
    try:
        transform = parse_transform(value["transform"])
    except PrivacyError as error:
        raise error.under("/transform") from None
    try:
        scan = parse_scan(value["scan"]) if "scan" in value else ScanConfig()
    except PrivacyError as error:
        raise error.under("/scan") from None
    return ScanAndTransformConfig(transform, scan)


def parse_context(value: Any) -> str:
    """The scope of token operations."""
    _fields(value, ("scope",), "/context", ("scope",))
    return _name(value["scope"], "/context/scope")
