"""JSON documents: their string leaves, name fields, and leaves put back."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from .. import registry
from ..config import SPACE, ScanConfig, _fields, _names, _need, parse_scan, pointer
from ..errors import PrivacyError, invalid_config
from . import labelled
from .spans import Finding, Scanner

MAX_DEPTH, MAX_INTEGER = 127, 2**53 - 1
# Field names that hold a person's name, in their three spellings.
PERSON_FIELDS = [
    ("first_name", "firstName", "FirstName"),
    ("given_name", "givenName", "GivenName"),
    ("last_name", "lastName", "LastName"),
    ("family_name", "familyName", "FamilyName"),
    ("full_name", "fullName", "FullName"),
    ("surname", "surname", "Surname"),
]


@dataclass(frozen=True)
class StructuredConfig:
    scan: ScanConfig = ScanConfig()
    discover_person: bool = True
    mappings: frozenset[str] = frozenset()
    exclude: frozenset[str] = frozenset()


def parse_structured(value: Any) -> StructuredConfig:
    _fields(value, ("deny", "locale", "detect_uuid", "format", "discover_person", "mappings", "exclude"), "")
    mappings = _need(value.get("mappings", {}), dict, "/mappings")
    for path, entity in mappings.items():
        if _need(entity, str, f"/mappings/{pointer(path)}") != registry.PERSON:
            raise invalid_config("invalid_value", f"/mappings/{pointer(path)}")
        _pointer(path, f"/mappings/{pointer(path)}")
    exclude = _names(value.get("exclude", []), "/exclude")
    for i, path in enumerate(exclude):
        _pointer(path, f"/exclude/{i}")
        if path in mappings:
            raise invalid_config("duplicate_value", f"/exclude/{i}")
    scan = parse_scan({k: v for k, v in value.items() if k in ("deny", "locale", "detect_uuid", "format")})
    return StructuredConfig(scan, _need(value.get("discover_person", True), bool, "/discover_person"), frozenset(mappings), frozenset(exclude))


def _pointer(path: str, where: str) -> None:
    if not path.startswith("/") or any(c not in "01" for part in path.split("~")[1:] for c in part[:1] or "x"):
        raise invalid_config("invalid_value", where, "must be a JSON pointer")


def _unfit(_: str) -> Any:
    raise PrivacyError("invalid_configuration", "invalid_value", "/data")


def parse_json(text: str) -> Any:
    try:
        data = json.loads(text, parse_constant=_unfit)
    except (ValueError, RecursionError):
        raise PrivacyError("invalid_configuration", "invalid_value", "/data", "not a JSON document") from None
    if not isinstance(data, dict | list):
        _unfit("")
    return data


@dataclass(frozen=True)
class Leaf:
    path: str
    key: str | None
    value: str


def leaves(data: Any, path: str = "", key: str | None = None, depth: int = 1) -> Iterator[Leaf]:
    """String leaves, depth first; members by the bytes of their names, items by position."""
    if isinstance(data, dict | list):
        if depth > MAX_DEPTH:
            _unfit("")
        if isinstance(data, dict):
            for name in sorted(data, key=lambda n: n.encode("utf-8", "surrogatepass")):
                yield from leaves(data[name], f"{path}/{pointer(name)}", name, depth + 1)
        else:
            for i, item in enumerate(data):
                yield from leaves(item, f"{path}/{i}", None, depth + 1)
    elif isinstance(data, str):
        yield Leaf(path, key, data)
    elif isinstance(data, int | float) and not isinstance(data, bool):
        if not math.isfinite(data) or (data == int(data) and abs(data) > MAX_INTEGER):
            _unfit("")


def replaced(data: Any, values: dict[str, str], path: str = "") -> Any:
    """``data`` with the leaves at the given paths replaced."""
    if isinstance(data, dict):
        return {k: replaced(v, values, f"{path}/{pointer(k)}") for k, v in data.items()}
    if isinstance(data, list):
        return [replaced(v, values, f"{path}/{i}") for i, v in enumerate(data)]
    return values.get(path, data) if isinstance(data, str) else data


def dump(data: Any) -> str:
    return json.dumps(data, ensure_ascii=False, separators=(",", ":"))


def person_rule(leaf: Leaf, config: StructuredConfig) -> tuple[str, str] | None:
    """(source, rule) that makes the leaf a person's name."""
    if leaf.path in config.mappings:
        return "explicit_mapping", "explicit_mapping"
    if not config.discover_person or leaf.path in config.exclude or leaf.key is None:
        return None
    for snake, camel, pascal in PERSON_FIELDS:
        if leaf.key in (camel, pascal) or (leaf.key.isascii() and leaf.key.lower() == snake):
            return "field_alias", snake
    return None


def scan_leaf(leaf: Leaf, config: StructuredConfig, scanner: Scanner) -> list[Finding]:
    found = scanner(leaf.value)
    if leaf.key and leaf.key.isascii() and leaf.key.lower() == "authorization" and (span := labelled.bearer_value(leaf.value)):
        found.append(Finding("BEARER_TOKEN", leaf.value[slice(*span)], *span, None, registry.DETECTORS["BEARER_TOKEN"].name))
    rule = person_rule(leaf, config)
    if rule and leaf.value.strip(SPACE):
        found.append(Finding(registry.PERSON, leaf.value, 0, len(leaf.value), None, f"{registry.PERSON_DETECTOR}/{rule[0]}"))
    return sorted(found, key=lambda f: (f.start, -f.end, f.entity_type))


def rewrite_leaves(data: Any, change: Callable[[Leaf], tuple[str, list[dict]]]) -> tuple[Any, list[tuple[str, dict]]]:
    values, rows = {}, []
    for leaf in leaves(data):
        text, own = change(leaf)
        if text != leaf.value:
            values[leaf.path] = text
        rows += [(leaf.path, r) for r in own]
    return replaced(data, values), rows


__all__ = ["Leaf", "StructuredConfig", "dump", "leaves", "parse_json", "parse_structured", "person_rule", "replace", "rewrite_leaves", "scan_leaf"]
