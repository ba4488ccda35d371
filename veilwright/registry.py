"""The supported labels: order, detector, activation and whether rules replace a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from . import __version__
from .kernels import labelled, network, numbers

Scan = Callable[[str], Iterator[tuple[int, int]]]


@dataclass(frozen=True)
class Detector:
    label: str
    #: Ties between findings of equal range are broken by this order.
    ordinal: int
    activation: str
    scan: Scan | None
    #: Every text with a finding holds one of these characters; "" stands for no such rule.
    needs: str = ""
    replaces_model: bool = True

    @property
    def name(self) -> str:
        return "veilwright/" + self.label.lower().replace("_", "-")


def _cards(text: str):
    return numbers.cards(text, labelled.ibans(text))


_RULES: list[tuple[str, str, Scan, str]] = [
    ("ACCOUNT_NUMBER", "default", labelled.accounts, "0123456789"),
    ("API_KEY", "default", labelled.api_keys, "_"),
    ("CREDENTIAL_URI", "default", labelled.credential_uris, "@"),
    ("EMAIL", "default", network.emails, "@"),
    ("PHONE", "default", numbers.phones, ""),
    ("SSN", "default", numbers.ssns, "0123456789"),
    ("STREET_ADDRESS", "default", labelled.streets, ":"),
    ("CREDIT_CARD", "default", _cards, "0123456789"),
    ("IP_ADDRESS", "default", network.ip_addresses, ".:"),
    ("DATE", "default", numbers.dates, "0123456789"),
    ("ZIP_CODE", "default", numbers.zips, "0123456789"),
    ("BEARER_TOKEN", "default", labelled.bearer_tokens, ":"),
    ("JWT", "default", labelled.jwts, "."),
    ("PRIVATE_KEY", "default", labelled.private_keys, "-"),
    ("US_ROUTING_NUMBER", "default", labelled.routing_numbers, "0123456789"),
    ("NPI", "default", labelled.npis, "0123456789"),
    *[(label, "german", labelled.german(label), "0123456789") for label in labelled.GERMAN],
    ("UUID", "uuid", labelled.uuids, "-"),
]
PARTIAL = {"ACCOUNT_NUMBER", "STREET_ADDRESS"}
DETECTORS: dict[str, Detector] = {label: Detector(label, i, when, scan, needs, label not in PARTIAL) for i, (label, when, scan, needs) in enumerate(_RULES)}
PERSON, DENYLIST = "PERSON", "DENYLIST"
DENY_DETECTOR = "veilwright/denylist"
PERSON_DETECTOR = "veilwright/person-field"
VERSION = __version__
#: Locale names, trimmed and compared without ASCII case, and what they activate.
LOCALES = {"de": "german", "de-de": "german", "de_de": "german", "en-us": "default", "fr": "default"}


def capabilities(spark):
    """(label, ordinal, detector_name, detector_version, activation, replaces_model) of every label."""
    rows = [(d.label, d.ordinal, d.name, VERSION, d.activation, d.replaces_model) for d in DETECTORS.values()]
    rows.append((PERSON, len(rows), PERSON_DETECTOR, VERSION, "structured", False))
    return spark.createDataFrame(rows, "label string, ordinal int, detector_name string, detector_version string, activation string, replaces_model boolean")
