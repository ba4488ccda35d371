"""Model-backed detection: which labels go to rules or a model, span conversion, evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry
from ..config import ScanConfig
from ..errors import PrivacyError, invalid_config
from ..kernels import tagging
from ..registry import DETECTORS
from ..session import spread
from .scan import findings

#: Texts whose tokens and scores are held at a time.
TEXTS = 512
COLUMNS = ["entity_type", "matched_text", "start", "end", "confidence", "detector_name"]


@dataclass(frozen=True)
class ModelContract:
    """What a model reports: its labels by native name, offset unit, score thresholds and limits."""

    name: str
    labels: dict[str, str]
    offset_unit: str = "codepoint"
    thresholds: dict[str, float] = field(default_factory=dict)
    max_bytes: int = 65_536
    max_findings: int = 1_024


class Backend(Protocol):
    """One is made in each task."""

    def spans(self, texts: list[str], labels: list[str]) -> Iterator[list[tuple[str, int, int, float | None]]]: ...


@dataclass(frozen=True)
class Tagger:
    """A backend made of a tokenizer (code point ranges) and a scorer of windows of tokens.

    ``score`` gives one row of ``1 + 2 len(labels)`` logits for each word, in the order of
    ``kernels.tagging``. Long texts are scored in overlapping windows. Spans have no confidence,
    as logits of a path are none.
    """

    labels: tuple[str, ...]
    tokenize: Callable[[str], list[tuple[int, int]]]
    score: Callable[[list[str]], np.ndarray]

    def spans(self, texts: list[str], labels: list[str]) -> Iterator[list[tuple[str, int, int, float | None]]]:
        for at in range(0, len(texts), TEXTS):
            part = texts[at : at + TEXTS]
            tokens = [self.tokenize(text) for text in part]
            tags = tagging.best_tags_of([self._scores([text[a:b] for a, b in own]) for text, own in zip(part, tokens, strict=True)])
            for text, own, best in zip(part, tokens, tags, strict=True):
                found = tagging.tagged_spans(text, own, best, list(self.labels))
                yield [(label, a, b, None) for label, a, b in found if label in labels]

    def _scores(self, words: list[str]) -> np.ndarray:
        scores = np.zeros((len(words), 1 + 2 * len(self.labels)), np.float32)
        for seen, own in tagging.windows(len(words)):
            scores[own] = self.score(words[seen])[own.start - seen.start : own.stop - seen.start]
        return scores


def route(entities: list[str] | None, contract: ModelContract) -> tuple[list[str], list[str]]:
    """(rule labels, model labels). A label whose rule replaces the model goes to the rule alone; partial rules run with the model."""
    offered = set(contract.labels.values())
    wanted = entities if entities is not None else sorted({d.label for d in DETECTORS.values() if d.activation == "default"} | offered)
    for i, name in enumerate(wanted):
        if name not in DETECTORS and name not in offered:
            raise invalid_config("invalid_value", f"/entities/{i}")
    rules = [n for n in wanted if n in DETECTORS]
    return rules, [n for n in wanted if n in offered and (n not in DETECTORS or not DETECTORS[n].replaces_model)]


def converted(text: str, spans, contract: ModelContract) -> list[tuple]:
    """Model spans as code point findings that keep the contract's rules."""
    raw = text.encode()
    if len(raw) > contract.max_bytes:
        raise PrivacyError("internal_error", "limit_exceeded", "/text")
    out = []
    for native, start, end, score in spans:
        if native not in contract.labels or (score is not None and not 0.0 <= score <= 1.0):
            raise PrivacyError("invalid_finding", "invalid_value")
        if score is not None and score < contract.thresholds.get(native, 0.0):
            continue
        if contract.offset_unit == "byte":
            if not 0 <= start < end <= len(raw):
                raise PrivacyError("invalid_finding", "out_of_bounds")
            try:
                start, end = len(raw[:start].decode()), len(raw[:end].decode())
            except UnicodeDecodeError:
                raise PrivacyError("invalid_finding", "invalid_boundary") from None
        if not 0 <= start < end <= len(text):
            raise PrivacyError("invalid_finding", "out_of_bounds")
        out.append((contract.labels[native], text[start:end], start, end, score))
    if len(out) > contract.max_findings:
        raise PrivacyError("internal_error", "limit_exceeded", "/findings")
    return out


def model_findings(df: DataFrame, key_col: str, make_backend, contract: ModelContract, labels: list[str], text_col: str = "text") -> DataFrame:
    """Findings of a model, whose backend is made once per task and fed whole Arrow batches."""
    natives = [n for n, label in contract.labels.items() if label in labels]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for pdf in batches:
            pdf = pdf[pdf["_t"].notna()]
            texts, out = pdf["_t"].tolist(), []
            for key, text, spans in zip(pdf["_k"], texts, backend.spans(texts, natives), strict=True):
                out += [(key, *row, contract.name) for row in converted(text, spans, contract)]
            yield pd.DataFrame(out, columns=[key_col, *COLUMNS])

    schema = f"{key_col} {dict(df.dtypes)[key_col]}, entity_type string, matched_text string, start long, end long, confidence float, detector_name string"
    return spread(df.select(F.col(key_col).alias("_k"), F.col(text_col).alias("_t"))).mapInPandas(run, schema)


def compose(rules: DataFrame, model: DataFrame, key_col: str) -> DataFrame:
    """One row per (key, start, end, entity_type): the best finding and the sorted names of all that found it.

    Findings are met in order, those of rules first. A later one is better if it is a denied
    phrase and the one so far is not; else, where both have a confidence, if it is surer; else if
    its detector comes first by name.
    """
    side = lambda df, n: df.select(key_col, *COLUMNS, F.lit(n).alias("_side"))
    rows = side(rules, 0).unionByName(side(model, 1))
    met = F.array_sort(F.collect_set(F.struct("_side", "detector_name", "confidence", "matched_text")))
    out = rows.groupBy(key_col, "start", "end", "entity_type").agg(met.alias("_m"), F.sort_array(F.collect_set("detector_name")).alias("sources"))
    denied = lambda f: (F.col("entity_type") == registry.DENYLIST) & (f["detector_name"] == registry.DENY_DETECTOR)
    both = lambda a, b: a["confidence"].isNotNull() & b["confidence"].isNotNull() & (a["confidence"] != b["confidence"])
    better = lambda a, b: F.when(denied(a) != denied(b), denied(b)).when(both(a, b), b["confidence"] > a["confidence"]).otherwise(b["detector_name"] < a["detector_name"])
    out = out.withColumn("_b", F.reduce("_m", F.get("_m", F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a)))
    out = out.withColumn("_b", F.struct("_b.matched_text", "_b.confidence", "_b.detector_name"))
    return out.select(key_col, "start", "end", "entity_type", "_b.*", "sources")


def scan_routed(df: DataFrame, key_col: str, make_backend, contract: ModelContract, config: ScanConfig = ScanConfig(), entities: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Rules and model together; the model does not run at all if no label is routed to it."""
    rule_labels, model_labels = route(entities, contract)
    on = ScanConfig(config.locale, config.detect_uuid, config.format).active()
    active = tuple(n for n in rule_labels if n in on)
    found = findings(df, key_col, text_col, ScanConfig(config.locale, config.detect_uuid, config.format, active or None, config.deny))
    if not active:
        found = found.where("entity_type = 'DENYLIST'")
    model = model_findings(df, key_col, make_backend, contract, model_labels, text_col) if model_labels else found.limit(0)
    return compose(found, model, key_col)
