"""Scan, protect and audit text columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types
from ..config import ScanAndTransformConfig, ScanConfig, TransformConfig
from ..errors import PrivacyError
from ..kernels.spans import Finding, Policy, Scanner, byte_offsets, merge, rewrite, select, validate
from ..session import spread

FINDINGS = T.ArrayType(types.FINDING)


def finding_rows(text: str, found: list[Finding]) -> list[tuple]:
    at = byte_offsets(text, [p for f in found for p in (f.start, f.end)])
    return [(f.entity_type, f.matched_text, f.start, f.end, at[f.start], at[f.end], f.confidence, f.detector_name, f.detector_version) for f in found]


def finding_of(row) -> Finding:
    """A finding from a row of type FINDING (a Row, dict or tuple)."""
    entity, matched, start, end, b0, b1, confidence, name, version = (row[n] for n in types.FINDING.names) if isinstance(row, dict) else row
    missing = lambda v: v is None or v != v
    return Finding(entity, matched, int(start), int(end), None if missing(confidence) else float(confidence), name or "", version, *(None if missing(b) else int(b) for b in (b0, b1)))


def error_row(error: PrivacyError) -> tuple:
    return error.code, error.reason, error.path, error.index


def prefilter(text: Column, config: ScanConfig) -> Column:
    """False only for texts in which no selected detector can find anything; evaluated without Python."""
    from ..registry import DETECTORS

    if config.deny:
        return text.isNotNull()
    needs = {c for label in config.active() for c in DETECTORS[label].needs or "0123456789"}
    body = "".join("\\" + c if c in "\\]^-" else c for c in sorted(needs))
    return text.isNotNull() & text.rlike(f"[{body}]" if "PHONE" not in config.active() else rf"(?U)[{body}\d]")


def scan_column(text: Column, config: ScanConfig = ScanConfig()) -> Column:
    """The findings of each text as an array; null texts have a null array.

    Only detectors that the configuration selects run, all in one Arrow-batched function; texts
    that hold none of the characters they need never leave the JVM.
    """
    scanner = Scanner.of(config)

    @F.pandas_udf(FINDINGS)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else finding_rows(t, scanner(t)))

    may = prefilter(text, config)
    return F.when(text.isNull(), F.lit(None)).when(~may, F.array().cast(FINDINGS)).otherwise(found(F.when(may, text)))


def with_findings(df: DataFrame, text_col: str = "text", config: ScanConfig = ScanConfig(), out: str = "findings") -> DataFrame:
    return df.withColumn(out, scan_column(F.col(text_col), config))


def findings(df: DataFrame, key_cols: list[str] | str, text_col: str = "text", config: ScanConfig = ScanConfig()) -> DataFrame:
    """One row per finding: the key columns, its number within the text, and the finding's fields."""
    keys = [key_cols] if isinstance(key_cols, str) else key_cols
    may = spread(df.select(*dict.fromkeys([*keys, text_col])).where(prefilter(F.col(text_col), config)))
    rows = may.select(*keys, scan_column(F.col(text_col), config).alias("_f"))
    return rows.select(*keys, F.posexplode("_f").alias("ord", "_f")).select(*keys, "ord", "_f.*")


def _rewriter(config: TransformConfig, choose: Callable, keys: dict | None, on_error: str) -> Callable[[str, list], tuple | None]:
    policy = Policy(config)

    def one(text: str, found: list[Finding]) -> tuple:
        try:
            done = rewrite(text, choose(text, found, policy), config, keys)
            return done.text, [tuple(r[n] for n in types.TRANSFORMATION.names) for r in done.rows], None
        except PrivacyError as error:
            if on_error == "raise":
                raise
            return None, None, error_row(error)

    return one


def _given(text: str, found: list[Finding], policy: Policy) -> list[Finding]:
    validate(text, found)
    return select(found, policy)


def _scanned(text: str, found: list[Finding], policy: Policy) -> list[Finding]:
    return select(merge(text, found, policy), policy)


def transform_column(text: Column, found: Column, config: TransformConfig, keys: dict | None = None, on_error: str = "raise") -> Column:
    """(text, transformations, error) from caller-supplied findings.

    Findings are validated and selected first; a partial overlap that selection cannot cover is a
    ``review_conflict``. With ``on_error="quarantine"`` a bad row has a null text and its error's
    code, reason and path instead of failing the job. Errors hold no source value.
    """
    one = _rewriter(config, _given, keys, on_error)

    @F.pandas_udf(types.PROTECTED)
    def apply(texts: pd.Series, rows: pd.Series) -> pd.DataFrame:
        done = [(None, None, None) if t is None else one(t, [finding_of(r) for r in (f if f is not None else [])]) for t, f in zip(texts, rows, strict=True)]
        return pd.DataFrame(done, columns=types.PROTECTED.names, dtype=object)

    return apply(text, found)


def protect_column(text: Column, config: ScanAndTransformConfig, keys: dict | None = None, on_error: str = "raise") -> Column:
    """(text, transformations, error): scanned and rewritten in one pass; overlapping findings are joined first."""
    scanner, one = Scanner.of(config.scan), _rewriter(config.transform, _scanned, keys, on_error)

    @F.pandas_udf(types.PROTECTED)
    def apply(texts: pd.Series) -> pd.DataFrame:
        done = [(None, None, None) if t is None else one(t, scanner(t)) for t in texts]
        return pd.DataFrame(done, columns=types.PROTECTED.names, dtype=object)

    may = prefilter(text, config.scan)
    plain = F.struct(text.alias("text"), F.array().cast(T.ArrayType(types.TRANSFORMATION)).alias("transformations"), F.lit(None).cast(types.ERROR).alias("error"))
    return F.when(may, apply(F.when(may, text))).otherwise(plain)


def protect(df: DataFrame, config: ScanAndTransformConfig, text_col: str = "text", keys: dict | None = None, on_error: str = "raise") -> DataFrame:
    """``df`` with the text replaced by its protected form, and columns transformations and error."""
    rows = spread(df).withColumn("_p", protect_column(F.col(text_col), config, keys, on_error))
    return rows.withColumns({text_col: F.col("_p.text"), "transformations": F.col("_p.transformations"), "error": F.col("_p.error")}).drop("_p")


def transform(df: DataFrame, config: TransformConfig, text_col: str = "text", findings_col: str = "findings", keys: dict | None = None, on_error: str = "raise") -> DataFrame:
    rows = spread(df).withColumn("_p", transform_column(F.col(text_col), F.col(findings_col), config, keys, on_error))
    return rows.withColumns({text_col: F.col("_p.text"), "transformations": F.col("_p.transformations"), "error": F.col("_p.error")}).drop("_p")


def audit(df: DataFrame, key_cols: list[str] | str, column: str = "transformations") -> DataFrame:
    """One row per transformation; no row holds a source value."""
    keys = [key_cols] if isinstance(key_cols, str) else key_cols
    return df.select(*keys, F.posexplode(column).alias("ord", "_t")).select(*keys, "ord", "_t.*")


def key_selectors(config: TransformConfig, entities: list[str]) -> list[tuple[str, str | None]]:
    """The distinct keys (reference, version) that findings of these entities need, in order."""
    found = {(s.key_ref, s.key_version) for e in entities if (s := config.strategy(e)).kind == "pseudonymize"}
    return sorted(found, key=lambda k: (k[0], k[1] or ""))


def resolve_keys(selectors: list[tuple[str, str | None]], provider: Callable[[str, str | None], tuple[str, bytes]]) -> dict:
    """Asks ``provider`` once for each selector, before any row is written; keys have 32 bytes and a version."""
    keys = {}
    for ref, version in selectors:
        resolved, key = provider(ref, version)
        if len(key) != 32 or not resolved.strip():
            raise PrivacyError("invalid_key_material")
        keys[ref, version] = (resolved, key)
    return keys
