"""Tokenise and restore through a vault table."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types
from ..config import ScanAndTransformConfig, TransformConfig, blank
from ..errors import PrivacyError, invalid_config
from ..kernels.envelope import PREFIX, envelope, parse_tokens
from ..kernels.spans import Finding, Policy, Scanner, merge, rewrite, select
from ..session import spread, staged
from .scan import error_row

ISSUED = T.StructType([T.StructField(n, t) for n, t in (("token_ref", T.StringType()), ("version", T.StringType()), ("payload", T.BinaryType()), ("value", T.StringType()))])
_RESULT = T.StructType([*types.PROTECTED.fields, T.StructField("issued", T.ArrayType(ISSUED))])
VAULT_SCHEMA = "scope string, token_ref string, version string, payload binary, value string"


def _checked(scope: str) -> str:
    if blank(scope):
        raise invalid_config("empty_value", "/context/scope")
    return scope


def issuer(scope: str, key: bytes, version: str, config: TransformConfig):
    """A function that makes the token of a finding, and the list of tokens that it made.

    A token's payload is a keyed digest of scope, reference and value, so a retried task issues
    the same tokens and equal values share one.
    """
    issued: list[tuple] = []

    def token(i: int, f: Finding) -> tuple[str, str]:
        ref = config.strategy(f.entity_type).token_ref
        payload = hmac.digest(key, "\0".join((scope, ref, f.matched_text)).encode(), hashlib.sha256)[:16]
        issued.append((ref, version, payload, f.matched_text))
        return envelope(ref, version, payload), version

    return token, issued


def chosen_findings(text: str, found: list[Finding], policy: Policy) -> list[Finding]:
    """The findings to transform; an error if one to tokenize overlaps a token that the text holds, or the text holds a malformed one."""
    chosen = select(found, policy)
    picked = [f for f in chosen if policy.config.strategy(f.entity_type).kind == "tokenize"]
    held = parse_tokens(text) if picked else []
    for f in picked:
        if any(f.start < t.end and t.start < f.end for t in held):
            raise PrivacyError("invalid_token", path=policy.config.strategy_path(f.entity_type))
    return chosen


def tokenize(df: DataFrame, config: ScanAndTransformConfig, scope: str, key: bytes, version: str = "1", text_col: str = "text", keys: dict | None = None, on_error: str = "raise") -> DataFrame:
    """``df`` protected, with columns transformations, error and issued (the tokens made).

    Tokens come from ``issuer``. Texts that already hold malformed tokens, or whose findings
    overlap a token, are errors. ``vault_rows`` turns ``issued`` into rows to append.
    """
    _checked(scope)
    scanner, policy, cfg = Scanner.of(config.scan), Policy(config.transform), config.transform

    def one(text: str) -> tuple:
        token, issued = issuer(scope, key, version, cfg)
        try:
            done = rewrite(text, chosen_findings(text, merge(text, scanner(text), policy), policy), cfg, keys, token)
            return done.text, [tuple(r[n] for n in types.TRANSFORMATION.names) for r in done.rows], None, issued
        except PrivacyError as error:
            if on_error == "raise":
                raise
            return None, None, error_row(error), []

    return _applied(df, text_col, F.pandas_udf(lambda texts: _rows(texts, one), _RESULT)(F.col(text_col)), "issued")


def _rows(texts: pd.Series, one: Callable[[str], tuple]) -> pd.DataFrame:
    return pd.DataFrame([(None, None, None, None) if t is None else one(t) for t in texts], columns=_RESULT.names, dtype=object)


def _applied(df: DataFrame, text_col: str, result: Column, *more: str) -> DataFrame:
    rows = spread(df).withColumn("_p", result)
    return rows.withColumns({text_col: F.col("_p.text")} | {c: F.col(f"_p.{c}") for c in ("transformations", "error", *more)}).drop("_p")


ITEM = T.StructType([T.StructField("entity_type", T.StringType()), T.StructField("token_ref", T.StringType()), T.StructField("value", T.StringType())])


def required_tokenization_items(df: DataFrame, config: ScanAndTransformConfig, key_col: str, text_col: str = "text") -> DataFrame:
    """(key, ord, entity_type, token_ref, value): what a provider has to issue tokens for, in order of each text."""
    scanner, policy, cfg = Scanner.of(config.scan), Policy(config.transform), config.transform

    def items(text: str) -> list[tuple]:
        chosen = chosen_findings(text, merge(text, scanner(text), policy), policy)
        return [(f.entity_type, s.token_ref, f.matched_text) for f in chosen if (s := cfg.strategy(f.entity_type)).kind == "tokenize"]

    found = F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else items(t)), T.ArrayType(ITEM))
    return spread(df.select(key_col, text_col)).select(F.col(key_col), F.posexplode(found(F.col(text_col))).alias("ord", "_i")).select(key_col, "ord", "_i.*")


def transform_with_provider_results(df: DataFrame, config: ScanAndTransformConfig, results: DataFrame, key_col: str, text_col: str = "text", keys: dict | None = None, on_error: str = "raise") -> DataFrame:
    """``df`` protected with the tokens that a provider issued: ``results`` (key, ord, version, payload).

    Each text needs as many results as it has items, no more and no fewer, or is an
    ``invalid_provider_response``. ``key_col`` has to be unique.
    """
    scanner, policy, cfg = Scanner.of(config.scan), Policy(config.transform), config.transform
    given = results.groupBy(F.col(key_col).alias("_k")).agg(F.array_sort(F.collect_list(F.struct("ord", "version", "payload"))).alias("_g"))

    def one(text: str, given) -> tuple:
        left = list(given if given is not None else [])

        def token(i: int, f: Finding) -> tuple[str, str]:
            if not left:
                raise PrivacyError("invalid_provider_response", path=cfg.strategy_path(f.entity_type))
            row = left.pop(0)
            if blank(row["version"] or "") or not row["payload"]:
                raise PrivacyError("invalid_provider_response", path=cfg.strategy_path(f.entity_type))
            return envelope(cfg.strategy(f.entity_type).token_ref, row["version"], bytes(row["payload"])), row["version"]

        try:
            done = rewrite(text, chosen_findings(text, merge(text, scanner(text), policy), policy), cfg, keys, token)
            if left:
                raise PrivacyError("invalid_provider_response")
            return done.text, [tuple(r[n] for n in types.TRANSFORMATION.names) for r in done.rows], None
        except PrivacyError as error:
            if on_error == "raise":
                raise
            return None, None, error_row(error)

    @F.pandas_udf(types.PROTECTED)
    def apply(texts: pd.Series, rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None) if t is None else one(t, g) for t, g in zip(texts, rows, strict=True)], columns=types.PROTECTED.names, dtype=object)

    joined = df.join(given, F.col(key_col) == F.col("_k"), "left").drop("_k")
    return _applied(joined, text_col, apply(F.col(text_col), F.col("_g"))).drop("_g")


class TokenProvider(Protocol):
    """A vault service. Results are in the order of the items; None stands for a token that it does not know."""

    def tokenize_batch(self, scope: str, items: list[tuple[str, str]]) -> list[tuple[str, bytes]]: ...

    def restore_batch(self, scope: str, items: list[tuple[str, str, bytes]]) -> list[str | None]: ...


def _asked(items: DataFrame, columns: list[str], call: Callable[[list[tuple]], list], result: T.StructType, make_row) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = list(pdf[columns].itertuples(index=False, name=None))
            answers = call(rows) if rows else []
            if len(answers) != len(rows):
                raise PrivacyError("invalid_provider_response")
            yield pd.DataFrame([make_row(*r) for r in zip(rows, answers, strict=True)], columns=result.names)

    return items.select(*columns).mapInPandas(run, result)


def issue_tokens(items: DataFrame, provider: TokenProvider, scope: str, key_col: str) -> DataFrame:
    """``items`` with version and payload: the provider is asked once for each distinct (token_ref, value), in batches.

    The answers are written before they are used, so that a retried task asks for no second token
    where another has read the first. The provider is sent to the executors.
    """
    _checked(scope)
    schema = T.StructType([T.StructField("token_ref", T.StringType()), T.StructField("value", T.StringType()), T.StructField("version", T.StringType()), T.StructField("payload", T.BinaryType())])
    distinct = items.select("token_ref", "value").distinct()
    answers = staged(_asked(distinct, ["token_ref", "value"], lambda rows: provider.tokenize_batch(scope, rows), schema, lambda row, answer: (*row, answer[0], bytes(answer[1]))), "issued-tokens")
    return items.join(answers, ["token_ref", "value"])


def tokenize_with(df: DataFrame, config: ScanAndTransformConfig, provider: TokenProvider, scope: str, key_col: str, text_col: str = "text", keys: dict | None = None, on_error: str = "raise") -> DataFrame:
    """``df`` protected with tokens of ``provider``: items are gathered, answered in batches and put in."""
    items = staged(required_tokenization_items(df, config, key_col, text_col), "token-items")
    return transform_with_provider_results(df, config, issue_tokens(items, provider, scope, key_col), key_col, text_col, keys, on_error)


def restore_with(df: DataFrame, provider: TokenProvider, scope: str, key_col: str, text_col: str = "text", on_error: str = "raise") -> DataFrame:
    """``df`` with its tokens restored by ``provider``, which is asked once for each distinct token, in batches."""
    _checked(scope)
    columns = ["token_ref", "version", "payload"]
    items = required_items(df, key_col, text_col).select(*columns).distinct()
    schema = T.StructType([T.StructField(n, T.BinaryType() if n == "payload" else T.StringType()) for n in (*columns, "value")])
    values = staged(_asked(items, columns, lambda rows: provider.restore_batch(scope, rows), schema, lambda row, answer: (*row, answer)), "restored-tokens")
    return restore(df, values.withColumn("scope", F.lit(scope)), scope, key_col, text_col, on_error)


def vault_rows(tokenized: DataFrame, scope: str) -> DataFrame:
    """The distinct tokens issued, as rows of VAULT_SCHEMA."""
    rows = tokenized.select(F.explode("issued").alias("i")).select(F.lit(_checked(scope)).alias("scope"), "i.*")
    return rows.distinct()


def parse_column(text_col: str, on_error: str = "raise"):
    @F.pandas_udf(types.PARSED)
    def parse(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            try:
                out.append((None if text is None else [(t.envelope, t.token_ref, t.version, t.payload, t.start, t.end) for t in parse_tokens(text)], None))
            except PrivacyError as error:
                if on_error == "raise":
                    raise
                out.append((None, error_row(error)))
        return pd.DataFrame(out, columns=types.PARSED.names, dtype=object)

    return parse(F.col(text_col))


def required_items(df: DataFrame, key_col: str, text_col: str = "text") -> DataFrame:
    """(key, envelope, token_ref, version, payload): the distinct tokens of each text."""
    rows = spread(df.select(key_col, text_col).where(F.col(text_col).contains(PREFIX))).select(F.col(key_col), F.explode(parse_column(text_col)["tokens"]).alias("t"))
    return rows.select(key_col, "t.envelope", "t.token_ref", "t.version", "t.payload").distinct()


def restore(df: DataFrame, vault: DataFrame, scope: str, key_col: str, text_col: str = "text", on_error: str = "raise") -> DataFrame:
    """``df`` with its tokens replaced by their values, and columns n_restored and error.

    All or nothing for each text: one token without a value in the vault is ``token_not_found``.
    Restored values are not looked at again. The vault is joined on its key; texts themselves are
    not part of that join's exchange. ``key_col`` has to be unique.
    """
    _checked(scope)
    may = F.coalesce(F.col(text_col).contains(PREFIX), F.lit(False))
    held = staged(spread(df.where(may)).withColumn("_t", parse_column(text_col, on_error)), "parsed-tokens")  # parsed once
    plain = held.where("_t.tokens is null or size(_t.tokens) = 0")
    marked = held.where("size(_t.tokens) > 0")
    wanted = marked.select(F.col(key_col).alias("_k"), F.explode("_t.tokens").alias("t")).select("_k", "t.envelope", "t.token_ref", "t.version", "t.payload").distinct()
    values = vault.where(F.col("scope") == scope).select("token_ref", "version", "payload", "value").dropDuplicates(["token_ref", "version", "payload"])
    found = wanted.join(values, ["token_ref", "version", "payload"], "left")
    known = found.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("envelope", "value"))).alias("_v"))

    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("error", types.ERROR)])

    @F.pandas_udf(schema)
    def fill(texts: pd.Series, values: pd.Series, tokens: pd.Series) -> pd.DataFrame:
        out = []
        for text, v, spans in zip(texts, values, tokens, strict=True):
            v = dict(v)
            if any(x is None for x in v.values()):
                error = PrivacyError("token_not_found")
                if on_error == "raise":
                    raise error
                out.append((None, 0, error_row(error)))
                continue
            parts, at = [], 0
            for t in spans:
                parts += [text[at : t["start"]], v[t["envelope"]]]
                at = t["end"]
            out.append(("".join([*parts, text[at:]]), len(spans), None))
        return pd.DataFrame(out, columns=schema.names, dtype=object)

    columns = [c for c in df.columns if c != text_col]
    done = marked.join(known, F.col(key_col) == F.col("_k")).withColumn("_r", fill(F.col(text_col), F.col("_v"), F.col("_t.tokens")))
    done = done.select(*columns, F.col("_r.text").alias(text_col), F.col("_r.n").alias("n_restored"), F.col("_r.error").alias("error"))
    same = plain.select(*columns, F.when(F.col("_t.error").isNull(), F.col(text_col)).alias(text_col), F.lit(0).cast("long").alias("n_restored"), F.col("_t.error").alias("error"))
    none = F.lit(None).cast(types.ERROR).alias("error")
    return df.where(~may).select(*columns, text_col, F.lit(0).cast("long").alias("n_restored"), none).unionByName(same).unionByName(done)


class PrivacySession:
    """Key and token providers around the operators: keys are resolved first, then tokens issued."""

    def __init__(self, key_provider: Callable[[str, str | None], tuple[str, bytes]] | None = None, vault: DataFrame | None = None, vault_key: bytes | None = None, token_provider: TokenProvider | None = None):
        self.key_provider, self.vault, self.vault_key, self.token_provider = key_provider, vault, vault_key, token_provider

    def _keys(self, config: ScanAndTransformConfig) -> dict:
        from .scan import resolve_keys

        t = config.transform
        chosen = [t.default, *t.overrides.values()]
        wanted = sorted({(s.key_ref, s.key_version) for s in chosen if s.kind == "pseudonymize"}, key=str)
        if wanted and self.key_provider is None:
            raise PrivacyError("key_provider_required", path="/default")
        return resolve_keys(wanted, self.key_provider) if wanted else {}

    def scan_and_transform(self, df: DataFrame, config: ScanAndTransformConfig, scope: str | None = None, text_col: str = "text", on_error: str = "raise", key_col: str | None = None) -> DataFrame:
        from .scan import protect

        t = config.transform
        keys = self._keys(config)
        if any(s.kind == "tokenize" for s in (t.default, *t.overrides.values())):
            if scope is not None and self.token_provider is not None and key_col is not None:
                return tokenize_with(df, config, self.token_provider, scope, key_col, text_col, keys, on_error)
            if scope is None or self.vault_key is None:
                raise PrivacyError("token_provider_required", path="/default")
            return tokenize(df, config, scope, self.vault_key, text_col=text_col, keys=keys, on_error=on_error)
        return protect(df, config, text_col, keys, on_error)

    def restore(self, df: DataFrame, scope: str, key_col: str, text_col: str = "text", on_error: str = "raise") -> DataFrame:
        if self.token_provider is not None:
            return restore_with(df, self.token_provider, scope, key_col, text_col, on_error)
        if self.vault is None:
            raise PrivacyError("token_provider_required")
        return restore(df, self.vault, scope, key_col, text_col, on_error)
