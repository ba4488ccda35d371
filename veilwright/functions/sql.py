"""The operations as SQL functions: ``register(spark)``, then call them in any query.

    scan_text(text)                    array of findings, default configuration
    scan_text_with(text, config)       with a JSON scan configuration
    protect_text(text, config)         struct(text, transformations, error), JSON scan and transform configuration
    json_leaves(data)                  array of (path, key, value)
    person_fields(data)                array of (path, entity_type, source, rule)
    identity_key(value)                normalised identity of an alias
    findings_of(text, config)          table function for LATERAL: one row per finding
"""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types
from ..config import parse_scan, parse_scan_and_transform
from ..errors import PrivacyError
from ..kernels import markers, tree
from ..kernels.spans import Policy, Scanner, merge, rewrite, select
from ..operators.scan import FINDINGS, error_row, finding_rows
from ..operators.structured import MAPPING


@functools.lru_cache(64)
def _scanner(config: str) -> Scanner:
    return Scanner.of(parse_scan(json.loads(config)))


@functools.lru_cache(64)
def _protector(config: str):
    parsed = parse_scan_and_transform(json.loads(config))
    return Scanner.of(parsed.scan), Policy(parsed.transform)


def _protected(text: str, config: str) -> tuple:
    try:
        scanner, policy = _protector(config)
        done = rewrite(text, select(merge(text, scanner(text), policy), policy), policy.config)
    except PrivacyError as error:
        return None, None, error_row(error)
    return done.text, [tuple(r[n] for n in types.TRANSFORMATION.names) for r in done.rows], None


def register(spark: SparkSession) -> None:
    @F.pandas_udf(FINDINGS)
    def scan_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else finding_rows(t, _scanner("{}")(t)))

    @F.pandas_udf(FINDINGS)
    def scan_text_with(texts: pd.Series, configs: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or c is None else finding_rows(t, _scanner(c)(t)) for t, c in zip(texts, configs, strict=True)], dtype=object)

    @F.pandas_udf(types.PROTECTED)
    def protect_text(texts: pd.Series, configs: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if t is None or c is None else _protected(t, c) for t, c in zip(texts, configs, strict=True)]
        return pd.DataFrame(rows, columns=types.PROTECTED.names, dtype=object)

    @F.pandas_udf(T.ArrayType(types.LEAF))
    def json_leaves(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [(x.path, x.key, x.value) for x in tree.leaves(tree.parse_json(t))])

    @F.pandas_udf(T.ArrayType(MAPPING))
    def person_fields(texts: pd.Series) -> pd.Series:
        config = tree.StructuredConfig()
        return texts.map(lambda t: None if t is None else [(x.path, "PERSON", *r) for x in tree.leaves(tree.parse_json(t)) if (r := tree.person_rule(x, config))])

    @F.pandas_udf(T.StringType())
    def identity_key(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else markers.identity_key(v))

    @F.udtf(returnType="entity_type string, matched_text string, start_at bigint, end_at bigint")
    class FindingsOf:
        def eval(self, text: str, config: str):
            for f in _scanner(config)(text) if text is not None else ():
                yield f.entity_type, f.matched_text, f.start, f.end

    for function in (scan_text, scan_text_with, protect_text, json_leaves, person_fields, identity_key):
        spark.udf.register(function.__name__, function)
    spark.udtf.register("findings_of", FindingsOf)
