"""JSON documents: leaves, name fields, findings by path, and protection of every string leaf."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types
from ..config import TransformConfig
from ..errors import PrivacyError
from ..kernels import tree
from ..kernels.spans import Policy, Scanner, merge, rewrite, validate
from ..kernels.tree import StructuredConfig
from ..session import spread
from .scan import error_row, finding_of, finding_rows
from .tokens import ISSUED

_S = T.StringType()
MAPPING = T.StructType([T.StructField(n, _S) for n in ("path", "entity_type", "source", "rule")])
PATH_FINDING = T.StructType([T.StructField("path", _S), *types.FINDING.fields])
PATH_CHANGE = T.StructType([T.StructField("path", _S), *types.TRANSFORMATION.fields])
DOCUMENT = T.StructType([T.StructField("data", _S), T.StructField("transformations", T.ArrayType(PATH_CHANGE)), T.StructField("error", types.ERROR), T.StructField("issued", T.ArrayType(ISSUED))])


def _each(schema: T.DataType, make, column: Column) -> Column:
    @F.pandas_udf(schema)
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else make(t))

    return apply(column)


def leaves_column(data: Column) -> Column:
    """The string leaves of each document: (path, key, value)."""
    return _each(T.ArrayType(types.LEAF), lambda t: [(x.path, x.key, x.value) for x in tree.leaves(tree.parse_json(t))], data)


def leaves(df: DataFrame, key_col: str, data_col: str) -> DataFrame:
    return spread(df.select(key_col, data_col)).select(key_col, F.posexplode(leaves_column(F.col(data_col))).alias("ord", "_l")).select(key_col, "ord", "_l.*")


def discover_fields(df: DataFrame, key_col: str, data_col: str, config: StructuredConfig = StructuredConfig()) -> DataFrame:
    """(key, path, entity_type, source, rule) for each field that holds a person's name."""

    def find(text: str) -> list[tuple]:
        return [(x.path, "PERSON", *rule) for x in tree.leaves(tree.parse_json(text)) if (rule := tree.person_rule(x, config))]

    return spread(df.select(key_col, data_col)).select(key_col, F.explode(_each(T.ArrayType(MAPPING), find, F.col(data_col))).alias("_m")).select(key_col, "_m.*")


def scan(df: DataFrame, key_col: str, data_col: str, config: StructuredConfig = StructuredConfig()) -> DataFrame:
    """One row per finding with the JSON pointer of its leaf; offsets are within the leaf."""
    scanner = Scanner.of(config.scan)

    def find(text: str) -> list[tuple]:
        return [(x.path, *row) for x in tree.leaves(tree.parse_json(text)) for row in finding_rows(x.value, tree.scan_leaf(x, config, scanner))]

    return spread(df.select(key_col, data_col)).select(key_col, F.posexplode(_each(T.ArrayType(PATH_FINDING), find, F.col(data_col))).alias("ord", "_f")).select(key_col, "ord", "_f.*")


def protect(
    df: DataFrame, data_col: str, transform: TransformConfig, config: StructuredConfig = StructuredConfig(), keys: dict | None = None, on_error: str = "raise",
    scope: str | None = None, token_key: bytes | None = None, version: str = "1",
) -> DataFrame:
    """``df`` with every string leaf protected, and columns transformations (with path), error and issued.

    With a ``scope`` and a ``token_key``, findings to tokenize get tokens as in
    ``tokens.tokenize``; equal values share one in a document and beyond. ``issued`` holds them
    for ``tokens.vault_rows``.
    """
    scanner, policy = Scanner.of(config.scan), Policy(transform)
    return _rewritten(df, data_col, lambda leaf, _: merge(leaf.value, tree.scan_leaf(leaf, config, scanner), policy), transform, policy, keys, on_error, scope, token_key, version)


def transform_given(
    df: DataFrame, data_col: str, findings_col: str, transform: TransformConfig, keys: dict | None = None, on_error: str = "raise",
    scope: str | None = None, token_key: bytes | None = None, version: str = "1",
) -> DataFrame:
    """Like ``protect``, but of the caller's findings: ``findings_col`` is an array of PATH_FINDING.

    A finding whose path names no string leaf, or that does not describe its leaf, is an error.
    """

    def own(leaf: tree.Leaf, given: dict[str, list]) -> list:
        found = [finding_of(r) for r in given.pop(leaf.path, [])]
        validate(leaf.value, found)
        return found

    return _rewritten(df, data_col, own, transform, Policy(transform), keys, on_error, scope, token_key, version, findings_col)


def _rewritten(df, data_col, find, transform, policy, keys, on_error, scope, token_key, version, findings_col=None) -> DataFrame:
    from .tokens import chosen_findings, issuer

    def one(text: str, found) -> tuple:
        given: dict[str, list] = {}
        for row in found if found is not None else []:
            given.setdefault(row["path"], []).append({n: row[n] for n in types.FINDING.names})
        token, issued = issuer(scope, token_key, version, transform) if scope and token_key else (None, [])

        def change(leaf: tree.Leaf) -> tuple[str, list[dict]]:
            done = rewrite(leaf.value, chosen_findings(leaf.value, find(leaf, given), policy), transform, keys, token)
            return done.text, done.rows

        try:
            data, rows = tree.rewrite_leaves(tree.parse_json(text), change)
            if given:
                raise PrivacyError("invalid_finding", "invalid_value", "/" + "path")
            return tree.dump(data), [(path, *(r[n] for n in types.TRANSFORMATION.names)) for path, r in rows], None, list(dict.fromkeys(issued))
        except PrivacyError as error:
            if on_error == "raise":
                raise
            return None, None, error_row(error), []

    @F.pandas_udf(DOCUMENT)
    def apply(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None, None) if t is None else one(t, f) for t, f in zip(texts, found, strict=True)], columns=DOCUMENT.names, dtype=object)

    given = F.col(findings_col) if findings_col else F.lit(None).cast(T.ArrayType(PATH_FINDING))
    rows = spread(df).withColumn("_p", apply(F.col(data_col), given))
    return rows.withColumns({data_col: F.col("_p.data")} | {c: F.col(f"_p.{c}") for c in DOCUMENT.names[1:]}).drop("_p")


def restore(df: DataFrame, vault: DataFrame, scope: str, key_col: str, data_col: str) -> DataFrame:
    """``df`` with the tokens of all string leaves restored; a document is restored whole or is an error.

    Leaves are restored as rows and put back by path.
    """
    from .tokens import restore as restore_text

    rows = leaves(df, key_col, data_col).withColumn("_id", F.to_json(F.struct(F.col(key_col), F.col("path"))))
    done = restore_text(rows.select("_id", F.col(key_col), "path", F.col("value").alias("text")), vault, scope, "_id")
    back = done.where("n_restored > 0").groupBy(key_col).agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("_v"))

    @F.pandas_udf(_S)
    def put(texts: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([t if v is None else tree.dump(tree.replaced(tree.parse_json(t), dict(v))) for t, v in zip(texts, values, strict=True)], dtype=object)

    return df.join(back, key_col, "left").withColumn(data_col, put(F.col(data_col), F.col("_v"))).drop("_v")
