"""Column types of findings, audit rows and restorations."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_S, _L, _F = T.StringType(), T.LongType(), T.FloatType()

FINDING = _struct(
    ("entity_type", _S), ("matched_text", _S), ("start", _L), ("end", _L), ("byte_start", _L), ("byte_end", _L),
    ("confidence", _F), ("detector_name", _S), ("detector_version", _S),
)
TRANSFORMATION = _struct(
    ("entity_type", _S), ("source_start", _L), ("source_end", _L), ("source_byte_start", _L), ("source_byte_end", _L),
    ("output_start", _L), ("output_end", _L), ("output_byte_start", _L), ("output_byte_end", _L), ("confidence", _F), ("detector_name", _S),
    ("detector_version", _S), ("strategy", _S), ("replacement", _S), ("key_ref", _S), ("key_version", _S), ("token_ref", _S), ("token_version", _S),
)
ERROR = _struct(("code", _S), ("reason", _S), ("path", _S), ("finding_index", _L))
PROTECTED = _struct(("text", _S), ("transformations", T.ArrayType(TRANSFORMATION)), ("error", ERROR))
TOKEN = _struct(("envelope", _S), ("token_ref", _S), ("version", _S), ("payload", T.BinaryType()), ("start", _L), ("end", _L))
PARSED = _struct(("tokens", T.ArrayType(TOKEN)), ("error", ERROR))
LEAF = _struct(("path", _S), ("key", _S), ("value", _S))
