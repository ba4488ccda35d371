"""Registered queries over whole tables, and the SQL that each has to agree with.

The expected values of detector queries come from the columns that the texts are built of, so
the SQL does not restate a detector's rule.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanAndTransformConfig, ScanConfig, Strategy, TransformConfig, parse_scan, parse_scan_and_transform, parse_transform
from ..functions import columns, sql
from ..kernels.tree import StructuredConfig
from ..operators import algebra, evaluate, models, report, scan, structured, tokens
from ..registry import DETECTORS, VERSION
from ..session import scratch_root, spread, staged
from ..sources.io import stream_documents, write_stream
from ..streaming import restore as streaming
from ..types import FINDING
from ..workspace import aliases as ws
from ..workspace import history, policy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _pad(key: str, n: int, fill: str = "0") -> str:
    return f"lpad(CAST({key} AS STRING), {n}, '{fill}')"


_C, _O = "c_custkey", "o_orderkey"
_MD5 = f"md5(CAST({_C} AS STRING))"
_YMD = [f"lpad(CAST({part}(o_orderdate) AS STRING), {n}, '0')" for part, n in (("year", 4), ("month", 2), ("day", 2))]
#: label: table, key, text before the value, the value, text after it. Spark and DuckDB read these alike.
TEXTS: dict[str, tuple[str, str, str, str, str]] = {
    "EMAIL": ("customer", _C, "'Contact '", f"'user' || CAST({_C} AS STRING) || '@mail' || CAST({_C} % 7 AS STRING) || '.example.com'", "' today.'"),
    "PHONE": ("customer", _C, "'Call '", f"'(' || CAST(200 + {_C} % 700 AS STRING) || ') 555-' || {_pad(f'{_C} % 10000', 4)}", "' now'"),
    "SSN": ("customer", _C, "'SSN '", f"'1' || {_pad(f'{_C} % 100', 2)} || '-' || {_pad(f'1 + {_C} % 99', 2)} || '-' || {_pad(f'1 + {_C} % 9999', 4)}", "', filed'"),
    "DATE": ("orders", _O, "'Ordered on '", f"{_YMD[0]} || '-' || {_YMD[1]} || '-' || {_YMD[2]}", "' at noon'"),
    "ZIP_CODE": ("customer", _C, "'Ship to '", _pad(f"{_C} % 100000", 5), "' please'"),
    "IP_ADDRESS": ("orders", _O, "'from '", f"'10.' || CAST({_O} % 256 AS STRING) || '.' || CAST(o_custkey % 256 AS STRING) || '.7'", "' ok'"),
    "ACCOUNT_NUMBER": ("customer", _C, "'Account number: '", _pad(_C, 10, "7"), "' is open'"),
    "STREET_ADDRESS": ("customer", _C, "'Shipping address: '", f"CAST(1 + {_C} % 9999 AS STRING) || ' Elm Grove Road'", "'; thanks'"),
    "BEARER_TOKEN": ("orders", _O, "'Authorization: Bearer '", f"'t' || CAST({_O} AS STRING) || '.x-1'", "''"),
    "API_KEY": ("customer", _C, "'key '", f"'ghp_' || substr({_MD5} || {_MD5}, 1, 36)", "' end'"),
    "JWT": ("customer", _C, "'jwt '", f"'eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.' || {_MD5}", "' end'"),
    "PRIVATE_KEY": ("customer", _C, "'pem=' || chr(10)", f"'-----BEGIN PRIVATE KEY-----' || chr(10) || {_MD5} || chr(10) || '-----END PRIVATE KEY-----'", "chr(10) || 'end'"),
    "CREDENTIAL_URI": ("customer", _C, "'db '", f"'postgresql://app:' || {_MD5} || '@db' || CAST({_C} AS STRING) || '.example.com:5432/main'", "' end'"),
    "US_ROUTING_NUMBER": ("customer", _C, "'routing number: '", _pad(_C, 9, "1"), "' end'"),
    "NPI": ("customer", _C, "'NPI: '", _pad(_C, 10, "1"), "' end'"),
    "DE_IBAN": ("customer", _C, "'IBAN '", f"'DE' || {_pad(_C, 20, '1')}", "' end'"),
    "DE_VAT_ID": ("customer", _C, "'USt '", f"'DE' || {_pad(_C, 9, '1')}", "' end'"),
    "DE_TAX_ID": ("customer", _C, "'Steuer-ID: '", _pad(_C, 11, "1"), "' end'"),
    "DE_SOCIAL_SECURITY_NUMBER": ("customer", _C, "'RVNR '", f"'12' || {_pad(f'{_C} % 1000000', 6)} || 'M345'", "' end'"),
    "DE_POSTAL_CODE": ("customer", _C, "'Ort '", f"'D-' || {_pad(f'{_C} % 100000', 5)}", "' end'"),
    "DE_PASSPORT_NUMBER": ("customer", _C, "'Passnummer: '", f"'C' || {_pad(_C, 8)}", "' end'"),
    "DE_RESIDENCE_PERMIT_NUMBER": ("customer", _C, "'Aufenthaltstitel '", f"'AT' || {_pad(_C, 7)}", "' end'"),
    "UUID": ("customer", _C, "'id '", f"substr({_MD5}, 1, 8) || '-' || substr({_MD5}, 9, 4) || '-4' || substr({_MD5}, 14, 3) || '-a' || substr({_MD5}, 18, 3) || '-' || substr({_MD5}, 21, 12)", "' end'"),
}


def texts(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """(id, text) with one value of the label in each."""
    name, key, before, value, after = TEXTS[label]
    return table(spark, sf_dir, name).selectExpr(f"{key} AS id", f"{before} || {value} || {after} AS text")


def _label_query(label: str) -> Query:
    config = ScanConfig(locale="de" if DETECTORS[label].activation == "german" else None, detect_uuid=label == "UUID", entities=(label,))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = scan.findings(texts(spark, sf_dir, label), "id", "text", config)
        return found.select("id", "entity_type", "matched_text", F.col("start").alias("start_at"), F.col("end").alias("end_at"))

    return run


for _label, (_table, _key, _before, _value, _after) in TEXTS.items():
    query(
        f"scan_{_label.lower()}",
        f"SELECT {_key} AS id, '{_label}' AS entity_type, {_value} AS matched_text, length({_before}) AS start_at, length({_before}) + length({_value}) AS end_at FROM {_table}",
    )(_label_query(_label))


#: label: an expression of a value much like those of the label, which is none.
_REJECTED = {
    "EMAIL": f"'user' || CAST({_C} AS STRING) || '@mail'",
    "PHONE": f"'(112) 555-' || {_pad(f'{_C} % 10000', 4)}",
    "SSN": f"'000-12-' || {_pad(f'1 + {_C} % 9999', 4)}",
    "DATE": f"{_YMD[0]} || '-02-30'",
    "ZIP_CODE": f"'$' || {_pad(f'{_C} % 100000', 5)}",
    "IP_ADDRESS": f"'10.0.256.' || CAST({_O} % 256 AS STRING)",
    "NPI": _pad(_C, 11, "1"),
    "API_KEY": f"'ghp_' || substr({_MD5}, 1, 30)",
    "CREDENTIAL_URI": f"'postgresql://app@db' || CAST({_C} AS STRING) || '/main'",
    "UUID": f"substr({_MD5}, 1, 8) || '-0000-9000-a000-' || substr({_MD5}, 21, 12)",
}


def _mixed_query(label: str) -> Query:
    name, key, before, value, after = TEXTS[label]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        one = f"CASE WHEN {key} % 3 = 0 THEN {_REJECTED[label]} ELSE {value} END"
        rows = table(spark, sf_dir, name).selectExpr(f"{key} AS id", f"'é ' || {before} || {one} || {after} || ' ü ' || {before} || {value} || ' ' || {_REJECTED[label]} AS text")
        found = scan.findings(rows, "id", "text", ScanConfig(detect_uuid=label == "UUID", entities=(label,)))
        return found.select("id", "matched_text", F.col("start").alias("start_at"))

    return run


for _label, _bad in _REJECTED.items():
    _table, _key, _before, _value, _after = TEXTS[_label]
    _first = f"CASE WHEN {_key} % 3 = 0 THEN {_bad} ELSE {_value} END"
    query(
        f"mixed_{_label.lower()}",
        f"SELECT {_key} AS id, {_value} AS matched_text, 2 + length({_before}) AS start_at FROM {_table} WHERE {_key} % 3 <> 0 "
        f"UNION ALL SELECT {_key}, {_value}, 5 + 2 * length({_before}) + length({_first}) + length({_after}) FROM {_table}",
    )(_mixed_query(_label))


def _luhn_sql(value: str, n: int = 16) -> str:
    digits = [f"CAST(substr({value}, {i + 1}, 1) AS INTEGER)" for i in range(n)]
    return " + ".join(d if (n - i) % 2 else f"(CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)" for i, d in enumerate(digits))


_CARD = f"'4' || {_pad(f'({_O} * 7919 + 104729) % 1000000007', 15)}"


def card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(f"{_O} AS id", f"'paid with ' || {_CARD} || ', thanks' AS text", f"{_CARD} AS card")


@query("scan_credit_card", f"SELECT {_O} AS id, {_CARD} AS matched_text FROM orders WHERE ({_luhn_sql(_CARD)}) % 10 = 0")
def scan_credit_card(spark, sf_dir):
    return scan.findings(card_texts(spark, sf_dir), "id", "text", ScanConfig(entities=("CREDIT_CARD",))).select("id", "matched_text")


@query("card_luhn", f"SELECT ({_luhn_sql(_CARD)}) % 10 = 0 AS valid, count(*) AS n FROM orders GROUP BY 1")
def card_luhn(spark, sf_dir):
    """The native check agrees with the rule."""
    return card_texts(spark, sf_dir).groupBy(columns.card_valid(F.col("card")).alias("valid")).agg(F.count("*").alias("n"))


@query("native_ssn", f"SELECT {_C} AS id, {TEXTS['SSN'][3]} AS matched_text FROM customer")
def native_ssn(spark, sf_dir):
    rows = texts(spark, sf_dir, "SSN")
    return rows.select("id", F.explode(columns.native_findings(F.col("text"), "SSN")).alias("matched_text"))


@query("native_uuid_spans", f"SELECT {_C} AS id, 3 AS start_at, 39 AS end_at FROM customer")
def native_uuid_spans(spark, sf_dir):
    rows = texts(spark, sf_dir, "UUID").select("id", F.explode(columns.native_spans(F.col("text"), "UUID")).alias("s"))
    return rows.select("id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


@query("date_validity", f"SELECT {_O} AS id, true AS valid FROM orders")
def date_validity(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(f"{_O} AS id", f"{TEXTS['DATE'][3]} AS d")
    return rows.select("id", columns.date_valid(F.col("d")).alias("valid"))


@query("range_systems", "SELECT c_custkey AS id, length('Grüße 👋 ') AS start_at, octet_length(encode('Grüße 👋 ')) AS byte_start, length('Grüße 👋 ') + 1 AS utf16_start FROM customer")
def range_systems(spark, sf_dir):
    """Code point, byte and UTF-16 offsets of one finding."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "'Grüße 👋 ' || 'user' || CAST(c_custkey AS STRING) || '@example.com' AS text")
    found = scan.findings(rows, "id", "text", ScanConfig(entities=("EMAIL",))).join(rows, "id")
    return found.select("id", F.col("start").alias("start_at"), "byte_start", columns.utf16_range(F.col("text"), F.col("start"), F.col("end"))["start"].alias("utf16_start"))


_NAMES = [*DETECTORS, "PERSON"]


@query(
    "capabilities",
    "SELECT label, ordinal::INTEGER AS ordinal, CASE label WHEN 'PERSON' THEN 'veilwright/person-field' ELSE 'veilwright/' || replace(lower(label), '_', '-') END AS detector_name, "
    f"'{VERSION}' AS detector_version, CASE WHEN label = 'PERSON' THEN 'structured' WHEN label = 'UUID' THEN 'uuid' WHEN label LIKE 'DE\\_%' ESCAPE '\\' THEN 'german' ELSE 'default' END AS activation, "
    f"label NOT IN ('ACCOUNT_NUMBER', 'STREET_ADDRESS', 'PERSON') AS replaces_model FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {i})' for i, n in enumerate(_NAMES))}) v(label, ordinal)",
)
def capabilities(spark, sf_dir):
    from ..registry import capabilities as rows

    return rows(spark)


_MAIL_SQL = r"len(regexp_extract_all(text, '[A-Za-z0-9.]+@mail[0-9]+\.example\.com'))"


@query("email_counts", f"SELECT doc_id, {_MAIL_SQL} AS n FROM documents WHERE {_MAIL_SQL} > 0")
def email_counts(spark, sf_dir):
    """Counts of each text that has any; texts that share an id have rows of their own."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.size(scan.scan_column(F.col("text"), ScanConfig(entities=("EMAIL",)))).cast("long")
    return rows.select("doc_id", F.explode(F.filter(F.array(n), lambda x: x > 0)).alias("n"))


@query("emails_by_lang_cube", f"SELECT lang, source, sum({_MAIL_SQL})::BIGINT AS n, grouping(lang, source)::BIGINT AS level FROM documents WHERE {_MAIL_SQL} > 0 GROUP BY CUBE (lang, source)")
def emails_by_lang_cube(spark, sf_dir):
    found = scan.findings(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"], "text", ScanConfig(entities=("EMAIL",)))
    return report.cube(found, "lang", "source")


@query("top_documents", f"SELECT doc_id, {_MAIL_SQL} AS n FROM documents WHERE {_MAIL_SQL} > 0 ORDER BY n DESC, doc_id LIMIT 20")
def top_documents(spark, sf_dir):
    return email_counts(spark, sf_dir).orderBy(F.desc("n"), "doc_id").limit(20)


#: What the generated documents and pages hold, by label.
_SHAPES = {
    "EMAIL": r"[A-Za-z0-9.]+@mail[0-9]+\.example\.com",
    "PHONE": r"\+1 \([0-9]{3}\) 555-[0-9]{4}|\b[2-9][0-9]{2}[1-9][0-9]{6}\b",
    "IP_ADDRESS": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
}


#: Sixteen digits of an issuer whose check digit is right. Of two such in a row, the second is read.
_APART = "regexp_replace({0}, '([0-9]{{15}})([0-9]) ([0-9])', '\\1' || chr(1) || '\\2 \\3', 'g')"
_CARDS = (
    "list_filter(regexp_extract_all({0}, '\\b(4|5|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|6011|62|63|64[4-9]|65|6[6-9]|30[0-5]|3[46789]|352[89]|35[3-8])[0-9]*\\b'), lambda c: length(c) = 16 AND "
    "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN coalesce(TRY_CAST(c[i] AS INTEGER), 0) WHEN coalesce(TRY_CAST(c[i] AS INTEGER), 0) > 4 THEN 2 * coalesce(TRY_CAST(c[i] AS INTEGER), 0) - 9 ELSE 2 * coalesce(TRY_CAST(c[i] AS INTEGER), 0) END)) % 10 = 0)"
)


def _found_sql(name: str, key: str, column: str) -> str:
    parts = [f"SELECT {key}, 'CREDIT_CARD' AS entity_type, unnest({_CARDS.format(_APART.format(column))}) AS matched_text FROM {name}"]
    parts += [f"SELECT {key}, '{label}' AS entity_type, unnest(regexp_extract_all({column}, '{shape}')) AS matched_text FROM {name}" for label, shape in _SHAPES.items()]
    return f"WITH f AS ({' UNION ALL '.join(parts)}), by_value AS (SELECT entity_type, matched_text, count(*) AS n FROM f GROUP BY ALL)"


_BY_LABEL = "SELECT entity_type, count(*) AS n, count(DISTINCT {0}) AS n_texts FROM f GROUP BY entity_type"


@query("findings_by_label", f"{_found_sql('documents', 'doc_id', 'text')} {_BY_LABEL.format('doc_id')}")
def findings_by_label(spark, sf_dir):
    return report.by_label(scan.findings(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")


@query(
    "top_values",
    f"{_found_sql('documents', 'doc_id', 'text')} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY n DESC, matched_text) AS rank FROM by_value) WHERE rank <= 5",
)
def top_values(spark, sf_dir):
    return report.top_values(scan.findings(table(spark, sf_dir, "documents"), "doc_id"), 5)


@query("page_findings", f"{_found_sql('pages', 'page_id', 'html')} {_BY_LABEL.format('page_id')}")
def page_findings(spark, sf_dir):
    return report.by_label(scan.findings(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id")


@query("redact_documents", rf"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9.]+@mail[0-9]+\.example\.com', '[EMAIL]', 'g') AS text, {_MAIL_SQL} AS n FROM documents")
def redact_documents(spark, sf_dir):
    config = parse_scan_and_transform({"scan": {"entities": ["EMAIL"]}, "transform": {"default": {"strategy": "redact"}}})
    out = scan.protect(table(spark, sf_dir, "documents"), config)
    return out.select("doc_id", "text", _changes().alias("n"))


def _changes():
    """How many findings a text had; null where there is no text."""
    return F.when(F.col("text").isNotNull(), F.size("transformations")).cast("long")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = ScanAndTransformConfig(TransformConfig(Strategy("redact")))
    out = scan.protect(table(spark, sf_dir, "documents"), config)
    return out.select("doc_id", F.col("text").alias("redacted_text"), _changes().alias("n_findings"))


_REDACTED, _COUNTED = f"replace(list_reduce([{_APART.format('text')}] || list_distinct({_CARDS.format(_APART.format('text'))}), lambda t, c: replace(t, c, '[CREDIT_CARD]')), chr(1), '')", f"len({_CARDS.format(_APART.format('text'))})"
for _label, _shape in _SHAPES.items():
    _REDACTED = f"regexp_replace({_REDACTED}, '{_shape}', '[{_label}]', 'g')"
    _COUNTED += f" + len(regexp_extract_all(text, '{_shape}'))"
query("protect_documents", f"SELECT doc_id, {_REDACTED} AS redacted_text, {_COUNTED} AS n_findings FROM documents")(flagship)

_PHRASE = "the"
_EDGE = r"[^\p{L}\p{N}_]"
_DOUBLED = rf"regexp_replace(text, '({_EDGE})', '\1\1', 'g')"


def _deny(boundary: str, sensitive: bool) -> Query:
    def run(spark, sf_dir):
        config = parse_scan({"entities": ["UUID"], "deny": [{"phrase": _PHRASE, "boundary": boundary, "case_sensitive": sensitive}]})
        found = scan.findings(table(spark, sf_dir, "documents"), "doc_id", "text", config)
        return found.groupBy("doc_id").agg(F.count("*").alias("n"))

    return run


_WORDS = rf"len(regexp_extract_all({_DOUBLED}, '(^|{_EDGE}){_PHRASE}({_EDGE}|$)'))"
query("denylist_word", f"SELECT doc_id, {_WORDS} AS n FROM documents WHERE {_WORDS} > 0")(_deny("word", True))
_PARTS = f"((length(lower(text)) - length(replace(lower(text), '{_PHRASE}', ''))) // {len(_PHRASE)})"
query("denylist_substring", f"SELECT doc_id, {_PARTS} AS n FROM documents WHERE {_PARTS} > 0")(_deny("substring", False))

_BOTH = "'Mail user' || CAST(c_custkey AS STRING) || '@example.com or call (212) 555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || ' soon'"


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{_BOTH} AS text")


def _protected(transform: dict, keys: dict | None = None, scan_config: dict | None = None) -> Query:
    config = parse_scan_and_transform({"transform": transform, **({"scan": scan_config} if scan_config else {"scan": {"entities": ["EMAIL", "PHONE"]}})})

    def run(spark, sf_dir):
        return scan.protect(contacts(spark, sf_dir), config, keys=keys).select("id", "text")

    return run


_DIGITS = "lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')"
_MAIL = "'user' || CAST(c_custkey AS STRING) || '@example.com'"
_PHONE = f"'(212) 555-' || {_DIGITS}"
query("redact", "SELECT c_custkey AS id, 'Mail [EMAIL] or call [PHONE] soon' AS text FROM customer")(_protected({"default": {"strategy": "redact"}}))
query("remove", "SELECT c_custkey AS id, 'Mail  or call  soon' AS text FROM customer")(_protected({"default": {"strategy": "remove"}}))
query("mask_last4", f"SELECT c_custkey AS id, 'Mail ' || repeat('*', length({_MAIL}) - 4) || '.com or call **********' || {_DIGITS} || ' soon' AS text FROM customer")(
    _protected({"default": {"strategy": "mask", "reveal": {"direction": "last", "count": 4}}})
)
query("mask_first2", f"SELECT c_custkey AS id, 'Mail us' || repeat('#', length({_MAIL}) - 2) || ' or call (2############ soon' AS text FROM customer")(
    _protected({"default": {"strategy": "mask", "character": "#", "reveal": {"direction": "first", "count": 2}}})
)
query("entity_override", "SELECT c_custkey AS id, 'Mail [EMAIL] or call  soon' AS text FROM customer")(
    _protected({"default": {"strategy": "redact"}, "overrides": {"PHONE": {"strategy": "remove"}}})
)
query("entity_filter", f"SELECT c_custkey AS id, 'Mail [EMAIL] or call ' || {_PHONE} || ' soon' AS text FROM customer")(
    _protected({"default": {"strategy": "redact"}, "entities": ["EMAIL"]})
)
query("exact_allowlist", f"SELECT c_custkey AS id, 'Mail ' || CASE WHEN c_custkey = 7 THEN {_MAIL} ELSE '[EMAIL]' END || ' or call [PHONE] soon' AS text FROM customer")(
    _protected({"default": {"strategy": "redact"}, "allow": {"exact": {"EMAIL": ["user7@example.com"]}}})
)
query("regex_allowlist", f"SELECT c_custkey AS id, 'Mail ' || CASE WHEN c_custkey % 10 = 3 THEN {_MAIL} ELSE '[EMAIL]' END || ' or call [PHONE] soon' AS text FROM customer")(
    _protected({"default": {"strategy": "redact"}, "allow": {"regex": {"EMAIL": [{"pattern": "USER[0-9]*3@.*", "case_sensitive": False}]}}})
)
query("deny_overrides_filters", f"SELECT c_custkey AS id, 'Mail ' || {_MAIL} || ' [DENYLIST] ' || {_PHONE} || ' soon' AS text FROM customer")(
    _protected({"default": {"strategy": "redact"}, "entities": ["SSN"]}, scan_config={"entities": ["EMAIL"], "deny": [{"phrase": "or call"}]})
)

_KEY = bytes(range(32))
_PADS = ["".join(f"\\x{b ^ x:02X}" for b in _KEY.ljust(64, b"\0")) for x in (0x36, 0x5C)]
_HMAC = f"base64(unhex(sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode({{0}}))))))"
query("pseudonymize", f"SELECT c_custkey AS id, 'Mail ' || {_HMAC.format(_MAIL)} || ' or call ' || {_HMAC.format(_PHONE)} || ' soon' AS text FROM customer")(
    _protected({"default": {"strategy": "pseudonymize", "key_ref": "k"}}, keys={("k", None): ("1", _KEY)})
)


@query("hmac_native", f"SELECT c_custkey AS id, {_HMAC.format(_MAIL)} AS digest FROM customer")
def hmac_native(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{_MAIL} AS v").select("id", columns.hmac_sha256(F.col("v"), _KEY).alias("digest"))


@query(
    "audit_rows",
    f"SELECT c_custkey AS id, 0 AS ord, 'EMAIL' AS entity_type, 5 AS source_start, 5 + length({_MAIL}) AS source_end, 5 AS output_start, 12 AS output_end, '[EMAIL]' AS replacement FROM customer "
    f"UNION ALL SELECT c_custkey, 1, 'PHONE', 14 + length({_MAIL}), 28 + length({_MAIL}), 21, 28, '[PHONE]' FROM customer",
)
def audit_rows(spark, sf_dir):
    config = parse_scan_and_transform({"scan": {"entities": ["EMAIL", "PHONE"]}, "transform": {"default": {"strategy": "redact"}}})
    rows = scan.audit(scan.protect(contacts(spark, sf_dir), config), "id")
    return rows.select("id", "ord", "entity_type", "source_start", "source_end", "output_start", "output_end", "replacement")


@query("transform_given", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '[NAME] wrote' END AS text, CASE WHEN c_custkey % 2 = 1 THEN 'invalid_finding' END AS error_code FROM customer")
def transform_given(spark, sf_dir):
    """Caller-supplied findings; those that do not match their text are set aside."""
    finding = F.struct(
        F.lit("NAME").alias("entity_type"), F.when(F.col("id") % 2 == 0, F.col("name")).otherwise("nobody").alias("matched_text"), F.lit(0).cast("long").alias("start"),
        F.length("name").cast("long").alias("end"), F.lit(None).cast("long").alias("byte_start"), F.lit(None).cast("long").alias("byte_end"),
        F.lit(None).cast("float").alias("confidence"), F.lit("caller").alias("detector_name"), F.lit("1").alias("detector_version"),
    )
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name").withColumns({"text": F.concat("name", F.lit(" wrote")), "findings": F.array(finding)})
    out = scan.transform(rows, parse_transform({"default": {"strategy": "redact"}}), on_error="quarantine")
    return out.select("id", "text", F.col("error.code").alias("error_code"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made of order lines: (key, entity_type, start, end, ...), with many overlaps and repeats."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS key", "CASE WHEN l_returnflag = 'A' THEN 'PERSON' ELSE 'SSN' END AS entity_type", "l_partkey % 50 AS start", "l_partkey % 50 + 1 + l_suppkey % 9 AS end",
        "CAST(l_discount AS FLOAT) AS confidence", "l_linestatus AS detector_name", "CAST(l_linenumber AS STRING) AS detector_version",
    )
    return lines.withColumn("matched_text", F.col("detector_name"))


_SPANS = (
    "SELECT l_orderkey AS key, CASE WHEN l_returnflag = 'A' THEN 'PERSON' ELSE 'SSN' END AS entity_type, l_partkey % 50 AS s, l_partkey % 50 + 1 + l_suppkey % 9 AS e, "
    "CAST(l_discount AS FLOAT) AS confidence, l_linestatus AS detector_name, CAST(l_linenumber AS STRING) AS v FROM lineitem"
)


def _ends(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"start": "start_at", "end": "end_at"})


@query("distinct_spans", f"SELECT DISTINCT key, entity_type, s AS start_at, e AS end_at FROM ({_SPANS})")
def distinct_spans(spark, sf_dir):
    return _ends(algebra.distinct_spans(spans(spark, sf_dir), "key").select("key", "entity_type", "start", "end"))


@query(
    "dup_collapse",
    f"SELECT key, entity_type, s AS start_at, e AS end_at, detector_name, v AS detector_version FROM ({_SPANS}) QUALIFY row_number() OVER (PARTITION BY key, entity_type, s, e ORDER BY confidence DESC, detector_name, v) = 1",
)
def dup_collapse(spark, sf_dir):
    return _ends(algebra.best_duplicates(spans(spark, sf_dir), "key").select("key", "entity_type", "start", "end", "detector_name", "detector_version"))


@query(
    "island_merge",
    f"WITH a AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({_SPANS})), "
    "b AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM a) SELECT key, min(s) AS start_at, max(e) AS end_at, count(*) AS n FROM b GROUP BY key, i",
)
def island_merge(spark, sf_dir):
    return _ends(algebra.islands(spans(spark, sf_dir), "key").select("key", "start", "end", "n"))


@query("ssn_over_person", f"WITH a AS ({_SPANS}) SELECT key, entity_type, s AS start_at, e AS end_at FROM a WHERE entity_type <> 'PERSON' OR NOT EXISTS (SELECT 1 FROM a b WHERE b.key = a.key AND b.s = a.s AND b.e = a.e AND b.entity_type = 'SSN')")
def ssn_over_person(spark, sf_dir):
    return _ends(algebra.drop_person_on_ssn(spans(spark, sf_dir), "key").select("key", "entity_type", "start", "end"))


@query("overlap_semijoin", f"WITH a AS ({_SPANS}) SELECT key, s AS start_at, e AS end_at FROM a WHERE entity_type = 'PERSON' AND EXISTS (SELECT 1 FROM a b WHERE b.key = a.key AND b.entity_type = 'SSN' AND a.s < b.e AND b.s < a.e)")
def overlap_semijoin(spark, sf_dir):
    rows = spans(spark, sf_dir)
    return _ends(algebra.overlapping(rows.where("entity_type = 'PERSON'"), rows.where("entity_type = 'SSN'"), "key").select("key", "start", "end"))


@query(
    "coverage_check",
    f"WITH a AS ({_SPANS}), w AS (SELECT key, s, e FROM a WHERE entity_type = 'SSN'), x AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM w), "
    "y AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM x), z AS (SELECT key, min(s) AS s, max(e) AS e FROM y GROUP BY key, i) "
    "SELECT key, s AS start_at, e AS end_at FROM a WHERE entity_type = 'PERSON' AND NOT EXISTS (SELECT 1 FROM z WHERE z.key = a.key AND z.s <= a.s AND z.e >= a.e)",
)
def coverage_check(spark, sf_dir):
    rows = spans(spark, sf_dir)
    return _ends(algebra.uncovered(rows.where("entity_type = 'PERSON'"), rows.where("entity_type = 'SSN'"), "key").select("key", "start", "end"))


@query("finding_gaps", f"SELECT key, s AS start_at, e AS end_at, entity_type, s - lag(e) OVER (PARTITION BY key ORDER BY s, e, entity_type) AS gap FROM (SELECT DISTINCT key, s, e, entity_type FROM ({_SPANS}))")
def finding_gaps(spark, sf_dir):
    rows = spans(spark, sf_dir).select("key", "start", "end", "entity_type").distinct()
    return _ends(report.gaps(rows, "key"))


_JSON = "'{\"id\":' || CAST(c_custkey AS STRING) || ',\"customer\":{\"firstName\":\"' || c_name || '\",\"note\":\"mail user' || CAST(c_custkey AS STRING) || '@example.com\"},\"tags\":[\"a\",\"' || c_mktsegment || '\"]}'"


def documents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{_JSON} AS data")


@query(
    "structured_leaves",
    "SELECT c_custkey AS id, '/customer/firstName' AS path, c_name AS value FROM customer UNION ALL SELECT c_custkey, '/customer/note', 'mail user' || CAST(c_custkey AS STRING) || '@example.com' FROM customer "
    "UNION ALL SELECT c_custkey, '/tags/0', 'a' FROM customer UNION ALL SELECT c_custkey, '/tags/1', c_mktsegment FROM customer",
)
def structured_leaves(spark, sf_dir):
    return structured.leaves(documents_json(spark, sf_dir), "id", "data").select("id", "path", "value")


@query("structured_person", "SELECT c_custkey AS id, '/customer/firstName' AS path, 'PERSON' AS entity_type, 'field_alias' AS source, 'first_name' AS rule FROM customer")
def structured_person(spark, sf_dir):
    return structured.discover_fields(documents_json(spark, sf_dir), "id", "data")


@query(
    "structured_scan",
    "SELECT c_custkey AS id, '/customer/firstName' AS path, 'PERSON' AS entity_type, c_name AS matched_text FROM customer "
    "UNION ALL SELECT c_custkey, '/customer/note', 'EMAIL', 'user' || CAST(c_custkey AS STRING) || '@example.com' FROM customer",
)
def structured_scan(spark, sf_dir):
    return structured.scan(documents_json(spark, sf_dir), "id", "data").select("id", "path", "entity_type", "matched_text")


@query(
    "structured_redact",
    "SELECT c_custkey AS id, '{\"id\":' || CAST(c_custkey AS STRING) || ',\"customer\":{\"firstName\":\"[PERSON]\",\"note\":\"mail [EMAIL]\"},\"tags\":[\"a\",\"' || c_mktsegment || '\"]}' AS data FROM customer",
)
def structured_redact(spark, sf_dir):
    return structured.protect(documents_json(spark, sf_dir), "data", TransformConfig(Strategy("redact"))).select("id", "data")


@query("structured_exclude", "SELECT c_custkey AS id, '/tags/1' AS path, 'explicit_mapping' AS source FROM customer")
def structured_exclude(spark, sf_dir):
    config = StructuredConfig(mappings=frozenset(["/tags/1"]), exclude=frozenset(["/customer/firstName"]))
    return structured.discover_fields(documents_json(spark, sf_dir), "id", "data", config).select("id", "path", "source")


@query("event_leaves", "SELECT '/event_type' AS path, count(event_type) AS n FROM events UNION ALL SELECT '/props', count(props) FROM events")
def event_leaves(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("data", F.to_json(F.struct("event_type", "props")))
    return structured.leaves(rows, "event_id", "data").groupBy("path").agg(F.count("*").alias("n"))


_TOKENIZE = parse_scan_and_transform({"scan": {"entities": ["EMAIL", "PHONE"]}, "transform": {"default": {"strategy": "tokenize", "token_ref": "vault"}}})


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(tokens.tokenize(contacts(spark, sf_dir), _TOKENIZE, "tenant", _KEY), "tokenized")


@query("token_roundtrip", f"SELECT c_custkey AS id, {_BOTH} AS text, 2 AS n_restored FROM customer")
def token_roundtrip(spark, sf_dir):
    rows = tokenized(spark, sf_dir)
    vault = staged(tokens.vault_rows(rows, "tenant"), "vault")
    return tokens.restore(rows.select("id", "text"), vault, "tenant", "id").select("id", "text", "n_restored")


@query("token_vault", f"SELECT 'tenant' AS scope, 'vault' AS token_ref, {_MAIL} AS value FROM customer UNION SELECT 'tenant', 'vault', {_PHONE} FROM customer")
def token_vault(spark, sf_dir):
    return tokens.vault_rows(tokenized(spark, sf_dir), "tenant").select("scope", "token_ref", "value")


@query("token_missing", "SELECT c_custkey AS id, NULL::VARCHAR AS text, 'token_not_found' AS error_code FROM customer")
def token_missing(spark, sf_dir):
    rows = tokenized(spark, sf_dir)
    vault = tokens.vault_rows(rows, "tenant").where("value like '(%'")
    out = tokens.restore(rows.select("id", "text"), staged(vault, "half-vault"), "tenant", "id", on_error="quarantine")
    return out.select("id", "text", F.col("error.code").alias("error_code"))


@query("token_items", "SELECT c_custkey AS id, 2 AS n FROM customer")
def token_items(spark, sf_dir):
    return tokens.required_items(tokenized(spark, sf_dir), "id").groupBy("id").agg(F.count("*").alias("n"))


class _Reversed:
    """A stand-in for a vault service: payloads are the values, reversed."""

    def tokenize_batch(self, scope, items):
        return [("7", f"{scope}/{value}".encode()[::-1]) for _, value in items]

    def restore_batch(self, scope, items):
        return [payload[::-1].decode().removeprefix(f"{scope}/") for _, _, payload in items]


@query("tokenization_items", f"SELECT c_custkey AS id, 0 AS ord, 'EMAIL' AS entity_type, 'vault' AS token_ref, {_MAIL} AS value FROM customer UNION ALL SELECT c_custkey, 1, 'PHONE', 'vault', {_PHONE} FROM customer")
def tokenization_items(spark, sf_dir):
    return tokens.required_tokenization_items(contacts(spark, sf_dir), _TOKENIZE, "id")


@query("provider_tokens", "SELECT c_custkey AS id, 2 AS n, 'DFTOKENv1' AS begins FROM customer")
def provider_tokens(spark, sf_dir):
    """The tokens that a provider issued stand in the texts."""
    rows = tokens.tokenize_with(contacts(spark, sf_dir), _TOKENIZE, _Reversed(), "tenant", "id")
    return rows.select("id", F.size("transformations").cast("long").alias("n"), F.regexp_extract("text", r"^Mail (DFTOKENv1)\(", 1).alias("begins"))


@query("provider_roundtrip", f"SELECT c_custkey AS id, {_BOTH} AS text, 2 AS n_restored FROM customer")
def provider_roundtrip(spark, sf_dir):
    rows = staged(tokens.tokenize_with(contacts(spark, sf_dir), _TOKENIZE, _Reversed(), "tenant", "id").select("id", "text"), "provided")
    return tokens.restore_with(rows, _Reversed(), "tenant", "id").select("id", "text", "n_restored")


@query("structured_restore", f"SELECT c_custkey AS id, {_JSON} AS data FROM customer")
def structured_restore(spark, sf_dir):
    """Leaves are tokenized and restored."""
    config = TransformConfig(Strategy("tokenize", token_ref="vault"))
    rows = staged(structured.protect(documents_json(spark, sf_dir), "data", config, scope="tenant", token_key=_KEY), "structured-tokens")
    return structured.restore(rows.select("id", "data"), staged(tokens.vault_rows(rows, "tenant"), "vault"), "tenant", "id", "data")


@query("structured_vault", f"SELECT 'vault' AS token_ref, c_name AS value FROM customer UNION SELECT 'vault', {_MAIL} FROM customer")
def structured_vault(spark, sf_dir):
    config = TransformConfig(Strategy("tokenize", token_ref="vault"))
    return tokens.vault_rows(structured.protect(documents_json(spark, sf_dir), "data", config, scope="tenant", token_key=_KEY), "tenant").select("token_ref", "value")


@query(
    "structured_given",
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '{\"id\":' || CAST(c_custkey AS STRING) || ',\"customer\":{\"firstName\":\"' || c_name || '\",\"note\":\"[WORD] ' || "
    + _MAIL + " || '\"},\"tags\":[\"a\",\"' || c_mktsegment || '\"]}' END AS data, CASE WHEN c_custkey % 2 = 1 THEN 'invalid_finding' END AS error_code FROM customer",
)
def structured_given(spark, sf_dir):
    """The caller's findings by path; those that name no leaf are set aside."""
    no = lambda kind: F.lit(None).cast(kind)
    path = F.when(F.col("id") % 2 == 0, "/customer/note").otherwise("/customer/nothing")
    fields = [F.lit("WORD"), F.lit("mail"), F.lit(0).cast("long"), F.lit(4).cast("long"), no("long"), no("long"), no("float"), F.lit("given"), no("string")]
    finding = F.struct(path.alias("path"), *[c.alias(n) for c, n in zip(fields, FINDING.names, strict=True)])
    rows = documents_json(spark, sf_dir).withColumn("found", F.array(finding))
    out = structured.transform_given(rows, "data", "found", TransformConfig(Strategy("redact")), on_error="quarantine")
    return out.select("id", "data", F.col("error.code").alias("error_code"))


_NAMESPACE, _OPERATION = b"\1" * 16, b"\0" * 16


def person_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mentions of each customer's name in an order text, the second in capitals."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.selectExpr("o_orderkey AS id", "'Dear ' || c_name || ', order ' || CAST(o_orderkey AS STRING) || '.' AS text", "'PERSON' AS entity_type", "c_name AS matched_text", "CAST(5 AS BIGINT) AS start", "CAST(5 + length(c_name) AS BIGINT) AS end")


def issued(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], ws.ALIAS_SCHEMA)
    return staged(ws.issue(person_findings(spark, sf_dir).select("entity_type", "matched_text", "id", "start"), none, _NAMESPACE, _OPERATION, ["id", "start"]), "aliases")


@query(
    "alias_assignment",
    "SELECT 'PERSON' AS entity_type, lower(c_name) AS identity, c_name AS display, row_number() OVER (ORDER BY first_id) AS counter FROM (SELECT c_name, min(o_orderkey) AS first_id FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name)",
)
def alias_assignment(spark, sf_dir):
    return issued(spark, sf_dir).select("entity_type", "identity", "display", "counter")


def aliased(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    known, found = issued(spark, sf_dir), person_findings(spark, sf_dir)
    return known, staged(ws.replace_with_aliases(found.select("id", "text"), found.select("id", "entity_type", "matched_text", "start", "end"), known, "id"), "aliased")


@query("restore_markers", "SELECT o_orderkey AS id, 'Dear ' || c_name || ', order ' || CAST(o_orderkey AS STRING) || '.' AS text, 1 AS n_markers FROM orders JOIN customer ON o_custkey = c_custkey")
def restore_markers(spark, sf_dir):
    known, rows = aliased(spark, sf_dir)
    return ws.restore_report(rows, known, "id")[0]


@query(
    "marker_issues",
    "SELECT o_orderkey AS id, kind FROM orders, (VALUES ('unknown', 0), ('damaged', 1), ('unbracketed', 2), ('expired', 3)) k(kind, r) WHERE o_orderkey % 4 = r AND o_custkey IN (SELECT c_custkey FROM customer)",
)
def marker_issues(spark, sf_dir):
    """Each text is damaged in one of four ways before it is restored."""
    known, rows = aliased(spark, sf_dir)
    lost = "regexp_extract(text, '[A-Z0-9]{6}(?=]])', 0)"
    bad = F.expr(
        f"CASE id % 4 WHEN 0 THEN regexp_replace(text, 'PERSON_', 'PLACE_') WHEN 1 THEN regexp_replace(text, '[A-Z0-9]{{6}}]]', 'UUUUUU]]') WHEN 2 THEN regexp_replace(text, '\\\\[\\\\[|]]', '') ELSE concat('Dear [[ORG_', {lost}, ']]') END"
    )
    retired = known.select("code", F.lit("ORG").alias("label"))
    return ws.restore_report(rows.withColumn("text", bad), known, "id", retired=retired)[1].select("id", "kind")


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One send of each alias in conversation 'c'; that of counters divisible by 3 was not observed."""
    rows = ws.with_marker(issued(spark, sf_dir)).select("marker", "counter")
    begin = rows.selectExpr("'c' AS conversation_id", "CAST(counter AS STRING) AS intent_id", "'pending' AS status", "marker", "CAST(0 AS BIGINT) AS seq")
    end = rows.selectExpr("'c' AS conversation_id", "CAST(counter AS STRING) AS intent_id", "CASE WHEN counter % 3 = 0 THEN 'definitely_not_sent' ELSE 'observed_sent' END AS status", "marker", "CAST(1 AS BIGINT) AS seq")
    return begin.unionByName(end)


_NUMBERED = "SELECT c_name, c_custkey, row_number() OVER (ORDER BY min(o_orderkey)) AS counter FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name, c_custkey"


@query("scoped_restore", f"WITH n AS ({_NUMBERED}) SELECT o_orderkey AS id, CASE WHEN counter % 3 = 0 THEN 'not_issued_in_conversation' END AS kind FROM orders JOIN n ON o_custkey = c_custkey")
def scoped_restore(spark, sf_dir):
    known, rows = aliased(spark, sf_dir)
    members = staged(history.memberships(intents(spark, sf_dir)), "memberships")
    restored, issues = ws.restore_report(rows, known, "id", memberships=members, conversation_id="c")
    return restored.join(issues.select("id", "kind"), "id", "left").select("id", "kind")


@query("intent_status", f"WITH n AS ({_NUMBERED}) SELECT CASE WHEN counter % 3 = 0 THEN 'definitely_not_sent' ELSE 'observed_sent' END AS status, count(*) AS n FROM n GROUP BY 1")
def intent_status(spark, sf_dir):
    return history.intent_status(intents(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


def conversations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A conversation of each customer, some without a known site, and a send for each order, resolved by its status."""
    known = table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS STRING) AS conversation_id", "c_mktsegment AS surface", "CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS site_id")
    sends = table(spark, sf_dir, "orders").selectExpr("CAST(o_custkey AS STRING) AS conversation_id", "CAST(o_orderkey AS STRING) AS intent_id", "o_orderstatus", "'m' || CAST(o_orderkey % 5 AS STRING) AS marker")
    begin = sends.selectExpr("conversation_id", "intent_id", "'pending' AS status", "marker", "CAST(0 AS BIGINT) AS seq")
    end = sends.where("o_orderstatus <> 'P'").selectExpr("conversation_id", "intent_id", "CASE o_orderstatus WHEN 'F' THEN 'observed_sent' ELSE 'definitely_not_sent' END AS status", "marker", "CAST(1 AS BIGINT) AS seq")
    return known, begin.unionByName(end)


@query(
    "conversation_states",
    "SELECT CAST(c_custkey AS VARCHAR) AS conversation_id, c_mktsegment AS surface, CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS site_id, count(*) FILTER (o_orderstatus = 'P') AS pending_intents, "
    "count(DISTINCT o_orderkey % 5) FILTER (o_orderstatus = 'F') AS issued_markers FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment, c_name",
)
def conversation_states(spark, sf_dir):
    return history.conversation_states(*conversations(spark, sf_dir))


@query(
    "conversation_sites",
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 10 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS conversation_id, "
    "CASE WHEN c_custkey % 3 = 2 THEN 'invalid_conversation' WHEN c_custkey % 3 = 1 OR c_custkey % 10 = 0 THEN 'conversation_unknown' END AS error FROM customer",
)
def conversation_sites(spark, sf_dir):
    """Sites by their names; some are written in other letters, some not at all."""
    name = "CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN lower(c_name) ELSE '' END AS site_id"
    wanted = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS surface", name)
    return history.conversations_for_sites(wanted, conversations(spark, sf_dir)[0]).select("id", "conversation_id", "error")


@query(
    "send_statuses",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'observed_sent' ELSE 'definitely_not_sent' END AS status, "
    "CASE WHEN o_orderkey % 3 = 0 THEN 'invalid_send_intent' END AS error FROM orders",
)
def send_statuses(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CAST(o_custkey AS STRING) AS conversation_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE CAST(o_orderkey AS STRING) END AS intent_id")
    return history.send_statuses(wanted, conversations(spark, sf_dir)[1]).select("id", "status", "error")


@query("recall", "SELECT c_custkey AS id, n_name AS matched FROM customer JOIN nation ON c_nationkey = n_nationkey")
def recall(spark, sf_dir):
    """Nation names, committed as values, found again in capitals and with other spacing."""
    nations = table(spark, sf_dir, "nation").selectExpr("'PLACE' AS entity_type", "n_name AS display", "'000000' AS code", "CAST(n_nationkey AS BIGINT) AS counter").withColumn("identity", ws.identity_key("display"))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey AS id", "'sold in ' || upper(n_name) || ' (' || c_name || ')' AS text")
    found = ws.recall(rows, nations, "id").join(nations.select("identity", "display"), "identity")
    return found.select("id", F.col("display").alias("matched"))


@query("forget", f"SELECT count(*) AS kept, (SELECT count(*) FROM ({_NUMBERED}) WHERE counter % 2 = 0) AS retired FROM ({_NUMBERED}) WHERE counter % 2 = 1")
def forget(spark, sf_dir):
    known = issued(spark, sf_dir)
    kept, retired = ws.forget(known, spark.createDataFrame([], ws.RETIRED_SCHEMA), known.where("counter % 2 = 0"))
    return kept.agg(F.count("*").alias("kept")).withColumn("k", F.lit(1)).join(retired.agg(F.count("*").alias("retired")).withColumn("k", F.lit(1)), "k").drop("k")


@query(
    "policy",
    "SELECT c_mktsegment AS entity_type, c_name AS matched_text, CASE WHEN c_custkey % 5 = 0 THEN 'not_sensitive' WHEN c_mktsegment = 'BUILDING' THEN 'keep' ELSE 'hide' END AS disposition FROM customer",
)
def policy_query(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    found = rows.select(F.col("c_mktsegment").alias("entity_type"), F.col("c_name").alias("matched_text"))
    rules = rows.where("c_mktsegment = 'BUILDING'").select(F.col("c_mktsegment").alias("entity_type"), F.lit("keep").alias("rule")).distinct()
    choices = rows.where("c_custkey % 5 = 0").select(F.col("c_mktsegment").alias("entity_type"), ws.identity_key("c_name").alias("identity"), F.lit("not_sensitive").alias("disposition"))
    return policy.apply_policy(found, rules, choices).select("entity_type", "matched_text", "disposition")


@query(
    "review_conflicts",
    f"WITH a AS (SELECT DISTINCT key, entity_type, s, e FROM ({_SPANS})) SELECT key, entity_type, s AS start_at, e AS end_at, EXISTS (SELECT 1 FROM a b WHERE b.key = a.key AND "
    "((b.s < a.s AND b.e > a.s AND b.e < a.e) OR (b.s > a.s AND b.s < a.e AND b.e > a.e) OR (b.s = a.s AND b.e = a.e AND b.entity_type <> a.entity_type))) AS conflict FROM a",
)
def review_conflicts(spark, sf_dir):
    rows = spans(spark, sf_dir).select("key", "entity_type", "start", "end")
    out = policy.review(rows, rows.limit(0), rows.limit(0), "key")
    return _ends(out.select("key", "entity_type", "start", "end", "conflict"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS operation_id", "o_orderstatus AS kind", "o_orderkey AS at_ms", "CAST(o_orderkey AS DECIMAL(20,0)) AS revision", "o_custkey AS entities", "CAST(1 AS BIGINT) AS texts", "CASE WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'ok' END AS outcome"
    )


@query("operation_counts", "SELECT o_orderstatus AS kind, count(*) AS operations, sum(o_custkey)::BIGINT AS entities, count(*) AS texts, count(*) FILTER (o_orderkey % 7 = 0) AS failures FROM orders GROUP BY 1")
def operation_counts(spark, sf_dir):
    return history.operation_counts(operations(spark, sf_dir))


@query("operations_page", "SELECT CAST(o_orderkey AS VARCHAR) AS operation_id, o_orderkey AS at_ms FROM orders ORDER BY o_orderkey, 1 LIMIT 50 OFFSET 100")
def operations_page(spark, sf_dir):
    return history.operations_page(operations(spark, sf_dir), 100, 50).select("operation_id", "at_ms")


_GOLD = "SELECT l_orderkey AS key, l_returnflag AS label, l_partkey AS s FROM lineitem WHERE l_suppkey % 5 <> 0"
_FOUND = "SELECT l_orderkey AS key, l_returnflag AS label, l_partkey AS s FROM lineitem WHERE l_suppkey % 7 <> 0"


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS key", "l_returnflag AS label", "l_partkey AS start", "l_partkey + 5 AS end", "l_suppkey")
    return rows.where("l_suppkey % 7 <> 0"), rows.where("l_suppkey % 5 <> 0")


@query(
    "eval_exact",
    f"WITH f AS (SELECT DISTINCT * FROM ({_FOUND})), g AS (SELECT DISTINCT * FROM ({_GOLD})), j AS (SELECT coalesce(f.label, g.label) AS label, f.key IS NOT NULL AS a, g.key IS NOT NULL AS b FROM f FULL JOIN g ON f.key = g.key AND f.label = g.label AND f.s = g.s) "
    "SELECT label, count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND NOT b) AS fp, count(*) FILTER (b AND NOT a) AS fn FROM j GROUP BY label",
)
def eval_exact(spark, sf_dir):
    return evaluate.exact_scores(*_scored(spark, sf_dir), "key").select("label", "tp", "fp", "fn")


@query("eval_overlap")
def eval_overlap(spark, sf_dir):
    return evaluate.overlap_scores(*_scored(spark, sf_dir), "key")


@query(
    "eval_macro",
    f"WITH f AS (SELECT DISTINCT * FROM ({_FOUND})), g AS (SELECT DISTINCT * FROM ({_GOLD})), j AS (SELECT coalesce(f.label, g.label) AS label, f.key IS NOT NULL AS a, g.key IS NOT NULL AS b FROM f FULL JOIN g ON f.key = g.key AND f.label = g.label AND f.s = g.s), "
    "n AS (SELECT label, count(*) FILTER (a AND b) AS tp, count(*) FILTER (a) AS found, count(*) FILTER (b) AS gold FROM j GROUP BY label), "
    "m AS (SELECT avg(CASE WHEN found = 0 THEN 0 ELSE tp / found END) AS precision, avg(tp / gold) AS recall FROM n WHERE gold > 0) SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM m",
)
def eval_macro(spark, sf_dir):
    return evaluate.macro(evaluate.exact_scores(*_scored(spark, sf_dir), "key"))


@query("bench_statistics", "SELECT median(value) AS median, min(value) AS min, max(value) AS max FROM events")
def bench_statistics(spark, sf_dir):
    return evaluate.bench_statistics(table(spark, sf_dir, "events"), "value").select("median", "min", "max")


@query("parity", "SELECT 0 AS n")
def parity(spark, sf_dir):
    """The native and the kernel path find the same."""
    rows = texts(spark, sf_dir, "SSN")
    kernel = scan.findings(rows, "id", "text", ScanConfig(entities=("SSN",))).select("id", "matched_text")
    return evaluate.parity(kernel, native_ssn(spark, sf_dir)).agg(F.count("*").alias("n"))


class _Names:
    """A stand-in for a model: capitalised names, each with a score."""

    def spans(self, texts, labels):
        import re

        for text in texts:
            yield [("name", *m.span(), 0.9) for m in re.finditer(r"Customer#[0-9]+", text)]


@query("model_compose", "SELECT c_custkey AS id, 'PERSON' AS entity_type, c_name AS matched_text FROM customer UNION ALL SELECT c_custkey, 'EMAIL', 'user' || CAST(c_custkey AS VARCHAR) || '@example.com' FROM customer")
def model_compose(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"c_name || ' <' || {_MAIL} || '>' AS text")
    contract = models.ModelContract("names", {"name": "PERSON"}, thresholds={"name": 0.5})
    return models.scan_routed(rows, "id", _Names, contract, entities=["PERSON", "EMAIL"]).select("id", "entity_type", "matched_text")


@query(
    "model_evidence",
    "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'm' WHEN 2 THEN 'm' ELSE 'veilwright/denylist' END AS detector_name, "
    "CASE WHEN c_custkey % 4 = 3 THEN 'm,veilwright/denylist' WHEN c_custkey % 4 = 0 THEN 'a,m' ELSE 'm,z' END AS sources FROM customer",
)
def model_evidence(spark, sf_dir):
    """One span found by a rule and a model: by name where one has no confidence, else by confidence; denied phrases win."""
    kind = F.col("c_custkey") % 4
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(kind == 3, "DENYLIST").otherwise("X").alias("entity_type"), F.lit("x").alias("matched_text"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("end"))
    none = F.lit(None).cast("float")
    rules = rows.withColumns({"confidence": F.when(F.col("id") % 4 == 2, F.lit(0.2).cast("float")).otherwise(none), "detector_name": F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 3, "veilwright/denylist").otherwise("z")})
    model = rows.withColumns({"confidence": F.lit(0.9).cast("float"), "detector_name": F.lit("m")})
    return models.compose(rules, model, "id").select("id", "detector_name", F.concat_ws(",", "sources").alias("sources"))


def _words(text):
    import re

    return [m.span() for m in re.finditer(r"\S+", text)]


def _logits(words):
    """Names look as if they went on, which nothing before them allows; an address begins with a number."""
    import numpy as np

    out = np.zeros((len(words), 5), np.float32)
    for row, word in zip(out, words, strict=True):
        if word.startswith("Customer#"):
            row[:] = 0, 2, 3, 0, 0
        elif word == "12":
            row[:] = 0, 0, 0, 3, 0
        elif word in ("Main", "St,"):
            row[:] = 0, 0, 0, 0, 3
        else:
            row[0] = 3
    return out


def _tagger():
    return models.Tagger(("PERSON", "ADDRESS"), _words, _logits)


@query("model_tagger", "SELECT c_custkey AS id, 'PERSON' AS entity_type, c_name AS matched_text FROM customer UNION ALL SELECT c_custkey, 'ADDRESS', '12 Main St' FROM customer")
def model_tagger(spark, sf_dir):
    """Scores of words become spans by the best legal tags, over texts that are longer than a window."""
    filler = "repeat('so it is said ', CAST(c_custkey % 90 AS INT))"
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).selectExpr("c_custkey AS id", f"{filler} || c_name || ' lives at 12 Main St, they say' AS text")
    contract = models.ModelContract("tagger", {"PERSON": "PERSON", "ADDRESS": "ADDRESS"})
    return models.model_findings(rows, "id", _tagger, contract, ["PERSON", "ADDRESS"]).select("id", "entity_type", "matched_text")


@query("buffered_restore", "SELECT CAST(o_orderkey AS VARCHAR) AS response_id, 'Dear ' || c_name || ', order ' || CAST(o_orderkey AS STRING) || '.' AS text FROM orders JOIN customer ON o_custkey = c_custkey")
def buffered_restore(spark, sf_dir):
    known, rows = aliased(spark, sf_dir)
    return streaming.buffered(chunked(rows), known)[0].select("response_id", "text")


def chunked(rows: DataFrame) -> DataFrame:
    """Each text as pieces of seven bytes."""
    raw = F.encode("text", "UTF-8")
    pieces = rows.select(F.col("id").cast("string").alias("response_id"), raw.alias("raw"), F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / 7).cast("int"))).alias("i"))
    last = F.octet_length("raw") <= (F.col("i") + 1) * 7
    return pieces.select("response_id", F.col("i").cast("long").alias("seq"), F.substring("raw", F.col("i") * 7 + 1, F.lit(7)).alias("chunk"), last.alias("eof"))


def progressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those pieces as a stream, and what was delivered of it."""
    known, rows = aliased(spark, sf_dir)
    base = f"{scratch_root(spark)}/veilwright/stream-{uuid.uuid4().hex}"
    chunked(rows).write.parquet(f"{base}/in")
    out = streaming.progressive(stream_documents(spark, f"{base}/in", streaming.CHUNK_SCHEMA), known)
    write_stream(out, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(streaming.OUTPUT).parquet(f"{base}/out")


@query("progressive_restore", "SELECT CAST(o_orderkey AS VARCHAR) AS response_id, 'Dear ' || c_name || ', order ' || CAST(o_orderkey AS STRING) || '.' AS text FROM orders JOIN customer ON o_custkey = c_custkey")
def progressive_restore(spark, sf_dir):
    """What was delivered for each response, joined in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return progressed(spark, sf_dir).groupBy("response_id").agg(text.alias("text"))


@query(
    "progressive_counters",
    "SELECT CAST(o_orderkey AS VARCHAR) AS response_id, 1 AS markers, n AS bytes, n AS code_points, n AS utf16 FROM (SELECT o_orderkey, length('Dear ' || c_name || ', order ' || CAST(o_orderkey AS STRING) || '.') AS n FROM orders JOIN customer ON o_custkey = c_custkey)",
)
def progressive_counters(spark, sf_dir):
    sums = {"markers": "n_markers", "bytes": "n_bytes", "code_points": "n_code_points", "utf16": "n_utf16"}
    return progressed(spark, sf_dir).groupBy("response_id").agg(*[F.sum(c).alias(name) for name, c in sums.items()])


@query("sql_functions", f"SELECT c_custkey AS id, 'Mail [EMAIL] or call ' || {_PHONE} || ' soon' AS text, 2 AS n FROM customer")
def sql_functions(spark, sf_dir):
    sql.register(spark)
    contacts(spark, sf_dir).createOrReplaceTempView("veilwright_contacts")
    config = '{"scan": {"entities": ["EMAIL"]}, "transform": {"default": {"strategy": "redact"}}}'
    return spark.sql(f"SELECT id, protect_text(text, '{config}').text AS text, CAST(size(scan_text(text)) AS BIGINT) AS n FROM veilwright_contacts")


@query("sql_lateral", f"SELECT c_custkey AS id, 'PHONE' AS entity_type, {_PHONE} AS matched_text FROM customer")
def sql_lateral(spark, sf_dir):
    sql.register(spark)
    contacts(spark, sf_dir).createOrReplaceTempView("veilwright_contacts")
    config = '{"entities": ["PHONE"]}'
    return spark.sql(f"SELECT id, f.entity_type, f.matched_text FROM veilwright_contacts, LATERAL findings_of(text, '{config}') f")
