"""Column functions that stay in the JVM: ranges, masks, checks, keyed digests, simple detectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_range(text: Column, start: Column, end: Column) -> Column:
    first = F.octet_length(F.substring(text, F.lit(1), start.cast("int")))
    return F.struct(first.cast("long").alias("start"), (first + F.octet_length(F.substring(text, start.cast("int") + 1, (end - start).cast("int")))).cast("long").alias("end"))


def utf16_range(text: Column, start: Column, end: Column) -> Column:
    units = lambda c: (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")
    first = units(F.substring(text, F.lit(1), start.cast("int")))
    return F.struct(first.alias("start"), (first + units(F.substring(text, start.cast("int") + 1, (end - start).cast("int")))).alias("end"))


def redacted(entity: Column) -> Column:
    return F.concat(F.lit("["), entity, F.lit("]"))


def masked(value: Column, character: str = "*", direction: str | None = None, count: int = 0) -> Column:
    """One mask character per code point; the revealed end never shows the whole value."""
    n = F.length(value)
    shown = F.least(F.lit(count), F.greatest(n - 1, F.lit(0))) if direction else F.lit(0)
    hidden = F.repeat(F.lit(character), n - shown)
    if direction == "first":
        return F.concat(F.substring(value, F.lit(1), shown), hidden)
    return F.concat(hidden, F.substring(value, n - shown + 1, shown))


def hmac_sha256(value: Column, key: bytes) -> Column:
    """Padded base64 of HMAC-SHA-256. The key becomes part of the plan: for tests and public salts only."""
    block = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in block) for x in (0x36, 0x5C))
    text = lambda b: F.lit(bytearray(b))
    first = F.unhex(F.sha2(F.concat(text(inner), F.encode(value, "UTF-8")), 256))
    return F.base64(F.unhex(F.sha2(F.concat(text(outer), first), 256)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def card_valid(value: Column) -> Column:
    d = digits(value)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def date_valid(value: Column) -> Column:
    """Whether an ISO date text is a calendar day of the year 1000 or later."""
    return value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.coalesce(F.try_to_date(value, "yyyy-MM-dd") >= F.lit("1000-01-01").cast("date"), F.lit(False))


#: Detectors whose rule one regular expression states in full, for use without Python.
NATIVE = {
    "SSN": r"(?<![0-9A-Za-z])(?!000|666|9)[0-9]{3}(-?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9A-Za-z])",
    "UUID": r"(?<![0-9A-Za-z_\-])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[1-8][0-9A-Fa-f]{3}-[89ABab][0-9A-Fa-f]{3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z_\-])",
    "IPV4": r"(?<![0-9A-Za-z])(?<![0-9]\.)(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?=[0-9])|(?![0-9A-Za-z.])|(?=\.(?![0-9])))){4}(?<!\.)",
}


def native_findings(text: Column, label: str) -> Column:
    """Matched texts of a NATIVE detector, in order."""
    return F.regexp_extract_all(text, F.lit(NATIVE[label]), 0)


def native_spans(text: Column, label: str) -> Column:
    """(start, end) code point spans of a NATIVE detector, in order."""
    between = F.split(text, NATIVE[label], -1)
    found = native_findings(text, label)
    lengths = F.transform(found, lambda m, i: F.struct(F.length(F.get(between, i)).alias("gap"), F.length(m).alias("n")))
    start = F.array().cast("array<struct<start:long,end:long>>")
    at = lambda done: F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0))
    step = lambda done, x: F.concat(done, F.array(F.struct((at(done) + x["gap"]).cast("long").alias("start"), (at(done) + x["gap"] + x["n"]).cast("long").alias("end"))))
    return F.aggregate(lengths, start, step)
