"""Set operations on tables of findings (key, entity_type, start, end, ...), without Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_spans(found: DataFrame, key_col: str) -> DataFrame:
    return found.dropDuplicates([key_col, "entity_type", "start", "end"])


def keep_entities(found: DataFrame, entities: list[str]) -> DataFrame:
    return found.where(F.col("entity_type").isin(entities) | (F.col("entity_type") == "DENYLIST"))


def without_allowed(found: DataFrame, allowed: DataFrame) -> DataFrame:
    """Findings whose (entity_type, matched_text) is not in ``allowed`` (entity_type, value); denied phrases stay."""
    rows = allowed.select("entity_type", F.col("value").alias("matched_text")).distinct().where("entity_type <> 'DENYLIST'")
    return found.join(rows, ["entity_type", "matched_text"], "left_anti")


def without_matching(found: DataFrame, entity: str, pattern: str, case_sensitive: bool = True) -> DataFrame:
    """Findings of ``entity`` that ``pattern`` matches in full are left out."""
    full = ("" if case_sensitive else "(?i)") + rf"\A(?:{pattern})\z"
    return found.where((F.col("entity_type") != entity) | ~F.col("matched_text").rlike(full))


def drop_person_on_ssn(found: DataFrame, key_col: str) -> DataFrame:
    social = found.where("entity_type = 'SSN'").select(key_col, "start", "end", F.lit("PERSON").alias("entity_type")).distinct()
    return found.join(social, [key_col, "start", "end", "entity_type"], "left_anti")


def best_duplicates(found: DataFrame, key_col: str) -> DataFrame:
    """One row per (key, entity_type, start, end) of findings that all have, or all lack, a confidence: surest, then first by name."""
    order = F.struct(F.coalesce(-F.col("confidence"), F.lit(0.0).cast("float")).alias("c"), F.col("detector_name"), F.coalesce("detector_version", F.lit("")).alias("v"))
    rest = [c for c in found.columns if c not in (key_col, "entity_type", "start", "end")]
    out = found.groupBy(key_col, "entity_type", "start", "end").agg(F.min_by(F.struct(*rest), order).alias("_b"))
    return out.select(key_col, "entity_type", "start", "end", "_b.*")


def _runs(rows: DataFrame, key_col: str, touching: bool) -> DataFrame:
    """``rows`` with ``_i``, the number of the run of overlapping (or also touching) ranges that each is in."""
    by = Window.partitionBy(key_col).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("start") > reach if touching else F.col("start") >= reach
    return rows.withColumn("_new", F.coalesce(new.cast("int"), F.lit(1))).withColumn("_i", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))


def islands(found: DataFrame, key_col: str) -> DataFrame:
    """Maximal runs of overlapping findings: (key, start, end, n, entity_type), named by the longest, then first, finding."""
    best = F.min_by("entity_type", F.struct((F.col("start") - F.col("end")).alias("l"), "start", "entity_type"))
    return _runs(found, key_col, False).groupBy(key_col, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), best.alias("entity_type")).drop("_i")


def uncovered(required: DataFrame, selected: DataFrame, key_col: str) -> DataFrame:
    """Required ranges that no run of adjoining selected ranges contains."""
    runs = _runs(selected, key_col, True).groupBy(F.col(key_col).alias("_k"), "_i").agg(F.min("start").alias("_s"), F.max("end").alias("_e"))
    return required.join(runs, (F.col(key_col) == F.col("_k")) & (F.col("_s") <= F.col("start")) & (F.col("_e") >= F.col("end")), "left_anti")


def overlapping(left: DataFrame, right: DataFrame, key_col: str) -> DataFrame:
    """Rows of ``left`` that share a code point with a row of ``right``."""
    other = right.select(F.col(key_col).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return left.join(other, (F.col(key_col) == F.col("_k")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_semi")
