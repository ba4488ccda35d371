"""Review and policy: which findings are hidden, what users corrected, which claims conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aliases import identity_key


def apply_policy(found: DataFrame, rules: DataFrame, choices: DataFrame, default: str = "hide") -> DataFrame:
    """``found`` with a column disposition: the value's choice, else its type's rule, else ``default``.

    ``rules`` has (entity_type, rule: hide or keep); ``choices`` has (entity_type, identity,
    disposition: keep or not_sensitive). A null resets to the next weaker source.
    """
    named = found.withColumn("identity", identity_key("matched_text"))
    small = choices.select("entity_type", "identity", F.col("disposition").alias("_c"))
    rows = named.join(small, ["entity_type", "identity"], "left").join(rules.select("entity_type", F.col("rule").alias("_r")), "entity_type", "left")
    return rows.withColumn("disposition", F.coalesce("_c", "_r", F.lit(default))).drop("_c", "_r")


def edit(table: DataFrame, edits: DataFrame, key: list[str], value: str) -> DataFrame:
    """``table`` after ``edits`` by key; a null value removes the row."""
    return table.join(edits.select(*key), key, "left_anti").unionByName(edits.where(F.col(value).isNotNull()).select(*table.columns))


def review(scanner: DataFrame, user: DataFrame, recalled: DataFrame, key_col: str) -> DataFrame:
    """One row per (key, start, end, entity_type) with the sorted sources that claim it and its conflict state.

    Inputs have (key, entity_type, start, end). A row conflicts if another claim of the same text
    partly overlaps it, or covers the same range under another type; ranges that contain one
    another do not conflict. A user's claim settles a conflict of types.
    """
    sides = [df.select(key_col, "entity_type", "start", "end", F.lit(name).alias("source")) for df, name in ((scanner, "scanner"), (user, "user"), (recalled, "recall"))]
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2])
    rows = rows.groupBy(key_col, "start", "end", "entity_type").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    other = rows.select(F.col(key_col).alias("_k"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("entity_type").alias("t"), F.array_contains("sources", "user").alias("u"))
    cross = "(s < start and e > start and e < end) or (s > start and s < end and e > end)"
    types = "s = start and e = end and t <> entity_type and u = array_contains(sources, 'user')"
    hit = rows.join(other, (F.col(key_col) == F.col("_k")) & F.expr(f"({cross}) or ({types})"), "left_semi").select(key_col, "start", "end", "entity_type", F.lit(True).alias("_x"))
    candidate = F.sha2(F.concat_ws("\x00", F.col(key_col).cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), "entity_type"), 256)
    return rows.join(hit, [key_col, "start", "end", "entity_type"], "left").select(*rows.columns, F.coalesce("_x", F.lit(False)).alias("conflict"), candidate.alias("candidate_key"))
