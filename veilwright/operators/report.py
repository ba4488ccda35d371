"""Reports over findings: counts, cubes, leaders and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_label(found: DataFrame, key_col: str) -> DataFrame:
    return found.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_distinct(key_col).alias("n_texts"))


def cube(found: DataFrame, *dims: str) -> DataFrame:
    """Counts for every combination of the dimensions; a null stands for all, told apart by ``level``."""
    return found.cube(*dims).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def leaders(found: DataFrame, key_col: str, k: int) -> DataFrame:
    """The ``k`` texts with the most findings; ties by key."""
    return found.groupBy(key_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key_col).limit(k)


def top_values(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values of each label, with their rank; ties by value."""
    rows = found.groupBy("entity_type", "matched_text").agg(F.count("*").alias("n"))
    by = Window.partitionBy("entity_type").orderBy(F.desc("n"), "matched_text")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def gaps(found: DataFrame, key_col: str) -> DataFrame:
    """Each finding with the distance from the end of the one before it in its text."""
    by = Window.partitionBy(key_col).orderBy("start", "end", "entity_type")
    return found.withColumn("gap", F.col("start") - F.lag("end").over(by))


def approximate(found: DataFrame) -> DataFrame:
    return found.groupBy("entity_type").agg(F.approx_count_distinct("matched_text").alias("values"))
