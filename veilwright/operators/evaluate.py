"""Scores of findings against gold spans, gates against a baseline, and bench statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = ["label", "start", "end"]


def _with_rates(counts: DataFrame) -> DataFrame:
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    rows = counts.withColumns({"precision": p, "recall": r})
    return rows.withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def exact_scores(found: DataFrame, gold: DataFrame, key_col: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of exact spans; rates are null where undefined."""
    key = [key_col, *SPAN]
    a = found.select(*key).distinct().withColumn("_f", F.lit(1))
    b = gold.select(*key).distinct().withColumn("_g", F.lit(1))
    f, g = F.col("_f").isNotNull(), F.col("_g").isNotNull()
    return _with_rates(a.join(b, key, "full").groupBy("label").agg(F.count_if(f & g).alias("tp"), F.count_if(f & ~g).alias("fp"), F.count_if(g & ~f).alias("fn")))


def macro(scores: DataFrame) -> DataFrame:
    """(precision, recall, f1) averaged over labels where defined; f1 from the averages."""
    row = scores.where("tp + fn > 0").agg(F.avg(F.coalesce("precision", F.lit(0.0))).alias("precision"), F.avg("recall").alias("recall"))
    return row.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def matched(left: list[tuple[int, int]], right: list[tuple[int, int]]) -> int:
    """Size of a largest one-to-one matching of overlapping spans, by augmenting paths."""
    taken: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for j, (s, e) in enumerate(right):
            if j not in seen and s < left[i][1] and left[i][0] < e:
                seen.add(j)
                if j not in taken or place(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(left)))


def overlap_scores(found: DataFrame, gold: DataFrame, key_col: str) -> DataFrame:
    """Like exact_scores, but a finding may match any gold span of its label that it overlaps, one to one.

    Spans that overlap one other at most are matched by a join; only texts where a span has
    several partners are matched group by group.
    """
    key = [key_col, *SPAN]
    a, b = found.select(*key).distinct(), gold.select(*key).distinct()
    right = b.toDF("_k", "_l", "_s", "_e")
    pairs = a.join(right, (F.col(key_col) == F.col("_k")) & (F.col("label") == F.col("_l")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")))
    ends = pairs.select(key_col, "label", F.array(F.struct(F.lit(True).alias("f"), F.col("start").alias("s"), F.col("end").alias("e")), F.struct(F.lit(False).alias("f"), F.col("_s").alias("s"), F.col("_e").alias("e"))).alias("x"))
    dense = ends.select(key_col, "label", F.explode("x").alias("x")).groupBy(key_col, "label", "x").count().where("count > 1").select(key_col, "label").distinct()
    simple = pairs.join(dense, [key_col, "label"], "left_anti").groupBy("label").agg(F.count("*").alias("tp"))
    rows = a.withColumn("_f", F.lit(True)).unionByName(b.withColumn("_f", F.lit(False))).join(dense, [key_col, "label"], "left_semi")

    def match(group: pd.DataFrame) -> pd.DataFrame:
        sides = ([tuple(x) for x in group[group["_f"] == side][["start", "end"]].sort_values(["start", "end"]).values.tolist()] for side in (True, False))
        return pd.DataFrame([(group["label"].iloc[0], matched(*sides))], columns=["label", "tp"])

    hits = rows.groupBy(key_col, "label").applyInPandas(match, "label string, tp long").unionByName(simple).groupBy("label").agg(F.sum("tp").alias("tp"))
    totals = a.groupBy("label").agg(F.count("*").alias("a")).join(b.groupBy("label").agg(F.count("*").alias("b")), "label", "full").join(hits, "label", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return _with_rates(totals.select("label", n("tp").alias("tp"), (n("a") - n("tp")).alias("fp"), (n("b") - n("tp")).alias("fn")))


def gate(scores: DataFrame, baseline: DataFrame, points: float = 0.0) -> DataFrame:
    """(label, metric, before, now, verdict): fail where precision or recall fell, or f1 fell by over ``points``."""
    stacked = lambda df, name: df.selectExpr("label", f"stack(3, 'precision', precision, 'recall', recall, 'f1', f1) as (metric, {name})")
    rows = stacked(baseline, "before").join(stacked(scores, "now"), ["label", "metric"], "left")
    slack = F.when(F.col("metric") == "f1", F.lit(points)).otherwise(F.lit(0.0))
    worse = F.coalesce(F.col("now"), F.lit(0.0)) < F.col("before") - slack
    return rows.withColumn("verdict", F.when(F.col("before").isNull(), "new").when(worse, "fail").otherwise("ok"))


def bench_statistics(runs: DataFrame, value: str = "mib_per_s") -> DataFrame:
    """(median, mean, min, max, stddev, cv) of repeated runs."""
    v = F.col(value)
    return runs.agg(F.median(v).alias("median"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev(v).alias("stddev"), F.try_divide(F.stddev(v), F.avg(v)).alias("cv"))


def bench_gate(now: float, before: float) -> str:
    """fail over 10 % slower, warn over 5 %, improved over 5 % faster."""
    change = (now - before) / before
    return "fail" if change < -0.10 else "warn" if change < -0.05 else "improved" if change > 0.05 else "ok"


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side; empty if both agree, repeats counted."""
    columns = sorted(left.columns)
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
