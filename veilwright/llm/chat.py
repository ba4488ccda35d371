"""Preference formatting: the common prompt of two conversations once, and both completions masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Who speaks in the turns that a model learns from.
TRAINED = "assistant"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _mask(turns: Column, trained: str) -> Column:
    """Spans of code points in the rendered turns that count for the loss: text and end mark of trained turns."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        head = F.length(turn["role"]) + 5
        end = done["at"] + F.length(_rendered(turn))
        span = F.struct((done["at"] + head).cast("long").alias("start"), (end - 1).cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(turn["role"] == trained, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(turns, begin, step)["spans"]


def preference_pairs(turns: DataFrame, pairs: DataFrame, trained: str = TRAINED) -> DataFrame:
    """Training records for (pair_id, chosen_id, rejected_id) rows over (conv_id, turn, role, text) rows.

    The prompt is the longest common prefix of turns, compared by role and text, rendered once;
    what follows in each conversation is its completion, with the spans of the trained role's
    turns as its mask. Returns pair_id, chosen_id, rejected_id, n_prefix, prompt, chosen,
    rejected, chosen_mask, rejected_mask, usable; a pair is usable if both masks hold a span.

    Turns are ordered by number (null first), then role, then text, so ties and repeated rows
    have one order. A null role or text is empty. A conversation without turns gives an empty
    completion; turns of no pair, and pairs with a null id, are left out. Equal conversations
    have empty completions. Only the named columns are read. A conversation is one record and
    so has to fit a task; conversations that share turns are never brought together.
    """
    ids = pairs.where("pair_id is not null and chosen_id is not null and rejected_id is not null")
    sides = ids.select("pair_id", F.col("chosen_id").alias("conv_id"), F.lit(0).alias("side")).union(ids.select("pair_id", F.col("rejected_id"), F.lit(1)))
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    spoken = sides.join(said, "conv_id").groupBy("pair_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == i, F.struct("turn", "role", "text")))).alias(name) for i, name in ((0, "c"), (1, "r"))])
    rows = ids.join(spoken, "pair_id", "left")
    for name in ("c", "r"):
        rows = rows.withColumn(name, F.coalesce(F.transform(name, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.array().cast("array<struct<role:string,text:string>>")))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce(x == y, F.lit(False)))
    miss = F.array_position(same, False)
    rows = rows.withColumn("n_prefix", F.when(miss > 0, miss - 1).otherwise(F.size("c")).cast("int"))
    rest = lambda name: F.slice(name, F.col("n_prefix") + 1, F.greatest(F.size(name) - F.col("n_prefix"), F.lit(0)))
    show = lambda turns: F.array_join(F.transform(turns, _rendered), "")
    rows = rows.withColumns({"prompt": show(F.slice("c", 1, F.col("n_prefix"))), "c": rest("c"), "r": rest("r")})
    rows = rows.withColumns({"chosen": show(F.col("c")), "rejected": show(F.col("r")), "chosen_mask": _mask(F.col("c"), trained), "rejected_mask": _mask(F.col("r"), trained)})
    usable = (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0)
    return rows.select("pair_id", "chosen_id", "rejected_id", "n_prefix", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask", usable.alias("usable"))


#: The pairs of conversations 2k (chosen) and 2k + 1 (rejected) of ``conversations``, masks as text.
CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT a.conv_id // 2 AS pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id
  FROM (SELECT DISTINCT conv_id FROM t WHERE conv_id % 2 = 0) a JOIN (SELECT DISTINCT conv_id FROM t WHERE conv_id % 2 = 1) b ON b.conv_id = a.conv_id + 1
), j AS (
  SELECT p.pair_id, coalesce(c.pos, r.pos) AS pos, coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM p JOIN t c ON c.conv_id = p.chosen_id LEFT JOIN t r ON r.conv_id = p.rejected_id AND r.pos = c.pos
), n AS (
  SELECT p.pair_id, chosen_id, rejected_id, coalesce((SELECT min(pos) - 1 FROM j WHERE j.pair_id = p.pair_id AND NOT same), (SELECT count(*) FROM t WHERE conv_id = chosen_id)) AS n_prefix FROM p
), s AS (
  SELECT pair_id, 0 AS side, pos, n_prefix, role, text FROM n JOIN t ON conv_id = chosen_id
  UNION ALL SELECT pair_id, 1, pos, n_prefix, role, text FROM n JOIN t ON conv_id = rejected_id
), v AS (
  SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM s
), o AS (
  SELECT *, coalesce(sum(CASE WHEN pos > n_prefix THEN length(shown) END) OVER (PARTITION BY pair_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM v
), g AS (
  SELECT pair_id,
    coalesce(string_agg(CASE WHEN side = 0 AND pos <= n_prefix THEN shown END, '' ORDER BY pos), '') AS prompt,
    coalesce(string_agg(CASE WHEN side = 0 AND pos > n_prefix THEN shown END, '' ORDER BY pos), '') AS chosen,
    coalesce(string_agg(CASE WHEN side = 1 AND pos > n_prefix THEN shown END, '' ORDER BY pos), '') AS rejected,
    coalesce(string_agg(CASE WHEN side = 0 AND pos > n_prefix AND role = 'assistant' THEN (begins + length(role) + 5)::BIGINT || '-' || (begins + length(shown) - 1)::BIGINT END, ',' ORDER BY pos), '') AS chosen_mask,
    coalesce(string_agg(CASE WHEN side = 1 AND pos > n_prefix AND role = 'assistant' THEN (begins + length(role) + 5)::BIGINT || '-' || (begins + length(shown) - 1)::BIGINT END, ',' ORDER BY pos), '') AS rejected_mask
  FROM o GROUP BY pair_id
)
SELECT pair_id, chosen_id, rejected_id, n_prefix::INTEGER AS n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask, chosen_mask <> '' AND rejected_mask <> '' AS usable
FROM n JOIN g USING (pair_id)
"""
