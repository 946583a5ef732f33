"""Chat formatting by multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant, all others as named users, and a mask over the assistant's words. System messages
are instructions of no participant; they stay system messages in each rendering.

A rendering is one text, stored in parts by turn number (``part_turns`` turns each), so that a
conversation of any length is never gathered in one task; rows that repeat a turn go to further
parts, a few copies each. The parts' texts in order of ``offset`` make the dialogue, and masks
count from its beginning, so where it is cut makes no difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def _plain(col: str, missing: str) -> Column:
    return F.replace(F.coalesce(F.col(col).cast("string"), F.lit(missing)), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", part_turns: int = 32, part_copies: int = 4, system: str = "system") -> DataFrame:
    """(conv_id, assistant, part, copies, offset, n_messages, rendered, mask) for every participant and part.

    offset: where the part begins in the whole dialogue. mask: ``start:end`` spans of code points
    in the whole dialogue, comma-joined: the assistant's texts and end marks. ``<|`` in texts and
    names becomes ``< |`` and line ends in names become spaces, so that nobody can forge a
    message. A null speaker is the participant ``unknown``; null texts are empty; a null
    turn is part -1; null conversations are one conversation. A conversation of system messages
    alone has no participant and no row. Messages of equal turn are ordered by speaker and text.
    """
    t = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.translate(_plain(speaker_col, "unknown"), "\r\n", "  ").alias("speaker"),
        _plain(text_col, "").alias("text"),
    )
    people = t.filter(F.col("speaker") != system).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("assistant")).distinct()
    # dealt once by conversation and part, which numbering repeated turns, gathering parts and measuring them share
    t = t.withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long")).repartition("conv_id", "part")
    t = t.withColumn("copy", F.row_number().over(W.partitionBy("conv_id", "part", "turn").orderBy("speaker", "text")) - 1).withColumn("copies", F.floor(F.col("copy") / part_copies).cast("long"))
    key = ["conv_id", "part", "copies"]
    m = t.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("turn", "copy", "speaker", "text"))).alias("m"))  # part_turns * part_copies messages at most
    title = F.when(F.col("speaker") == system, F.lit("system")).otherwise(F.concat(F.lit("user name="), "speaker"))
    size = (F.length(title) + F.length("text") + len(START) + 1 + len(END)).cast("long")
    sizes = t.groupBy(*key).agg(F.sum(size).alias("size"), F.collect_list("speaker").alias("speakers"))
    g = sizes.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.size(F.filter("speakers", lambda x: x == F.col("assistant"))) * (F.length("assistant") + len("user name=") - len("assistant"))
    before = W.partitionBy("conv_id", "assistant").orderBy("part", "copies").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("size") - own).over(before), F.lit(0)).alias("offset")
    g = g.select(*(F.col(c).alias(f"_{c}") for c in key), "assistant", offset)
    g = m.join(g, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("part") == F.col("_part")) & (F.col("copies") == F.col("_copies")))

    def head(x: Column) -> Column:
        name = F.when(x["speaker"] == F.col("assistant"), F.lit("assistant")).when(x["speaker"] == system, F.lit("system"))
        return F.concat(F.lit(START), name.otherwise(F.concat(F.lit("user name="), x["speaker"])), F.lit("\n"))

    def span(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(head(x))
        end = start + F.length(x["text"]) + len(END) - 1
        mask = F.when(x["speaker"] == F.col("assistant"), F.concat(s["mask"], F.lit(","), start.cast("string"), F.lit(":"), end.cast("string")))
        return F.struct((end + 1).alias("at"), mask.otherwise(s["mask"]).alias("mask"))

    spans = F.aggregate("m", F.struct(F.col("offset").alias("at"), F.lit("").alias("mask")), span)
    return g.select(
        "conv_id", "assistant", "part", "copies", "offset", F.size("m").cast("long").alias("n_messages"),
        F.array_join(F.transform("m", lambda x: F.concat(head(x), x["text"], F.lit(END))), "").alias("rendered"),
        F.substring(spans["mask"], 2, 1 << 30).alias("mask"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, seen from each of their participants."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP3_SQL = """
WITH t AS (
  SELECT conv_id, turn, translate(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(13) || chr(10), '  ') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY speaker, text) - 1 AS copy FROM t),
p AS (SELECT DISTINCT conv_id, speaker AS assistant FROM t WHERE speaker <> 'system'),
j AS (
  SELECT n.conv_id, p.assistant, coalesce(CAST(floor(n.turn / 32.0) AS BIGINT), -1) AS part, CAST(floor(n.copy / 4.0) AS BIGINT) AS copies,
         n.turn, n.copy, n.text, n.speaker = p.assistant AS own,
         '<|im_start|>' || CASE WHEN n.speaker = p.assistant THEN 'assistant' WHEN n.speaker = 'system' THEN 'system' ELSE 'user name=' || n.speaker END || chr(10) AS head
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, assistant ORDER BY part, copies, turn NULLS FIRST, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM j)
SELECT conv_id, assistant, part, copies, min(off) AS "offset", count(*)::BIGINT AS n_messages,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, copy) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN (off + length(head)) || ':' || (off + length(head) + length(text) + 10) END, ',' ORDER BY turn NULLS FIRST, copy), '') AS mask
FROM o GROUP BY conv_id, assistant, part, copies
"""
