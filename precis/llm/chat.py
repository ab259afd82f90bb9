"""Chat formatting from every participant's point of view.

For each participant of a conversation the dialogue is rendered with that speaker as
the assistant and the others as named users; system turns stay system turns. A
rendering is a sequence of segments, one a turn::

    <|im_start|>assistant\\n...text...<|im_end|>\\n
    <|im_start|>user name=NAME\\n...text...<|im_end|>\\n

``segment_start`` and ``segment_end`` are code points in the rendering (segments
joined by position), ``mask_start`` and ``mask_end`` the part to learn from: text and
end mark of the assistant's own turns, null for others.

A rendering is never built in one row, so a conversation of any length is spread over
tasks: offsets are prefix sums in two steps, within blocks of ``TURNS`` turn numbers
and over the blocks' sums. Turns go by number (null last), then role and text; equal
rows are rendered one by one. A null role speaks as ``unknown``, a null text is empty,
a null conversation is one of its own. Marks inside texts are broken (``<|`` becomes
``< |``) and white space in names becomes ``_``. All work is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
UNKNOWN = "unknown"
TURNS = 64


def perspectives(conversations: DataFrame) -> DataFrame:
    """One row a conversation, participant and turn: ``conv_id, participant, position,
    role_tag, segment, segment_start, segment_end, mask_start, mask_end``."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.translate(role, " \t\n\r", "____").alias("speaker"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"),
    )
    people = turns.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("participant")).distinct()
    seen = turns.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("speaker") == F.col("participant")
    tag = F.when(F.col("speaker") == SYSTEM, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.col("speaker")))
    seen = seen.withColumn("role_tag", tag).withColumn("head", F.concat(F.lit("<|im_start|>"), F.col("role_tag"), F.lit("\n")))
    seen = seen.withColumn("segment", F.concat("head", "said", F.lit("<|im_end|>\n"))).withColumn("size", F.length("segment").cast("long"))
    seen = seen.withColumn("block", F.floor(F.col("turn") / TURNS))
    whole = ["conv_id", "participant"]
    order = [F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("said")]
    inner = Window.partitionBy(*whole, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = seen.groupBy(*whole, "block").agg(F.sum("size").alias("all_size"), F.count(F.lit(1)).alias("all_turns"))
    ahead = Window.partitionBy(*whole).orderBy(F.col("block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("_c"), F.col("participant").alias("_p"), F.col("block").alias("_b"),
        F.coalesce(F.sum("all_size").over(ahead), F.lit(0)).alias("size_ahead"), F.coalesce(F.sum("all_turns").over(ahead), F.lit(0)).alias("turns_ahead"),
    )
    seen = seen.withColumn("size_in", F.coalesce(F.sum("size").over(inner), F.lit(0))).withColumn("turns_in", F.count(F.lit(1)).over(inner))
    seen = seen.join(blocks, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("participant") == F.col("_p")) & F.col("block").eqNullSafe(F.col("_b")))
    start = F.col("size_ahead") + F.col("size_in")
    mine = F.col("role_tag") == "assistant"
    return seen.select(
        "conv_id", "participant", (F.col("turns_ahead") + F.col("turns_in") + 1).alias("position"), "role_tag", "segment",
        start.alias("segment_start"), (start + F.col("size")).alias("segment_end"),
        F.when(mine, start + F.length("head")).alias("mask_start"), F.when(mine, start + F.col("size") - 1).alias("mask_end"),
    )


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, translate(coalesce(role, 'unknown'), chr(32) || chr(9) || chr(10) || chr(13), '____') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> 'system'),
s AS (
  SELECT t.*, p.participant,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant' ELSE 'user name=' || speaker END AS role_tag
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
r AS (
  SELECT *, '<|im_start|>' || role_tag || chr(10) || said || '<|im_end|>' || chr(10) AS segment,
         row_number() OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS LAST, speaker, said) AS position FROM s),
o AS (
  SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, participant ORDER BY position) AS stop FROM r)
SELECT conv_id, participant, position, role_tag, segment, (stop - length(segment))::BIGINT AS segment_start, stop::BIGINT AS segment_end,
       CASE WHEN role_tag = 'assistant' THEN (stop - length(segment) + length('<|im_start|>assistant') + 1)::BIGINT END AS mask_start,
       CASE WHEN role_tag = 'assistant' THEN (stop - 1)::BIGINT END AS mask_end
FROM o
"""
