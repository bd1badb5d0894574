"""Chat formatting by perspective rotation, in DataFrame operations only.

Every participant of a conversation gets a rendering of the whole dialogue in which that speaker is the assistant and
all others are named users; system turns stay system turns and have no perspective of their own. The result has one
row per conversation, perspective and turn: a dialogue of any length stays spread over many rows, and no conversation
is gathered into one task. Concatenating `segment` by `turn` gives the dialogue.

Only the perspective's own words are training targets: `target_start` and `target_end` are the code points of the
segment that count (text and end mark), equal for every other segment.

The format's own marks inside names and bodies are written with a backslash (`<\\|im_end|>`), so no text can end a turn
or begin another one.

Defined cases: a null or blank role is the speaker `unknown`; a null text is empty; a row without a conversation is one
by itself; repeated rows and equal turn numbers stay separate segments; very long texts are one segment; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SYSTEM, UNKNOWN = "<|im_start|>", "<|im_end|>", "system", "unknown"


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<\\|im_"))


def _speaker(role: Column) -> Column:
    trimmed = _plain(F.trim(role))
    return F.when(trimmed.isNull() | (trimmed == ""), F.lit(UNKNOWN)).otherwise(trimmed)


def rotate_perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, turn, speaker, role, segment, is_target, target_start, target_end."""
    said = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), _speaker(F.col(role)).alias("speaker"), _plain(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    cast = said.where(F.col("conv_id").isNotNull() & (F.col("speaker") != SYSTEM)).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    alone = said.where(F.col("conv_id").isNull() & (F.col("speaker") != SYSTEM)).withColumn("perspective", F.col("speaker"))
    own = F.col("speaker") == F.col("perspective")
    shown = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    head = F.concat(F.lit(START), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(""), F.lit("\n"))
    return (
        said.join(cast, F.col("conv_id") == F.col("of"))
        .select(*said.columns, "perspective")
        .unionByName(alone)
        .select("conv_id", "perspective", "turn", "speaker", shown.alias("role"), "body", own.alias("is_target"))
        .withColumn("head", head)
        .select(
            "conv_id",
            "perspective",
            "turn",
            "speaker",
            "role",
            F.concat("head", "body", F.lit(f"{END}\n")).alias("segment"),
            "is_target",
            F.length("head").cast("long").alias("target_start"),
            (F.length("head") + F.when(F.col("is_target"), F.length("body") + len(END)).otherwise(0)).cast("long").alias("target_end"),
        )
    )


def perspective_totals(segments: DataFrame) -> DataFrame:
    """Segments, code points and target code points of each rendering; sums are combined before the shuffle."""
    return segments.groupBy("conv_id", "perspective").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.sum(F.length("segment")).alias("n_chars"),
        F.sum(F.col("target_end") - F.col("target_start")).alias("n_target_chars"),
    )


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, CASE WHEN role IS NULL OR trim(role) = '' THEN 'unknown' ELSE replace(trim(role), '<|im_', '<\|im_') END AS speaker, replace(coalesce(text, ''), '<|im_', '<\|im_') AS body
  FROM conversations
), speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system' AND conv_id IS NOT NULL),
paired AS (
  SELECT said.*, perspective FROM said JOIN speakers USING (conv_id)
  UNION ALL SELECT *, speaker FROM said WHERE conv_id IS NULL AND speaker <> 'system'
), shown AS (
  SELECT conv_id, perspective, turn, speaker, body, speaker = perspective AS is_target,
    CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM paired
), headed AS (
  SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM shown
)
SELECT conv_id, perspective, turn, speaker, role, head || body || '<|im_end|>' || chr(10) AS segment, is_target,
  CAST(length(head) AS BIGINT) AS target_start,
  CAST(length(head) + CASE WHEN is_target THEN length(body) + 10 ELSE 0 END AS BIGINT) AS target_end
FROM headed
"""
