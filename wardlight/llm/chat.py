"""Perspective rotation of dialogues: each participant in turn is the assistant.

For every speaker of a conversation the whole dialogue is rendered once: that speaker's
turns are the assistant's and carry the loss, all others are users under their names,
and system turns stay as they are and carry none.  A row is one rendered turn with its
place in the rendered dialogue and the span of it that the loss covers (the text and the
end mark), so a dialogue of any length needs no row or task of its own: joining the rows
of a perspective by ``start`` gives its text.

Places are running sums in two steps, over slices of ``SLICE`` turn numbers and then
within a slice, so a very long conversation is no single task.

Defined results: a null or empty role is the speaker ``unknown``; a null text is empty;
an opening mark inside a text or name gets a blank; a conversation of system turns alone
has no perspective and no rows; equal rows follow each other; null conv_ids are one
conversation, null turns come first; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wardlight.llm.tables import query, table

SLICE = 64
OPEN, END = "<|im_start|>", "<|im_end|>"


def _safe(text):
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, rendered, start, loss_start, loss_end (null without loss)."""
    role = F.coalesce(F.nullif("role", F.lit("")), F.lit("unknown"))
    rows = turns.select("conv_id", "turn", role.alias("speaker"), _safe(F.coalesce("text", F.lit(""))).alias("body"))
    seats = (rows.filter("speaker <> 'system'").groupBy("conv_id", "speaker").agg(F.count("*").alias("own_turns"))
             .select(F.col("conv_id").alias("seat_conv"), F.col("speaker").alias("perspective")))
    turned = rows.join(seats, F.col("conv_id").eqNullSafe(F.col("seat_conv"))).drop("seat_conv")
    name = _safe(F.regexp_replace("speaker", r"[\r\n]+", " "))
    head = F.concat(F.lit(OPEN), F.when(F.col("speaker") == "system", "system")
                    .when(F.col("speaker") == F.col("perspective"), "assistant")
                    .otherwise(F.concat(F.lit("user name="), name)), F.lit("\n"))
    shown = (turned.withColumn("head", head)
             .withColumn("rendered", F.concat("head", "body", F.lit(END + "\n")))
             .withColumn("slice", F.floor(F.col("turn") / SLICE)))
    in_slice = Window.partitionBy("conv_id", "perspective", "slice").orderBy(
        "turn", "speaker", "body").rowsBetween(Window.unboundedPreceding, -1)
    sums = shown.groupBy("conv_id", "perspective", "slice").agg(F.sum(F.length("rendered")).alias("size"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("slice").alias("s"),
                       F.coalesce(F.sum("size").over(before), F.lit(0)).alias("earlier"))
    placed = shown.withColumn("here", F.coalesce(F.sum(F.length("rendered")).over(in_slice), F.lit(0)))
    placed = placed.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p"))
                         & F.col("slice").eqNullSafe(F.col("s")))
    start = F.col("earlier") + F.col("here")
    own = F.col("speaker") == F.col("perspective")
    return placed.select("conv_id", "perspective", "turn", "speaker", "rendered", start.alias("start"),
                         F.when(own, start + F.length("head")).alias("loss_start"),
                         F.when(own, start + F.length("head") + F.length("body") + len(END)).alias("loss_end"))


_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker,
    replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
h AS (SELECT t.*, p.perspective, '{OPEN}' || CASE WHEN speaker = 'system' THEN 'system'
      WHEN speaker = perspective THEN 'assistant'
      ELSE 'user name=' || replace(regexp_replace(speaker, '[\r\n]+', ' ', 'g'), '<|', '< |') END || chr(10) AS head
    FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
r AS (SELECT *, head || body || '{END}' || chr(10) AS rendered FROM h),
s AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective
      ORDER BY turn NULLS FIRST, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r)
SELECT conv_id, perspective, turn, speaker, rendered, start,
  CASE WHEN speaker = perspective THEN start + length(head) END AS loss_start,
  CASE WHEN speaker = perspective THEN start + length(head) + length(body) + {len(END)} END AS loss_end FROM s"""


@query("op8_perspective_rotation", _SQL)
def op8(spark, folder):
    return perspectives(table(spark, folder, "conversations"))
