"""Perspective rotation of dialogues: every participant once as the assistant.

For each participant of a dialogue all turns are rendered in order, that participant's as the assistant's and the
others' as named users'; system turns stay what they are.  The mask of a rendering covers the assistant's own words.
Marks of the rendering that stand in a role or a text are broken by a backslash, so that no turn can open or end another.
Renderings are kept as one row per turn with its offsets, so a dialogue of any length never has to fit in one
task: the whole rendering is the rows' ``rendered`` in the order of ``start``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.operators.positions import with_positions

SYSTEM = "system"
END = "<|end|>\n"
# Rows of a dialogue that are summed in one window; above them only one total per block is.
BLOCK = 4096
_NO_ID = -(1 << 63)


def escaped(text: Column) -> Column:
    """``text`` with ``<|`` and ``|>`` as ``<\\|`` and ``|\\>``."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def header(role: Column, speaker: Column) -> Column:
    return (
        F.when(role == SYSTEM, F.lit("<|system|>\n"))
        .when(role == speaker, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), escaped(role), F.lit("|>\n")))
    )


def rotate(turns: DataFrame) -> DataFrame:
    """Per dialogue, participant and turn: ``conv_id, speaker, turn, role, rendered, start, stop, mask_start, mask_stop``.

    Offsets are code points in the rendering; the mask is null for turns that are not the speaker's.  Turns are in
    order of turn, role and text, null turns first; a null role is the participant ``unknown``; a null text is
    empty; rows with a null dialogue are one dialogue; dialogues of system turns only have no participant and no
    rows; repeated rows are repeated turns.
    """
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(_NO_ID)).alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    placed = with_positions(rows, "conv", "turn", "role", "text", name="place").withColumn("block", F.floor(F.col("place") / BLOCK))
    speakers = placed.where(F.col("role") != SYSTEM).groupBy("conv", F.col("role").alias("speaker")).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    told = placed.join(speakers, "conv")
    head = header(F.col("role"), F.col("speaker"))
    told = told.withColumn("rendered", F.concat(head, escaped(F.col("text")), F.lit(END))).withColumn("size", F.length("rendered").cast("bigint"))
    totals = told.groupBy("conv", "speaker", "block").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("conv", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0))).drop("size")
    inside = Window.partitionBy("conv", "speaker", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, ["conv", "speaker", "block"])
    start = F.col("before") + F.col("within")
    own = F.col("role") == F.col("speaker")
    mask_start = start + F.length(head)
    return told.select(
        F.when(F.col("conv") != _NO_ID, F.col("conv")).alias("conv_id"),
        "speaker",
        "turn",
        "role",
        "rendered",
        start.alias("start"),
        (start + F.col("size")).alias("stop"),
        F.when(own, mask_start).alias("mask_start"),
        F.when(own, mask_start + F.length(escaped(F.col("text")))).alias("mask_stop"),
    )
