"""Chat formatting by perspective rotation.

Every participant of a conversation gets a rendering of the whole dialogue in which they are the assistant and all others
are users with names; system turns stay system turns. The rendering comes turn by turn, each with its place in the
rendered text and the part of it that counts for the loss, which is the assistant's text.

No task holds a whole conversation: turns are dealt in order to ranges, places are summed within a range and shifted by
the totals of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import written

SYSTEM, NOBODY = "system", "unknown"


def plain(text: Column) -> Column:
    """Text that cannot be taken for a header."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def header(speaker: Column, perspective: Column) -> Column:
    name = F.translate(speaker, "<>|\n\r", "_____")
    return (
        F.when(speaker == SYSTEM, F.lit("<|system|>\n"))
        .when(speaker == perspective, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    )


def rotations(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
) -> DataFrame:
    """(conversation, perspective, position, turn, speaker, rendered, start, end, loss_start, loss_end).

    One row for each turn and each participant of its conversation (speakers other than `system`), position from 0. start
    and end are places of the rendered turn in the perspective's rendered dialogue, in code points; loss_start and
    loss_end those of the text to be learned, equal to end on turns of others. Turns are in order of turn (null first),
    then speaker, then a hash of the text; equal rows are all kept. A null speaker is `unknown`, a null text is empty. A
    null conversation is one conversation. Conversations of system turns only have no perspective. Other columns are
    ignored.
    """
    order = ["turn", "speaker", "tie"]
    rows = turns.select(
        F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.coalesce(speaker, F.lit(NOBODY)).alias("speaker"),
        plain(F.col(text)).alias("text"), F.xxhash64(text).alias("tie"),
    )
    rows = written(rows.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()), "turns")
    people = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv").alias("of"), F.col("speaker").alias("perspective")).distinct()
    head = header(F.col("speaker"), F.col("perspective"))
    rotated = (
        rows.join(people, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("head", F.length(head)).withColumn("rendered", F.concat(head, "text", F.lit("\n")))
        .withColumn("size", F.length("rendered").cast("long"))
    )
    # Numbered and summed within a range of turns, then shifted by the ranges before.
    within = Window.partitionBy("conv", "perspective", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("p_conv", "p_perspective").orderBy("p_part").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    parts = rotated.groupBy(*[F.col(c).alias(f"p_{c}") for c in ("conv", "perspective", "part")]).agg(F.sum("size").alias("sizes"), F.count(F.lit(1)).alias("rows"))
    shifts = parts.select(
        "p_conv", "p_perspective", "p_part", F.coalesce(F.sum("sizes").over(earlier), none).alias("size_before"),
        F.coalesce(F.sum("rows").over(earlier), none).alias("rows_before"),
    )
    placed = rotated.withColumn("at", F.coalesce(F.sum("size").over(within), none)).withColumn("number", F.count(F.lit(1)).over(within))
    equal = F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("perspective") == F.col("p_perspective")) & (F.col("part") == F.col("p_part"))
    start = F.col("at") + F.col("size_before")
    end = start + F.col("size")
    loss = F.when(F.col("speaker") == F.col("perspective"), start + F.col("head")).otherwise(end)
    return placed.join(shifts, equal).select(
        F.col("conv").alias(conversation), "perspective", (F.col("number") + F.col("rows_before")).alias("position"), F.col("turn").alias(turn),
        F.col("speaker").alias("speaker"), "rendered", start.alias("start"), end.alias("end"), loss.alias("loss_start"), end.alias("loss_end"),
    )
