"""Chat formatting by perspective rotation.

Each participant of a conversation gets a rendering of all of it in which that participant's turns are the
assistant's and learned from, and every other participant's turns are a named user's and masked.  System turns are
nobody's: they are rendered in every perspective, masked.

A rendering is a run of segments, one a turn, each with its character offset, so a conversation of any length is
spread over tasks; concatenating the segments of (conversation, perspective) by offset gives the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modwarden import staging
from modwarden.llm import common

#: The marks around a turn.
OPEN, NAME, BODY, CLOSE = "<|turn|>", " name=", "\n", "<|end|>\n"


def rotated(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system", block_rows: int = 1_000_000) -> DataFrame:
    """conv_id, perspective, turn, speaker, as_role, segment, seg_start, seg_end, learn_start, learn_end.

    learn_start and learn_end bound the characters learned from: the text and closing mark of the perspective's own
    turns, null elsewhere.  A null speaker is a participant named `unknown`; null texts are empty turns.  A null
    turn comes first.  Turns that share a number stand in the order of speaker and of the text's MD5; repeated rows are
    repeated turns.  Rows of a null conversation are one conversation.  A conversation of system turns only has no
    participant and so no rendering; an empty table gives an empty result.  Other columns are left out.

    Each rendering is written once; places are counted on rows without text and joined back by the row's number.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    people = rows.where(F.col("speaker") != system).select(F.col("conv").alias("pconv"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(people, F.col("conv").eqNullSafe(F.col("pconv"))).drop("pconv")
    role = F.when(F.col("speaker") == system, F.lit("system")).when(F.col("speaker") == F.col("perspective"), F.lit("assistant")).otherwise(F.lit("user"))
    seen = seen.withColumn("as_role", role)
    head = F.concat(F.lit(OPEN), F.col("as_role"), F.when(F.col("as_role") == "user", F.concat(F.lit(NAME), F.col("speaker"))).otherwise(F.lit("")), F.lit(BODY))
    seen = seen.withColumns({"segment": F.concat(head, F.col("text"), F.lit(CLOSE)), "__head": F.length(head).cast("long"), "__digest": F.md5(F.col("text").cast("binary")), "__row": F.monotonically_increasing_id()})
    seen = staging.staged(seen.drop("text"))
    short = seen.select("__row", "conv", "perspective", "turn", "speaker", "__digest", F.length("segment").alias("__length"))
    placed = common.running(short, ["conv", "perspective"], "turn", ["speaker", "__digest"], F.col("__length"), "seg_start", block_rows)
    placed = seen.join(placed.select("__row", "seg_start"), "__row")
    own = F.col("as_role") == "assistant"
    end = F.col("seg_start") + F.length("segment")
    return placed.select(
        F.col("conv").alias(conv_col),
        "perspective",
        F.col("turn").alias(turn_col),
        "speaker",
        "as_role",
        "segment",
        "seg_start",
        end.alias("seg_end"),
        F.when(own, F.col("seg_start") + F.col("__head")).alias("learn_start"),
        F.when(own, end).alias("learn_end"),
    )
