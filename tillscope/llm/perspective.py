"""Rotate a dialogue of several speakers into one training view per speaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: speakers that direct the dialogue and never take the assistant's place
DIRECTORS = ("system",)
#: name of a speaker that is null
NOBODY = "unknown"


def _plain(text: Column) -> Column:
    """Text that cannot open or close a turn of its own."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def perspective_rotation(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    directors: tuple[str, ...] = DIRECTORS,
) -> DataFrame:
    """Every turn once per participant of its conversation, rendered for that view.

    Columns: conv_id, perspective, turn, speaker, chat_role, segment, mask_start,
    mask_end. ``chat_role`` is assistant for the participant's own turns, system for a
    director's, user otherwise; users carry their name. A view's dialogue is its
    segments in order of turn. [mask_start, mask_end) are the code points of the
    segment to train on: an assistant's text and its end mark; 0, 0 elsewhere.

    A row stays a row, so a conversation of any length, even one with a third of all
    turns, is never gathered: the participants, one row per conversation and speaker,
    are added up before they move, and the join with the turns can be split.
    A null text is an empty one, a null speaker is called unknown, null conversations
    form one conversation, repeated turns repeat, other columns are dropped. A
    conversation of directors only has no view. "<|" in a text or name becomes "< |".
    """
    said = turns.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit(NOBODY)).alias("speaker"),
        _plain(F.col(text)).alias("body"),
    )
    people = (
        said.where(~F.col("speaker").isin(*directors))
        .select(F.col("conv_id").alias("__conv"), F.col("speaker").alias("perspective"))
        .distinct()
    )
    seen = said.join(people, said["conv_id"].eqNullSafe(people["__conv"]))
    own = F.col("speaker") == F.col("perspective")
    role = (
        F.when(F.col("speaker").isin(*directors), "system").when(own, "assistant").otherwise("user")
    )
    name = F.replace(_plain(F.col("speaker")), F.lit("\n"), F.lit(" "))
    named = F.when(F.col("chat_role") == "user", F.concat(F.lit(" name="), name)).otherwise("")
    head = F.concat(F.lit(OPEN), F.col("chat_role"), named, F.lit("\n"))
    learn = F.col("chat_role") == "assistant"
    stop = F.length("head") + F.length("body") + len(CLOSE)
    return (
        seen.withColumn("chat_role", role)
        .withColumn("head", head)
        .select(
            "conv_id",
            "perspective",
            "turn",
            "speaker",
            "chat_role",
            F.concat("head", "body", F.lit(f"{CLOSE}\n")).alias("segment"),
            F.when(learn, F.length("head")).otherwise(0).cast("bigint").alias("mask_start"),
            F.when(learn, stop).otherwise(0).cast("bigint").alias("mask_end"),
        )
    )
