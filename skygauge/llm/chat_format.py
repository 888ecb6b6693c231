"""Chat formatting by perspective rotation, in DataFrame operations only.

Every participant of a dialogue becomes the assistant once: the dialogue is rendered from that speaker's
perspective, the others speak as named users, and only the speaker's own words are trained on. System messages
are instructions, not participants; they keep their place in every rendering and are never trained on.

A rendering is delivered as one row per message and perspective, already marked up, with the span of characters
to train on. Joining `segment` in the order (turn null last, role, text) gives the whole rendering, so a dialogue
of any length never has to meet in one row or task.

    <|system|>...<|end|>   <|assistant|>...<|end|>   <|user name=alice|>...<|end|>

Defined cases: a null role speaks as `unknown`; a null text is an empty message; rows with a null conversation form
one dialogue of their own; repeated rows are repeated messages; a dialogue of system messages only is rendered once
with a null perspective and trains nothing; marker text inside messages is escaped, so that a message cannot forge
a turn; an empty table gives an empty result. Further columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM_ROLES = ("system",)
UNKNOWN = "unknown"
END = "<|end|>"


def _escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def rotate(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    system_roles: tuple[str, ...] = SYSTEM_ROLES,
) -> DataFrame:
    """Rows `conv_id, perspective, turn, speaker, chat_role, segment, train, train_from, train_to`.

    `train_from` and `train_to` are character offsets in `segment` (0-based, end exclusive), equal if not trained.
    """
    said = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(UNKNOWN)).alias("speaker"),
        _escaped(F.coalesce(F.col(text), F.lit(""))).alias("words"),
    )
    is_system = F.col("speaker").isin(*system_roles)
    # one row a speaker, combined before the shuffle
    speakers = (
        said.where(~is_system)
        .groupBy(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .drop("_n")
    )
    own = F.col("perspective").eqNullSafe(F.col("speaker"))
    chat_role = F.when(is_system, "system").when(own, "assistant").otherwise("user")
    name = F.replace(F.replace(_escaped(F.col("speaker")), F.lit("|>"), F.lit("\\|>")), F.lit("\n"), F.lit(" "))
    opening = (
        F.when(F.col("chat_role") == "user", F.concat(F.lit("<|user name="), name, F.lit("|>")))
        .otherwise(F.concat(F.lit("<|"), F.col("chat_role"), F.lit("|>")))
    )
    start = F.char_length("opening").cast("long")
    # the end marker is trained too: the assistant has to learn where to stop
    end = start + F.char_length("words") + F.lit(len(END))
    return (
        said.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
        .withColumn("chat_role", chat_role)
        .withColumn("opening", opening)
        .select(
            "conv_id",
            "perspective",
            "turn",
            "speaker",
            "chat_role",
            F.concat("opening", "words", F.lit(END)).alias("segment"),
            (F.col("chat_role") == "assistant").alias("train"),
            start.alias("train_from"),
            F.when(F.col("chat_role") == "assistant", end).otherwise(start).alias("train_to"),
        )
    )
