"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered with that speaker as `assistant`, all
others as named users, and `system` turns as they are. The result has a row for each message of each
rendering, in order, so that no conversation has to fit into one row or one task; joined in `turn` order
the segments are the rendered dialogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"
#: What a label can't hold, in the order of replacement, and what stands for it.
ESCAPED = {"%": "%25", "<": "%3C", " ": "%20", "\t": "%09", "\n": "%0A", "\x0b": "%0B", "\x0c": "%0C", "\r": "%0D"}


def rotate(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, perspective, turn, role, name, segment, mask_start, mask_end, trained).

    perspective: the participant who speaks as assistant; role is system, assistant or user; name is the
    speaker's label for users, else null. segment is `<|im_start|>role[ name=...]\\n` + text + `<|im_end|>\\n`;
    characters [mask_start, mask_end) of it (text and `<|im_end|>`) are learned in assistant turns, none
    (0, 0) in others. A mark `<|im_start|>` or `<|im_end|>` in a text gets a space before its last bar, so that no text
    can end its own turn (removal could join what stands around a mark into another one).

    Speakers are the exact values of role; labels keep different roles apart: `%`, `<` and white space are written as
    `%25`, `%3C`, `%20` and so on, a null role is `%unknown`, an empty one `%empty`. Only the role `system` is the system.
    Null text is empty; null conv_ids are one conversation. Repeated rows are repeated; equal turns keep equal
    numbers. Conversations with system turns only have no participants and no rows; an empty table gives none. Dialogues
    and texts may be of any length. Other columns are ignored.
    """
    speaker = F.col("role").cast("string")
    for c, code in ESCAPED.items():
        speaker = F.replace(speaker, F.lit(c), F.lit(code))
    speaker = F.when(F.col("role").isNull(), "%unknown").when(F.col("role") == "", "%empty").otherwise(speaker)
    rows = conversations.select(
        "conv_id",
        "turn",
        speaker.alias("speaker"),
        F.regexp_replace(F.coalesce("text", F.lit("")), "<\\|im_(start|end)\\|>", "<|im_$1 |>").alias("said"),
    )
    # A few names for each conversation, aggregated before the shuffle; a conversation with very many turns
    # is split by the skewed-join rule.
    people = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("of")))
    role = (
        F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    )
    seen = seen.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    seen = seen.withColumn("head", F.concat(F.lit("<|im_start|>"), "role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n")))
    trained = F.col("role") == "assistant"
    return seen.select(
        "conv_id",
        "perspective",
        "turn",
        "role",
        "name",
        F.concat("head", "said", F.lit("<|im_end|>\n")).alias("segment"),
        F.when(trained, F.length("head")).otherwise(0).cast("long").alias("mask_start"),
        F.when(trained, F.length("head") + F.length("said") + len("<|im_end|>")).otherwise(0).cast("long").alias("mask_end"),
        trained.alias("trained"),
    )
