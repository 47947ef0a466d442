"""Multi-party perspective rotation: the dialogue is rendered once for every participant, with that
speaker as the assistant and all others as named users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rotate_perspectives(turns: DataFrame, context_roles: tuple[str, ...] = ("system",),
                        conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                        text_col: str = "text") -> DataFrame:
    """One row for each turn and perspective: ``(conv_id, perspective, turn, speaker, chat_role, name,
    content, segment, prefix_chars, mask_chars, trained)``.

    A conversation has a perspective for each distinct speaker (``role``) that is neither null,
    empty nor in ``context_roles``.  Seen from it, that speaker's turns have chat role
    ``assistant`` and are trained on; every other speaker's turns, those of context roles apart, are
    of a ``user`` with the speaker's name; turns of context roles stay what they are; turns
    without a speaker (null or empty) are of a user named ``unknown``.  ``segment`` is the turn as
    rendered; the loss mask covers ``mask_chars`` characters of it after the first
    ``prefix_chars``: for trained turns the text and the end mark, else none.  The segments of a
    perspective in order of (turn, speaker, content) make up its dialogue; they are rows and never
    collected, so a conversation of any length is spread like any other rows.

    A null text is rendered as an empty one.  Conversations without a speaker have no perspective
    and give no row.  Rows with a null ``conv_id`` form one conversation.  Repeated turns are all
    kept.  Names keep letters, digits, ``_`` and ``-``; other characters become ``_``.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("speaker"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("content"))
    context = F.col("speaker").isin(*context_roles) if context_roles else F.lit(False)
    people = (rows.where(~context & (F.col("speaker") != ""))
              .select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct())
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))
    own = F.col("speaker") == F.col("perspective")
    chat_role = F.when(own, "assistant").when(context, F.col("speaker")).otherwise("user")
    name = F.when(~own & ~context, F.when(F.col("speaker") == "", F.lit("unknown")).otherwise(
        F.regexp_replace("speaker", r"[^\p{L}\p{N}_-]", "_")))
    prefix = F.concat(F.lit("<|im_start|>"), "chat_role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")),
                      F.lit("\n"))
    body = F.concat("content", F.lit("<|im_end|>"))
    return (seen.withColumns({"chat_role": chat_role, "name": name, "trained": own})
            .select("conv_id", "perspective", "turn", "speaker", "chat_role", "name", "content",
                    F.concat(prefix, body, F.lit("\n")).alias("segment"),
                    F.length(prefix).alias("prefix_chars"),
                    F.when(F.col("trained"), F.length(body)).otherwise(0).alias("mask_chars"), "trained"))


ROTATION_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS speaker, coalesce(text, '') AS content FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM rows WHERE speaker NOT IN ('system', '')),
seen AS (
  SELECT r.*, p.perspective, r.speaker = p.perspective AS trained,
    CASE WHEN r.speaker = p.perspective THEN 'assistant' WHEN r.speaker = 'system' THEN 'system'
         ELSE 'user' END AS chat_role,
    CASE WHEN r.speaker = p.perspective OR r.speaker = 'system' THEN NULL WHEN r.speaker = '' THEN 'unknown'
         ELSE regexp_replace(r.speaker, '[^\p{L}\p{N}_-]', '_', 'g') END AS name
  FROM rows r JOIN people p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
headed AS (
  SELECT *, '<|im_start|>' || chat_role || coalesce(' name=' || name, '') || chr(10) AS head,
         content || '<|im_end|>' AS body FROM seen)
SELECT conv_id, perspective, turn, speaker, chat_role, name, content, head || body || chr(10) AS segment,
       length(head)::INTEGER AS prefix_chars, (CASE WHEN trained THEN length(body) ELSE 0 END)::INTEGER AS mask_chars,
       trained
FROM headed"""
