"""Conversation capture sources: prompt events, transcripts, SDK chat logs and
the turn expander.  All are column transformations over event tables, batch or streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classify import ASSISTANT_EVENT, USER_EVENT, envelope
from ..functions.text import flatten_content, is_blank, strip_context, strip_ws
from .records import uuid_like

# Fixed tag lists of the capture hooks.
PROMPT_HOOK_TAGS = ["prompt", "claude-code", "realtime"]
STOP_HOOK_TAGS = ["response", "claude-code"]

PROMPT_EVENT_SCHEMA = T.StructType(
    [T.StructField("prompt", T.StringType()), T.StructField("session_id", T.StringType()), T.StructField("cwd", T.StringType())]
)

# message.content is a string or a list of blocks: a VARIANT keeps which of them it was.
TRANSCRIPT_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("sessionId", T.StringType()),
        T.StructField(
            "message",
            T.StructType([T.StructField("content", T.VariantType()), T.StructField("stop_reason", T.StringType())]),
        ),
    ]
)


def _lit_array(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def prompt_events_to_entries(events: DataFrame) -> DataFrame:
    """``(prompt, session_id, cwd)`` events -> entries.  Context tags are stripped, empty
    prompts dropped, missing fields become '' (as the hook reads them), and the prompt is
    wrapped in a ``UserPromptSubmit`` envelope with the hook's three tags."""
    p = strip_context(F.coalesce(F.col("prompt"), F.lit("")))
    df = events.withColumn("_p", p).where(F.length("_p") > 0)
    text = envelope(USER_EVENT, F.col("_p"), F.coalesce(F.col("session_id"), F.lit("")), F.coalesce(F.col("cwd"), F.lit("")))
    return df.select(text.alias("text"), _lit_array(PROMPT_HOOK_TAGS).alias("tags"))


def transcript_turns(lines: DataFrame, key: Column | str | None = None, line_col: str | None = None) -> DataFrame:
    """Transcript JSONL rows -> kept turns ``(transcript, line, role, ts, text)``.

    Users with non-blank text and assistants with ``stop_reason = 'end_turn'`` and non-blank
    text are kept; text is flattened (C4) and stripped.  ``key`` names the transcript
    (default: the source file path); ``line_col`` the file order (default: the row order
    within the file, which the reader keeps)."""
    k = F.col("_metadata.file_path") if key is None else (F.col(key) if isinstance(key, str) else key)
    df = lines.select(
        k.alias("transcript"),
        (F.col(line_col) if line_col else F.monotonically_increasing_id()).alias("line"),
        F.col("type").alias("role"),
        F.coalesce(F.col("timestamp"), F.lit("")).alias("ts"),
        strip_ws(flatten_content(F.col("message.content"))).alias("text"),
        F.col("message.stop_reason").alias("stop_reason"),
    )
    keep = ((F.col("role") == "user") & ~is_blank("text")) | (
        (F.col("role") == "assistant") & (F.col("stop_reason") == "end_turn") & ~is_blank("text")
    )
    return df.where(F.coalesce(keep, F.lit(False))).drop("stop_reason")


def stop_events_to_entries(events: DataFrame, turns: DataFrame) -> DataFrame:
    """Stop events ``(stop_hook_active, transcript_path, session_id, cwd)`` and the kept ``turns`` of their
    transcripts (see :func:`transcript_turns`) -> one entry for each event: the transcript's last
    assistant turn in a ``Stop`` envelope with the hook's tags, and the prompt it answers.

    Events that are sent while a stop hook runs, name no transcript, or whose transcript keeps no assistant
    turn give none.  The prompt is the last user turn of the whole transcript that is not later than
    the answer (any, if the answer has no time), else ''.  Each transcript is reduced by partial
    aggregates; of equal lines the greatest (ts, text) counts.  Null fields become ''.
    Output: ``session_id, text, tags, prompt``."""
    last = (turns.where("role = 'assistant'").groupBy("transcript")
            .agg(F.max(F.struct("line", "ts", "text")).alias("a")))
    users = turns.where("role = 'user'").select(F.col("transcript").alias("_t"), "line", "ts", "text")
    answered = (last.join(users, F.col("transcript") == F.col("_t"), "left")
                .groupBy("transcript", F.col("a.text").alias("response"))
                .agg(F.max(F.when((F.col("a.ts") == "") | (F.col("ts") <= F.col("a.ts")), F.struct("line", "ts", "text")))["text"]
                     .alias("prompt")))
    wanted = events.where(~F.coalesce("stop_hook_active", F.lit(False)) & (F.col("transcript_path") != "")).select(
        F.col("transcript_path").alias("_path"), F.coalesce("session_id", F.lit("")).alias("session_id"),
        F.coalesce("cwd", F.lit("")).alias("cwd"))
    joined = wanted.join(answered, F.col("_path") == F.col("transcript"))
    return joined.select("session_id", envelope(ASSISTANT_EVENT, F.col("response"), F.col("session_id"), F.col("cwd")).alias("text"),
                         _lit_array(STOP_HOOK_TAGS).alias("tags"), F.coalesce("prompt", F.lit("")).alias("prompt"))


def chat_log_prompt(messages: Column | str, shape: str = "openai") -> Column:
    """S8 prompt: the last ``role = 'user'`` message.  ``content`` is a VARIANT holding a
    string, which is kept, or a block list.  OpenAI shape keeps the JSON text of a non-string content;
    Anthropic shape joins its text blocks with newlines."""
    m = F.col(messages) if isinstance(messages, str) else messages
    last_user = F.element_at(F.filter(m, lambda x: x["role"] == "user"), -1)
    content = last_user["content"]
    if shape == "anthropic":
        return F.coalesce(flatten_content(content), F.lit(""))
    string = F.schema_of_variant(content) == "STRING"
    return F.coalesce(F.when(string, F.try_variant_get(content, "$", "string")).otherwise(F.to_json(content)), F.lit(""))


def chat_log_response_openai(choices: Column | str) -> Column:
    """S8 response, OpenAI shape: first choice's message content or ''."""
    c = F.col(choices) if isinstance(choices, str) else choices
    return F.coalesce(F.element_at(c, 1)["message"]["content"], F.lit(""))


def chat_log_response_anthropic(blocks: Column | str) -> Column:
    """S8 response, Anthropic shape: the ``text`` of every block that has one, concatenated."""
    b = F.col(blocks) if isinstance(blocks, str) else blocks
    return F.array_join(F.filter(F.transform(b, lambda x: x["text"]), lambda t: t.isNotNull()), "")


def expand_turns(
    pairs: DataFrame,
    prompt: str = "prompt",
    response: str = "response",
    session_id: str | None = "session_id",
    tags: str | None = "tags",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One (prompt, response, session?, tags?) row -> two entries: the prompt envelope with
    tags ``['prompt'] + tags`` and the response envelope with ``['response'] + tags``.
    A missing session gets a uuid of the pair and its row: the ``keep`` columns, which are to name it, or
    without them the row's place in the input.  So equal exchanges stay sessions of their own.
    Output: ``*keep, pos (0 prompt / 1 response), text, tags``."""
    sid = F.col(session_id) if session_id and session_id in pairs.columns else F.lit(None).cast("string")
    extra = F.coalesce(F.col(tags), F.array().cast("array<string>")) if tags and tags in pairs.columns else F.array().cast("array<string>")
    row = [F.col(k).cast("string") for k in keep] or [F.monotonically_increasing_id().cast("string")]
    gen = uuid_like(F.col(prompt), F.col(response), *row, salt="session")
    base = pairs.select(*keep, F.col(prompt).alias("_p"), F.col(response).alias("_r"), F.coalesce(sid, gen).alias("_s"), extra.alias("_t"))
    two = F.array(
        F.struct(F.lit(0).alias("pos"), envelope(USER_EVENT, F.col("_p"), F.col("_s")).alias("text"),
                 F.concat(F.array(F.lit("prompt")), F.col("_t")).alias("tags")),
        F.struct(F.lit(1).alias("pos"), envelope(ASSISTANT_EVENT, F.col("_r"), F.col("_s")).alias("text"),
                 F.concat(F.array(F.lit("response")), F.col("_t")).alias("tags")),
    )
    return base.select(*keep, F.inline(two))
