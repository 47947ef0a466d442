"""Listings, timelines, session roll-ups and Markdown transcripts.

Classification (C1/C2) is a projection, so every plan here is scan -> project -> filter ->
TakeOrderedAndProject (limits) or HashAggregate with map-side partial aggregation (sessions).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import classify, classify_lenient
from ..functions.text import truncate_chars
from .predicates import has_all_tags, hide_notes, role_is, session_prefix


def classify_records(df: DataFrame, lenient: bool = False) -> DataFrame:
    """C1 (or C2 with ``lenient=True``): adds ``role, body, session_id``."""
    c = (classify_lenient if lenient else classify)("text", "tags")
    return df.withColumn("_c", c).select("*", "_c.role", "_c.body", "_c.session_id").drop("_c")


def list_records(df: DataFrame, tags: Sequence[str] | None = None) -> DataFrame:
    """Records with all given tags in insertion order (no limit)."""
    return df.where(has_all_tags(tags)).orderBy("seq")


def list_recent(df: DataFrame, tags: Sequence[str] | None = None, limit: int = 50) -> DataFrame:
    """Newest-inserted first, at most ``limit``."""
    return df.where(has_all_tags(tags)).orderBy(F.col("seq").desc()).limit(limit)


def timeline(
    df: DataFrame,
    *,
    session: str | None = None,
    role: str | None = None,
    limit: int | None = 50,
    show_notes: bool = False,
    keep_legacy: bool = False,
) -> DataFrame:
    """T3 (HTTP defaults) / T4 (``keep_legacy=True``, ``limit=None``, notes optional):
    classified rows sorted by (timestamp, seq), role/session filters, the *first* ``limit``."""
    c = classify_records(df)
    out = c.where(hide_notes(show_notes) & role_is(role) & session_prefix(session, keep_legacy))
    out = out.orderBy("timestamp", "seq")
    return out.limit(limit) if limit is not None else out


def session_transcript(df: DataFrame, session_id: str) -> DataFrame:
    """T5: one session's user and assistant rows (exact session id), oldest first."""
    c = classify_records(df)
    return c.where(F.col("role").isin("user", "claude") & (F.col("session_id") == F.lit(session_id))).orderBy(
        "timestamp", "seq"
    )


def session_summaries(df: DataFrame, tags: Sequence[str] | None = None, preview_chars: int = 100) -> DataFrame:
    """A2: per session over user turns that carry a session: prompt count, first/last
    timestamp and the first prompt (earliest timestamp, first inserted on ties) cut to
    ``preview_chars`` characters; newest ``last_ts`` first.  ``tags`` limits which records
    build sessions.  The preview is cut before aggregating so partial aggregates stay small."""
    c = classify_records(df.where(has_all_tags(tags)))
    users = c.where((F.col("role") == "user") & F.col("session_id").isNotNull()).select(
        "session_id", "timestamp", "seq", F.substring("body", 1, preview_chars).alias("preview")
    )
    agg = users.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        F.min(F.struct("timestamp", "seq", "preview")).getField("preview").alias("first_prompt"),
    )
    return agg.orderBy(F.col("last_ts").desc(), F.col("session_id"))


MD_SEPARATOR = "\n\n---\n\n"


def session_markdown(df: DataFrame, session: str | None = None) -> DataFrame:
    """A4: each session rendered as Markdown: ``## User``/``## Claude`` blocks with the body,
    joined by a horizontal rule, ordered by (timestamp, seq).  Rows are those the session
    view of the timeline returns (claude rows need a session).  One string per session is the
    output itself, so a session's rows meet in one group; the block text is built first."""
    c = classify_records(df)
    rows = c.where(F.col("role").isin("user", "claude") & F.col("session_id").isNotNull())
    if session is not None:
        rows = rows.where(F.col("session_id").startswith(F.lit(session)))
    block = F.concat(
        F.when(F.col("role") == "user", F.lit("## User\n\n")).otherwise(F.lit("## Claude\n\n")), F.col("body")
    )
    rows = rows.select("session_id", "timestamp", "seq", block.alias("block"))
    return rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.expr(f"listagg(block, '{_sql_escape(MD_SEPARATOR)}') WITHIN GROUP (ORDER BY timestamp, seq)").alias("markdown"),
    )


def _sql_escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("\n", "\\n").replace("'", "\\'")


def preview_rows(df: DataFrame, user_chars: int = 300, note_chars: int = 200) -> DataFrame:
    """T4 display columns: role label, preview (300 chars, notes 200) and the short session."""
    label = F.when(F.col("role") == "user", "User").when(F.col("role") == "claude", "Claude").otherwise("Note")
    prev = F.when(F.col("role") == "note", truncate_chars("body", note_chars)).otherwise(truncate_chars("body", user_chars))
    return df.withColumn("label", label).withColumn("preview", prev).withColumn(
        "sid_short", F.when(F.col("role") == "claude", F.substring("session_id", 1, 8))
    )
