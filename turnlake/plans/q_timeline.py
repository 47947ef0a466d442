"""Classification, timelines, sessions, Markdown, facets and listings (C1, C2, C9-C13,
T1-T5, A1, A2, A4, P1-P7) over the derived record tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import format_tags, short_id, score_band, truncate_chars
from ..functions.timeutil import format_ts, parse_date
from ..functions.vector import cosine_to
from ..operators.facets import tag_facets
from ..operators.timeline import (
    classify_records, list_recent, list_records, preview_rows, session_markdown, session_summaries,
    session_transcript, timeline,
)
from ..session import checkpointed
from ..sources.records import with_seq
from ..sources.tables import doc_records, turn_records
from .catalog import register
from .common import big, joined, query_vector, r6
from .oracle_ctes import DOC_RECORDS, TURNS, cos, with_

_TS = "strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M:%S')"


def _trunc(col: str, n: int) -> str:
    return f"(CASE WHEN length({col}) > {n} THEN left({col}, {n}) || '…' ELSE {col} END)"


# texts that only a lenient JSON parser takes for an envelope: single quotes, then text after the value
_ODD = """,
odd AS (SELECT seq, id, concat('{''hook_event_name'':"Stop",''response'':"', id, '"}') AS quoted,
  concat('{"hook_event_name":"UserPromptSubmit","prompt":"', id, '"} x') AS tailed FROM turns WHERE role = 'claude')
"""


def _with_odd(records):
    """The turn records, and for each assistant turn two more that are envelopes to a lenient parser only."""
    claude = records.where(F.array_contains("tags", "response"))
    quoted = F.concat(F.lit("{'hook_event_name':\"Stop\",'response':\""), "id", F.lit('"}'))
    trailing = F.concat(F.lit('{"hook_event_name":"UserPromptSubmit","prompt":"'), "id", F.lit('"} x'))
    return (records.unionByName(claude.withColumns({"id": F.concat("id", F.lit("-q")), "text": quoted}))
            .unionByName(claude.withColumns({"id": F.concat("id", F.lit("-t")), "text": trailing,
                                             "tags": F.array(F.lit("fixture"))})))


@register(
    "classify_roles",
    with_(TURNS) + _ODD + "SELECT seq, id, role, body, session_id FROM turns "
    "UNION ALL SELECT seq, concat(id, '-q'), 'claude', quoted, NULL FROM odd "
    "UNION ALL SELECT seq, concat(id, '-t'), 'note', tailed, NULL FROM odd",
)
def q_classify_roles(spark, sf_dir):
    """role/body/session of every turn record (envelopes parsed once per row), and of texts that
    are no JSON: they keep their raw text."""
    c = classify_records(_with_odd(turn_records(spark, sf_dir)))
    return c.select("seq", "id", "role", "body", "session_id")


@register(
    "classify_lenient",
    with_(TURNS) + _ODD
    + "SELECT seq, id, CASE WHEN role = 'note' THEN NULL ELSE role END AS role, "
    "CASE WHEN role = 'note' THEN NULL ELSE body END AS body, session_id FROM turns "
    "UNION ALL SELECT seq, concat(id, '-q'), 'claude', quoted, NULL FROM odd "
    "UNION ALL SELECT seq, concat(id, '-t'), NULL, NULL, NULL FROM odd",
)
def q_classify_lenient(spark, sf_dir):
    """The UI rule (envelope first, then tag); other records get NULL role."""
    c = classify_records(_with_odd(turn_records(spark, sf_dir)), lenient=True)
    return c.select("seq", "id", "role", "body", "session_id")


def _tl_out(df):
    return df.select("role", big("timestamp").alias("timestamp"), "session_id", F.col("body").alias("text"), "id", "seq")


@register(
    "timeline",
    with_(TURNS) + "SELECT role, timestamp, session_id, body AS text, id, seq FROM turns "
    "WHERE role <> 'note' ORDER BY timestamp, seq LIMIT 50",
)
def q_timeline(spark, sf_dir):
    """HTTP timeline defaults: notes hidden, oldest 50 by (timestamp, seq)."""
    return _tl_out(timeline(turn_records(spark, sf_dir)))


@register(
    "timeline_role_session",
    with_(TURNS) + "SELECT role, timestamp, session_id, body AS text, id, seq FROM turns "
    "WHERE role = 'user' AND starts_with(coalesce(session_id, ''), 's0000001') ORDER BY timestamp, seq LIMIT 50",
)
def q_timeline_role_session(spark, sf_dir):
    """T3 + P4 + P5: user turns of sessions with prefix 's0000001'."""
    return _tl_out(timeline(turn_records(spark, sf_dir), session="s0000001", role="user"))


def _cli_out(df):
    p = preview_rows(df.withColumn("ts_text", format_ts("timestamp")))
    return p.select("seq", "ts_text", "label", "preview", "sid_short")


_CLI_SELECT = (
    f"SELECT seq, {_TS} AS ts_text, CASE role WHEN 'user' THEN 'User' WHEN 'claude' THEN 'Claude' ELSE 'Note' END AS label, "
    f"CASE WHEN role = 'note' THEN {_trunc('body', 200)} ELSE {_trunc('body', 300)} END AS preview, "
    "CASE WHEN role = 'claude' THEN left(session_id, 8) END AS sid_short FROM turns"
)


@register("timeline_cli", with_(TURNS) + _CLI_SELECT)
def q_timeline_cli(spark, sf_dir):
    """T4 + C10 + C11: CLI timeline with notes, no limit, UTC time text and previews."""
    return _cli_out(timeline(turn_records(spark, sf_dir), limit=None, show_notes=True, keep_legacy=True))


@register(
    "timeline_cli_session",
    with_(TURNS) + _CLI_SELECT + " WHERE (role = 'user' AND starts_with(session_id, 's0000002')) OR "
    "(role = 'claude' AND (session_id IS NULL OR starts_with(session_id, 's0000002')))",
)
def q_timeline_cli_session(spark, sf_dir):
    """T4 + P4 (CLI rule, rule 2.12-5): sessionless assistant rows are kept, notes dropped."""
    return _cli_out(timeline(turn_records(spark, sf_dir), session="s0000002", limit=None, keep_legacy=True))


@register(
    "session_summaries",
    with_(TURNS) + "SELECT session_id, count(*) AS count, min(timestamp) AS first_ts, max(timestamp) AS last_ts, "
    "first(left(body, 100) ORDER BY timestamp, seq) AS first_prompt FROM turns "
    "WHERE role = 'user' AND session_id IS NOT NULL GROUP BY session_id",
)
def q_session_summaries(spark, sf_dir):
    """A2: per session prompt count, first/last timestamp, first prompt (100 chars)."""
    s = session_summaries(turn_records(spark, sf_dir))
    return s.select("session_id", big("count").alias("count"), big("first_ts").alias("first_ts"),
                    big("last_ts").alias("last_ts"), "first_prompt")


@register(
    "session_markdown",
    with_(TURNS) + "SELECT session_id, count(*) AS n_rows, string_agg(CASE WHEN role = 'user' THEN '## User' ELSE "
    "'## Claude' END || chr(10) || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) "
    "ORDER BY timestamp, seq) AS markdown FROM turns WHERE role IN ('user', 'claude') AND session_id IS NOT NULL "
    "GROUP BY session_id",
)
def q_session_markdown(spark, sf_dir):
    """A4: every session as one Markdown document."""
    m = session_markdown(turn_records(spark, sf_dir))
    return m.select("session_id", big("n_rows").alias("n_rows"), "markdown")


@register(
    "session_transcript",
    with_(
        TURNS,
        "s AS (SELECT session_id FROM turns WHERE role = 'user' AND session_id IS NOT NULL GROUP BY session_id "
        "ORDER BY max(timestamp) DESC, session_id LIMIT 1)",
    )
    + f"SELECT seq, {_TS} AS ts_text, CASE role WHEN 'user' THEN 'User' ELSE 'Claude' END AS label, "
    f"{_trunc('body', 300)} AS preview FROM turns JOIN s USING (session_id) WHERE role IN ('user', 'claude')",
)
def q_session_transcript(spark, sf_dir):
    """T5: the transcript of the session listed first (newest last prompt)."""
    recs = turn_records(spark, sf_dir)
    newest = session_summaries(recs, preview_chars=80).select("session_id").first()
    c = session_transcript(recs, newest[0] if newest else "")
    p = preview_rows(c.withColumn("ts_text", format_ts("timestamp")))
    return p.select("seq", "ts_text", "label", "preview")


@register(
    "tag_facets",
    with_(DOC_RECORDS) + "SELECT tag, count(*) AS count FROM (SELECT unnest(tags) AS tag FROM doc_records) GROUP BY tag",
)
def q_tag_facets(spark, sf_dir):
    """A1: occurrences per tag."""
    return tag_facets(doc_records(spark, sf_dir)).select("tag", big("count").alias("count"))


@register(
    "list_by_tags",
    with_(DOC_RECORDS) + "SELECT seq, id, timestamp, array_to_string(tags, ',') AS tags FROM doc_records "
    "WHERE list_contains(tags, 'en') AND list_contains(tags, 'hq')",
)
def q_list_by_tags(spark, sf_dir):
    """T1 + P1 + C15: records with tags en AND hq in insertion order."""
    r = list_records(doc_records(spark, sf_dir), ["en", "hq"])
    return r.select("seq", "id", big("timestamp").alias("timestamp"), joined("tags").alias("tags"))


@register(
    "list_recent",
    with_(DOC_RECORDS) + "SELECT seq, id, timestamp, array_to_string(tags, ',') AS tags FROM doc_records "
    "WHERE list_contains(tags, 'en') ORDER BY seq DESC LIMIT 50",
)
def q_list_recent(spark, sf_dir):
    """Newest-inserted 50 with tag en."""
    r = list_recent(doc_records(spark, sf_dir), ["en"], 50)
    return r.select("seq", "id", big("timestamp").alias("timestamp"), joined("tags").alias("tags"))


_AFTER_ARG, _BEFORE_ARG = "2024-01-02", "1706227200"  # the oracle has both as seconds


@register(
    "record_display",
    with_(DOC_RECORDS, "q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 7)")
    + f"SELECT seq, left(id, 8) AS short_id, {_TS} AS ts_text, "
    "CASE WHEN len(tags) > 0 THEN ' [' || array_to_string(tags, ', ') || ']' ELSE '' END AS tags_text, "
    f"{_trunc('text', 80)} AS preview, round({cos('vector', 'q.qv')}, 6) AS score, "
    f"CASE WHEN {cos('vector', 'q.qv')} >= 0.8 THEN 'high' WHEN {cos('vector', 'q.qv')} >= 0.6 THEN 'mid' ELSE 'low' END AS band "
    f"FROM doc_records CROSS JOIN q WHERE timestamp >= 1704153600 AND timestamp < 1706227200",
)
def q_record_display(spark, sf_dir):
    """Date arguments, UTC time text, short id, tag list text, preview, score band."""
    after, before = parse_date(_AFTER_ARG), parse_date(_BEFORE_ARG)
    r = doc_records(spark, sf_dir).where((F.col("timestamp") >= after) & (F.col("timestamp") < before))
    r = r.withColumn("s", cosine_to("vector", query_vector(spark, sf_dir)))
    return r.select(
        "seq", short_id("id").alias("short_id"), format_ts("timestamp").alias("ts_text"),
        format_tags("tags").alias("tags_text"), truncate_chars("text", 80).alias("preview"),
        r6("s").alias("score"), score_band("s").alias("band"),
    )


def _in_order(df, *columns):
    """``columns`` with the place of each row in the order that the operator returns."""
    return with_seq(checkpointed(df.select(*columns)), 1, "position").select("position", *columns)


def _ordered(sql: str, columns: str, order: str, limit: int | None = None) -> str:
    cut = f" WHERE position <= {limit}" if limit else ""
    return f"{sql} SELECT * FROM (SELECT row_number() OVER (ORDER BY {order}) AS position, {columns}){cut}"


@register("list_by_tags_order", _ordered(
    with_(DOC_RECORDS), "seq FROM doc_records WHERE list_contains(tags, 'en') AND list_contains(tags, 'hq')", "seq"))
def q_list_by_tags_order(spark, sf_dir):
    """The order of the listing."""
    return _in_order(list_records(doc_records(spark, sf_dir), ["en", "hq"]), "seq")


@register("list_recent_order", _ordered(with_(DOC_RECORDS), "seq FROM doc_records WHERE list_contains(tags, 'en')", "seq DESC", 50))
def q_list_recent_order(spark, sf_dir):
    """The order of the newest 50."""
    return _in_order(list_recent(doc_records(spark, sf_dir), ["en"], 50), "seq")


@register("timeline_order", _ordered(with_(TURNS), "seq FROM turns WHERE role <> 'note'", "timestamp, seq", 50))
def q_timeline_order(spark, sf_dir):
    """The order of the oldest 50."""
    return _in_order(timeline(turn_records(spark, sf_dir)), "seq")


@register("timeline_cli_order", _ordered(with_(TURNS), "seq FROM turns", "timestamp, seq"))
def q_timeline_cli_order(spark, sf_dir):
    """T4: the order of the whole timeline with notes."""
    return _in_order(timeline(turn_records(spark, sf_dir), limit=None, show_notes=True, keep_legacy=True), "seq")


@register("session_summaries_order", _ordered(
    with_(TURNS), "session_id FROM turns WHERE role = 'user' AND session_id IS NOT NULL GROUP BY session_id",
    "max(timestamp) DESC, session_id"))
def q_session_summaries_order(spark, sf_dir):
    """A2: the order of the sessions, newest first."""
    return _in_order(session_summaries(turn_records(spark, sf_dir)), "session_id")


@register("tag_facets_order", _ordered(
    with_(DOC_RECORDS), "tag FROM (SELECT unnest(tags) AS tag FROM doc_records) GROUP BY tag", "count(*) DESC, tag"))
def q_tag_facets_order(spark, sf_dir):
    """A1: the order of the tags, most frequent first."""
    return _in_order(tag_facets(doc_records(spark, sf_dir)), "tag")
