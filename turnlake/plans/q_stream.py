"""Streaming plans (X1-X4) run with ``trigger(availableNow=True)`` over turn events that Spark
writes from ``conversations`` as one file per trigger (conversation ranges in event-time
order, then one replayed file), each query with its own checkpoint under the shared
checkpoint folder.  The registered frame is the final state read back from the sink."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..operators.timeline import classify_records
from ..schema import RECORD_SCHEMA
from ..session import scratch_path
from ..sources.tables import BASE_TS, HOUR, MINUTE, session_of, table
from ..streaming.capture import TURN_EVENT_SCHEMA, capture_stream
from ..streaming.pairing import current_pairs, pair_stream, turns_from_events
from ..streaming.rollups import current_state, session_rollup, start_update_stream, tag_rollup
from .catalog import register
from .common import big
from .oracle_ctes import TURNS, with_

WATERMARK = "10 minutes"
N_FILES = 4


def write_turn_events(spark, sf_dir) -> str:
    conv = table(spark, sf_dir, "conversations")
    ev = conv.select(
        F.concat(F.lit("c"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit("-"),
                 F.lpad(F.col("turn").cast("string"), 4, "0")).alias("event_id"),
        session_of().alias("session_id"), "role", "text",
        (F.lit(BASE_TS) + HOUR * F.col("conv_id") + MINUTE * F.floor(F.col("turn") / 2)).cast("bigint").alias("ts"),
        F.col("turn").alias("line"), F.lit("/work").alias("cwd"), "conv_id",
    )
    top = conv.select(F.max("conv_id")).scalar()
    ev = ev.withColumn("_b", F.floor(F.col("conv_id") * N_FILES / (top + 1))).drop("conv_id")
    path = scratch_path(spark, "events")
    for b in list(range(N_FILES)) + [1]:  # the last file replays the second one
        ev.where(F.col("_b") == b).drop("_b").coalesce(1).write.mode("append").json(path)
        time.sleep(0.05)  # distinct file times keep the trigger order
    return path


def _event_stream(spark, path):
    return spark.readStream.schema(TURN_EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(path)


@register(
    "stream_capture",
    with_(TURNS) + "SELECT id, role, body, CASE WHEN role = 'note' THEN NULL ELSE concat('s', lpad(CAST(conv_id AS VARCHAR), 8, '0')) END AS session_id FROM turns",
)
def q_stream_capture(spark, sf_dir):
    """X1 + X2: live capture appended by foreachBatch; the replayed file adds nothing."""
    src = write_turn_events(spark, sf_dir)
    sink, chk = scratch_path(spark, "capture"), scratch_path(spark, "capture-chk")
    capture_stream(_event_stream(spark, src), sink, chk).awaitTermination()
    recs = classify_records(spark.read.parquet(sink))
    return recs.select("id", "role", "body", "session_id")


def _captured_stream(spark, sf_dir):
    """The capture sink of the event files, as a stream of its records."""
    sink, chk = scratch_path(spark, "captured"), scratch_path(spark, "captured-chk")
    capture_stream(_event_stream(spark, write_turn_events(spark, sf_dir)), sink, chk).awaitTermination()
    return spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", 8).parquet(sink)


@register(
    "stream_sessions",
    with_(TURNS) + "SELECT session_id, count(*) AS count, min(timestamp) AS first_ts, max(timestamp) AS last_ts, "
    "first(left(body, 100) ORDER BY timestamp, seq) AS first_prompt FROM turns "
    "WHERE role = 'user' AND session_id IS NOT NULL GROUP BY session_id",
)
def q_stream_sessions(spark, sf_dir):
    """Running session summaries in update mode over the captured records, which hold each event
    once however late it came; final state equals batch A2."""
    recs = _captured_stream(spark, sf_dir)
    sink, chk = scratch_path(spark, "sessions"), scratch_path(spark, "sessions-chk")
    start_update_stream(session_rollup(recs), sink, chk).awaitTermination()
    st = current_state(spark.read.parquet(sink), "session_id")
    return st.select("session_id", big("count").alias("count"), big("first_ts").alias("first_ts"),
                     big("last_ts").alias("last_ts"), F.col("_first.preview").alias("first_prompt"))


_WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STREAM_PAIRS_ORACLE = f"""
WITH t AS (SELECT conv_id, turn, role,
    concat('c', lpad(CAST(conv_id AS VARCHAR), 8, '0'), '-', lpad(CAST(turn AS VARCHAR), 4, '0')) AS id,
    strftime(make_timestamp((1704067200 + 3600 * conv_id + 60 * (turn // 2)) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS ts,
    regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS text FROM conversations WHERE role IN ('user', 'assistant')),
c AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
        OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_text FROM t)
SELECT concat('s', lpad(CAST(conv_id AS VARCHAR), 8, '0')) AS transcript, id, ts,
  coalesce(user_text, '') AS user_text, text AS assistant_text FROM c WHERE role = 'assistant'
"""


@register("stream_pairs", _STREAM_PAIRS_ORACLE)
def q_stream_pairs(spark, sf_dir):
    """Stateful pairing per session (applyInPandasWithState, event-time watermark); the replayed file
    changes nothing."""
    src = write_turn_events(spark, sf_dir)
    ev = (_event_stream(spark, src).withColumn("event_time", F.timestamp_seconds("ts"))
          .withWatermark("event_time", WATERMARK))
    pairs = pair_stream(turns_from_events(ev), watermark=None)
    sink, chk = scratch_path(spark, "pairs"), scratch_path(spark, "pairs-chk")
    (pairs.writeStream.format("parquet").option("path", sink).option("checkpointLocation", chk)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return current_pairs(spark.read.parquet(sink)).select("transcript", "id", "ts", "user_text", "assistant_text")


@register(
    "stream_tag_counts",
    "SELECT tag, count(*) AS count FROM (SELECT unnest(CASE role WHEN 'user' THEN ['prompt', 'capture'] "
    "WHEN 'assistant' THEN ['response', 'capture'] ELSE ['note'] END) AS tag FROM conversations) GROUP BY tag",
)
def q_stream_tag_counts(spark, sf_dir):
    """Running tag counts of the captured records (update mode); final state equals A1."""
    recs = _captured_stream(spark, sf_dir)
    sink, chk = scratch_path(spark, "tags"), scratch_path(spark, "tags-chk")
    start_update_stream(tag_rollup(recs), sink, chk).awaitTermination()
    return current_state(spark.read.parquet(sink), "tag").select("tag", big("count").alias("count"))
