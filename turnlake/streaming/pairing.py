"""Running turn pairing (X4): each assistant turn of a session paired with the latest earlier
user turn whose timestamp is not later, as the batch J3 rule.

Stateful per session with ``applyInPandasWithState``.  A pair is given out when its assistant turn
comes, and given out again with a higher ``rev`` when a user turn that arrives out of order belongs
to it; ``current_pairs`` keeps the last.  The state holds the lines seen (as ranges, so replays are known
however old they are), the assistant turns that the watermark has not passed, and of the user turns
that it has passed the one with the highest line; that one stays as long as the session does, so
a session may rest for any time.  An assistant turn that comes behind the watermark is paired with what
is kept."""

from __future__ import annotations

import bisect
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.text import strip_ws
from ..operators.pairing import latest_user, push_user
from ..operators.timeline import classify_records

PAIR_SCHEMA = "transcript string, line long, id string, ts string, user_text string, assistant_text string, rev long"
STATE_SCHEMA = "state string"


def _ts_text(col: str):
    return F.date_format(F.timestamp_add("SECOND", F.col(col), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")),
                         "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def turns_from_events(events: DataFrame) -> DataFrame:
    """Turn events -> ``(transcript, line, id, role, ts, text, event_time)`` for user and
    assistant turns with non-blank text (the transcript rule of S7)."""
    e = events.where(F.col("role").isin("user", "assistant"))
    return e.select(
        F.col("session_id").alias("transcript"), F.col("line"), F.col("event_id").alias("id"), F.col("role"),
        _ts_text("ts").alias("ts"), strip_ws(F.col("text")).alias("text"), F.col("event_time"),
        F.unix_millis("event_time").alias("et"),
    ).where(F.length("text") > 0)


def turns_from_records(records: DataFrame) -> DataFrame:
    """Records -> the same turn columns (classified user/assistant rows with a session)."""
    c = classify_records(records).where(F.col("role").isin("user", "claude") & F.col("session_id").isNotNull())
    return c.select(
        F.col("session_id").alias("transcript"), F.col("seq").alias("line"), F.col("id"),
        F.when(F.col("role") == "user", "user").otherwise("assistant").alias("role"),
        _ts_text("timestamp").alias("ts"), strip_ws(F.col("body")).alias("text"),
        F.timestamp_seconds("timestamp").alias("event_time"), (F.col("timestamp") * 1000).alias("et"),
    ).where(F.length("text") > 0)


def _add_line(seen: list[list[int]], line: int) -> bool:
    """Adds a line to sorted ranges; False if it was there."""
    k = bisect.bisect_right(seen, [line, float("inf")])
    if k and line <= seen[k - 1][1]:
        return False
    joins_left, joins_right = k and seen[k - 1][1] == line - 1, k < len(seen) and seen[k][0] == line + 1
    if joins_left and joins_right:
        seen[k - 1][1] = seen.pop(k)[1]
    elif joins_left:
        seen[k - 1][1] = line
    elif joins_right:
        seen[k][0] = line
    else:
        seen.insert(k, [line, line])
    return True


def _pair_group(key, pdfs, state):
    (transcript,) = key
    held = json.loads(state.get[0]) if state.exists else {"users": [], "open": [], "seen": [], "rev": 0}
    users, waiting = held["users"], held["open"]
    rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["line", "et"], kind="stable")
    for r in rows.itertuples(index=False):
        if not _add_line(held["seen"], int(r.line)):
            continue
        if r.role == "user":
            users.append([int(r.line), r.ts, r.text, int(r.et)])
        else:
            waiting.append([int(r.line), r.ts, r.text, int(r.et), r.id, None])
    users.sort(key=lambda u: u[0])
    waiting.sort(key=lambda t: t[0])
    held["rev"] += 1
    out = []
    # one merge by line: the stack holds the users that no later one hides, as in the batch rule
    times, places, k = [], [], 0
    for turn in waiting:
        while k < len(users) and users[k][0] < turn[0]:
            push_user(times, places, users[k][1], k)
            k += 1
        fit = latest_user(times, places, turn[1])
        line, text = (-1, "") if fit is None else (users[fit][0], users[fit][2])
        if turn[5] is None or line > turn[5]:
            turn[5] = line
            out.append((transcript, turn[0], turn[4], turn[1], text, turn[2], held["rev"]))
    passed = state.getCurrentWatermarkMs()
    held["open"] = [t for t in waiting if t[3] >= passed]
    old = [u for u in users if u[3] < passed]
    held["users"] = old[-1:] + [u for u in users if u[3] >= passed]
    state.update((json.dumps(held),))
    if out:
        yield pd.DataFrame(out, columns=["transcript", "line", "id", "ts", "user_text", "assistant_text", "rev"])


def current_pairs(pairs: DataFrame) -> DataFrame:
    """The last revision of each pair of a sink that ``pair_stream`` was written to."""
    kept = ("id", "ts", "user_text", "assistant_text")
    return pairs.groupBy("transcript", "line").agg(*[F.max_by(c, "rev").alias(c) for c in kept])


def pair_stream(turns: DataFrame, watermark: str | None = "10 minutes") -> DataFrame:
    """Streaming frame of pairs from a streaming frame of turns (``watermark=None`` when the
    input already carries one on ``event_time``)."""
    if watermark:
        turns = turns.withWatermark("event_time", watermark)
    return (
        turns.groupBy("transcript")
        .applyInPandasWithState(_pair_group, PAIR_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    )
