"""Assistant-turn / user-turn pairing.

For every kept assistant turn of a transcript: the latest earlier user turn (file order)
whose timestamp text is ``<=`` the assistant's, or the latest earlier user turn when the
assistant has no timestamp; '' when there is none.

This is a search for the previous smaller value.  A user turn hides all earlier ones that are not earlier in
time, so the users that can still be an answer form a stack whose times grow towards the top; an answer is
found in it by bisection.

Plan (no transcript has to fit in one task; a fixed number of jobs, whatever the clocks do):

1. turns are range-partitioned on ``(transcript, line)`` and checkpointed, so a hot transcript spans many
   partitions and partition ids are stable; texts stay behind, only keys and times go on;
2. one pass per partition keeps the stack of the transcript at hand and answers what it can.  It also returns
   the stack that its last transcript ends with and one summary row, that stack's earliest time;
3. a turn without an answer in its own partition looks for it in the partitions before that end with its
   transcript: the summaries (one row per partition) have a stack of their own, which gives the latest partition
   with an early enough user;
4. such turns meet that partition's stack, cut into parts where very many ask for one, in a second pass;
5. texts are joined to the answers by ``(transcript, line)``.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

_LINK_SCHEMA = ("kind string, pid int, transcript string, line long, ts string, answer long, first_t string")
_ASKED_PART = 100_000  # turns that meet one copy of a stack


def push_user(times: list, lines: list, ts: str, line: int) -> None:
    """A new user turn hides those that are not earlier in time."""
    while times and times[-1] >= ts:
        times.pop()
        lines.pop()
    times.append(ts)
    lines.append(line)


def latest_user(times: list, lines: list, ts: str) -> int | None:
    """The latest turn of the stack that is not later than ``ts``; the last one for a turn without a time."""
    at = bisect_right(times, ts) if ts else len(times)
    return lines[at - 1] if at else None


def _links(batches):
    """One partition, sorted by (transcript, line), in Arrow batches of any size: rows 'A' with the assistant turns'
    answers, 'K' with the stack of the last transcript, and one 'S' with the first and last transcript and the
    earliest time of that stack."""
    pid, first, now, times, lines = None, None, None, [], []
    for pdf in batches:
        if len(pdf) == 0:
            continue
        if pid is None:
            pid, first = int(pdf["pid"].iloc[0]), pdf["transcript"].iloc[0]
        answers, assistant = [], (pdf["role"] != "user").to_numpy()
        for transcript, line, asks, ts in zip(pdf["transcript"], pdf["line"].tolist(), assistant.tolist(), pdf["ts"], strict=True):
            if transcript != now:
                now, times, lines = transcript, [], []
            if asks:
                answers.append(latest_user(times, lines, ts))
            else:
                push_user(times, lines, ts, line)
        own = pdf[assistant]
        if len(own):
            yield pd.DataFrame({"kind": "A", "pid": pid, "transcript": own["transcript"], "line": own["line"], "ts": own["ts"],
                                "answer": pd.array(answers, "Int64"), "first_t": first})
    if pid is not None:
        if lines:
            yield pd.DataFrame({"kind": "K", "pid": pid, "transcript": now, "line": pd.array(lines, "Int64"), "ts": times,
                                "answer": pd.array([None] * len(lines), "Int64"), "first_t": None})
        yield pd.DataFrame({"kind": ["S"], "pid": [pid], "transcript": [now], "line": pd.array([None], "Int64"),
                            "ts": [times[0] if times else None], "answer": pd.array([None], "Int64"), "first_t": [first]})


def _targets(summaries: list) -> dict[int, tuple[list, list]]:
    """For each partition the stack of the partitions before it that end with the transcript it begins with:
    their earliest times, and their ids."""
    out: dict[int, tuple[list, list]] = {}
    now, times, ids = None, [], []
    for s in sorted(summaries, key=lambda r: r["pid"]):
        out[s["pid"]] = (list(times), list(ids)) if s["first_t"] == now else ([], [])
        if s["transcript"] != now:
            now, times, ids = s["transcript"], [], []
        if s["ts"] is not None:
            push_user(times, ids, s["ts"], s["pid"])
    return out


def _look_back(batches):
    """Rows sorted by (target, part): a partition's stack (kind 0, by line), then the turns that ask for it (kind 1)."""
    now, times, lines = None, [], []
    for pdf in batches:
        out = []
        for target, part, kind, transcript, line, ts in zip(pdf["target"].tolist(), pdf["part"].tolist(), pdf["kind"].tolist(),
                                                            pdf["transcript"], pdf["line"].tolist(), pdf["ts"], strict=True):
            if (target, part) != now:
                now, times, lines = (target, part), [], []
            if kind == 0:
                times.append(ts)
                lines.append(line)
            else:
                out.append((transcript, line, latest_user(times, lines, ts)))
        if out:
            yield pd.DataFrame({"transcript": [x[0] for x in out], "line": [x[1] for x in out], "answer": pd.array([x[2] for x in out], "Int64")})


def pair_turns(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """``turns``: ``(transcript, line, role, ts, text)`` (see ``transcript_turns``).
    Returns ``(transcript, line, ts, user_text, assistant_text)`` per assistant turn."""
    spark = turns.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = checkpointed(
        turns.select("transcript", "line", "role", "ts", "text")
        .repartitionByRange(n, "transcript", "line")
        .sortWithinPartitions("transcript", "line")
        .withColumn("pid", F.spark_partition_id())
    )
    links = checkpointed(ordered.select("pid", "transcript", "line", "role", "ts").mapInPandas(_links, _LINK_SCHEMA))
    stacks = _targets(links.where("kind = 'S'").collect())  # one row per partition

    def aim(batches):
        for pdf in batches:
            found = [latest_user(*stacks[p], ts) for p, ts in zip(pdf["pid"].tolist(), pdf["ts"], strict=True)]
            yield pdf[["transcript", "line", "ts"]].assign(target=pd.array(found, "Int64"))

    answers = links.where("kind = 'A'")
    back = answers.where("answer IS NULL AND transcript = first_t").select("pid", "transcript", "line", "ts")
    asked = checkpointed(back.mapInPandas(aim, "transcript string, line long, ts string, target int").where("target IS NOT NULL"))
    parts = asked.groupBy(F.col("target").alias("_t")).agg(F.ceil(F.count("*") / _ASKED_PART).cast("int").alias("parts"))
    parts = F.broadcast(checkpointed(parts))  # one row per partition at most
    stack = (links.where("kind = 'K'").join(parts, F.col("pid") == F.col("_t"))
             .select(F.col("pid").alias("target"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                     F.lit(0).alias("kind"), "transcript", "line", "ts"))
    asks = asked.join(parts, F.col("target") == F.col("_t")).select(
        "target", F.pmod(F.xxhash64("line"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "transcript", "line", "ts")
    looked = (stack.unionByName(asks).repartition("target", "part").sortWithinPartitions("target", "part", "kind", "line")
              .mapInPandas(_look_back, "transcript string, line long, answer long"))
    paired = answers.where("answer IS NOT NULL").select("transcript", "line", "answer").unionByName(looked)
    paired = paired.select(F.col("transcript").alias("_t"), F.col("line").alias("_l"), "answer")
    said = ordered.where("role <> 'user'").select("transcript", "line", "ts", F.col("text").alias("assistant_text"))
    users = ordered.where("role = 'user'").select(
        F.col("transcript").alias("u_t"), F.col("line").alias("u_line"), F.col("text").alias("u_text"))
    out = said.join(paired, (F.col("transcript") == F.col("_t")) & (F.col("line") == F.col("_l")), "left").join(
        users, (F.col("transcript") == F.col("u_t")) & (F.col("answer") == F.col("u_line")), "left")
    return out.select("transcript", "line", "ts", F.coalesce("u_text", F.lit("")).alias("user_text"), "assistant_text")
