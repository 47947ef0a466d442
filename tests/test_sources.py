"""Sources (S1-S9, S11) and turn pairing (J3, rule 2.12-17) on hand-written inputs."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from turnlake.operators.pairing import pair_turns
from turnlake.sources.conversation import TRANSCRIPT_SCHEMA, expand_turns, prompt_events_to_entries, transcript_turns
from turnlake.sources.files import add_tag, detect_format, load_entries
from turnlake.sources.records import build_records, uuid_like, with_seq
from turnlake.sources.validate import split_valid


def _tmp(name, content):
    d = tempfile.mkdtemp(prefix="turnlake-test-")
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(content)
    return p


def test_text_lines(spark):
    p = _tmp("a.txt", "  first line \n\n\t\nsecond\r\n  ")
    e = load_entries(spark, p)
    assert [(r.text, r.tags) for r in e.collect()] == [("first line", []), ("second", [])]


def test_csv_by_position(spark):
    p = _tmp("a.csv", 'body,labels,extra\n" quoted, ""text"" ","a, b,,c",x\nsolo\n,"t"\n"multi\nline",z\n')
    e = load_entries(spark, p, extra_tag="imp")
    got = [(r.text, r.tags) for r in e.collect()]
    assert got == [('quoted, "text"', ["a", "b", "c", "imp"]), ("solo", ["imp"]), ("multi\nline", ["z", "imp"])]


def test_json_array_and_extra_tag(spark):
    p = _tmp("a.json", json.dumps([{"text": "x", "tags": ["t", "t"], "junk": 1}, {"text": ""}, {"tags": ["only"]}]))
    e = add_tag(load_entries(spark, p), "t")
    got = [(r.text, r.tags) for r in e.collect()]
    # repeats kept, existing tag not added twice, blank JSON text accepted, missing text stays NULL
    assert got == [("x", ["t", "t"]), ("", ["t"]), (None, ["only", "t"])]
    ok, bad = split_valid(e)
    assert ok.count() == 1 and sorted(r.reject_reason for r in bad.collect()) == ["empty_text", "missing_text"]


def test_format_dispatch():
    assert detect_format("x.CSV") == "csv" and detect_format("x.md") == "txt" and detect_format("x", "JSON") == "json"


def test_validation_limits(spark):
    df = spark.createDataFrame(
        [("é" * 16384, []), ("é" * 16385, []), ("ok", ["t"] * 65), ("ok", ["x" * 257]), ("ok", ["x" * 256])],
        "text string, tags array<string>")
    _, bad = split_valid(df)
    assert sorted(r.reject_reason for r in bad.collect()) == ["tag_too_long", "text_too_long", "too_many_tags"]


def test_prompt_events(spark):
    ev = spark.createDataFrame(
        [("<ide_opened_file>f</ide_opened_file>\n hello ", "s1", "/w"), ("<a>only</a>  ", "s1", "/w"), (None, None, None)],
        "prompt string, session_id string, cwd string")
    out = prompt_events_to_entries(ev).collect()
    assert len(out) == 1
    assert json.loads(out[0].text) == {"hook_event_name": "UserPromptSubmit", "prompt": "hello", "session_id": "s1", "cwd": "/w"}
    assert out[0].tags == ["prompt", "claude-code", "realtime"]


def test_expand_turns_generates_one_session_per_pair(spark):
    pairs = spark.createDataFrame([("p", "r", None, ["x"])], "prompt string, response string, session_id string, tags array<string>")
    out = expand_turns(pairs).collect()
    s0, s1 = (json.loads(r.text)["session_id"] for r in out)
    assert s0 == s1 and len(s0) == 36
    assert [r.tags for r in out] == [["prompt", "x"], ["response", "x"]]


def _lines(spark, rows):
    d = tempfile.mkdtemp(prefix="turnlake-tr-")
    with open(os.path.join(d, "t1.jsonl"), "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
    return spark.read.schema(TRANSCRIPT_SCHEMA).json(d)


def test_transcript_pairing_edge_cases(spark):
    rows = [
        {"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": [{"type": "text", "text": "orphan"}], "stop_reason": "end_turn"}},
        {"type": "user", "timestamp": "2024-01-01T00:00:01Z", "message": {"content": "  q1  "}},
        {"type": "assistant", "timestamp": "2024-01-01T00:00:01Z", "message": {"content": [{"type": "text", "text": "a1"}, {"type": "text", "text": "b1"}], "stop_reason": "end_turn"}},
        {"type": "assistant", "timestamp": "2024-01-01T00:00:02Z", "message": {"content": [{"type": "text", "text": "tool"}], "stop_reason": "tool_use"}},
        {"type": "assistant", "timestamp": "2024-01-01T00:00:03Z", "message": {"content": "a2", "stop_reason": "end_turn"}},
        {"type": "user", "timestamp": "2024-01-01T00:00:09Z", "message": {"content": "late clock"}},
        {"type": "assistant", "timestamp": "2024-01-01T00:00:05Z", "message": {"content": "a3", "stop_reason": "end_turn"}},
        {"type": "user", "message": {"content": "   "}},
        {"type": "assistant", "message": {"content": "a4", "stop_reason": "end_turn"}},
    ]
    turns = transcript_turns(_lines(spark, rows))
    got = sorted((r.line, r.user_text, r.assistant_text) for r in pair_turns(turns).collect())
    assert [(u, a) for _, u, a in got] == [
        ("", "orphan"),             # assistant without any user turn
        ("q1", "a1\nb1"),           # equal timestamps count, blocks joined by newline
        ("q1", "a2"),               # two assistant turns in a row share the user turn
        ("q1", "a3"),               # the later user turn has a later clock: walk back
        ("late clock", "a4"),       # no assistant timestamp: the last user turn
    ]


def test_strings_that_are_json_stay_strings(spark):
    texts = ["hello", "42", "true", '{"a":1}', '["x"]', '"quoted"', "null", "[]"]
    lines = _lines(spark, [{"type": "user", "timestamp": "t", "message": {"content": t}} for t in texts])
    assert [r.text for r in transcript_turns(lines).orderBy("line").collect()] == texts


def test_equal_exchanges_are_sessions_of_their_own(spark):
    pairs = spark.createDataFrame([(k, "p", "r") for k in range(3)], "k int, prompt string, response string")
    for out in (expand_turns(pairs, keep=("k",)), expand_turns(pairs)):
        sessions = [json.loads(r.text)["session_id"] for r in out.collect()]
        assert len(set(sessions)) == 3 and len(sessions) == 6


@pytest.mark.parametrize("batch_rows", [1, 7, 10_000])
def test_pairing_equals_brute_force_at_any_batch_size(spark, batch_rows):
    rng = random.Random(batch_rows)
    rows, want = [], []
    for t in range(6):
        users = []
        for line in range(rng.choice([3, 40, 200])):
            role, ts = rng.choice(["user", "assistant"]), rng.choice(["", f"{max(0, line + rng.randrange(-9, 3)):05d}"])
            rows.append((f"t{t}", line, role, ts, f"{t}-{line}"))
            if role == "user":
                users.append((ts, f"{t}-{line}"))
            else:
                fit = [u for u in users if not ts or u[0] <= ts]
                want.append((f"t{t}", line, fit[-1][1] if fit else "", f"{t}-{line}"))
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "transcript string, line long, role string, ts string, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    try:
        got = [(r.transcript, r.line, r.user_text, r.assistant_text) for r in pair_turns(turns, partitions=3).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got) == sorted(want)


def test_with_seq_and_records(spark):
    e = spark.range(0, 1000, numPartitions=7).select(F.col("id").cast("string").alias("text"), F.array().cast("array<string>").alias("tags"))
    s = with_seq(e, 100).select("seq", "text").collect()
    assert sorted(r.seq for r in s) == list(range(100, 1100))
    assert all(int(r.text) + 100 == r.seq for r in s)  # consecutive in input order
    recs = build_records(e, start_seq=5, now=7)
    r = recs.orderBy("seq").first()
    assert r.seq == 5 and r.timestamp == 7 and len(r.id) == 36 and r.id[14] == "4"
    loose = build_records(e.union(e).distinct(), start_seq=2, now=7)  # partitions that only the run decides
    assert sorted(r.seq for r in loose.collect()) == list(range(2, 1002))
    assert build_records(e.limit(0), now=7).count() == 0
    # deterministic ids
    a = spark.range(3).select(uuid_like(F.col("id")).alias("u")).collect()
    b = spark.range(3).select(uuid_like(F.col("id")).alias("u")).collect()
    assert a == b


def _brute_pairs(rows):
    """Rule 2.12-17 straight from its definition, per transcript in line order."""
    out = {}
    by_t = {}
    for t, line, role, ts, text in rows:
        by_t.setdefault(t, []).append((line, role, ts, text))
    for t, items in by_t.items():
        items.sort()
        users = []
        for line, role, ts, text in items:
            if role == "user":
                users.append((ts, text))
            else:
                u = ""
                for uts, utext in reversed(users):
                    if ts == "" or uts <= ts:
                        u = utext
                        break
                out[(t, line)] = u
    return out


def test_pairing_hot_transcript_across_partitions(spark):
    import random

    rnd = random.Random(5)
    rows = []
    for t, n in [("hot", 240), ("a", 7), ("b", 3), ("z", 30)]:
        clock = 0
        for line in range(n):
            clock += rnd.choice([1, 1, 2, -3])  # mostly increasing, sometimes back in time
            ts = "" if rnd.random() < 0.03 else f"{1000 + clock:06d}"
            role = "user" if rnd.random() < 0.4 else "assistant"
            rows.append((t, line, role, ts, f"{t}-{line}"))
    df = spark.createDataFrame(rows, "transcript string, line long, role string, ts string, text string")
    got = {(r.transcript, r.line): r.user_text for r in pair_turns(df, partitions=16).collect()}
    assert got == _brute_pairs(rows)


def test_stop_events(spark):
    from turnlake.functions.classify import classify
    from turnlake.sources.conversation import STOP_HOOK_TAGS, stop_events_to_entries

    turns = spark.createDataFrame([
        ("a", 1, "user", "t1", "early"), ("a", 2, "assistant", "t2", "first"), ("a", 3, "user", "t5", "too late"),
        ("a", 4, "assistant", "t4", "last"), ("a", 5, "user", "t3", "after it, but not later"), ("b", 1, "user", "t1", "no answer"),
        ("c", 1, "assistant", "t1", "unasked"), ("d", 1, "user", "t9", "any"), ("d", 2, "assistant", "", "without time"),
    ], "transcript string, line long, role string, ts string, text string")
    events = spark.createDataFrame([
        (None, "a", "s", "/w"), (False, "a", None, None), (True, "a", "s", ""), (False, "", "s", ""), (False, None, "s", ""),
        (False, "b", "s", ""), (False, "c", "s3", ""), (False, "d", "s4", ""), (False, "unknown", "s", ""),
    ], "stop_hook_active boolean, transcript_path string, session_id string, cwd string")
    got = stop_events_to_entries(events, turns)
    assert sorted((r.session_id, r.prompt, r.tags) for r in got.collect()) == [
        ("", "after it, but not later", STOP_HOOK_TAGS), ("s", "after it, but not later", STOP_HOOK_TAGS),
        ("s3", "", STOP_HOOK_TAGS), ("s4", "any", STOP_HOOK_TAGS)]
    turn = {r.session_id: r.c for r in got.select("session_id", classify("text", "tags").alias("c")).collect()}
    assert tuple(turn["s"]) == ("claude", "last", "s") and tuple(turn["s4"]) == ("claude", "without time", "s4")
    assert stop_events_to_entries(events.limit(0), turns.limit(0)).count() == 0


def _job_count(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        got = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("asked_part", [100_000, 7])
def test_pairing_with_falling_clocks_takes_a_fixed_number_of_jobs(spark, monkeypatch, asked_part):
    from turnlake.operators import pairing

    monkeypatch.setattr(pairing, "_ASKED_PART", asked_part)
    jobs = set()
    for n, kind in ((100, "falling"), (10_000, "falling"), (3000, "random"), (3000, "rising")):
        rng = random.Random(n)
        rows = []
        for k in range(n):
            clock = {"falling": n - k, "random": rng.randrange(n), "rising": k}[kind]
            role = "assistant" if k % 50 == 49 or rng.random() < 0.2 else "user"
            # late answers look for the first users, far back
            rows.append(("hot" if k % 10 else "cold", k, role, "" if rng.random() < 0.02 else f"t{clock + (n // 2 if role == 'assistant' else 0):06d}", f"x{k}"))
        df = spark.createDataFrame(rows, "transcript string, line long, role string, ts string, text string").repartition(5)
        got, count = _job_count(spark, f"pairs-{n}-{kind}-{asked_part}", lambda: pair_turns(df, partitions=8).collect())
        assert {(r.transcript, r.line): r.user_text for r in got} == _brute_pairs(rows)
        jobs.add(count)
    assert max(jobs) - min(jobs) <= 6, jobs  # AQE may plan a join another way, but no job per step back
