"""Streaming capture keeps late-but-new rows (only replays are skipped); pairing state."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from turnlake.session import scratch_path
from turnlake.streaming.capture import TURN_EVENT_SCHEMA, capture_stream, write_batch
from turnlake.streaming.pairing import current_pairs, pair_stream, turns_from_events


def _write(path, rows, name):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
    time.sleep(0.05)


def _ev(i, sid, role, text, ts, line):
    return {"event_id": f"e{i}", "session_id": sid, "role": role, "text": text, "ts": ts, "line": line, "cwd": "/w"}


def test_capture_keeps_late_rows_and_skips_replays(spark):
    src = scratch_path(spark, "t-ev").replace("file:", "")
    _write(src, [_ev(1, "s1", "user", "hi", 10_000_000, 0), _ev(2, "s1", "assistant", "yo", 10_000_000, 1)], "a.json")
    _write(src, [_ev(3, "s2", "user", "old but new", 1_000, 0)], "b.json")           # hours late
    _write(src, [_ev(1, "s1", "user", "hi", 10_000_000, 0), _ev(4, "s2", "system", "n", 1_000, 1)], "c.json")  # replay + new
    sink, chk = scratch_path(spark, "t-sink"), scratch_path(spark, "t-chk")
    ev = spark.readStream.schema(TURN_EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(src)
    capture_stream(ev, sink, chk).awaitTermination()
    out = spark.read.parquet(sink)
    assert sorted(r.id for r in out.collect()) == ["e1", "e2", "e3", "e4"]
    assert out.select("seq").distinct().count() == 4
    # a second run over the same files (restarted query, new checkpoint) adds nothing
    capture_stream(spark.readStream.schema(TURN_EVENT_SCHEMA).json(src), sink, scratch_path(spark, "t-chk2")).awaitTermination()
    assert spark.read.parquet(sink).count() == 4


def test_pairing_state_across_triggers(spark):
    src = scratch_path(spark, "t-ev2").replace("file:", "")
    _write(src, [_ev(1, "s", "user", "q1", 100, 0)], "a.json")
    _write(src, [_ev(2, "s", "assistant", "a1", 100, 1), _ev(3, "s", "assistant", "a2", 160, 2)], "b.json")
    _write(src, [_ev(4, "s", "user", "q2", 220, 3), _ev(5, "s", "assistant", "a3", 230, 4)], "c.json")
    ev = (spark.readStream.schema(TURN_EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(src)
          .withColumn("event_time", F.timestamp_seconds("ts")))
    sink, chk = scratch_path(spark, "t-pairs"), scratch_path(spark, "t-pchk")
    q = (pair_stream(turns_from_events(ev)).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", chk).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.line, r.user_text, r.assistant_text) for r in spark.read.parquet(sink).collect())
    assert got == [(1, "q1", "a1"), (2, "q1", "a2"), (4, "q2", "a3")]


def test_capture_of_events_without_ids_tags_and_prompts(spark):
    src = scratch_path(spark, "t-ev4").replace("file:", "")
    bare = [dict(_ev(0, "s1", "user", f"q{k}", 1_000 + k, k), event_id=None) for k in range(3)]
    odd = [_ev(8, "s1", "user", "<ide_x>f</ide_x>\n real", 2_000, 5), _ev(9, "s1", "user", "<ide_x>only</ide_x> ", 2_001, 6),
           _ev(10, "s1", "assistant", "later line", 3_000, 8), _ev(10, "s1", "assistant", "first line", 3_000, 7)]
    _write(src, bare + odd, "a.json")
    sink, rejects = scratch_path(spark, "t-sink4"), scratch_path(spark, "t-rej4")
    _write(src, [_ev(20, "s1", "note", "", 4_000, 9)], "b.json")
    for run in range(2):  # the second run replays everything under a new checkpoint
        events = spark.readStream.schema(TURN_EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(src)
        capture_stream(events, sink, scratch_path(spark, "t-chk4"), rejects).awaitTermination()
    out = spark.read.parquet(sink).collect()
    assert len(out) == 5 and len({r.id for r in out}) == 5
    assert {json.loads(r.text).get("prompt") for r in out} == {"q0", "q1", "q2", "real", None}
    assert [json.loads(r.text)["response"] for r in out if r.id == "e10"] == ["first line"]
    assert [r.reject_reason for r in spark.read.parquet(rejects).collect()] == ["empty_text"]


def _paired(spark, files):
    src = scratch_path(spark, "t-ev5").replace("file:", "")
    for k, rows in enumerate(files):
        _write(src, rows, f"{k}.json")
    events = (spark.readStream.schema(TURN_EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(src)
              .withColumn("event_time", F.timestamp_seconds("ts")))
    sink = scratch_path(spark, "t-pairs5")
    (pair_stream(turns_from_events(events)).writeStream.format("parquet").option("path", sink)
     .option("checkpointLocation", scratch_path(spark, "t-pchk5")).outputMode("append").trigger(availableNow=True).start()
     .awaitTermination())
    return sorted((r.transcript, r.line, r.user_text, r.assistant_text) for r in current_pairs(spark.read.parquet(sink)).collect())


def test_pairing_of_turns_out_of_order(spark):
    got = _paired(spark, [[_ev(0, "s", "user", "q0", 100, 0)],
                          [_ev(2, "s", "user", "q2", 120, 2), _ev(3, "s", "assistant", "a3", 125, 3)],
                          [_ev(1, "s", "assistant", "a1", 110, 1)]])
    assert got == [("s", 1, "q0", "a1"), ("s", 3, "q2", "a3")]
    got = _paired(spark, [[_ev(1, "s", "assistant", "a1", 110, 1)], [_ev(0, "s", "user", "q0", 100, 0)]])
    assert got == [("s", 1, "q0", "a1")]  # given out with no user turn first, then again


def test_pairing_after_a_long_rest_and_a_replay(spark):
    far = 100 + 4 * 3600
    first = [_ev(0, "s", "user", "q1", 100, 0), _ev(1, "s", "assistant", "a1", 101, 1)]
    got = _paired(spark, [first, [_ev(5, "x", "user", "u", far, 0)], [_ev(6, "x", "user", "u", far + 5, 1)], first,
                          [_ev(2, "s", "assistant", "a2", far, 2)]])
    assert got == [("s", 1, "q1", "a1"), ("s", 2, "q1", "a2")]


def _batch(spark, ids, text="x"):
    return spark.createDataFrame([(f"e{i}", "s", "user", f"{text} {i}", 1000 + i, i, "/w") for i in ids], TURN_EVENT_SCHEMA)


def _stored(spark, sink):
    return sorted(int(r.id[1:]) for r in spark.read.parquet(sink).collect())


def test_a_batch_reads_its_own_parts_of_the_id_index(spark, monkeypatch):
    from turnlake.streaming import capture

    sink = scratch_path(spark, "t-sink-ids")
    write_batch(_batch(spark, range(300)), 0, sink)
    read, sinks = [], []
    plain, stored = capture.IdIndex.read, capture._existing_ids
    monkeypatch.setattr(capture.IdIndex, "read", lambda self, parts: read.append(plain(self, parts)) or read[-1])
    monkeypatch.setattr(capture, "_existing_ids", lambda *a: sinks.append(a) or stored(*a))
    write_batch(_batch(spark, [5, 1000]), 1, sink)
    assert _stored(spark, sink) == [*range(300), 1000] and not sinks  # the sink itself isn't read
    parts = {r.p for r in _batch(spark, [5, 1000]).select(capture.id_part("event_id").alias("p")).collect()}
    files = [r[0] for r in read[0].select(F.input_file_name()).distinct().collect()]
    assert len(parts) <= 2 and files and {int(f.split("part=")[1].split("/")[0]) for f in files} <= parts
    plan = read[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part#" in plan or "PartitionFilters: [isnotnull(part" in plan, plan


@pytest.mark.parametrize("cut", ["sink", "index", "end"])
def test_a_crash_between_the_writes_stores_every_id_once(spark, monkeypatch, cut):
    from turnlake.streaming import capture

    sink = scratch_path(spark, "t-sink-cut")
    write_batch(_batch(spark, range(20)), 0, sink)

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        if cut == "sink":
            m.setattr(capture, "with_seq", lost)
        else:
            m.setattr(capture.IdIndex, {"index": "append", "end": "end"}[cut], lost)
        with pytest.raises(OSError):
            write_batch(_batch(spark, range(15, 40)), 1, sink)
    write_batch(_batch(spark, range(15, 40)), 1, sink)  # the batch is run again
    assert _stored(spark, sink) == list(range(40))
    with monkeypatch.context() as m:
        m.setattr(capture.IdIndex, "append", lost)
        with pytest.raises(OSError):
            write_batch(_batch(spark, range(40, 50)), 0, sink)  # another stream, whose batches begin at 0 again
    write_batch(_batch(spark, range(40, 55)), 0, sink)
    write_batch(_batch(spark, range(0, 60)), 2, sink)
    write_batch(_batch(spark, []), 3, sink)
    assert _stored(spark, sink) == list(range(60))


def test_a_large_batch_is_joined_by_a_shuffle(spark, monkeypatch):
    from turnlake.streaming import capture

    sink = scratch_path(spark, "t-sink-wide")
    write_batch(_batch(spark, range(20)), 0, sink)
    monkeypatch.setattr(capture, "BROADCAST_BATCH_IDS", 3)
    write_batch(_batch(spark, range(10, 40)), 1, sink)
    assert _stored(spark, sink) == list(range(40))


def test_a_sink_without_an_index_gets_one(spark):
    from turnlake.streaming.capture import IdIndex

    first, sink = scratch_path(spark, "t-sink-old"), scratch_path(spark, "t-sink-old")
    write_batch(_batch(spark, range(30)), 0, first)
    spark.read.parquet(first).write.parquet(sink)
    write_batch(_batch(spark, range(25, 35)), 1, sink)
    assert _stored(spark, sink) == list(range(35))
    assert IdIndex(spark, sink).read(list(range(16))).select("id").distinct().count() == 35


def test_a_long_session_is_merged_in_one_pass():
    import pandas as pd

    from turnlake.streaming.pairing import _pair_group

    class State:
        exists, held = False, None

        @property
        def get(self):
            return self.held

        def getCurrentWatermarkMs(self):
            return 0

        def update(self, value):
            self.exists, self.held = True, value

    n = 100_000
    pdf = pd.DataFrame({"line": range(n), "id": [f"e{k}" for k in range(n)], "role": ["user" if k % 2 == 0 else "assistant" for k in range(n)],
                        "ts": [f"t{k:07d}" for k in range(n)], "text": [f"x{k}" for k in range(n)], "et": [k * 1000 for k in range(n)]})
    state, began = State(), time.time()
    first = pd.concat(list(_pair_group(("s",), [pdf.iloc[:n - 10]], state)))
    more = pd.concat(list(_pair_group(("s",), [pdf.iloc[n - 10:]], state)))
    assert time.time() - began < 20
    assert len(first) == (n - 10) // 2 and len(more) == 5
    assert (first["user_text"] == ["x" + str(k - 1) for k in first["line"]]).all() and more["user_text"].iloc[-1] == f"x{n - 2}"
