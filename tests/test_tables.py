"""Table changes, exports, facets and plan-shape checks."""

import os

from pyspark.sql import functions as F

from .paths import SF001
from turnlake.operators.facets import tag_facets
from turnlake.operators.mutate import delete_by_prefix, merge_new, update_by_prefix
from turnlake.operators.search import hybrid_search, search_batch
from turnlake.operators.timeline import session_summaries
from turnlake.session import scratch_path
from turnlake.sources.files import read_json_entries
from turnlake.sources.sinks import CSV_HEADER, write_csv, write_json
from turnlake.sources.tables import doc_records, table, turn_records


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_twice_adds_nothing(spark):
    recs = doc_records(spark, SF001)
    local, remote = recs.where(F.array_contains("tags", "en")), recs.where(F.array_contains("tags", "fr"))
    merged, counts = merge_new(local, remote)
    c = counts.first()
    assert c.added == remote.count() and c.total == local.count() + remote.count()
    again, counts2 = merge_new(merged, remote)
    assert counts2.first().added == 0
    assert merged.select("seq").distinct().count() == merged.count()


def test_update_first_match_and_delete_all(spark):
    recs = doc_records(spark, SF001)
    ups = spark.createDataFrame([(1, "d0000001", "new", []), (2, "zzz", "none", ["t"])],
                                "useq long, prefix string, text string, tags array<string>")
    out, unmatched = update_by_prefix(recs, ups, 42)
    changed = out.where(F.col("timestamp") == 42).collect()
    assert [(r.id, r.text) for r in changed] == [("d00000010", "new")]
    assert changed[0].tags == recs.where("id = 'd00000010'").first().tags  # empty tags keep old ones
    assert [r.prefix for r in unmatched.collect()] == ["zzz"]
    pre = spark.createDataFrame([("d0000001",), ("d00000012",), ("d000001",), ("q",)], "prefix string")
    rem, counts = delete_by_prefix(recs, pre)
    # overlapping prefixes: every match counted per prefix, each record removed once
    assert dict((r.prefix, r.deleted) for r in counts.collect()) == {"d0000001": 10, "d00000012": 1, "d000001": 100, "q": 0}
    assert rem.count() == recs.count() - 110


def test_export_roundtrip_and_csv(spark):
    recs = doc_records(spark, SF001)
    p = scratch_path(spark, "t-json")
    write_json(recs, p)
    back = read_json_entries(spark, p, json_lines=True)
    assert back.join(recs, ["id", "text", "tags"]).count() == recs.count()
    c = scratch_path(spark, "t-csv")
    write_csv(recs.where("seq < 3"), c)
    files = sorted(f for f in os.listdir(c.replace("file:", "")) if f.startswith("part-"))
    text = "".join(open(os.path.join(c.replace("file:", ""), f), encoding="utf-8").read() for f in files)
    first = text.split("\n")[0]
    assert first == CSV_HEADER and text.count('\n"d0000000') == 3


def test_facets_sum_to_tag_total(spark):
    recs = doc_records(spark, SF001)
    total = recs.select(F.sum(F.size("tags"))).first()[0]
    assert tag_facets(recs).select(F.sum("count")).first()[0] == total


def test_session_tie_first_inserted(spark):
    rows = [
        (2, "", "b", '{"hook_event_name":"UserPromptSubmit","prompt":"second","session_id":"s"}', None, 10, ["prompt"]),
        (1, "", "a", '{"hook_event_name":"UserPromptSubmit","prompt":"first","session_id":"s"}', None, 10, ["prompt"]),
        (3, "", "c", '{"hook_event_name":"Stop","response":"r","session_id":"s"}', None, 99, ["response"]),
    ]
    df = spark.createDataFrame(rows, "seq long, ns string, id string, text string, vector array<float>, timestamp long, tags array<string>")
    r = session_summaries(df).first()
    # responses move neither count nor last_ts; ties go to the first inserted
    assert (r["count"], r.first_ts, r.last_ts, r.first_prompt) == (2, 10, 10, "first")


def test_plan_shapes(spark):
    recs = doc_records(spark, SF001)
    qv = [float(x) for x in table(spark, SF001, "embeddings").where("vec_id = 7").first().embedding]
    hs = hybrid_search(recs, qv, "the", top=5, tags=["en"], after=1704153600)
    assert "TakeOrderedAndProject" in _plan(hs)
    q = table(spark, SF001, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    sb = search_batch(recs, q, 5)
    sb.collect()
    assert "WindowGroupLimit" in _plan(sb)
    # time filter reaches the Parquet scan of a stored record table
    p = scratch_path(spark, "t-parquet")
    recs.write.parquet(p)
    stored = spark.read.parquet(p)
    hs2 = hybrid_search(stored, qv, "the", top=5, after=1704153600, before=1706227200)
    plan = _plan(hs2)
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp,1704153600)" in plan


def test_no_cartesian_in_lsh_or_prefix_plans(spark):
    from turnlake.operators.dedup import duplicate_pairs_lsh

    recs = doc_records(spark, SF001)
    d = duplicate_pairs_lsh(recs, 0.95)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "CartesianProduct" not in _plan(d)
    pre = spark.createDataFrame([("d0000001",)], "prefix string")
    rem, _ = delete_by_prefix(recs, pre)
    assert "NestedLoop" not in _plan(rem)


def test_turn_records_sessions(spark):
    s = session_summaries(turn_records(spark, SF001))
    assert s.count() == 20


def test_record_table_namespaces(spark):
    from turnlake.sources.tables import read_records, write_records

    recs = doc_records(spark, SF001)
    two = recs.withColumn("ns", F.when(F.col("seq") < 50, F.lit("work")).otherwise(F.lit("")))
    p = scratch_path(spark, "t-records")
    write_records(two, p)
    work = read_records(spark, p, "work")
    assert work.count() == 50
    assert "PartitionFilters: [isnotnull(ns" in _plan(work) and "(ns#" in _plan(work)
    assert read_records(spark, p).count() == recs.count()


def test_prefixes_joined_by_a_shuffle_give_the_same(spark, monkeypatch):
    from turnlake.operators import mutate

    recs = doc_records(spark, SF001)
    prefixes = spark.createDataFrame([("d0000001",), ("d0000005",), ("d00000017",), ("none",)], "prefix string")
    want = sorted(r.id for r in mutate.delete_by_prefix(recs, prefixes)[0].select("id").collect())
    monkeypatch.setattr(mutate, "BROADCAST_PREFIXES", 2)
    got = sorted(r.id for r in mutate.delete_by_prefix(recs, prefixes)[0].select("id").collect())
    assert got == want and 0 < len(got) < recs.count()


def test_updates_of_one_record_act_in_order(spark):
    recs = spark.createDataFrame([("", "abc1", 0, "old", None, 1, ["orig"]), ("", "abd2", 1, "other", None, 1, ["keep"])],
                                 "ns string, id string, seq long, text string, vector array<float>, timestamp long, tags array<string>")
    ups = spark.createDataFrame([(1, "abc", "first", ["x"]), (2, "abc", "second", []), (3, "zzz", "none", ["y"]), (4, "abd", "t", None)],
                                "useq long, prefix string, text string, tags array<string>")
    out, unmatched = update_by_prefix(recs, ups, 9)
    got = {r.id: (r.text, r.tags, r.timestamp) for r in out.collect()}
    assert got == {"abc1": ("second", ["x"], 9), "abd2": ("t", ["keep"], 9)}
    assert [r.useq for r in unmatched.collect()] == [3]
