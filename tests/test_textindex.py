"""The trigram index against a scan of all texts."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnlake.functions.text import keyword_score, tokenize_py
from turnlake.operators import textindex
from turnlake.operators.textindex import build_trigrams, candidates, keyword_rank_indexed, read_trigrams, write_trigrams
from turnlake.session import scratch_path

TEXTS = ["Abc abd", "", None, "ab", "a", "xabcx ABD", "日本語 abc", "日", "aaaa", "aa", "b\x00c", "İstanbul IS", "no match here"]


def scanned(records, query, top):
    score = keyword_score("text", tokenize_py(query))
    rows = records.select("seq", F.coalesce(score, F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "seq").limit(top)
    return [(r.seq, r.score) for r in rows.orderBy(F.desc("score"), "seq").collect()]


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(4)
    words = ["abc", "abd", "bcd", "the", "thé", "日本", "x1", "zz", "longer", "longest"]
    rows = list(enumerate(TEXTS)) + [(100 + 9000 * k, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for k in range(80)]
    records = spark.createDataFrame(rows, "seq long, text string").repartition(4)
    path = scratch_path(spark, "t-trigrams")
    write_trigrams(build_trigrams(records), path)
    return records, read_trigrams(spark, path)


@pytest.mark.parametrize("query", ["abc", "ABC abd", "ab", "aa aa bc", "日", "日本 語", "longe longest the zz", "i̇stanbul is", "nothing", "",
                                   "a b c", "aaaa aaaaa", "match here", "x1"])
@pytest.mark.parametrize("top", [3, 20])
def test_ranks_equal_a_scan(stored, query, top):
    records, index = stored
    got = [(r.seq, r.score) for r in keyword_rank_indexed(records, index, query, top).orderBy("rank").collect()]
    assert got == scanned(records, query, top)


def test_candidates_hold_every_match_and_little_else(stored):
    records, index = stored
    for word in ("abc", "ab", "日", "longest", "é"):
        have = {r.seq for r in records.where(F.contains(F.lower("text"), F.lit(word))).collect()}
        named = {r.seq for r in candidates(index, [word]).collect()}
        assert have <= named and (len(word) > 3 or have == named)
    assert candidates(index, []).count() == 0


def test_lists_are_bounded_and_pruned(stored, spark):
    _, index = stored
    assert index.where(F.size("ids") > textindex.BLOCK).count() == 0
    assert index.groupBy("gram", "block").count().where("count > 1").count() == 0
    plan = candidates(index, ["longer", "ab"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "StringStartsWith(gram,ab)" in plan


def test_only_the_levels_needed_are_read(stored, monkeypatch):
    records, index = stored
    read = []
    plain = textindex.keyword_score
    monkeypatch.setattr(textindex, "keyword_score", lambda *a: read.append(1) or plain(*a))
    keyword_rank_indexed(records, index, "abc the longest", 1).collect()
    assert len(read) < 3


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], "seq long, text string")
    index = build_trigrams(empty)
    assert index.count() == 0 and keyword_rank_indexed(empty, index, "some words", 5).count() == 0
