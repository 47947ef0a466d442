"""Cells of exact and index searches: equal vectors are one row, a query goes once to a block of lists, vectors keep their width."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.operators import ann, knn
from turnlake.operators.dedup import duplicate_pairs
from turnlake.operators.search import knn_graph, related_batch, search_batch

from .test_graph import planted


def key(df):
    return sorted((r.qid, r.rank, r.seq, r.id, round(r.score, 9)) for r in df.collect())


def counted(spark, monkeypatch, module):
    """Pairs that the cells of ``module`` look at, and the queries that reach them."""
    pairs, queries, plain = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), knn.best_pairs

    def count(Qu, C, *args, **more):
        pairs.add(len(Qu) * len(C))
        queries.add(len(Qu))
        return plain(Qu, C, *args, **more)

    monkeypatch.setattr(module, "best_pairs", count)
    return pairs, queries


def test_duplicate_pairs_compare_distinct_vectors_only(spark, monkeypatch):
    recs = planted(spark)  # 600 records, 400 distinct vectors
    want = {(r.seq_a, r.seq_b, round(r.score, 9)) for r in duplicate_pairs(recs, 0.95, strategy="broadcast").collect()}
    pairs, _ = counted(spark, monkeypatch, knn)
    got = duplicate_pairs(recs, 0.95, strategy="blocked", block_rows=64).persist()
    assert {(r.seq_a, r.seq_b, round(r.score, 9)) for r in got.collect()} == want and want
    assert 0 < pairs.value <= 2 * 400 * 400  # the pass may run twice


def test_own_rows_are_left_out_for_each_record_of_a_vector(spark):
    recs = planted(spark)
    twice = recs.unionByName(recs.where("seq % 3 = 0")).unionByName(recs.where("seq = 3"))
    for rows in (recs, twice):
        assert key(knn_graph(rows, 4, strategy="blocked", block_rows=50)) == key(knn_graph(rows, 4, strategy="broadcast"))
    named = recs.withColumn("id", F.concat(F.lit("r"), F.lpad(F.col("seq").cast("string"), 4, "0")))
    prefixes = named.select(F.substring("id", 1, 4).alias("prefix")).distinct()
    assert key(related_batch(named, prefixes, 3, strategy="blocked", block_rows=50)) == key(related_batch(named, prefixes, 3))


def test_vectors_of_single_precision_numbers_are_sent_as_such(spark):
    recs = planted(spark)
    double = recs.withColumn("vector", F.col("vector").cast("array<double>"))
    kind = lambda df: knn.narrowed(df, "vector").schema["vector"].dataType.simpleString()
    assert kind(recs) == kind(double) == "array<float>"
    assert kind(double.withColumn("vector", F.transform("vector", lambda x: x / 3))) == "array<double>"
    odd = spark.createDataFrame([(1, None), (2, [None, float("nan")]), (3, [float("inf"), -0.5])], "seq long, vector array<double>")
    assert kind(odd) == "array<float>"
    q = double.select(F.col("seq").alias("qid"), "vector")
    assert key(search_batch(double, q, 6, strategy="blocked", block_rows=70)) == key(search_batch(double, q, 6, strategy="broadcast"))


def test_many_equal_scores_stay_few(monkeypatch):
    """Candidates of a chunk are bounded, and the first in order win."""
    monkeypatch.setattr(knn, "_COLUMNS", 64)
    C = np.tile([[0.6, 0.8]], (5000, 1))
    order = np.random.default_rng(1).permutation(5000)
    seen, plain = [], knn._Best.cut
    monkeypatch.setattr(knn._Best, "cut", lambda self: (seen.append(self.held), plain(self))[1])
    found = [x for _, x in knn.best_pairs(np.tile([[1.0, 0.0]], (100, 1)), C, order, 3, np.full(100, -np.inf))]
    qi, ci, _ = found[0]
    assert len(qi) == 300 and sorted(order[ci[:3]]) == [0, 1, 2] and max(seen) <= (1 << 15) + 100 * 64


def probed_by_hand(rows, queries, centroids, nprobe, k, exclude_self):
    unit = lambda x: np.array([np.asarray(v) / (np.linalg.norm(v) or 1) for v in x], dtype=np.float64)
    R, Q = unit([r.vector for r in rows]), unit([q.vector for q in queries])
    C = unit(centroids)
    out = []
    for q, u in zip(queries, Q, strict=True):
        lists = set(np.argsort(-(C @ u), kind="stable")[:nprobe].tolist())
        near = sorted((-round(float(R[i] @ u), 9), r.seq) for i, r in enumerate(rows)
                      if r.list_id in lists and not (exclude_self and r.seq == q.qid))[:k]
        out += [(q.qid, rank, seq, f"r{seq}", -score) for rank, (score, seq) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("nprobe, exclude_self", [(1, False), (3, True), (7, False), (8, True)])
def test_a_query_is_sent_once_to_a_block_of_lists(spark, monkeypatch, nprobe, exclude_self):
    recs = planted(spark)
    index, centroids = ann.build_index(recs, 9, rounds=2)
    index = index.persist()
    q = recs.where("seq % 2 = 0").select(F.col("seq").alias("qid"), "vector")
    pairs, queries = counted(spark, monkeypatch, ann)
    found = ann.ann_search(index, centroids, q, 4, nprobe, exclude_self=exclude_self, block_rows=200).persist()
    want = probed_by_hand(index.collect(), q.collect(), centroids, nprobe, 4, exclude_self)
    assert key(found) == want
    # 400 vectors make about 2 blocks of 200, where a row for each query and list would make up to 8
    assert 0 < queries.value <= 2 * 3 * q.count()


def test_lists_over_the_bound_are_cut(spark):
    recs = planted(spark)
    index, centroids = ann.build_index(recs, 4, rounds=2)
    q = recs.select(F.col("seq").alias("qid"), "vector")
    few, many = (ann.ann_search(index, centroids, q, 5, 3, block_rows=n) for n in (16, 10**6))
    assert key(few) == key(many)


def test_blocks_hold_near_lists_and_keep_the_bound():
    rng = np.random.default_rng(4)
    centres = np.repeat(np.eye(4), 25, axis=0) + 0.05 * rng.standard_normal((100, 4))
    sizes = {int(x): int(n) for x, n in zip(rng.permutation(100), rng.integers(1, 40, 100), strict=True)} | {7: 5000}
    blocks = ann.list_blocks(centres, sizes, 300)
    assert sorted(x for b in blocks for x in b) == list(range(100))
    assert all(sum(sizes[x] for x in b) <= 300 or b == [7] for b in blocks)
    # a near group of 25 lists lies in few blocks
    assert max(sum(any(x // 25 == g for x in b) for b in blocks) for g in range(4)) <= len(blocks) // 2 + 1


def test_marks_of_lists_packed_both_ways():
    rng = np.random.default_rng(5)
    marks = rng.random((20, 77)) < 0.1
    for sparse in (True, False):
        assert (ann._unpacked(ann._packed(marks, sparse), 77, sparse) == marks).all()
    centres = rng.standard_normal((30, 5))
    centres[3], centres[9] = np.nan, centres[8]
    rows = np.vstack([rng.standard_normal((40, 5)), np.zeros((1, 5))])
    for n in (1, 4, 29):
        near, order = ann.nearest_lists(rows, centres, n), ann.list_order(rows, centres)
        assert all(set(np.flatnonzero(m)) == set(o[:n]) for m, o in zip(near, order, strict=True))
