"""What moves grows with the input: blocks of pairs, index files, vectors of graph walks, pieces of files."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from turnlake.operators import ann, graph, knn
from turnlake.operators.search import knn_graph, search_batch
from turnlake.plans import q_sources
from turnlake.session import scratch_path
from turnlake.sources import splitting

from .paths import SF001
from .test_graph import planted


def _key(df):
    return sorted((r.qid, r.rank, r.seq, round(r.score, 9)) for r in df.collect())


def test_blocks_grow_with_the_input():
    for n in (10**5, 10**6, 3 * 10**6):
        assert n / knn.grid_rows(n, n, 256) <= max(16, n / knn.MAX_BLOCK_ROWS)
    assert knn.grid_rows(2000, 2000, 256) == 256 and knn.grid_rows(10**9, 10**9, 256) == knn.MAX_BLOCK_ROWS


def test_copies_in_blocks_equal_broadcast(spark):
    recs = planted(spark)
    q = recs.select(F.col("seq").alias("qid"), "vector")
    assert _key(search_batch(recs, q, 7, strategy="blocked", block_rows=50)) == _key(search_batch(recs, q, 7, strategy="broadcast"))
    twice = recs.unionByName(recs.where("seq % 3 = 0"))
    assert _key(knn_graph(twice, 7, strategy="blocked", block_rows=50)) == _key(knn_graph(twice, 7, strategy="broadcast"))


def test_scores_within_single_precision_are_ranked_in_double():
    base = np.zeros((1, 8))
    base[0, 0] = 1.0
    tilt = np.linspace(1e-4, 5e-4, 3000)[np.random.default_rng(0).permutation(3000)]
    rows = np.zeros((3000, 8))
    rows[:, 0], rows[:, 1] = np.cos(tilt), np.sin(tilt)
    corpus = pd.DataFrame({"seq": np.arange(3000)})
    floor = np.full(1, -np.inf)
    got = pd.concat(knn._score_pairs(base, np.array([0]), None, rows, corpus, ["seq"], None, "seq", 5, False, floor=floor))
    want = np.lexsort((np.arange(3000), -np.round(rows[:, 0], 9)))[:5]
    assert got["seq"].tolist() == want.tolist() and floor[0] <= got["score"].min()


def test_a_full_probe_makes_no_row_for_each_query_and_list(spark, monkeypatch):
    recs = planted(spark)
    rows, centroids = ann.build_index(recs, 9, rounds=2)
    q = recs.where("seq % 20 = 0").select(F.col("seq").alias("qid"), "vector")
    monkeypatch.setattr(ann, "probe_lists", None)
    assert _key(ann.ann_search(rows, centroids, q, 4, nprobe=9)) == _key(search_batch(recs, q, 4))


def test_files_of_an_index_grow_with_lists_not_tasks(spark):
    rows, _ = ann.build_index(planted(spark).repartition(12), 5, rounds=2)
    path = scratch_path(spark, "t-files")
    ann.write_index(rows, path)
    stored = ann.read_index(spark, path)
    assert len(stored.inputFiles()) <= 5 and stored.count() == 600


def test_walks_of_a_block_share_vectors(spark, monkeypatch):
    recs = planted(spark)
    nodes, members = graph.nodes_of(recs)
    links = graph.link_graph(graph.neighbour_graph(nodes, 8, max_rounds=4), nodes, 8)
    moved, rounds, plain = spark.sparkContext.accumulator(0), [], graph._walk

    def counted(dim, beam):
        run = plain(dim, beam)
        rounds.append(dim)

        def walk(state, rows):
            moved.add(int(rows["vector"].notna().sum()))
            return run(state, rows)

        return walk

    monkeypatch.setattr(graph, "_walk", counted)
    q = recs.select(F.col("seq").alias("qid"), "vector")
    found = graph.graph_search(links, nodes, members, q, 5, beam=16)
    assert found.select("qid").distinct().count() == 600
    assert 0 < moved.value <= 2 * 400 * len(rounds)  # one block of 600 queries, 400 nodes; a pass may run twice


def test_pairs_are_cut_to_what_a_list_can_hold():
    pairs = pd.DataFrame({"node": [1] * 9 + [2], "nbr": range(10), "score": [0.1 * k for k in range(9)] + [0.5]})
    got = next(graph._within(2, lambda batches: batches)(iter([pairs])))
    assert sorted(zip(got["node"], got["nbr"], strict=True)) == [(1, 5), (1, 6), (1, 7), (1, 8), (2, 9)]


def test_csv_in_several_files(spark, monkeypatch):
    key = lambda: sorted((r.text, r.tags) for r in q_sources.q_ingest_csv_split(spark, SF001).collect())
    whole, paths = key(), []
    plain = q_sources.scratch_path
    monkeypatch.setattr(q_sources, "scratch_path", lambda s, name: paths.append(plain(s, name)) or paths[-1])
    monkeypatch.setattr(q_sources, "CSV_FILE_BYTES", 30_000)
    assert key() == whole
    assert len(spark.read.text(paths[0]).inputFiles()) > 3


def test_records_leave_a_task_in_small_batches():
    lines = ['"' + "x" * 5000 + '",a'] * 2000
    batch = pa.RecordBatch.from_pydict({"file": ["f"] * 2000, "start": [0] * 2000, "at": list(range(2000)), "odd": [False] * 2000, "value": lines})
    out = list(splitting._in_arrow(splitting._csv_records)(iter([batch])))
    assert sum(b.num_rows for b in out) == 2000
    assert all(b.nbytes <= 2 * splitting.OUT_BYTES for b in out)
