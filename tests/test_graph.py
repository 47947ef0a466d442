"""Neighbour descent and graph search: recall, copies, odd vectors, connected graphs, plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.operators.ann import recall_at_k
from turnlake.operators.graph import (
    graph_search, knn_graph_descent, link_graph, neighbour_graph, nodes_of, read_graph, write_graph,
)
from turnlake.operators.search import knn_graph, search_batch
from turnlake.plans import catalog
from turnlake.session import scratch_path
from turnlake.sources.tables import doc_records, table

from .paths import SF001, SF01


def queries_of(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def planted(spark, n=600, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dim))
    rows = centres[rng.integers(0, 20, n)] + 0.3 * rng.standard_normal((n, dim))
    rows[n // 2:n // 2 + n // 3] = rows[0]  # a third are copies of one
    data = [(int(k), f"r{k}", [float(x) for x in v]) for k, v in enumerate(rows)]
    return spark.createDataFrame(data, "seq long, id string, vector array<float>")


@pytest.mark.parametrize("folder", [SF001, SF01])
def test_recall_at_the_registered_parameters(spark, folder):
    recs = doc_records(spark, folder)
    found = catalog.queries()["graph_search"](spark, folder)
    assert recall_at_k(found, search_batch(recs, queries_of(spark, folder), 10)) >= 0.9
    assert recall_at_k(catalog.queries()["knn_graph_descent"](spark, folder), knn_graph(recs, 5)) >= 0.95


def test_copies_share_their_neighbours(spark):
    recs = planted(spark)
    exact = knn_graph(recs, 5)
    found = knn_graph_descent(recs.repartition(5), 5).persist()
    assert recall_at_k(found, exact) >= 0.95 and found.count() == 5 * 600
    rows = {(r.qid, r.rank): r for r in found.collect()}
    for r in exact.collect():  # the copies are all found, with the smallest seq first
        if r.qid == 0 or 300 <= r.qid < 500:
            assert rows[r.qid, r.rank].seq == r.seq and abs(rows[r.qid, r.rank].score - 1) < 1e-9


def test_a_stored_graph_reaches_every_node(spark):
    recs = planted(spark)
    nodes, members = nodes_of(recs)
    lists = neighbour_graph(nodes, 8, max_rounds=6)
    path = scratch_path(spark, "t-graph")
    write_graph(link_graph(lists, nodes, 8), nodes, members, path)
    graph, nodes, members = read_graph(spark, path)
    links = {r.node: r.nbrs for r in graph.collect()}
    assert len(links) == nodes.count() == 400 and members.count() == 600
    assert all(len(x) <= 18 and n not in x for n, x in links.items())
    reached, todo = {0}, [0]
    while todo:
        for n in links[todo.pop()]:
            if n not in reached:
                reached.add(n)
                todo.append(n)
    assert len(reached) == 400
    q = recs.where("seq % 10 = 0").select(F.col("seq").alias("qid"), "vector")
    exact = search_batch(recs, q, 7)
    assert recall_at_k(graph_search(graph, nodes, members, q, 7, beam=40, entries=3), exact) >= 0.95
    full = graph_search(graph, nodes, members, q, 7, beam=1000, entries=1)  # a beam of all nodes is exact
    key = lambda df: sorted((r.qid, r.rank, r.seq) for r in df.collect())
    assert key(full) == key(exact)


def test_vectors_without_a_direction(spark):
    recs = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 0.0]), (3, "c", None), (4, "d", [1.0, 0.1]), (5, "e", []),
                                  (6, "f", [1.0, 0.0]), (7, "g", [None, 1.0])], "seq long, id string, vector array<double>")
    got = sorted((r.qid, r.seq, r.rank) for r in knn_graph_descent(recs, 2).collect())
    assert got == [(1, 4, 2), (1, 6, 1), (4, 1, 1), (4, 6, 2), (6, 1, 1), (6, 4, 2), (7, 1, 2), (7, 4, 1)]
    nodes, members = nodes_of(recs)
    graph = link_graph(neighbour_graph(nodes, 4), nodes, 4)
    q = recs.select(F.col("id").alias("qid"), "vector")
    found = graph_search(graph, nodes, members, q, 2)
    assert {r.qid for r in found.collect()} == {"a", "d", "f", "g"}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "seq long, id string, vector array<double>")
    assert knn_graph_descent(empty, 3).count() == 0
    nodes, members = nodes_of(empty)
    graph = link_graph(neighbour_graph(nodes), nodes)
    q = spark.createDataFrame([(1, [1.0])], "qid long, vector array<double>")
    assert graph_search(graph, nodes, members, q, 3).count() == 0


def test_no_all_pairs_step(spark):
    for name in ("graph_search", "knn_graph_descent"):
        plan = catalog.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "FlatMapCoGroups" not in plan


def test_work_grows_with_rows_and_degree(spark, monkeypatch):
    """Vectors that a round moves: at most two lists' length for each node."""
    from turnlake.operators import graph as module

    moved = []
    plain = module._compare

    def counted(dim):
        run = plain(dim)
        total = spark.sparkContext.accumulator(0)
        moved.append(total)

        def count(batches):
            def seen():
                for b in batches:
                    total.add(len(b))
                    yield b
            yield from run(seen())

        return count

    monkeypatch.setattr(module, "_compare", counted)
    nodes, _ = nodes_of(planted(spark))
    module.neighbour_graph(nodes, 8, max_rounds=4)
    assert moved and all(0 < m.value <= 2 * 2 * 8 * 400 for m in moved)  # the pass may run twice
