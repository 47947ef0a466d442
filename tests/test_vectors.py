"""Vector operators against brute force (rules 2.12-7, -10, -11; SURVEY 5.2 properties)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from .paths import SF001, SF01
from turnlake.operators.ann import ann_search, build_index, recall_at_k
from turnlake.operators.cluster import kmeans
from turnlake.operators.dedup import duplicate_pairs, duplicate_pairs_lsh, removal_flags
from turnlake.operators.knn import topk_neighbors
from turnlake.operators.search import hybrid_search, knn_graph, search_batch, semantic_topk
from turnlake.sources.tables import doc_records, table


def _recs(spark, vecs, ts=None):
    rows = [(i, "", f"r{i:03d}", f"t{i}", [float(x) for x in v], (ts[i] if ts else 100), []) for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "seq long, ns string, id string, text string, vector array<float>, timestamp long, tags array<string>")


def _np_topk(Q, C, k, exclude_same=False):
    Qn = Q / np.maximum(np.linalg.norm(Q, axis=1, keepdims=True), 1e-300)
    Cn = C / np.maximum(np.linalg.norm(C, axis=1, keepdims=True), 1e-300)
    S = Qn @ Cn.T
    out = {}
    for i in range(len(Q)):
        order = sorted(range(len(C)), key=lambda j: (-round(S[i, j], 9), j))
        if exclude_same:
            order = [j for j in order if j != i]
        out[i] = order[:k]
    return out


@pytest.mark.parametrize("strategy", ["broadcast", "blocked"])
def test_topk_kernel_matches_numpy(spark, strategy):
    rng = np.random.default_rng(3)
    C = rng.standard_normal((300, 16)).astype(np.float32)
    C[5] = 0.0  # zero vector scores 0
    C[7] = C[8]  # exact tie broken by seq
    recs = _recs(spark, C)
    got = knn_graph(recs, 4, strategy=strategy, block_rows=64).collect()
    exp = _np_topk(C.astype(np.float64), C.astype(np.float64), 4, exclude_same=True)
    by_q = {}
    for r in got:
        by_q.setdefault(r.qid, []).append((r.rank, r.seq))
    assert {q: [s for _, s in sorted(v)] for q, v in by_q.items()} == exp


def test_batch_of_one_equals_single_query(spark):
    recs = doc_records(spark, SF001)
    q = table(spark, SF001, "embeddings").where("vec_id = 7").select(F.lit(7).alias("qid"), F.col("embedding").alias("vector"))
    qv = [float(x) for x in q.first().vector]
    a = [(r.seq, round(r.score, 9)) for r in semantic_topk(recs, qv, 10).orderBy("rank").collect()]
    b = [(r.seq, round(r.score, 9)) for r in search_batch(recs, q, 10).orderBy("rank").collect()]
    assert a == b


def test_candidate_pool_can_return_fewer(spark):
    recs = doc_records(spark, SF001)
    qv = [float(x) for x in table(spark, SF001, "embeddings").where("vec_id = 7").first().embedding]
    full = hybrid_search(recs, qv, "in the", top=10, tags=["de"], alpha=0.5)
    pool = hybrid_search(recs, qv, "in the", top=10, tags=["de"], alpha=0.5, candidate_pool=10)
    assert full.count() == 10 and pool.count() < 10
    with pytest.raises(ValueError):
        hybrid_search(recs, qv, "x", top=0)
    with pytest.raises(ValueError):
        hybrid_search(recs, qv, "x", alpha=1.5)


def test_seven_equal_vectors_capped_rule(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8)
    vecs = [base] * 7 + list(rng.standard_normal((20, 8)))
    recs = _recs(spark, vecs)
    exact = {(r.seq_a, r.seq_b) for r in duplicate_pairs(recs, 0.95).collect()}
    # each copy sees itself + the 4 lowest others: pairs = (i, j) with j among the 5 lowest
    expect = {(min(i, j), max(i, j)) for i in range(7) for j in range(5) if i != j}
    assert exact == expect and len(exact) < 21  # the uncapped rule would give all 21 pairs
    lsh = {(r.seq_a, r.seq_b) for r in duplicate_pairs_lsh(recs, 0.95).collect()}
    assert lsh == exact


def test_lsh_equals_exact_on_fixture(spark):
    recs = doc_records(spark, SF001)
    a = {(r.seq_a, r.seq_b, round(r.score, 6)) for r in duplicate_pairs(recs, 0.95).collect()}
    b = {(r.seq_a, r.seq_b, round(r.score, 6)) for r in duplicate_pairs_lsh(recs, 0.95).collect()}
    assert len(a) == 61 and a == b


def test_lsh_hot_bucket_goes_exact(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8)
    vecs = [base + 0.01 * rng.standard_normal(8) for _ in range(30)] + list(rng.standard_normal((10, 8)))
    recs = _recs(spark, vecs)
    a = {(r.seq_a, r.seq_b) for r in duplicate_pairs(recs, 0.95).collect()}
    b = {(r.seq_a, r.seq_b) for r in duplicate_pairs_lsh(recs, 0.95, block_rows=5).collect()}
    assert a == b and len(a) > 0


def test_removal_rule(spark):
    v = [1.0, 0.0]
    recs = _recs(spark, [v, v, v], ts=[5, 5, 9])
    pairs = duplicate_pairs(recs, 0.95)
    # (0,1) equal ts -> lower index 0; (0,2) -> 2 newer; (1,2) -> 2
    assert sorted(r.seq for r in removal_flags(recs, pairs).collect()) == [0, 2]


def _np_kmeans(V, k):
    n = len(V)
    k = min(k, n)
    C = np.array([V[i * n // k] for i in range(k)], dtype=np.float64)
    a = np.zeros(n, dtype=int)

    def assign(C):
        U = V / np.maximum(np.linalg.norm(V, axis=1, keepdims=True), 1e-300)
        Cu = C / np.maximum(np.linalg.norm(C, axis=1, keepdims=True), 1e-300)
        S = U @ Cu.T
        return k - 1 - np.argmax(S[:, ::-1], axis=1)

    for _ in range(30):
        b = assign(C)
        if (b == a).all():
            break
        a = b
        for c in range(k):
            m = V[a == c]
            if len(m):
                C[c] = m.mean(axis=0)
    return a


def test_kmeans_matches_numpy_model(spark):
    e = table(spark, SF001, "embeddings").orderBy("vec_id")
    V = np.array([r.embedding for r in e.collect()], dtype=np.float64)
    recs = e.select(F.col("vec_id").alias("seq"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    got = {r.seq: r.cluster for r in kmeans(recs, 5).collect()}
    exp = _np_kmeans(V, 5)
    assert [got[i] for i in range(len(V))] == list(exp)


def _grouped(n, groups, dim, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    V = centres[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, dim))
    V[5] = V[17] = 0.0  # zero vectors tie everywhere
    V[40] = V[41] = V[42]  # copies
    return V


def test_bounded_kmeans_scores_fewer_rows(spark):
    from turnlake.operators.cluster import assign_clusters, bounded_rounds, initial_centroids, kmeans_fit

    V = _grouped(600, 6, 12)
    recs = _recs(spark, V.tolist())
    C0, k, _ = initial_centroids(recs, 6)
    C, rounds, scored = bounded_rounds(recs, C0, 30)
    P, plain = kmeans_fit(recs, 6)
    assert rounds == plain == len(scored) and np.allclose(C, P, atol=1e-9)
    got = {r.seq: r.cluster for r in assign_clusters(recs, C).collect()}
    assert [got[i] for i in range(len(V))] == list(_np_kmeans(V, 6))
    assert scored[0] == len(V) and scored[-1] < len(V) // 4, scored


def test_bounded_kmeans_sums_in_cells(spark, monkeypatch):
    """Past the limit of the partial sums they are added up on Spark."""
    from turnlake.operators import cluster

    recs = _recs(spark, _grouped(200, 3, 8).tolist())
    want, rounds = cluster.kmeans_fit(recs, 3, max_rounds=5, bounds=True)
    monkeypatch.setattr(cluster, "DIRECT_PARTIALS_LIMIT", 0)
    for bounds in (True, False):
        got, n = cluster.kmeans_fit(recs, 3, max_rounds=5, bounds=bounds)
        assert n == rounds and np.allclose(got, want, atol=1e-9)


def test_bounded_kmeans_of_odd_tables(spark):
    from turnlake.operators.cluster import kmeans_fit

    recs = _recs(spark, [[0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [0.0, 2.0]])
    for k in (1, 2, 4, 9):  # a zero vector is a first centroid, too
        want, n = kmeans_fit(recs, k)
        got, m = kmeans_fit(recs, k, bounds=True)
        assert n == m and np.allclose(got, want)
    assert kmeans_fit(recs.limit(0), 3, bounds=True)[1] == 0


def test_centroid_turns():
    from turnlake.operators.cluster import centroid_turns

    A = np.array([[1.0, 0.0], [0.0, 0.0], [0.0, 0.0], [2.0, 0.0], [1.0, 0.0]])
    B = np.array([[0.0, 3.0], [0.0, 0.0], [1.0, 0.0], [5.0, 0.0], [-1.0, 0.0]])
    assert np.allclose(centroid_turns(A, B), [np.pi / 2, 0.0, np.pi, 0.0, np.pi])


def test_kmeans_k_capped(spark):
    recs = _recs(spark, [[1.0, 0.0], [0.0, 1.0]])
    assert sorted(r.cluster for r in kmeans(recs, 5).collect()) == [0, 1]


def test_ann_full_probe_exact_and_recall(spark):
    recs = doc_records(spark, SF01)
    q = table(spark, SF01, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    idx, C = build_index(recs)
    exact = search_batch(recs, q, 10)
    full = ann_search(idx, C, q, 10, nprobe=C.shape[0])
    assert recall_at_k(full, exact) == 1.0
    quarter = ann_search(idx, C, q, 10, nprobe=C.shape[0] // 4)
    assert recall_at_k(quarter, exact) >= 0.70


def test_registered_approximate_searches_reach_their_recall(spark):
    from turnlake.plans import catalog

    for folder in (SF001, SF01):
        recs = doc_records(spark, folder)
        q = table(spark, folder, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
        assert recall_at_k(catalog.queries()["ann_search"](spark, folder), search_batch(recs, q, 10)) >= 0.9
        assert recall_at_k(catalog.queries()["knn_graph_ann"](spark, folder), knn_graph(recs, 5)) >= 0.9


def test_probes_follow_the_recall_asked_for(spark):
    from turnlake.operators.ann import probes_for_recall

    recs = doc_records(spark, SF01)
    idx, C = build_index(recs, 32, rounds=3)
    q = table(spark, SF01, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    exact = search_batch(recs, q, 10)
    few, many = (probes_for_recall(idx, C, q, 10, r, sample=10**6) for r in (0.5, 0.9))
    assert 1 <= few < many < 32 and probes_for_recall(idx, C, q, 10, 1.0, sample=10**6) <= 32
    assert recall_at_k(ann_search(idx, C, q, 10, many), exact) >= 0.9 > recall_at_k(ann_search(idx, C, q, 10, many - 1), exact)
    assert probes_for_recall(idx, C, q.limit(0), 10) == 1


def test_ann_stored_index_prunes_lists(spark):
    from turnlake.operators.ann import read_index, write_index
    from turnlake.session import scratch_path

    recs = doc_records(spark, SF001)
    q = table(spark, SF001, "embeddings").where("vec_id < 2").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    idx, C = build_index(recs, nlist=8)
    p = scratch_path(spark, "t-ann")
    write_index(idx, p)
    stored = read_index(spark, p)
    res = ann_search(stored, C, q, 5, nprobe=2)
    plan = res._jdf.queryExecution().executedPlan().toString()
    import re

    m = re.search(r"PartitionFilters: \[list_id#\d+ IN \(([0-9,]+)\)", plan)
    assert m and len(m.group(1).split(",")) <= 4  # 2 queries x 2 probes of 8 lists
    mem = ann_search(idx, C, q, 5, nprobe=2)
    key = lambda df: sorted((r.qid, r.rank, r.seq) for r in df.collect())
    assert key(res) == key(mem)


def test_single_query_through_index(spark):
    recs = doc_records(spark, SF001)
    qv = [float(x) for x in table(spark, SF001, "embeddings").where("vec_id = 7").first().embedding]
    idx, C = build_index(recs.select("seq", "id", "vector", "text", "timestamp", "tags"), nlist=8)
    rich = idx.join(recs.select("seq", "text", "timestamp", "tags"), "seq")
    exact = [(r.seq, round(r.score, 9)) for r in semantic_topk(recs, qv, 10).orderBy("rank").collect()]
    full = [(r.seq, round(r.score, 9)) for r in semantic_topk(recs, qv, 10, index=(idx, C), nprobe=8).orderBy("rank").collect()]
    assert full == exact
    h_exact = hybrid_search(recs, qv, "the", top=5, tags=["en"], alpha=0.7).select("seq").collect()
    h_full = hybrid_search(recs, qv, "the", top=5, tags=["en"], alpha=0.7, index=(rich, C), nprobe=8).select("seq").collect()
    assert h_full == h_exact
    part = semantic_topk(recs, qv, 10, index=(idx, C), nprobe=2).count()
    assert 1 <= part <= 10


def test_knn_graph_through_index(spark):
    from turnlake.operators.ann import knn_graph_ann

    recs = doc_records(spark, SF01)
    idx, C = build_index(recs)
    exact = knn_graph(recs, 5)
    full = knn_graph_ann(idx, C, 5, nprobe=C.shape[0])
    key = lambda df: sorted((r.qid, r.rank, r.seq) for r in df.collect())
    assert key(full) == key(exact)
    assert recall_at_k(knn_graph_ann(idx, C, 5, C.shape[0] // 4), exact) >= 0.7


def test_blocked_equals_broadcast_on_fixture(spark):
    # many blocks per side, duplicate vectors and ties: cogroup keys must meet exactly
    recs = doc_records(spark, SF01)
    q = recs.select(F.col("seq").alias("qid"), "vector")
    a = {(r.qid, r.rank, r.seq) for r in topk_neighbors(q, recs, 5, strategy="broadcast").collect()}
    b = {(r.qid, r.rank, r.seq) for r in topk_neighbors(q, recs, 5, strategy="blocked", block_rows=128).collect()}
    assert a == b and len(a) == 5000


@pytest.mark.parametrize("dim", [64, 300])
def test_kernel_and_sql_single_query_agree(spark, dim):
    rng = np.random.default_rng(dim)
    V = rng.standard_normal((400, dim)).astype(np.float32)
    V[10] = V[11]  # a tie broken by seq
    V[12] = 0.0
    rows = [(i, "", f"r{i:03d}", f"text {i} the", [float(x) for x in V[i]], 1704067200 + i * 3600, ["en"] if i % 2 else ["fr"])
            for i in range(400)]
    recs = spark.createDataFrame(rows, "seq long, ns string, id string, text string, vector array<float>, timestamp long, tags array<string>")
    qv = [float(x) for x in V[11] + 0.1 * rng.standard_normal(dim)]
    key = lambda df: [(r.rank, r.seq, round(r.score, 9)) for r in df.orderBy("rank").collect()]
    assert key(semantic_topk(recs, qv, 10, method="kernel")) == key(semantic_topk(recs, qv, 10, method="sql"))
    for opts in ({"tags": ["en"], "after": 1704067200 + 50 * 3600}, {"candidate_pool": 40, "tags": ["fr"]}, {"min_score": 0.05}):
        a = key(hybrid_search(recs, qv, "the", top=8, alpha=1.0, method="kernel", **opts))
        b = key(hybrid_search(recs, qv, "the", top=8, alpha=1.0, method="sql", **opts))
        assert a == b
    # blended scores: keyword share from the JVM as a per-row bias inside the kernel
    for opts in ({"candidate_pool": 40}, {"tags": ["en"]}, {"min_score": 0.3}):
        a = key(hybrid_search(recs, qv, "17 the", top=8, alpha=0.5, method="kernel", **opts))
        b = key(hybrid_search(recs, qv, "17 the", top=8, alpha=0.5, method="sql", **opts))
        assert a == b


def test_lsh_equals_exact_at_sf01(spark):
    # SURVEY 5.2 property (LSH pairs within exact pairs, recall >= 0.95); measured: identical
    recs = doc_records(spark, "/root/testdata/sf0.1")
    a = {(r.seq_a, r.seq_b) for r in duplicate_pairs(recs, 0.95).collect()}
    b = {(r.seq_a, r.seq_b) for r in duplicate_pairs_lsh(recs, 0.95).collect()}
    assert b <= a and len(a & b) / len(a) >= 0.95 and len(a) == 17256


def test_vectors_of_another_width_are_rejected(spark):
    from turnlake.sources.validate import split_vectors

    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [1.0, 2.0, 3.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]),
                                (6, [1.0, float("-inf")]), (7, []), (8, [0.0, 0.0])], "seq long, vector array<float>")
    valid, rejected = split_vectors(df, 2)
    assert sorted(r.seq for r in valid.collect()) == [0, 8]
    assert {r.seq: r.reject_reason for r in rejected.collect()} == {
        1: "vector_width", 2: "vector_width", 3: "missing_vector", 4: "vector_item", 5: "vector_item", 6: "vector_item", 7: "vector_width"}
    assert split_vectors(df.limit(0), 2)[0].count() == 0


def test_append_keeps_one_width(spark):
    from turnlake.operators.mutate import append_vectors

    old = _recs(spark, [[1.0, 2.0], [3.0, 4.0]])
    odd = _recs(spark, [[1.0], [5.0, 6.0], [1.0, float("nan")], []]).withColumn("seq", F.col("seq") + 10)
    table, rejected = append_vectors(old, odd)
    assert sorted(r.seq for r in table.collect()) == [0, 1, 11]
    assert {r.seq: r.reject_reason for r in rejected.collect()} == {10: "vector_width", 12: "vector_item", 13: "vector_width"}
    assert append_vectors(old.limit(0), old)[0].count() == 2
    table, rejected = append_vectors(old.limit(0), odd.where("seq = 13"))
    assert table.count() == 0 and rejected.count() == 1


def test_hash_embedding_of_odd_texts(spark):
    from turnlake.operators.embed import hash_embedding

    df = spark.createDataFrame([(0, None), (1, ""), (2, "a b"), (3, "Word word"), (4, "word"), (5, "other words, word")], "k long, text string")
    found = {r.k: r.vector for r in hash_embedding(df, "k", dim=16).collect()}
    assert sorted(found) == [0, 1, 2, 3, 4, 5] and all(len(v) == 16 for v in found.values())
    assert all(found[k] == [0.0] * 16 for k in (0, 1, 2))
    assert found[3] == found[4] and abs(sum(x * x for x in found[5]) - 1) < 1e-6
    assert hash_embedding(df.limit(0), "k").count() == 0


def test_index_of_the_initial_rows_and_required_probes(spark):
    from turnlake.operators.ann import knn_graph_ann

    recs = _recs(spark, [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.1, 0.9]])
    idx, C = build_index(recs, 2, rounds=1)
    assert C.tolist() == [[1.0, 0.0], [0.0, 1.0]]
    assert {r.seq: r.list_id for r in idx.collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    assert sorted((r.qid, r.seq) for r in knn_graph_ann(idx, C, 3, 1).collect()) == [(0, 1), (1, 0), (2, 3), (3, 2)]
    with pytest.raises(ValueError):
        semantic_topk(recs, [1.0, 0.0], 2, index=(idx, C))


def test_probes_reach_pairs_at_the_threshold():
    from turnlake.operators.dedup import _probe_order, plan_probes

    rng = np.random.default_rng(6)
    for rows, threshold in ((2000, 0.95), (10**6, 0.95), (10**6, 0.8), (10**9, 0.99)):
        plan = plan_probes(rows, threshold)
        missed = np.ones(3000, bool)
        for _ in range(plan.tables):
            x = rng.standard_normal((3000, plan.bits))
            y = threshold * x + np.sqrt(1 - threshold**2) * rng.standard_normal((3000, plan.bits))
            apart = ((x > 0) != (y > 0)) @ (np.int64(1) << np.arange(plan.bits))
            for side in (x, y):
                missed &= ~(_probe_order(side, plan.probes) == apart[:, None]).any(axis=1)
        assert not missed.any()
    order = _probe_order(rng.standard_normal((50, 12)), 256)
    assert (order[:, 0] == 0).all() and all(len(set(r)) == 256 for r in order.tolist())
    # keys of 32 bytes in place of bands that carried the vector and all their signatures
    plan = plan_probes(10**9, 0.95)
    bits, agree = 21, 1 - np.arccos(0.95) / np.pi
    bands = np.ceil(np.log(1e-6) / np.log1p(-agree ** bits))
    assert 32 * plan.tables * (1 + plan.probes) < bands * (64 * 4 + 8 * bands) / 10


@pytest.mark.parametrize("threshold, block_rows", [(0.95, 1024), (0.95, 20), (0.6, 1024), (0.0, 64)])
def test_lsh_equals_exact_on_dense_groups(spark, threshold, block_rows):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((6, 16))
    rows = [c + 0.12 * rng.standard_normal(16) for c in centres for _ in range(25)] + list(rng.standard_normal((100, 16)))
    rows += [rows[3]] * 40 + [rows[160]] * 3 + [[0.0] * 16] * 2 * (threshold > 0)
    recs = _recs(spark, [list(map(float, r)) for r in rows]).repartition(3)
    key = lambda df: {(r.seq_a, r.seq_b, round(r.score, 6)) for r in df.collect()}
    assert key(duplicate_pairs_lsh(recs, threshold, block_rows=block_rows)) == key(duplicate_pairs(recs, threshold))
