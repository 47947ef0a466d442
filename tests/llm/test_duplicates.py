"""Embedding, passage and SimHash duplicates against brute force."""

import hashlib

import numpy as np
import pytest
from .helpers import AWKWARD, DOC, clashing, cut, simhash, spread
from hypothesis import given, settings
from hypothesis import strategies as st

from turnlake.llm import run_index, simhash as golay
from turnlake.llm.common import components
from turnlake.llm.embedding_dedup import embedding_groups, plan_tables
from turnlake.llm.queries import op4_run_length_index
from turnlake.llm.run_index import remove_repeats
from turnlake.llm.simhash import fuzzy_keys, simhash_groups


def planted_vectors(seed, n, width, kind=np.float32):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((n, width))
    for k in range(0, n // 2, 2):  # near copies on both sides of the limit
        rows[k + 1] = rows[k] + rng.standard_normal(width) * rng.uniform(0.1, 0.5)
    rows[n // 2:n // 2 + n // 6] = rows[0]  # exact copies
    start = n // 2 + n // 6
    rows[start:start + n // 6] = rows[2] + rng.standard_normal((n // 6, width)) * 0.15  # a dense group
    return rows.astype(kind)


@pytest.mark.parametrize("block_rows, kind", [(1024, "float"), (7, "double")])
def test_embedding_links_equal_all_pairs(spark, block_rows, kind):
    v = planted_vectors(5, 240, 32)
    ids = np.random.default_rng(1).permutation(1000)[:len(v)]
    odd = [(2001, None), (2002, [0.0] * 32), (2003, [float("nan")] * 32), (2004, [None] + [1.0] * 31), (2005, []),
           (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [float("inf")] * 32), (2009, [1e-30] * 32), (2010, [2e-30] * 32)]
    df = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, v)] + odd,
                               f"vec_id long, embedding array<{kind}>")
    got = {r["vec_id"]: r for r in embedding_groups(clashing(df).repartition(5), block_rows=block_rows).collect()}
    assert len(got) == len(v) + len(odd)
    x = v.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() > 1000
    group = spread(len(v), zip(*np.nonzero(near)))
    least = {}
    for k, g in enumerate(group):
        least[g] = min(least.get(g, 1 << 60), int(ids[k]))
    for k, i in enumerate(ids.tolist()):
        assert (got[i]["n_links"], got[i]["component_id"]) == (int(near[k].sum()), least[group[k]])
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    for i, links, root in ((2001, 0, 2001), (2002, 0, 2002), (2003, 0, 2003), (2004, 0, 2004), (2005, 0, 2005),
                           (2006, 1, 2006), (2007, 1, 2006), (2008, 0, 2008), (2009, 1, 2009), (2010, 1, 2009)):
        assert (got[i]["n_links"], got[i]["component_id"]) == (links, root)


def test_embedding_of_an_empty_table(spark):
    assert embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tables_reach_the_recall_asked_for():
    for rows in (10, 10**5, 10**9):
        bits, tables = plan_tables(rows, 0.95)
        agree = 1 - np.arccos(0.95) / np.pi
        assert (1 - agree ** bits) ** tables <= 1e-7


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2))
def test_fingerprints_two_bits_apart_share_a_key(value, bits):
    other = value
    for b in bits:
        other ^= 1 << b
    rows, keys = fuzzy_keys(np.array([value, other], np.uint64))
    assert set(keys[rows == 0]) & set(keys[rows == 1])
    assert (rows == 0).sum() <= 18


def test_golay_code_is_perfect():
    words = np.arange(1 << 12, dtype=np.int64) << 11
    code = words ^ golay._remainder(words)
    assert min(int(c).bit_count() for c in code[1:]) == 7
    index, count = golay.codeword_indices(np.arange(0, 1 << 23, 4099))
    assert set(np.unique(count)) <= {1, 6}


def test_simhash_groups_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(5000 + k, t) for k, (_, t) in enumerate(rows[:40])] + [(6000, None), (6001, ""), (6002, " \n "), (6003, "one two")]
    rng = np.random.default_rng(0)
    for k in range(60):  # near copies: a word changed
        words = rows[k][1].split()
        words[rng.integers(len(words))] = "changed"
        rows.append((7000 + k, " ".join(words)))
    got = simhash_groups(clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(7)).collect()
    got = {r["doc_id"]: r for r in got}
    prints = np.array([simhash(t) for _, t in rows], np.uint64)
    assert [got[i]["fp"] % (1 << 64) for i, _ in rows] == prints.tolist()
    pairs = [(k, k + 1 + j) for k in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(prints[k + 1:] ^ prints[k]) <= 2)]
    group, least = spread(len(rows), pairs), {}
    for g, (i, _) in zip(group, rows):
        least[g] = min(least.get(g, 1 << 60), i)
    assert [got[i]["component_id"] for i, _ in rows] == [least[g] for g in group]
    assert got[6000]["component_id"] == got[6002]["component_id"] == 6000


def test_simhash_awkward_rows(spark):
    got = simhash_groups(clashing(spark.createDataFrame(AWKWARD, DOC))).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in AWKWARD)
    root = {r["doc_id"]: r["component_id"] for r in got}
    assert root[6] == root[5] == root[11] == 5 and root[1] == root[2] == root[3] == 1 and root[None] is None
    assert simhash_groups(spark.createDataFrame([], DOC)).count() == 0


def test_components_of_long_chains_and_stars(spark):
    n = 300
    pairs = [(k, k + 1) for k in range(0, 120)] + [(150, k) for k in range(151, 250)] + [(7, 7), (8, 7), (260, 261)]
    order = np.random.default_rng(3).permutation(n)
    nodes = spark.createDataFrame([(int(x),) for x in order], "node long")
    links = spark.createDataFrame([(int(order[a]), int(order[b])) for a, b in pairs], "a long, b long")
    got = {r["node"]: r["root"] for r in components(nodes, links).collect()}
    group, least = spread(n, pairs), {}
    for k, g in enumerate(group):
        least[g] = min(least.get(g, n), int(order[k]))
    assert all(got[int(order[k])] == least[g] for k, g in enumerate(group))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=30), st.integers(0, 2)), min_size=1, max_size=8))
def test_matching_statistics(items):
    texts, groups = [t.encode() for t, _ in items], [g for _, g in items]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    index = run_index.build_run_index(data, offsets, np.array(groups))
    got, want = run_index.matching_statistics(index, len(data)), []
    for k, t in enumerate(texts):
        for i in range(len(t)):
            best = 0
            for q, u in enumerate(texts):
                for j in range(len(u)):
                    if groups[q] == groups[k] and (q, j) != (k, i):
                        z = 0
                        while i + z < len(t) and j + z < len(u) and t[i + z] == u[j + z]:
                            z += 1
                        best = max(best, z)
            want.append(best)
    assert got.tolist() == want


def test_runs_are_fewer_than_rows_in_repetitive_text():
    text = np.random.default_rng(0).integers(97, 123, 500).astype(np.uint8).tobytes()
    data = np.frombuffer(text * 20, np.uint8)
    index = run_index.build_run_index(data, np.arange(0, len(data) + 1, 500), np.zeros(20, int))
    assert len(index.starts) < len(data) / 10


def passages():
    rng = np.random.default_rng(3)

    def random(n):
        return "".join(chr(97 + x) for x in rng.integers(0, 26, n))

    shared = random(700)
    texts = [random(300) + shared + random(500) for _ in range(5)] + [random(450) + shared[:399] + random(300)]
    texts += [random(200) + shared[200:620] + "é" * 300, "ab" * 600, "ab" * 600, "x" * 399, "x" * 398, "y" * 400, "y" * 401,
              "é" * 500, random(1000) + shared[100:400] + random(200), random(50) + shared[100:400] + random(600)]
    texts += [shared[:300] + random(500) for _ in range(6)] + ["line of text repeated " * 40 + random(100), "", None]
    return [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (99, texts[0]), (None, texts[1])]


@pytest.mark.parametrize("group_contexts, length", [(4096, 400), (2, 400), (0, 400), (4096, 200), (3, 200), (0, 33)])
def test_repeats_equal_brute_force(spark, group_contexts, length):
    rows = passages()
    want = cut([(t or "").encode() for _, t in rows], length)
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    got = remove_repeats(df, group_contexts=group_contexts, length=length).collect()
    assert {"_h", "_n", "_ch", "_cn"} <= set(got[0].asDict()) and all(r["_h"] == "x" and r["_cn"] == "x" for r in got)
    key = lambda i, raw, spans: (str(i), raw, spans)
    assert (sorted(key(r["doc_id"], bytes(r["kept"]), [tuple(s) for s in r["spans"]]) for r in got)
            == sorted(key(i, *w) for (i, _), w in zip(rows, want)))
    assert all(r["n_removed"] == sum(b - a for a, b in r["spans"]) for r in got)


def test_split_contexts_share_keys_where_windows_are_equal():
    rng = np.random.default_rng(5)
    common = rng.integers(97, 100, 300).astype(np.uint8).tobytes()
    texts = [rng.integers(97, 123, 150).astype(np.uint8).tobytes() + common + rng.integers(97, 123, 150).astype(np.uint8).tobytes()
             for _ in range(4)]
    texts += [texts[0][20:], b"ab" * 250, b"z" * 450]
    for depth in (1, 2, 4, 64, 512):
        keys = {}
        for t in texts:
            parts = run_index.split_context(t, 200, depth)
            assert [p[0] for p in parts] == [0, *(p[1] + 1 for p in parts[:-1])] and parts[-1][1] == len(t) - 200
            for first, last, key in parts:
                for k in range(first, last + 1):
                    assert keys.setdefault(t[k:k + 200], key) == key
    # all anchors of a window tell it apart from every other
    assert len(set(keys.values())) == len(keys)


def test_contexts_in_pieces(monkeypatch):
    data = np.random.default_rng(0).integers(97, 99, 5000).astype(np.uint8)
    whole = run_index.contexts(data, 400)
    monkeypatch.setattr(run_index, "PIECE_BYTES", 777)
    assert all(np.array_equal(a, b) for a, b in zip(whole, run_index.contexts(data, 400)))


def test_repeats_of_awkward_rows(spark):
    assert remove_repeats(clashing(spark.createDataFrame(AWKWARD, DOC))).count() == len(AWKWARD)
    assert remove_repeats(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.parametrize("group_contexts, length, shorter", [(4096, 400, 200), (0, 400, 200), (2, 401, 400), (4096, 120, 33)])
def test_repeats_of_two_lengths_equal_brute_force(spark, group_contexts, length, shorter):
    rows = passages() + [(200, "ab" * 205 + "c" * 350), (201, "c" * 500)]
    texts = [(t or "").encode() for _, t in rows]
    long, short = cut(texts, length), cut(texts, shorter)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["h"], r["n"]): r for r in run_index.repeated_texts(df, length, group_contexts, shorter=shorter).collect()}
    keys = {r["text"]: (r["_h"], r["_n"]) for r in run_index.keyed(df).collect()}
    assert got.keys() == {keys[t] for (_, t), (_, spans) in zip(rows, short) if spans}
    for (_, text), (kept, spans), (_, covered) in zip(rows, long, short):
        if keys[text] in got:
            r = got[keys[text]]
            assert (bytes(r["kept"]), [tuple(s) for s in r["spans"]]) == (kept, spans)
            assert r["n_removed"] == sum(b - a for a, b in spans) and r["n_covered"] == sum(b - a for a, b in covered)
    with pytest.raises(ValueError):
        run_index.repeated_texts(df, 200, shorter=400)


@pytest.mark.parametrize("group_contexts", [4096, 0])
def test_only_texts_that_are_cut_are_shuffled(spark, monkeypatch, group_contexts):
    """Of 300 texts without repeats none or almost none comes to a shuffle of texts, hot anchors or not."""
    rng = np.random.default_rng(9)
    shared = rng.integers(97, 123, 500).astype(np.uint8).tobytes().decode()
    texts = [rng.integers(97, 123, 900).astype(np.uint8).tobytes().decode() + (shared if k < 3 else "") for k in range(303)]
    left, likely = [], run_index._likely

    def counted(*args):
        left.append(likely(*args).count())
        return likely(*args)

    monkeypatch.setattr(run_index, "_likely", counted)
    df = spark.createDataFrame([(t,) for t in [*texts, texts[0]]], "text string").repartition(4)
    found = run_index.repeated_texts(df, 400, group_contexts).collect()
    assert sorted(r["n_removed"] for r in found) == [500, 500, 1400] and left and all(n <= 10 for n in left)


@pytest.mark.parametrize("bits", [1, 40_000, 1 << 26])
def test_texts_with_a_key_pass_the_bitmap(spark, monkeypatch, bits):
    monkeypatch.setattr(run_index, "FILTER_BITS", bits)
    hashes = [int(x) for x in np.random.default_rng(4).integers(-1 << 63, (1 << 63) - 1, 500)] + [0, -1, 32767, 32768, -1 << 63, (1 << 63) - 1]
    texts = spark.createDataFrame([(h, k, b"t") for k, h in enumerate(hashes)], "h long, n long, text binary")
    keys = spark.createDataFrame([(h, 0, "x") for h in hashes[::2] * 2], "h long, n long, _at string")
    got = [r["h"] for r in run_index._likely(texts, keys).collect()]
    assert len(got) == len(set(got)) and set(hashes[::2]) <= set(got)
    assert set(got) == {h for h in hashes if h % bits in {k % bits for k in hashes[::2]}}
    assert run_index._likely(texts, keys.where("false")).count() == 0


def test_query_shows_passages_too_short_to_cut(spark, tmp_path):
    """Passages of over 50 words that two documents share: all are counted, those of 400 bytes or more are cut."""
    rng = np.random.default_rng(8)

    def prose(n):
        return " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(n))

    shared = [prose(n) for n in (51, 55, 60, 80, 200)]
    rows = [(k, f"{prose(90)} {shared[k % 5]} {prose(90)}") for k in range(10)] + [(100 + k, prose(200)) for k in range(10)]
    rows += [(200, None), (201, ""), (202, prose(3)), (None, f"{shared[0]} {prose(60)}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op4_run_length_index(spark, str(tmp_path)).collect()}
    texts = [(t or "").encode() for _, t in rows]
    assert len(got) == len(rows) and any(len(p) < 400 for p in shared)
    for (doc_id, _), raw, (kept, spans), (_, short) in zip(rows, texts, cut(texts, 400), cut(texts, 200)):
        r = got[doc_id]
        assert (r["n_bytes"], r["n_spans"], r["kept_sha256"]) == (len(raw), len(spans), hashlib.sha256(kept).hexdigest())
        assert r["n_removed"] == sum(b - a for a, b in spans) and r["n_repeated_200"] == sum(b - a for a, b in short)
        if doc_id is not None and doc_id < 200:
            assert (r["n_repeated_200"] > 0) == (doc_id < 10)
