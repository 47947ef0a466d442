"""The stored index that takes inserts: what it reads and writes, removals, splits and crashes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.operators import ann_store
from turnlake.operators.ann import ann_search
from turnlake.operators.ann_store import create_store, insert, list_sizes, open_store, remove, split_lists
from turnlake.operators.search import search_batch, semantic_topk
from turnlake.session import scratch_path


def records(spark, ids, seed=0, dim=6):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((1000, dim))
    return spark.createDataFrame([(int(i), f"r{i}", [float(x) for x in rows[i]]) for i in ids], "seq long, id string, vector array<float>")


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def local(spark, name):
    path = scratch_path(spark, name)
    return path, path.removeprefix("file:")


def same_as_exact(spark, path, expected):
    rows, centroids = open_store(spark, path)
    q = records(spark, range(900, 930)).select(F.col("seq").alias("qid"), "vector")
    key = lambda df: sorted((r.qid, r.rank, r.seq) for r in df.collect())
    assert key(ann_search(rows, centroids, q, 5, nprobe=centroids.shape[0])) == key(search_batch(expected, q, 5))
    assert sorted(r.seq for r in rows.select("seq").collect()) == sorted(r.seq for r in expected.select("seq").collect())


def test_insert_leaves_stored_files_and_reads_no_stored_row(spark, monkeypatch):
    path, folder = local(spark, "t-store")
    create_store(records(spark, range(200)), path, 8, rounds=2)
    before = files(folder)
    written = []
    plain = ann_store._write_rows
    monkeypatch.setattr(ann_store, "_write_rows", lambda rows, p: written.append(rows) or plain(rows, p))
    insert(spark, path, records(spark, range(200, 230)))
    after = files(folder)
    assert all(after[f] == t for f, t in before.items())
    assert not written[0].inputFiles()  # made of the new records and the broadcast centroids alone
    same_as_exact(spark, path, records(spark, range(230)))


def test_a_search_reads_only_the_probed_lists(spark):
    path, _ = local(spark, "t-store")
    create_store(records(spark, range(200)), path, 8, rounds=2)
    insert(spark, path, records(spark, range(200, 260)))
    remove(spark, path, spark.range(10).withColumnRenamed("id", "seq"))
    rows, centroids = open_store(spark, path)
    found = semantic_topk(rows, [1.0] * 6, 3, index=(rows, centroids), nprobe=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.split("PartitionFilters: ")[1:] if "list_id" in x.split("PushedFilters")[0]]
    assert filters and found.count() == 3
    lists = {r.list_id for r in found.select("list_id").collect()} if "list_id" in found.columns else set()
    assert len(lists) <= 2


def test_remove_insert_again_and_remove_again(spark):
    path, _ = local(spark, "t-store")
    create_store(records(spark, range(100)), path, 4)
    remove(spark, path, spark.createDataFrame([(k,) for k in (3, 4, 5, 5, 5000)], "seq int"))
    same_as_exact(spark, path, records(spark, [k for k in range(100) if k not in (3, 4, 5)]))
    insert(spark, path, records(spark, [4, 5]))
    remove(spark, path, spark.createDataFrame([(5,)], "seq long"))
    same_as_exact(spark, path, records(spark, [k for k in range(100) if k not in (3, 5)]))


def test_split_touches_its_list_only(spark):
    path, folder = local(spark, "t-store")
    create_store(records(spark, range(300)), path, 5, rounds=2)
    remove(spark, path, spark.range(0, 300, 7).withColumnRenamed("id", "seq"))
    sizes, before = list_sizes(spark, path), files(folder)
    bound = sorted(sizes.values())[-2]
    assert split_lists(spark, path, bound) == 1
    now = list_sizes(spark, path)
    kept = {k for k in sizes if k in now}
    assert len(kept) == 4 and all(now[k] == sizes[k] for k in kept) and len(now) > 5 and max(now) >= 6
    assert all(files(folder)[f] == t for f, t in before.items())
    alive = [k for k in range(300) if k % 7]
    same_as_exact(spark, path, records(spark, alive))
    insert(spark, path, records(spark, range(300, 400)), max_list_rows=30)
    assert max(list_sizes(spark, path).values()) <= 60 and split_lists(spark, path, 10**6) == 0
    same_as_exact(spark, path, records(spark, alive + list(range(300, 400))))
    remove(spark, path, records(spark, range(400)).select("seq"))
    split_lists(spark, path, 5)
    assert open_store(spark, path)[0].count() == 0
    insert(spark, path, records(spark, range(500, 520)))
    same_as_exact(spark, path, records(spark, range(500, 520)))


def test_equal_rows_cannot_be_split(spark):
    path, _ = local(spark, "t-store")
    same = spark.createDataFrame([(k, f"r{k}", [1.0, 0.0]) for k in range(50)] + [(50, "z", None), (51, "zero", [0.0, 0.0])],
                                 "seq long, id string, vector array<double>")
    create_store(same, path, 1)
    split_lists(spark, path, 10)
    rows, centroids = open_store(spark, path)
    assert rows.count() == 52
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<double>")
    assert [r.seq for r in ann_search(rows, centroids, q, 3, nprobe=9).orderBy("rank").collect()] == [0, 1, 2]


def test_what_a_crashed_writer_left_is_not_read(spark, monkeypatch):
    path, _ = local(spark, "t-store")
    create_store(records(spark, range(100)), path, 4)

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(ann_store, "_commit", crash)
    for step in (lambda: insert(spark, path, records(spark, range(100, 150))), lambda: remove(spark, path, spark.range(50).withColumnRenamed("id", "seq")),
                 lambda: split_lists(spark, path, 10)):
        with pytest.raises(OSError):
            step()
    monkeypatch.undo()
    same_as_exact(spark, path, records(spark, range(100)))
    insert(spark, path, records(spark, range(100, 150)))
    same_as_exact(spark, path, records(spark, range(150)))


def test_empty_inserts_and_stores(spark):
    path, _ = local(spark, "t-store")
    with pytest.raises(ValueError):
        create_store(records(spark, []), path)
    create_store(records(spark, range(10)), path, 2)
    insert(spark, path, records(spark, []), max_list_rows=100)
    remove(spark, path, spark.range(0).withColumnRenamed("id", "seq"))
    same_as_exact(spark, path, records(spark, range(10)))
