"""Sharding, chat, decontamination, tokenizer and pipeline."""

import base64
import random

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from .helpers import AWKWARD, DOC, LABEL, clashing, part_distance
from pyspark.sql import functions as F

import corpus_pipeline
from turnlake.llm import bpe, queries
from turnlake.llm.bpe import bpe_decode, bpe_round_trip
from turnlake.llm.chat import ROTATION_SQL, rotate_perspectives
from turnlake.llm.decontaminate import _edited, build_index, contaminated, decontaminate, edit_distance, find_items, words_of
from turnlake.llm.sharding import fill_table, place, placement_sql

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def rows_of(frame):
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return int(v) if isinstance(v, float) and v.is_integer() else v

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", ["op6_lookup_sharding", "op7_perspective_chat"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    assert rows_of(queries.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()) == rows_of(want)


def test_lookup_table_shares_and_stability():
    shards = [f"s{k}" for k in range(10)]
    table = fill_table(shards, 1009)
    assert {table.count(k) for k in range(10)} == {100, 101}
    fewer = fill_table(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 9)
    assert moved < 1009 * 0.15
    for wrong in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            fill_table(*wrong)


def test_placement_of_awkward_rows(spark):
    docs = clashing(spark.createDataFrame(AWKWARD, DOC))
    placed = place(docs, "doc_id", ["a", "b", "c"], 101)
    assert placed.count() == len(AWKWARD) and set(placed.columns) == set(docs.columns)
    assert placed.groupBy("doc_id").agg(F.count_distinct("shard").alias("k")).where("k > 1").count() == 0
    assert place(spark.createDataFrame([], DOC), "doc_id", ["a"], 7).count() == 0
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"doc_id": pd.array([r[0] for r in AWKWARD], "Int64")}))
    want = con.sql(placement_sql("t", "doc_id", ["a", "b", "c"], 101)).df()
    assert rows_of(placed.select("doc_id", "slot", "shard").toPandas()) == rows_of(want)


def test_rotation_of_awkward_turns(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "Ann Lee", "hi"), (1, 2, "Bob", None), (1, 2, "Bob", "tie"), (1, 2, "Bob", "tie"),
             (1, 3, None, "who?"), (2, 0, "system", "alone"), (None, 0, "x", "a"), (None, 1, "y", "b"), (3, None, "", "z"), (3, 0, "q", "")]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(turns, schema)
    con = duckdb.connect()
    con.register("raw", df.toPandas())
    con.execute("create view conversations as select conv_id::BIGINT conv_id, turn::BIGINT turn, role, text from raw")
    got = rotate_perspectives(clashing(df))
    assert rows_of(got.toPandas()) == rows_of(con.sql(ROTATION_SQL).df())
    rows = got.where("conv_id = 1 and perspective = 'Bob' and speaker in ('Ann Lee', 'Bob')").collect()
    for r in rows:
        masked = r["segment"][r["prefix_chars"]:r["prefix_chars"] + r["mask_chars"]]
        assert masked == ((r["content"] + "<|im_end|>") if r["speaker"] == "Bob" else "")
        assert r["segment"].startswith("<|im_start|>assistant\n" if r["speaker"] == "Bob" else "<|im_start|>user name=Ann_Lee\n")
    assert rotate_perspectives(spark.createDataFrame([], schema)).count() == 0


def test_edit_distance_by_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        pattern = tuple(rng.randrange(4) for _ in range(rng.randrange(1, 80)))
        text = [rng.randrange(4) for _ in range(rng.randrange(0, 90))]
        assert edit_distance(pattern, text) == part_distance(pattern, text)


def test_edited_passages_reach_the_recall():
    rng = np.random.default_rng(4)
    items = [(k, " ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(3, 150)) % 4000)) for k in range(150)]
    index = build_index(items)
    docs, planted = [], []
    for d in range(1500):
        own = index.items[rng.integers(len(index.items))]
        around = (rng.zipf(1.3, 120) % len(index.vocabulary) + 1).tolist()
        at = int(rng.integers(0, 100))
        copy = _edited(own.words, int(rng.integers(0, own.edits + 1)), len(index.vocabulary), rng)
        docs.append(around[:at] + copy + around[at:])
        planted.append((d, index.items.index(own)))
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    found = find_items(index, np.concatenate(docs).astype(np.int32), offsets)
    assert len({(d, k) for d, k, _, _ in found} & set(planted)) >= 0.98 * len(set(planted))
    for d, k, edits, _ in found[:200]:
        assert edits <= index.items[k].edits and part_distance(index.items[k].words, docs[d]) <= edits


@pytest.mark.parametrize("words", [10, 20, 39, 61, 122])
def test_edits_bunched_at_either_end_are_found(words):
    rng = np.random.default_rng(words)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 4000, words))) for k in range(60)]
    index = build_index(items)
    docs, planted = [], []
    for d in range(1200):
        own = index.items[d % len(items)]
        half = words // 2
        parts = [own.words[:half], own.words[half:]]
        parts[d >= 600] = _edited(parts[d >= 600], own.edits, len(index.vocabulary), rng)
        copy = [*parts[0], *parts[1]]
        around = rng.integers(1, len(index.vocabulary) + 1, 40).tolist()
        at = int(rng.integers(0, 40))
        docs.append(around[:at] + copy + around[at:])
        planted.append((d, d % len(items)))
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    found = {(d, k) for d, k, _, _ in find_items(index, np.concatenate(docs).astype(np.int32), offsets)}
    for half in (planted[:600], planted[600:]):
        assert len(found & set(half)) >= 0.99 * len(half)


@pytest.mark.parametrize("item", ["机器学习模型需要大量的训练数据", "きかいがくしゅうのもでるがひつようです", "การเรียนรู้ของเครื่องต้องการข้อมูล"])
def test_text_without_spaces(spark, item):
    edited = item[:6] + "x" + item[7:]
    docs = spark.createDataFrame([(1, item[3] * 3 + item + item[4] * 2), (2, item[5:] * 2), (3, item[3] * 3 + edited + item[4])],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((r["doc_id"], r["edits"]) for r in contaminated(docs, bench).collect()) == [(1, 0), (3, 1)]
    assert words_of("Ab 12_é 漢字x") == ["ab", "12_é", "漢", "字", "x"]


def test_too_few_repetitions_raise(monkeypatch):
    monkeypatch.setattr("turnlake.llm.decontaminate.MAX_WALKS", 1)
    with pytest.raises(RuntimeError):
        build_index([(k, " ".join(f"w{k}x{j}" for j in range(50))) for k in range(20)])


def test_decontamination_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    items = {r["item_id"]: words_of(r["text"]) for r in bench.collect()}
    number = {}
    coded = {i: tuple(number.setdefault(w, len(number)) for w in ws) for i, ws in items.items()}
    want = set()
    for r in docs.collect():
        text = [number.get(w, -1) for w in words_of(r["text"])]
        want |= {(r["doc_id"], i) for i, ws in coded.items() if ws and edit_distance(ws, text) <= int(0.1 * len(ws) + 1e-9)}
    assert found == want and found
    blocks = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench, block_items=7).collect()}
    assert blocks == want
    left = {r["doc_id"] for r in decontaminate(docs, bench, block_items=7).collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}


def test_decontamination_of_awkward_rows(spark):
    docs = clashing(spark.createDataFrame(AWKWARD, DOC))
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "Words, again!"), (3, "Words, again!"), (None, "no id here")],
                                  "item_id long, text string")
    found = [(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()]
    assert sorted(found, key=str) == sorted([(5, 3)] * 2 + [(6, 3)] * 4 + [(11, 3)] * 2 + [(None, None)], key=str)
    empty_docs, empty_bench = spark.createDataFrame([], DOC), spark.createDataFrame([], "item_id long, text string")
    assert contaminated(empty_docs, bench).count() == 0 and contaminated(docs, empty_bench).count() == 0
    assert decontaminate(docs, empty_bench).count() == len(AWKWARD)


@pytest.mark.parametrize("kind, ids", [("smallint", [7, 8, 9]), ("string", ["a", "b", "b"]), ("decimal(5,1)", [7, 8, 9]),
                                       ("struct<x:int>", [(1,), (2,), (3,)])])
def test_items_with_ids_of_any_type(spark, kind, ids):
    from decimal import Decimal

    ids = [Decimal(i) for i in ids] if kind.startswith("decimal") else ids
    bench = spark.createDataFrame(list(zip(ids, ["these words are looked for", "these words are looked for", "others are not"])),
                                  f"item_id {kind}, text string")
    docs = spark.createDataFrame([("d", "here these words are looked for, always")], "doc_id string, text string")
    found = contaminated(docs, bench).collect()
    assert sorted(str(r["item_id"]) for r in found) == sorted(str(r[0]) for r in bench.limit(2).collect())
    assert decontaminate(docs, bench).count() == 0


def test_repeated_items_are_indexed_once(spark, monkeypatch):
    from turnlake.llm import decontaminate as module

    built = []
    monkeypatch.setattr(module, "build_index", lambda items, **o: built.append(len(items)) or build_index(items, **o))
    monkeypatch.setattr(module, "BLOCK_CHARS", 60)
    bench = spark.createDataFrame([(k, "the same item over and over again") for k in range(500)]
                                  + [(k, f"item number {k} has words of its own") for k in range(500, 506)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x the same item over and over again y"), (2, "nothing")], "doc_id long, text string")
    assert module.contaminated(docs, bench).count() == 500 and sum(built) == 7 and len(built) > 1


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(reference):
    rng = random.Random(1)
    letters = "ab cd\n\t01'sé ñ漢字🙂　\x1c\x85​.,!<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(1000)]
    texts += ["", "a" * 5000, "ab" * 3000, " " * 3000, "\n" * 700 + " x", "漢" * 1000, "=-" * 500, "naïve café's 1234567"]
    texts += ["".join(rng.choice(s) for _ in range(6000)) for s in ("abcdefghijklmnopqrstuvwxyz", "aeint")]
    texts += [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    for low in range(0, len(texts), 2000):
        part = texts[low:low + 2000]
        got = encoder.encode(part)
        assert got == [np.array(reference.encode_ordinary(t), "<u4").tobytes() for t in part]
        assert [encoder.decode(g) for g in got] == [t.encode() for t in part]


def test_small_matrices_and_forgotten_pieces(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MATRIX_CELLS", 40)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 50)
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    for text in ("Unbelievable multidisciplinary Wissenschaftlerinnen " * 8, "x", ""):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_round_trip_of_awkward_rows(spark):
    docs = clashing(spark.createDataFrame(AWKWARD, DOC))
    coded = bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN)
    rows = coded.collect()
    assert (sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in rows)
            == sorted((str(r[0]), (r[1] or "").encode()) for r in AWKWARD))
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    again = bpe_decode(coded, RANKS).collect()
    assert sorted(bytes(r["decoded"]) for r in again) == sorted((r[1] or "").encode() for r in AWKWARD)
    assert bpe_round_trip(spark.createDataFrame([], DOC), RANKS, public_tokenizers.PATTERN).count() == 0


def write_tables(spark, folder, docs, labels, bench):
    spark.createDataFrame(docs, DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABEL).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("docs, bench", [(AWKWARD, [(1, "No id; here!")]), ([], []), ([(1, None, None, None, None)], [(None, None)])])
def test_pipeline_of_awkward_tables(spark, tmp_path, docs, bench):
    folder = write_tables(spark, tmp_path / "in", docs, [], bench)
    got = corpus_pipeline.run(spark, folder).collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    if len(docs) > 2:
        assert {r["doc_id"] for r in got} == {1, 4, 5, 7, 8, 9, 10}


def test_pipeline_cuts_every_shared_passage(spark, tmp_path):
    rng = np.random.default_rng(12)
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 2000").select("text").collect()
    words = sorted({w for r in source for w in r["text"].split() if len(w) > 2})

    def text(n):
        return " ".join(rng.choice(words, n))

    rows, planted = [], []
    for n in (51, 60, 80, 200):
        for _ in range(10):
            passage = text(n)
            planted.append(passage)
            for _ in range(2):
                rows.append((len(rows), f"{text(40)} {passage} {text(40)}", "en", "a", 0))
    alone = len(rows)
    rows += [(alone + k, text(150), "en", "a", 0) for k in range(40)]
    docs = spark.createDataFrame(rows, DOC)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    for k, passage in enumerate(planted):
        inner = " ".join(passage.split()[1:-1])
        assert inner not in got[2 * k] and inner not in got[2 * k + 1]
        assert len(got[2 * k]) >= len(rows[2 * k][1]) - len(passage) - 20  # and no more than it
    assert all(got[i] == t for i, t, *_ in rows[alone:])


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, folder).cache()
    toxic = labels.where("toxic = 1").select("doc_id")
    assert kept.columns == docs.columns and kept.join(toxic, "doc_id").count() < 0.2 * toxic.count()
    assert docs.count() - kept.count() < 0.2 * docs.count()
    once = corpus_pipeline.simhash_dedup(spark, kept, folder).cache()
    assert once.select("text").distinct().count() == once.count() and once.columns == docs.columns
    cut_docs = corpus_pipeline.suffix_dedup(spark, once, folder).cache()
    assert cut_docs.count() == once.count() and cut_docs.where("n_chars <> length(text)").count() == 0
    clean = corpus_pipeline.benchmark_decontamination(spark, cut_docs, folder).cache()
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert contaminated(clean, bench).count() == 0 and clean.count() >= 0.9 * cut_docs.count()
    coded = corpus_pipeline.byte_bpe(spark, clean, folder)
    same = coded.join(clean.select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("own")), "doc_id")
    assert same.where("own = decoded_sha256").count() == clean.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "suffix_dedup", "benchmark_decontamination", "byte_bpe"]
