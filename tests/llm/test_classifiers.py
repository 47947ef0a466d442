"""Quality, toxicity and language: held-out accuracy, the model against brute force, awkward rows."""

import math
from collections import Counter

import numpy as np
import pytest
from .helpers import AWKWARD, DOC, LABEL, clashing
from pyspark.sql import functions as F

from turnlake.llm import langid, queries, toxicity
from turnlake.llm.langid import fit_languages, identify
from turnlake.llm.quality import fit_quality, score_quality
from turnlake.llm.toxicity import fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.1"


def held_out(spark, name, label):
    got = queries.QUERIES[name](spark, SF).where("held_out")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    return got.join(labels, "doc_id").toPandas()


@pytest.mark.parametrize("name, label, least", [("op1_compression_quality", "quality", 0.97),
                                                ("op2_ngram_toxicity", "toxic", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    rows = held_out(spark, name, label)
    assert len(rows) > 500 and (rows.predicted == rows.y).mean() >= least
    ranks = rows.score.rank()
    ones, zeros = (rows.y == 1).sum(), (rows.y == 0).sum()
    assert (ranks[rows.y == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros) >= 0.95


def test_every_row_is_scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op1_compression_quality(spark, SF)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op9_kneser_ney_langid(spark, SF).where("held_out").join(docs, "doc_id").toPandas()
    assert len(rows) > 3000 and (rows.lang == rows.lang_pred).mean() >= 0.99


def test_toxicity_features_by_brute_force():
    texts = [b"Idiot\nhere", b"", b"abc", b"id"]
    data, offsets = toxicity._join(texts)
    row, bucket = toxicity._present(data, offsets, (3, 4), 20)
    want = set()
    for k, t in enumerate(texts):
        t = t.lower().replace(b"\n", b" ")
        for n in (3, 4):
            for i in range(len(t) - n + 1):
                value = (int.from_bytes(t[i:i + n], "big") + n) * 0x9E3779B97F4A7C15 % (1 << 64) >> 44
                want.add((k, value))
    assert set(zip(row.tolist(), bucket.tolist())) == want


def test_kneser_ney_by_brute_force(spark):
    texts = ["abab ab ba", "aab bba ab", "ba", "b" * 12]
    model = fit_languages(spark.createDataFrame([("xx", t) for t in texts], "lang string, text string"))
    padded = ["   " + t for t in texts]
    chars = {" ": 32, "a": 97, "b": 98}
    count = Counter(t[k - 3:k + 1] for t in padded for k in range(3, len(t)))
    tables = {4: count}
    for order in (3, 2, 1):
        tables[order] = Counter(g[1:] for g in tables[order + 1])
    alphabet = len(tables[1]) + 1

    def p(gram):
        if not gram:
            return 1 / alphabet
        table = tables[len(gram)]
        n1, n2 = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        own = {g: v for g, v in table.items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        return (max(own[gram] - d, 0) / total if gram in own else 0) + d * len(own) / total * p(gram[1:])

    grams = [a + b + c + d for a in " ab" for b in " ab" for c in " ab" for d in " ab"]
    packed = np.array([sum(chars[c] << (12 * (3 - k)) for k, c in enumerate(g)) for g in grams], np.uint64)
    got = langid.log_probabilities(model, packed)[:, 0]
    assert np.allclose(got, [math.log(p(g)) for g in grams], atol=1e-5)


def test_language_memory_gives_the_same_values(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_languages(docs)
    texts = [r["text"].encode() for r in docs.limit(80).collect()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = langid._Scorer(model)
    whole.entropies(data, offsets)
    again, letters = whole.entropies(data, offsets)
    monkeypatch.setattr(langid, "CHUNK_BYTES", 1000)
    small, few = langid._Scorer(model).entropies(data, offsets)
    assert np.allclose(again, small, atol=1e-6) and (letters == few).all()


def test_every_gram_is_in_the_model(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 10_000))) for _ in range(130)]  # over 2^20 n-grams
    rows = spark.createDataFrame([("zh", t) for t in texts + texts[:50]] + [("en", "words of another language")], "lang string, text string")
    model = fit_languages(rows)
    got = identify(spark.createDataFrame([(1, texts[100])], "doc_id long, text string"), model, reject=False).first()
    assert got["lang_pred"] == "zh" and got["entropy"] < 1.5  # its n-grams were counted once each


def test_shards_change_no_value(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole = fit_languages(docs)
    cut = fit_languages(docs, shard_grams=sum(len(own[-1][0]) for own in whole.levels) // 4)
    assert not whole.shards and len(cut.shards) == 5
    wanted = ["doc_id", "lang_pred", "score", "entropy", "rejected"]
    a, b = (identify(docs, m).toPandas()[wanted].sort_values("doc_id").reset_index(drop=True) for m in (whole, cut))
    assert (a.lang_pred == b.lang_pred).all() and np.allclose(a.entropy, b.entropy) and np.allclose(a.score, b.score)


def test_rejection_is_calibrated(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_languages(docs)
    odd = spark.createDataFrame([(1, "zzxq qqxz jjwq xzzk " * 20), (2, "日本語の文章です" * 20)], "doc_id long, text string")
    assert {r["lang_pred"] for r in identify(odd, model).collect()} == {"und"}
    assert {r["lang_pred"] for r in identify(odd, model, reject=False).collect()} <= set(model.langs)
    share = identify(docs, model).agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    assert share < 0.03


@pytest.mark.parametrize("rows", [AWKWARD, []])
@pytest.mark.parametrize("labels", [[], [(k, k % 2, (k + 1) % 2) for k in range(1, 12)] + [(5, 1, 1), (None, 1, 0), (4, None, None)]])
def test_awkward_rows(spark, rows, labels):
    docs, marks = clashing(spark.createDataFrame(rows, DOC)), clashing(spark.createDataFrame(labels, LABEL))
    for got in (score_quality(docs, fit_quality(docs, marks)).collect(),
                score_toxicity(docs, fit_toxicity(docs, marks)).collect()):
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
        by_text = {}
        for r, text in [(r, dict((x[0], x[1]) for x in rows)[r["doc_id"]]) for r in got]:
            assert by_text.setdefault(text, r["score"]) == r["score"]
    got = identify(docs, fit_languages(docs), reject=False).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict((x[0], x[1]) for x in rows)[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r["score"] <= 1


def test_held_out_labels_are_never_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(fit_toxicity(docs, labels).weight, fit_toxicity(docs, flipped).weight)
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert fit_quality(docs, labels) == fit_quality(docs, flipped)


def test_quality_scores_equal_plain_compression(spark):
    """Both sizes, the three features and the score by single zstandard calls."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_quality(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    extra = spark.createDataFrame([r[:2] for r in AWKWARD], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra.withColumn("doc_id", F.col("doc_id") + 10**6)).where("doc_id is not null")
    want = {}
    for r in rows.collect():
        text, sizes = (r["text"] or "").encode(), [0, 0]
        for k, d in enumerate((model.good, model.bad)):
            made = zstandard.ZstdCompressionDict(d)
            for low in range(0, len(text), 4096):
                frame = zstandard.ZstdCompressor(level=3, dict_data=made, write_checksum=False, write_content_size=False,
                                                 write_dict_id=False).compress(text[low:low + 4096])
                sizes[k] += len(frame)
        if text:
            d, rate = (sizes[1] - sizes[0]) / max(sizes), math.log(max(sizes) / len(text))
        else:
            d = rate = 0.0
        z = model.weights[0] * d + model.weights[1] * rate + model.weights[2] * d * rate + model.weights[3]
        want.setdefault(r["doc_id"], (d, 1 / (1 + math.exp(-z))))
    got = {r["doc_id"]: r for r in score_quality(rows, model, threshold=0.3).collect()}
    assert len(got) == len(want)
    for i, (d, score) in want.items():
        assert abs(got[i]["difference"] - d) < 1e-12 and abs(got[i]["score"] - score) < 1e-9
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_label_sample_fills_up(spark):
    from turnlake.llm.common import fold, label_sample

    ids = [r["id"] for r in spark.range(2000).where(fold(F.col("id"), 5) != 0).collect()]
    docs = [(i, None if k % 4 == 0 else "x" * 50 if k % 4 == 1 else f"text {i}") for k, i in enumerate(ids[:800])]
    docs += [docs[2], docs[2], (docs[3][0], "another text")]
    labels = [(i, k % 2) for k, i in enumerate(ids)] + [(ids[6], 1), (None, 1), (ids[7], None)]  # ids[6] has both labels
    d = spark.createDataFrame(docs, "doc_id long, text string")
    shares, texts = label_sample(d, spark.createDataFrame(labels, "doc_id long, quality int"), "quality", 150, 20)
    assert sum(shares.values()) == len(ids) + 1
    assert len(texts[0]) == len(texts[1]) == 150
    assert f"text {ids[6]}".encode() not in texts[0] + texts[1] and all(t.startswith((b"text", b"another")) for t in texts[0] + texts[1])
    everything = label_sample(d, spark.createDataFrame(labels, "doc_id long, quality int"), "quality", 10**4, 20)[1]
    assert len(everything[0]) + len(everything[1]) == 400 - 1 + 1 and len(set(everything[0] + everything[1])) == 400
