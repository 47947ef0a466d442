"""Line deduplication, periodic runs and resampling against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnlake.llm import periodic, resample as rs
from turnlake.llm.line_dedup import dedup_lines
from turnlake.llm.periodic import fragments, periodic_runs, plan_tiles, planted_runs, run_digests, stitch

from .helpers import AWKWARD, DOC, clashing, periodic as brute_runs


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_lines(rows, min_docs=2, min_chars=10):
    def key(line):
        return lower(line.strip(" \t\n\x0b\f\r"))

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines, kept = (t or "").split("\n"), []
        for line in lines:
            ids = holders.get(key(line), {i})
            least = min((x for x in ids if x is not None), default=None)
            if len(ids) < min_docs or i == least:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    rng = np.random.default_rng(4)
    common = [f"A common Line {k} \t" for k in range(20)] + ["short", "", " ", "\x0b tabbed common line", "äöü äöü äöü", "ÄÖÜ äöü äöü",
                                                              "no-break space line\xa0", "no-break space line", "123456789", "1234567890"]
    rows = [(int(i), "\n".join(str(rng.choice(common)) if rng.random() < .6 else f"own line {rng.integers(1 << 40)}"
                               for _ in range(rng.integers(0, 30)))) for i in rng.permutation(200)]
    rows += [(k, t) for k, t, *_ in AWKWARD] + [(3, rows[0][1]), (None, "A COMMON LINE 3"), (None, "only without an id, twice\nA common line 4")]
    rows += [(500, "repeated row line\nrepeated row line\nA common line 5")] * 3 + [(501, "\n"), (502, "windows line one\r\nwindows line one"),
                                                                                 (503, "WINDOWS line one\n")]
    return rows


@pytest.mark.parametrize("min_docs, min_chars", [(2, 10), (5, 0)])
def test_lines_equal_brute_force(spark, min_docs, min_chars):
    rows = line_rows()
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).withColumns({"pos": F.lit(1), "kept": F.lit(""), "own": F.lit(0)})
    got = sorted((tuple(r) for r in dedup_lines(df.repartition(5), min_docs, min_chars).collect()), key=repr)
    assert got == sorted(brute_lines(rows, min_docs, min_chars), key=repr)


def test_lines_of_an_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], DOC)).count() == 0


def word_texts(seed, n, longest):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        size = int(rng.integers(0, longest))
        words = rng.integers(0, int(rng.choice([1, 2, 3, 40])), size)
        for _ in range(int(rng.integers(0, 4))):
            if size > 4:
                low, period = int(rng.integers(0, size - 1)), int(rng.integers(1, max(2, size // 3)))
                for k in range(low + period, int(rng.integers(low, size))):
                    words[k] = words[k - period]
        out.append(words.tolist())
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([2, 4, 12, 16]), st.sampled_from([64, 128, 4096]))
def test_fragments_cover_every_run(seed, min_length, tile_words):
    texts = [np.array(w, np.int64) for w in word_texts(seed, 3, 500)]
    runs = [{} for _ in texts]
    joined = {}
    for text, p, low, high in sorted(zip(*(x.tolist() for x in fragments(texts, min_length, tile_words)))):
        spans = joined.setdefault((text, p), [])
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    for (text, p), spans in sorted(joined.items()):
        for low, high in spans:
            runs[text].setdefault((low, high - low + p), p)
    for words, found in zip(texts, runs):
        assert sorted(((a, n, p) for (a, n), p in found.items()), key=lambda r: (r[0], r[2])) == brute_runs(words.tolist(), min_length)


def test_tiles_overlap_and_serve_every_octave():
    for n in (0, 1, 12, 95, 96, 97, 1000, 6144, 6145, 100_000, 3_000_000):
        tiles = plan_tiles(n)
        octaves = {}
        for start, size, low, high in tiles:
            octaves.setdefault((low, high), []).append((start, start + size))
        for (low, high), spans in octaves.items():
            assert spans[0][0] == 0 and spans[-1][1] == n
            longest = 2 * (1 << (high.bit_length() - 1))  # periods are below
            assert all(end - start >= 2 * longest for (_, end), (start, _) in zip(spans, spans[1:]))
        if n >= 2:
            served = sorted(octaves)
            assert served[0][0] == 1 and served[-1][1] == n // 2
            assert all(2 * (1 << (h.bit_length() - 1)) == low for (_, h), (low, _) in zip(served, served[1:]))


def want_runs(i, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    runs = brute_runs(words)
    gone = {k for a, n, p in runs for k in range(a + p, a + n)}
    return i, len(words), sorted(runs), " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("tile_words, spread_bytes", [(4096, 8 << 20), (64, 8 << 20), (64, 500), (64, -1)])
def test_runs_equal_brute_force(spark, tile_words, spread_bytes):
    rows = [(k, " \n".join(f"w{x}" for x in t)) for k, t in enumerate(word_texts(7, 40, 900))]
    rows += [r[:2] for r in AWKWARD if r[0] != 7] + [(900, "x\xa0y " * 30), (901, "a b " * 6), (902, "a b " * 5 + "a"), (None, "z " * 12)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).withColumns(
        {c: F.lit("x") for c in ("runs", "words", "period", "_row", "n_words", "fragments", "low", "high")})
    got = periodic_runs(df.repartition(4), tile_words=tile_words, spread_bytes=spread_bytes).collect()
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got]
    assert sorted(got, key=repr) == sorted((want_runs(*r) for r in rows), key=repr)


def test_runs_of_an_empty_table(spark):
    assert periodic_runs(spark.createDataFrame([], DOC)).count() == 0
    assert stitch(spark.createDataFrame([], "_row long, period long, low long, high long")).count() == 0


def test_run_query_digests(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + [(k, None) for k in range(5000, 5020)]
    rows += [(k, "one two three") for k in range(6000, 6040)] + [(k, " ") for k in range(6040, 6060)] + [(None, "a " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in run_digests(periodic_runs(
        df.select("doc_id", planted_runs(F.col("doc_id"), F.col("text")).alias("text")))).collect()}
    assert len(got) == len(rows)
    planted = 0
    for i, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            planted += 1
        runs = brute_runs(words)
        gone = {k for a, size, p in runs for k in range(a + p, a + size)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (
            (len(runs), *best, 1000 * best[1] // best[2]) if best else (0, None, None, None, None))
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    assert planted > 20 and sum(r["n_runs"] > 0 for r in got.values()) > 20


def test_long_text_is_split_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE_BYTES", 7)
    text = ("ab  cd\tefghijklmno \x0b p \n" * 20).encode()
    numbers, joined = periodic._numbered(text, periodic._Vocabulary())
    assert joined == b" ".join(text.split()) and numbers.tolist() == [0, 1, 2, 3] * 20


def brute_resample(rows, target, share, min_words, buckets=10_000, n_max=1):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        return len(words), [zlib.crc32(" ".join(words[k:k + n]).encode()) % buckets
                            for n in range(1, n_max + 1) for k in range(len(words) - n + 1)]

    found = [features(t) for _, t in rows]
    s = np.bincount([b for _, f in found for b in f], minlength=buckets)
    t = np.bincount([b for x in target for b in features(x)[1]], minlength=buckets)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (n, f) in zip(rows, found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [r for r in out if r[1] >= min_words]
    able.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], r[2]))
    for place, r in enumerate(able[:len(able) * share[0] // share[1]], 1):
        r[5] = place
    return out


@pytest.mark.parametrize("exact, share, n_max", [(100_000, (10, 100), 1), (3, (10, 100), 1), (1, (1, 2), 2), (5, (1, 1), 3), (4, (0, 1), 1)])
def test_resample_equals_brute_force(spark, exact, share, n_max):
    rng = np.random.default_rng(2)
    vocabulary = [f"W{k}" for k in range(300)] + ["naïve", "日本", "x-y", "a_b"]
    rows = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(0, 80)))) for i in rng.permutation(300)]
    rows += [r[:2] for r in AWKWARD] + [(7, rows[3][1])] * 4 + [(None, rows[5][1])] * 2
    target = [" ".join(vocabulary[:20] * 3), None, "naïve NAÏVE"]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).withColumns({c: F.lit("x") for c in ("rank", "weight", "_v")})
    got = rs.resample(df.repartition(6), spark.createDataFrame([(t,) for t in target], "text string"), share, 20, exact, max_words=n_max)
    want = brute_resample(rows, target, share, 20, n_max=n_max)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((tuple(r) for r in want), key=repr)


@pytest.mark.parametrize("exact", [1, 10, 10**6])
def test_cutoff_is_located_in_tied_and_lopsided_values(spark, exact):
    rng = np.random.default_rng(8)
    for values in (np.zeros(500, int), np.repeat([3, 9], [400, 100]), rng.zipf(1.5, 2000) % 10**6, np.arange(777)[::-1],
                   np.repeat(np.arange(5), 300)):
        df = spark.createDataFrame([(int(v),) for v in values], "v long").persist()
        order = np.sort(values)
        for wanted in {1, 2, len(values) // 10, len(values) // 2, len(values) - 1, len(values)}:
            value, smaller = rs.locate(df, wanted, len(values), "v", exact)
            assert value == order[wanted - 1] and smaller == int((values < value).sum())
        df.unpersist()


def test_ties_at_the_cutoff_go_to_the_smaller_ids(spark):
    scored = spark.createDataFrame([(i, 30, 30, 0, 5) for i in range(100)], "doc_id long, n_words long, n_features long, weight long, score long")
    assert rs._least_id(scored, 40, 100, 7) == 39
    assert rs._least_id(scored.withColumn("doc_id", F.lpad("doc_id", 3, "0")), 40, 100, 7) == "039"
    ranks = rs.numbered(scored.repartition(9), F.col("doc_id").desc()).collect()
    assert all(r["rank"] == 100 - r["doc_id"] for r in ranks)


def test_resample_of_empty_tables(spark):
    empty = spark.createDataFrame([], DOC)
    some = spark.createDataFrame([(k, f"w{k} " * 30) for k in range(10)], "doc_id long, text string")
    assert rs.resample(empty, some).count() == 0
    got = rs.resample(some, empty, share=0.5).collect()
    assert sum(r["rank"] is not None for r in got) == 5


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aZ0 -é日\n", max_size=200), st.integers(1, 3), st.integers(1, 9))
def test_features_of_pieces_equal_those_of_the_text(text, n_max, piece):
    old, rs.PIECE_BYTES = rs.PIECE_BYTES, piece
    try:
        parts = list(rs.feature_buckets(text.encode(), rs._Buckets(1000), n_max))
    finally:
        rs.PIECE_BYTES = old
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    want = [zlib.crc32(" ".join(words[k:k + n]).encode()) % 1000 for n in range(1, n_max + 1) for k in range(len(words) - n + 1)]
    assert sum(n for n, _ in parts) == len(words)
    assert sorted(x for _, f in parts for x in f.tolist()) == sorted(want)
