"""CSV files and JSON arrays read from many splits, against Python's own parsers."""

import csv
import io
import json
import os
import random
import tempfile

import pytest

from turnlake.sources.files import load_entries
from turnlake.sources.splitting import csv_records, json_array_records, read_csv_rows, read_json_array


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def set_size(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield set_size
    for n, v in before.items():
        spark.conf.set(n, v)


def write(name, *texts):
    folder = tempfile.mkdtemp(prefix="turnlake-split-")
    for k, t in enumerate(texts):
        with open(os.path.join(folder, f"{k}-{name}"), "w", encoding="utf-8", newline="") as f:
            f.write(t)
    return folder


def fields(rng):
    parts = ["plain", 'a "quoted" word', "two\nlines", "\n", '"', '""', ",", "日本 é", "x" * 300, "crlf\r\nin it", "tail\\", "}{][", " spaces "]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(4)))


@pytest.mark.parametrize("size", [150, 2000, 10**6])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_equals_a_plain_parser(spark, small_splits, size, end):
    rng = random.Random(size)
    rows = [[fields(rng), fields(rng), "more"][:rng.choice([1, 2, 2, 3])] for _ in range(40)] + [["q\n" * 400, "after a long one"], ["last", "z"]]
    texts = []
    for part in (rows[:25], rows[25:]):
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=end).writerows([["text", "tags"], *part])
        texts.append(out.getvalue())
    texts[1] = texts[1][:-len(end)]  # no line end at the end of the file
    path = write("x.csv", *texts)
    small_splits(size)
    if size == 150:
        assert spark.read.text(path).rdd.getNumPartitions() >= 8
    got = sorted((r.c0 or "", r.c1 or "") for r in read_csv_rows(spark, path).collect())
    assert got == sorted((r[0], r[1] if len(r) > 1 else "") for r in rows)
    assert csv_records(spark, path).count() == len(rows) + 2


def test_csv_without_quotes_or_rows(spark, small_splits):
    small_splits(5)
    assert [(r.c0, r.c1) for r in read_csv_rows(spark, write("a.csv", "h1,h2\na,b\n\nc\n")).orderBy("c0").collect()] == [("a", "b"), ("c", None)]
    assert read_csv_rows(spark, write("b.csv", "h1,h2\n", "")).count() == 0
    open_ended = read_csv_rows(spark, write("c.csv", 'h\n"never closed\nand on\n'))
    assert open_ended.count() == 1


@pytest.mark.parametrize("size", [150, 2000, 10**6])
@pytest.mark.parametrize("indent", [None, 1])
def test_json_array_equals_a_plain_parser(spark, small_splits, size, indent):
    rng = random.Random(size)
    rows = [{"id": str(k), "text": fields(rng), "tags": [fields(rng) for _ in range(rng.randrange(3))],
             "more": {"deep": [{"a": "}"}, {}], "n": -1.5}} for k in range(40)]
    rows += [{}, {"text": None}, {"text": "}" * 200 + "\\" + '"', "id": "odd"}]
    path = write("x.json", json.dumps(rows[:25], indent=indent), json.dumps(rows[25:], indent=indent, ensure_ascii=False) + "\n", "[]", " [ ] \n")
    small_splits(size)
    got = sorted(((r.id, r.text, r.tags) for r in read_json_array(spark, path, "id string, text string, tags array<string>").collect()), key=repr)
    assert got == sorted(((r.get("id"), r.get("text"), r.get("tags")) for r in rows), key=repr)
    assert json_array_records(spark, path).count() == len(rows)


def test_entries_from_split_files(spark, small_splits):
    small_splits(16)
    path = write("x.json", json.dumps([{"text": "a } b", "tags": ["t"]}, {"text": "c", "unknown": [1, {"x": "]"}]}]))
    assert sorted((r.text, r.tags) for r in load_entries(spark, path, fmt="json").collect()) == [("a } b", ["t"]), ("c", [])]
    path = write("x.csv", 'text,tags\n" a\nb ","x, y"\n\n"  ",z\n')
    assert [(r.text, r.tags) for r in load_entries(spark, path, fmt="csv").collect()] == [("a\nb", ["x", "y"])]
