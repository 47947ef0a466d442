"""Column functions: rule 2.12-1 (classify), C3-C14 edge cases."""

import pytest
from pyspark.sql import functions as F

from turnlake.functions.classify import classify, classify_lenient, envelope
from turnlake.functions.text import (
    flatten_content, format_tags, keyword_score, strip_context, strip_ws, tokenize, tokenize_py, truncate_chars,
)
from turnlake.functions.timeutil import format_ts, parse_date, parse_date_col
from turnlake.functions.vector import cosine, cosine_to, stack_unit


def rows(df):
    return [tuple(r) for r in df.collect()]


CASES = [
    # text, tags, expected (role, body, session)
    ('{"hook_event_name":"UserPromptSubmit","prompt":"hi","session_id":"s1"}', ["prompt"], ("user", "hi", "s1")),
    ('{"hook_event_name":"UserPromptSubmit","session_id":"s1"}', [], ("user", "<no prompt>", "s1")),
    ('{"hook_event_name":"UserPromptSubmit","prompt":5,"session_id":7}', [], ("user", "<no prompt>", None)),
    ('{"hook_event_name":"UserPromptSubmit","prompt":null}', [], ("user", "<no prompt>", None)),
    ('{"hook_event_name":"UserPromptSubmit","prompt":{"a":1}}', [], ("user", "<no prompt>", None)),
    ('{"hook_event_name":"Stop","response":"ok","session_id":"s1"}', ["response"], ("claude", "ok", "s1")),
    ('{"hook_event_name":"Stop","response":3,"session_id":"s1"}', ["response"], ("claude", "", "s1")),
    # Stop without the tag is a note; UserPromptSubmit with the tag is claude with raw text
    ('{"hook_event_name":"Stop","response":"ok"}', [], ("note", '{"hook_event_name":"Stop","response":"ok"}', None)),
    ('{"hook_event_name":"UserPromptSubmit","prompt":"p"}', ["response"],
     ("claude", '{"hook_event_name":"UserPromptSubmit","prompt":"p"}', None)),
    ("plain legacy answer", ["response"], ("claude", "plain legacy answer", None)),
    ("{broken", [], ("note", "{broken", None)),
    ('{"hook_event_name":1}', [], ("note", '{"hook_event_name":1}', None)),
]


def test_classify_rules(spark):
    df = spark.createDataFrame([(t, g) for t, g, _ in CASES], "text string, tags array<string>")
    got = rows(df.select(classify("text", "tags").alias("c")).select("c.*"))
    assert got == [e for _, _, e in CASES]


def test_classify_trailing_text_is_a_note(spark):
    df = spark.createDataFrame([('{"hook_event_name":"UserPromptSubmit","prompt":"x"} tail', [])], "text string, tags array<string>")
    assert rows(df.select(classify("text", "tags").alias("c")).select("c.role")) == [("note",)]


def test_classify_lenient(spark):
    data = [
        ('{"hook_event_name":"Stop","response":"ok","session_id":"s"}', []),  # claude in UI rule
        ('{"hook_event_name":"UserPromptSubmit","prompt":"p"}', ["response"]),  # user in UI rule
        ('{"hook_event_name":"UserPromptSubmit","prompt":""}', []),  # empty -> raw text
        ("legacy", ["response"]),
        ("other", []),
    ]
    df = spark.createDataFrame(data, "text string, tags array<string>")
    got = rows(df.select(classify_lenient("text", "tags").alias("c")).select("c.*"))
    assert got == [
        ("claude", "ok", "s"),
        ("user", "p", None),
        ("user", '{"hook_event_name":"UserPromptSubmit","prompt":""}', None),
        ("claude", "legacy", None),
        (None, None, None),
    ]


def test_envelope_roundtrip(spark):
    df = spark.createDataFrame([("héllo \"x\"", "s9")], "b string, s string")
    env = df.select(envelope("UserPromptSubmit", F.col("b"), F.col("s")).alias("text"), F.array(F.lit("prompt")).alias("tags"))
    assert "héllo" in env.first()[0]  # non-ASCII kept as is
    assert rows(env.select(classify("text", "tags").alias("c")).select("c.*")) == [("user", "héllo \"x\"", "s9")]


def test_tokenize_and_keyword_score(spark):
    q = "A an 日 Über-naïve ½ x2 été"
    expect = tokenize_py(q)
    assert "a" not in expect and "an" in expect and "日" in expect and "über" in expect and "x2" in expect
    df = spark.createDataFrame([(q,)], "q string")
    assert df.select(tokenize("q")).first()[0] == expect
    t = spark.createDataFrame([("The Blue lagoon",)], "text string")
    assert t.select(keyword_score("text", ["the", "bl", "zz"])).first()[0] == pytest.approx(2 / 3)
    assert t.select(keyword_score("text", [])).first()[0] == 0.0
    assert t.select(keyword_score("text", F.array().cast("array<string>"))).first()[0] == 0.0


def test_strip_and_context_tags(spark):
    df = spark.createDataFrame([("<ide_opened_file>a\nb</ide_opened_file>\n  real <x>y</x>  text 　",)], "p string")
    assert df.select(strip_context("p")).first()[0] == "real text"
    assert df.select(strip_ws(F.lit("  a \n"))).first()[0] == "a"


def test_truncate_chars_not_bytes(spark):
    df = spark.createDataFrame([("ééééé",), ("abc",)], "s string")
    assert [r[0] for r in df.select(truncate_chars("s", 3)).collect()] == ["ééé…", "abc"]


def test_format_tags_and_time(spark):
    df = spark.createDataFrame([(["a", "b"], 1704067200 + 3661), ([], 0)], "tags array<string>, ts long")
    got = rows(df.select(format_tags("tags"), format_ts("ts")))
    assert got == [(" [a, b]", "2024-01-01 01:01:01"), ("", "1970-01-01 00:00:00")]


def test_parse_date():
    assert parse_date("2024-01-02") == 1704153600
    assert parse_date("2024") == 2024  # digits are seconds, not a year
    assert parse_date("1706227200") == 1706227200
    for bad in ["1969-12-31", "2024-02-30", "yesterday", "-5"]:
        with pytest.raises(ValueError):
            parse_date(bad)


def test_parse_date_col(spark):
    df = spark.createDataFrame([("2024-01-02",), ("17",), ("1969-12-31",), ("nope",)], "s string")
    assert [r[0] for r in df.select(parse_date_col("s")).collect()] == [1704153600, 17, None, None]


def test_flatten_content(spark):
    df = spark.createDataFrame(
        [('"plain json string"',), ('[{"type":"text","text":"a"},{"type":"tool_use"},{"type":"text","text":"b"}]',),
         ("42",), ("null",), ('"42"',), ('"[]"',), ('"{\\"a\\":1}"',), ("[]",)], "c string").select(F.parse_json("c").alias("c"))
    assert [r[0] for r in df.select(flatten_content("c")).collect()] == [
        "plain json string", "a\nb", "", "", "42", "[]", '{"a":1}', ""]


def test_unit_rows_of_other_widths_score_as_in_sql(spark):
    rows = [[1.0, 0.0, 5.0], [1.0, 1.0], [2.0], [], [0.0, 3.0]]
    units, _ = stack_unit(rows, 2)
    query, _ = stack_unit([[1.0, 0.5]], 2)
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, a array<double>")
    sql = [r[0] for r in df.orderBy("k").select(cosine_to("a", [1.0, 0.5])).collect()]
    assert [round(float(x), 9) for x in units @ query[0]] == [round(x, 9) for x in sql]


def test_classify_wants_one_json_value(spark):
    stop = '{"hook_event_name":"UserPromptSubmit","prompt":"p","session_id":"s"}'
    texts = [stop, " " + stop + "\n", stop + " tail", stop + "{}", stop + ',"x":1', stop + "}", "[" + stop + "]",
             '{"hook_event_name":"x","hook_event_name":"UserPromptSubmit","prompt":"a","prompt":"last"}', "42", "", None]
    df = spark.createDataFrame([(k, t, ["prompt"]) for k, t in enumerate(texts)], "k int, text string, tags array<string>")
    got = [r.c for r in df.orderBy("k").select(classify("text", "tags").alias("c")).collect()]
    assert [c.role for c in got] == ["user", "user", "note", "note", "note", "note", "note", "user", "note", "note", "note"]
    assert got[0].body == "p" and got[0].session_id == "s" and got[7].body == "last" and got[2].body == texts[2]


def test_classify_wants_strict_json(spark):
    tail = '"response":"r","session_id":"s"}'
    texts = ["{'hook_event_name':\"Stop\"," + tail, '{"hook_event_name":"Stop","n":NaN,' + tail, '{hook_event_name:"Stop",' + tail,
             '{"hook_event_name":"Stop","n":01,' + tail, '{"hook_event_name":"Stop",' + tail + ',{"end_of_text":"end_of_text"}]',
             '{"hook_event_name":"Stop",' + tail + ',{"end_of_text":"1"}', '/* */{"hook_event_name":"Stop",' + tail,
             '{"hook_event_name":"Stop",}', "{}", "{", '{"hook_event_name":"Stop","response":"a\nb"}']
    df = spark.createDataFrame([(k, t, ["response"]) for k, t in enumerate(texts)], "k int, text string, tags array<string>")
    got = [r.c for r in df.orderBy("k").select(classify("text", "tags").alias("c")).collect()]
    assert [(c.role, c.body, c.session_id) for c in got] == [("claude", t, None) for t in texts]
    fine = ['\t\n{"hook_event_name":"Stop",' + tail + "\r\n", '{"hook_event_name":"Stop","n":[1.5e3,{"a":null}],' + tail]
    df = spark.createDataFrame([(t, ["response"]) for t in fine], "text string, tags array<string>")
    assert [tuple(r.c) for r in df.select(classify("text", "tags").alias("c")).collect()] == [("claude", "r", "s")] * 2
    lenient = spark.createDataFrame([(t, []) for t in texts], "text string, tags array<string>")
    assert {tuple(r.c) for r in lenient.select(classify_lenient("text", "tags").alias("c")).collect()} == {(None, None, None)}


def test_cosine_zero_and_lengths(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, -1.0])],
                               "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in df.select(cosine("a", "b")).collect()] == [0.0, 1.0, 0.0]
    assert [round(r[0], 9) for r in df.select(cosine_to("a", [1.0, 0.0])).collect()] == [0.0, 1.0, round(2 ** -0.5, 9)]
    assert df.select(cosine_to("a", [0.0, 0.0])).first()[0] == 0.0
