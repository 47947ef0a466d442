"""Sources, validation, capture envelopes, chat logs and turn pairing (S1-S9, S11, C3, C4,
C14, J3).  File sources are exercised on files Spark writes from the driver tables into the
session's shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_context
from ..operators.pairing import pair_turns
from ..operators.search import semantic_topk
from ..operators.timeline import classify_records
from ..session import checkpointed, scratch_path
from ..sources.conversation import (
    TRANSCRIPT_SCHEMA, chat_log_prompt, chat_log_response_anthropic, chat_log_response_openai, expand_turns,
    prompt_events_to_entries, stop_events_to_entries, transcript_turns,
)
from ..sources.files import add_tag, load_entries
from ..sources.tables import doc_records, session_of, table
from ..sources.validate import split_vectors, with_reject_reason, with_vector_reason
from .catalog import register
from .common import big, joined, query_vector, r6
from .oracle_ctes import DOC_RECORDS, cos, with_

# Unicode White_Space as an explicit class for DuckDB (RE2 has no such property).
_WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


@register(
    "ingest_text_lines",
    "SELECT text, '' AS tags FROM (SELECT " + _strip_sql("line") + " AS text FROM "
    "(SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE length(text) > 0",
)
def q_ingest_text_lines(spark, sf_dir):
    """S1 (+S4 dispatch): every document written as a text file, read back as one entry per
    non-blank stripped line."""
    path = scratch_path(spark, "lines")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    e = load_entries(spark, path, fmt="txt")
    return e.select("text", joined("tags").alias("tags"))


_CSV_TAGS = (
    "list_filter(list_transform(string_split(array_to_string(tags, ','), ','), lambda s: " + _strip_sql("s") + "), "
    "lambda s: length(s) > 0)"
)


@register(
    "ingest_csv",
    with_(DOC_RECORDS)
    + "SELECT text, array_to_string(CASE WHEN list_contains(t, 'imported') THEN t ELSE list_append(t, 'imported') END, ',') AS tags "
    f"FROM (SELECT {_strip_sql('text')} AS text, {_CSV_TAGS} AS t FROM doc_records) WHERE length(text) > 0",
)
def q_ingest_csv(spark, sf_dir):
    """S2 + S4 + S5: records written as CSV ``text,tags`` (quoted, multi-line), read back by
    position, plus the extra tag 'imported'."""
    path = scratch_path(spark, "csv")
    recs = doc_records(spark, sf_dir).select("text", F.array_join("tags", ",").alias("tags"))
    (recs.write.option("header", True).option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    e = load_entries(spark, path, fmt="csv", extra_tag="imported")
    return e.select("text", joined("tags").alias("tags"))


@register(
    "ingest_json",
    with_(DOC_RECORDS)
    + "SELECT text, array_to_string(CASE WHEN list_contains(tags, 'imported') THEN tags ELSE list_append(tags, 'imported') END, ',') AS tags "
    "FROM doc_records",
)
def q_ingest_json(spark, sf_dir):
    """S3 + S5: records written as JSON lines ``{text, tags, ...}`` read back (unknown keys
    ignored), plus the extra tag."""
    path = scratch_path(spark, "json")
    doc_records(spark, sf_dir).select("text", "tags", "timestamp").write.json(path)
    e = add_tag(load_entries(spark, path, fmt="jsonl"), "imported")
    return e.select("text", joined("tags").alias("tags"))


@register(
    "ingest_csv_split",
    with_(DOC_RECORDS) + f"SELECT {_strip_sql('text')} AS text, array_to_string({_CSV_TAGS}, ',') AS tags FROM doc_records "
    f"WHERE length({_strip_sql('text')}) > 0",
)
def q_ingest_csv_split(spark, sf_dir):
    """S2 from files of up to ``CSV_FILE_BYTES``, whose quoted multi-line records are read in eight or more splits each."""
    path = scratch_path(spark, "csv-one")
    recs = doc_records(spark, sf_dir).select("text", F.array_join("tags", ",").alias("tags"))
    size = recs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.octet_length("tags"))).first()[0] or 0
    (recs.repartition(max(1, -(-size // CSV_FILE_BYTES))).write.option("header", True).option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return _in_splits(spark, path, lambda: load_entries(spark, path, fmt="csv").select("text", joined("tags").alias("tags")))


CSV_FILE_BYTES = 64 << 20
SPLIT_BYTES = CSV_FILE_BYTES // 10


def _in_splits(spark, path, read, splits=10):
    """``read()`` with the file bytes of a split set so that the files at ``path`` give about ``splits`` of them, or more
    of ``SPLIT_BYTES``."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], str(min(max(size // splits, 1), SPLIT_BYTES)))
    spark.conf.set(names[1], "1")
    try:
        return checkpointed(read())
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


@register("ingest_json_array", with_(DOC_RECORDS) + "SELECT id, text, array_to_string(tags, ',') AS tags FROM doc_records")
def q_ingest_json_array(spark, sf_dir):
    """S3: records written as files of one JSON array of at most 10,000 objects each, read back."""
    path = scratch_path(spark, "arrays")
    recs = doc_records(spark, sf_dir).select(F.floor(F.col("seq") / 10_000).alias("block"), F.struct("id", "text", "tags").alias("r"))
    recs.groupBy("block").agg(F.to_json(F.collect_list("r")).alias("value")).write.partitionBy("block").text(path)
    return load_entries(spark, path, fmt="json").select("id", "text", joined("tags").alias("tags"))


_ODD_VECTORS = (
    "odd AS (SELECT seq, id, CASE seq % 8 WHEN 3 THEN vector[1:40] WHEN 4 THEN list_concat(vector, [CAST(5 AS FLOAT), CAST(5 AS FLOAT)]) "
    "WHEN 5 THEN NULL WHEN 6 THEN list_concat([CAST(NULL AS FLOAT)], vector[2:64]) ELSE vector END AS vector FROM doc_records)"
)
_ODD_REASON = (
    "CASE WHEN vector IS NULL THEN 'missing_vector' WHEN len(vector) <> 64 THEN 'vector_width' "
    "WHEN len(list_filter(vector, lambda x: x IS NULL)) > 0 THEN 'vector_item' END"
)


def _odd_vectors(spark, sf_dir):
    """Record vectors with odd ones among them: too short, too long, missing, with a missing item."""
    v, kind = F.col("vector"), F.pmod("seq", F.lit(8))
    five, none = F.lit(5).cast("float"), F.array(F.lit(None).cast("float"))
    odd = (F.when(kind == 3, F.slice(v, 1, 40)).when(kind == 4, F.concat(v, F.array(five, five)))
           .when(kind == 6, F.concat(none, F.slice(v, 2, 63))).when(kind != 5, v))
    return doc_records(spark, sf_dir).select("seq", "id", odd.alias("vector"))


@register(
    "validate_vectors",
    with_(DOC_RECORDS, _ODD_VECTORS) + f"SELECT coalesce({_ODD_REASON}, 'ok') AS reason, count(*) AS n FROM odd GROUP BY ALL",
)
def q_validate_vectors(spark, sf_dir):
    """Records by the reason their vector is rejected for."""
    v = with_vector_reason(_odd_vectors(spark, sf_dir), 64)
    return v.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(big(F.count(F.lit(1))).alias("n"))


@register(
    "search_valid_vectors",
    with_(
        DOC_RECORDS, _ODD_VECTORS,
        f"s AS (SELECT seq, id, {cos('vector', '(SELECT embedding FROM embeddings WHERE vec_id = 7)')} AS score FROM odd WHERE {_ODD_REASON} IS NULL)",
        "t AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, seq) AS rank FROM s)",
    )
    + "SELECT method, rank, seq, id, round(score, 6) AS score FROM t CROSS JOIN (VALUES ('kernel'), ('sql')) m(method) WHERE rank <= 10",
)
def q_search_valid_vectors(spark, sf_dir):
    """S11 + V1: the 10 nearest of the records with a valid vector, by both forms of the cosine."""
    valid, _ = split_vectors(_odd_vectors(spark, sf_dir), 64)
    found = [semantic_topk(valid, query_vector(spark, sf_dir), 10, method=m).select(F.lit(m).alias("method"), "rank", "seq", "id", "score")
             for m in ("kernel", "sql")]
    return found[0].unionByName(found[1]).select(
        "method", big("rank").alias("rank"), big("seq").alias("seq"), "id", r6("score").alias("score"))


@register(
    "validate_split",
    "SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL THEN 'missing_text' "
    "WHEN length(text) = 0 THEN 'empty_text' WHEN strlen(text) > 32768 THEN 'text_too_long' END AS reason "
    "FROM documents) GROUP BY ALL",
)
def q_validate_split(spark, sf_dir):
    """Documents as entries (tags = language, source) split into accepted / rejected."""
    e = table(spark, sf_dir, "documents").select("text", F.array("lang", "source").alias("tags"))
    v = with_reject_reason(e)
    return v.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(big(F.count(F.lit(1))).alias("n"))


_TURN_PAIRS_ORACLE = (
    "SELECT u.conv_id, u.turn, p.pos, CASE p.pos WHEN 0 THEN 'user' ELSE 'claude' END AS role, "
    "CASE p.pos WHEN 0 THEN u.text ELSE a.text END AS body, concat('s', lpad(CAST(u.conv_id AS VARCHAR), 8, '0')) AS session_id, "
    "CASE p.pos WHEN 0 THEN 'prompt,' ELSE 'response,' END || u.role AS tags "
    "FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
    "CROSS JOIN (VALUES (0), (1)) p(pos) WHERE u.role = 'user' AND a.role = 'assistant'"
)


@register("turns_to_records", _TURN_PAIRS_ORACLE)
def q_turns_to_records(spark, sf_dir):
    """S9 + C14 + C1: each (user turn, next assistant turn) pair expanded into a prompt record
    and a response record, then classified back."""
    conv = table(spark, sf_dir, "conversations")
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"), F.col("role").alias("r"))
    a = conv.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    pairs = u.join(a, ["conv_id", "turn"]).withColumn("session_id", session_of()).withColumn("tags", F.array("r"))
    recs = expand_turns(pairs, keep=("conv_id", "turn"))
    c = classify_records(recs)
    return c.select(
        "conv_id", "turn", big("pos").alias("pos"), "role", "body", "session_id", joined("tags").alias("tags")
    )


_CHATLOG_ORACLE = """
SELECT a.conv_id, a.turn,
  coalesce(CASE WHEN p1.role = 'user' THEN p1.text WHEN p2.role = 'user' THEN p2.text END, '') AS prompt,
  CASE WHEN a.conv_id % 2 = 0 THEN a.text ELSE replace(a.text, chr(10), '') END AS response
FROM conversations a
LEFT JOIN conversations p1 ON p1.conv_id = a.conv_id AND p1.turn = a.turn - 1
LEFT JOIN conversations p2 ON p2.conv_id = a.conv_id AND p2.turn = a.turn - 2
WHERE a.role = 'assistant'
"""


@register("chatlog_prompt_response", _CHATLOG_ORACLE)
def q_chatlog_prompt_response(spark, sf_dir):
    """S8 + C4: a chat-call log built from conversations (the two turns before each assistant
    turn as ``messages``; even conversations in OpenAI shape with string content, odd ones in
    Anthropic shape with one text block per line) -> (prompt, response)."""
    conv = table(spark, sf_dir, "conversations")
    blocks = lambda c: F.transform(F.split(c, "\n"), lambda l: F.struct(F.lit("text").alias("type"), l.alias("text")))
    anth = F.pmod("conv_id", F.lit(2)) == 1
    content = F.when(anth, F.parse_json(F.to_json(blocks(F.col("text"))))).otherwise(F.col("text").cast("variant"))
    msg = conv.select("conv_id", "turn", F.struct(F.col("role"), content.alias("content")).alias("m"))
    a = conv.where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    m1 = msg.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("m").alias("m1"))
    m2 = msg.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("m").alias("m2"))
    log = a.join(m2, ["conv_id", "turn"], "left").join(m1, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.filter(F.array("m2", "m1"), lambda x: x.isNotNull()).alias("messages"),
        F.when(~anth, F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message")))).alias("choices"),
        F.when(anth, blocks(F.col("text"))).alias("content_blocks"), anth.alias("anth"),
    )
    prompt = F.when(F.col("anth"), chat_log_prompt("messages", "anthropic")).otherwise(chat_log_prompt("messages", "openai"))
    resp = F.when(F.col("anth"), chat_log_response_anthropic("content_blocks")).otherwise(chat_log_response_openai("choices"))
    return log.select("conv_id", "turn", prompt.alias("prompt"), resp.alias("response"))


JSON_LOOKALIKES = ("42", "true", '{"a":1}', '["x"]', '"quoted"', "null", "[]", "")  # user turns that are JSON themselves
_LOOKS = ", ".join(f"'{x}'" for x in JSON_LOOKALIKES)

_PAIRS_ORACLE = f"""
WITH conversations AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND conv_id % 8 < 7
    THEN [{_LOOKS}][conv_id % 8 + 1] ELSE text END AS text FROM main.conversations),
t AS (SELECT conv_id, turn, role,
    strftime(make_timestamp((1704067200 + 3600 * conv_id + 60 * (turn // 2)) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS ts,
    {_strip_sql('text')} AS text FROM conversations WHERE role IN ('user', 'assistant')),
c AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
        OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_text
      FROM t)
SELECT concat('s', lpad(CAST(conv_id AS VARCHAR), 8, '0')) AS transcript, turn AS line, ts,
  coalesce(user_text, '') AS user_text, text AS assistant_text FROM c WHERE role = 'assistant'
"""


def _transcripts(spark, sf_dir):
    """The conversations written as transcript JSON lines and read back, as kept turns."""
    conv = table(spark, sf_dir, "conversations")
    looks = F.element_at(F.array(*[F.lit(x) for x in JSON_LOOKALIKES]), (F.pmod("conv_id", F.lit(8)) + 1).cast("int"))
    conv = conv.withColumn("text", F.when((F.col("role") == "user") & (F.pmod("conv_id", F.lit(8)) < 7), looks)
                           .otherwise(F.col("text")))
    ts = F.date_format(F.timestamp_add("SECOND", F.lit(1704067200) + 3600 * F.col("conv_id") + 60 * F.floor(F.col("turn") / 2),
                                       F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    content = F.when(F.col("role") == "assistant", F.parse_json(F.to_json(block))).otherwise(F.col("text").cast("variant"))
    lines = conv.select(
        F.col("role").alias("type"), ts.alias("timestamp"), session_of().alias("sessionId"), F.col("turn").alias("line"),
        F.struct(content.alias("content"), F.when(F.col("role") == "assistant", F.lit("end_turn")).alias("stop_reason")).alias("message"),
    )
    path = scratch_path(spark, "transcripts")
    lines.write.json(path)
    schema = T.StructType(TRANSCRIPT_SCHEMA.fields + [T.StructField("line", T.LongType())])
    raw = spark.read.schema(schema).json(path)
    return transcript_turns(raw, key="sessionId", line_col="line")


@register("transcript_pairs", _PAIRS_ORACLE)
def q_transcript_pairs(spark, sf_dir):
    """S7 + J3: conversations written as transcript JSON lines (assistant content as a block
    list with stop_reason end_turn, user content as a string, some of them JSON texts themselves) -> kept turns -> each assistant
    turn paired with the latest earlier user turn not later in time."""
    p = pair_turns(_transcripts(spark, sf_dir))
    return p.select("transcript", big("line").alias("line"), "ts", "user_text", "assistant_text")


# an event for every conversation; some are sent by a running hook, some name no transcript
_STOP_ORACLE = _PAIRS_ORACLE[:_PAIRS_ORACLE.index("c AS (")] + """
a AS (SELECT * FROM t WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
u AS (SELECT a.conv_id, arg_max(t.text, t.turn) AS prompt FROM a JOIN t ON t.conv_id = a.conv_id AND t.role = 'user' AND t.ts <= a.ts
      GROUP BY a.conv_id)
SELECT concat('s', lpad(CAST(a.conv_id AS VARCHAR), 8, '0')) AS session_id, a.text AS response, coalesce(u.prompt, '') AS prompt,
  'response,claude-code' AS tags, CASE WHEN a.conv_id % 2 = 0 THEN '/work' ELSE '' END AS cwd
FROM a LEFT JOIN u USING (conv_id) WHERE a.conv_id % 10 NOT IN (1, 2)
"""


@register("stop_hook_records", _STOP_ORACLE)
def q_stop_hook_records(spark, sf_dir):
    """S6 for Stop events: each conversation's last answer as the Stop hook stores it, and its prompt."""
    conv = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    rest = F.pmod("conv_id", F.lit(10))
    events = conv.select((rest == 1).alias("stop_hook_active"), F.when(rest != 2, session_of()).alias("transcript_path"),
                         session_of().alias("session_id"), F.when(F.pmod("conv_id", F.lit(2)) == 0, "/work").alias("cwd"))
    found = stop_events_to_entries(events, _transcripts(spark, sf_dir))
    parsed = F.from_json("text", "hook_event_name string, response string, session_id string, cwd string")
    return found.select("session_id", parsed["response"].alias("response"), "prompt", joined("tags").alias("tags"),
                        parsed["cwd"].alias("cwd"))


_STRIP_ORACLE = (
    "SELECT doc_id, " + _strip_sql(
        "regexp_replace(CASE WHEN lang = 'en' THEN '<ide_opened_file>' || source || '</ide_opened_file>' || chr(10) || text "
        "WHEN lang = 'fr' THEN '<system_reminder>' || chr(10) || source || chr(10) || '</system_reminder>  ' || text "
        "ELSE text END, '<[a-z_]+>.*?</[a-z_]+>\\s*', '', 'gs')"
    ) + " AS prompt FROM documents"
)


@register("strip_context", _STRIP_ORACLE)
def q_strip_context(spark, sf_dir):
    """S6 + C3 + C1: prompt events built from documents with context tags planted (one-line
    tag for English, multi-line for French), stripped, wrapped, then classified back."""
    docs = table(spark, sf_dir, "documents")
    prompt = (
        F.when(F.col("lang") == "en", F.concat(F.lit("<ide_opened_file>"), F.col("source"), F.lit("</ide_opened_file>\n"), F.col("text")))
        .when(F.col("lang") == "fr", F.concat(F.lit("<system_reminder>\n"), F.col("source"), F.lit("\n</system_reminder>  "), F.col("text")))
        .otherwise(F.col("text"))
    )
    ev = docs.select(prompt.alias("prompt"), F.col("doc_id").cast("string").alias("session_id"), F.lit("/work").alias("cwd"))
    entries = prompt_events_to_entries(ev)
    c = classify_records(entries)
    return c.select(F.col("session_id").cast("bigint").alias("doc_id"), F.col("body").alias("prompt"))
