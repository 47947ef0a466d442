"""Retrieval contexts and generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.embed import hash_embedding
from ..operators.rag import SYSTEM_PROMPT, ask_contexts, summary_contexts
from ..sources.tables import doc_records, table
from .catalog import register
from .common import AFTER, BEFORE, big
from .oracle_ctes import DOC_RECORDS, cos, with_


def _questions(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    e = table(spark, sf_dir, "embeddings")
    return b.join(e, b.item_id == e.vec_id, "left").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.col("embedding").alias("vector"))


_ASK_ORACLE = with_(
    DOC_RECORDS,
    "qs AS (SELECT b.item_id AS qid, b.text AS question, e.embedding AS qv FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)",
    f"s AS (SELECT qs.qid, r.seq, r.id, r.text, {cos('r.vector', 'qs.qv')} AS score FROM qs CROSS JOIN doc_records r)",
    "t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, seq) AS rank FROM s)",
    "c AS (SELECT qid, count(*) AS n_sources, string_agg(id, ',' ORDER BY rank) AS source_ids, "
    "string_agg('[' || rank || '] ' || text, chr(10) ORDER BY rank) AS context FROM t WHERE rank <= 5 GROUP BY qid)",
) + (
    f"SELECT qs.qid, qs.question, c.n_sources, c.source_ids, c.context, '{SYSTEM_PROMPT}' AS system, "
    "'Context:' || chr(10) || c.context || chr(10) || chr(10) || 'Question: ' || qs.question AS prompt "
    "FROM qs JOIN c USING (qid)"
)


def _ask(spark, sf_dir):
    return ask_contexts(doc_records(spark, sf_dir), _questions(spark, sf_dir), 5)


@register("ask_context", _ASK_ORACLE)
def q_ask_context(spark, sf_dir):
    """Benchmark items as questions (vector = the embedding with the same id), the 5
    nearest records as numbered context, and the user message for the model."""
    a = _ask(spark, sf_dir)
    return a.select(big("qid").alias("qid"), "question", big("n_sources").alias("n_sources"), "source_ids", "context", "system", "prompt")


_SUMMARY_ORACLE = with_(
    DOC_RECORDS,
    f"f AS (SELECT *, tags[1] AS g FROM doc_records WHERE list_contains(tags, 'hq') AND timestamp >= {AFTER} AND timestamp < {BEFORE})",
    "t AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY seq) AS rk FROM f)",
    "c AS (SELECT g, count(*) AS record_count, string_agg(id, ',' ORDER BY rk) AS source_ids, "
    "string_agg('[' || rk || '] ' || text, chr(10) ORDER BY rk) AS context FROM t WHERE rk <= 20 GROUP BY g)",
    "i AS (SELECT *, 'Summarize the following records about ' || g || '. Identify key themes, patterns, and notable items. "
    "Be concise but comprehensive.' AS instruction FROM c)",
) + (
    "SELECT g AS grp, record_count, source_ids, context, instruction, "
    "'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || instruction AS prompt FROM i"
)


@register("summary_context", _SUMMARY_ORACLE)
def q_summary_context(spark, sf_dir):
    """Per language, the first 20 'hq' records of the time window in insertion order,
    numbered, with the summary instruction about that language."""
    recs = doc_records(spark, sf_dir)
    s = summary_contexts(recs, group_by=F.col("tags")[0], tags=["hq"], after=AFTER, before=BEFORE, top=20)
    return s.select(F.col("group").alias("grp"), big("record_count").alias("record_count"), "source_ids", "context", "instruction", "prompt")


_HEX = "'0123456789abcdef'"
_EMBED_ORACLE = with_(
    "t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: strlen(w) > 1)) AS w FROM documents)",
    "h AS (SELECT doc_id, md5(lower(w)) AS h FROM t)",
    f"b AS (SELECT doc_id, (strpos({_HEX}, h[7]) - 1) % 4 * 16 + strpos({_HEX}, h[8]) - 1 AS b, "
    "sum(CASE WHEN h[9] < '8' THEN 1 ELSE -1 END) AS x FROM h GROUP BY ALL)",
    "n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM b GROUP BY doc_id)",
    "v AS (SELECT d.doc_id, i, CAST(CASE WHEN n.norm > 0 THEN coalesce(b.x, 0) / n.norm ELSE 0 END AS FLOAT) AS x FROM documents d "
    "CROSS JOIN range(0, 64) r(i) LEFT JOIN b ON b.doc_id = d.doc_id AND b.b = r.i LEFT JOIN n ON n.doc_id = d.doc_id)",
) + "SELECT doc_id, string_agg(CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT), ',' ORDER BY i) AS items FROM v GROUP BY doc_id"


@register("embed_documents", _EMBED_ORACLE)
def q_embed_documents(spark, sf_dir):
    """Every document embedded by token hashing (64 items, shown in thousandths)."""
    e = hash_embedding(table(spark, sf_dir, "documents"), "doc_id")
    return e.select("doc_id", F.array_join(F.transform("vector", lambda x: F.round(x.cast("double") * 1000).cast("bigint").cast("string")), ",").alias("items"))
