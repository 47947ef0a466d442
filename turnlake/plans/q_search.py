"""Single-query search plans: V1, V2 (both pool modes), C5-C8, P1, P2, P6, T6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.search import hybrid_search, semantic_topk
from ..sources.tables import doc_records, table
from .catalog import register
from .common import AFTER, ALPHA, BEFORE, FILTER_TAG, QUERY_TEXT, QUERY_VEC_ID, TOP, big, query_vector, r6, search_out
from .oracle_ctes import DOC_RECORDS, cos, with_

KEYWORD_SHARE = "(" + " + ".join(
    f"CAST(contains(lower(r.text), '{w}') AS INTEGER)" for w in ["in", "the", "bl", "日", "la"]
) + ") / CAST(5 AS DOUBLE)"

_HYBRID_ORACLE = with_(
    DOC_RECORDS,
    f"q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = {QUERY_VEC_ID})",
    f"""s AS (SELECT r.seq, r.id, r.timestamp, array_to_string(r.tags, ',') AS tags,
          CAST({ALPHA} AS DOUBLE) * {cos('r.vector', 'q.qv')} + CAST(0.3 AS DOUBLE) * {KEYWORD_SHARE} AS score
        FROM doc_records r CROSS JOIN q
        WHERE list_contains(r.tags, '{FILTER_TAG}') AND r.timestamp >= {AFTER} AND r.timestamp < {BEFORE})""",
    "t AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, seq) AS rank FROM s WHERE score >= 0.0)",
) + f"SELECT rank, seq, id, round(score, 6) AS score, timestamp, tags FROM t WHERE rank <= {TOP}"


@register("hybrid_search", _HYBRID_ORACLE)
def q_hybrid_search(spark, sf_dir):
    """V2 filter-first: tag 'en', time window, alpha 0.7 blend of cosine and keyword share, top 10."""
    res = hybrid_search(
        doc_records(spark, sf_dir), query_vector(spark, sf_dir), QUERY_TEXT,
        top=TOP, tags=[FILTER_TAG], after=AFTER, before=BEFORE, alpha=ALPHA, min_score=0.0,
    )
    return search_out(res)


_POOL = 4 * TOP
_HYBRID_POOL_ORACLE = with_(
    DOC_RECORDS,
    f"q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = {QUERY_VEC_ID})",
    f"""p AS (SELECT r.*, {cos('r.vector', 'q.qv')} AS sem,
               row_number() OVER (ORDER BY round({cos('r.vector', 'q.qv')}, 9) DESC, r.seq) AS prank
        FROM doc_records r CROSS JOIN q)""",
    f"""s AS (SELECT r.seq, r.id, r.timestamp, array_to_string(r.tags, ',') AS tags,
          CAST({ALPHA} AS DOUBLE) * r.sem + CAST(0.3 AS DOUBLE) * {KEYWORD_SHARE} AS score
        FROM p r
        WHERE r.prank <= {_POOL} AND list_contains(r.tags, '{FILTER_TAG}')
          AND r.timestamp >= {AFTER} AND r.timestamp < {BEFORE})""",
    "t AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, seq) AS rank FROM s WHERE score >= 0.0)",
) + f"SELECT rank, seq, id, round(score, 6) AS score, timestamp, tags FROM t WHERE rank <= {TOP}"


@register("hybrid_search_pool", _HYBRID_POOL_ORACLE)
def q_hybrid_search_pool(spark, sf_dir):
    """V2 bounded form (rule 2.12-7): the 4*top nearest first, then filters, blend and cut."""
    res = hybrid_search(
        doc_records(spark, sf_dir), query_vector(spark, sf_dir), QUERY_TEXT,
        top=TOP, tags=[FILTER_TAG], after=AFTER, before=BEFORE, alpha=ALPHA, min_score=0.0,
        candidate_pool=_POOL,
    )
    return search_out(res)


_SEMANTIC_ORACLE = with_(
    f"q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = {QUERY_VEC_ID})",
    f"s AS (SELECT e.vec_id, {cos('e.embedding', 'q.qv')} AS score FROM embeddings e CROSS JOIN q)",
    "t AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)",
) + f"SELECT rank, vec_id, round(score, 6) AS score FROM t WHERE rank <= {TOP}"


@register("semantic_topk", _SEMANTIC_ORACLE)
def q_semantic_topk(spark, sf_dir):
    """V1 + C7: exact cosine top 10 of one query vector over all embeddings."""
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"))
    res = semantic_topk(emb, query_vector(spark, sf_dir), top=TOP)
    return res.select(big("rank").alias("rank"), big("seq").alias("vec_id"), r6("score").alias("score"))


_KEYWORD_ORACLE = with_(
    """s AS (SELECT doc_id, (""" + " + ".join(
        f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in ["in", "the", "bl", "日", "la"]
    ) + """) / CAST(5 AS DOUBLE) AS score FROM documents)""",
    "t AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)",
) + "SELECT rank, doc_id, round(score, 6) AS score FROM t WHERE rank <= 20"


@register("keyword_rank", _KEYWORD_ORACLE)
def q_keyword_rank(spark, sf_dir):
    """C5 + C6 + T6: keyword share of the tokenised query over every document, top 20."""
    from ..functions.text import keyword_score, tokenize_py
    from ..functions.vector import rank_key

    docs = table(spark, sf_dir, "documents")
    scored = docs.select("doc_id", keyword_score("text", tokenize_py(QUERY_TEXT)).alias("score"))
    top = scored.orderBy(rank_key("score").desc(), F.col("doc_id")).limit(20)
    from pyspark.sql import Window

    w = Window.orderBy(rank_key("score").desc(), F.col("doc_id"))
    return top.select(big(F.row_number().over(w)).alias("rank"), "doc_id", r6("score").alias("score"))


@register("keyword_rank_indexed", _KEYWORD_ORACLE)
def q_keyword_rank_indexed(spark, sf_dir):
    """C6 + T6 through a stored trigram index of all documents: the same top 20, from the texts of candidates."""
    from ..operators.textindex import build_trigrams, keyword_rank_indexed, read_trigrams, write_trigrams
    from ..session import scratch_path

    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "trigrams")
    write_trigrams(build_trigrams(docs, "doc_id"), path)
    found = keyword_rank_indexed(docs, read_trigrams(spark, path), QUERY_TEXT, 20, "doc_id")
    return found.select(big("rank").alias("rank"), "doc_id", r6("score").alias("score"))
