"""Similarity and hybrid search.

One query: the score is a projection over the filtered scan and the cut is
TakeOrderedAndProject, so the scan reads only ``seq, id, vector, timestamp, tags`` (+ ``text``
when keywords are scored), with the time filter pushed into Parquet.
Many queries: :func:`turnlake.operators.knn.topk_neighbors`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_score, tokenize_py
from ..functions.vector import OUT_DECIMALS, cosine_to, rank_key
from .knn import topk_neighbors
from .predicates import has_all_tags, id_prefix, in_time_range, min_score as min_score_pred


def _check_top(top: int, hi: int = 100) -> None:
    if not (1 <= top <= hi):
        raise ValueError(f"top must be between 1 and {hi}")


def _ranked(df: DataFrame, top: int, order_col: str = "seq") -> DataFrame:
    """Best ``top`` by (round(score, 9) desc, seq asc) with a 1-based rank."""
    cut = df.orderBy(rank_key("score").desc(), F.col(order_col).asc()).limit(top)
    w = Window.orderBy(rank_key("score").desc(), F.col(order_col).asc())
    return cut.withColumn("rank", F.row_number().over(w))  # window over <= top rows


def probe_index(index: DataFrame, centroids, query_vector: Sequence[float], nprobe: int) -> DataFrame:
    """Rows of a stored ANN index (see :mod:`turnlake.operators.ann`) in the ``nprobe`` lists
    nearest to one query vector: a partition filter, so only those lists are read."""
    import numpy as np

    from ..functions.vector import stack_unit
    from .ann import list_order

    q, _ = stack_unit([np.asarray(query_vector, dtype=np.float64)], centroids.shape[1])
    lists = [int(i) for i in list_order(q, centroids)[0][: max(1, int(nprobe))]]
    return index.where(F.col("list_id").isin(lists))


def _lists(nprobe: int | None) -> int:
    if not nprobe:
        raise ValueError("a search through an index needs nprobe, the number of lists to read")
    return nprobe


KERNEL_MIN_DIM = 256  # from this width one-query scoring runs on Arrow batches (measured ~3x at 768)


def _use_kernel(method: str, query_vector: Sequence[float]) -> bool:
    if method not in ("auto", "sql", "kernel"):
        raise ValueError("method must be 'auto', 'sql' or 'kernel'")
    return method == "kernel" or (method == "auto" and len(query_vector) >= KERNEL_MIN_DIM)


def _kernel_topk(corpus: DataFrame, query_vector: Sequence[float], n: int, score_col: str = "score",
                 weight: float = 1.0, bias: Column | None = None) -> DataFrame:
    """Best ``n`` rows of ``corpus`` by ``weight * cosine + bias`` through the Arrow/numpy
    kernel: only ``(seq, vector[, bias])`` go to Python (the bias, e.g. the keyword share, is
    computed in the JVM), each task keeps its n best, and the winners get their other columns
    back by a broadcast join (at most n rows)."""
    spark = corpus.sparkSession
    q = spark.createDataFrame([(0, [float(x) for x in query_vector])], "qid long, vector array<double>")
    src = corpus if bias is None else corpus.withColumn("_bias", bias)
    nb = topk_neighbors(q, src, n, corpus_cols=("seq",), strategy="broadcast", weight=weight,
                        bias_col="_bias" if bias is not None else None)
    hits = nb.select("seq", F.col("score").alias(score_col))
    return corpus.join(F.broadcast(hits), "seq")


def semantic_topk(corpus: DataFrame, query_vector: Sequence[float], top: int = 5, *, index=None,
                  nprobe: int | None = None, method: str = "auto") -> DataFrame:
    """V1: exact cosine top-k for one query vector.  With ``index=(index_rows, centroids)``
    only the ``nprobe`` nearest lists are scanned (approximate; exact at ``nprobe = nlist``).
    ``method``: 'sql' scores with JVM higher-order functions, 'kernel' on Arrow batches with
    numpy; 'auto' picks the kernel for vectors of ``KERNEL_MIN_DIM`` or more items."""
    _check_top(top)
    if index is not None:
        rows, cents = index
        corpus = probe_index(rows, cents, query_vector, _lists(nprobe))
    if _use_kernel(method, query_vector):
        return _ranked(_kernel_topk(corpus, query_vector, top), top)
    scored = corpus.withColumn("score", cosine_to("vector", query_vector))
    return _ranked(scored, top)


def hybrid_search(
    corpus: DataFrame,
    query_vector: Sequence[float],
    query_text: str | None = None,
    *,
    words: Sequence[str] | None = None,
    top: int = 5,
    tags: Sequence[str] | None = None,
    after: int | None = None,
    before: int | None = None,
    alpha: float = 1.0,
    min_score: float | None = 0.0,
    candidate_pool: int | None = None,
    index=None,
    nprobe: int | None = None,
    method: str = "auto",
) -> DataFrame:
    """V2: tag/time filters -> ``alpha*cosine + (1-alpha)*keyword`` -> min score -> top.

    ``candidate_pool=None`` filters first and ranks every matching row.  ``candidate_pool=n``
    reproduces the bounded form: take the ``n`` nearest by cosine over the whole table first
    (the reference uses ``4*top``), then filter, blend and cut.  With ``alpha >= 1`` the
    keyword score is not computed at all.  ``index=(index_rows, centroids)`` restricts the
    candidates to the ``nprobe`` nearest lists of a stored ANN index."""
    _check_top(top)
    if not (0.0 <= alpha <= 1.0):
        raise ValueError("alpha must be between 0.0 and 1.0")
    if index is not None:
        # candidates come from the probed lists of a stored ANN index, as the reference takes
        # them from its graph index; the index rows must carry the record columns
        rows, cents = index
        corpus = probe_index(rows, cents, query_vector, _lists(nprobe))
    qwords = list(words) if words is not None else tokenize_py(query_text or "")
    sem = cosine_to("vector", query_vector)
    filt = has_all_tags(tags) & in_time_range(after, before)
    kernel = _use_kernel(method, query_vector)
    if candidate_pool is None and kernel:
        # the kernel ranks the filtered rows by the final score and keeps ``top``; min_score
        # only removes low scores, so it commutes with the cut
        rows = corpus.where(filt)
        if alpha >= 1.0:
            ranked = _kernel_topk(rows, query_vector, top, "score")
        else:
            kw = F.lit(round(1.0 - float(alpha), 12)) * keyword_score("text", qwords)
            ranked = _kernel_topk(rows, query_vector, top, "score", weight=float(alpha), bias=kw)
        return _ranked(ranked.where(min_score_pred(min_score)), top)
    if candidate_pool is None:
        base = corpus.where(filt).withColumn("sem", sem)
    elif kernel:
        base = _kernel_topk(corpus, query_vector, int(candidate_pool), "sem").where(filt)
    else:
        pool = corpus.withColumn("sem", sem).orderBy(rank_key("sem").desc(), F.col("seq").asc()).limit(int(candidate_pool))
        base = pool.where(filt)
    if alpha >= 1.0:
        scored = base.withColumn("score", F.col("sem"))
    else:
        kw = keyword_score("text", qwords)
        scored = base.withColumn("score", F.lit(float(alpha)) * F.col("sem") + F.lit(round(1.0 - float(alpha), 12)) * kw)
    scored = scored.where(min_score_pred(min_score)).drop("sem")
    return _ranked(scored, top)


def search_batch(
    corpus: DataFrame,
    queries: DataFrame,
    top: int = 5,
    *,
    query_id: str = "qid",
    query_vec: str = "vector",
    tags: Sequence[str] | None = None,
    after: int | None = None,
    before: int | None = None,
    **kernel_opts,
) -> DataFrame:
    """V3: exact cosine top-k for every row of ``queries``; filters apply to the corpus first.
    Returns ``(qid, seq, id, score, rank)``; join back on ``seq`` for other columns (J1)."""
    _check_top(top)
    c = corpus.where(has_all_tags(tags) & in_time_range(after, before))
    return topk_neighbors(queries, c, top, query_id=query_id, query_vec=query_vec, **kernel_opts)


def related(corpus: DataFrame, prefix: str, top: int = 5, **kernel_opts) -> DataFrame:
    """V4: the ``top`` nearest records of the first record (insertion order) whose id starts
    with ``prefix``, itself excluded.  Returns ``(qid, seq, id, score, rank)`` with qid = the
    target's id; empty when nothing matches."""
    _check_top(top)
    target = (
        corpus.where(id_prefix(prefix)).orderBy("seq").limit(1)
        .select(F.col("id").alias("qid"), F.col("vector"))
    )
    return topk_neighbors(target, corpus, top, query_key="qid", corpus_key="id", **kernel_opts)


def related_batch(corpus: DataFrame, prefixes: DataFrame, top: int = 5, prefix_col: str = "prefix", **kernel_opts) -> DataFrame:
    """V4 for a table of id prefixes: each prefix's target is its first matching record in
    insertion order (an equi-join per prefix length, then a partial ``min``); returns
    ``(prefix, qid, seq, id, score, rank)``.  Prefixes without a match give no rows."""
    _check_top(top)
    from .mutate import _prefix_matches

    m = _prefix_matches(corpus.select("seq", "id"), prefixes.select(F.col(prefix_col).alias("prefix")).distinct())
    first = m.groupBy("prefix").agg(F.min("seq").alias("seq"))
    targets = first.join(corpus.select("seq", "id", "vector"), "seq").select("prefix", F.col("id").alias("qid"), "vector")
    nb = topk_neighbors(targets.select("qid", "vector").distinct(), corpus, top, query_key="qid", corpus_key="id", **kernel_opts)
    return targets.select("prefix", "qid").join(nb, "qid")


def knn_graph(corpus: DataFrame, k: int = 5, *, include_self: bool = False, **kernel_opts) -> DataFrame:
    """V5: the k nearest records of every record.  ``include_self=True`` keeps the record as its
    own candidate (the duplicate rule counts it among the k)."""
    queries = corpus.select(F.col("seq").alias("qid"), "vector")
    if include_self:
        return topk_neighbors(queries, corpus, k, **kernel_opts)
    return topk_neighbors(queries, corpus, k, query_key="qid", corpus_key="seq", **kernel_opts)


def rounded(df: DataFrame, col: str = "score") -> DataFrame:
    return df.withColumn(col, F.round(F.col(col), OUT_DECIMALS))
