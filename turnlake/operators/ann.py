"""Approximate nearest-neighbour search through a partitioned index.

The reference keeps a navigable graph in memory; on Spark the same purpose (not scanning
every vector per query) is served by an inverted-file layout:

* ``build_index``: coarse cosine centroids (rounds of the V8 k-means over all records, ``nlist``
  about sqrt(n) within the broadcast bound), every record tagged with its nearest ``list_id``;
* ``write_index`` / ``read_index``: the index stored by ``list_id``, built once and searched often;
* ``probes_for_recall``: how many lists a search has to read to reach a recall, measured against the
  exact search for a bounded sample of queries;
* ``ann_search``: each query picks its ``nprobe`` nearest lists (broadcast centroids).  Lists near each other form
  blocks of bounded size (a list over the bound is cut); a query is sent once to each block that holds lists
  of it, with a bit for each of the block's lists, and never once for each list.  In a cell of one block and some of
  its queries a list meets the queries that probe it, and the exact re-rank keeps k per query.  Equal vectors
  of a side are one row.  ``nprobe = nlist`` is exact (equals :func:`search_batch`).

:mod:`turnlake.operators.ann_store` keeps such an index on disk and takes inserts and removals.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import stack_unit
from ..session import checkpointed
from ..sources.records import with_seq
from .cluster import MAX_CENTROID_BYTES, assign_clusters, kmeans_fit
from .knn import (
    best_pairs, gathered_rows, grid_rows, most_alike, narrowed, numbered, other_keys, topk_neighbors, unrolled,
)

_QUERIES = 1024  # queries whose lists are chosen at once


def default_lists(rows: int, dim: int = 1) -> int:
    """sqrt(rows), to the nearest, within the broadcast bound of the centroids."""
    return max(1, min(math.floor(math.sqrt(rows) + 0.5), MAX_CENTROID_BYTES // (8 * max(dim, 1))))


def build_index(records: DataFrame, nlist: int | None = None, *, rounds: int = 10) -> tuple[DataFrame, np.ndarray]:
    """Returns ``(index rows (seq, id, vector, list_id), centroids)``.  The lists are fitted on all
    records.  ``nlist`` defaults to sqrt(n), or as many centroids as may be broadcast; ``rounds=1`` takes
    the initial rows as centroids."""
    if nlist is None:
        size = records.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
        nlist = default_lists(size["n"], size["dim"] or 1)
    C, _ = kmeans_fit(records.select("seq", "vector"), max(1, int(nlist)), max_rounds=rounds)
    idx = assign_clusters(records.select("seq", "id", "vector"), C, cols=("seq", "id", "vector"))
    return idx.withColumnRenamed("cluster", "list_id"), C


def write_index(index: DataFrame, path: str) -> None:
    """Store the index partitioned by ``list_id`` so a probe reads only its lists."""
    gathered(index).write.mode("errorifexists").partitionBy("list_id").parquet(path)


def gathered(index: DataFrame) -> DataFrame:
    """Rows of a list in one task, or a few for a large list, so that files grow with the rows and not with tasks x lists."""
    return index.hint("rebalance", F.col("list_id"))


def read_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def list_order(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each unit row the lists, nearest first, ties to the lower id; lists without a centroid (NaN) last."""
    scores = unit @ stack_unit(list(centroids), centroids.shape[1])[0].T
    return np.argsort(np.where(np.isnan(scores), np.inf, -scores), axis=1, kind="stable")


def nearest_lists(unit: np.ndarray, centroids: np.ndarray, nprobe: int) -> np.ndarray:
    """For each unit row a mark for each list: among the first ``nprobe`` of :func:`list_order`."""
    scores = unit @ stack_unit(list(centroids), centroids.shape[1])[0].T
    away = np.where(np.isnan(scores), np.inf, -scores)
    last = np.partition(away, nprobe - 1, axis=1)[:, nprobe - 1:nprobe]
    inside, tied = away < last, away == last
    return inside | (tied & (np.cumsum(tied, axis=1) <= nprobe - inside.sum(axis=1, keepdims=True)))


def _packed(marks: np.ndarray, sparse: bool) -> list[bytes]:
    """Rows of marks as bits, or as numbers of 4 bytes where these are fewer."""
    return [np.flatnonzero(m).astype("<i4").tobytes() for m in marks] if sparse else [m.tobytes() for m in np.packbits(marks, axis=1)]


def _unpacked(packed, nlist: int, sparse: bool) -> np.ndarray:
    if not sparse:
        width = -(-nlist // 8)
        return np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), width), axis=1, count=nlist).astype(bool)
    marks = np.zeros((len(packed), nlist), dtype=bool)
    for m, p in zip(marks, packed, strict=True):
        m[np.frombuffer(p, "<i4")] = True
    return marks


def probe_lists(queries: DataFrame, centroids: np.ndarray, nprobe: int, sparse: bool, query_vec: str = "vector") -> DataFrame:
    """``queries`` with ``_lists``, the packed marks of the ``nprobe`` nearest lists of each; a centroid of NaN is no list."""
    bc = queries.sparkSession.sparkContext.broadcast(centroids)
    nprobe = max(1, min(int(nprobe), int((~np.isnan(centroids).any(axis=1)).sum())))

    def part(it):
        C = bc.value
        for pdf in it:
            for s in range(0, len(pdf), _QUERIES):
                some = pdf.iloc[s:s + _QUERIES]
                yield some.assign(_lists=_packed(nearest_lists(stack_unit(some[query_vec], C.shape[1])[0], C, nprobe), sparse))

    return queries.mapInPandas(part, T.StructType([*queries.schema.fields, T.StructField("_lists", T.BinaryType())]))


def _askers(probes: DataFrame, nlist: int, sparse: bool) -> dict[int, int]:
    """The queries that probe each list, for lists that any does."""
    def part(it):
        total = np.zeros(nlist, dtype=np.int64)
        for pdf in it:
            for s in range(0, len(pdf), _QUERIES):
                total += _unpacked(pdf["_lists"].iloc[s:s + _QUERIES], nlist, sparse).sum(axis=0)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"list_id": at, "n": total[at]})

    counts = probes.select("_lists").mapInPandas(part, "list_id long, n long")
    return {r["list_id"]: r["n"] for r in counts.groupBy("list_id").agg(F.sum("n").alias("n")).collect()}  # nlist rows


def list_blocks(centroids: np.ndarray, sizes: dict[int, int], bound: int) -> list[list[int]]:
    """The lists of ``sizes`` in blocks of about ``bound`` rows at most, lists near each other in one block: halves along
    the direction in which their centroids vary most.  A list over the bound is a block by itself."""
    todo, done = [np.array(sorted(sizes))], []
    unit = stack_unit(list(centroids), centroids.shape[1])[0]
    while todo:
        lists = todo.pop()
        rows = np.array([sizes[int(x)] for x in lists])
        if rows.sum() <= bound or len(lists) == 1:
            done.append([int(x) for x in lists])
            continue
        middle = unit[lists] - unit[lists].mean(axis=0)
        along = middle @ np.linalg.eigh(middle.T @ middle)[1][:, -1]
        order = np.argsort(along, kind="stable")
        half = np.searchsorted(np.cumsum(rows[order]), rows.sum() / 2)
        half = min(max(int(half), 1), len(lists) - 1)
        todo += [lists[order[:half]], lists[order[half:]]]
    return done


def probes_for_recall(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, recall: float = 0.92, *,
                      sample: int = 500, query_id: str = "qid", query_vec: str = "vector", exclude_self: bool = False) -> int:
    """The fewest lists to probe so that the sampled queries find a share of ``recall`` of their ``k`` exact
    nearest rows (``exclude_self``: other than themselves).

    The sample: of n queries in the order of their id those at ``i * n // m``, m = min(n, ``sample``).  Their
    exact neighbours are ``m * k`` rows, which reach the driver; the index is read once.  Ask for
    somewhat more than is wanted of all queries."""
    n = queries.count()
    m = min(n, sample)
    if m == 0:
        return 1
    numbered = with_seq(checkpointed(queries.select(query_id).orderBy(query_id)), 0, "_pos")
    chosen = numbered.where(F.col("_pos").isin(sorted({i * n // m for i in range(m)}))).select(query_id)
    asked = checkpointed(queries.select(query_id, query_vec).join(F.broadcast(chosen), query_id))  # ``sample`` rows
    near = topk_neighbors(asked, index, k, query_id=query_id, query_vec=query_vec, corpus_cols=("seq", "list_id"),
                          query_key=query_id if exclude_self else None, corpus_key="seq" if exclude_self else None).select(
        query_id, "list_id").collect()
    if not near:
        return 1
    rows = asked.collect()
    order = list_order(stack_unit([r[query_vec] for r in rows], centroids.shape[1])[0], centroids)
    place = np.argsort(order, axis=1, kind="stable")
    at = {r[query_id]: i for i, r in enumerate(rows)}
    places = np.sort([place[at[r[query_id]], r["list_id"]] for r in near])
    wanted = -(-round(recall * 1000) * len(places) // 1000)
    return int(places[wanted - 1]) + 1


def ann_search(
    index: DataFrame,
    centroids: np.ndarray,
    queries: DataFrame,
    k: int,
    nprobe: int,
    *,
    query_id: str = "qid",
    query_vec: str = "vector",
    block_rows: int = 4096,
    prune: bool = True,
    exclude_self: bool = False,
) -> DataFrame:
    """``(qid, seq, id, score, rank)`` from each query's ``nprobe`` nearest lists.  The index is read
    several times: give one that is stored.
    ``exclude_self=True`` when the queries are index records themselves (qid = their seq)."""
    nlist = centroids.shape[0]
    # a repeated id stands for its vectors as often as it comes
    asked = queries.select(query_id).join(queries.select(query_id, query_vec), query_id)
    if nprobe >= int((~np.isnan(centroids).any(axis=1)).sum()):
        own = {"query_key": query_id, "corpus_key": "seq"} if exclude_self else {}
        found = topk_neighbors(asked, index, k, query_id=query_id, query_vec=query_vec, block_rows=block_rows, **own)
        return found.select(query_id, "seq", "id", "score", "rank")
    spark = queries.sparkSession
    most = k + (most_alike(index.select("seq"), "seq") if exclude_self else 0)
    sparse = 4 * nprobe < nlist // 8
    groups, members = numbered(narrowed(asked.select(F.col(query_id).alias("_qid"), F.col(query_vec).alias("_qv")), "_qv"), "_qv")
    probes = checkpointed(probe_lists(groups, centroids, nprobe, sparse, "_qv"))
    askers = _askers(probes, nlist, sparse)
    if prune and len(askers) < nlist:
        # the probed list ids (at most nlist small numbers) become a partition filter, so a
        # stored index partitioned by list_id is read only where some query probes
        index = index.where(F.col("list_id").isin(sorted(askers)))
    index = index.select(F.col("list_id").cast("long").alias("list_id"), "seq", "id", F.col("vector").alias("_cv"))
    sizes = {r["list_id"]: r["n"] for r in index.groupBy("list_id").agg(
        F.approx_count_distinct(F.xxhash64("_cv")).alias("n")).collect() if r["list_id"] in askers}  # nlist rows
    fields = [T.StructField("_qid", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("id", T.StringType()),
              T.StructField("score", T.DoubleType()), T.StructField("_rs", T.DoubleType())]
    bound = grid_rows(groups.count(), max(sum(sizes.values()), 1), block_rows)
    blocks = list_blocks(centroids, sizes, bound) if sizes else []
    shared = spark.sparkContext.broadcast(blocks)
    # a block and its queries are cut, so that a cell is bounded on both sides; one row for each list, and for each block
    subs = [max(1, math.ceil(sum(sizes[x] for x in lists) / bound)) for lists in blocks]
    qsubs = [max(1, math.ceil(min(sum(askers[x] for x in lists), groups.count()) / bound)) for lists in blocks]
    places = F.broadcast(spark.createDataFrame(
        [(x, b, place, subs[b], qsubs[b]) for b, lists in enumerate(blocks) for place, x in enumerate(lists)],
        "list_id long, _b int, _place int, _subs int, _qsubs int"))
    cuts = F.broadcast(spark.createDataFrame([(b, subs[b], qsubs[b]) for b in range(len(blocks))], "_b int, _subs int, _qsubs int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ix = gathered_rows(narrowed(index, "_cv"), ["list_id", "_cv"], "seq", ["seq", "id"], most).join(places, "list_id")
    ix = ix.withColumn("_sub", F.pmod(F.xxhash64("_cv"), F.col("_subs")).cast("int")).withColumn("_qsub", each("_qsubs")).select(
        "_b", "_sub", "_qsub", "_place", "_cv", "seq", "id")

    def sent(batches):
        for pdf in batches:
            for s in range(0, len(pdf), _QUERIES):
                some = pdf.iloc[s:s + _QUERIES]
                marks = _unpacked(some["_lists"], nlist, sparse)
                at = [marks[:, lists] for lists in shared.value]
                met = np.array([m.any(axis=1) for m in at])
                bits = [[x.tobytes() for x in np.packbits(m, axis=1)] for m in at]
                to = [np.flatnonzero(x) for x in met.T]
                yield pd.DataFrame({"_g": some["_g"], "_qv": some["_qv"], "_bs": [x.astype(np.int32) for x in to],
                                    "_ms": [[bits[b][i] for b in x] for i, x in enumerate(to)]})

    kind = groups.schema["_qv"].dataType.simpleString()
    qx = probes.mapInPandas(sent, f"_g long, _qv {kind}, _bs array<int>, _ms array<binary>")
    qx = qx.select("_g", "_qv", F.explode(F.arrays_zip("_bs", "_ms")).alias("x")).select(
        "_g", "_qv", F.col("x._bs").alias("_b"), F.col("x._ms").alias("_marks")).join(cuts, "_b")
    qx = qx.withColumn("_qsub", F.pmod(F.xxhash64("_g"), F.col("_qsubs")).cast("int")).withColumn("_sub", each("_subs")).select(
        "_b", "_sub", "_qsub", "_g", "_qv", "_marks")

    def cell(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(cpdf) == 0:
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in fields})
        cpdf = cpdf.sort_values("_place", kind="stable")
        dim = max((len(v) for s in (qpdf["_qv"], cpdf["_cv"]) for v in s if v is not None), default=0)
        Q, _ = stack_unit(qpdf["_qv"], dim)
        C, _ = stack_unit(cpdf["_cv"], dim)
        n = len(shared.value[int(cpdf["_b"].iloc[0])])
        marks = _unpacked(qpdf["_marks"], n, False)
        spans = np.searchsorted(cpdf["_place"].to_numpy(), np.arange(n + 1))
        first, ids = np.array([x[0] for x in cpdf["seq"]]), qpdf["_g"].to_numpy()
        found = best_pairs(Q, C, first, most, np.full(len(Q), -np.inf), lists=(spans, lambda low, high: marks[low:high]))
        parts = [unrolled(*x, cpdf, ["seq", "id"], "seq", most, ids[s:]) for s, x in found if len(x[0])]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({f.name: pd.Series(dtype=object) for f in fields})

    cand = qx.groupBy("_b", "_sub", "_qsub").cogroup(ix.groupBy("_b", "_sub", "_qsub")).applyInPandas(cell, T.StructType(fields))
    own = Window.partitionBy("_qid").orderBy(F.col("_rs").desc(), F.col("seq"))
    best = cand.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= most).drop("_r").withColumnRenamed("_qid", "_g")
    cand = members.join(best, "_g").drop("_g")
    if exclude_self:
        cand = cand.where(other_keys(cand, "_qid", "seq"))
    return (
        cand.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).drop("_rs")
        .withColumnRenamed("_qid", query_id)
    )


def recall_at_k(approx: DataFrame, exact: DataFrame, query_id: str = "qid") -> float:
    """Share of exact (qid, seq) neighbours that the approximate search returned."""
    hit = exact.join(approx.select(query_id, "seq"), [query_id, "seq"], "left_semi").count()
    tot = exact.count()
    return hit / tot if tot else 1.0


def knn_graph_ann(index: DataFrame, centroids: np.ndarray, k: int, nprobe: int, **opts) -> DataFrame:
    """V5 at scale: every indexed record's k nearest other records through its ``nprobe``
    nearest lists (exact when every list is probed)."""
    queries = index.select(F.col("seq").alias("qid"), "vector")
    return ann_search(index, centroids, queries, k, nprobe, exclude_self=True, **opts)
