"""Exact top-k cosine neighbours of a table of queries in a table of records.

Two physical strategies, chosen by a size check on the query side:

* **broadcast queries** (query block ``rows x dim x 8 B`` under ``broadcast_limit``): the unit
  query matrix is broadcast once; ``mapInPandas`` streams the corpus in Arrow batches, does one
  matrix product per batch and keeps a running top-k per query for its partition, so each
  task emits at most ``#queries x k`` rows;
* **blocked** (anything larger): both sides get a hash block number; each query block meets
  each corpus block in one cogroup cell (an equi-join on ``(qb, cb)``, no Cartesian product),
  so no side is ever broadcast whole.  Each row is sent once for each block of the other side, so
  blocks grow with the input (:func:`grid_rows`): cells stay few until blocks have ``MAX_BLOCK_ROWS`` rows.
  Equal vectors of a side are one row of a cell (:func:`numbered`, :func:`gathered_rows`): a query vector is searched
  once for all its queries, a corpus vector brings the rows of it that can be among the k.  Vectors whose
  items all are single precision numbers are sent as such.

Pairs are scored in single precision first (:class:`_Best`); those that may be among the k by more than its
rounding error are scored in double precision, which ranks them.

Both end with one ``row_number`` per query ordered by ``(round(score, 9) desc, order key)``;
the filter on it becomes a WindowGroupLimit, which cuts each shuffle input to k rows per query
before the exchange.  Ties at the cut are resolved by the order key inside the tasks too, so
the partial results never grow with ties.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import RANK_DECIMALS, stack_unit
from ..session import checkpointed

DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024  # bytes of the dense query block
DEFAULT_BLOCK_ROWS = 4096
MAX_BLOCK_ROWS = 131072  # from here on the cells grow with the pairs
CELLS = 64
_QUERY_CHUNK = 1024  # queries scored at once inside a task (bounds the score matrix)
_COLUMNS = 1024  # corpus rows scored at once; with the queries a matrix that stays in the processor's cache
_LOWEST = -1e30  # scores are finite


def grid_rows(queries: int, corpus: int, least: int) -> int:
    """Rows of a block so that there are about ``CELLS`` cells: ``least`` at least, ``MAX_BLOCK_ROWS`` at most."""
    return max(least, min(MAX_BLOCK_ROWS, math.ceil(math.sqrt(queries * corpus / CELLS))))


def _first_k(qi: np.ndarray, ci: np.ndarray, score: np.ndarray, corder: np.ndarray, k: int):
    """The pairs among the k best of their query by (rounded score desc, corpus order asc), sorted so."""
    order = np.lexsort((corder[ci], -np.round(score, RANK_DECIMALS), qi))
    qi, ci, score = qi[order], ci[order], score[order]
    starts = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
    pos = np.arange(len(qi)) - np.repeat(starts, np.diff(np.r_[starts, len(qi)]))
    keep = pos < k
    return qi[keep], ci[keep], score[keep]


def _same_keys(qkeys: np.ndarray, ckeys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``(query, corpus)`` of the pairs with equal keys; NaN equals nothing."""
    sides = []
    for name, keys in (("q", qkeys), ("c", ckeys)):
        side = pd.DataFrame({"key": keys, name: np.arange(len(keys))})
        sides.append(side[side["key"].notna()] if keys.dtype.kind == "f" else side)
    met = sides[0].merge(sides[1], on="key")
    return met["q"].to_numpy(), met["c"].to_numpy()


def _prune(best: pd.DataFrame, k: int, qcol: str, ocol: str) -> pd.DataFrame:
    best = best.sort_values([qcol, "_rs", ocol], ascending=[True, False, True], kind="stable")
    return best[best.groupby(qcol, sort=False).cumcount() < k]


class _Best:
    """The pairs of a chunk of queries that may be among the ``k`` best of their query, while scores come in.  ``low``
    holds for each query a score that its candidates reach at least, and is raised as better ones are found."""

    def __init__(self, Q, C, corder, k, low, bias=False):
        self.Q, self.C, self.corder, self.k, self.low, self.bias = Q, C, corder, k, low, bias
        # twice the error of a dot product of d products of unit rows' items, rounded to single precision
        self.slack = 1e-9 if bias else (Q.shape[1] + 8) * 2.0 ** -23
        self.parts, self.held, self.limit = [], 0, max(4 * k * len(Q), 1 << 15)
        self.exact = None

    def take(self, S, rows, lo):
        """The scores of the chunk's ``rows`` (None: all) with the corpus rows from ``lo`` on."""
        low = self.low if rows is None else self.low[rows]
        new = np.isneginf(low)
        if S.shape[1] >= self.k and new.any():
            low = low.copy()
            low[new] = -np.partition(-S[new], self.k - 1, axis=1)[:, self.k - 1] - self.slack
            if rows is None:
                self.low[:] = low
            else:
                self.low[rows] = low
        low = np.maximum(low, _LOWEST)
        if S.max() < low.min() - self.slack:
            return
        hit = S >= low.astype(S.dtype)[:, None]
        width = hit.shape[1]
        if width % 8:
            at = np.flatnonzero(hit)
        else:  # eight at a time, as few are set
            words = np.flatnonzero(hit.reshape(-1).view(np.uint64))
            word, byte = np.nonzero(hit.reshape(-1, 8)[words])
            at = words[word] * 8 + byte
        if not len(at):
            return
        qi, ci = at // width, at % width
        self.parts.append((qi if rows is None else rows[qi], ci + lo, S.reshape(-1)[at].astype(np.float64)))
        self.held += len(at)
        if self.held > self.limit:
            self.cut()

    def cut(self):
        """Drops what cannot be among the k best any more."""
        qi, ci, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((-score, qi)) if self.bias else np.argsort(qi * 4.0 - score)  # cosines are far under 2
        self._raise(qi[order], score[order])
        keep = score >= self.low[qi]
        qi, ci, score = qi[keep], ci[keep], score[keep]
        if len(qi) > self.limit // 2:  # many alike: only their order tells which go
            qi, ci, score = self._ranked(qi, ci, score)
        self.parts, self.held = [(qi, ci, score)], len(qi)

    def _raise(self, qi, score):
        """The k-th of each query's scores, which come sorted, less the error is its new floor."""
        first = np.searchsorted(qi, np.arange(len(self.low)))
        full = np.flatnonzero(np.diff(np.r_[first, len(qi)]) >= self.k)
        self.low[full] = np.maximum(self.low[full], score[first[full] + self.k - 1] - self.slack)

    def _ranked(self, qi, ci, score):
        exact = score if self.bias else np.einsum("nd,nd->n", self.Q[qi], self.C[ci])
        return _first_k(qi, ci, exact, self.corder, self.k)

    def result(self):
        """``(query, corpus row, score)`` of the k best of each query by (rounded score desc, corpus order asc)."""
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.cut()
        qi, ci, score = self._ranked(*self.parts[0])
        self._raise(qi, np.round(score, RANK_DECIMALS))
        return qi, ci, score


def best_pairs(Qu, C, corder, k, floor, own=None, weight=1.0, bias=None, lists=None):
    """``(first query, (query of the chunk, corpus row, score))`` for chunks of the unit rows ``Qu`` against the unit rows ``C``: the k
    best of each query.  ``own``: positions (query, corpus row) of pairs to pass over.  ``lists = (cuts, probed)``: the
    corpus rows between two cuts are a list, which meets the queries that ``probed(low, high)`` marks, a column for each."""
    small = C if bias is not None else C.astype(np.float32)
    odd = np.flatnonzero(~np.isfinite(C).all(axis=1))
    spans = [0, len(C)] if lists is None else lists[0]
    room = np.empty((_QUERY_CHUNK, _COLUMNS), small.dtype)
    for s in range(0, len(Qu), _QUERY_CHUNK):
        Q = Qu[s:s + _QUERY_CHUNK]
        Qs = Q.astype(small.dtype, copy=False)
        blank = ~np.isfinite(Q).all(axis=1)
        best = _Best(Q, C, corder, k, floor[s:s + _QUERY_CHUNK], bias is not None)
        if own is not None:
            here = (own[0] >= s) & (own[0] < s + len(Q))
            oq, oc = own[0][here] - s, own[1][here]
        probed = None if lists is None else lists[1](s, s + len(Q))
        for number, (start, end) in enumerate(zip(spans[:-1], spans[1:], strict=True)):
            rows = None
            if probed is not None and not probed[:, number].all():
                rows = np.flatnonzero(probed[:, number])
                if not len(rows):
                    continue
            asked = Qs if rows is None else Qs[rows]
            for lo in range(start, end, _COLUMNS):
                hi = min(lo + _COLUMNS, end)
                S = room.reshape(-1)[:len(asked) * (hi - lo)].reshape(len(asked), hi - lo)
                np.matmul(asked, small[lo:hi].T, out=S)
                if bias is not None:
                    S *= weight
                    S += bias[None, lo:hi]
                if len(odd):
                    S[:, odd[(odd >= lo) & (odd < hi)] - lo] = -np.inf
                if blank.any():
                    S[blank if rows is None else blank[rows]] = -np.inf
                if own is not None:
                    at = (oc >= lo) & (oc < hi)
                    S[oq[at], oc[at] - lo] = -np.inf
                best.take(S, rows, lo)
        yield s, best.result()


def _score_pairs(Qu, qids, qkeys, C, cpdf, ccols, ckey, ocol, k, exclude_self, weight=1.0, bias=None, floor=None):
    """Top-k candidates of one corpus block for a set of unit query rows; the score is
    ``weight * cosine + bias`` (bias: one value per corpus row, e.g. a keyword share).  ``floor`` holds for each query
    a score that its candidates reach at least, and is raised as better ones are found."""
    floor = np.full(len(qids), -np.inf) if floor is None else floor
    own = _same_keys(qkeys, cpdf[ckey].to_numpy()) if exclude_self else None
    out = []
    for s, (qi, ci, score) in best_pairs(Qu, C, cpdf[ocol].to_numpy(), k, floor, own, weight, bias):
        if len(qi) == 0:
            continue
        frame = {"_qid": qids[s:s + _QUERY_CHUNK][qi]}
        for c in ccols:
            frame[c] = cpdf[c].to_numpy()[ci]
        frame["score"] = score
        frame["_rs"] = np.round(score, RANK_DECIMALS)
        out.append(pd.DataFrame(frame))
    return out


def narrowed(rows: DataFrame, col: str) -> DataFrame:
    """``rows`` with the vectors of ``col`` as ``array<float>`` if all of their items are single precision numbers."""
    if rows.schema[col].dataType.simpleString() != "array<double>":
        return rows
    exact = rows.agg(F.bool_and(F.col(col).cast("array<float>").cast("array<double>").eqNullSafe(F.col(col))).alias("e")).first()["e"]
    return rows.withColumn(col, F.col(col).cast("array<float>")) if exact else rows


def numbered(queries: DataFrame, vec: str) -> tuple[DataFrame, DataFrame]:
    """``(groups (_g, vec), members)``: a number for each distinct vector of ``queries``, and the other columns with the
    number of their vector; both stored."""
    rows = queries.withColumn("_h", F.xxhash64(vec)).repartition("_h").withColumn("_u", F.monotonically_increasing_id())
    alike = Window.partitionBy("_h", vec).orderBy("_u")  # the rows of a hash meet in a task, which gives their number
    rows = rows.withColumn("_g", F.first("_u").over(alike))
    stored = checkpointed(rows.withColumn(vec, F.when(F.col("_u") == F.col("_g"), F.col(vec)))
                          .withColumn("_first", F.col("_u") == F.col("_g")).drop("_h", "_u"))
    return stored.where("_first").select("_g", vec), stored.drop(vec, "_first")


def gathered_rows(corpus: DataFrame, keys: list[str], order: str, cols: list[str], most: int) -> DataFrame:
    """One row for each distinct ``keys``: of its first ``most`` rows by ``order``, each of ``cols`` as an array."""
    alike = Window.partitionBy("_h", *keys).orderBy(order)
    low = corpus.withColumn("_h", F.xxhash64(*keys)).withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= most)
    made = low.groupBy("_h", *keys).agg(F.array_sort(F.collect_list(F.struct("_r", *cols))).alias("_rows"))
    return made.select(*keys, *(F.col("_rows").getField(c).alias(c) for c in cols))


def unrolled(qi, ci, score, cpdf: pd.DataFrame, cols: list[str], order: str, k: int, ids) -> pd.DataFrame:
    """The pairs of :func:`best_pairs` with rows of :func:`gathered_rows` as their single rows, the k best of each query."""
    sizes = np.array([len(x) for x in cpdf[order].to_numpy()[ci]], dtype=np.int64)
    frame = {"_qid": np.repeat(ids[qi], sizes)}
    for c in cols:
        frame[c] = np.concatenate(list(cpdf[c].to_numpy()[ci]))
    frame["score"] = np.repeat(score, sizes)
    out = pd.DataFrame(frame)
    out["_rs"] = out["score"].round(RANK_DECIMALS)
    return _prune(out, k, "_qid", order) if sizes.max() > 1 else out


def most_alike(corpus: DataFrame, key: str) -> int:
    """The most rows that have the same ``key``."""
    return corpus.groupBy(key).count().agg(F.max("count").alias("n")).first()["n"] or 1


def other_keys(df: DataFrame, key: str, other: str):
    """Condition: two keys differ, as in :func:`_same_keys` (a null number equals nothing)."""
    a, b = F.col(key), F.col(other)
    return ~a.eqNullSafe(b) if df.schema[key].dataType.simpleString() == "string" else F.coalesce(a != b, F.lit(True))


def topk_neighbors(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    query_id: str = "qid",
    query_vec: str = "vector",
    query_key: str | None = None,
    corpus_cols: tuple[str, ...] = ("seq", "id"),
    corpus_vec: str = "vector",
    order_col: str = "seq",
    corpus_key: str | None = None,
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
    block_rows: int = DEFAULT_BLOCK_ROWS,
    strategy: str | None = None,
    weight: float = 1.0,
    bias_col: str | None = None,
    min_score: float | None = None,
) -> DataFrame:
    """Rows ``(qid, *corpus_cols, score DOUBLE, rank INT)``: the k nearest corpus rows of every
    query by cosine.  With ``query_key``/``corpus_key`` a pair whose keys are equal is skipped
    (a record is not its own neighbour).  ``order_col`` (in ``corpus_cols``) breaks ties.
    With ``bias_col`` the ranked score is ``weight * cosine + bias`` (a per-row JVM column such
    as a keyword share), so blended rankings also keep only k rows per task.  Rows of a score below
    ``min_score`` may be left out.  ``block_rows`` is the least size of a block (see :func:`grid_rows`)."""
    if k < 1:
        raise ValueError("k must be >= 1")
    if order_col not in corpus_cols:
        raise ValueError("order_col must be one of corpus_cols")
    exclude_self = query_key is not None and corpus_key is not None
    if exclude_self and corpus_key not in corpus_cols:
        raise ValueError("corpus_key must be one of corpus_cols")
    spark = queries.sparkSession
    qsel = [F.col(query_id).alias("_qid"), F.col(query_vec).alias("_qv")]
    if exclude_self:
        qsel.append(F.col(query_key).alias("_qk"))
    q = queries.select(*qsel)
    extra = [F.col(bias_col).cast("double").alias("_bias")] if bias_col else []
    c = corpus.select(*corpus_cols, F.col(corpus_vec).alias("_cv"), *extra)

    qid_type = queries.schema[query_id].dataType
    cfields = [corpus.schema[x] for x in corpus_cols]
    part_schema = T.StructType(
        [T.StructField("_qid", qid_type)]
        + [T.StructField(f.name, f.dataType) for f in cfields]
        + [T.StructField("score", T.DoubleType()), T.StructField("_rs", T.DoubleType())]
    )
    ccols = list(corpus_cols)
    ckey = corpus_key

    # size check of the query side: row count and vector width in one aggregation
    stats = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_qv")).alias("d")).first()
    nq, dim = int(stats["n"]), int(stats["d"] or 0)
    if nq == 0 or dim <= 0:
        return spark.createDataFrame([], part_schema.add("rank", T.IntegerType())).drop("_rs").withColumnRenamed("_qid", query_id)
    start = -np.inf if min_score is None else min_score - 1e-9 - (dim + 8) * 2.0 ** -23
    chosen = strategy or ("broadcast" if nq * dim * 8 <= broadcast_limit else "blocked")

    if chosen == "broadcast":
        qpdf = q.toPandas()  # bounded by the size check above
        Qu, _ = stack_unit(qpdf["_qv"], dim)
        qids = qpdf["_qid"].to_numpy()
        qkeys = qpdf["_qk"].to_numpy() if exclude_self else None
        bc = spark.sparkContext.broadcast((Qu, qids, qkeys))

        def partial_topk(it):
            Qb, qids_b, qkeys_b = bc.value
            best, more, rows = None, [], 0
            floor = np.full(len(qids_b), start)
            for cpdf in it:
                if len(cpdf) == 0:
                    continue
                C, _ = stack_unit(cpdf["_cv"], dim)
                b = cpdf["_bias"].to_numpy(dtype=np.float64) if bias_col else None
                parts = _score_pairs(Qb, qids_b, qkeys_b, C, cpdf, ccols, ckey, order_col, k, exclude_self, weight, b, floor)
                more += parts
                rows += sum(len(x) for x in parts)
                if rows > 2 * k * len(qids_b):
                    best = _prune(pd.concat(more if best is None else [best] + more, ignore_index=True), k, "_qid", order_col)
                    more, rows = [], 0
            if more:
                best = _prune(pd.concat(more if best is None else [best] + more, ignore_index=True), k, "_qid", order_col)
            if best is not None and len(best):
                yield best

        cand = c.mapInPandas(partial_topk, part_schema)
    elif chosen == "blocked":
        # leaving out the rows of one key takes so many of a query's best at most
        most = k + (most_alike(c, ckey) if exclude_self else 0)
        groups, members = numbered(narrowed(q, "_qv"), "_qv")
        c = gathered_rows(narrowed(c, "_cv"), ["_cv", *(["_bias"] if bias_col else [])], order_col, ccols, most)
        c = checkpointed(c)
        nq, nc = groups.count(), c.count()
        rows = grid_rows(nq, nc, block_rows)
        qb = max(1, math.ceil(nq / rows))
        cb = max(1, math.ceil(nc / rows))
        # block keys are ints on both sides: cogroup does not coerce key types
        qx = groups.withColumn("_qb", F.pmod(F.xxhash64("_g"), F.lit(qb)).cast("int")).withColumn(
            "_cb", F.explode(F.sequence(F.lit(0), F.lit(cb - 1))))
        cx = c.withColumn("_cb", F.pmod(F.xxhash64(F.col(order_col)[0], "_cv"), F.lit(cb)).cast("int")).withColumn(
            "_qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
        part_schema = T.StructType([T.StructField("_qid", T.LongType()), *part_schema.fields[1:]])

        def cell_topk(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
            if len(qpdf) == 0 or len(cpdf) == 0:
                return pd.DataFrame({f.name: pd.Series(dtype=object) for f in part_schema.fields})
            Qu, _ = stack_unit(qpdf["_qv"], dim)
            C, _ = stack_unit(cpdf["_cv"], dim)
            b = cpdf["_bias"].to_numpy(dtype=np.float64) if bias_col else None
            first = np.array([x[0] for x in cpdf[order_col]])
            ids = qpdf["_g"].to_numpy()
            parts = [unrolled(*found, cpdf, ccols, order_col, most, ids[s:]) for s, found in
                     best_pairs(Qu, C, first, most, np.full(len(qpdf), start), None, weight, b) if len(found[0])]
            if not parts:
                return pd.DataFrame({f.name: pd.Series(dtype=object) for f in part_schema.fields})
            return pd.concat(parts, ignore_index=True)

        cand = qx.groupBy("_qb", "_cb").cogroup(cx.groupBy("_qb", "_cb")).applyInPandas(cell_topk, part_schema)
        own = Window.partitionBy("_qid").orderBy(F.col("_rs").desc(), F.col(order_col).asc())
        best = cand.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= most).drop("_r").withColumnRenamed("_qid", "_g")
        cand = members.join(best, "_g").drop("_g")
        if exclude_self:
            cand = cand.where(other_keys(cand, "_qk", ckey)).drop("_qk")
    else:
        raise ValueError(f"unknown strategy {chosen!r}")

    w = Window.partitionBy("_qid").orderBy(F.col("_rs").desc(), F.col(order_col).asc())
    return (
        cand.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .drop("_rs")
        .withColumnRenamed("_qid", query_id)
    )
