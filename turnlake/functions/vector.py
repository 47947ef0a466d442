"""Vector column functions and the numpy helpers used inside Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores are ranked by this many decimals so that both engines and both code paths break
# ties the same way (then by ``seq``).
RANK_DECIMALS = 9
OUT_DECIMALS = 6


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def norm(col: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(col), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_to(col: Column | str, query: Sequence[float]) -> Column:
    """Cosine similarity of each row's vector with one literal query vector; 0 when either norm
    is 0.  Items past the shorter length are ignored in the dot product."""
    q = [float(x) for x in query]
    qn = math.sqrt(sum(x * x for x in q))
    if qn == 0.0:
        return F.lit(0.0)
    qarr = F.array(*[F.lit(x) for x in q])
    dot = F.aggregate(
        F.zip_with(_c(col), qarr, lambda x, y: x.cast("double") * y),
        F.lit(0.0),
        lambda acc, p: acc + F.coalesce(p, F.lit(0.0)),
    )
    n = norm(col)
    return F.when(n == 0.0, F.lit(0.0)).otherwise(dot / (n * F.lit(qn)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two vector columns."""
    dot = F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, p: acc + F.coalesce(p, F.lit(0.0)),
    )
    na, nb = norm(a), norm(b)
    return F.when((na == 0.0) | (nb == 0.0), F.lit(0.0)).otherwise(dot / (na * nb))


def rank_key(score: Column | str) -> Column:
    return F.round(_c(score), RANK_DECIMALS)


# ---- numpy helpers (run inside Arrow batches on executors) ----

def stack_unit(vectors, dim: int | None = None) -> tuple[np.ndarray, int]:
    """Stack a sequence of vectors into float64 rows scaled by their own length.  Zero vectors stay zero
    (their cosine with anything is then 0).  Rows shorter than ``dim`` (default: the longest) are
    padded with zeros; of longer ones the first ``dim`` items of the whole vector's unit are kept, so that
    the product with a vector of ``dim`` items is the cosine that the SQL form gives."""
    vecs = list(vectors)
    if dim is None:
        dim = max((len(v) for v in vecs if v is not None), default=0)
    lengths = {(-1 if v is None else len(v)) for v in vecs}
    if lengths == {dim} and vecs:
        m = np.vstack(vecs).astype(np.float64, copy=False)
        norms = np.linalg.norm(m, axis=1)
    else:
        m = np.zeros((len(vecs), dim), dtype=np.float64)
        norms = raw_norms(vecs)
        for i, v in enumerate(vecs):
            if v is None:
                continue
            a = np.asarray(v, dtype=np.float64)
            n = min(len(a), dim)
            m[i, :n] = a[:n]
    nz = norms > 0
    m[nz] /= norms[nz, None]
    return m, dim


def stack_raw(vectors, dim: int) -> np.ndarray:
    """The first ``dim`` items of each vector as float64 rows; missing items and vectors are zeros."""
    vecs = list(vectors)
    if vecs and {(-1 if v is None else len(v)) for v in vecs} == {dim}:
        return np.vstack(vecs).astype(np.float64, copy=False)
    m = np.zeros((len(vecs), dim), dtype=np.float64)
    for i, v in enumerate(vecs):
        if v is not None:
            m[i, :min(len(v), dim)] = np.asarray(v, dtype=np.float64)[:dim]
    return m


def raw_norms(vectors) -> np.ndarray:
    return np.array([0.0 if v is None else float(np.linalg.norm(np.asarray(v, dtype=np.float64))) for v in vectors])
