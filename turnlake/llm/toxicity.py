"""Toxicity: a linear classifier over character n-grams whose binary features are scaled by naive
Bayes log-count ratios before the logistic weights are learnt."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import label_sample, row_groups, utf8

CHUNK_BYTES = 1 << 19  # of text in one numpy pass


@dataclass(frozen=True)
class ToxicityModel:
    weight: np.ndarray  # float32 by n-gram bucket: ratio times learnt weight, 0 where not selected
    intercept: float
    lengths: tuple[int, ...]
    bits: int


def _fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all white space as one blank code; other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[9, 10, 11, 12, 13]] = 32
    return table[data]


def _grams(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...], bits: int
           ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the bucket of the byte n-gram at every position, and whether the n-gram
    lies inside one row.  Each text is read with the blank that ends it as part of the corpus:
    n-grams across two rows are masked out."""
    codes = _fold_case(data).astype(np.uint64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    where = np.arange(len(data), dtype=np.int64)
    for n in lengths:
        if len(codes) < n:
            continue
        packed = codes[:len(codes) - n + 1].copy()
        for k in range(1, n):
            packed <<= np.uint64(8)
            packed |= codes[k:len(codes) - n + 1 + k]
        packed += np.uint64(n)
        packed *= np.uint64(0x9E3779B97F4A7C15)
        packed >>= np.uint64(64 - bits)
        yield packed.astype(np.int64), where[:len(packed)] + n <= ends[:len(packed)]


def _present(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...], bits: int,
             keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of some whole texts, of the buckets in ``keep`` only."""
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    found = []
    for bucket, inside in _grams(data, offsets, lengths, bits):
        mask = inside if keep is None else inside & keep[bucket]
        at = np.flatnonzero(mask)
        found.append((rows[at] << bits) | bucket[at])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> bits, pairs & ((1 << bits) - 1)


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def _fit_weights(row: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, sample: np.ndarray,
                 width: int, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression of sparse rows by Adam steps over the whole sample."""
    weight, bias = np.zeros(width + 1), 0.0
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, weight[feature] * value, len(y)) + weight[width]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        error = sample * (p - y)
        slope = np.bincount(feature, error[row] * value, width + 1) / len(y) + ridge * weight
        slope[width] = error.mean()
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        weight -= 0.1 * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.99 ** t)) + 1e-8)
    bias = float(weight[width])
    return weight[:width], bias


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 1500,
                 sample_chars: int = 20_000, lengths: tuple[int, ...] = (3, 4, 5, 6), bits: int = 20,
                 features: int = 1000, alpha: float = 1.0, ridge: float = 3e-4,
                 rounds: int = 120) -> ToxicityModel:
    """Fit on the rows of ``labels(doc_id, <label>)``, 1 for toxic, outside the held-out fold.

    The fit reads a bounded sample, see :func:`common.label_sample`.  A feature is the presence of
    a case-folded byte n-gram (hashed to ``bits`` bits).  Its ratio is
    log((alpha + toxic rows with it) / (2 alpha + toxic rows)) less the same of the other rows;
    the ``features`` n-grams whose two-sided z value is largest are kept, each scaled by its ratio,
    and a ridge logistic regression weighted to the labels' shares learns their weights.
    Without texts of both labels every score is the share of label 1 with one toxic row in ten imagined:
    without labels nothing is toxic.
    """
    shares, texts = label_sample(docs, labels, label, sample_rows, sample_chars)
    size, total = 1 << bits, sum(shares.values())
    if not texts[0] or not texts[1]:
        share = (shares.get(1, 0) + 1) / (total + 10)
        return ToxicityModel(np.zeros(size, np.float32), float(np.log(share / (1 - share))), lengths, bits)
    y = np.repeat([0.0, 1.0], [len(texts[0]), len(texts[1])])
    data, offsets = _join(texts[0] + texts[1])
    def found(keep: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for low, high in row_groups(offsets, CHUNK_BYTES):
            row, bucket = _present(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], lengths,
                                   bits, keep)
            yield row + low, bucket

    hits = [np.zeros(size), np.zeros(size)]
    for row, bucket in found():
        for k in (0, 1):
            hits[k] += np.bincount(bucket[y[row] == k], minlength=size)
    rate = [(alpha + hits[k]) / (2 * alpha + len(texts[k])) for k in (0, 1)]
    ratio = np.log(rate[1]) - np.log(rate[0])
    spread = np.sqrt(1 / (alpha + hits[0]) + 1 / (alpha + hits[1]))
    z = np.where(hits[0] + hits[1] > 0, np.abs(ratio) / spread, 0.0)
    kept = np.flatnonzero(z > 0)
    if len(kept) > features:
        kept = np.sort(kept[np.argsort(-z[kept], kind="stable")[:features]])
    place = np.full(size, -1, np.int64)
    place[kept] = np.arange(len(kept))
    row, bucket = (np.concatenate(x) for x in zip(*found(place >= 0), strict=True))
    feature = place[bucket]
    share = {k: shares[k] / total for k in (0, 1)}
    sample = np.where(y == 1, share[1] / len(texts[1]), share[0] / len(texts[0])) * len(y)
    learnt, bias = _fit_weights(row, feature, ratio[kept][feature], y, sample, len(kept), ridge, rounds)
    weight = np.zeros(size, np.float32)
    weight[kept] = (learnt * ratio[kept]).astype(np.float32)
    return ToxicityModel(weight, bias, lengths, bits)


def score_texts(data: np.ndarray, offsets: np.ndarray, model: ToxicityModel) -> np.ndarray:
    """The score of each row of a text buffer."""
    keep, out = model.weight != 0, []
    for low, high in row_groups(offsets, CHUNK_BYTES):
        own = offsets[low:high + 1] - offsets[low]
        row, bucket = _present(data[offsets[low]:offsets[high]], own, model.lengths, model.bits, keep)
        z = np.bincount(row, model.weight[bucket].astype(np.float64), high - low) + model.intercept
        out.append(1 / (1 + np.exp(-np.clip(z, -60, 60))))
    return np.concatenate(out) if out else np.zeros(0)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with columns ``score`` and ``predicted`` (replacing columns of these names), every row
    scored on its whole text.

    Null and empty texts have no feature and so the score of the intercept.  Repeated rows are
    scored alike and all kept.  Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB at 20 bits, whatever the table
    rows = docs.drop("score", "predicted")

    def run(batches):
        for batch in batches:
            score = score_texts(*utf8(batch.column(text_col)), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, T.StructType(
        [*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
