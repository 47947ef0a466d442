"""Quality classifier by compression: two zstandard dictionaries, one built from text labelled
good and one from text labelled bad; the normalised difference of the two compressed sizes of a
text, calibrated at its compression rate, becomes the probability of being good."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import label_sample, logistic


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # of the features of _Sizer.features, then of 1
    piece_bytes: int
    level: int


def _pieces(text: bytes, size: int) -> list[bytes]:
    return [text[i:i + size] for i in range(0, len(text), size)]


class _Sizer:
    """Compressed sizes of whole texts under both dictionaries, piece by piece."""

    def __init__(self, model: QualityModel):
        self.size = model.piece_bytes
        self.compress = [
            zstandard.ZstdCompressor(level=model.level, write_checksum=False, write_content_size=False,
                                     write_dict_id=False, dict_data=self._ready(d, model.level)).compress
            for d in (model.good, model.bad)]

    @staticmethod
    def _ready(data: bytes, level: int) -> zstandard.ZstdCompressionDict:
        made = zstandard.ZstdCompressionDict(data)
        made.precompute_compress(level=level)
        return made

    def features(self, text: bytes) -> tuple[float, float, float]:
        """The difference (size under bad - size under good) / the larger size, from -1 to 1; the log
        of that size by the text's; the product of both.  All 0 for an empty text."""
        good = bad = 0
        for piece in _pieces(text, self.size):
            good += len(self.compress[0](piece))
            bad += len(self.compress[1](piece))
        if not text:
            return 0.0, 0.0, 0.0
        larger = max(good, bad)
        difference, rate = (bad - good) / larger, float(np.log(larger / len(text)))
        return difference, rate, difference * rate


def _dictionary(texts: list[bytes], size: int, piece_bytes: int) -> bytes:
    """A trained dictionary; too little text to train on serves as raw content itself."""
    pieces = [p for t in texts for p in _pieces(t, piece_bytes) if len(p) >= 8]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return (b"\n".join(pieces) or b" " * 8)[-size:]


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 1500,
                sample_chars: int = 20_000, dict_bytes: int = 112_640, piece_bytes: int = 4096,
                level: int = 3) -> QualityModel:
    """Fit on the rows of ``labels(doc_id, <label>)``, 1 for good, outside the held-out fold.

    The fit reads a bounded sample, see :func:`common.label_sample`: at most ``sample_rows`` texts
    of each label, of at most ``sample_chars`` characters.  Two of three train the dictionary, the
    third calibrates, weighted by the labels' shares of all labelled rows.  Without texts of both
    labels every score is the (smoothed) share of label 1.
    """
    shares, texts = label_sample(docs, labels, label, sample_rows, sample_chars)
    train = {k: [t for i, t in enumerate(v) if i % 3] or v for k, v in texts.items()}
    hold = {k: [t for i, t in enumerate(v) if i % 3 == 0] for k, v in texts.items()}
    blank = QualityModel(_dictionary(train[1], dict_bytes, piece_bytes),
                         _dictionary(train[0], dict_bytes, piece_bytes), (0.0, 0.0, 0.0, 0.0), piece_bytes, level)
    total = sum(shares.values())
    if not hold[0] or not hold[1]:
        share = (shares.get(1, 0) + 1) / (total + 2)
        return replace(blank, weights=(0.0, 0.0, 0.0, float(np.log(share / (1 - share)))))
    sizer = _Sizer(blank)
    x = np.array([sizer.features(t) for k in (0, 1) for t in hold[k]])
    y = np.repeat([0.0, 1.0], [len(hold[0]), len(hold[1])])
    weight = np.where(y == 1, shares[1] / total / len(hold[1]), shares[0] / total / len(hold[0])) * len(y)
    return replace(blank, weights=logistic(x, y, weight))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted, difference)`` for every row of ``docs``, on its whole text.

    Null and empty texts have features of 0 and so the score of the calibration's intercept.
    Repeated rows are scored alike and all kept; other columns are not read.
    """
    def run(batches):
        sizer = _Sizer(model)
        for batch in batches:
            found = np.array([sizer.features((t or "").encode()) for t in batch.column("text").to_pylist()],
                             dtype=np.float64).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip(found @ model.weights[:3] + model.weights[3], -60, 60)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)),
                 pa.array(found[:, 0])], ["doc_id", "score", "predicted", "difference"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int, difference double")

