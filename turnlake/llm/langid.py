"""Language identification by interpolated Kneser-Ney character language models, one for each
language, stored in sorted hash arrays; the lowest length-normalised cross-entropy wins, with a
calibrated score and rejection."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import logistic, row_groups, shared_folder, utf8

ORDER = 4
LOW = 2  # orders that every task holds whole where a model is cut into shards
WIDTH = 12  # bits of a character's code: an n-gram packs into 48, its last character lowest
BLANK = 32
CHUNK_BYTES = 1 << 20  # of text in one numpy pass
MERGE_ROWS = 1 << 20  # n-grams that a counting task holds
SHARD_GRAMS = 1 << 22  # n-grams of a model's shard, about
SLOTS = 1 << 18  # of a task's memory of n-grams already looked up
MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so that multiplying by it loses nothing


@dataclass(frozen=True)
class LanguageModel:
    """``levels[lang][k]``: of order k + 1, sorted n-gram hashes with their discounted
    probabilities, and sorted context hashes with their back-off weights.  Of a model with ``shards``
    these are the orders up to LOW; each shard holds the higher orders, by language, of the n-grams
    whose two characters before the last fall to it, and one shard at a time is in memory."""
    langs: tuple[str, ...]
    levels: tuple[tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...], ...]
    floor: float  # probability of each character below the lowest order
    weights: tuple[float, ...]
    max_entropy: float
    shards: tuple[Broadcast, ...] = ()


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """The code of every code point: letters lower-cased where that is one code point, themselves
    below 2048 and hashed to 2048-4095 above; all others are blanks."""
    out = np.full(0x110000, BLANK, np.uint16)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            value = ord(low) if len(low) == 1 else point
            out[point] = value if value < 2048 else 2048 + (value * 2654435761 >> 8) % 2048
    return out


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and packed n-gram of ORDER characters that ends at each character of some whole
    rows of text.  A run of non-letters is one blank; before a row's start blanks are read."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = (data & 0xC0) != 0x80
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[heads]
    code = _codes()[points]
    keep = code != BLANK
    keep[1:] |= (code[:-1] != BLANK) | (rows[1:] != rows[:-1])
    keep[:1] = True
    rows, code = rows[keep], code[keep].astype(np.uint64)
    gram = code.copy()
    for k in range(1, ORDER):
        before = np.full(len(code), BLANK, np.uint64)
        before[k:] = np.where(rows[k:] == rows[:-k], code[:-k], np.uint64(BLANK))
        before <<= np.uint64(WIDTH * k)
        gram |= before
    return rows, gram


def _tail(gram: np.ndarray, order: int) -> np.ndarray:
    return gram & np.uint64((1 << (WIDTH * order)) - 1)


def count_grams(rows: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over all of ``rows(lang, text)``: counted in each task, then summed."""
    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def merged():
            for lang, parts in held.items():
                gram, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                yield lang, gram, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out():
            for lang, gram, n in merged():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in dict.fromkeys(names.tolist()):
                data, offsets = utf8(batch.column("text").filter(pa.array(names == lang)))
                for low, high in row_groups(offsets, CHUNK_BYTES):
                    _, grams = _grams(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                    gram, n = np.unique(grams, return_counts=True)
                    held.setdefault(lang, []).append((gram, n))
                    size += len(gram)
                    if size > MERGE_ROWS:
                        held = {k: [(g, c)] for k, g, c in merged()}
                        size = sum(len(p[0][0]) for p in held.values())
                        if size > MERGE_ROWS // 2:
                            yield from out()
                            held, size = {}, 0
        yield from out()

    return (rows.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def _level(gram: np.ndarray, count: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Discounted probabilities of n-grams of one order and back-off weights of their contexts; all
    n-grams of a context are given."""
    context, at = np.unique(gram >> np.uint64(WIDTH), return_inverse=True)
    total, types = np.bincount(at, count), np.bincount(at)
    sort = np.argsort(gram * MIX)
    sort_context = np.argsort(context * MIX)
    return ((gram * MIX)[sort], ((count - discount) / total[at])[sort].astype(np.float64),
            (context * MIX)[sort_context], (discount * types / total)[sort_context].astype(np.float64))


def _shard(gram, shards: int):
    """The shard of a 4-gram, of a column or an array: by the two characters before its last, which
    the contexts and the 3-gram it backs off to share."""
    if isinstance(gram, np.ndarray):
        pair = (gram >> np.uint64(WIDTH)) & np.uint64((1 << 2 * WIDTH) - 1)
        return (pair * np.uint64(2654435761) >> np.uint64(20)) % np.uint64(shards)
    pair = F.shiftright(gram, WIDTH).bitwiseAND(F.lit((1 << 2 * WIDTH) - 1))
    return F.pmod(F.shiftright(pair * F.lit(2654435761), 20), F.lit(shards)).cast("int")


def _by_language(rows: DataFrame, names: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The n-grams and counts of ``rows(lang, gram, n)`` for each of the names."""
    got = rows.select("lang", "gram", "n").toArrow()
    lang = got.column("lang").combine_chunks().dictionary_encode()
    code = {name: k for k, name in enumerate(lang.dictionary.to_pylist())}
    at = lang.indices.to_numpy(zero_copy_only=False)
    gram, n = got.column("gram").to_numpy().astype(np.uint64), got.column("n").to_numpy()
    return [(gram[own], n[own]) for own in (at == code.get(name, -1) for name in names)]


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _interpolated(levels, low: int, gram: np.ndarray, p: np.ndarray | float) -> np.ndarray:
    """``p``, the probability by the orders up to ``low``, interpolated with those of ``levels``."""
    for k, (keys, values, contexts, weights) in enumerate(levels, low + 1):
        own = _tail(gram, k)
        p = (_find(keys, values, own * MIX, 0.0)
             + _find(contexts, weights, (own >> np.uint64(WIDTH)) * MIX, 1.0) * p)
    return p


def log_probabilities(model: LanguageModel, gram: np.ndarray) -> np.ndarray:
    """Natural log probability of the last character of each n-gram given those before, by language."""
    out = np.empty((len(gram), len(model.langs)), np.float64 if model.shards else np.float32)
    for j, levels in enumerate(model.levels):
        p = _interpolated(levels, 0, gram, model.floor)
        out[:, j] = p if model.shards else np.log(p)
    if not model.shards:
        return out
    shard = _shard(gram, len(model.shards))
    for s, held in enumerate(model.shards):
        at = np.flatnonzero(shard == s)
        if len(at):
            for j, levels in enumerate(held.value):
                out[at, j] = _interpolated(levels, LOW, gram[at], out[at, j])
            held.__dict__.pop("_value", None)  # read again from its file when next needed
    return np.log(out).astype(np.float32)


class _Scorer:
    """Sums of log probabilities; n-grams met before are kept in a table of fixed size, found by
    their hash and checked, so that the sorted arrays are searched for new ones only."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.key = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
        self.value = np.zeros((SLOTS, len(model.langs)), np.float32)

    def _values(self, gram: np.ndarray) -> np.ndarray:
        slot = ((gram * MIX) >> np.uint64(64 - 18)).astype(np.int64)
        new = np.flatnonzero(self.key[slot] != gram)
        out = self.value[slot]
        if len(new):
            distinct, at = np.unique(gram[new], return_inverse=True)
            value = log_probabilities(self.model, distinct)
            out[new] = value[at]
            place = ((distinct * MIX) >> np.uint64(64 - 18)).astype(np.int64)
            last = np.full(SLOTS, -1, np.int64)
            last[place] = np.arange(len(distinct))
            filled = np.flatnonzero(last >= 0)
            self.key[filled], self.value[filled] = distinct[last[filled]], value[last[filled]]
        return out

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row: nats per character in each language, and the number of letters."""
        parts = []
        # a pass may read every shard once
        for low, high in row_groups(offsets, CHUNK_BYTES * (4 if self.model.shards else 1)):
            rows, gram = _grams(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
            values = self._values(gram)
            letters = np.bincount(rows, _tail(gram, 1) != BLANK, high - low)
            size = np.maximum(np.bincount(rows, minlength=high - low), 1)
            sums = np.stack([np.bincount(rows, values[:, j], high - low) for j in range(values.shape[1])], 1)
            parts.append((-sums / size[:, None], letters))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _features(entropy: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its entropy, and the features of its score: the lead over the second, and
    that times the log of the length."""
    best = entropy.argmin(1)
    ordered = np.sort(entropy, 1)
    lead = ordered[:, 1] - ordered[:, 0] if entropy.shape[1] > 1 else np.ones(len(entropy))
    return best, ordered[:, 0], np.column_stack([lead, lead * np.log1p(letters)])


def _fit_levels(usable: DataFrame, shard_grams: int, max_langs: int) -> LanguageModel:
    """The probabilities of all n-grams counted; a model of over ``shard_grams`` is cut into shards, which
    the driver makes one at a time.  Discounts are of whole orders, so the cut changes no value."""
    spark = usable.sparkSession
    counted = count_grams(usable).persist()
    third = (counted.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 3 * WIDTH) - 1)).alias("gram"))
             .agg(F.count("*").alias("n")).persist())
    second = third.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 2 * WIDTH) - 1)).alias("gram")).agg(F.count("*").alias("n"))
    sizes = counted.groupBy("lang").agg(F.count("*").alias("k")).collect()
    names = sorted(r["lang"] for r in sizes)
    if len(names) > max_langs:
        raise ValueError(f"{len(names)} languages; models of at most {max_langs} are sent to the tasks")
    rare = {(order, r["lang"]): (r["ones"], r["twos"]) for order, of in ((3, third), (4, counted))
            for r in of.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()}
    low, letters = [], [np.zeros(0, np.uint64)]
    for gram, count in _by_language(second, names):
        own = []
        for k in range(LOW, 0, -1):
            own.insert(0, _level(gram, count, _discount((count == 1).sum(), (count == 2).sum())))
            letters.append(np.unique(_tail(gram, 1)))
            gram, count = np.unique(_tail(gram, k - 1), return_counts=True)
        low.append(tuple(own))
    third.unpersist()

    def high(part: DataFrame):
        out = []
        for name, (gram, count) in zip(names, _by_language(part, names), strict=True):
            below, kinds = np.unique(_tail(gram, 3), return_counts=True)
            out.append((_level(below, kinds, _discount(*rare[3, name])), _level(gram, count, _discount(*rare[4, name]))))
        return tuple(out)

    shards = -(-sum(r["k"] for r in sizes) // shard_grams)
    model = LanguageModel(tuple(names), tuple(low), 1 / (len(np.unique(np.concatenate(letters))) + 1),
                          (1.0, 1.0, 0.0), float("inf"))
    if shards <= 1:
        model = replace(model, levels=tuple(a + b for a, b in zip(low, high(counted), strict=True)))
    else:
        path = f"{shared_folder(spark)}/langid-{uuid.uuid4().hex}"
        cut = counted.withColumn("shard", _shard(F.col("gram"), shards))
        cut.repartition(shards, "shard").write.partitionBy("shard").parquet(path)
        stored = spark.read.schema("lang string, gram bigint, n bigint, shard int").parquet(path)
        model = replace(model, shards=tuple(
            spark.sparkContext.broadcast(high(stored.where(F.col("shard") == s))) for s in range(shards)))
    counted.unpersist()
    return model


def fit_languages(rows: DataFrame, shard_grams: int = SHARD_GRAMS, calibration_rows: int = 2000,
                  calibration_chars: int = 20_000, max_langs: int = 1000) -> LanguageModel:
    """Fit on ``rows(lang, text)``; rows with a null in either are ignored.

    The n-gram counts cover every row, and the model holds every n-gram; of more than ``shard_grams`` it
    is cut into shards of about that size, which bounds the arrays that a task has in memory.
    Lower orders count the distinct characters seen before an n-gram, as Kneser-Ney smoothing
    does, and every order is interpolated with the one below.  The score's calibration (the probability
    of being right given lead and length) and the rejection limit (four thirds of the entropy that
    99.5 % of texts do not reach) come from the ``calibration_rows`` texts of at most
    ``calibration_chars`` characters with the smallest xxhash64 (copies once).
    """
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    model = _fit_levels(usable, shard_grams, max_langs)
    names = model.langs
    if not names:
        return model
    # the limit on the hash is found without the texts, which only the rows below it then send
    hashed = usable.where(F.length("text") <= calibration_chars).withColumn("h", F.xxhash64("text", "lang"))
    limit = hashed.select("h").orderBy("h").limit(calibration_rows).agg(F.max("h")).first()[0]
    if limit is None:
        return model
    sample = (hashed.where(F.col("h") <= limit).groupBy("h").agg(F.first("text").alias("text"), F.first("lang").alias("lang"))
              .orderBy("h").toArrow())
    texts = sample.column("text").combine_chunks()
    entropy, letters = _Scorer(model).entropies(*utf8(texts))
    best, nats, features = _features(entropy, letters)
    real = letters > 0
    right = np.array([names[b] == lang for b, lang in zip(best, sample.column("lang").to_pylist(), strict=True)])
    if not real.any():
        return model
    # one imagined miss with no lead keeps the fit finite when every text is right
    x = np.vstack([features[real], np.zeros((1, 2))])
    weights = logistic(x, np.append(right[real], False).astype(float), np.ones(len(x)))
    return replace(model, weights=weights, max_entropy=float(np.quantile(nats[real], 0.995) * 4 / 3))


def identify(docs: DataFrame, model: LanguageModel, reject: bool = True, min_score: float = 0.5,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, entropy, rejected)`` for every row, on its whole text.

    ``lang_pred`` is the language with the lowest entropy (nats per character; ties: the first
    by name).  ``rejected``: its entropy is above the model's limit or its score below ``min_score``; with
    ``reject`` such rows are ``und``.  A null text, one without a letter, and every text
    under a model without languages are ``und`` with score 0 and a null entropy, and rejected.
    Repeated rows are judged alike and all kept; other columns are not read.
    """
    shards = model.shards
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, shards=()))

    def run(batches):
        model = replace(shared.value, shards=shards)
        scorer = _Scorer(model) if model.langs else None
        names = np.array([*model.langs, "und"], dtype=object)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if scorer:
                entropy, letters = scorer.entropies(*utf8(batch.column("text")))
                best, nats, features = _features(entropy, letters)
                z = features @ np.array(model.weights[:2]) + model.weights[2]
            else:
                best, nats, letters, z = (np.zeros(n, np.int64) for _ in range(4))
            none = letters == 0
            score = np.where(none, 0.0, 1 / (1 + np.exp(-np.clip(z, -60, 60))))
            rejected = none | (nats > model.max_entropy) | (score < min_score)
            best = np.where(none | (rejected & reject), len(names) - 1, best)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score),
                 pa.array(nats.astype(float), mask=none), pa.array(rejected)],
                ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, entropy double, rejected boolean")
