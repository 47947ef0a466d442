"""Importance resampling of documents towards a target distribution.

Words (and runs of several) of the source and the target are counted in hashed buckets.  A bucket's gain
is the logarithm of how much commoner it is in the target, in thousandths; the gains are one array,
with which every document is scored by the mean gain of its features, plus Gumbel noise that its id
determines.  The documents with the highest scores are drawn without replacement.

The cutoff is located by quantile-sketch bracketing.  A mergeable sketch gives a bracket of values in
which the cutoff should lie; exact counts outside of it validate that or widen it, until it holds.  The
same is then done for the ids of documents that tie at the cutoff's score.  Only the last bracket is
sorted.  Ranks come from a distributed sort of what is drawn and the sizes of its partitions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, row_groups, utf8

BUCKETS = 10_000
SCALE = 1000  # gains and noise are whole thousandths
PIECE_BYTES = 1 << 20  # of a text whose words are listed at a time
KNOWN_WORDS = 1 << 19  # whose buckets a task remembers
BRACKET_ROWS = 100_000  # sorted to locate the cutoff
#: A-Z to a-z, and what is no word (ASCII but digits and letters) to a blank
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b >= 97 and b <= 122 or b >= 128 else 32 for b in range(256))


class _Buckets(dict):
    """Bucket by feature; features met before are not hashed again."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.buckets
        return bucket


def _word_pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    low = 0
    while low < len(raw):
        high = low + PIECE_BYTES
        if high < len(raw):
            words = raw[low:high].translate(TO_WORDS)
            cut = words.rfind(b" ", 1)
            while cut < 0 and high < len(raw):  # one word longer than a piece
                high += PIECE_BYTES
                words = raw[low:high].translate(TO_WORDS)
                cut = words.rfind(b" ", 1)
            if high < len(raw):
                words, high = words[:cut], low + cut
        else:
            words = raw[low:].translate(TO_WORDS)
        yield words.split()
        low = high


def feature_buckets(raw: bytes, known: _Buckets, max_words: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """``(words, buckets of features)`` for consecutive pieces of a text: runs of 1 to ``max_words`` words
    joined by one space, repeats included, each counted where its last word is."""
    before: list[bytes] = []
    for words in _word_pieces(raw):
        around = before + words
        runs = [words]
        for n in range(2, max_words + 1):
            first = max(len(before) - n + 1, 0)
            runs.append([b" ".join(around[k:k + n]) for k in range(first, len(around) - n + 1)])
        found = list(chain.from_iterable(runs))
        yield len(words), np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        before = around[len(around) - max_words + 1:] if max_words > 1 else []


def _counter(buckets: int, max_words: int):
    def run(batches):
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for low, high in zip(offsets[:-1], offsets[1:], strict=True):
                for _, found in feature_buckets(data[low:high].tobytes(), known, max_words):
                    total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, max_words: int = 1, text_col: str = "text") -> np.ndarray:
    """Features in each bucket over all rows (null: no word).  At most ``buckets`` numbers leave a task
    and reach the driver."""
    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(_counter(buckets, max_words), "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) of each of the B buckets."""
    s, t, b = source.astype(float), target.astype(float), float(len(source))
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def _scorer(shared, max_words: int):
    def run(batches):
        gains = shared.value
        known = _Buckets(len(gains))
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for low, high in row_groups(offsets, 1 << 24):
                n_words, n_features, weight = (np.zeros(high - low, np.int64) for _ in range(3))
                for k in range(low, high):
                    for words, found in feature_buckets(data[offsets[k]:offsets[k + 1]].tobytes(), known, max_words):
                        n_words[k - low] += words
                        n_features[k - low] += len(found)
                        weight[k - low] += gains[found].sum()
                weight //= np.maximum(n_features, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), *map(pa.array, (n_words, n_features, weight))],
                    ["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in whole thousandths, from the first 32 bits of sha256(``seed:doc_id``)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("bigint")


def importance_scores(docs: DataFrame, target: DataFrame, seed: str = "2024", buckets: int = BUCKETS, max_words: int = 1,
                      id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` for every row of ``docs``; see :func:`resample`."""
    gains = bucket_gains(bucket_counts(docs, buckets, max_words, text_col), bucket_counts(target, buckets, max_words, target_col))
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # ``buckets`` numbers
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_scorer(shared, max_words), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
    return scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def locate(rows: DataFrame, wanted: int, total: int, value: str, exact: int = BRACKET_ROWS, accuracy: int = 1000
           ) -> tuple[object, int]:
    """The ``wanted``-th smallest ``value`` of ``rows``, of which there are ``total``, and how many are smaller.

    The sketch brackets the quantile with its own error on both sides.  Counts of what lies below and
    inside validate the bracket; it is widened by doubling while they don't, and taken again from inside
    with finer quantiles while it holds over ``exact`` rows of more than one value.  Its rows are
    then grouped by value and sorted: ``exact`` at most reach the driver.
    """
    low, high, below, inside = None, None, 0, total
    while inside > exact:
        within = rows if low is None else rows.where(F.col(value).between(low, high))
        share, slack = (wanted - below) / inside, 2.0 / accuracy
        while True:
            cuts = [max(share - slack, 0.0), min(share + slack, 1.0)]
            a, b = within.agg(F.percentile_approx(value, cuts, accuracy)).first()[0]
            left = within.agg(F.count(F.when(F.col(value) < a, 1)), F.count(F.when(F.col(value) <= b, 1))).first()
            if below + left[0] < wanted <= below + left[1]:
                break
            slack *= 2
        if left[1] - left[0] == inside and a != b:  # few values, most rows at the ends: halve by value
            middle = within.agg(F.percentile_approx(value, 0.5, accuracy)).first()[0]
            counts = within.agg(F.count(F.when(F.col(value) < middle, 1)), F.count(F.when(F.col(value) <= middle, 1))).first()
            if below + counts[0] >= wanted:
                b, left = within.where(F.col(value) < middle).agg(F.max(value)).first()[0], (0, counts[0])
            elif below + counts[1] < wanted:
                a, left = within.where(F.col(value) > middle).agg(F.min(value)).first()[0], (counts[1], inside)
            else:
                a, b, left = middle, middle, counts
        low, high, below, inside = a, b, below + left[0], left[1] - left[0]
        if low == high:
            return low, below
    within = rows if low is None else rows.where(F.col(value).between(low, high))
    for r in within.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")).orderBy("v").collect():
        if below + r["n"] >= wanted:
            return r["v"], below
        below += r["n"]
    raise ValueError("fewer rows than wanted")


def numbered(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``rows`` with their places 1, 2, 3... in ``order``: a distributed sort, then the sizes of its partitions
    (one row for each partition on the driver)."""
    place = checkpointed(rows.orderBy(*order)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_at", 33)
    sizes = {r["p"]: r["n"] for r in place.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, before = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(p, 0)
    start = F.get(F.array(*map(F.lit, offsets)), part.cast("int")) if offsets else F.lit(0)
    return place.withColumn(name, (start + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("bigint")).drop("_at")


def resample(docs: DataFrame, target: DataFrame, share: float | tuple[int, int] = (10, 100), min_words: int = 20,
             exact: int = BRACKET_ROWS, **options) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` for every row of ``docs``.

    Words are runs of ASCII digits and letters (A-Z lower-cased) and of all other code points above 127;
    features are their runs of 1 to ``max_words``, joined by a space, repeats counted; a feature's bucket is
    its crc32 modulo ``buckets``.  ``weight`` is the floored mean of its features' gains from ``docs``
    to ``target`` (none: 0), ``score`` adds the noise of its id.  Of the N rows with at least ``min_words``
    words the floor(N * share) with the highest scores are drawn (``share``: numerator and denominator),
    ties going to the smaller id; ``rank`` is a drawn row's place, null for the others.

    A null text has no word.  A null id has the noise of an empty one and comes after the others in ties; rows
    of equal score and id are taken in the order of their weight, features and place.  Every row
    stays, repeated ones too.  An empty table gives none, an empty target a uniform one; other columns
    are not read.
    """
    up, down = share if isinstance(share, tuple) else share.as_integer_ratio()
    rows = checkpointed(importance_scores(docs, target, **options)).withColumn("_row", F.monotonically_increasing_id())
    able = rows.where(F.col("n_words") >= min_words)
    total = able.count()
    wanted = total * up // down
    none = F.lit(None).cast("bigint")
    if not wanted:
        return rows.drop("_row").withColumn("rank", none)
    worst = able.withColumn("_v", -F.col("score"))
    value, better = locate(worst, wanted, total, "_v", exact)
    ties = able.where(F.col("score") == -value)
    inside = F.col("score") > F.lit(-value)
    known = ties.where(F.col("doc_id").isNotNull())
    number = known.count()
    if wanted - better <= number:  # the ids that tie at the cutoff, up to the last one drawn
        last = _least_id(known, wanted - better, number, exact)
        inside = inside | ((F.col("score") == F.lit(-value)) & (F.col("doc_id") <= F.lit(last)))
    else:
        inside = inside | (F.col("score") == F.lit(-value))
    first = F.coalesce((F.col("n_words") >= min_words) & inside, F.lit(False))
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features"), F.col("_row"))
    drawn = numbered(rows.where(first), *order)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.unionByName(rows.where(~first).withColumn("rank", none)).drop("_row")


def _least_id(rows: DataFrame, wanted: int, total: int, exact: int):
    """The ``wanted``-th smallest id of ``rows``; ids that are no numbers are bracketed by their hash order
    only where they are few enough, else by sorting."""
    if rows.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        return locate(rows, wanted, total, "doc_id", exact)[0]
    return numbered(rows.select("doc_id"), F.col("doc_id")).where(F.col("rank") == wanted).first()["doc_id"]


def resample_sql(documents: str, target: str, seed: str = "2024", buckets: int = BUCKETS, share: tuple[int, int] = (10, 100),
                 min_words: int = 20) -> str:
    """The same for single words in DuckDB."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = (f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), "
             "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM {documents}),
b AS (SELECT {words} AS ws FROM {target}),
dw AS (SELECT r, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
v AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])),
  lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
bytes AS (SELECT w, list_transform(range(strlen(w)),
  lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT)) AS x FROM v),
k AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), x),
  lambda c, y: xor(c >> 8, t[CAST(xor(c, y) & 255 AS BIGINT) + 1])), 4294967295) % {buckets} AS bucket FROM bytes CROSS JOIN crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN k USING (w) GROUP BY bucket),
g AS (SELECT range AS bucket, floor({SCALE} * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + {buckets}.0::DOUBLE)
  / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM bw) + {buckets}.0::DOUBLE)))) AS gain
  FROM range({buckets}) LEFT JOIN s ON s.bucket = range LEFT JOIN t ON t.bucket = range),
w AS (SELECT r, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY r),
f AS (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  CAST('0x' || left(sha256('{seed}:' || CAST(doc_id AS VARCHAR)), 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
z AS (SELECT *, weight + CAST(floor(-{SCALE} * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM f),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= {min_words})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {share[0]} // {share[1]} THEN rank END AS rank FROM z LEFT JOIN p USING (r)
"""
