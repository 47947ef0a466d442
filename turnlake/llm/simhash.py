"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last one filled up with zeros).
The binary Golay code (23, 12) is perfect: every 23-bit word lies within 3 bits of one codeword.  Two
words at most 2 bits apart share a codeword that is within 4 bits of both (the one nearest to a
word between them), and no word has more than 6 codewords that near.  If two fingerprints differ
in at most 2 bits, then by pigeonhole some segment is equal and the next one (cyclically) differs in
at most one bit.  So each fingerprint gets, for each segment, keys of that segment's value and one
nearby codeword of the next segment: 18 keys at most, of 30 to 35 bits.  Fingerprints that share
a key are joined and their distance is verified."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components

GENERATOR = 0b101011100011  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, number of bits
REACH = 4  # codewords this near to a segment are its keys


def _remainder(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials by the generator: 0 for codewords, below 2^11."""
    word = word.copy()
    for bit in range(22, 10, -1):
        word ^= np.where((word >> bit) & 1 == 1, np.int64(GENERATOR << (bit - 11)), np.int64(0))
    return word


@lru_cache(maxsize=1)
def nearby_patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each remainder, the error patterns of at most 4 bits with it (filled up with
    the first one) and their number: adding one to a word gives a codeword."""
    patterns = np.array(sorted((sum(1 << b for b in bits) for k in range(REACH + 1)
                                for bits in combinations(range(23), k)), key=lambda p: (p.bit_count(), p)))
    rest = _remainder(patterns)
    order = np.argsort(rest, kind="stable")
    counts = np.bincount(rest, minlength=2048)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    column = np.minimum(np.arange(counts.max())[None, :], counts[:, None] - 1)
    return patterns[order][first[:, None] + column], counts


def codeword_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 12-bit indices of the codewords within 4 bits of each 23-bit word (repeated to
    the same width) and how many there are."""
    patterns, counts = nearby_patterns()
    rest = _remainder(segment)
    return (segment[:, None] ^ patterns[rest]) >> 11, counts[rest]


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (row, key) pairs of some uint64 fingerprints."""
    parts = [((fingerprints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)
             for at, width in SEGMENTS]
    rows, keys = [], []
    for k, exact in enumerate(parts):
        index, count = codeword_indices(parts[(k + 1) % len(parts)])
        row, col = np.nonzero(np.arange(index.shape[1])[None, :] < count[:, None])
        rows.append(row)
        keys.append((np.int64(k) << 40) | (exact[row] << 12) | index[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a whole text: A-Z lower-cased, split at ASCII white space, shingles of
    ``words`` words joined by a blank, repeats included (fewer words: all of them); a bit is 1 if it
    is set in over half of the shingles' XXH64 (seed 42).  No word: 0."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    starts = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    low = [0, *(starts[:len(parts) - words] + 1).tolist()]
    high = [*starts[words - 1:].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(low), 1 << 16):
        hashes = np.array([digest(joined[a:b], 42)
                           for a, b in zip(low[at:at + (1 << 16)], high[at:at + (1 << 16)], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(low)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` is the fingerprint's 64 bits as a signed long."""
    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))],
                                             ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct ``fp`` at most ``max_bits`` (2 or fewer) bits apart,
    each pair once.  A key that many fingerprints share is an ordinary skewed equi-join, which Spark
    splits; only verified pairs leave it."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the segments and codeword reach are for at most 2 bits")

    def run(batches):
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False)
            row, key = fuzzy_keys(values.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(values[row])], ["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(run, "key bigint, fp bigint")
    left, right = keyed.select("key", F.col("fp").alias("a")), keyed.select("key", F.col("fp").alias("b"))
    near = F.expr(f"a < b AND bit_count(a ^ b) <= {int(max_bits)}")
    return left.join(right, "key").where(near).select("a", "b").distinct()


def simhash_groups(docs: DataFrame, words: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``: the smallest id reachable by links of
    fingerprints at most ``max_bits`` apart.

    Rows of one fingerprint are first reduced to it and its smallest id, so that copies, however
    many, are linked through one row.  Texts without a word (null, empty, blank) have
    fingerprint 0, which links like any other.  Repeated rows stay; a null id stays and counts only
    where its group has no other.  An empty table gives no row; other columns are not read.
    """
    marked = checkpointed(fingerprints(docs, words, id_col, text_col))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    pairs = links(distinct, max_bits)
    roots = components(distinct.select(F.col("fp").alias("node")), pairs)
    named = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "least", "root")
    smallest = checkpointed(named.groupBy("root").agg(F.min("least").alias("component_id")))
    of_fp = named.join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(of_fp, marked["fp"] == of_fp["_fp"]).select("doc_id", "fp", "component_id")
