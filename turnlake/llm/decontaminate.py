"""Benchmark decontamination by edit distance.

The CGK random walk reads a sequence of words through a pointer that moves on or stays by a random
function of step and word; two sequences a few edits apart give walks that differ in few places, so
edit distance becomes Hamming distance.  A repetition draws a new walk and a few of its places (bit
sampling); windows whose words at these places equal those of an item are candidates.  Enough
repetitions are made to reach the target recall, measured on copies of the items with the edits
anywhere, bunched at either end and dealt evenly, and each candidate's exact edit distance is computed."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: letters of scripts written without spaces: Thai, Lao, Myanmar, Khmer, Tai Le to Tai Tham, kana, bopomofo, Han, Yi
UNSPACED = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3038-\u303c\u3040-\u312f"
            "\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua48f\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f"
            "\U0001aff0-\U0001b16f\U00020000-\U0003ffff")
WORD = re.compile(rf"(?=\w)[{UNSPACED}]|(?:(?![{UNSPACED}])\w)+")
SPACED = re.compile(r"\w+")
HAS_UNSPACED = re.compile(f"[{UNSPACED}]")
SYMBOLS = 4096  # classes of words that the walk's random function tells apart
GROUP_WORDS = 1 << 19
WINDOW_BLOCK = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCK_CHARS = 16 << 20  # of distinct item texts in one index
SIZES = (1, 2, 3, 4, 5, 6, 8, 12, 18, 27, 40, 60)  # words of a window
MAX_WALKS = 200  # of a window size


def words_of(text: str | None) -> list[str]:
    """The lower-cased runs of letters, digits and underscores; each letter of a script written without
    spaces is a word."""
    text = (text or "").lower()
    return (WORD if HAS_UNSPACED.search(text) else SPACED).findall(text)


@dataclass(frozen=True)
class Item:
    item_id: object
    words: tuple[int, ...]
    edits: int  # allowed


@dataclass(frozen=True)
class Walk:
    """One repetition at one window size."""
    moves: np.ndarray  # (steps, SYMBOLS) of 0 and 1
    places: tuple[int, ...]  # steps whose word is sampled
    prefixes: tuple[np.ndarray, ...]  # sorted keys of the items' first 1, 2, ... sampled words
    entry: np.ndarray  # the (item, offset) entry of each last key


@dataclass(frozen=True)
class Index:
    items: tuple[Item, ...]
    vocabulary: dict[str, int]
    strides: dict[int, int]  # by window size
    foreign: dict[int, int]  # by window size, words outside the vocabulary that a match can have
    walks: dict[int, tuple[Walk, ...]]
    entries: dict[int, np.ndarray]  # by window size, (item, offset)


def _run(ids: np.ndarray, starts: np.ndarray, size: int, moves: np.ndarray, places: tuple[int, ...],
         prefixes: tuple[np.ndarray, ...] | None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Walks from ``starts`` over windows of ``size`` words.  Returns the starts that are left, their keys
    and (without ``prefixes``) all keys by number of words sampled.  Windows whose sampled words so far
    are not those of an item's stop."""
    at, key, seen = starts.copy(), np.zeros(len(starts), np.uint64), []
    for step in range(places[-1] + 1):
        inside = at < starts + size
        word = np.where(inside, ids[np.minimum(at, len(ids) - 1)], -1)
        if step in places:
            key = ((key ^ (word + 2).astype(np.uint64)) * MIX) ^ ((key ^ (word + 2).astype(np.uint64)) >> np.uint64(31))
            if prefixes is None:
                seen.append(key)
            else:
                wanted = prefixes[places.index(step)]
                found = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                starts, at, key, word = starts[found], at[found], key[found], word[found]
                if not len(starts):
                    break
        at = at + moves[step][word & (SYMBOLS - 1)]
    return starts, key, seen


def edit_distance(pattern: tuple[int, ...], text: list[int]) -> int:
    """Smallest number of word edits that turn ``pattern`` into some part of ``text``
    (bit-parallel, one step a word of ``text``)."""
    size = len(pattern)
    bits: dict[int, int] = {}
    for k, word in enumerate(pattern):
        bits[word] = bits.get(word, 0) | (1 << k)
    full, last = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best = size
    for word in text:
        same = bits.get(word, 0)
        vertical = same | minus
        horizontal = ((((same & plus) + plus) ^ plus) | same) & full
        up = minus | (~(horizontal | plus) & full)
        down = plus & horizontal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
            best = min(best, score)
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
    return best


def _edited(words: tuple[int, ...], edits: int, vocabulary: int, rng: np.random.Generator,
            ranges: list[tuple[int, int]] | None = None) -> list[int]:
    """A copy with some words replaced, left out or put in, at random places, or each in its own of
    the ``ranges`` of places."""
    out = list(words)
    for k in range(edits):
        low, high = ranges[k] if ranges else (0, len(out))
        low = min(low, max(len(out) - 1, 0))
        kind, at = rng.integers(3), low + int(rng.integers(max(min(high, len(out)) - low, 1)))
        new = int(rng.integers(1, vocabulary + 2))
        if kind == 0 and out:
            out[at] = new
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, new)
    return out


def _blocks(words: int, edits: int, stride: int) -> tuple[int, int, list[int]]:
    """Window size, its stride and the first words of the blocks of an item: disjoint ones, the first at
    its start and the last at its end, each long enough for a window at every place of the grid.  One of
    them has its share of the edits at most; the size is the largest that leaves a share of one edit
    (else the smallest share), with two blocks at least where edits are allowed."""
    best = None
    for size in SIZES:
        own_stride = stride if size >= 2 * stride else 1
        count = words // (size + own_stride - 1)
        if count:
            rank = (edits > 0 and count < 2, max(edits // count, 1), -size)
            if best is None or rank < best[0]:
                best = rank, size, own_stride, count
    _, size, own_stride, count = best
    last = words - (size + own_stride - 1)
    return size, own_stride, [k * last // (count - 1) for k in range(count)] if count > 1 and edits else [0]


def _copies(item: Item, size: int, starts: list[int], vocabulary: int, rng: np.random.Generator) -> list[list[int]]:
    """Copies with all edits allowed: anywhere, in the first window, in the last, dealt over the blocks."""
    n, ends = len(item.words), [*starts[1:], len(item.words)]
    dealt = sorted((int(k) for k in np.resize(rng.permutation(len(starts)), item.edits)), reverse=True)
    return [_edited(item.words, item.edits, vocabulary, rng, ranges) for ranges in (
        None, [(0, size)] * item.edits, [(n - size, n)] * item.edits, [(starts[k], ends[k]) for k in dealt])]


def _draw(size: int, samples: int, rng: np.random.Generator) -> tuple[np.ndarray, tuple[int, ...]]:
    steps = max(samples, math.ceil(1.6 * size))
    places = tuple(sorted(rng.choice(steps, size=min(samples, steps), replace=False).tolist()))
    return rng.integers(0, 2, (steps, SYMBOLS), dtype=np.int64), places


def build_index(rows: list[tuple[object, str | None]], max_edit: float = 0.1, stride: int = 4, samples: int = 4,
                recall: float = 0.99, trials: int = 400, seed: int = 11) -> Index:
    """Index of some items ``(item_id, text)``; items without a word are left out, as nothing
    matches them.

    An item of n words allows floor(max_edit * n) word edits.  Documents are read in windows that
    start at each ``stride``-th word, those of less than twice the stride at every word.  An item is
    entered with the windows of disjoint blocks from its start to its end (see :func:`_blocks`), so that by
    pigeonhole one has its share of the edits at most; one without allowed edits with one window.  The
    number of repetitions of each size is what copies with all allowed edits need to be found by their own
    item's entries with probability ``recall``, for each number of blocks (8 or more alike) and each way to
    place the edits; if MAX_WALKS are too few, this raises.
    """
    vocabulary: dict[str, int] = {}
    items = []
    for item_id, text in rows:
        words = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text))
        if words:
            items.append(Item(item_id, words, int(max_edit * len(words) + 1e-9)))
    by_size: dict[int, list[tuple[int, int]]] = {}
    groups: dict[int, dict[int, list[int]]] = {}  # items by size and number of blocks
    foreign: dict[int, int] = {}
    strides: dict[int, int] = {}
    for k, item in enumerate(items):
        size, own_stride, starts = _blocks(len(item.words), item.edits, stride)
        foreign[size] = max(foreign.get(size, 0), 2 * (item.edits // len(starts)))
        strides[size] = own_stride
        groups.setdefault(size, {}).setdefault(min(len(starts), 8), []).append(k)
        by_size.setdefault(size, []).extend((k, start + q) for start in starts for q in range(own_stride))
    rng = np.random.default_rng(seed)
    walks, entries = {}, {}
    for size, own in sorted(by_size.items()):
        own = np.array(sorted(set(own)), np.int64).reshape(-1, 2)
        flat = np.array([w for k, q in own.tolist() for w in items[k].words[q:q + size]], np.int64)
        starts = np.arange(len(own)) * size
        # copies of items, read by a grid that falls on any of their first words alike
        text, places, copy_of, origin, case, item_of = [], [], [], [], [], []
        for g, members in enumerate(groups[size].values()):
            for k in rng.choice(members, max(trials // 4, 1)).tolist():
                item_starts = _blocks(len(items[k].words), items[k].edits, stride)[2]
                for pattern, copy in enumerate(_copies(items[k], size, item_starts, len(vocabulary), rng)):
                    at = np.arange(int(rng.integers(strides[size])), len(copy) - size + 1, strides[size])
                    places.append(len(text) + at)
                    copy_of.append(np.full(len(at), len(item_of)))
                    origin.append(len(text))
                    case.append(4 * g + pattern)
                    item_of.append(k)
                    text += copy
        text, places, copy_of = np.array(text, np.int64), np.concatenate(places), np.concatenate(copy_of)
        origin, case, item_of = np.array(origin), np.array(case), np.array(item_of)
        edits_of = np.array([items[k].edits for k in item_of])
        exact = not edits_of.any() or foreign[size] == 0
        copies_by_case = np.bincount(case)
        found, hits, made = np.zeros(len(case), bool), np.zeros(len(case)), []
        while True:
            moves, sampled = _draw(size, samples, rng)
            _, _, keys = _run(flat, starts, size, moves, sampled, None)
            order = np.argsort(keys[-1], kind="stable")
            walk = Walk(moves.astype(np.int8), sampled, tuple(np.unique(k) for k in keys[:-1]) + (keys[-1][order],),
                        order)
            made.append(walk)
            left, key, _ = _run(text, places, size, moves, sampled, walk.prefixes)
            first, last = (np.searchsorted(walk.prefixes[-1], key, side) for side in ("left", "right"))
            which = np.repeat(np.arange(len(left)), last - first)
            entry = own[walk.entry[np.arange(len(which)) - np.repeat(np.cumsum(last - first) - (last - first) - first, last - first)]]
            copy = copy_of[np.searchsorted(places, left[which])]
            begin = left[which] - entry[:, 1] - origin[copy]
            caught = np.unique(copy[(entry[:, 0] == item_of[copy]) & (np.abs(begin) <= edits_of[copy])])
            found[caught] = True
            hits[caught] += 1
            n = len(made)
            rate = (np.bincount(case, hits) / n / copies_by_case).min()
            # by the mean chance of one repetition, and by the share found by all made so far
            if ((n >= 4 or exact) and (1 - max(rate, 1e-3)) ** n <= 1 - recall
                    and (np.bincount(case, found) / copies_by_case).min() >= recall):
                break
            if n >= MAX_WALKS:
                raise RuntimeError(f"recall {recall} not reached by {n} repetitions at windows of {size} words")
        walks[size], entries[size] = tuple(made), own
    return Index(tuple(items), vocabulary, strides, foreign, walks, entries)


def find_items(index: Index, ids: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(document, item, edits, word)`` of each item found in some documents, given their word ids
    (0 for a foreign word) and offsets: the fewest edits, and the first place looked at with that."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    if not len(ids):
        return []
    tried = set()
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(len(ids)) - offsets[document]
    strange = np.concatenate([[0], np.cumsum(ids == 0)])
    for size, walks in index.walks.items():
        on_grid = np.flatnonzero(place % index.strides[size] == 0)
        fits = on_grid[on_grid + size <= offsets[document[on_grid] + 1]]
        fits = fits[strange[fits + size] - strange[fits] <= index.foreign[size]]
        for low in range(0, len(fits), WINDOW_BLOCK):
            block = fits[low:low + WINDOW_BLOCK]
            for walk in walks:
                left, key, _ = _run(ids, block, size, walk.moves, walk.places, walk.prefixes)
                last = walk.prefixes[-1]
                first, end = np.searchsorted(last, key, "left"), np.searchsorted(last, key, "right")
                for start, a, b in zip(left.tolist(), first.tolist(), end.tolist(), strict=True):
                    doc = int(document[start])
                    for item, offset in index.entries[size][walk.entry[a:b]].tolist():
                        begin = start - offset
                        if (item, begin) in tried:
                            continue
                        tried.add((item, begin))
                        own = index.items[item]
                        low_word = max(int(offsets[doc]), begin - own.edits)
                        high_word = min(int(offsets[doc + 1]), begin + len(own.words) + own.edits)
                        edits = edit_distance(own.words, ids[low_word:high_word].tolist())
                        if edits <= own.edits:
                            now = (edits, max(begin - int(offsets[doc]), 0))
                            found[doc, item] = min(found.get((doc, item), now), now)
    return [(doc, item, edits, word) for (doc, item), (edits, word) in sorted(found.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, block_items: int = 20_000, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 **index_options) -> DataFrame:
    """``(doc_id, item_id, edits, word)`` for each document row and item where some part of the whole
    text is within the item's word edits (see :func:`build_index`): the fewest edits found and
    the word the item begins near.

    The benchmark is a query set: its distinct texts are read in blocks of about ``block_items`` of them, or
    ``BLOCK_CHARS`` characters, by a hash of the text; each block's index goes to the tasks, and every block
    is held against all documents.  Documents are not shuffled; what is found is joined with the
    items of each text.  Null and empty texts contain nothing, items without a word are in
    nothing; repeated documents and repeated items each give their own rows; an empty table on
    either side gives no row; other columns are not read.  Ids may be of any type.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key bigint, edits int, word bigint"
    texts, result = _distinct_texts(items), None
    for shared in _indexes(texts, block_items, index_options):
        found = rows.mapInArrow(_matcher(shared), schema)
        result = found if result is None else result.unionByName(found)
    named = checkpointed(items.join(texts.withColumnRenamed("text", "_text"), F.col("text") == F.col("_text"))
                         .select("item_id", F.col("key").alias("_key")))
    return result.join(named, F.col("key") == F.col("_key")).select("doc_id", "item_id", "edits", "word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_items: int = 20_000, text_col: str = "text",
                  item_text_col: str = "text", **index_options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`contaminated` finds no item in; each
    block of the benchmark takes rows away from what the last one left, without a shuffle."""
    texts = _distinct_texts(benchmark.select(F.col(item_text_col).alias("text")))
    for shared in _indexes(texts, block_items, index_options):
        docs = docs.mapInArrow(_cleaner(shared, text_col), docs.schema)
    return docs


def _distinct_texts(items: DataFrame) -> DataFrame:
    """``(text, key)``: each text of the items once, numbered."""
    texts = checkpointed(items.where(F.col("text").isNotNull()).select("text").distinct())
    return texts.withColumn("key", F.monotonically_increasing_id())


def _indexes(texts: DataFrame, block_items: int, index_options: dict):
    """The broadcast index of each block of texts."""
    size = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(size[0] / block_items), math.ceil(size[1] / BLOCK_CHARS))
    for k in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("text")
        index = build_index([(r["key"], r["text"]) for r in own.collect()], **index_options)
        yield texts.sparkSession.sparkContext.broadcast(index)


def _found_in(index: Index, texts: list[str | None]):
    """``find_items`` over some texts, a bounded number of words at a time: ``(first text, found)``."""
    get, low = index.vocabulary.get, 0
    while low < len(texts):
        parts, size, high = [], 0, low
        while high < len(texts) and (high == low or size < GROUP_WORDS):
            words = words_of(texts[high])
            parts.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
            size += len(words)
            high += 1
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        yield low, find_items(index, np.concatenate(parts), offsets)
        low = high


def _matcher(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            for low, found in _found_in(index, batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([low + f[0] for f in found], pa.int64())),
                     pa.array([index.items[f[1]].item_id for f in found], pa.int64()),
                     pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int64())],
                    ["doc_id", "key", "edits", "word"])

    return run


def _cleaner(shared, text_col: str):
    def run(batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for low, found in _found_in(shared.value, batch.column(text_col).to_pylist()):
                clean[[low + f[0] for f in found]] = False
            yield batch.filter(pa.array(clean))

    return run
