"""Periodic runs of words: every maximal stretch of a text that repeats with some period.

With E(p) the places i at which word i equals word i + p, a run of period p and length l is a maximal
stretch of l - p places in E(p).  Periods are searched by octave, [P, 2P).  Texts are exploded into
overlapping tiles, whose size follows the octaves that they serve; every tile is solved by itself.  In an
octave, block boundaries are set so close that each stretch looked for holds a whole block.  Where a
block equals the one p words on (one comparison of hashes for all lags of the octave), the stretch is
lengthened both ways by the Z-function at the block's two boundaries, of the words after the last
equal block and, backwards, of those before the first one; both are found by halving steps over hashes of 1, 2, 4...
words.  Tiles overlap by more than the shortest stretch looked for, so a shorter fragment is never
needed and a longer stretch is covered by fragments that overlap.

Fragments are shuffled by document and period and stitched where they overlap.  A stretch of several
periods has equal ends for all of them; the smallest period is its own."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, row_groups, utf8

TILE_WORDS = 4096  # before the overlap; of the first octaves
SPREAD_BYTES = 8 << 20  # a longer text's tiles are dealt out to tasks
GROUP_BYTES = 4 << 20  # of texts solved at a time
PIECE_BYTES = 1 << 20  # of a text split at a time
BLOCK_CELLS = 1 << 21  # comparisons at a time
WHITE = re.compile(rb"[\x20\x09-\x0D]")
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
FRAGMENT = "struct<period:bigint,low:bigint,high:bigint>"
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    low = 0
    while low < len(raw):
        end = WHITE.search(raw, low + PIECE_BYTES)
        high = end.start() if end else len(raw)
        yield raw[low:high].split()
        low = high


def _numbered(raw: bytes, known: _Vocabulary) -> tuple[np.ndarray, bytes]:
    """Numbers of a text's words, equal where the words are, and the words joined by one space."""
    numbers, joined = [np.zeros(0, np.int64)], []
    for words in _pieces(raw):
        if words:
            numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            joined.append(b" ".join(words))
    return np.concatenate(numbers), b" ".join(joined)


def plan_tiles(n: int, tile_words: int = TILE_WORDS) -> list[tuple[int, int, int, int]]:
    """``(start, size, low, high)`` of the tiles of a text of n words: the octaves from ``low`` to ``high``
    are solved in it.  Tiles start at multiples of a base and have half of it added; as their periods are below
    a quarter of the base, they overlap by at least another quarter of it in each E(p)."""
    out, base, low = [], tile_words, 1
    while 2 * low <= n:
        last = n <= base + base // 2
        high = max(n // 2, 1) if last else base // 8
        start = 0
        while True:
            size = min(base + base // 2, n - start)
            out.append((start, size, low, high))
            if start + size >= n:
                break
            start += base
        if last:
            break
        while low <= high:
            low *= 2
        base *= 4
    return out


def _block(octave: int, min_length: int) -> int:
    """Words of a block: two of them, less one word, are no longer than any stretch looked for."""
    least = min(max(p, min_length - p) for p in range(octave, min(2 * octave, max(octave, min_length) + 1)))
    block = 1
    while 4 * block - 1 <= least:
        block *= 2
    return block


def solve_tiles(words: np.ndarray, offsets: np.ndarray, low: int, high: np.ndarray, min_length: int = 12
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(tile, period, first, end)``: in each of some tiles (``offsets`` into ``words``) the maximal stretches
    of places equal to the one a period later, with periods of the octaves from ``low`` to the tile's ``high``,
    and at least the period and ``min_length`` less the period long."""
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
    tiles, hashes, octave = np.arange(len(high)), [], 1
    while True:
        sizes = np.diff(offsets)
        stay = (high >= octave) & (sizes >= max(2 * octave, min_length))
        if not stay.all():  # the tiles that this octave and later ones concern
            at = np.repeat(stay, sizes)
            words, hashes = words[at], [h[at] for h in hashes]
            tiles, high, sizes = tiles[stay], high[stay], sizes[stay]
            offsets = np.concatenate([[0], np.cumsum(sizes)])
        if not len(tiles):
            break
        block = _block(octave, min_length)
        while 1 << len(hashes) <= block:
            if not hashes:
                hashes.append(_mixed(words.astype(np.uint64)))
                continue
            half, last = 1 << (len(hashes) - 1), hashes[-1]
            joined = last * MIX[0]
            joined[:-half] += last[half:]
            hashes.append(_mixed(joined))
        if octave >= low:
            part = _octave(hashes, offsets, octave, block, min_length)
            found.append((tiles[part[0]], *part[1:]))
        octave *= 2
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(32))) * MIX[1]
    return value ^ (value >> np.uint64(29))


def _octave(hashes: list[np.ndarray], offsets: np.ndarray, octave: int, block: int, min_length: int):
    n = int(offsets[-1])
    own = hashes[block.bit_length() - 1]
    padded = np.concatenate([own, np.zeros(2 * octave, np.uint64)])
    blocks, at, lags = -(-n // block), [], []
    step = max(1, BLOCK_CELLS // octave)
    for j in range(0, blocks, step):
        k = min(step, blocks - j)
        later = np.lib.stride_tricks.as_strided(padded[j * block + octave:], (k, octave), (8 * block, 8), writeable=False)
        row, lag = np.nonzero(later == own[j * block:(j + k - 1) * block + 1:block, None])
        at.append((row + j) * block)
        lags.append(lag + octave)
    at, lags = np.concatenate(at), np.concatenate(lags)
    tile = np.searchsorted(offsets, at, "right") - 1
    fits = at + lags + block <= offsets[tile + 1]
    at, lags, tile = at[fits], lags[fits], tile[fits]
    order = np.argsort(lags * np.int64(n + 1) + at, kind="stable")
    at, lags, tile = at[order], lags[order], tile[order]
    new = np.concatenate([[True], (np.diff(at) != block) | (np.diff(lags) != 0) | (np.diff(tile) != 0)])[:len(at)]
    first, end = at[new], at[np.concatenate([new[1:], [True]])[:len(at)]] + block
    lags, tile = lags[new], tile[new]
    # the next block on either side differs, so the Z-values at the boundaries are below a block
    start, stop = offsets[tile], offsets[tile + 1]
    for level in range(block.bit_length() - 2, -1, -1):
        width, h = 1 << level, hashes[level]
        more = end + lags + width <= stop
        more[more] = h[end[more]] == h[end[more] + lags[more]]
        end = np.where(more, end + width, end)
        more = first - width >= start
        more[more] = h[first[more] - width] == h[first[more] - width + lags[more]]
        first = np.where(more, first - width, first)
    keep = end - first >= np.maximum(lags, min_length - lags)
    return tile[keep], lags[keep], (first - start)[keep], (end - start)[keep]


def _smallest_periods(found, starts: np.ndarray):
    """Fragments in words of their texts; of those in one tile with equal ends, the one with the smallest
    period.  Two periods p < q with equal ends at least 2 q apart have a common divisor that is a period
    too, up to the ends of the whole run, so both show the same ends in every tile that shows q."""
    tile, period, first, end = found
    order = np.lexsort((period, end + period, first, tile))
    tile, period, first, end = (x[order] for x in (tile, period, first, end))
    new = np.ones(len(tile), bool)
    new[1:] = (np.diff(tile) != 0) | (np.diff(first) != 0) | (np.diff(end + period) != 0)
    tile, period = tile[new], period[new]
    return tile, period, first[new] + starts[tile], end[new] + starts[tile]


def fragments(texts: list[np.ndarray], min_length: int = 12, tile_words: int = TILE_WORDS):
    """``(text, period, low, high)``: the stretches that the tiles of some texts (numbers of words) show."""
    levels: dict[int, list[tuple[int, int, int, int]]] = {}
    for k, words in enumerate(texts):
        for start, size, low, high in plan_tiles(len(words), tile_words):
            levels.setdefault(low, []).append((k, start, size, high))
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
    for low, tiles in levels.items():
        owner, starts, sizes, high = (np.array(x, np.int64) for x in zip(*tiles, strict=True))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        words = np.concatenate([texts[k][a:a + n] for k, a, n, _ in tiles])
        found = _smallest_periods(solve_tiles(words, offsets, low, high, min_length), starts)
        out.append((owner[found[0]], *found[1:]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _fragment_lists(found, rows: int) -> pa.ListArray:
    text, period, low, high = found
    order = np.argsort(text, kind="stable")
    ends = np.searchsorted(text[order], np.arange(rows + 1))
    fields = pa.StructArray.from_arrays([pa.array(x[order]) for x in (period, low, high)], ["period", "low", "high"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)


def _solver(min_length: int, tile_words: int, with_fragments: bool):
    """Texts split and solved; those with fragments or those without."""
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for low, high in row_groups(offsets, GROUP_BYTES):
                known = _Vocabulary()
                parts = [_numbered(data[offsets[k]:offsets[k + 1]].tobytes(), known) for k in range(low, high)]
                found = fragments([p[0] for p in parts], min_length, tile_words)
                out = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array([len(p[0]) for p in parts], pa.int64()),
                     pa.array([p[1] for p in parts], pa.binary()).cast(pa.string()), _fragment_lists(found, high - low)],
                    ["doc_id", "n_words", "words", "fragments"])
                has = np.isin(np.arange(high - low), found[0])
                yield out.filter(pa.array(has if with_fragments else ~has))

    return run


def _long(batches):
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for k in range(batch.num_rows):
            joined = [b" ".join(words) for words in _pieces(data[offsets[k]:offsets[k + 1]].tobytes())]
            text = b" ".join(j for j in joined if j)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(k, 1), pa.array([text.count(b" ") + 1 if text else 0], pa.int64()),
                 pa.array([text], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "words"])


def _tile_rows(tile_words: int):
    def run(batches):
        for batch in batches:
            for k, text in enumerate(batch.column("words")):
                words = _numbered(text.as_py().encode(), _Vocabulary())[0].astype(np.int32)
                for start, size, low, high in plan_tiles(len(words), tile_words):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("_row").slice(k, 1), *(pa.array([x], pa.int64()) for x in (start, low, high)),
                         pa.array([words[start:start + size].tobytes()], pa.binary())],
                        ["_row", "start", "low", "high", "words"])

    return run


def _tile_solver(min_length: int):
    def run(batches):
        for batch in batches:
            for row, start, low, high, raw in zip(*(batch.column(c).to_pylist() for c in (
                    "_row", "start", "low", "high", "words")), strict=True):
                words = np.frombuffer(raw, np.int32)
                found = solve_tiles(words, np.array([0, len(words)]), low, np.array([high]), min_length)
                found = _smallest_periods(found, np.array([start]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), row)), *map(pa.array, found[1:])],
                                                 ["_row", "period", "low", "high"])

    return run


def stitch(found: DataFrame, min_length: int = 12) -> DataFrame:
    """Runs ``(_row, runs)`` of fragments ``(_row, period, low, high)``: of each document and period those that
    overlap are joined, and of equal stretches the smallest period is taken."""
    from pyspark.sql import Window

    ahead = Window.partitionBy("_row", "period").orderBy("low", "high")
    reached = F.max("high").over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    parted = found.withColumn("_new", F.coalesce(F.col("low") > reached, F.lit(True)).cast("int"))
    island = F.sum("_new").over(ahead.rowsBetween(Window.unboundedPreceding, 0))
    whole = (parted.withColumn("_island", island).groupBy("_row", "period", "_island")
             .agg(F.min("low").alias("low"), F.max("high").alias("high"))
             .where(F.col("high") - F.col("low") >= F.greatest("period", min_length - F.col("period"))))
    least = whole.groupBy("_row", F.col("low").alias("start"), (F.col("high") + F.col("period") - F.col("low")).alias("length")).agg(
        F.min("period").alias("period"))
    return least.groupBy(F.col("_row").alias("_owner")).agg(
        F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))


def _collapse(batches):
    """Texts without the words that repeat a run's first period."""
    for batch in batches:
        data, offsets = utf8(batch.column("words"))
        out = []
        for k, runs in enumerate(batch.column("runs")):
            raw = data[offsets[k]:offsets[k + 1]]
            n = batch.column("n_words")[k].as_py()
            depth = np.zeros(n + 1, np.int64)
            for r in runs.as_py() or ():
                depth[r["start"] + r["period"]] += 1
                depth[r["start"] + r["length"]] -= 1
            stays = np.cumsum(depth)[:n] == 0
            ends = np.append(np.flatnonzero(raw == 32), len(raw))
            starts = np.concatenate([[0], ends[:-1] + 1])
            edge = np.diff(np.concatenate([[0], stays.astype(np.int8), [0]]))
            out.append(b" ".join(raw[starts[a]:ends[b]].tobytes() for a, b in
                                 zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, strict=True)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), batch.column("runs"), pa.array(out, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, min_length: int = 12, tile_words: int = TILE_WORDS, spread_bytes: int = SPREAD_BYTES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for every row of ``docs``.

    Words are split at ASCII white space and numbered from 0.  ``runs`` holds ``{start, length, period}``
    of every maximal run with its smallest period and a length of at least ``min_length`` and twice the
    period, by start (then length, then period).  ``collapsed`` is the text's words, joined by one space, without those that
    some run holds after its first period.

    Null, empty and blank texts have no word, no run and an empty ``collapsed``.  Rows are taken one by
    one: repeated rows and null ids stay, with results of their own.  An empty table gives no row; other
    columns are not read.  Texts of any length are solved whole: one of over ``spread_bytes`` has its tiles dealt out to
    tasks.  Stretches are found by 64-bit hashes of blocks and end where words differ.
    Texts without a fragment have no run and are returned by the pass that finds that out; the
    others are written to the shared folder first, so that their fragments' rows have a fixed name.
    """
    if tile_words < 64 or tile_words & (tile_words - 1) or not 2 <= min_length <= tile_words // 4:
        raise ValueError("tile_words must be a power of two, at least 64 and four times min_length")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    spread = F.coalesce(F.octet_length("text") > spread_bytes, F.lit(False))
    solved = f"doc_id {kind}, n_words bigint, words string, fragments array<{FRAGMENT}>"
    short = rows.where(~spread)
    plain = short.mapInArrow(_solver(min_length, tile_words, False), solved)
    long = rows.where(spread).mapInArrow(_long, f"doc_id {kind}, n_words bigint, words string")
    open_ = short.mapInArrow(_solver(min_length, tile_words, True), solved).unionByName(
        long.withColumn("fragments", F.lit(None).cast(f"array<{FRAGMENT}>")))
    open_ = checkpointed(open_).withColumn("_row", F.monotonically_increasing_id())
    tiles = open_.where("fragments IS NULL").select("_row", "words").mapInArrow(
        _tile_rows(tile_words), "_row bigint, start bigint, low bigint, high bigint, words binary")
    dealt = tiles.repartition("_row", "low", "start").mapInArrow(
        _tile_solver(min_length), "_row bigint, period bigint, low bigint, high bigint")
    found = open_.where("fragments IS NOT NULL").select("_row", F.inline("fragments")).unionByName(dealt)
    runs = checkpointed(stitch(found, min_length))
    joined = open_.drop("fragments").join(runs, F.col("_row") == F.col("_owner"), "left").select(
        "doc_id", "n_words", "words", F.coalesce("runs", F.array().cast(f"array<{RUN}>")).alias("runs"))
    out = f"doc_id {kind}, n_words bigint, runs array<{RUN}>, collapsed string"
    collapsed = joined.mapInArrow(_collapse, out)
    return collapsed.unionByName(plain.select("doc_id", "n_words", F.array().cast(f"array<{RUN}>").alias("runs"),
                                              F.col("words").alias("collapsed")))


def planted_runs(doc_id: Column, text: Column) -> Column:
    """A tenth of the texts, by crc32 of the id, continued from some word on by repeating a stretch: with h the
    crc32, g = h // 10, n words, a = g % n and p = 1 + (n - a) // (3 + g % 8), each word i >= a becomes
    word a + (i - a) % p."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    rest = n - a
    p = (1 + F.floor(rest / (3 + F.pmod(g, F.lit(8))))).cast("int")
    times = F.ceil(rest / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), rest)
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), changed).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)``: the longest
    run (ties: smallest start, then period; nulls without one) and digests of all runs and of what is left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                                              (-r["period"]).alias("period"))))
    by_period = F.array_sort(F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["period"].alias("period"),
                                                                    r["length"].alias("length"))))
    lines = F.transform(by_period, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("_best"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"),
                       (-F.col("_best.period")).alias("period"),
                       F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
