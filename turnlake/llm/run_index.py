"""Repeated-passage removal with a run-length index.

A passage of ``length`` bytes is cut wherever it also starts elsewhere.  Every window of that many
bytes is filed under its anchor: the 128 (or ``length`` / 2) bytes in it whose hash (32 bits of it) is smallest, the leftmost of ties.
Equal windows have equal anchors, and the windows of a text that share one anchor are
neighbours, so a text becomes a row of contexts: stretches that hold the windows of one anchor each.
Two windows are equal only within one anchor's group of contexts.

Contexts that are equal byte for byte are counted, not compared.  The distinct contexts of an
anchor met more than once go, many groups at a time, into a run-length index: the suffixes sorted, the
Burrows-Wheeler transform cut into runs, and at both ends of each run the text position and the
length of the match across the boundary.  Between run ends the longest match of a position with its
neighbour in suffix order is one shorter than that of the position before it, so streaming over the
text from the samples gives all matching statistics; where they reach ``length``, the window is
repeated.

An anchor with too many distinct contexts for one index (a passage that very many texts share) is split by
more anchors: the windows of its contexts are filed under their 2, 4, 8... smallest hashes and
the distances between them, which equal windows share too, until every group fits.

For two lengths at once the shorter strings are found first; the longer are looked for, by the same index, only in
the stretches that repeated shorter ones cover, where all of them lie."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8, written

MAX_ANCHOR = 128  # bytes; a power of two
BLOCK_BYTES = 1 << 20  # of contexts in one index
PIECE_BYTES = 1 << 20  # of a text whose anchors are found at a time
MIN_LENGTH = 32
FILTER_BITS = 1 << 26  # of the bitmap that keeps texts from a shuffle they need not take: 8 MB
PLACE = np.uint64((1 << 32) - 1)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _byte_values() -> np.ndarray:
    return np.random.default_rng(2).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE_VALUE = _byte_values()


def anchor_bytes(length: int) -> int:
    """Size of the anchors in windows of ``length`` bytes: the greatest power of two up to its half, 128 at most."""
    return 1 << (min(length // 2, MAX_ANCHOR).bit_length() - 1)


def _values(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes (a power of two) from each place."""
    value, power, width = BYTE_VALUE[data], int(MIX[0]), 1
    while width < size:
        value = value[:-width] * np.uint64(power) + value[width:]
        power, width = power * power % (1 << 64), 2 * width
    value ^= value >> np.uint64(32)
    value *= MIX[1]
    value ^= value >> np.uint64(32)
    return value


def _leftmost_least(data: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes the place of its anchor."""
    size = anchor_bytes(length)
    value = _values(data, size)
    # upper half of the hash, then the place: the least of these is the leftmost of the smallest hashes
    least = (value & ~PLACE) | np.arange(len(value), dtype=np.uint64)
    width, whole = 1, length - size + 1
    while width < whole:
        step = min(width, whole - width)
        least = np.minimum(least[step:], least[:-step])
        width += step
    return (least & PLACE).astype(np.int64)


def contexts(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start and anchor place of each context of a text, in order."""
    parts = []
    for low in range(0, max(len(data) - length + 1, 0), PIECE_BYTES):
        place = _leftmost_least(data[low:low + PIECE_BYTES + length - 1], length) + low
        change = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate([[0], change])
        parts.append((first + low, np.concatenate([change, [len(place)]]) - 1 + low, place[first]))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    first, last, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    starts = np.concatenate([[True], place[1:] != place[:-1]])  # a context may go on in the next piece
    return first[starts], last[np.concatenate([starts[1:], [True]])], place[starts]


@dataclass(frozen=True)
class RunIndex:
    """Run-compressed transform of some texts: the rows at which its runs start, the text position of the
    first and last row of each, and how long the first row's suffix matches that of the row above and
    the last row's that of the row below (0 across groups)."""
    starts: np.ndarray
    heads: np.ndarray  # the byte of each run plus 1; 0: a text's start
    first_sample: np.ndarray
    last_sample: np.ndarray
    match_above: np.ndarray
    match_below: np.ndarray


def _suffix_order(symbols: np.ndarray, text: np.ndarray, group: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions sorted by group, then suffix up to its text's end, then text: prefix doubling in which
    only positions not yet told apart are sorted again."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(5, np.int64)])
    key, remaining = group.astype(np.int64), ends - np.arange(n)
    for k in range(5):
        key = (key << 9) | np.where(remaining > k, padded[k:k + n], 0)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    slot = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = slot
    texts, done = int(text.max(initial=0)) + 1, 5
    while True:
        alone = new & np.concatenate([new[1:], [True]])
        at = np.flatnonzero(~alone)
        if not len(at):
            return order
        own = order[at]
        after = own + done
        over = after >= ends[own]
        second = np.where(over, text[own], rank[np.minimum(after, n - 1)] + texts)
        key = (rank[own] << 32) | second
        sort = np.argsort(key, kind="stable")
        own, key = own[sort], key[sort]
        order[at] = own
        first = np.concatenate([[True], key[1:] != key[:-1]])
        new[at] = first
        rank[own] = np.maximum.accumulate(np.where(first, at, 0))
        done *= 2


def _match(data: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common start of the stretches from ``a`` and ``b``, up to ``limit``."""
    words = np.ndarray((len(data) - 7,), np.uint64, data.tobytes(), strides=(1,))
    out = limit.copy()
    todo = np.flatnonzero(limit > 0)
    done = 0
    while len(todo):
        differ = words[a[todo] + done] ^ words[b[todo] + done]
        found = differ != 0
        lowest = differ[found] & (~differ[found] + np.uint64(1))
        at = todo[found]
        out[at] = np.minimum(out[at], done + (np.bitwise_count(lowest - np.uint64(1)) >> 3).astype(np.int64))
        done += 8
        todo = todo[~found]
        todo = todo[limit[todo] > done]
    return out


def build_run_index(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> RunIndex:
    """Index of some texts (``offsets`` into ``data``) that are compared within their ``groups``."""
    n = len(data)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(offsets[1:], sizes)
    group = np.repeat(np.unique(groups, return_inverse=True)[1], sizes)
    symbols = data.astype(np.int64) + 1
    order = _suffix_order(symbols, text, group, ends)
    at_start = np.zeros(n, bool)
    at_start[offsets[:-1][sizes > 0]] = True
    head = np.where(at_start[order], 0, symbols[order - 1])
    edge = (head[1:] != head[:-1]) | (head[1:] == 0) | (group[order[1:]] != group[order[:-1]])
    starts = np.concatenate([[0], np.flatnonzero(edge) + 1])
    lasts = np.concatenate([starts[1:] - 1, [n - 1]])
    above, below = order[lasts[:-1]], order[starts[1:]]
    same = group[above] == group[below]
    limit = np.where(same, np.minimum(ends[above] - above, ends[below] - below), 0)
    match = _match(np.concatenate([data, np.zeros(16, np.uint8)]), above, below, limit)
    return RunIndex(starts, head[starts], order[starts], order[lasts],
                    np.concatenate([[0], match]), np.concatenate([match, [0]]))


def matching_statistics(index: RunIndex, n: int) -> np.ndarray:
    """For each text position the length of its longest match elsewhere in its group, streamed from
    the samples at run ends."""
    best = np.zeros(n, np.int64)
    for sample, match in ((index.first_sample, index.match_above), (index.last_sample, index.match_below)):
        value, last = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        value[sample], last[sample] = match, sample
        last = np.maximum.accumulate(last)
        best = np.maximum(best, value[last] - (np.arange(n) - last))
    return best


def repeated_windows(texts: list[bytes], groups: list[int], copies: list[int], length: int
                     ) -> list[tuple[int, int, int]]:
    """``(text, first, last)``: the runs of window starts of each distinct text whose window also
    starts elsewhere in the group; all of a text that has several copies."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    found = matching_statistics(build_run_index(data, offsets, np.array(groups)), len(data)) >= length
    many = np.repeat(np.array(copies) > 1, sizes)
    room = np.repeat(offsets[1:], sizes) - np.arange(len(data))
    found = (found | many) & (room >= length)
    text = np.repeat(np.arange(len(texts)), sizes)
    edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
    # a text's last length - 1 positions start no window, so no run crosses two texts
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return list(zip(text[first].tolist(), (first - offsets[text[first]]).tolist(),
                    (last - offsets[text[first]]).tolist(), strict=True))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _anchor_rows(length: int):
    size = anchor_bytes(length)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys = list(zip(batch.column("h").to_pylist(), batch.column("n").to_pylist(), strict=True))
            copies: dict[tuple, list[int]] = {}
            for k, key in enumerate(keys):  # copies in one batch are read once
                copies.setdefault(key, [k, 0])[1] += 1
            out: list[list] = [[] for _ in range(7)]
            for (h, n), (k, number) in copies.items():
                own = data[offsets[k]:offsets[k + 1]]
                raw = own.tobytes()
                first, last, place = contexts(own, length)
                out[0] += [h] * len(first)
                out[1] += [n] * len(first)
                out[2] += [number] * len(first)
                out[3] += [_signed(xxhash.xxh3_64_intdigest(raw[p:p + size])) for p in place.tolist()]
                out[4] += [_signed(xxhash.xxh3_64_intdigest(raw[a:b + length]))
                           for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                out[5] += first.tolist()
                out[6] += last.tolist()
                if len(out[0]) > 50_000:
                    yield _anchor_batch(out)
                    out = [[] for _ in range(7)]
            yield _anchor_batch(out)

    return run


def _anchor_batch(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      ["h", "n", "copies", "anchor", "context", "first", "last"])


def _cut_out(length: int):
    """Rows of a text with a list of contexts: one row for each context, with its bytes."""
    def run(batches):
        for batch in batches:
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["anchor"] for w in wanted], pa.int64()),
                     pa.array([w["context"] for w in wanted], pa.int64()),
                     pa.array([w["copies"] for w in wanted], pa.int64()),
                     pa.array([text[w["first"]:w["last"] + length] for w in wanted], pa.binary())],
                    ["anchor", "context", "copies", "bytes"])

    return run


def _index_groups(length: int):
    """Contexts sorted by anchor: indexes of whole groups of about BLOCK_BYTES."""
    def found(anchors, names, copies, texts) -> pa.RecordBatch:
        runs = repeated_windows(texts, anchors, copies, length)
        return pa.RecordBatch.from_arrays(
            [pa.array([anchors[r[0]] for r in runs], pa.int64()), pa.array([names[r[0]] for r in runs], pa.int64()),
             pa.array([r[1] for r in runs], pa.int64()), pa.array([r[2] for r in runs], pa.int64())],
            ["anchor", "context", "low", "high"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "copies", "bytes")), strict=True):
                if size >= BLOCK_BYTES and row[0] != held[0][-1]:
                    yield found(*held)
                    held, size = ([], [], [], []), 0
                for column, value in zip(held, row, strict=True):
                    column.append(value)
                size += len(row[3])
        if size:
            yield found(*held)

    return run


def split_context(raw: bytes, length: int, depth: int) -> list[tuple[int, int, int]]:
    """``(first, last, key)``: the runs of windows of some bytes that have the same ``depth`` smallest anchors,
    and the hash of these and the distances between them, which equal windows share."""
    size = anchor_bytes(length)
    value = _values(np.frombuffer(raw, np.uint8), size)
    order = np.argsort(value, kind="stable")
    rank = np.empty(len(value), np.int32)
    rank[order] = np.arange(len(value), dtype=np.int32)
    windows = np.lib.stride_tricks.sliding_window_view(rank, length - size + 1)
    depth = min(depth, windows.shape[1])
    least = np.sort(np.partition(windows, depth - 1, axis=1)[:, :depth], axis=1)
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]).any(axis=1)]))
    last = np.concatenate([first[1:], [len(least)]]) - 1
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        places = order[least[a]]
        digest = xxhash.xxh3_64((places - places[0]).tobytes())
        for p in places.tolist():
            digest.update(raw[p:p + size])
        out.append((a, b, _signed(digest.intdigest())))
    return out


def _split(length: int, depth: int):
    """Contexts of hot anchors: one row for each part of one, with its bytes, a key that its windows share
    and its name."""
    def run(batches):
        for batch in batches:
            for anchor, context, copies, raw in zip(
                    *(batch.column(c).to_pylist() for c in ("anchor", "context", "copies", "bytes")), strict=True):
                parts = split_context(raw, length, depth)
                texts = [raw[a:b + length] for a, b, _ in parts]
                m = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * m, pa.int64()), pa.array([context] * m, pa.int64()),
                     pa.array([copies] * m, pa.int64()), pa.array([p[0] for p in parts], pa.int64()),
                     pa.array([p[2] for p in parts], pa.int64()),
                     pa.array([_signed(xxhash.xxh3_64_intdigest(t)) for t in texts], pa.int64()), pa.array(texts, pa.binary())],
                    ["anchor", "context", "copies", "at", "key", "part", "bytes"])

    return run


def _spans(runs: list[dict], length: int) -> list[list[int]]:
    """The maximal stretches, from start to end, that runs of starts of windows cover."""
    spans: list[list[int]] = []
    for low, high in sorted((r["low"], r["high"] + length) for r in runs):
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    return spans


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _apply_cuts(length: int):
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for h, n, covered, text, runs in zip(*(batch.column(c).to_pylist() for c in ("h", "n", "n_covered", "text", "runs")),
                                                 strict=True):
                spans, kept, at = _spans(runs, length), [], 0
                for low, high in spans:
                    kept.append(text[at:low])
                    at = high
                kept.append(text[at:])
                left = b"".join(kept)
                removed = sum(b - a for a, b in spans)
                for column, value in zip(out, (h, n, removed, [{"start": a, "end": b} for a, b in spans], left,
                                               left.decode("utf-8", "ignore"), removed if covered is None else covered), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), SPAN, pa.binary(), pa.string(), pa.int64()),
                                              strict=True)],
                ["h", "n", "n_removed", "spans", "kept", "kept_text", "n_covered"])

    return run


def _cover(length: int, least: int):
    """Texts with runs of windows of ``length``: the bytes these cover, and the covered stretches of ``least`` bytes or more."""
    def run(batches):
        for batch in batches:
            found = [_spans(runs, length) for runs in batch.column("runs").to_pylist()]
            covered = [sum(b - a for a, b in spans) for spans in found]
            long = [[{"start": a, "end": b} for a, b in spans if b - a >= least] for spans in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("h", "n", "copies", "text")), pa.array(covered, pa.int64()), pa.array(long, SPAN)],
                ["h", "n", "copies", "text", "n_covered", "long"])

    return run


def _bytes(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the key of its text (characters or bytes): XXH64 ``_h`` and size in bytes ``_n`` (null: empty)."""
    text = _bytes(text_col)
    return docs.withColumns({"_h": F.xxhash64(text), "_n": F.octet_length(text).cast("bigint")})


def repeated_texts(docs: DataFrame, length: int = 400, group_contexts: int = 4096, text_col: str = "text",
                   shorter: int | None = None) -> DataFrame:
    """``(h, n, n_removed, spans, kept, kept_text, n_covered)`` for each distinct text of ``docs`` with a repeated passage:
    the byte spans ``{start, end}`` covered by strings of ``length`` bytes that start anywhere else too,
    in another row or in the same text, the bytes left, and these as text (without what is left of a
    character that a cut divides).  ``h`` and ``n`` are those of :func:`keyed`; equal texts have equal results, whatever rows they are in.

    ``n_covered`` is the number of bytes covered by strings of ``shorter`` bytes (default: of ``length``) that start anywhere
    else; with ``shorter``, texts that repeat only such strings have a row too, with nothing cut.

    Matches are judged on the input and never cross texts.  Null, empty and shorter texts have none, and so has an
    empty table.  Other columns are not read.
    Contexts are counted by (anchor, context hash), so copies of a text or passage, however many, are
    one row with a number; every join is on a key whose other side has one row each.  The contexts of
    an anchor with more than ``group_contexts`` distinct ones are split by more anchors, see :func:`split_context`.
    """
    if min(length, shorter or length) < MIN_LENGTH:
        raise ValueError(f"length and shorter must be {MIN_LENGTH} or more")
    if shorter is None or shorter == length:
        found = _repeated_runs(docs, length, group_contexts, text_col).withColumn("n_covered", F.lit(None).cast("bigint"))
    elif shorter > length:
        raise ValueError("shorter must be length at most")
    else:
        found = _runs_in_shorter(docs, length, shorter, group_contexts, text_col)
    return found.select("h", "n", "copies", "n_covered", "text", "runs").mapInArrow(
        _apply_cuts(length), "h bigint, n bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, "
        "kept binary, kept_text string, n_covered bigint")


def _runs_in_shorter(docs: DataFrame, length: int, shorter: int, group_contexts: int, text_col: str) -> DataFrame:
    """``(h, n, n_covered, text, runs)`` of texts with repeated strings of ``shorter`` bytes, the runs those of ``length``.

    A string of ``length`` bytes that is repeated lies, wherever it starts, within one stretch covered by repeated
    strings of ``shorter`` bytes, so only such stretches are searched for it.  A text of several rows gives its stretches
    twice, which tells as much as more copies would."""
    short = _repeated_runs(docs, shorter, group_contexts, text_col)
    covered = written(short.select("h", "n", "copies", "text", "runs").mapInArrow(
        _cover(shorter, length), "h bigint, n bigint, copies bigint, text binary, n_covered bigint, "
        "long array<struct<start:bigint,end:bigint>>"), "covered")
    stretches = F.transform("long", lambda s: F.struct(s["start"].alias("start"), F.substring(
        F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).alias("piece")))
    pieces = covered.select("h", "n", "copies", F.explode(stretches).alias("s")).select("h", "n", "copies", "s.start", "s.piece")
    twice = pieces.select("piece", F.explode(F.array_repeat(F.lit(0), F.least("copies", F.lit(2)).cast("int"))))
    found = _repeated_runs(twice, length, group_contexts, "piece").select(
        F.col("h").alias("piece_h"), F.col("n").alias("piece_n"), F.col("runs").alias("within"))
    runs = (keyed(pieces, "piece").join(found, (F.col("_h") == F.col("piece_h")) & (F.col("_n") == F.col("piece_n")))
            .select(F.col("h").alias("_h"), F.col("n").alias("_n"), F.transform("within", lambda r: F.struct(
                (F.col("start") + r["low"]).alias("low"), (F.col("start") + r["high"]).alias("high"))).alias("runs"))
            .groupBy("_h", "_n").agg(F.flatten(F.collect_list("runs")).alias("runs")))
    joined = covered.join(runs, (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n")), "left")
    return joined.withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<low:bigint,high:bigint>>")))


def _repeated_runs(docs: DataFrame, length: int, group_contexts: int, text_col: str) -> DataFrame:
    """``(h, n, copies, text, runs)`` for each distinct text with repeated windows of ``length`` bytes: the number of its
    rows, its bytes and the runs ``{low, high}`` of starts of such windows.

    Texts are shuffled only to be cut, and of them only those that :func:`_likely` leaves: for contexts to index, for
    contexts of hot anchors, and in the end those with runs."""
    texts = keyed(docs.select(_bytes(text_col).alias("text")), "text").where(F.col("_n") >= length).select(
        F.col("_h").alias("h"), F.col("_n").alias("n"), "text")
    anchors = written(texts.mapInArrow(_anchor_rows(length), "h bigint, n bigint, copies bigint, anchor bigint, "
                                       "context bigint, first bigint, last bigint"), "anchors")
    # one side of each join below is written first: Spark splits a hot key of two plain shuffles only
    often = written(anchors.groupBy("anchor").agg(F.sum("copies").alias("k")).where("k > 1")
                    .select(F.col("anchor").alias("_anchor")), "often")
    met = written(anchors.join(often, F.col("anchor") == F.col("_anchor"), "left_semi"), "met")
    kinds = met.groupBy("anchor", "context").agg(
        F.sum("copies").alias("copies"), *(F.first(c).alias(c) for c in ("h", "n", "first", "last")))
    sized = _sized(written(kinds, "kinds"))
    whole = sized.where("m = 1").select("anchor", "context", F.lit(0).cast("bigint").alias("low"),
                                        (F.col("last") - F.col("first")).alias("high"))
    hot = F.col("m") > group_contexts

    def cut(contexts_: DataFrame) -> DataFrame:
        wanted = (contexts_.groupBy(F.col("h").alias("_h"), F.col("n").alias("_n"))
                  .agg(F.collect_list(F.struct("anchor", "context", "copies", "first", "last")).alias("wanted")))
        one_each = _likely(texts, contexts_).groupBy("h", "n").agg(F.first("text").alias("text"))
        return (one_each.join(wanted, (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n"))).select("text", "wanted")
                .mapInArrow(_cut_out(length), "anchor bigint, context bigint, copies bigint, bytes binary"))

    marked = whole.unionByName(_indexed(cut(sized.where((F.col("m") > 1) & ~hot)), length))
    split = sized.where((F.col("m") > 1) & hot)
    if split.limit(1).count():
        marked = marked.unionByName(_split_marks(written(cut(split), "hot"), length, group_contexts, 2))
    marked = marked.select(F.col("anchor").alias("_anchor"), F.col("context").alias("_context"), "low", "high")
    placed = met.join(marked, (F.col("anchor") == F.col("_anchor")) & (F.col("context") == F.col("_context")))
    runs = written(placed.select("h", "n", F.struct((F.col("first") + F.col("low")).alias("low"),
                                                    (F.col("first") + F.col("high")).alias("high")).alias("run"))
                   .groupBy("h", "n").agg(F.collect_set("run").alias("runs")), "runs")
    one_each = _likely(texts, runs).groupBy("h", "n").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    runs = runs.select(F.col("h").alias("_h"), F.col("n").alias("_n"), "runs")
    return one_each.join(runs, (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n"))).select("h", "n", "copies", "text", "runs")


def _likely(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``texts`` without most of those whose ``h`` is none of that of ``keys``: a bitmap of FILTER_BITS, broadcast
    whatever the number of keys, spares them the shuffle of the join that follows."""
    slot = F.pmod(F.col("h"), F.lit(FILTER_BITS))
    page, bit = F.shiftright(slot, 15), slot.bitwiseAND(F.lit(32767))  # a bitmap of Spark has 32768 bits
    pages = keys.select(page.alias("_page"), bit.alias("_bit")).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.substring("_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
    found = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    joined = texts.withColumn("_at", page).join(F.broadcast(pages), F.col("_at") == F.col("_page"))
    return joined.where(found).select(*texts.columns)


def _sized(kinds: DataFrame) -> DataFrame:
    """``kinds`` with ``m``, the number of rows with the same ``anchor``."""
    sizes = written(kinds.groupBy(F.col("anchor").alias("_anchor")).agg(F.count("*").alias("m")), "sizes")
    return written(kinds.join(sizes, F.col("anchor") == F.col("_anchor")).drop("_anchor"), "sized")


def _indexed(contexts_: DataFrame, length: int) -> DataFrame:
    """``(anchor, context, low, high)``: the repeated windows of contexts ``(anchor, context, copies, bytes)``,
    found by run-length indexes of whole groups."""
    return contexts_.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        _index_groups(length), "anchor bigint, context bigint, low bigint, high bigint")


def _split_marks(hot: DataFrame, length: int, group_contexts: int, depth: int) -> DataFrame:
    """The same for contexts of hot anchors, split by their ``depth`` smallest anchors.  Distinct parts are
    counted and indexed like contexts; a group still too large is split again by twice as many
    anchors, at last by all of a window, which leaves one part in each group."""
    parts = written(hot.mapInArrow(_split(length, depth), "anchor bigint, context bigint, copies bigint, at bigint, "
                                   "key bigint, part bigint, bytes binary"), "parts")
    kinds = written(parts.groupBy(F.col("key").alias("anchor"), F.col("part").alias("context")).agg(
        F.sum("copies").alias("copies"), F.first("bytes").alias("bytes")), "kinds")
    sized = _sized(kinds)
    marked = sized.where("m = 1 AND copies > 1").select(
        "anchor", "context", F.lit(0).cast("bigint").alias("low"), (F.octet_length("bytes") - length).cast("bigint").alias("high"))
    columns = ("anchor", "context", "copies", "bytes")
    marked = marked.unionByName(_indexed(sized.where((F.col("m") > 1) & (F.col("m") <= group_contexts)).select(*columns), length))
    large = sized.where((F.col("m") > 1) & (F.col("m") > group_contexts)).select(*columns)
    if large.limit(1).count():
        marked = marked.unionByName(_split_marks(large, length, group_contexts, 2 * depth))
    marked = written(marked.select(F.col("anchor").alias("_key"), F.col("context").alias("_part"), "low", "high"), "marked")
    found = parts.drop("bytes").join(marked, (F.col("key") == F.col("_key")) & (F.col("part") == F.col("_part")))
    return found.select("anchor", "context", (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high"))


def remove_repeats(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with columns ``n_removed``, ``spans`` and ``kept`` (bytes) added, or replaced where it has such;
    see :func:`repeated_texts`.  Every row stays, those whose text is null or wholly cut too; other columns,
    whatever they are called, come through as they are.  An empty table stays empty."""
    cuts = repeated_texts(docs, text_col=text_col, **options)
    cuts = cuts.select(F.struct("n_removed", "spans", "kept").alias("cut"), F.col("h").alias("cut_h"), F.col("n").alias("cut_n"))
    others = [c for c in docs.columns if c not in ("n_removed", "spans", "kept")]
    rows = docs.select(F.struct(*others).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = keyed(rows)
    joined = rows.join(cuts, (F.col("_h") == F.col("cut_h")) & (F.col("_n") == F.col("cut_n")), "left")
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in others], F.coalesce("cut.n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("cut.spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce("cut.kept", F.encode("text", "utf-8")).alias("kept"))
