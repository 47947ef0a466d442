"""Byte-level BPE encoding and decoding with length-bucketed padded numpy matrices: the distinct
pieces of a group of texts are put into matrices by length; in each round every row merges its
leftmost pair of the lowest rank, found by a hashed pair lookup, and closes the gap."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int32(2 ** 31 - 1)  # rank of a pair that doesn't merge
MIX = np.uint64(0x9E3779B97F4A7C15)
LONGEST_ROW = 128  # bytes of a piece in a matrix; longer ones are merged alone
GROUP_CHARS = 1 << 20  # of text split at a time
KEPT_PIECES = 600_000  # that a task remembers
MATRIX_CELLS = 1 << 20


class PairTable:
    """Open-addressing hash table in numpy: (left id, right id) to the rank of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(rank), 1) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.value = np.full(1 << bits, NONE, np.int32)
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = ((key * MIX) >> self.shift).astype(np.int64)
        todo = np.arange(len(key))
        while len(todo):
            free = todo[self.value[slot[todo]] == NONE]
            self.key[slot[free]], self.value[slot[free]] = key[free], rank[free]  # of rivals the last stays
            todo = todo[self.key[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it doesn't merge or an id is negative."""
        out = np.full(left.shape, NONE, np.int32)
        flat = out.ravel()
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        key = (left.ravel()[todo].astype(np.uint64) << np.uint64(32)) | right.ravel()[todo].astype(np.uint64)
        slot = ((key * MIX) >> self.shift).astype(np.int64)
        while len(todo):
            found, value = self.key[slot] == key, self.value[slot]
            flat[todo[found]] = value[found]
            more = ~found & (value != NONE)
            todo, key, slot = todo[more], key[more], (slot[more] + 1) & self.mask
        return out


class Vocabulary:
    """A rank file's tokens, and the pairs of tokens that make a token."""

    def __init__(self, rank_file: bytes):
        lines = [line.split() for line in rank_file.splitlines() if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.byte = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError("the rank file lacks single bytes")
        get, pairs = self.rank.get, []
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                if (left := get(token[:cut])) is not None and (right := get(token[cut:])) is not None:
                    pairs.append((left, right, rank))
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank)
        # tokens that merge on into a token of lower rank than their own
        top = max(self.token, default=0) + 1
        self.falls = np.zeros(top, bool)
        self.falls[left[rank < left]] = True
        self.falls[right[rank < right]] = True

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece, merged by itself."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            known = self.rank.get(piece)
            if known is not None:
                out[k] = np.array([known], np.int32)
            elif len(piece) > LONGEST_ROW:
                out[k] = self._long(piece)
            else:
                buckets.setdefault(-(-len(piece) // 8) * 8, []).append(k)
        for width, members in buckets.items():
            step = max(1, MATRIX_CELLS // max(width, 1))
            for low in range(0, len(members), step):
                part = members[low:low + step]
                for k, ids in zip(part, self._matrix([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> Iterator[np.ndarray]:
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < sizes[:, None], self.byte[raw], np.int32(-1))
        done = np.full((len(pieces), width + 1), -1, np.int32)
        rows = np.arange(len(pieces))
        rank = self.pairs.ranks(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(pieces), 1), NONE)
        while len(rows):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            over = best == NONE
            if over.any():
                done[rows[over], :ids.shape[1]] = ids[over]
                keep = ~over
                rows, ids, rank, at, best = rows[keep], ids[keep], rank[keep], at[keep], best[keep]
                # no row is longer than what is left of the longest one
                longest = max(2, int((ids >= 0).sum(axis=1).max())) if len(rows) else 2
                ids, rank = ids[:, :longest], rank[:, :longest - 1]
                if not len(rows):
                    break
            n = np.arange(len(rows))
            ids[n, at] = best
            column = np.arange(ids.shape[1] - 1)
            shift = column + (column > at[:, None])
            tail = np.full((len(rows), 1), -1, np.int32)
            ids = np.concatenate([np.take_along_axis(ids, shift, 1), tail], 1)
            # the pair after the merged one goes; those on its two sides are looked up anew
            pair = np.arange(rank.shape[1] - 1)
            shift = pair + (pair >= at[:, None])
            rank = np.concatenate([np.take_along_axis(rank, shift, 1), np.full((len(rows), 1), NONE)], 1)
            rank[n, at] = self.pairs.ranks(ids[n, at], ids[n, np.minimum(at + 1, ids.shape[1] - 1)])
            before = np.maximum(at - 1, 0)
            left = self.pairs.ranks(ids[n, before], ids[n, at])
            rank[n, before] = np.where(at > 0, left, rank[n, before])
        for row in done:
            yield row[row >= 0]

    def _long(self, piece: bytes) -> np.ndarray:
        """One long piece: every place of the lowest rank is merged in a round, from the left and
        without overlap.  That is what merging them one at a time gives, unless the new token could at
        once merge into one of lower rank; then only the leftmost place is merged."""
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.ranks(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            if self.falls[best]:
                at = at[:1]
            else:
                start = np.ones(len(at), bool)
                start[1:] = np.diff(at) > 1
                head = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at = at[(at - at[head]) % 2 == 0]
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            place = at - np.arange(len(at))
            rank = rank[keep[1:]] if len(ids) > 1 else rank[:0]
            for near in (place - 1, place):
                near = near[(near >= 0) & (near < len(ids) - 1)]
                rank[near] = self.pairs.ranks(ids[near], ids[near + 1])
        return ids


@lru_cache(maxsize=2)
def _vocabulary(rank_file: bytes) -> Vocabulary:
    return Vocabulary(rank_file)


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with ``\\s`` read as the Unicode property, as rank files' own libraries do."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
                         .replace(r"\S", r"\P{White_Space}"))


class Encoder:
    """Packed ids of whole texts.  The ids of pieces met before are remembered, up to a number."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.vocabulary, self.pattern = _vocabulary(rank_file), splitter(pattern)
        self.known: dict[str, bytes] = {}

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= 4 * GROUP_CHARS:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while part := [m.group() for m in islice(found, GROUP_CHARS // 4)]:
            yield part

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        lists = [list(self._pieces(t)) for t in texts]
        if len(self.known) > KEPT_PIECES:
            self.known = {}
        new = list(set().union(*(p for parts in lists for p in parts)) - self.known.keys())
        ids = self.vocabulary.encode_pieces([p.encode() for p in new])
        self.known.update(zip(new, (i.astype("<u4").tobytes() for i in ids), strict=True))
        get = self.known.__getitem__
        return [b"".join(b"".join(map(get, part)) for part in parts) for parts in lists]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids; raises KeyError for an id that the rank file lacks."""
        return b"".join(map(self.vocabulary.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    low, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > GROUP_CHARS:
            yield low, k
            low, size = k, 0
        size += len(text)
    if low < len(texts):
        yield low, len(texts)


def bpe_round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                   decode: bool = True) -> DataFrame:
    """``(doc_id, ids, n_tokens, decoded)`` for every row, on its whole text.

    ``ids`` holds the ids as packed little-endian unsigned 32-bit integers, ``decoded`` the bytes that
    they stand for (null without ``decode``).  Each match of ``pattern`` is merged by itself; a match
    that is a token is that token; no special token is known.  A null text is an empty one: no ids.
    Repeated rows are all kept; other columns are not read.  The rank file is read on the driver and
    sent to the tasks (below a megabyte for the public ones; above 64 MB it raises).
    """
    ranks = read_ranks(rank_path)
    if len(ranks) > 64 << 20:
        raise ValueError("the rank file is too large to send to the tasks")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for low, high in _groups(texts):
                ids = encoder.encode(texts[low:high])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(ids, pa.binary()),
                     pa.array([len(i) // 4 for i in ids], pa.int64()),
                     pa.array([encoder.decode(i) if decode else None for i in ids], pa.binary())],
                    ["doc_id", "ids", "n_tokens", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens bigint, decoded binary")


def bpe_decode(rows: DataFrame, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, decoded)``: the bytes of packed ids; null ids decode to null."""
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches):
        encoder = Encoder(shared.value, "")
        for batch in batches:
            found = [None if i is None else encoder.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())],
                                             ["doc_id", "decoded"])

    own = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, decoded binary")
