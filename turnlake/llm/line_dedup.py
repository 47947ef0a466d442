"""Line deduplication across documents.

Every text is exploded into its lines; a line's key is the line without white space at its ends and
with A-Z lower-cased.  Keys are hashed, the distinct documents of each hash are counted, and a key
that enough documents hold loses its lines in all of them but the one with the smallest id.  The
positions of lost lines go back to their documents, which are put together from the rest.

Nothing collects a key's lines: documents of a key are counted by partial aggregates, first by (key,
document), then by key, so a line that a third of all documents share is one row for each task, and
the join that finds its lines is one of two plain shuffles, which Spark splits where a key is hot."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, row_groups, utf8

WHITE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GROUP_BYTES = 16 << 20  # of texts put together at a time


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, UPPER.lower())


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("own"))


def hashed_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, own, pos, h1, h2)`` for each line whose key has at least ``min_chars`` code points: its
    number, the 128-bit hash of its key (two XXH64 of different seeds) and its text's XXH64 ``own``."""
    lines = _own(docs, id_col, text_col).select("doc_id", "own", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.select("doc_id", "own", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "own", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def shared_lines(lines: DataFrame, min_docs: int = 2) -> DataFrame:
    """``(h1, h2, docs, least)``: the keys that at least ``min_docs`` distinct ids hold, and the smallest."""
    once = lines.select("h1", "h2", "doc_id").distinct()
    return (once.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.min("doc_id").alias("least"))
            .where(F.col("docs") >= min_docs))


def _reassemble(batches):
    """Texts without the lines at their ``gone`` positions (null: none)."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        gone = batch.column("gone")
        for low, high in row_groups(offsets, GROUP_BYTES):
            total, dropped, kept = [], [], []
            for k in range(low, high):
                raw = data[offsets[k]:offsets[k + 1]]
                ends = np.append(np.flatnonzero(raw == 10), len(raw))
                lost = np.array(gone[k].as_py() or (), np.int64)
                total.append(len(ends))
                dropped.append(len(lost))
                if not len(lost):
                    kept.append(raw.tobytes())
                    continue
                stays = np.ones(len(ends), bool)
                stays[lost] = False
                starts = np.concatenate([[0], ends[:-1] + 1])
                edge = np.diff(np.concatenate([[0], stays.astype(np.int8), [0]]))
                kept.append(b"\n".join(raw[starts[a]:ends[b]].tobytes() for a, b in
                                       zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(low, high - low), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept)`` for every row of ``docs``: its number of lines, how many of
    them are dropped, and the others joined by a newline.

    Lines end at newlines only; a null or empty text is one empty line.  A key (see :func:`line_key`) of
    at least ``min_chars`` code points that at least ``min_docs`` documents hold stays in the document with
    the smallest id, however often it is there, and goes from all others.  Shorter keys stay.  Rows
    of one id are one document when counted, and each is put together by itself; so repeated rows
    stay, with equal results.  Rows without an id are one document, which comes after all others.
    An empty table gives no row; other columns are not read.  Keys are equal where 128 bits of hash are.
    """
    lines = hashed_lines(docs, min_chars, id_col, text_col)
    shared = checkpointed(shared_lines(lines, min_docs).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "least"))
    lost = lines.join(shared, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).where(
        ~F.col("doc_id").eqNullSafe(F.col("least")))
    # a document's lost positions: its own lines at most, and a set, so that repeated rows are one
    gone = checkpointed(lost.groupBy(F.col("doc_id").alias("_id"), F.col("own").alias("_own"))
                        .agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    rows = _own(docs, id_col, text_col)
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_own")), "left")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "gone").mapInArrow(
        _reassemble, f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept string")


def line_dedup_sql(documents: str, min_docs: int = 2, min_chars: int = 10) -> str:
    """The same in DuckDB, with SHA-256 of the text that is left."""
    white = " || ".join(f"chr({ord(c)})" for c in WHITE)
    return f"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {documents}),
l AS (SELECT r, doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM rows_),
k AS (SELECT *, translate(trim(line, {white}), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
s AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= {min_chars}
      GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
m AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.least AS gone FROM k LEFT JOIN s USING (key))
SELECT min(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
