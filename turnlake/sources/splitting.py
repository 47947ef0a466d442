"""Large quoted CSV files and JSON arrays read in parallel.

A quoted field may hold line ends, and a JSON array is one value, so Spark's own readers give each such file to one
task.  Here the files are read as pieces by the text reader, which splits them anywhere: CSV by lines, JSON
by ``}``.

1. A first pass counts, for each split of a file, the quotes (CSV), or the quotes and the change of nesting with and
   without an open string at its start (JSON): one row for each split.
2. Sums over the splits before give each split its state at the start.
3. A second pass goes through the pieces with that state and joins them to whole records.  What belongs to
   a record that began in an earlier split is a fragment, and so is the record that is open at the end;
   fragments meet by the split that their record began in, and are joined in order.
4. The records are parsed by Spark's CSV and JSON functions, in parallel."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PIECES = "file string, start long, at long, value string"
_RECORDS = "file string, start long, at long, part long, whole boolean, record string"
_ESCAPED = re.compile(r"\\.", re.S)
_MARKS = re.compile(r'["{}\[\]]')


SLICE_ROWS = 256  # pieces turned into Python values at a time
OUT_BYTES = 1 << 20  # of records handed on at a time, but for a longer one
_RECORD_FIELDS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()),
                            ("record", pa.string())])


def _tuples(batches, *columns: str):
    """The rows of Arrow batches, a slice at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(low, SLICE_ROWS)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORD_FIELDS, strict=True)], schema=_RECORD_FIELDS)


def _in_arrow(records):
    """``records``, which yields rows, for ``mapInArrow``."""
    def run(batches):
        out, size = [], 0
        for row in records(batches):
            out.append(row)
            size += len(row[-1])
            if len(out) >= SLICE_ROWS or size >= OUT_BYTES:
                yield _record_batch(out)
                out, size = [], 0
        if out:
            yield _record_batch(out)

    return run


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``(file, start, at, value)``: pieces with their file, the place their split begins at, and an ascending number.  A
    separator at the end of a file leaves no empty piece."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.monotonically_increasing_id().alias("at"), "value")


def _states(splits: DataFrame, *columns: str) -> DataFrame:
    """``splits (file, start, *columns)`` with sums over the splits of a file before each."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("file", "start", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in columns])


def _with_states(pieces: DataFrame, states: DataFrame) -> DataFrame:
    """Pieces with their split's state, in order; the states are one row for each split."""
    named = states.withColumnsRenamed({"file": "_f", "start": "_s"})
    joined = pieces.join(F.broadcast(named), (F.col("file") == F.col("_f")) & (F.col("start") == F.col("_s")))
    return joined.drop("_f", "_s")


def _joined(parts: DataFrame, separator: str) -> DataFrame:
    """``(file, start, at, record)``: whole records, and those of several splits from their fragments.  ``part`` of a
    fragment is the split it is in; a record began in the last split before with an open record."""
    cut = parts.where("NOT whole")
    # an open end (at >= 0) names its record; what follows in later splits belongs to the last open end
    order = Window.partitionBy("file").orderBy("part", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(F.col("at") >= 0, F.struct("start", "at")), ignorenulls=True).over(order)
    named = cut.withColumn("_o", owner).where(F.col("_o").isNotNull())
    whole = (named.groupBy("file", F.col("_o.start").alias("start"), F.col("_o.at").alias("at"))
             .agg(F.array_sort(F.collect_list(F.struct("part", "record"))).alias("f")))
    whole = whole.select("file", "start", "at", F.array_join(F.transform("f", lambda x: x["record"]), separator).alias("record"))
    return parts.where("whole").select("file", "start", "at", "record").unionByName(whole)


def _csv_records(batches):
    """Lines of splits with ``odd``, whether a quoted field is open where the split begins."""
    split, held, at, open_, head = None, [], 0, False, False

    def rest():
        if split is not None and held:
            if head:
                yield (*split, -1, split[1], False, "\n".join(held))
            else:
                yield (*split, at, split[1], False, "\n".join(held))

    for file, start, number, odd, line in _tuples(batches, "file", "start", "at", "odd", "value"):
        if (file, start) != split:
            yield from rest()
            split, held, at, open_, head = (file, start), [], number, bool(odd), bool(odd)
        if not held and not head:
            at = number
        held.append(line)
        open_ ^= line.count('"') % 2 == 1
        if not open_:
            text = "\n".join(held)
            yield (file, start, -1, start, False, text) if head else (file, start, at, start, True, text)
            held, head = [], False
    yield from rest()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, at, record)``: the records of quoted CSV files, unparsed, each with its line ends; the file's first
    record has the smallest ``(start, at)``."""
    pieces = _pieces(spark, path, "\n")
    quotes = (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))).alias("quotes")
    states = _states(pieces.select("file", "start", quotes).groupBy("file", "start").agg(F.sum("quotes").alias("quotes")), "quotes")
    marked = _with_states(pieces, states.select("file", "start", (F.col("quotes_before") % 2 == 1).alias("odd")))
    return _joined(marked.select("file", "start", "at", "odd", "value").mapInArrow(_in_arrow(_csv_records), _RECORDS), "\n")


def read_csv_rows(spark: SparkSession, path: str, columns: int = 2) -> DataFrame:
    """The first ``columns`` columns (``c0``, ``c1``...) of the rows of quoted CSV files with a header line each: quotes are
    doubled, fields may span lines, lines end in LF or CRLF.  Columns that a row lacks are null; rows without a character are
    left out."""
    rows = csv_records(spark, path).withColumn("record", F.regexp_replace("record", "\r$", ""))
    first = rows.groupBy(F.col("file").alias("_f")).agg(F.min(F.struct("start", "at")).alias("_h"))  # one for each file
    rows = rows.join(F.broadcast(first), F.col("file") == F.col("_f")).where(F.struct("start", "at") != F.col("_h"))
    schema = ", ".join(f"c{k} string" for k in range(columns))
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    parsed = rows.where(F.length("record") > 0).select(F.from_csv("record", schema, options).alias("r"))
    return parsed.select("r.*")


def _json_splits(batches):
    """Of each split the quotes, and the change of nesting if it begins outside or inside of a string."""
    totals: dict[tuple[str, int], list[int]] = {}
    for file, start, piece, last in _tuples(batches, "file", "start", "value", "last"):
        state = totals.setdefault((file, start), [0, 0, 0])
        text = _ESCAPED.sub("", piece) + ("" if last else "}")
        for mark in _MARKS.finditer(text):
            if mark[0] == '"':
                state[0] += 1
            else:
                # outside of a string for one of the two beginnings
                state[1 + state[0] % 2] += 1 if mark[0] in "{[" else -1
    names = ["file", "start", "quotes", "out", "in"]
    yield pa.RecordBatch.from_pylist([dict(zip(names, (*k, *v), strict=True)) for k, v in totals.items()],
                                     schema=pa.schema([("file", pa.string()), *((n, pa.int64()) for n in names[1:])]))


def _json_records(batches):
    """Pieces of splits with the state they begin in: the objects of a top-level array."""
    split, held, at, inside, depth, head = None, [], 0, False, 0, False

    def rest():
        if split is not None and held:
            yield (*split, -1 if head else at, split[1], False, "}".join(held))

    columns = ("file", "start", "at", "odd", "nest", "last", "value")
    for file, start, number, odd, nest, last, piece in _tuples(batches, *columns):
        if (file, start) != split:
            yield from rest()
            split, held, at, inside, depth = (file, start), [], number, bool(odd), int(nest)
            head = inside or depth > 1
        text = _ESCAPED.sub("", piece)
        begin = None
        for mark in _MARKS.finditer(text):
            if mark[0] == '"':
                inside = not inside
            elif not inside:
                if mark[0] == "{" and depth == 1:
                    begin = True
                depth += 1 if mark[0] in "{[" else -1
        if not held and not head:
            if not begin:
                if not last and not inside:
                    depth -= 1
                continue  # between two objects, or the end of the array
            # no string stands between objects, so the first brace begins the record
            at, piece = number, piece[piece.index("{"):]
        held.append(piece)
        if not last and not inside:
            depth -= 1
            if depth == 1:
                text = "}".join(held) + "}"
                yield (file, start, -1, start, False, text) if head else (file, start, at, start, True, text)
                held, head = [], False
    yield from rest()


def json_array_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, at, record)``: the objects of files that hold one JSON array of objects each, unparsed."""
    pieces = _pieces(spark, path, "}")
    # the last piece of a file ends without the separator
    ends = pieces.groupBy(F.col("file").alias("_f")).agg(F.max(F.struct("start", "at")).alias("_e"))
    pieces = pieces.join(F.broadcast(ends), F.col("file") == F.col("_f")).withColumn("last", F.struct("start", "at") == F.col("_e")).drop("_f", "_e")
    splits = pieces.select("file", "start", "value", "last").mapInArrow(_json_splits, "file string, start long, quotes long, out long, `in` long")
    splits = splits.groupBy("file", "start").agg(*[F.sum(c).alias(c) for c in ("quotes", "out", "in")])
    quotes = _states(splits, "quotes")
    odd = F.col("quotes_before") % 2 == 1
    chosen = splits.join(quotes, ["file", "start"]).select("file", "start", odd.alias("odd"), F.when(odd, F.col("in")).otherwise(F.col("out")).alias("nest"))
    states = _states(chosen, "nest").join(chosen.select("file", "start", "odd"), ["file", "start"]).select(
        "file", "start", "odd", F.col("nest_before").alias("nest"))
    marked = _with_states(pieces, states).select("file", "start", "at", "odd", "nest", "last", "value")
    return _joined(marked.mapInArrow(_in_arrow(_json_records), _RECORDS), "}")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSON array files by ``schema``; unknown keys are ignored, an object that is no JSON gives nulls."""
    return json_array_records(spark, path).select(F.from_json("record", schema).alias("r")).select("r.*")
