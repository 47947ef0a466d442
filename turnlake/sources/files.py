"""Entry sources: text lines, CSV by position, JSON, format dispatch and the extra tag
(SURVEY S1-S5).  An *entry* is ``(text STRING, tags ARRAY<STRING>)`` (+ ``id`` when the JSON
carries one); records are built from entries by :mod:`turnlake.sources.records`."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_ws
from .splitting import read_csv_rows, read_json_array

ENTRY_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])
JSON_ENTRY_SCHEMA = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))]
)


def _empty_tags() -> Column:
    return F.array().cast(T.ArrayType(T.StringType()))


def lines_to_entries(lines: DataFrame, col: str = "value") -> DataFrame:
    """S1 on a frame of lines: strip each line, drop empty ones, no tags."""
    t = strip_ws(col)
    return lines.select(t.alias("text")).where(F.length("text") > 0).withColumn("tags", _empty_tags())


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One entry per non-blank line of the text file(s) at ``path``."""
    return lines_to_entries(spark.read.text(path))


def split_tag_list(col: Column | str) -> Column:
    """Comma-separated tag text -> stripped, non-empty tags (NULL -> [])."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda s: strip_ws(s))
    return F.filter(parts, lambda s: F.length(s) > 0)


def csv_rows_to_entries(rows: DataFrame) -> DataFrame:
    """S2 on parsed CSV rows: column 0 is the text (stripped, skipped when empty), column 1
    the comma-separated tags; other columns are ignored; names do not matter."""
    cols = rows.columns
    text = strip_ws(F.col(f"`{cols[0]}`"))
    tags = split_tag_list(F.col(f"`{cols[1]}`")) if len(cols) > 1 else _empty_tags()
    return rows.select(text.alias("text"), tags.alias("tags")).where(F.length("text") > 0)


def read_csv_entries(spark: SparkSession, path: str) -> DataFrame:
    """Header line, RFC-4180 quoting (doubled quotes), fields may span lines; large files are split."""
    return csv_rows_to_entries(read_csv_rows(spark, path))


def read_json_entries(spark: SparkSession, path: str, json_lines: bool | None = None) -> DataFrame:
    """S3: files of one JSON array of ``{text, tags?}`` (or JSON lines); unknown keys are ignored, missing
    tags become [], a missing ``text`` stays NULL (validation sends it to the rejects).  Large files
    of either form are split."""
    multi = (not json_lines) if json_lines is not None else not str(path).endswith((".jsonl", ".ndjson"))
    if multi:
        df = read_json_array(spark, path, "id string, text string, tags array<string>")
    else:
        df = spark.read.schema(JSON_ENTRY_SCHEMA).json(path)
    return df.select("id", "text", F.coalesce("tags", _empty_tags()).alias("tags"))


def detect_format(path: str, fmt: str | None = None) -> str:
    """Explicit format, else the file extension, else txt; unknown formats read as txt."""
    f = (fmt or os.path.splitext(str(path).rstrip("/"))[1].lstrip(".") or "txt").lower()
    return f if f in ("json", "jsonl", "ndjson", "csv") else "txt"


def load_entries(spark: SparkSession, path: str, fmt: str | None = None, extra_tag: str | None = None) -> DataFrame:
    f = detect_format(path, fmt)
    if f in ("json", "jsonl", "ndjson"):
        df = read_json_entries(spark, path, json_lines=(f != "json"))
    elif f == "csv":
        df = read_csv_entries(spark, path)
    else:
        df = read_text_lines(spark, path)
    return add_tag(df, extra_tag) if extra_tag else df


def add_tag(df: DataFrame, tag: str, col: str = "tags") -> DataFrame:
    """Append ``tag`` where missing (keeps existing repeats, unlike ``array_union``)."""
    t = F.lit(tag)
    return df.withColumn(col, F.when(F.array_contains(col, t), F.col(col)).otherwise(F.array_append(F.col(col), t)))
