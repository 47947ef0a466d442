"""Exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSV_HEADER = "id,text,tags,timestamp"


def export_rows(records: DataFrame) -> DataFrame:
    """S13/C15 projection: ``id, text, tags, timestamp`` (no vector)."""
    return records.select("id", "text", "tags", "timestamp")


def csv_line(id_col: str = "id", text: str = "text", tags: str = "tags", ts: str = "timestamp") -> Column:
    """S14 line: id, text and comma-joined tags in double quotes (quotes doubled in text and
    tags), timestamp bare — the reference's exact layout."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    esc = lambda c: F.replace(c, F.lit('"'), F.lit('""'))
    return F.concat_ws(",", q(F.col(id_col)), q(esc(F.col(text))), q(esc(F.array_join(F.col(tags), ","))), F.col(ts).cast("string"))


def write_json(records: DataFrame, path: str, with_vectors: bool = False) -> None:
    """S13 (S15 with vectors and seq): JSON lines, one part file per partition."""
    cols = ["seq", "ns", "id", "text", "vector", "timestamp", "tags"] if with_vectors else ["id", "text", "tags", "timestamp"]
    records.select(*cols).write.mode("errorifexists").json(path)


def write_csv(records: DataFrame, path: str) -> None:
    """The header line then one line per record in insertion order.  A range-partitioned
    sort on ``seq`` puts the header (key -1) first, so the part files concatenated in name
    order are the reference's file."""
    spark = records.sparkSession
    header = spark.range(1).select(F.lit(-1).cast("bigint").alias("_k"), F.lit(CSV_HEADER).alias("value"))
    lines = records.select(F.col("seq").alias("_k"), csv_line().alias("value"))
    header.unionByName(lines).orderBy("_k").select("value").write.mode("errorifexists").text(path)


def write_parquet(records: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """S15 full export (vectors included) as Parquet, optionally partitioned (e.g. ``ns``)."""
    w = records.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
