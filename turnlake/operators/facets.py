"""Tag facets and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tag_facets(df: DataFrame) -> DataFrame:
    """A1: occurrences per tag (a tag repeated in one record counts each time), most frequent
    first, then by tag.  ``explode`` + partial aggregation: a hot tag is combined map-side."""
    return (
        df.select(F.explode("tags").alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col("tag"))
    )


def totals(df: DataFrame) -> DataFrame:
    """A3: record count as a one-row frame (no driver round trip)."""
    return df.agg(F.count(F.lit(1)).alias("total"))
