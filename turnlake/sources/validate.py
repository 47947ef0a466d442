"""Input validation: accepted and rejected rows, with a reason column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed limits of the reference's put/update checks (bytes, counts).
MAX_INPUT_TEXT_BYTES = 32768
MAX_TAGS = 64
MAX_TAG_BYTES = 256


def with_reject_reason(df: DataFrame, text: str = "text", tags: str = "tags") -> DataFrame:
    """Adds ``reject_reason``: NULL when valid, else the first failed check in the
    reference's order (empty text, text too long, too many tags, tag too long)."""
    t, g = F.col(text), F.coalesce(F.col(tags), F.array())
    reason = (
        F.when(t.isNull(), "missing_text")
        .when(F.length(t) == 0, "empty_text")
        .when(F.octet_length(t) > MAX_INPUT_TEXT_BYTES, "text_too_long")
        .when(F.size(g) > MAX_TAGS, "too_many_tags")
        .when(F.exists(g, lambda x: F.octet_length(x) > MAX_TAG_BYTES), "tag_too_long")
    )
    return df.withColumn("reject_reason", reason)


def split_valid(df: DataFrame, text: str = "text", tags: str = "tags") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reject_reason``)."""
    v = with_reject_reason(df, text, tags)
    return v.where(F.col("reject_reason").isNull()).drop("reject_reason"), v.where(F.col("reject_reason").isNotNull())


def with_vector_reason(df: DataFrame, width: int, vector: str = "vector") -> DataFrame:
    """Adds ``reject_reason``: NULL for a vector of ``width`` finite items, the width of the table's vectors;
    else the first failed check (missing vector, other width, a missing or non-finite item)."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = F.when(v.isNull(), "missing_vector").when(F.size(v) != width, "vector_width").when(bad, "vector_item")
    return df.withColumn("reject_reason", reason)


def split_vectors(df: DataFrame, width: int, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(rows with a vector of the table's width, rejected rows with ``reject_reason``)."""
    v = with_vector_reason(df, width, vector)
    return v.where(F.col("reject_reason").isNull()).drop("reject_reason"), v.where(F.col("reject_reason").isNotNull())
