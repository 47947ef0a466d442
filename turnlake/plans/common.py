"""Shared parameters of the registered queries (FIXTURES C.3) and output helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import OUT_DECIMALS
from ..sources.tables import BASE_TS, table

# Fixed parameters of the registered queries.
QUERY_VEC_ID = 7
QUERY_TEXT = "In the BL 日 la"  # tokens: in, the, bl, 日, la
FILTER_TAG = "en"
AFTER = BASE_TS + 86400
BEFORE = BASE_TS + 25 * 86400
ALPHA = 0.7
TOP = 10
DUP_THRESHOLD = 0.95


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = QUERY_VEC_ID) -> list[float]:
    """One query vector (a parameter of the search, fetched like a user's embedded question)."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    if row is None:
        raise ValueError(f"no embedding with vec_id {vec_id}")
    return [float(x) for x in row[0]]


def r6(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, OUT_DECIMALS)


def big(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("bigint")


def joined(col: str | Column, sep: str = ",") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(c, sep)


def search_out(df: DataFrame) -> DataFrame:
    return df.select(
        big("rank").alias("rank"), big("seq").alias("seq"), "id", r6("score").alias("score"),
        big("timestamp").alias("timestamp"), joined("tags").alias("tags"),
    )
