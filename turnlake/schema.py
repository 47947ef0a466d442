"""Record schema (one row per stored record) and small schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),  # insertion order
        T.StructField("ns", T.StringType(), False),  # namespace, '' = default
        T.StructField("id", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("vector", T.ArrayType(T.FloatType()), True),
        T.StructField("timestamp", T.LongType(), False),  # Unix seconds, UTC
        T.StructField("tags", T.ArrayType(T.StringType()), False),
    ]
)

RECORD_COLUMNS = [f.name for f in RECORD_SCHEMA.fields]
PUBLIC_COLUMNS = ["id", "text", "tags", "timestamp"]  # projection without the vector


def public_view(df: DataFrame) -> DataFrame:
    """The record without its vector."""
    return df.select(*PUBLIC_COLUMNS)


def conform(df: DataFrame) -> DataFrame:
    """Cast a frame to the record schema; missing optional columns are filled."""
    cols = []
    for f in RECORD_SCHEMA.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "ns":
            cols.append(F.lit("").alias("ns"))
        elif f.name == "vector":
            cols.append(F.lit(None).cast(f.dataType).alias("vector"))
        elif f.name == "tags":
            cols.append(F.array().cast(f.dataType).alias("tags"))
        else:
            raise ValueError(f"record frame lacks required column {f.name!r}")
    return df.select(*cols)


def tags_text(col: str = "tags", sep: str = ",") -> F.Column:
    """Arrays are compared as joined strings in oracle checks."""
    return F.array_join(F.col(col), sep)
