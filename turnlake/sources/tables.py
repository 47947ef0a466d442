"""Loading the driver tables and deriving record tables from them (FIXTURES C.1, C.2).

``doc_records``: one record per document; each embedding is shared by several documents,
the copies keep it whole or zero its leading items, which plants exact, near and
below-threshold duplicate pairs; timestamps plant newer/older/equal cases.
``turn_records``: one record per conversation turn, as the capture hooks store them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import ASSISTANT_EVENT, USER_EVENT, envelope

# Fixed values of the derived fixtures.
BASE_TS = 1704067200  # 2024-01-01 00:00:00 UTC
HOUR, MINUTE = 3600, 60
LEGACY_CONV_MOD, LEGACY_CONV_REM = 10, 3  # assistant turns stored in the legacy plain-text form


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_id_text(col: str, prefix: str, width: int = 8):
    return F.concat(F.lit(prefix), F.lpad(F.col(col).cast("string"), width, "0"))


def doc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    emb = table(spark, sf_dir, "embeddings")
    labels = table(spark, sf_dir, "labels")
    # m = least(#embeddings, #documents div 2): two row counts (Parquet metadata) read once on
    # the driver, so every expression below carries a literal instead of re-inlined subqueries
    m = F.lit(int(min(emb.count(), docs.count() // 2)))
    d = docs.select(
        "doc_id", "lang", "source", "text",
        F.pmod(F.col("doc_id"), m).alias("g"),
        F.floor(F.col("doc_id") / m).alias("r"),
    )
    zeros = (
        F.when(F.col("r") == 0, 0)
        .when(F.pmod("g", F.lit(4)) == 1, 2)
        .when(F.pmod("g", F.lit(4)) == 2, 6)
        .when(F.pmod("g", F.lit(4)) == 3, 16)
        .otherwise(0)
    )
    d = d.withColumn("zeros", zeros)
    e = emb.select(F.col("vec_id").alias("g"), "embedding")
    lab = labels.select("doc_id", "quality", "toxic")
    j = d.join(e, "g").join(lab, "doc_id", "left")
    shift = F.when(F.pmod("g", F.lit(3)) == 0, F.col("r")).when(F.pmod("g", F.lit(3)) == 1, 10 - F.col("r")).otherwise(0)
    return j.select(
        F.col("doc_id").cast("bigint").alias("seq"),
        F.lit("").alias("ns"),
        doc_id_text("doc_id", "d").alias("id"),
        F.col("text"),
        F.transform("embedding", lambda x, i: F.when(i < F.col("zeros"), F.lit(0.0).cast("float")).otherwise(x)).alias("vector"),
        (F.lit(BASE_TS) + HOUR * F.pmod("g", F.lit(720)) + MINUTE * shift).cast("bigint").alias("timestamp"),
        F.filter(
            F.array(
                F.col("lang"), F.col("source"),
                F.when(F.col("quality") == 1, F.lit("hq")), F.when(F.col("toxic") == 1, F.lit("toxic")),
            ),
            lambda x: x.isNotNull(),
        ).alias("tags"),
    )


def session_of(conv_col: str = "conv_id"):
    return doc_id_text(conv_col, "s")


def turn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    sid = session_of()
    legacy = F.pmod("conv_id", F.lit(LEGACY_CONV_MOD)) == LEGACY_CONV_REM
    text = (
        F.when(F.col("role") == "user", envelope(USER_EVENT, F.col("text"), sid))
        .when((F.col("role") == "assistant") & ~legacy, envelope(ASSISTANT_EVENT, F.col("text"), sid))
        .otherwise(F.col("text"))
    )
    tags = (
        F.when(F.col("role") == "user", F.array(F.lit("prompt"), F.lit("fixture")))
        .when(F.col("role") == "assistant", F.array(F.lit("response"), F.lit("fixture")))
        .otherwise(F.array(F.lit("note")))
    )
    return conv.select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("seq"),
        F.lit("").alias("ns"),
        F.concat(F.lit("c"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit("-"),
                 F.lpad(F.col("turn").cast("string"), 4, "0")).alias("id"),
        text.alias("text"),
        (F.lit(BASE_TS) + HOUR * F.col("conv_id") + MINUTE * F.floor(F.col("turn") / 2)).cast("bigint").alias("timestamp"),
        tags.alias("tags"),
    )


def write_records(records: DataFrame, path: str) -> None:
    """Store a record table partitioned by namespace (S12/S15); always a new path."""
    from ..schema import conform

    conform(records).write.mode("errorifexists").partitionBy("ns").parquet(path)


def read_records(spark: SparkSession, path: str, ns: str | None = None) -> DataFrame:
    """Load a record table, optionally one namespace (a partition filter, so other
    namespaces are not read)."""
    df = spark.read.parquet(path)
    return df.where(F.col("ns") == F.lit(ns)) if ns is not None else df
