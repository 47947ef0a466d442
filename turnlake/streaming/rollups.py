"""Running session summaries and tag counts.

The record stream is classified with the batch column functions and aggregated with
``groupBy`` in *update* mode: Spark keeps one small state row per key and emits the changed
keys each trigger.  ``foreachBatch`` appends those rows with their batch id; the current
value of a key is the row of its latest batch (``max_by`` over batch id, a partial
aggregation) — :func:`current_state`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.timeline import classify_records


def session_rollup(records: DataFrame, preview_chars: int = 100) -> DataFrame:
    users = classify_records(records).where((F.col("role") == "user") & F.col("session_id").isNotNull())
    users = users.select("session_id", "timestamp", "seq", F.substring("body", 1, preview_chars).alias("preview"))
    return users.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("count"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        F.min(F.struct("timestamp", "seq", "preview")).alias("_first"),
    )


def tag_rollup(records: DataFrame) -> DataFrame:
    return records.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("count"))


def start_update_stream(agg: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None):
    def body(df, bid):
        df.withColumn("_batch", F.lit(int(bid))).write.mode("append").parquet(sink)

    return (
        agg.writeStream.outputMode("update").foreachBatch(body).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def current_state(updates: DataFrame, key: str) -> DataFrame:
    """Latest emitted row per key."""
    cols = [c for c in updates.columns if c not in (key, "_batch")]
    latest = updates.groupBy(key).agg(F.max_by(F.struct(*cols), "_batch").alias("_s"))
    return latest.select(key, "_s.*")
