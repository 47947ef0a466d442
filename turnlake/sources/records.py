"""Record building: insertion order, ids, clock and vectors for new entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import conform
from ..session import checkpointed


def with_seq(df: DataFrame, start: int | Column = 0, col: str = "seq") -> DataFrame:
    """Consecutive ``start, start+1, ...`` in the frame's current row order, without a single
    partition: one small job counts rows per input partition (one row per partition), a
    window over those counts gives offsets, and each row adds its position inside its
    partition.  Apply it straight after a scan (or a checkpoint), whose partitioning is
    stable between the two jobs."""
    pid = F.spark_partition_id()
    tagged = df.withColumn("_pid", pid).withColumn("_mid", F.monotonically_increasing_id())
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    s = start if isinstance(start, Column) else F.lit(int(start))
    out = tagged.join(F.broadcast(offsets), "_pid")  # one row per input partition
    return out.withColumn(col, (s + F.col("_off") + pos).cast("bigint")).drop("_pid", "_mid", "_off")


def uuid_like(*cols: Column | str, salt: str = "") -> Column:
    """A deterministic UUID-v4-shaped id from the given columns (sha-256): stable under task
    retries, unlike ``uuid()``."""
    parts = [F.lit(salt)] + [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\u0000")) for c in cols]
    h = F.sha2(F.concat_ws("\u001f", *parts), 256)
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)),
        F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def build_records(
    entries: DataFrame,
    *,
    start_seq: int | Column = 0,
    ns: str = "",
    now: int | Column | None = None,
    id_col: str | None = None,
    vector: Column | None = None,
) -> DataFrame:
    """Entries ``(text, tags[, id])`` -> records.  ``seq`` continues from ``start_seq``;
    ids come from ``id_col`` when given (and present), else a deterministic uuid of
    ``(ns, seq, text)``; ``timestamp`` is ``now`` (default: the query's current time);
    ``vector`` is a column (e.g. from :func:`turnlake.operators.embed.embed`).  The entries are checkpointed, since both
    jobs of the numbering must see the same partitions, whatever plan the caller's frame has."""
    df = with_seq(checkpointed(entries), start_seq)
    gen_id = uuid_like(F.lit(ns), "seq", "text")
    rid = F.coalesce(F.col(id_col), gen_id) if id_col and id_col in entries.columns else gen_id
    ts = F.unix_timestamp() if now is None else (now if isinstance(now, Column) else F.lit(int(now)))
    out = df.withColumn("id", rid).withColumn("ns", F.lit(ns)).withColumn("timestamp", ts.cast("bigint"))
    if vector is not None:
        out = out.withColumn("vector", vector)
    return conform(out)


def next_seq(table: DataFrame) -> Column:
    """max(seq)+1 of an existing table as a scalar subquery (0 for an empty table)."""
    return F.coalesce(table.select(F.max("seq")).scalar(), F.lit(-1)) + 1
