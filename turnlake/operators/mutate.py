"""Table changes as pure functions.

Every function returns new frames; writing them goes to a *new* path (never overwrite a path
being read).  Prefix lookups are equi-joins on the beginnings of the id, so no nested-loop join
appears in the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import conform
from ..session import checkpointed
from ..sources.records import with_seq
from ..sources.validate import split_vectors


def number_rows(df: DataFrame, order_cols: list[str], start, col: str = "seq") -> DataFrame:
    """Consecutive numbers from ``start`` in ``order_cols`` order: a distributed sort, a
    reliable checkpoint (stable partitions) and per-partition offsets."""
    return with_seq(checkpointed(df.orderBy(*order_cols)), start, col)


BROADCAST_PREFIXES = 200_000  # prefixes sent to every task; more are joined by a shuffle, with equal results


def _prefix_matches(records: DataFrame, prefixes: DataFrame, prefix_col: str = "prefix") -> DataFrame:
    """All (prefix row, record) pairs where ``id`` starts with the prefix: one scan of the records, each with
    the beginnings of its id at the lengths that occur (a few small numbers read on the driver), and
    one equi-join.  A short prefix that much of the table has is no hot key as long as the prefixes are
    broadcast."""
    lengths = [r[0] for r in prefixes.select(F.length(prefix_col)).distinct().collect()]
    lengths = sorted(x for x in lengths if x is not None)
    if not lengths:
        schema = T.StructType(records.schema.fields + prefixes.schema.fields)
        return records.sparkSession.createDataFrame([], schema)
    starts = F.filter(F.array(*[F.when(F.length("id") >= n, F.substring("id", 1, n)) for n in lengths]), lambda x: x.isNotNull())
    few = prefixes.limit(BROADCAST_PREFIXES + 1).count() <= BROADCAST_PREFIXES
    keyed = records.withColumn(prefix_col, F.explode(starts))
    return keyed.join(F.broadcast(prefixes) if few else prefixes, prefix_col)


def append(records: DataFrame, new: DataFrame) -> DataFrame:
    """M1: new records (already built, seq continuing) appended."""
    return conform(records).unionByName(conform(new))


def append_vectors(records: DataFrame, new: DataFrame, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """M1 for a table that is searched by vector: ``(records and the new ones whose vector is of the table's width,
    the rejected ones with reject_reason)``.  ``width`` defaults to that of one stored vector, read on the driver; a
    table without any takes every finite vector of the width of its first new one, and without that rejects all."""
    if width is None:
        found = next((r for df in (records, new) for r in df.where(F.size("vector") > 0).select(F.size("vector")).limit(1).collect()), None)
        width = -1 if found is None else found[0]
    valid, rejected = split_vectors(conform(new), width)
    return append(records, valid), rejected


def update_by_prefix(
    records: DataFrame, updates: DataFrame, now: int, *, vector_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """M2 in batch form.  ``updates(useq, prefix, text, tags[, vector])``: each update hits the
    *first* record (lowest seq) whose id starts with its prefix; new text, timestamp ``now``,
    tags replaced only when non-empty.  Several updates of one record act as applied in order of
    ``useq``: text (and vector) of the last, tags of the last that has any.  Returns ``(updated table, unmatched
    updates)``."""
    if updates.where(F.length("prefix") == 0).limit(1).count():
        raise ValueError("empty prefix")
    m = _prefix_matches(records.select("seq", "id"), updates.select("useq", "prefix"))
    first = m.groupBy("useq", "prefix").agg(F.min("seq").alias("seq"))  # first match per update
    last = first.join(updates.select("useq", (F.size(F.coalesce("tags", F.array())) > 0).alias("_has")), "useq")
    last = last.groupBy("seq").agg(F.max("useq").alias("useq"), F.max(F.when(F.col("_has"), F.col("useq"))).alias("_tseq"))
    cols = ["useq", F.col("text").alias("_ntext")]
    if vector_col:
        cols.append(F.col(vector_col).alias("_nvec"))
    tags = updates.select(F.col("useq").alias("_tseq"), F.col("tags").alias("_ntags"))
    u = last.join(updates.select(*cols), "useq").join(tags, "_tseq", "left").drop("_tseq")
    j = records.join(u, "seq", "left")
    hit = F.col("useq").isNotNull()
    out = (
        j.withColumn("text", F.when(hit, F.col("_ntext")).otherwise(F.col("text")))
        .withColumn("tags", F.when(hit & (F.size(F.coalesce("_ntags", F.array())) > 0), F.col("_ntags")).otherwise(F.col("tags")))
        .withColumn("timestamp", F.when(hit, F.lit(int(now)).cast("bigint")).otherwise(F.col("timestamp")))
    )
    if vector_col:
        out = out.withColumn("vector", F.when(hit, F.col("_nvec")).otherwise(F.col("vector")))
    unmatched = updates.join(first.select("useq"), "useq", "left_anti")
    return conform(out), unmatched


def delete_by_prefix(records: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M3: remove *all* records whose id starts with any prefix (empty prefixes refused).
    Returns ``(remaining, per-prefix deleted counts)``; a prefix with count 0 is the
    reference's "not found"."""
    if prefixes.where(F.length("prefix") == 0).limit(1).count():
        raise ValueError("empty prefix")
    m = _prefix_matches(records.select("seq", "id"), prefixes.select("prefix").distinct())
    gone = m.select("seq").distinct()
    remaining = records.join(gone, "seq", "left_anti")
    counts = prefixes.select("prefix").distinct().join(m.groupBy("prefix").agg(F.count(F.lit(1)).alias("deleted")), "prefix", "left")
    return remaining, counts.select("prefix", F.coalesce("deleted", F.lit(0)).alias("deleted"))


def merge_new(local: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add remote records whose id is unknown locally; never overwrite.  Repeats of
    an id inside ``remote`` are added once (lowest remote seq) — the reference would add both.
    New rows get ``seq`` after the local maximum in remote order.
    Returns ``(merged table, one-row counts(added, total))``."""
    new = remote.join(local.select("id"), "id", "left_anti")
    w = Window.partitionBy("id").orderBy("seq")
    new = new.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
    start = F.coalesce(local.select(F.max("seq")).scalar(), F.lit(-1)) + 1
    renum = number_rows(new.withColumnRenamed("seq", "_rseq"), ["_rseq"], start).drop("_rseq")
    merged = conform(local).withColumn("_new", F.lit(0)).unionByName(conform(renum).withColumn("_new", F.lit(1)))
    counts = merged.agg(F.sum("_new").cast("bigint").alias("added"), F.count(F.lit(1)).alias("total"))
    return merged.drop("_new"), counts
