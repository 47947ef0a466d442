"""Shared helpers of the training-data operators: tables, label folds, Arrow text buffers and
connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


def in_fold(doc_id: Column, modulus: int, rest: int) -> Column:
    """True where the fold is ``rest``; false for a null id."""
    return F.coalesce(fold(doc_id, modulus) == rest, F.lit(False))


def label_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int,
                 modulus: int = 5, held: int = 0) -> tuple[dict[int, int], dict[int, list[bytes]]]:
    """The number of labelled rows by label 0 and 1, and a bounded sample of texts of each.

    Only ids whose fold by ``modulus`` is not ``held`` count.  An id labelled both 0 and 1 counts in
    neither sample.  The sample: of the documents with a label, a text that is not null and at most
    ``chars`` characters (longer texts are left out whole, never cut), of each label the ``rows`` with the smallest
    xxhash64 of their id (ties: of id and text); one for each id and text.  The ranks are found
    from ids and sizes alone; texts are read for what they choose.
    """
    usable = (labels.where(F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), modulus, held)
                           & F.col(label).isin(0, 1))
              .select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")))
    shares = {r["_label"]: r["n"] for r in usable.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    once = usable.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).where("_label = _other")
    able = docs.where(F.col("text").isNotNull() & (F.length("text") <= chars)).select("doc_id", F.xxhash64("doc_id", "text").alias("_t"))
    ranked = able.join(once, F.col("doc_id") == F.col("_id")).select("_id", "_label", "_t").distinct()
    picked = [ranked.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id", "_t").limit(rows) for k in (0, 1)]
    wanted = checkpointed(picked[0].unionByName(picked[1]))  # 2 x ``rows`` at most
    found = docs.select("doc_id", "text").join(
        F.broadcast(wanted), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("doc_id", "text") == F.col("_t")))
    # copies of a row give one text each
    chosen = found.dropDuplicates(["_id", "_t"]).orderBy(F.xxhash64("_id"), "_id", "_t").select("_label", "text").collect()
    return shares, {k: [r["text"].encode() for r in chosen if r["_label"] == k] for k in (0, 1)}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.  Only where the session names
    none and runs locally (tests) is a new one under /tmp set."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or f"/tmp/llm-checkpoints-{uuid.uuid4().hex[:8]}")
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them (n + 1); null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[starts[0]:starts[-1]], starts - starts[0]


def row_groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, a longer row alone."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, ...]:
    """Weighted logistic regression of a few variables with a small ridge, by Newton steps."""
    design = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(design.shape[1])
    ridge = np.diag([1e-2] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (p - y)) + ridge @ beta
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + ridge
        step = np.linalg.solve(curve, slope)
        beta = beta - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components: ``nodes(node)`` and ``links(a, b)`` give ``(node, root)`` with the
    smallest node that links reach.

    Alternating large-star and small-star steps: every step is a grouped minimum and an equi-join,
    each round's links are checkpointed, and no group is ever collected.  Ends when a round
    leaves the links as they were; raises after ``max_rounds``.  Self-links and repeated links
    are harmless; a node without links is its own root.
    """
    def digest(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    def star(pairs: DataFrame, own: str, other: str) -> DataFrame:
        """Every ``other`` of an ``own`` linked to the smallest of the group and ``own``.  The minima are
        written first: Spark splits a hot key of two plain shuffles only, not beside an aggregate."""
        least = pairs.groupBy(F.col(own).alias("k")).agg(F.min(other).alias("m"))
        least = checkpointed(least.select("k", F.least("k", "m").alias("m")))
        return pairs.join(least, pairs[own] == least["k"])

    edges = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                         .where("a <> b").distinct())
    seen = digest(edges)
    if seen[0] == 0:
        return nodes.select("node", F.col("node").alias("root"))
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (star(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        # large holds (a, b) with a > b: small star links every smaller neighbour of a, and a,
        # to the smallest of them
        joined = star(large, "a", "b")
        small = (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(joined.select("a", F.col("m").alias("b")))
                 .where("a <> b").distinct())
        edges = checkpointed(small)
        now = digest(edges)
        if now == seen:
            roots = edges.select(F.col("a").alias("k"), F.col("b").alias("root"))
            return (nodes.join(roots, nodes["node"] == roots["k"], "left")
                    .select("node", F.coalesce("root", "node").alias("root")))
        seen = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
