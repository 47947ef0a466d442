"""A stored index of lists that takes inserts and removals without a rebuild.

The reference inserts into its graph in memory; here the index is a folder of append-only segments:

* ``rows/seg=<name>/list_id=<n>/`` holds the records ``(seq, id, vector)`` of one insert, each in its
  nearest list.  An insert writes one segment and reads no stored row.
* ``gone/seg=<name>/`` holds the ``seq`` of one removal; readers drop older rows by an anti join.
* ``centroids/<name>/`` holds the lists' centroids, null for a list that was split.
* ``manifest/`` has one row for each of these, with the number of the operation that wrote it.  An
  operation's manifest rows are its last write, one file: what a crashed writer left behind is in no
  manifest and is never read.

When a list passes its bound, its live rows alone are read, dealt to new lists by a few rounds of
k-means inside the list and written as a segment; the old list gets no centroid and is not read again.
Files of other lists stay as they are.  One writer at a time; readers need none."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import stack_raw, stack_unit
from ..session import checkpointed
from .ann import build_index, gathered

_MANIFEST = "op long, kind string, name string"
_ROWS = "seq long, id string, vector array<double>, seg string, list_id long"


def create_store(records: DataFrame, path: str, nlist: int | None = None, *, rounds: int = 10) -> None:
    """A new store at ``path`` with the lists of :func:`turnlake.operators.ann.build_index`."""
    rows, centroids = build_index(records.select("seq", "id", "vector"), nlist, rounds=rounds)
    spark = records.sparkSession
    if centroids.shape[0] == 0:
        raise ValueError("an index needs a record to begin with")
    _commit(spark, path, 0, [("rows", _write_rows(rows, path)), ("centroids", _write_centroids(spark, path, centroids))])


def insert(spark: SparkSession, path: str, records: DataFrame, *, max_list_rows: int | None = None) -> None:
    """Add records; stored rows are not read, unless a list then holds more than ``max_list_rows`` (counted
    from the files' footers, removed rows included) and is split.  A ``seq`` that was removed lives again;
    one that lives already would be there twice."""
    ops = _manifest(spark, path)
    centroids = _centroids(spark, path, ops)
    rows = _assigned(records.select("seq", "id", "vector"), centroids)
    _commit(spark, path, _next(ops), [("rows", _write_rows(rows, path))])
    if max_list_rows:
        split_lists(spark, path, max_list_rows)


def remove(spark: SparkSession, path: str, seqs: DataFrame) -> None:
    """Remove the records with the given ``seq``; unknown ones are ignored."""
    name = _name()
    seqs.select(F.col("seq").cast("bigint").alias("seq")).distinct().write.parquet(f"{path}/gone/seg={name}")
    _commit(spark, path, _next(_manifest(spark, path)), [("gone", name)])


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """``(rows (seq, id, vector, list_id), centroids)`` for the searches of :mod:`turnlake.operators.ann`; a
    filter on ``list_id`` prunes the lists' folders."""
    ops = _manifest(spark, path)
    centroids = _centroids(spark, path, ops)
    live = [int(x) for x in np.flatnonzero(~np.isnan(centroids).any(axis=1))]
    return _live_rows(spark, path, ops, live), centroids


def list_sizes(spark: SparkSession, path: str) -> dict[int, int]:
    """Stored rows of each list in use, from the files' footers."""
    ops = _manifest(spark, path)
    centroids = _centroids(spark, path, ops)
    counts = _stored(spark, path, ops).groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["list_id"]: r["n"] for r in counts if not np.isnan(centroids[r["list_id"]]).any()}


def split_lists(spark: SparkSession, path: str, max_list_rows: int, *, rounds: int = 3) -> int:
    """Split every list of more than ``max_list_rows`` stored rows; the number of lists split.  A list whose
    rows are all alike stays."""
    large = {k: n for k, n in list_sizes(spark, path).items() if n > max_list_rows}
    if not large:
        return 0
    ops = _manifest(spark, path)
    centroids = _centroids(spark, path, ops)
    rows = checkpointed(_live_rows(spark, path, ops, sorted(large)))
    parts = spark.createDataFrame([(int(k), int(-(-2 * n // max_list_rows))) for k, n in large.items()], "list_id long, parts int")
    # the first members of a list, in the order of a hash of seq, are its parts' first centroids
    first = Window.partitionBy("list_id").orderBy(F.xxhash64("seq"), "seq")
    seeds = (rows.withColumn("at", F.row_number().over(first)).join(F.broadcast(parts), "list_id")
             .where(F.col("at") <= F.col("parts")).select("list_id", "vector").orderBy("list_id", "at").collect())
    dim = centroids.shape[1]
    means: dict[int, np.ndarray] = {}
    for r in seeds:
        row = stack_raw([r["vector"]], dim)
        means[r["list_id"]] = np.vstack([means[r["list_id"]], row]) if r["list_id"] in means else row
    for _ in range(rounds):
        means = _part_means(rows, means, dim)
    dealt = checkpointed(_dealt(rows, means, dim))
    used = {(r["list_id"], r["part"]) for r in dealt.select("list_id", "part").distinct().collect()}
    split = sorted({k for k, _ in used if sum(1 for x in used if x[0] == k) > 1})
    emptied = sorted(set(large) - {k for k, _ in used})  # all of their rows are removed
    if not split and not emptied:
        return 0
    number, added = {}, []
    for k, p in sorted(used):
        if k in split:
            number[k, p] = centroids.shape[0] + len(added)
            added.append(means[k][p])
    after = np.vstack([centroids, *added]) if added else centroids.copy()
    after[split + (emptied if len(split) + len(emptied) < (~np.isnan(after).any(axis=1)).sum() else [])] = np.nan
    writes = [("centroids", _write_centroids(spark, path, after))]
    if split:
        names = spark.createDataFrame([(k, p, n) for (k, p), n in number.items()], "list_id long, part long, new long")
        moved = dealt.join(F.broadcast(names), ["list_id", "part"]).select("seq", "id", "vector", F.col("new").alias("list_id"))
        writes.append(("rows", _write_rows(moved, path)))
    _commit(spark, path, _next(ops), writes)
    return len(split)


def _name() -> str:
    return f"s-{uuid.uuid4().hex[:16]}"


def _manifest(spark: SparkSession, path: str) -> list:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").orderBy("op").collect()  # one row for each write


def _next(ops: list) -> int:
    return ops[-1]["op"] + 1


def _commit(spark: SparkSession, path: str, op: int, writes: list[tuple[str, str]]) -> None:
    entries = spark.createDataFrame([(op, kind, name) for kind, name in writes], _MANIFEST).coalesce(1)
    entries.write.mode("append").parquet(f"{path}/manifest")


def _write_rows(rows: DataFrame, path: str) -> str:
    name = _name()
    out = rows.select("seq", "id", F.col("vector").cast("array<double>").alias("vector"), "list_id")
    gathered(out).write.partitionBy("list_id").parquet(f"{path}/rows/seg={name}")
    return name


def _write_centroids(spark: SparkSession, path: str, centroids: np.ndarray) -> str:
    name = _name()
    rows = [(k, None if np.isnan(c).any() else [float(x) for x in c]) for k, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list_id long, vector array<double>").coalesce(1).write.parquet(f"{path}/centroids/{name}")
    return name


def _centroids(spark: SparkSession, path: str, ops: list) -> np.ndarray:
    """The newest centroids by list id; NaN for lists that are no longer used."""
    name = [o["name"] for o in ops if o["kind"] == "centroids"][-1]
    rows = spark.read.parquet(f"{path}/centroids/{name}").orderBy("list_id").collect()
    dim = max(len(r["vector"]) for r in rows if r["vector"])
    return np.array([r["vector"] or [np.nan] * dim for r in rows], dtype=np.float64)


def _assigned(records: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(seq, id, vector, list_id)``: nearest list in use, ties to the last, as when the index is built."""
    shared = records.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        C = shared.value
        used = np.flatnonzero(~np.isnan(C).any(axis=1))
        unit = stack_unit(list(C[used]), C.shape[1])[0]
        for pdf in batches:
            if len(pdf):
                scores = stack_unit(pdf["vector"], C.shape[1])[0] @ unit.T
                pdf["list_id"] = used[len(used) - 1 - np.argmax(scores[:, ::-1], axis=1)]
                yield pdf

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema.fields)
    return records.mapInPandas(run, f"{kinds}, list_id long")


def _stored(spark: SparkSession, path: str, ops: list) -> DataFrame:
    names = [o["name"] for o in ops if o["kind"] == "rows"]
    return spark.read.schema(_ROWS).parquet(f"{path}/rows").where(F.col("seg").isin(names))


def _live_rows(spark: SparkSession, path: str, ops: list, lists: list[int]) -> DataFrame:
    rows = _stored(spark, path, ops).where(F.col("list_id").isin(lists))
    gone = [o["name"] for o in ops if o["kind"] == "gone"]
    if gone:
        # one row for each operation on the small side of both broadcasts
        order = F.broadcast(spark.createDataFrame([(o["name"], o["op"]) for o in ops if o["kind"] != "centroids"], "seg string, op long"))
        dead = (spark.read.schema("seq long, seg string").parquet(f"{path}/gone").where(F.col("seg").isin(gone)).join(order, "seg")
                .groupBy("seq").agg(F.max("op").alias("gone_op")))
        rows = rows.join(order, "seg")
        rows = rows.join(dead.withColumnRenamed("seq", "gone_seq"), (F.col("seq") == F.col("gone_seq")) & (F.col("op") < F.col("gone_op")), "left_anti")
    return rows.select("seq", "id", "vector", "list_id")


def _dealt(rows: DataFrame, means: dict[int, np.ndarray], dim: int) -> DataFrame:
    """``rows`` with ``part``, the nearest of their list's means."""
    shared = rows.sparkSession.sparkContext.broadcast(means)

    def run(batches):
        for pdf in batches:
            part = np.zeros(len(pdf), np.int64)
            unit = stack_unit(pdf["vector"], dim)[0]
            for k in pdf["list_id"].unique():
                at = np.flatnonzero(pdf["list_id"].to_numpy() == k)
                part[at] = np.argmax(unit[at] @ stack_unit(list(shared.value[k]), dim)[0].T, axis=1)
            pdf["part"] = part
            yield pdf

    return rows.mapInPandas(run, "seq long, id string, vector array<double>, list_id long, part long")


def _part_means(rows: DataFrame, means: dict[int, np.ndarray], dim: int) -> dict[int, np.ndarray]:
    """One round of k-means inside each list: sums by task, list and part are added up by Spark; a row of
    numbers for each part reaches the driver."""
    def sums(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            values = stack_raw(pdf["vector"], dim)
            for (k, p), at in pdf.groupby(["list_id", "part"]).indices.items():
                yield pd.DataFrame({"list_id": k, "part": p, "j": np.arange(dim + 1), "x": np.append(values[at].sum(axis=0), len(at))})

    found = _dealt(rows, means, dim).mapInPandas(sums, "list_id long, part long, j long, x double")
    out = {k: m.copy() for k, m in means.items()}
    totals: dict[tuple[int, int], np.ndarray] = {}
    for r in found.groupBy("list_id", "part", "j").agg(F.sum("x").alias("x")).collect():
        totals.setdefault((r["list_id"], r["part"]), np.zeros(dim + 1))[r["j"]] = r["x"]
    for (k, p), total in totals.items():
        out[k][p] = total[:dim] / total[dim]
    return out
