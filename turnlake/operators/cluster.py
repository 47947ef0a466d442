"""Cosine k-means with the reference's rules.

* k is capped at n; initial centroid i is the row at position ``i*n//k`` in insertion order;
* each round assigns every vector to the centroid of highest cosine, ties to the *last*
  centroid; assignments start at 0 and the loop stops *before* the update when nothing
  changed; at most 30 rounds;
* the update is the plain mean of the members; an empty cluster keeps its centroid.

Per round: one ``mapInPandas`` pass over the (persisted) vectors with the k x d centroids
broadcast.  The pass emits only per-partition partial sums (k rows per partition), which are
added up in the order of the partitions, so that an unchanged assignment gives equal means; one small
``groupBy`` finishes them where they are many.  Only k x d numbers reach the driver and no
per-row state is carried between rounds.

With ``bounds=True`` each row keeps its cluster, an upper bound of the angle to its own centroid and a lower
bound of the angle to all others.  A centroid that turns by an angle moves these bounds by no more than that
(the triangle inequality on the sphere), so a row is scored again only when its bounds meet.  The bounds are a
narrow table beside the vectors, partitioned and sorted alike; of a round only the rows scored again are shuffled
or cross to Python, and the sums change by the rows that moved.  The assignments are those of the plain rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import stack_raw, stack_unit
from ..session import checkpointed
from ..sources.records import with_seq

MAX_ROUNDS = 30
DIRECT_PARTIALS_LIMIT = 2_000_000  # partial-sum values small enough to skip the aggregation shuffle
MAX_CENTROID_BYTES = 256 * 1024 * 1024  # centroids are broadcast every round
BOUND_SLACK = 1e-6  # radians; rounding of arccos near 1 is about 1e-8
BOUND_CHECKPOINT = 8  # rounds between checkpoints of all bounds; those of a round's scored rows are written each time
BOUND_SCHEMA = "seq long, cluster long, own double, other double, block array<double>"


def assign_nearest(U: np.ndarray, C: np.ndarray) -> np.ndarray:
    """Index of the centroid with the highest cosine, ties to the last one."""
    Cu, _ = stack_unit(list(C), C.shape[1])
    S = U @ Cu.T
    k = S.shape[1]
    return (k - 1 - np.argmax(S[:, ::-1], axis=1)).astype(np.int64)


def initial_centroids(vectors: DataFrame, k: int) -> tuple[np.ndarray, int, int]:
    """Rows ``i*n//k`` in ``seq`` order.  The sort is distributed; positions come from
    per-partition counts (:func:`with_seq`); only the k chosen vectors are collected."""
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    n = size["n"]
    if n == 0 or k <= 0:
        return np.zeros((0, 0)), 0, n
    k = min(k, n)
    if k * (size["dim"] or 1) * 8 > MAX_CENTROID_BYTES:
        raise ValueError(f"{k} x {size['dim']} centroids exceed the broadcast budget; lower k")
    # positions need a stable partitioning between with_seq's two jobs: number the sorted
    # keys after a reliable checkpoint (keys only, not vectors)
    keys = checkpointed(vectors.select("seq").orderBy("seq"))
    pos = with_seq(keys, 0, "pos")
    wanted = sorted({i * n // k for i in range(k)})
    chosen = pos.where(F.col("pos").isin(wanted))
    rows = vectors.join(F.broadcast(chosen), "seq").select("pos", "vector").collect()  # k rows
    by_pos = {r["pos"]: r["vector"] for r in rows}
    C = stack_raw([by_pos[i * n // k] for i in range(k)], max(size["dim"] or 0, 0))
    return C, k, n


def _round_stats(vectors: DataFrame, C_new: np.ndarray, C_prev: np.ndarray | None, dim: int):
    """One pass: assignment under ``C_new``, per-cluster counts and vector sums, and the number of changed
    assignments (from 0 in the first round).

    Each partition emits its partial block ``k x (d + 2)`` (sums, count, changed).  When
    #partitions x block is small the blocks are collected as one array row per partition and
    summed on the driver, always in the same order: the caller then sees from the means whether anything
    changed, and after the first round ``changed`` is None.  Otherwise they are summed by a ``groupBy`` over
    ``(cluster, j)``, in any order, and the rows are assigned under ``C_prev`` too."""
    spark = vectors.sparkSession
    bc = spark.sparkContext.broadcast((C_new, C_prev))
    k = C_new.shape[0]
    width = dim + 2
    direct = vectors.rdd.getNumPartitions() * k * width <= DIRECT_PARTIALS_LIMIT

    def part(it):
        Cn, Cp = bc.value
        block = np.zeros((k, width), dtype=np.float64)  # sums | count | changed
        for pdf in it:
            if len(pdf) == 0:
                continue
            raw = stack_raw(pdf["vector"], dim)
            U, _ = stack_unit(list(raw), dim)
            a = assign_nearest(U, Cn)
            if Cp is None:
                block[0, dim + 1] += np.count_nonzero(a)
            elif not direct:
                block[0, dim + 1] += np.count_nonzero(a != assign_nearest(U, Cp))
            np.add.at(block[:, dim], a, 1.0)
            np.add.at(block[:, :dim], a, raw)
        if direct:
            yield pd.DataFrame({"block": [block.reshape(-1)]})
        else:
            js = np.arange(width)
            yield pd.DataFrame({"cluster": np.repeat(np.arange(k), width), "j": np.tile(js, k), "x": block.reshape(-1)})

    if direct:
        out = vectors.select("vector").mapInPandas(part, "block array<double>")
        total = np.zeros(k * width)
        for r in out.collect():  # one row per partition, bounded by the check above
            total += np.asarray(r["block"], dtype=np.float64)
        total = total.reshape(k, width)
    else:
        out = vectors.select("vector").mapInPandas(part, "cluster long, j long, x double")
        total = np.zeros((k, width))
        for r in out.groupBy("cluster", "j").agg(F.sum("x").alias("x")).collect():  # k x (d + 2) numbers
            total[r["cluster"], r["j"]] = r["x"]
    sums = total[:, :dim]
    counts = np.rint(total[:, dim]).astype(np.int64)
    changed = None if direct and C_prev is not None else int(round(total[:, dim + 1].sum()))
    return counts, sums, changed


def centroid_turns(C: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The angle by which each centroid turned; pi when it became zero or was zero (a zero centroid is at a
    right angle to every row, whatever its place)."""
    A, B = (stack_unit(list(m), C.shape[1])[0] for m in (C, new))
    angle = 2 * np.arcsin(np.clip(np.linalg.norm(A - B, axis=1) / 2, 0.0, 1.0))
    return np.where(A.any(axis=1) != B.any(axis=1), np.pi, angle)


def _bound_moves(spark, turns: np.ndarray) -> DataFrame:
    """``(cluster, grow, shrink)``: by what the two bounds of a cluster's rows move, k rows."""
    k = len(turns)
    far = np.full(k, turns.max())
    top = int(turns.argmax())
    far[top] = np.delete(turns, top).max() if k > 1 else 0.0
    return spark.createDataFrame(pd.DataFrame({"cluster": np.arange(k), "grow": turns, "shrink": far}))


def _score_rows(rows: DataFrame, C: np.ndarray, first: bool) -> DataFrame:
    """Rows ``(seq, was, vector)`` scored under ``C``: their new cluster and bounds.  Each partition adds, with no
    ``seq``, one block ``sums | count`` for each cluster that it changes, and one of cluster -1 that holds
    ``changed, scored``."""
    bc = rows.sparkSession.sparkContext.broadcast(C)
    k, dim = C.shape

    def part(it):
        centroids = stack_unit(list(bc.value), dim)[0]
        moved = np.zeros((k, dim + 1))
        touched = np.zeros(k, dtype=bool)
        changed = scored = 0
        for pdf in it:
            if len(pdf) == 0:
                continue
            raw = stack_raw(pdf["vector"], dim)
            S = stack_unit(pdf["vector"], dim)[0] @ centroids.T
            at = np.arange(len(S))
            now = k - 1 - np.argmax(S[:, ::-1], axis=1)
            best = S[at, now]
            S[at, now] = -np.inf
            rest = np.arccos(np.clip(S.max(axis=1), -1.0, 1.0)) if k > 1 else np.full(len(S), np.inf)
            was = pdf["was"].to_numpy()
            differs = now != was
            changed, scored = changed + int(differs.sum()), scored + len(S)
            adds = np.ones(len(S), dtype=bool) if first else differs
            x = np.column_stack([raw, np.ones(len(raw))])[adds]
            np.add.at(moved, now[adds], x)
            touched[now[adds]] = True
            if not first:
                np.subtract.at(moved, was[adds], x)
                touched[was[adds]] = True
            yield pd.DataFrame({"seq": pdf["seq"].astype("Int64"), "cluster": now, "own": np.arccos(np.clip(best, -1.0, 1.0)),
                                "other": rest, "block": None})
        ids = np.flatnonzero(touched)
        yield pd.DataFrame({"seq": pd.array([None] * (len(ids) + 1), dtype="Int64"), "cluster": [-1, *ids.tolist()], "own": 0.0,
                            "other": 0.0, "block": [np.array([changed, scored], dtype=np.float64), *moved[ids]]})

    return rows.mapInPandas(part, BOUND_SCHEMA)


def _added_blocks(scored: DataFrame, k: int, width: int, parts: int) -> tuple[np.ndarray, int, int]:
    """The blocks of :func:`_score_rows` summed: ``(k x width changes of sums and counts, changed, scored)``."""
    blocks = scored.where(F.col("seq").isNull()).select("cluster", "block")
    total, marks = np.zeros((k, width)), np.zeros(2)
    if parts * k * width <= DIRECT_PARTIALS_LIMIT:
        for r in blocks.collect():  # at most k + 1 rows for each partition, bounded by the check above
            if r["cluster"] < 0:
                marks += r["block"]
            else:
                total[r["cluster"]] += r["block"]
    else:
        cells = blocks.select("cluster", F.posexplode("block").alias("j", "x"))
        for r in cells.groupBy("cluster", "j").agg(F.sum("x").alias("x")).collect():  # k x (d + 1) numbers
            if r["cluster"] < 0:
                marks[r["j"]] = r["x"]
            else:
                total[r["cluster"], r["j"]] = r["x"]
    return total, int(round(marks[0])), int(round(marks[1]))


def bounded_rounds(records: DataFrame, C: np.ndarray, limit: int) -> tuple[np.ndarray, int, list[int]]:
    """The rounds of :func:`kmeans_fit` with bounds: ``(centroids, rounds, rows scored in each round)``.  ``seq`` is
    unique.  Rows that no bound can part (zero vectors, ties) are scored in every round."""
    spark = records.sparkSession
    parts = max(records.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    vectors = records.select("seq", "vector").repartition(parts, "seq").sortWithinPartitions("seq").persist(StorageLevel.MEMORY_AND_DISK)
    k, dim = C.shape
    total = np.zeros((k, dim + 1))
    state = vectors.select("seq", F.lit(0).cast("long").alias("cluster"), F.lit(0.0).alias("own"), F.lit(-1.0).alias("other"))
    kept, counts, rounds = [vectors], [], 0
    try:
        while rounds + 1 < limit:
            active = state.where(F.col("own") + BOUND_SLACK >= F.col("other")).select("seq", F.col("cluster").alias("was"))
            scored = checkpointed(_score_rows(active.join(vectors, "seq"), C, rounds == 0))
            delta, changed, n = _added_blocks(scored, k, dim + 1, parts)
            rounds += 1
            counts.append(n)
            for old in kept[1:-1]:  # what the current bounds were made of is computed by now
                old.unpersist()
            kept = [vectors, *kept[1:][-1:]]
            if changed == 0:
                return C, rounds, counts
            total += delta
            size = np.rint(total[:, dim])
            total[size == 0] = 0.0  # an emptied cluster starts from nothing again
            new = C.copy()
            filled = size > 0
            new[filled] = total[filled, :dim] / size[filled, None]
            fresh = scored.where(F.col("seq").isNotNull()).select(
                "seq", F.col("cluster").alias("c"), F.col("own").alias("o"), F.col("other").alias("r"))
            moves = _bound_moves(spark, centroid_turns(C, new))
            state = (
                state.join(fresh, "seq", "left")
                .select("seq", F.coalesce("c", "cluster").alias("cluster"), F.coalesce("o", "own").alias("own"),
                        F.coalesce("r", "other").alias("other"))
                .join(F.broadcast(moves), "cluster")  # k rows, held to MAX_CENTROID_BYTES
                .select("seq", "cluster", (F.col("own") + F.col("grow")).alias("own"), (F.col("other") - F.col("shrink")).alias("other"))
            )
            state = checkpointed(state) if rounds % BOUND_CHECKPOINT == 0 else state.persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(state)
            C = new
        return C, limit, counts
    finally:
        for df in kept:
            df.unpersist()


def kmeans_fit(
    records: DataFrame, k: int = 5, *, max_rounds: int = MAX_ROUNDS, stop_after: int | None = None, bounds: bool = False
) -> tuple[np.ndarray, int]:
    """Returns ``(centroids used by the final assignment, rounds run)``.  ``stop_after=r``
    stops after r assignment rounds (for step-wise checks).  ``bounds`` keeps bounds beside the rows, which pays
    with many clusters or wide vectors; the assignments are the same."""
    vectors = records.select("seq", "vector").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        C, k, n = initial_centroids(vectors, k)
        if k == 0:
            return C, 0
        dim = C.shape[1]
        prev = None
        rounds = 0
        limit = max_rounds if stop_after is None else min(max_rounds, stop_after)
        if bounds:
            return bounded_rounds(vectors, C, limit)[:2]
        while rounds < limit:
            if rounds + 1 == limit:  # no update follows, so nothing is left to measure
                rounds += 1
                break
            counts, sums, changed = _round_stats(vectors, C, prev, dim)
            rounds += 1
            if changed == 0:
                break
            newC = C.copy()
            nz = counts > 0
            newC[nz] = sums[nz] / counts[nz, None]
            if changed is None and np.array_equal(newC, C):  # an unchanged assignment adds up to the same means
                break
            prev, C = C, newC
        return C, rounds
    finally:
        vectors.unpersist()


def assign_clusters(records: DataFrame, centroids: np.ndarray, cols: tuple[str, ...] = ("seq", "id")) -> DataFrame:
    """Rows ``(*cols, cluster)`` under the given centroids (broadcast, k x d)."""
    spark = records.sparkSession
    bc = spark.sparkContext.broadcast(centroids)
    dim = centroids.shape[1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*cols).schema.fields) + ", cluster long"

    def part(it):
        C = bc.value
        for pdf in it:
            if len(pdf) == 0:
                continue
            U, _ = stack_unit(pdf["vector"], dim)
            out = pdf[list(cols)].copy()
            out["cluster"] = assign_nearest(U, C)
            yield out

    sel = list(dict.fromkeys([*cols, "vector"]))
    return records.select(*sel).mapInPandas(part, schema)


def kmeans(records: DataFrame, k: int = 5, **opts) -> DataFrame:
    """V8: ``(seq, id, cluster)`` for every record (clusters numbered from 0)."""
    C, _ = kmeans_fit(records, k, **opts)
    if C.shape[0] == 0:
        return records.select("seq", "id").withColumn("cluster", F.lit(None).cast("long")).limit(0)
    return assign_clusters(records, C)


def cluster_members(assignments: DataFrame) -> DataFrame:
    """A5: ``(cluster, position, seq, id)``: the members of each cluster in insertion order, as rows."""
    w = Window.partitionBy("cluster").orderBy("seq")
    return assignments.select("cluster", F.row_number().over(w).alias("position"), "seq", "id")


def cluster_summary(assignments: DataFrame) -> DataFrame:
    """A5: size per non-empty cluster (members are the rows of :func:`cluster_members`)."""
    return assignments.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).orderBy("cluster")
