"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine
verification in blocks, distributed connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components


def plan_tables(rows: int, cosine: float, miss: float = 1e-7, bucket_rows: int = 1024) -> tuple[int, int]:
    """Bits of a table and number of tables.  A pair at the threshold agrees on one hyperplane with
    probability p = 1 - acos(cosine) / pi, on a table of k with p^k; tables are added until
    all of them miss such a pair with probability ``miss`` at most.  The bits follow the number of
    rows, so that a bucket of unrelated vectors keeps about ``bucket_rows``."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = min(max(math.ceil(math.log2(max(rows, 1) / bucket_rows)), 4), 40)
    return bits, math.ceil(math.log(miss) / math.log1p(-(agree ** bits)))


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1 in double precision, and which rows can be scaled."""
    peak = np.abs(vectors).max(axis=1, initial=0.0)
    ok = np.isfinite(vectors).all(axis=1) & (peak > 0)
    scaled = np.where(ok[:, None], vectors, 0.0) / np.where(ok, peak, 1.0)[:, None]
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-300), ok


def _signatures(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """The sign bits of each row in each table, as (rows, tables) integers."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables))
    signs = (_unit(vectors)[0] @ planes >= 0).reshape(len(vectors), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(column), width)


def _cell_links(left: np.ndarray, right: np.ndarray, left_sig: np.ndarray, right_sig: np.ndarray, table: int,
                cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one cell with the cosine wanted that no earlier table puts together."""
    near = left @ right.T >= cosine
    if same:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    earlier = (left_sig[a, :table] == right_sig[b, :table]).any(axis=1)
    return a[~earlier], b[~earlier]


def embedding_groups(vectors: DataFrame, cosine: float = 0.95, block_rows: int = 1024, seed: int = 17,
                     miss: float = 1e-7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Two rows link if the cosine of their vectors, computed in double precision, is ``cosine`` or
    more; ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id
    reachable, ``kept`` tells whether the row is that one.  Vectors that are null, empty, zero or hold
    a null or non-finite component link with nothing; vectors of different widths do not link.

    Equal vectors are reduced to one row with their number first, so a vector that a third of all
    rows share is hashed once.  Bits and tables come from the number of distinct vectors
    (:func:`plan_tables`).  A bucket above ``block_rows`` is cut into blocks, and each pair of
    blocks is a group of its own, so no task holds a whole bucket; inside a cell the pairs are
    counted in numpy, once per pair (in its first common table), and only the count of each row
    linked and one row of its component inside the cell leave it.
    Rows with equal ids are taken as different rows.
    """
    element = getattr(vectors.schema[vector_col].dataType, "elementType", None)
    kind = "float" if element is not None and element.simpleString() == "float" else "double"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)
    rows = checkpointed(rows.select("vec_id", F.when(usable, F.col("v")).alias("v")))
    classes = checkpointed(rows.where("v IS NOT NULL").groupBy("v")
                           .agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
                           .select(F.monotonically_increasing_id().alias("cid"), "v", "copies", "least",
                                   F.size("v").alias("width")))
    bits, tables = plan_tables(classes.count(), cosine, miss)

    def sign(batches):
        for batch in batches:
            width = batch.column("width").to_numpy(zero_copy_only=False)
            for w in np.unique(width):
                part = batch.filter(pa.array(width == w))
                sig = _signatures(_matrix(part.column("v"), int(w)), bits, tables, seed)
                yield pa.RecordBatch.from_arrays(
                    [part.column("cid"), part.column("copies"), part.column("width"), part.column("v"),
                     pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel()), tables).cast(pa.list_(pa.int64()))],
                    ["cid", "copies", "width", "v", "sig"])

    signed = checkpointed(classes.select("cid", "copies", "width", "v").mapInArrow(
        sign, f"cid bigint, copies bigint, width int, v array<{kind}>, sig array<bigint>"))
    keys = signed.select("cid", "width", F.posexplode("sig").alias("t", "s"))
    sizes = (keys.groupBy("width", "t", "s").agg(F.count("*").alias("n")).where("n > 1")
             .select("width", "t", "s", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")))
    placed = (keys.join(sizes, ["width", "t", "s"])
              .withColumn("own", F.pmod(F.xxhash64("cid", "t"), F.col("blocks")).cast("int")))
    # block `own` meets each block once: as the left side of later blocks, as the right of earlier
    cells = placed.select(
        "cid", "width", "t", "s", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("cid", "t", F.xxhash64("width", "s").alias("s"), "width", "own",
                         F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = cells.join(signed.select("cid", "copies", "v", "sig"), "cid")

    def verify(key, cell):
        t, _, width, i, j = (k.as_py() for k in key)
        own = cell.column("own").to_numpy()
        unit = _unit(_matrix(cell.column("v"), width))[0]
        sig = _matrix(cell.column("sig"), tables)
        cid, copies = cell.column("cid").to_numpy(), cell.column("copies").to_numpy()
        x = np.flatnonzero(own == i)
        y = x if i == j else np.flatnonzero(own == j)
        a, b = _cell_links(unit[x], unit[y], sig[x], sig[y], t, cosine, i == j)
        a, b = x[a], y[b]
        linked = (np.bincount(a, copies[b], len(cid)) + np.bincount(b, copies[a], len(cid))).astype(np.int64)
        # the cell's own components, by propagating the smallest index
        root = np.arange(len(cid))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        touched = np.flatnonzero(linked)
        return pa.table({"cid": cid[touched], "links": linked[touched], "partner": cid[root[touched]]})

    found = checkpointed(full.groupBy("t", "s", "width", "i", "j").applyInArrow(
        verify, "cid bigint, links bigint, partner bigint"))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(classes.select(F.col("cid").alias("node")),
                       found.select(F.col("cid").alias("a"), F.col("partner").alias("b")))
    named = (classes.select("cid", "v", "copies", "least")
             .join(roots, F.col("cid") == F.col("node")).join(counts, "cid", "left"))
    smallest = checkpointed(named.groupBy("root").agg(F.min("least").alias("component_id")))
    of_vector = named.join(smallest, "root").select(
        F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(of_vector, rows["v"] == of_vector["_v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"),
                      component.eqNullSafe(F.col("vec_id")).alias("kept"))
