"""Near-duplicate pairs and their removal.

``duplicate_pairs`` reproduces the reference rule exactly: each record's 5 nearest records
*including itself* (ties by insertion order), minus itself, with cosine >= threshold; each
unordered pair once.  Work is the exact kNN kernel.  ``duplicate_pairs_lsh`` is the scalable
form of the same rule (see its docstring).
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import RANK_DECIMALS, stack_unit
from ..session import checkpointed
from .search import knn_graph


def _check_threshold(t: float) -> None:
    if not (0.0 <= t <= 1.0):
        raise ValueError("threshold must be between 0.0 and 1.0")


def pairs_from_neighbors(nbrs: DataFrame, threshold: float) -> DataFrame:
    """Neighbour rows ``(qid = seq of the record, seq = neighbour, score)`` -> unordered pairs
    ``(seq_a < seq_b, score)`` found from either side."""
    p = nbrs.where((F.col("qid") != F.col("seq")) & (F.col("score") >= F.lit(float(threshold))))
    return p.groupBy(
        F.least("qid", "seq").alias("seq_a"), F.greatest("qid", "seq").alias("seq_b")
    ).agg(F.max("score").alias("score"))


def duplicate_pairs(records: DataFrame, threshold: float = 0.95, k: int = 5, **kernel_opts) -> DataFrame:
    """V6 exact: ``(seq_a, id_a, seq_b, id_b, score)``; order by score desc to print."""
    _check_threshold(threshold)
    nbrs = knn_graph(records, k, include_self=True, min_score=threshold, **kernel_opts)
    pairs = pairs_from_neighbors(nbrs, threshold)
    ids = records.select("seq", "id")
    return (
        pairs.join(ids.withColumnRenamed("seq", "seq_a").withColumnRenamed("id", "id_a"), "seq_a")
        .join(ids.withColumnRenamed("seq", "seq_b").withColumnRenamed("id", "id_b"), "seq_b")
        .select("seq_a", "id_a", "seq_b", "id_b", "score")
    )


def removal_flags(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """V7: for each pair the newer record (larger timestamp; on equal timestamps the one
    inserted first) is flagged; flags over all pairs at once, not transitive.
    Returns distinct ``seq`` to delete."""
    ts = records.select("seq", "timestamp")
    j = pairs.select("seq_a", "seq_b").join(
        ts.withColumnRenamed("seq", "seq_a").withColumnRenamed("timestamp", "ts_a"), "seq_a"
    ).join(ts.withColumnRenamed("seq", "seq_b").withColumnRenamed("timestamp", "ts_b"), "seq_b")
    return j.select(F.when(F.col("ts_a") >= F.col("ts_b"), F.col("seq_a")).otherwise(F.col("seq_b")).alias("seq")).distinct()


def remove_duplicates(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """V7 + J5: records minus the flagged ones (left anti join on ``seq``)."""
    return records.join(removal_flags(records, pairs), "seq", "left_anti")


# ---------------------------------------------------------------------------------------
# Scalable form: exact-copy collapse + sign hashing with several probes in each table

SKETCH_BITS = 128  # of a second sign hash, compared before any vector is fetched
FLIPPED = 8  # signs of a table nearest to their planes, which probes may turn over


class ProbePlan(NamedTuple):
    bits: int  # of a bucket's key
    tables: int
    probes: int  # buckets looked into in each table, the own one first
    sketch: int  # most differing bits of the sketches of a pair


def _probe_order(dots: np.ndarray, probes: int) -> np.ndarray:
    """For rows of dot products with a table's planes the ``probes`` likeliest changes of signs (as bits to turn over): those
    with the least sum of squared margins, the unchanged one first."""
    bits = dots.shape[-1]
    m = min(FLIPPED, bits)
    margin = dots * dots
    near = np.argsort(margin, axis=-1, kind="stable")[..., :m]
    sets = np.arange(1 << m)
    cost = np.take_along_axis(margin, near, axis=-1) @ ((sets[None, :] >> np.arange(m)[:, None]) & 1).astype(float)
    chosen = np.argsort(cost, axis=-1, kind="stable")[..., :probes]
    turned = (chosen[..., None] >> np.arange(m)) & 1
    return (turned * (np.int64(1) << near[..., None, :])).sum(axis=-1)


@lru_cache(maxsize=256)
def _met_in_a_table(threshold: float, bits: int, probes: int, pairs: int = 4000) -> float:
    """Lower bound (three standard errors) of the probability that of a pair with a cosine of ``threshold`` one looks
    into the other's bucket of a table, from simulated pairs."""
    rng = np.random.default_rng(bits * 1000 + probes)
    x = rng.standard_normal((pairs, bits))
    y = threshold * x + math.sqrt(max(1 - threshold * threshold, 0.0)) * rng.standard_normal((pairs, bits))
    weight = np.int64(1) << np.arange(bits, dtype=np.int64)
    apart = ((x > 0) != (y > 0)) @ weight
    met = (_probe_order(x, probes) == apart[:, None]).any(axis=1) | (_probe_order(y, probes) == apart[:, None]).any(axis=1)
    share = met.mean()
    return max(float(share - 3 * math.sqrt(max(share * (1 - share), 1 / pairs) / pairs)), 0.0)


def plan_probes(rows: int, threshold: float, miss: float = 1e-6, bucket_rows: int = 16) -> ProbePlan:
    """Bits, tables and probes, so that a pair at the threshold is missed with probability ``miss`` at most, with the
    least work for a row: its keys, and the unrelated rows that it meets under them (a key is written, shuffled and
    sorted, which costs as much as ``bucket_rows`` sketches compared).  The bits follow the number of rows, and are fewer for
    low thresholds, whose pairs agree in few signs.  The sketch's limit misses a tenth of ``miss``."""
    most = min(max(math.ceil(math.log2(max(rows, 1) / bucket_rows)), 4), 48)
    best = None
    for bits in sorted({most, most - 2, most - 4, most // 2, most // 4, 4}):
        for probes in (1, 2, 4, 8, 16, 32, 64, 128):
            if bits < 1 or probes > 1 << bits:
                continue
            met = _met_in_a_table(round(threshold, 6), bits, probes) if probes < 1 << bits else 1.0
            if met > 0:
                tables = 1 if met >= 1 else max(1, math.ceil(math.log(0.9 * miss) / math.log1p(-met)))
                work = tables * (1 + probes) + tables * probes * rows / (1 << bits) / bucket_rows
                best = min(x for x in (best, (work, bits, tables, probes)) if x)
    differ = math.acos(min(max(threshold, -1.0), 1.0)) / math.pi
    within, limit = 0.0, -1
    while within < 1 - miss / 10 and limit < SKETCH_BITS:
        limit += 1
        within += math.comb(SKETCH_BITS, limit) * differ ** limit * (1 - differ) ** (SKETCH_BITS - limit)
    return ProbePlan(*best[1:], limit)


def duplicate_pairs_lsh(
    records: DataFrame,
    threshold: float = 0.95,
    k: int = 5,
    *,
    seed: int = 17,
    miss: float = 1e-6,
    block_rows: int = 1024,
) -> DataFrame:
    """V6 at scale, same output and rule as :func:`duplicate_pairs`; a pair at the threshold is missed
    with probability ``miss`` (see :func:`plan_probes`), closer ones with less.

    1. Records with equal vectors form a copy group, found by their vectors' 128-bit hash; only its representative
       (lowest ``seq``) is hashed further, and each group keeps its ``k`` lowest ``seq`` (a WindowGroupLimit, so a huge
       copy group is cut map-side, never gathered).
    2. Every representative is stored in its own bucket of a few tables and looks into the buckets next to it, in the
       order of its margins to their planes.  Ids meet first: pairs whose sketches differ in too many bits go inside
       the join, and the vectors of the others are fetched once for each pair.
    3. A bucket of more than ``block_rows`` stored rows (a dense group, whose pairs are too many to list) is cut into
       blocks instead: its rows and those that look into it meet in cells of two blocks, and each cell returns the ``k``
       best partners of each representative.  As each partner stands for at least its own record, the ``k`` best records
       are among the ``k`` best partners' groups.
    4. The ``k`` best records are ranked once for each representative, by (score desc, seq asc), self
       included; all members of its group share them.
    The function is eager: intermediates are written to the shared checkpoint folder.
    """
    _check_threshold(threshold)
    spark = records.sparkSession
    nonzero = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + F.abs(x.cast("double"))) > 0
    base = records.select("seq", "vector", F.xxhash64("vector").alias("_h1"), F.xxhash64(F.lit(1), "vector").alias("_h2"),
                          F.size("vector").alias("_d"), nonzero.alias("_nz"))
    groups = checkpointed(base.groupBy("_h1", "_h2").agg(F.min("seq").alias("rep"), F.max("_d").alias("_d")))
    g_ = groups.select(F.col("_h1").alias("_g1"), F.col("_h2").alias("_g2"), "rep")
    member_rep = checkpointed(base.select("seq", "_h1", "_h2", "_nz").join(
        g_, (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2"))).select("seq", "rep", "_nz"))
    w_g = Window.partitionBy("rep").orderBy("seq")
    low_by_rep = member_rep.withColumn("_gr", F.row_number().over(w_g)).where(F.col("_gr") <= k).select(
        "rep", F.col("seq").alias("m"), "_nz")
    size = groups.agg(F.max("_d").alias("d"), F.count("*").alias("n")).first()
    dim = int(size["d"] or 0)
    if dim <= 0:
        return spark.createDataFrame([], "seq_a long, id_a string, seq_b long, id_b string, score double")
    plan = plan_probes(int(size["n"]), threshold, miss)
    keyed = checkpointed(_signed(records.select("seq", "vector").join(
        member_rep.where("seq = rep AND _nz").select(F.col("seq").alias("_s")), F.col("seq") == F.col("_s"), "left_semi"), dim, plan, seed))
    stored = keyed.select("rep", "s1", "s2", F.explode(F.transform("probes", lambda p: p[0])).alias("key"))
    sizes = stored.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > block_rows)
    large = checkpointed(sizes.select(F.col("key").alias("_large"), F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks")))
    looking = keyed.select("rep", "s1", "s2", F.explode(F.flatten("probes")).alias("key"))
    vectors = records.select(F.col("seq").alias("_s"), "vector")
    dense = large.count() > 0
    if dense:
        cells = _cells(stored, looking, large, block_rows)
        best = cells.join(vectors, F.col("rep") == F.col("_s")).groupBy("key", "i", "j").applyInPandas(
            _best_partners(dim, threshold, k), "r1 long, r2 long, score double")
        stored, looking = (x.join(large, F.col("key") == F.col("_large"), "left_anti") for x in (stored, looking))
    other = looking.select("key", F.col("rep").alias("r2"), F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    apart = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2")))
    met = (stored.join(other, "key").where((F.col("rep") != F.col("r2")) & (apart <= plan.sketch))
           .select(F.least("rep", "r2").alias("r1"), F.greatest("rep", "r2").alias("r2")).distinct())
    first = met.join(vectors.select(F.col("_s"), F.col("vector").alias("va")), F.col("r1") == F.col("_s")).drop("_s")
    both = first.join(vectors.select(F.col("_s"), F.col("vector").alias("vb")), F.col("r2") == F.col("_s")).select("r1", "r2", "va", "vb")
    found = both.mapInPandas(_pair_scores(dim, threshold), "r1 long, r2 long, score double")
    found = found.unionByName(found.select(F.col("r2").alias("r1"), F.col("r1").alias("r2"), "score"))
    if dense:
        found = found.unionByName(best).groupBy("r1", "r2").agg(F.max("score").alias("score"))
    w_r = Window.partitionBy("r1").orderBy(F.round("score", RANK_DECIMALS).desc(), "r2")
    best = checkpointed(found.withColumn("_rk", F.row_number().over(w_r)).where(F.col("_rk") <= k).drop("_rk"))
    near = best.join(low_by_rep.select(F.col("rep").alias("r2"), "m"), "r2").select(F.col("r1").alias("rep"), "m", "score")
    # exact copies (self included) score 1, zero vectors 0
    same = low_by_rep.select("rep", "m", F.when(F.col("_nz"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("score"))
    w = Window.partitionBy("rep").orderBy(F.round("score", RANK_DECIMALS).desc(), F.col("m"))
    lists = near.unionByName(same).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    nbrs = member_rep.select(F.col("seq").alias("qid"), "rep").join(lists, "rep").select(
        "qid", F.col("m").alias("seq"), "score", "rank")
    pairs = pairs_from_neighbors(nbrs, threshold)
    ids = records.select("seq", "id")
    return (
        pairs.join(ids.withColumnRenamed("seq", "seq_a").withColumnRenamed("id", "id_a"), "seq_a")
        .join(ids.withColumnRenamed("seq", "seq_b").withColumnRenamed("id", "id_b"), "seq_b")
        .select("seq_a", "id_a", "seq_b", "id_b", "score")
    )


def _signed(rows: DataFrame, dim: int, plan: ProbePlan, seed: int) -> DataFrame:
    """``(rep, s1, s2, probes)``: the sketch of each row, and for each table the keys of the buckets it looks into, its
    own first.  A key holds the table's number above the bucket's bits."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((dim, plan.tables * plan.bits))
    sketch = rng.standard_normal((dim, SKETCH_BITS))
    weights = np.int64(1) << np.arange(plan.bits, dtype=np.int64)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            for low in range(0, len(pdf), 1024):
                part = pdf.iloc[low:low + 1024]
                unit = stack_unit(part["vector"], dim)[0]
                dots = (unit @ planes).reshape(len(part), plan.tables, plan.bits)
                own = (dots > 0) @ weights | (np.arange(plan.tables, dtype=np.int64) << plan.bits)
                keys = own[:, :, None] ^ _probe_order(dots, plan.probes)
                words = np.packbits(unit @ sketch > 0, axis=1).view(np.int64)
                yield pd.DataFrame({"rep": part["seq"].to_numpy(), "s1": words[:, 0], "s2": words[:, 1],
                                    "probes": [[list(t) for t in r] for r in keys.tolist()]})

    return rows.mapInPandas(run, "rep long, s1 long, s2 long, probes array<array<long>>")


def _cells(stored: DataFrame, looking: DataFrame, large: DataFrame, block_rows: int) -> DataFrame:
    """``(rep, key, i, j, here)``: the rows of large buckets by cell; ``here`` marks those stored in block ``i``, the others
    look into it as block ``j``, cut by the same hash."""
    at = F.pmod(F.xxhash64("rep", "key"), F.col("_blocks")).cast("int")
    home = stored.join(large, F.col("key") == F.col("_large")).select("rep", "key", at.alias("i"), "_blocks")
    guest = looking.join(large, F.col("key") == F.col("_large")).select("rep", "key", at.alias("j"), "_blocks")
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return (home.select("rep", "key", "i", every.alias("j"), F.lit(True).alias("here"))
            .unionByName(guest.select("rep", "key", every.alias("i"), "j", F.lit(False).alias("here"))))


def _best_partners(dim: int, threshold: float, k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        here = pdf["here"].to_numpy()
        rep, unit = pdf["rep"].to_numpy(), stack_unit(pdf["vector"], dim)[0]
        x, y = np.flatnonzero(here), np.flatnonzero(~here)
        score = unit[x] @ unit[y].T
        a, b = np.nonzero((score >= threshold) & (rep[x][:, None] != rep[y][None, :]))
        value = score[a, b]
        a, b = rep[x[a]], rep[y[b]]
        out = pd.DataFrame({"r1": np.concatenate([a, b]), "r2": np.concatenate([b, a]), "score": np.concatenate([value, value])})
        out["_s"] = out["score"].round(RANK_DECIMALS)
        out = out.sort_values(["r1", "_s", "r2"], ascending=[True, False, True]).drop_duplicates(["r1", "r2"])
        return out.groupby("r1", sort=False).head(k)[["r1", "r2", "score"]]

    return run


def _pair_scores(dim: int, threshold: float):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                score = np.einsum("nd,nd->n", stack_unit(pdf["va"], dim)[0], stack_unit(pdf["vb"], dim)[0])
                near = score >= threshold
                yield pd.DataFrame({"r1": pdf["r1"][near], "r2": pdf["r2"][near], "score": score[near]})

    return run
