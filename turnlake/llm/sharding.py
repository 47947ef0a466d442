"""Sharding by a permutation-filled lookup table.

Each shard orders the slots of a table of prime size by a permutation of its own (an offset and a
stride, both hashed from the shard's name).  The shards take turns in a fixed order; at its turn a
shard claims the first slot of its order that is still free, until the table is full.  A row is
placed by hashing its key to a slot: one lookup in a broadcast table.  Shards get equal shares
within one slot, and a shard that leaves or joins moves little besides its own share.

The table depends on the shard names alone and has ``slots`` rows, so its size is a parameter and
not the data's; it is filled on the driver.  The rows are placed by DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SLOTS = 1 << 21  # broadcast rows: about 32 MB


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def _hash(text: str) -> int:
    """The first 60 bits of MD5, which other engines have too."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], slots: int) -> list[int]:
    """For each slot the position in ``shards`` of the shard that owns it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and one at least")
    if not _prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    offset = [_hash(f"{name}/offset") % slots for name in shards]
    stride = [_hash(f"{name}/stride") % (slots - 1) + 1 for name in shards]
    owner, turn = [-1] * slots, 0
    at = list(offset)
    for turn in range(slots):
        shard = turn % len(shards)
        while owner[at[shard]] >= 0:
            at[shard] = (at[shard] + stride[shard]) % slots
        owner[at[shard]] = shard
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo ``slots``; a null key
    is placed as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], slots: int = 4099) -> DataFrame:
    """``rows`` with columns ``slot`` and ``shard`` (replacing columns of these names).

    Equal keys, null ones too, go to one shard; repeated rows stay; other columns, whatever they are called,
    come through as they are.  An empty table gives an empty one.
    To spread the rows of a key that holds much of the table, key on the row's own id.
    """
    spark: SparkSession = rows.sparkSession
    owners = spark.createDataFrame(list(enumerate(shards[k] for k in fill_table(shards, slots))),
                                   "owned int, shard string")
    others = [c for c in rows.columns if c not in ("slot", "shard")]
    slotted = rows.select(F.struct(*others).alias("row"), slot_of(rows[key], slots).alias("slot"))
    joined = slotted.join(F.broadcast(owners), F.col("slot") == F.col("owned"))
    return joined.select(*[F.col("row").getField(c).alias(c) for c in others], "slot", "shard")


def placement_sql(source: str, key: str, shards: list[str], slots: int) -> str:
    """DuckDB SQL of :func:`place` with the turns played by a recursive query."""
    names = ", ".join(f"'{s}'" for s in shards)
    n = len(shards)
    return f"""
WITH RECURSIVE shard AS (
  SELECT generate_subscripts([{names}], 1) - 1 AS k, unnest([{names}]) AS name),
walk AS (
  SELECT list(('0x' || substr(md5(name || '/offset'), 1, 15))::BIGINT % {slots} ORDER BY k) AS first,
         list(('0x' || substr(md5(name || '/stride'), 1, 15))::BIGINT % {slots - 1} + 1 ORDER BY k) AS stride
  FROM shard),
play AS (
  SELECT 0 AS turn, -1::BIGINT AS claimed, repeat('0', {slots})::BIT AS taken
  UNION ALL
  SELECT turn + 1, free, set_bit(taken, free::INTEGER, 1)
  FROM (SELECT turn, taken, list_filter(
          list_transform(range({slots}), lambda j: (first[turn % {n} + 1] + j * stride[turn % {n} + 1]) % {slots}),
          lambda s: get_bit(taken, s::INTEGER) = 0)[1] AS free
        FROM play, walk WHERE turn < {slots}))
SELECT d.{key}, p.claimed::INTEGER AS slot, s.name AS shard
FROM (SELECT {key}, ('0x' || substr(md5(coalesce({key}::VARCHAR, '')), 1, 15))::BIGINT % {slots} AS place
      FROM {source}) d
JOIN play p ON p.claimed = d.place JOIN shard s ON s.k = (p.turn - 1) % {n}"""
