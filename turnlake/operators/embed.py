"""Embedding as a column.

``embed(df, 'text', embedder)`` runs an iterator ``pandas_udf``: the embedder (a batch
callable ``list[str] -> array (n, d)``) is created once per Python worker and fed Arrow
batches.  The shipped default is a deterministic feature-hashing embedder (signed token
counts, L2-normalised), since no model endpoint is reachable here; a real model is passed as
a factory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokenize, tokenize_py

EmbedderFactory = Callable[[], Callable[[list[str]], np.ndarray]]


def hashing_embedder(dim: int = 64, seed: int = 0) -> Callable[[list[str]], np.ndarray]:
    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for tok in tokenize_py(t or ""):
                h = xxhash.xxh64_intdigest(tok, seed=seed)
                out[i, h % dim] += 1.0 if (h >> 63) == 0 else -1.0
        n = np.linalg.norm(out, axis=1)
        nz = n > 0
        out[nz] /= n[nz, None]
        return out

    return run


_MODELS: dict = {}  # per Python worker process (workers are reused across tasks)


def _model(key, make):
    m = _MODELS.get(key)
    if m is None:
        m = _MODELS[key] = make()
    return m


def embed_column(text: Column | str, factory: EmbedderFactory | None = None, dim: int = 64,
                 model_key: str | None = None) -> Column:
    """``model_key`` names the factory's model; workers keep a model by it, so it is required with a factory."""
    if factory is not None and not model_key:
        raise ValueError("name the factory's model by model_key")
    make = factory or (lambda: hashing_embedder(dim))
    key = ("hashing", dim) if factory is None else ("factory", model_key)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(key, make)  # built once per Python worker, reused by later tasks
        for s in batches:
            m = model(s.fillna("").tolist())
            yield pd.Series(list(np.asarray(m, dtype=np.float32)))

    c = F.col(text) if isinstance(text, str) else text
    return _embed(c)


def embed(df: DataFrame, text: str = "text", out: str = "vector", factory: EmbedderFactory | None = None, dim: int = 64,
          model_key: str | None = None) -> DataFrame:
    """Adds ``out`` = embedding of ``text``."""
    return df.withColumn(out, embed_column(text, factory, dim, model_key))


def hash_embedding(df: DataFrame, key: str, text: str = "text", out: str = "vector", dim: int = 64) -> DataFrame:
    """E1 without a model: ``(key, out)``, signed token counts in ``dim`` buckets by MD5, scaled to length 1
    (all zeros without tokens).  ``key`` must be unique.  Tokens are counted before the shuffle, and a
    row of a vector is put together from ``dim`` counts at most."""
    digest = F.md5(F.col("_token").cast("binary"))
    sign = F.when(F.substring(digest, 9, 1) < "8", 1).otherwise(-1)
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    tokens = df.select(key, F.explode_outer(tokenize(F.coalesce(F.col(text), F.lit("")))).alias("_token"))
    counts = tokens.select(key, bucket.alias("_b"), sign.alias("_s")).groupBy(key, "_b").agg(F.sum("_s").alias("_x"))
    rows = counts.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_b", F.col("_x").cast("double"))))).alias("_m"),
        F.sqrt(F.sum(F.when(F.col("_b").isNotNull(), F.col("_x") * F.col("_x")).otherwise(0)).cast("double")).alias("_norm"))
    item = lambda i: F.when(F.col("_norm") > 0, F.coalesce(F.try_element_at("_m", i), F.lit(0.0)) / F.col("_norm")).otherwise(0.0)
    return rows.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), item).cast("array<float>").alias(out))
