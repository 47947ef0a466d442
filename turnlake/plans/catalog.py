"""Registry of named queries: each is a Spark callable ``(spark, sf_dir) -> DataFrame`` over the
driver tables (or tables Spark derives from them), plus, where SQL can express it, the DuckDB
oracle that must return the same rows.  Output columns are scalar (arrays joined to text,
scores rounded to 6 decimals, integers as BIGINT) so that the two engines compare exactly."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    fn: QueryFn
    oracle: str | None
    doc: str


REGISTRY: dict[str, Entry] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query name {name}")
        REGISTRY[name] = Entry(fn, oracle, (fn.__doc__ or "").strip())
        return fn

    return deco


def queries() -> dict[str, QueryFn]:
    _load()
    return {k: v.fn for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v.oracle for k, v in REGISTRY.items() if v.oracle}


def _load() -> None:
    # importing the modules fills the registry
    from . import q_search, q_timeline, q_sources, q_vectors, q_rag, q_mutate, q_stream  # noqa: F401
