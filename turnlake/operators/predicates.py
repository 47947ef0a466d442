"""Record predicates.  All are plain Column expressions, so Catalyst pushes
the ones on stored columns (time, namespace) into the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_all_tags(tags: Sequence[str] | None, col: str = "tags") -> Column:
    """The record carries every given tag (case-sensitive, exact); no tags = true."""
    if not tags:
        return F.lit(True)
    cond = F.lit(True)
    for t in dict.fromkeys(tags):
        cond = cond & F.array_contains(F.col(col), F.lit(t))
    return cond


def in_time_range(after: int | None = None, before: int | None = None, col: str = "timestamp") -> Column:
    """``after <= ts < before``, either side optional."""
    cond = F.lit(True)
    if after is not None:
        cond = cond & (F.col(col) >= F.lit(int(after)))
    if before is not None:
        cond = cond & (F.col(col) < F.lit(int(before)))
    return cond


def id_prefix(prefix: str, col: str = "id") -> Column:
    """P3."""
    return F.col(col).startswith(F.lit(prefix))


def session_prefix(prefix: str | None, keep_legacy: bool = False) -> Column:
    """P4 on classified rows (columns role, session_id).

    ``keep_legacy=False`` (HTTP rule): claude rows need a session with the prefix, a user row
    without a session counts as ''.  ``keep_legacy=True`` (CLI rule): claude rows without a
    session are kept, user rows without a session and notes are dropped."""
    if prefix is None:
        return F.lit(True)
    p = F.lit(prefix)
    role, sid = F.col("role"), F.col("session_id")
    if keep_legacy:
        return (
            F.when(role == "user", F.coalesce(sid.startswith(p), F.lit(False)))
            .when(role == "claude", F.coalesce(sid.startswith(p), sid.isNull()))
            .otherwise(F.lit(False))
        )
    return (
        F.when(role == "user", F.coalesce(sid, F.lit("")).startswith(p))
        .when(role == "claude", F.coalesce(sid.startswith(p), F.lit(False)))
        .otherwise(F.lit(True))
    )


def role_is(role: str | None) -> Column:
    """P5: 'user' or 'claude'; any other value means no filter."""
    if role in ("user", "claude"):
        return F.col("role") == F.lit(role)
    return F.lit(True)


def min_score(threshold: float | None, col: str = "score") -> Column:
    """Inclusive minimum; ``None`` turns it off."""
    if threshold is None:
        return F.lit(True)
    return F.col(col) >= F.lit(float(threshold))


def hide_notes(show_notes: bool = False) -> Column:
    """P7."""
    return F.lit(True) if show_notes else (F.col("role") != F.lit("note"))
