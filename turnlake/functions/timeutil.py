"""Time functions.  Both are independent of the session time zone."""

from __future__ import annotations

import datetime as _dt
import re as _re

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def parse_date(s: str | int) -> int:
    """C9 for an argument: integer text = Unix seconds, else Y-M-D at 00:00 UTC.

    Raises ValueError before the epoch, for negatives and for malformed or impossible dates
    (the reference rolls impossible days over; we reject them)."""
    if isinstance(s, int):
        if s < 0:
            raise ValueError(f"negative timestamp: {s}")
        return s
    text = str(s).strip()
    if _re.fullmatch(r"\+?\d+", text):
        return int(text)
    m = _re.fullmatch(r"([+-]?\d+)-([+-]?\d+)-([+-]?\d+)", text)
    if not m:
        raise ValueError(f"neither a day like 2024-01-31 nor seconds: {s}")
    y, mo, d = (int(g) for g in m.groups())
    day = _dt.date(y, mo, d)
    days = (day - _dt.date(1970, 1, 1)).days
    if days < 0:
        raise ValueError(f"days start at 1970-01-01, got {s}")
    return days * 86400


def parse_date_col(col: Column | str) -> Column:
    """C9 as a column: NULL where the text is neither seconds nor a valid date on/after 1970."""
    c = F.col(col) if isinstance(col, str) else col
    as_num = F.try_to_number(F.regexp_replace(c, r"^\+", ""), F.lit("9" * 19)).cast("bigint")
    as_date = F.unix_date(F.try_to_date(c, "y-M-d")).cast("bigint") * 86400
    value = F.when(c.rlike(r"^\+?[0-9]+$"), as_num).otherwise(as_date)
    return F.when(value >= 0, value)


def ts_ntz(col: Column | str) -> Column:
    """Unix seconds -> TIMESTAMP_NTZ wall clock in UTC (no session zone involved)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_add("SECOND", c, F.expr(_EPOCH_NTZ))


def format_ts(col: Column | str) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in UTC."""
    return F.date_format(ts_ntz(col), "yyyy-MM-dd HH:mm:ss")
