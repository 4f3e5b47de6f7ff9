"""Column helpers for millisecond event time: buckets, windows, durations."""

from __future__ import annotations

import datetime as dt
import re
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.schemas import DAY_MS, HOUR_MS, MINUTE_MS

_UNITS = {"m": MINUTE_MS, "h": HOUR_MS, "d": DAY_MS}


def duration_ms(text: str) -> int:
    """``5m`` / ``1h`` / ``2d`` in milliseconds; zero and other units are refused."""
    m = re.fullmatch(r"(\d+)([mhd])", text)
    if not m:
        raise ValueError(f"bad duration {text!r}: use forms like 5m, 1h, 2d")
    n = int(m.group(1))
    if n == 0:
        raise ValueError("duration can't be zero")
    return n * _UNITS[m.group(2)]


def now_ms() -> int:
    return int(time.time() * 1000)


def utc_date(ms: int) -> dt.date:
    return (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)).date()


def bucket(ts: Column | str, bucket_ms: int) -> Column:
    """Start of the integer bucket a millisecond time falls in (truncating toward zero)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    width = F.lit(bucket_ms).cast("long")
    return F.call_function("div", col, width) * width


def event_date(ts: Column | str) -> Column:
    """UTC date of a millisecond time, the partition column of the stored tables."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.date_add(F.lit(dt.date(1970, 1, 1)), F.floor(col / F.lit(DAY_MS)).cast("int"))


def newer_condition(columns: Sequence[str], cutoff_ms: int, ts: str = "timestamp") -> Column:
    """Strictly after ``cutoff_ms``; with the date too where ``dt`` is among the columns."""
    cond = F.col(ts) > F.lit(cutoff_ms).cast("long")
    return (F.col("dt") >= F.lit(utc_date(cutoff_ms))) & cond if "dt" in columns else cond


def newer_than(df: DataFrame, cutoff_ms: int, ts: str = "timestamp") -> DataFrame:
    """Rows strictly after ``cutoff_ms``, with no upper bound; prunes ``dt`` partitions when there are any."""
    return df.filter(newer_condition(df.columns, cutoff_ms, ts))


def between_condition(columns: Sequence[str], from_ms: int, to_ms: int, ts: str = "timestamp") -> Column:
    """In the inclusive window; with the date too where ``dt`` is among the columns."""
    cond = F.col(ts).between(F.lit(from_ms).cast("long"), F.lit(to_ms).cast("long"))
    return F.col("dt").between(F.lit(utc_date(from_ms)), F.lit(utc_date(to_ms))) & cond if "dt" in columns else cond


def between(df: DataFrame, from_ms: int, to_ms: int, ts: str = "timestamp") -> DataFrame:
    """Rows in the inclusive window, pruning ``dt`` partitions when there are any."""
    return df.filter(between_condition(df.columns, from_ms, to_ms, ts))
