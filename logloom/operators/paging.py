"""Keyset paging through history, in event time with arrival order as tie-break."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.timeexpr import utc_date

PAGE_SIZE = 50


def keyset_page(logs: DataFrame, before: tuple[int, int] | None = None, size: int = PAGE_SIZE,
                days: Sequence[dt.date] | None = None) -> DataFrame:
    """The newest ``size`` lines before a (timestamp, id) cursor; an empty page is the start of history.

    With ``days``, the stored days of the table, only the newest that fill the page are read.

    Planned as a top-k, so each task keeps ``size`` rows and nothing is sorted globally.
    """
    if size <= 0:
        raise ValueError(f"page size {size} out of range")
    if before:
        ts, log_id = before
        cond = (F.col("timestamp") < ts) | ((F.col("timestamp") == ts) & (F.col("id") < log_id))
        if "dt" in logs.columns:
            cond = (F.col("dt") <= F.lit(utc_date(ts))) & cond
        logs = logs.filter(cond)
    return newest_days(logs, size, days).orderBy(F.desc("timestamp"), F.desc("id")).limit(size)


def newest_days(rows: DataFrame, wanted: int, days: Sequence[dt.date] | None) -> DataFrame:
    """The rows of the newest days that together hold ``wanted`` rows, or all rows if there are fewer.

    ``days`` are the ``dt`` values that exist. They are walked newest first, twice as many at each step; the answer
    is a lower bound on ``dt``, which prunes. Without ``days`` all rows stay.
    """
    days = sorted(days or [], reverse=True)
    step = 1
    while step < len(days):
        some = rows.filter(F.col("dt") >= F.lit(days[step - 1]))
        if some.limit(wanted).count() >= wanted:
            return some
        step *= 2
    return rows


def viewer_rows(page: DataFrame) -> DataFrame:
    """A page as displayed: oldest first, the raw line where there is no message."""
    return (page.select("id", "timestamp", "level", "service", "host",
                        F.coalesce("message", "raw").alias("message"), "raw")
            .orderBy("timestamp", "id"))


def recent(logs: DataFrame, n: int = 1000) -> DataFrame:
    """The last ``n`` lines by arrival, oldest first. Arrival may differ from event time, so no day is left out."""
    return logs.orderBy(F.desc("id")).limit(n).orderBy("id")
