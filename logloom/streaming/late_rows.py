"""Event-time buckets that late rows repair.

A watermark closes a bucket and drops what comes later. Here every row is stored; a bucket is computed once, from
the stored rows, when the newest event time has passed its end by the lateness. Rows that arrive for a closed bucket
are written to a side table, and just the (bucket, keys) cells they touch are computed again. So the cells do not
depend on the order of arrival, and aggregates need not be mergeable.

Below one folder: ``rows`` by (dt, batch), ``late`` and ``cells`` by batch. A batch that runs again replaces its own
parts. How far buckets are closed is read off the stored rows of the other batches, so no note or state can be lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.timeexpr import event_date, utc_date
from logloom.functions.values import clamp_time
from logloom.session import folders, stored_days
from logloom.streaming.live import batch_name, replace_batch

SIDES = ("rows", "late", "cells")


def _table(spark: SparkSession, path: str, side: str) -> DataFrame | None:
    root = f"{path.rstrip('/')}/{side}"
    return spark.read.parquet(root) if folders(spark, root, "dt" if side == "rows" else "batch") else None


def _start(ts: Column, width: int) -> Column:
    return ts - F.pmod(ts, F.lit(width).cast("long"))


def _between(rows: DataFrame, low: int | None, high: int) -> DataFrame:
    """Rows in [low, high), with their dates, so that other days are not opened."""
    inside = (F.col("timestamp") < high) & (F.col("dt") <= F.lit(utc_date(high)))
    if low is not None:
        inside = inside & (F.col("timestamp") >= low) & (F.col("dt") >= F.lit(utc_date(low)))
    return rows.filter(inside)


def _computed(rows: DataFrame, width: int, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return rows.groupBy(_start(F.col("timestamp"), width).alias("bucket"), *keys).agg(F.count("*").alias("n_rows"), *aggs)


def closed_before(spark: SparkSession, path: str, width: int, lateness: int, without: str | None = None) -> int | None:
    """The end of the last closed bucket, as the stored rows of all batches (but ``without``) tell; None if there are none.

    Days are tried from the newest on, and the first that holds another batch's row decides.
    """
    rows = _table(spark, path, "rows")
    for day in stored_days(spark, f"{path.rstrip('/')}/rows") if rows is not None else []:
        there = rows.filter(F.col("dt") == F.lit(day))
        if without is not None:
            there = there.filter(F.col("batch") != without)
        newest = there.agg(F.max("timestamp")).first()[0]
        if newest is not None:
            return (newest - lateness) // width * width
    return None


def _touched(stored: DataFrame, late: DataFrame, closed: int, width: int, keys: Sequence[str]) -> DataFrame | None:
    """The stored rows of the cells that late rows fall in."""
    oldest = late.agg(F.min("timestamp")).first()[0]
    if oldest is None:
        return None
    names = [f"_at{i}" for i in range(len(keys) + 1)]
    at = [_start(F.col("timestamp"), width), *[F.col(k) for k in keys]]
    cells = late.select(*[c.alias(n) for c, n in zip(at, names)]).distinct()
    same = reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(n)) for c, n in zip(at, names)])
    return _between(stored, oldest // width * width, closed).join(cells, same, "left_semi")


def follow(path: str, width: int, keys: Sequence[str], aggs: Sequence[Column], lateness: int,
           received: str | None = None, run: str | None = None) -> Callable[[DataFrame, int], None]:
    """Batch sink that stores rows and keeps the cells of closed buckets right. Times are milliseconds.

    Times are clamped by ``received`` first, if given, so that one absurd time closes nothing. Rows without a time are
    stored and lie in no bucket; a null key is a key; repeated rows count as often as they come, an empty batch changes
    nothing. ``keys`` and ``aggs`` may name any column.
    """
    root = path.rstrip("/")

    def each(df: DataFrame, batch_id: int) -> None:
        spark, name = df.sparkSession, batch_name(df, batch_id, run)
        ts = F.col("timestamp") if received is None else clamp_time(F.col("timestamp"), F.col(received))
        rows = df.withColumn("timestamp", ts).withColumns({"dt": event_date("timestamp"), "batch": F.lit(name)})
        replace_batch(rows, f"{root}/rows", ["dt", "batch"])
        stored = _table(spark, path, "rows")
        if stored is None:
            return
        before = closed_before(spark, path, width, lateness, without=name)
        after = closed_before(spark, path, width, lateness)
        if after is None:
            return
        fresh = _computed(_between(stored, before, after), width, keys, aggs)
        if before is not None:
            late = _between(stored.filter(F.col("batch") == name), None, before)
            replace_batch(late, f"{root}/late", ["batch"])
            again = _touched(stored, late, before, width, keys)
            if again is not None:
                fresh = fresh.unionByName(_computed(again, width, keys, aggs))
        replace_batch(fresh.withColumn("batch", F.lit(name)), f"{root}/cells", ["batch"])
    return each


def cells(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    """The cells of closed buckets as they are now; None before the first bucket is closed.

    A cell that was computed again has more rows than before, so the newest is the one with the most.
    """
    every = _table(spark, path, "cells")
    if every is None:
        return None
    values = [c for c in every.columns if c not in ("bucket", "batch", *keys)]
    newest = every.groupBy("bucket", *keys).agg(F.max_by(F.struct(*values), "n_rows").alias("_cell"))
    return newest.select("bucket", *keys, "_cell.*")


def open_cells(spark: SparkSession, path: str, width: int, keys: Sequence[str], aggs: Sequence[Column],
               lateness: int) -> DataFrame | None:
    """The cells of buckets that are not closed yet, as far as their rows have come."""
    rows, closed = _table(spark, path, "rows"), closed_before(spark, path, width, lateness)
    if rows is None or closed is None:
        return None
    recent = rows.filter((F.col("timestamp") >= closed) & (F.col("dt") >= F.lit(utc_date(closed))))
    return _computed(recent, width, keys, aggs)


def late_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows that came after their bucket was closed, with the batch that brought them."""
    return _table(spark, path, "late")
