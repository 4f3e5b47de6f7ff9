"""Live views over unbounded logs.

The same functions that filter, parse and aggregate tables run on streams; this module adds
the sinks. A sink's checkpoint plays the part of a polling cursor. Micro-batches are written
under their batch id, so a batch that is run again replaces itself.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.functions.timeexpr import event_date
from logloom.functions.values import clamp_time
from logloom.operators import search
from logloom.operators.filters import LogFilter
from logloom.operators.retention import replace_day
from logloom.operators.sinks import with_ids
from logloom.schemas import LOG_COLUMNS, METRIC_COLUMNS
from logloom.session import delete_path, read_note, write_note

# How often the views refresh, and the size of the recent-lines ring.
TAIL_EVERY, REFRESH_EVERY = "1 second", "5 seconds"
RING = 1000


def strategy(flt: LogFilter | None, spec=None, aggregated: bool = False, set_operation: bool = False) -> str:
    """How a live view runs: every new line, new matching lines, or a refreshed aggregate."""
    if set_operation:
        raise ValueError("live tail is not supported for set operations")
    if aggregated:
        if spec is not None:
            raise ValueError("full-text search does not combine with aggregates")
        return "refresh"
    return "filtered" if spec is not None or (flt and not flt.is_empty) else "all"


def tail(stream: DataFrame, flt: LogFilter | None = None, spec=None, pred: Column | None = None,
         op: str = "and") -> DataFrame:
    """New lines that match: stateless, in append mode, nothing from before the query started.

    With ``op='or'`` a line needs to satisfy any of the filter, the predicate and the search that are given.
    """
    given = [] if flt is None or flt.is_empty else [flt.condition(stream.columns)]
    given += [] if pred is None else [pred]
    if op == "or":
        if spec is not None:
            return search.scan(stream, search.any_of(spec, *map(search.Where, given)) if given else spec)
        return stream.filter(reduce(or_, given)) if given else stream
    out = stream.filter(reduce(and_, given)) if given else stream
    return out if spec is None else search.scan(out, spec)


def tumbling(stream: DataFrame, width: str, keys: Sequence[str], aggs: Sequence[Column],
             lateness: str, received: str | None = None) -> DataFrame:
    """Event-time buckets of a stream. Times are clamped before the watermark, so one absurd
    time can't push it ahead; rows later than ``lateness`` are left to the stored table
    (``late_rows`` repairs buckets with them)."""
    ts = F.col("timestamp") if received is None else clamp_time(F.col("timestamp"), F.col(received))
    timed = stream.withColumn("_ts", F.timestamp_millis(ts)).withWatermark("_ts", lateness)
    out = timed.groupBy(F.window("_ts", width).alias("_w"), *keys).agg(*aggs)
    return out.select(F.unix_millis("_w.start").alias("bucket"), *[c for c in out.columns if c != "_w"])


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append",
        every: str | None = None) -> StreamingQuery:
    """Starts a query that hands each micro-batch to ``each``; without ``every`` it works off what there is and ends."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def run_of(df: DataFrame) -> str:
    """The streaming query a micro-batch belongs to, which lives as long as its checkpoint; ``direct`` outside of any."""
    return df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"


def replace_batch(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Writes a micro-batch over what it has written before, if it ran before; other batches stay."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partitions).parquet(path))


def batch_name(df: DataFrame, batch_id: int, run: str | None = None) -> str:
    """Names a micro-batch among all that were ever written: batch numbers start anew with a new checkpoint, runs do not."""
    return f"{run or run_of(df)}-{batch_id}"


def _store(path: str, columns: Sequence[str], run: str | None) -> Callable[[DataFrame, int], None]:
    def each(df: DataFrame, batch_id: int) -> None:
        own = run or run_of(df)
        with with_ids(df, path, own, batch_id) as rows:
            rows = rows.select(*columns, event_date("timestamp").alias("dt"), F.lit(batch_name(df, batch_id, own)).alias("batch"))
            replace_batch(rows, path, ["dt", "batch"])
    return each


def store_logs(path: str, run: str | None = None) -> Callable[[DataFrame, int], None]:
    """Batch sink of parsed lines: ids given, partitioned by date and batch. ``compact`` joins the batches of a past day."""
    return _store(path, LOG_COLUMNS, run)


def store_metrics(path: str, run: str | None = None) -> Callable[[DataFrame, int], None]:
    return _store(path, METRIC_COLUMNS, run)


def append_batches(path: str, run: str | None = None) -> Callable[[DataFrame, int], None]:
    """Batch sink of any append stream, one partition per batch."""
    def each(df: DataFrame, batch_id: int) -> None:
        replace_batch(df.withColumn("batch", F.lit(batch_name(df, batch_id, run))), path, ["batch"])
    return each


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Several sinks fed by one read of each micro-batch, in order: live views first, storage last."""
    def each(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            for sink in sinks:
                sink(df, batch_id)
        finally:
            df.unpersist()
    return each


def _version(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/v={name}"


def latest(spark: SparkSession, path: str, other_than: str | None = None) -> DataFrame | None:
    """The newest complete version of a refreshed result, or the one before it if the newest is ``other_than``."""
    note = read_note(spark, f"{path}/_versions") or {}
    name = note.get("current")
    if name is not None and name == other_than:
        name = note.get("previous")
    return spark.read.parquet(_version(path, name)) if name else None


def _publish(df: DataFrame, path: str, name: str) -> None:
    """Writes a version and makes it the newest. It and the one before it stay, whatever was there earlier goes."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(_version(path, name))
    note = read_note(spark, f"{path}/_versions") or {}
    if note.get("current") != name:
        write_note(spark, f"{path}/_versions", {"current": name, "previous": note.get("current")})
        if note.get("previous"):
            delete_path(spark, _version(path, note["previous"]))


def refresh(path: str, run: str | None = None) -> Callable[[DataFrame, int], None]:
    """Batch sink of a complete-mode aggregate: each batch writes the whole result anew."""
    def each(df: DataFrame, batch_id: int) -> None:
        _publish(df, path, batch_name(df, batch_id, run))
    return each


def ring(path: str, size: int = RING, by: str = "id", run: str | None = None) -> Callable[[DataFrame, int], None]:
    """Batch sink that keeps the last ``size`` lines by arrival."""
    def each(df: DataFrame, batch_id: int) -> None:
        name = batch_name(df, batch_id, run)
        before = latest(df.sparkSession, path, other_than=name)
        rows = df if before is None else df.unionByName(before)
        _publish(rows.orderBy(F.desc(by)).limit(size), path, name)
    return each


def compact(spark: SparkSession, path: str, day: dt.date) -> None:
    """Joins the batch folders of one past day into one; batches written meanwhile stay as they are."""
    replace_day(spark, path, day, lambda rows: rows.withColumn("batch", F.lit("compacted")), always=True)
