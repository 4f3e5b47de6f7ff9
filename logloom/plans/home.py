"""The fixed overview queries over logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.timeexpr import bucket, newer_than
from logloom.operators.shape import gap_fill, grid_bounds
from logloom.operators.paging import keyset_page
from logloom.plans.catalog import services_seen
from logloom.schemas import DAY_MS, ERROR, HOUR_MS, MINUTE_MS

VOLUME_BUCKET_MS = 5 * MINUTE_MS
#: Fixed value: a non-empty bar is at least this share of the tallest.
MIN_BAR_PERCENT = 4.0


def volume(logs: DataFrame, as_of: int, span_ms: int = HOUR_MS) -> DataFrame:
    """Lines per five minutes up to now, empty buckets included."""
    counted = (newer_than(logs, as_of - span_ms)
               .groupBy(bucket("timestamp", VOLUME_BUCKET_MS).alias("bucket"))
               .agg(F.count("*").alias("lines")))
    start, end = grid_bounds(as_of - span_ms, as_of, VOLUME_BUCKET_MS)
    return gap_fill(counted, start_ms=start, end_ms=end, bucket_ms=VOLUME_BUCKET_MS, zero=True)


def volume_bars(points: DataFrame) -> DataFrame:
    """Total, maximum and bar height in percent beside each bucket (a grid of known size)."""
    grid = Window.partitionBy(F.lit(1))
    points = (points.withColumn("total", F.sum("lines").over(grid))
              .withColumn("max_lines", F.max("lines").over(grid)))
    share = F.try_divide(F.col("lines") * F.lit(100.0), F.col("max_lines"))
    height = F.when((F.col("lines") == 0) | (F.col("max_lines") == 0), F.lit(0.0)).otherwise(
        F.greatest(share, F.lit(MIN_BAR_PERCENT)))
    return points.withColumn("height_pct", F.round(height, 0))


def errors_by_service(logs: DataFrame, as_of: int, limit: int = 10) -> DataFrame:
    """The services with the most errors of the last day."""
    return (newer_than(logs, as_of - DAY_MS).filter(F.col("level") >= ERROR)
            .groupBy("service").agg(F.count("*").alias("cnt"))
            .orderBy(F.desc("cnt"), "service").limit(limit))


def log_services_seen(logs: DataFrame, as_of: int) -> DataFrame:
    return services_seen(logs, as_of, "lines")


def errors_per_bucket(logs: DataFrame, as_of: int, bucket_ms: int = 10 * MINUTE_MS) -> DataFrame:
    return (newer_than(logs, as_of - DAY_MS).filter(F.col("level") >= ERROR)
            .groupBy(bucket("timestamp", bucket_ms).alias("bucket")).agg(F.count("*").alias("errors"))
            .orderBy("bucket"))


def errors_vs_total(logs: DataFrame, as_of: int) -> DataFrame:
    return (newer_than(logs, as_of - DAY_MS).groupBy("service")
            .agg(F.count_if(F.col("level") >= ERROR).alias("errors"), F.count("*").alias("total"))
            .orderBy(F.desc("errors"), "service"))


def json_field(logs: DataFrame, field: str, limit: int = 100) -> DataFrame:
    """One field of the newest structured lines, as text."""
    newest = keyset_page(logs.filter(F.col("parsed").isNotNull()), size=limit)
    return newest.select("id", "timestamp", F.get_json_object("parsed", f"$.{field}").alias("field"), "message")
