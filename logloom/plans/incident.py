"""The incident view: metrics and logs locked to one window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.timeexpr import between, bucket, duration_ms
from logloom.operators import paging, series, shape
from logloom.operators.filters import LogFilter
from logloom.schemas import ERROR, HOUR_MS, MINUTE_MS

# Fixed values of the view.
DEFAULT_SPAN_MS = HOUR_MS
MIN_SPAN_MS = MINUTE_MS


def resolve_window(from_ms: int, to_ms: int, now: int, follow: bool = False) -> tuple[int, int]:
    """The window to show: the last hour when missing or under a minute; follow moves it to end now."""
    span = to_ms - from_ms
    if from_ms <= 0 or to_ms <= 0 or span < MIN_SPAN_MS:
        span, from_ms, to_ms = DEFAULT_SPAN_MS, now - DEFAULT_SPAN_MS, now
    if follow:
        from_ms, to_ms = now - span, now
    return from_ms, to_ms


def mini_chart(logs: DataFrame, window: tuple[int, int]) -> DataFrame:
    """Lines and errors per adaptive bucket over the whole window, empty buckets as zero."""
    width = shape.adaptive_bucket_ms(window[1] - window[0])
    counted = (between(logs, *window).groupBy(bucket("timestamp", width).alias("bucket"))
               .agg(F.count("*").alias("lines"), F.count_if(F.col("level") >= ERROR).alias("errors")))
    start, end = shape.grid_bounds(*window, width)
    return shape.gap_fill(counted, start_ms=start, end_ms=end, bucket_ms=width, zero=True)


def mini_totals(logs: DataFrame, window: tuple[int, int]) -> DataFrame:
    return between(logs, *window).agg(F.count("*").alias("total"),
                                      F.count_if(F.col("level") >= ERROR).alias("errors"))


@dataclass(frozen=True)
class MetricRow:
    """One metric of the view, as the verb call it stands for."""

    verb: str
    metric: str
    per: str | None = None
    by_service: bool = False
    services: tuple[str, ...] | None = None


def metric_row(metrics: DataFrame, row: MetricRow, window: tuple[int, int]) -> DataFrame:
    df = series.verb(metrics, row.verb, row.metric, per=row.per, by_service=row.by_service,
                     services=row.services, window=window)
    if not row.per or row.verb == "latest":
        return df
    width = duration_ms(row.per)
    start, end = shape.grid_bounds(*window, width)
    return shape.gap_fill(df, start_ms=start, end_ms=end, bucket_ms=width, zero=series.fills_with_zero(row.verb))


def logs_pane(logs: DataFrame, flt: LogFilter, window: tuple[int, int], limit: int = 100) -> DataFrame:
    """The newest matching lines inside the window, displayed oldest first."""
    return paging.viewer_rows(paging.keyset_page(flt.within(*window).apply(logs), size=limit))


def view(logs: DataFrame, metrics: DataFrame, rows: Sequence[MetricRow], flt: LogFilter,
         window: tuple[int, int]) -> dict[str, DataFrame]:
    """Everything the view shows, each part under the same window."""
    out = {f"metric_{i}": metric_row(metrics, r, window) for i, r in enumerate(rows)}
    out["mini_chart"] = mini_chart(logs, window)
    out["logs"] = logs_pane(logs, flt, window)
    return out
