"""Catalog queries over the metrics table: what exists, who reports it, how fresh it is.

Each is one partial aggregation; only (name, service)-sized groups are shuffled.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.timeexpr import newer_than
from logloom.operators.paging import newest_days
from logloom.operators.series import suggested_query
from logloom.schemas import DAY_MS, GAUGE

# Fixed value: the label keys that may be asked for. Lists are complete unless a ``limit`` is given.
LABEL_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def metrics_catalog(metrics: DataFrame, limit: int | None = None) -> DataFrame:
    """Metrics per service, newest first, with the verb each would open with."""
    rows = (metrics.groupBy("name", "service")
            .agg(F.min("type").alias("t"), F.count("*").alias("points"), F.max("timestamp").alias("last_seen")))
    return opened(rows, limit)


def opened(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of (name, service, t, points, last_seen), newest first, with the verb each would open with."""
    rows = _first(rows.orderBy(F.desc("last_seen"), "name", "service"), limit)
    return rows.select(
        "name", F.when(F.col("t") == GAUGE, "gauge").otherwise("counter").alias("type"),
        "service", "points", "last_seen", suggested_query(F.col("name"), F.col("t")).alias("suggested"))


def service_metrics(metrics: DataFrame, service: str, limit: int | None = None) -> DataFrame:
    """What one service reports."""
    rows = (metrics.filter(F.col("service") == service).groupBy("name")
            .agg(F.count("*").alias("points"), F.max("timestamp").alias("last_seen"))
            .orderBy(F.desc("last_seen"), "name"))
    return _first(rows, limit)


def top_metrics(metrics: DataFrame, limit: int = 20) -> DataFrame:
    """The metrics with the most samples."""
    return (metrics.groupBy("name").agg(F.count("*").alias("datapoints"))
            .orderBy(F.desc("datapoints"), "name").limit(limit))


def metric_names(metrics: DataFrame, limit: int | None = None) -> DataFrame:
    return _first(metrics.select("name").distinct().orderBy("name"), limit)


def filter_keys(metrics: DataFrame, metric: str) -> DataFrame:
    """What a metric can be filtered by: service, host, then its label keys in order of name.

    Reads every distinct label set of the metric; ``pos`` keeps the two columns in front.
    """
    labels = (metrics.filter((F.col("name") == metric) & F.col("labels").isNotNull())
              .select(F.explode(F.json_object_keys("labels")).alias("key")).distinct()
              .select("key", F.lit(2).alias("pos")))
    fixed = metrics.sparkSession.range(2).select(
        F.element_at(F.array(F.lit("service"), F.lit("host")), F.col("id").cast("int") + 1).alias("key"),
        F.col("id").cast("int").alias("pos"))
    return fixed.unionAll(labels).orderBy("pos", "key")


def filter_values(metrics: DataFrame, metric: str, key: str, limit: int | None = None) -> DataFrame:
    """The values that exist for one filter key."""
    rows = metrics.filter(F.col("name") == metric)
    if key in ("service", "host"):
        v = F.col(key)
    elif LABEL_KEY.fullmatch(key):
        v = F.get_json_object("labels", f"$['{key}']")
    else:
        raise ValueError(f"bad label key {key!r}")
    values = rows.select(v.alias("v")).filter(F.col("v").isNotNull() & (F.col("v") != "")).distinct().orderBy("v")
    return _first(values, limit)


def services_seen(rows: DataFrame, as_of: int, count_name: str = "points", limit: int | None = None) -> DataFrame:
    """Services heard from in the last seven days, newest first (logs or metrics)."""
    seen = (newer_than(rows, as_of - 7 * DAY_MS).groupBy("service")
            .agg(F.max("timestamp").alias("last_seen"), F.count("*").alias(count_name))
            .orderBy(F.desc("last_seen"), "service"))
    return _first(seen, limit)


def ingest_health(metrics: DataFrame, as_of: int, days: Sequence[dt.date] | None = None) -> DataFrame:
    """Newest sample time and the number of samples of the last day.

    The count reads the last day. With ``days``, the stored days of the table, the newest time is read from the
    newest of them, and from all history otherwise.
    """
    none = F.lit(None).cast("long")
    count = newer_than(metrics, as_of - DAY_MS).agg(F.count("*").alias("points_24h")).select(none.alias("last_seen"), "points_24h")
    last = newest_days(metrics, 1, days).agg(F.max("timestamp").alias("last_seen")).select("last_seen", none.alias("points_24h"))
    return count.unionAll(last).agg(F.max("last_seen").alias("last_seen"), F.max("points_24h").alias("points_24h"))


def failing_sources(targets: DataFrame, limit: int = 5) -> DataFrame:
    """The sources that failed most recently."""
    return (targets.filter(F.col("enabled") & F.col("last_error").isNotNull())
            .orderBy(F.desc("last_error_at"), "service", "host").limit(limit)
            .select("service", "host", "last_error"))
