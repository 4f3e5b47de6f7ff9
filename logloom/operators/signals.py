"""Correlating the two signals.

Joins meet on aggregated rows or unique keys, so a hot service adds one row per bucket
instead of pairing all its lines with all its samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.timeexpr import bucket
from logloom.schemas import ERROR


def log_buckets(logs: DataFrame, bucket_ms: int) -> DataFrame:
    return (logs.groupBy("service", bucket("timestamp", bucket_ms).alias("bucket"))
            .agg(F.count("*").alias("lines"), F.count_if(F.col("level") >= ERROR).alias("errors")))


def metric_buckets(metrics: DataFrame, metric: str, bucket_ms: int) -> DataFrame:
    return (metrics.filter(F.col("name") == metric)
            .groupBy("service", bucket("timestamp", bucket_ms).alias("bucket"))
            .agg(F.avg("value").alias("avg_value"), F.count("*").alias("samples")))


def correlate(logs: DataFrame, metrics: DataFrame, metric: str, bucket_ms: int, how: str = "inner") -> DataFrame:
    """Log volume and errors beside a metric, per service and bucket; ``how`` as in ``join``."""
    return log_buckets(logs, bucket_ms).join(metric_buckets(metrics, metric, bucket_ms),
                                             ["service", "bucket"], how)


def bursts(logs: DataFrame, bucket_ms: int, threshold: int) -> DataFrame:
    """Service and bucket where more than ``threshold`` errors were logged."""
    return log_buckets(logs, bucket_ms).filter(F.col("errors") > threshold).select("service", "bucket", "errors")


def around(left: DataFrame, right: DataFrame, bucket_ms: int, before: int, after: int) -> DataFrame:
    """Range join of two bucketed results: rows of ``right`` from ``before`` buckets ahead of a ``left`` row to
    ``after`` behind it, same service.

    Every left row is spread over the few buckets it reaches, which makes the range an equality.
    """
    start = F.col("bucket")
    reach = F.sequence(start - F.lit(before * bucket_ms), start + F.lit(after * bucket_ms), F.lit(bucket_ms).cast("long"))
    spread = left.withColumn("burst", start).withColumn("bucket", F.explode(reach))
    return spread.join(right, ["service", "bucket"])


def lines_with_sample(logs: DataFrame, metrics: DataFrame, metric: str) -> DataFrame:
    """Each line with the mean sample its own (service, host) reported at the same instant."""
    at = (metrics.filter(F.col("name") == metric).groupBy("service", "host", "timestamp")
          .agg(F.avg("value").alias("value")))
    return logs.join(at, ["service", "host", "timestamp"])


def services_where_both(logs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Services seen by both filtered inputs: the cross-signal rule condition."""
    return (logs.select("service").distinct()
            .join(metrics.select("service").distinct(), "service", "left_semi"))


def silent(expected: DataFrame, recent: DataFrame, key: str = "service") -> DataFrame:
    """Expected senders without recent rows."""
    return expected.select(key).distinct().join(recent.select(key).distinct(), key, "left_anti")


def latest_rows(rows: DataFrame, by: str = "service") -> DataFrame:
    """The row that arrived last for every key.

    The newest id per key is a hash aggregate over two narrow columns; the rows are then picked
    by that small result, so nothing wide is sorted or shuffled.
    """
    newest = rows.groupBy(by).agg(F.max("id").alias("id"))
    return rows.join(newest, [by, "id"], "left_semi").select(*rows.columns)


def _line_keys(logs: DataFrame, matches: DataFrame) -> list[str]:
    # with the date on both sides the hits prune the partitions of the table
    return [c for c in ("dt", "id") if c in logs.columns and c in matches.columns]


def both(logs: DataFrame, matches: DataFrame) -> DataFrame:
    """Lines in ``matches``; the columns stay those of ``logs``."""
    keys = _line_keys(logs, matches)
    return logs.join(matches.select(*keys), keys, "left_semi").select(*logs.columns)


def either(logs: DataFrame, matches: DataFrame, pred: Column) -> DataFrame:
    """Lines satisfying ``pred`` or in ``matches``: one scan, beside which the distinct hits are a flag."""
    keys = _line_keys(logs, matches)
    hits = matches.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return logs.join(hits, keys, "left").filter(pred | F.col("_hit")).select(*logs.columns)
