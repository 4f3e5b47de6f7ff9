"""Daily summaries of the metrics table, from which catalogs are read without its history.

Two tables by ``dt``: ``senders`` has one row per metric and service of a day (least type, samples, newest time), and
``filters`` one per value that a metric can be filtered by. Rows of different days merge by sum, least and greatest, so
an append or a sweep has just its own days summed up again. A day is replaced whole: doing it again changes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.plans.catalog import LABEL_KEY, opened
from logloom.session import delete_path, folders
from logloom.sources.files import read_metrics

SENDERS = "dt date, name string, service string, type int, points bigint, last_seen bigint"
FILTERS = "dt date, name string, pos int, key string, value string, points bigint"


def senders_of(metrics: DataFrame) -> DataFrame:
    """One row per day, metric and service."""
    return metrics.groupBy("dt", "name", "service").agg(
        F.min("type").alias("type"), F.count("*").alias("points"), F.max("timestamp").alias("last_seen"))


def filters_of(metrics: DataFrame) -> DataFrame:
    """One row per day, metric, key and value. ``pos`` is 0 for service, 1 for host and 2 for a label, so that a label
    named like one of the columns stays a label; a label without text has a null value. Label sets are counted before
    they are taken apart."""
    sets = metrics.groupBy("dt", "name", "service", "host", "labels").agg(F.count("*").alias("points"))
    label = F.expr("coalesce(transform(json_object_keys(labels), k -> struct(2 as pos, k as key,"
                   " get_json_object(labels, concat('$[\\'', k, '\\']')) as value)),"
                   " cast(array() as array<struct<pos: int, key: string, value: string>>))")
    fixed = F.expr("array(struct(0 as pos, 'service' as key, service as value), struct(1 as pos, 'host' as key, host as value))")
    each = sets.select("dt", "name", "points", F.explode(F.concat(fixed, label)).alias("f"))
    return each.groupBy("dt", "name", "f.pos", "f.key", "f.value").agg(F.sum("points").alias("points"))


def senders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SENDERS).parquet(f"{path}/senders")


def filters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILTERS).parquet(f"{path}/filters")


def changed_days(spark: SparkSession, metrics_path: str, path: str) -> list[dt.date]:
    """The days whose number of samples is not the summed-up one. Counting reads Parquet footers, no columns."""
    stored = read_metrics(spark, metrics_path).groupBy("dt").agg(F.count("*").alias("n"))
    if not folders(spark, f"{path}/senders", "dt"):
        return sorted(r.dt for r in stored.collect())
    known = senders(spark, path).groupBy("dt").agg(F.sum("points").alias("known"))
    return sorted(r.dt for r in stored.join(known, "dt", "full").filter("not (n <=> known)").select("dt").collect())


def follow(spark: SparkSession, metrics_path: str, path: str, days: Iterable[dt.date] = ()) -> list[dt.date]:
    """Brings the summaries below ``path`` up to date and returns the days that were summed up again.

    For after each append and each sweep. Days are found by their number of samples; where rows may have been exchanged
    for as many others, name those days too. Only these days of the metrics are read. A run that was cut short is
    mended by the next: senders, by which days are judged, are written last.
    """
    days = sorted({*changed_days(spark, metrics_path, path), *days})
    if not days:
        return days
    rows = read_metrics(spark, metrics_path).filter(F.col("dt").isin(days))
    held = folders(spark, metrics_path, "dt")
    for name, made in (("filters", filters_of(rows)), ("senders", senders_of(rows))):
        made = made.repartition("dt", "name").sortWithinPartitions("dt", "name")
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(f"{path}/{name}")
        for day, folder in folders(spark, f"{path}/{name}", "dt").items():
            if day not in held:
                delete_path(spark, folder)  # an overwrite leaves days alone that have no rows any more
    return days


def metrics_catalog(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``catalog.metrics_catalog`` from the summaries."""
    rows = senders(spark, path).groupBy("name", "service").agg(
        F.min("type").alias("t"), F.sum("points").alias("points"), F.max("last_seen").alias("last_seen"))
    return opened(rows, limit)


def metric_names(spark: SparkSession, path: str) -> DataFrame:
    return senders(spark, path).select("name").distinct().orderBy("name")


def filter_keys(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """``catalog.filter_keys`` from the summaries: service and host always, then label keys by name."""
    fixed = spark.sql("select * from values ('service', 0), ('host', 1) as f(key, pos)")
    labels = filters(spark, path).filter((F.col("name") == metric) & (F.col("pos") == 2)).select("key", "pos").distinct()
    return fixed.unionAll(labels).orderBy("pos", "key")


def filter_values(spark: SparkSession, path: str, metric: str, key: str) -> DataFrame:
    """``catalog.filter_values`` from the summaries."""
    if not LABEL_KEY.fullmatch(key):
        raise ValueError(f"bad label key {key!r}")
    pos = {"service": 0, "host": 1}.get(key, 2)
    rows = filters(spark, path).filter((F.col("name") == metric) & (F.col("pos") == pos) & (F.col("key") == key))
    return rows.filter("value != ''").select(F.col("value").alias("v")).distinct().orderBy("v")
