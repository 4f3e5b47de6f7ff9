"""The generated test tables seen as the two-table model.

Both views are plain projections of ``events``: no shuffle, and ``dt`` is a cast of the
stored timestamp, so a date predicate reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.schemas import COUNTER, GAUGE

#: One day after the last event date, so that "the last 24 h" is never empty.
AS_OF = 1706659200000

# ``ts`` has no zone and means UTC, whatever the session's zone is.
_MS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000"


#: Declared, so that reading a table costs no job to look at its files.
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", "user_id", "value", "props",
        F.expr(_MS).alias("timestamp"),
        F.expr("cast(ts as date)").alias("dt"),
        F.expr("concat('svc-', cast(user_id % 4 as string))").alias("service"),
        F.expr("concat('host-', cast(user_id % 3 as string))").alias("host"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        "timestamp",
        (F.col("timestamp") + 37).alias("ingested_at"),
        F.expr("CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2"
               " WHEN 'view' THEN 1 ELSE 0 END").alias("level"),
        "service", "host",
        F.expr("concat(event_type, ' by user ', cast(user_id as string))").alias("message"),
        F.col("props").alias("parsed"),
        F.expr("concat(event_type, ' by user ', cast(user_id as string), ' ', props)").alias("raw"),
        "dt")


def metrics(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """One gauge sample (``<type>_value``) and one counter sample (``<type>_total``) per event.

    The counter's value is the source's running event number at that moment, which never
    goes down in event time. ``only`` reads a single metric, with its event type pushed
    into the scan, as a table clustered by metric name would.
    """
    e = events(spark, sf_dir)
    gauge = counter = e
    if only:
        kind, _, suffix = only.rpartition("_")
        e = e.filter(F.col("event_type") == kind)
        gauge, counter = (e, None) if suffix == "value" else (None, e)

    def samples(src: DataFrame, id_expr: str, suffix: str, type_: int, value: str, labels: str) -> DataFrame:
        return src.select(
            F.expr(id_expr).alias("id"), "timestamp",
            F.concat("event_type", F.lit(suffix)).alias("name"),
            F.lit(type_).alias("type"),
            F.expr(value).cast("double").alias("value"),
            "service", "host", F.expr(labels).alias("labels"), "dt")

    parts = []
    if gauge is not None:
        parts.append(samples(gauge, "event_id * 2", "_value", GAUGE, "value",
                             "concat('{\"k\":\"', regexp_extract(props, '([0-9]+)', 1), '\"}')"))
    if counter is not None:
        parts.append(samples(counter, "event_id * 2 + 1", "_total", COUNTER, "event_id + 1", "cast(null as string)"))
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])


def search_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("raw"),
        F.col("source").alias("service"), F.col("lang").alias("host"))


# The same views for the SQL side of the checks.
_SQL_EVENTS = """ev AS (
  SELECT event_id, event_type, user_id, value, props, epoch_us(ts) // 1000 AS timestamp,
         concat('svc-', CAST(user_id % 4 AS VARCHAR)) AS service,
         concat('host-', CAST(user_id % 3 AS VARCHAR)) AS host
  FROM events)"""

SQL_LOGS = _SQL_EVENTS + """, logs AS (
  SELECT event_id AS id, timestamp, timestamp + 37 AS ingested_at,
         CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2
              WHEN 'view' THEN 1 ELSE 0 END AS level,
         service, host, concat(event_type, ' by user ', CAST(user_id AS VARCHAR)) AS message,
         props AS parsed, concat(event_type, ' by user ', CAST(user_id AS VARCHAR), ' ', props) AS raw
  FROM ev)"""

SQL_METRICS = _SQL_EVENTS + """, metrics AS (
  SELECT event_id * 2 AS id, timestamp, concat(event_type, '_value') AS name, 1 AS type, value,
         service, host, concat('{"k":"', regexp_extract(props, '([0-9]+)', 1), '"}') AS labels
  FROM ev
  UNION ALL
  SELECT event_id * 2 + 1, timestamp, concat(event_type, '_total'), 0, CAST(event_id + 1 AS DOUBLE),
         service, host, CAST(NULL AS VARCHAR)
  FROM ev)"""

SQL_BOTH = SQL_LOGS + SQL_METRICS[len(_SQL_EVENTS):]

SQL_CORPUS = "corpus AS (SELECT doc_id AS id, text AS raw, source AS service, lang AS host FROM documents)"
