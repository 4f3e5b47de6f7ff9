"""The two-table data model: schemas and the small enumerations it uses."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
TRACE, DEBUG, INFO, WARN, ERROR, FATAL = range(6)
COUNTER, GAUGE = 0, 1

MINUTE_MS = 60_000
HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS

LOG_COLUMNS = ["id", "timestamp", "ingested_at", "level", "service", "host", "message", "parsed", "raw"]
METRIC_COLUMNS = ["id", "timestamp", "name", "type", "value", "service", "host", "labels"]

#: What a parser yields, before an id is given at write time.
PARSED_LOG_COLUMNS = LOG_COLUMNS[1:]
SAMPLE_COLUMNS = METRIC_COLUMNS[1:]

LOGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.LongType(), False),
    T.StructField("ingested_at", T.LongType(), False),
    T.StructField("level", T.IntegerType(), False),
    T.StructField("service", T.StringType(), False),
    T.StructField("host", T.StringType(), False),
    T.StructField("message", T.StringType(), True),
    T.StructField("parsed", T.StringType(), True),
    T.StructField("raw", T.StringType(), False),
])

METRICS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("type", T.IntegerType(), False),
    T.StructField("value", T.DoubleType(), False),
    T.StructField("service", T.StringType(), False),
    T.StructField("host", T.StringType(), False),
    T.StructField("labels", T.StringType(), True),
])

#: A counter series within one metric name.
SERIES_KEYS = ["service", "host", "labels"]
