"""Function names of the SQL users write today, defined as SQL functions Spark inlines.

After ``define(spark)`` and ``register_views`` a query like
``SELECT json_extract(parsed, '$.k') FROM logs WHERE timestamp > (unixepoch() - 3600) * 1000``
runs as it is. Aggregates can't be defined this way: write ``coalesce(sum(x), 0.0)`` for
``total(x)`` and ``string_agg(x, ',')`` for ``group_concat(x)``. Integer division is ``div``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# UTC wall-clock time, whatever the session's zone is.
_EPOCH = "timestampadd(MICROSECOND, cast(secs * 1000000 as bigint), timestamp_ntz'1970-01-01 00:00:00')"
_PATTERN = "fmt"
# Format codes and their date patterns.
for _code, _pattern in (("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%H", "HH"), ("%M", "mm"), ("%S", "ss"),
                        ("%j", "DDD"), ("T", "''T''")):
    _PATTERN = f"replace({_PATTERN}, '{_code}', '{_pattern}')"

DEFINITIONS = {
    "unixepoch() RETURNS BIGINT": "unix_timestamp()",
    "json_extract(doc STRING, path STRING) RETURNS STRING": "get_json_object(doc, path)",
    "datetime(secs DOUBLE, modifier STRING DEFAULT 'unixepoch') RETURNS STRING":
        f"date_format({_EPOCH}, 'yyyy-MM-dd HH:mm:ss')",
    "strftime(fmt STRING, secs DOUBLE, modifier STRING DEFAULT 'unixepoch') RETURNS STRING":
        f"date_format({_EPOCH}, {_PATTERN})",
    "iif(cond BOOLEAN, a STRING, b STRING) RETURNS STRING": "if(cond, a, b)",
    "glob(pattern STRING, txt STRING) RETURNS BOOLEAN":
        "txt rlike concat('^', replace(replace(regexp_replace(pattern, '([.+(){}|^$\\\\\\\\])', '\\\\\\\\$1'), '*', '.*'), '?', '.'), '$')",
}


def define(spark: SparkSession) -> None:
    for signature, body in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def register_views(logs: DataFrame | None = None, metrics: DataFrame | None = None) -> None:
    """The two tables under the names queries use."""
    if logs is not None:
        logs.createOrReplaceTempView("logs")
    if metrics is not None:
        metrics.createOrReplaceTempView("metrics")
