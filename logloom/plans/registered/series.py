"""Registered queries over the metrics table, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.timeexpr import duration_ms
from logloom.operators import series, shape
from logloom.plans import catalog
from logloom.schemas import DAY_MS
from logloom.sources import testdata as td

AS_OF = td.AS_OF
WITH = f"WITH {td.SQL_METRICS}"
LAST_DAY = f"timestamp > {AS_OF} - {DAY_MS}"
WINDOW = (AS_OF - 5 * DAY_MS, AS_OF - 3 * DAY_MS)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name, fn, sql):
    QUERIES[name] = fn
    ORACLE[name] = sql


def _rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[F.round(f"`{c}`", digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _verb(name, metric, **kw):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(series.verb(td.metrics(spark, sf_dir, only=metric), name, metric, as_of=AS_OF, **kw))
    return run


def _bucket_sql(per: str) -> str:
    ms = duration_ms(per)
    return f"timestamp // {ms} * {ms}"


def _growth_sql(metric, per, where=LAST_DAY, outer="SUM(inc) AS increase", keys="bucket"):
    return (f"{WITH} SELECT {keys}, {outer} FROM (SELECT {_bucket_sql(per)} AS bucket, service, host, labels,"
            f" MAX(value) - MIN(value) AS inc FROM metrics WHERE name = '{metric}' AND {where}"
            f" GROUP BY 1, 2, 3, 4) GROUP BY {keys}")


# counter verbs
_add("ts_increase_hourly", _verb("increase", "error_total", per="1h"), _growth_sql("error_total", "1h"))
_add("ts_rate_hourly", _verb("rate", "error_total", per="1h"),
     _growth_sql("error_total", "1h", outer="ROUND(SUM(inc) / 3600.0, 8) AS rate_per_s"))
_add("ts_increase_window", _verb("increase", "click_total", last="7d"),
     f"{WITH} SELECT SUM(inc) AS increase FROM (SELECT service, host, labels, MAX(value) - MIN(value) AS inc"
     f" FROM metrics WHERE name = 'click_total' AND timestamp > {AS_OF} - {7 * DAY_MS} GROUP BY 1, 2, 3)")
_add("ts_increase_by_service", _verb("increase", "click_total", last="7d", by_service=True),
     f"{WITH} SELECT service, SUM(inc) AS increase FROM (SELECT service, host, labels, MAX(value) - MIN(value) AS inc"
     f" FROM metrics WHERE name = 'click_total' AND timestamp > {AS_OF} - {7 * DAY_MS} GROUP BY 1, 2, 3)"
     " GROUP BY service")
_add("ts_rate_by_service", _verb("rate", "view_total", last="2d", by_service=True),
     f"{WITH} SELECT service, ROUND(SUM(inc) / {2 * DAY_MS // 1000}.0, 8) AS rate_per_s FROM (SELECT service, host,"
     " labels, MAX(value) - MIN(value) AS inc FROM metrics WHERE name = 'view_total'"
     f" AND timestamp > {AS_OF} - {2 * DAY_MS} GROUP BY 1, 2, 3) GROUP BY service")

# gauge verbs
_add("ts_avg_bucket", _verb("avg", "error_value", per="1h"),
     f"{WITH} SELECT {_bucket_sql('1h')} AS bucket, ROUND(AVG(value), 8) AS avg_value FROM metrics"
     f" WHERE name = 'error_value' AND {LAST_DAY} GROUP BY 1")


def _min_max_sum(spark, sf_dir):
    m = td.metrics(spark, sf_dir, only="purchase_value")
    samples = series.select_samples(m, "purchase_value", last="30d", as_of=AS_OF)
    return _rounded(samples.groupBy("service").agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.sum("value").alias("sum_value")), 2)


_add("ts_min_max_sum", _min_max_sum,
     f"{WITH} SELECT service, ROUND(MIN(value), 2) AS min_value, ROUND(MAX(value), 2) AS max_value,"
     " ROUND(SUM(value), 2) AS sum_value FROM metrics WHERE name = 'purchase_value'"
     f" AND timestamp > {AS_OF} - {30 * DAY_MS} GROUP BY service")
for _v in ("min", "max", "sum"):
    _add(f"ts_{_v}_bucket", _verb(_v, "purchase_value", per="6h", last="7d"),
         f"{WITH} SELECT {_bucket_sql('6h')} AS bucket, ROUND({_v.upper()}(value), 8) AS {_v}_value FROM metrics"
         f" WHERE name = 'purchase_value' AND timestamp > {AS_OF} - {7 * DAY_MS} GROUP BY 1")
_add("ts_avg_stat", _verb("avg", "signup_value", last="30d"),
     f"{WITH} SELECT ROUND(AVG(value), 8) AS avg_value FROM metrics WHERE name = 'signup_value'"
     f" AND timestamp > {AS_OF} - {30 * DAY_MS}")
_add("ts_count_samples", _verb("count", "view_value", per="1h"),
     f"{WITH} SELECT {_bucket_sql('1h')} AS bucket, COUNT(*) AS samples FROM metrics"
     f" WHERE name = 'view_value' AND {LAST_DAY} GROUP BY 1")
_add("ts_latest", _verb("latest", "error_value"),
     f"{WITH} SELECT value AS latest FROM metrics WHERE name = 'error_value' AND {LAST_DAY} ORDER BY id DESC LIMIT 1")
_add("ts_latest_by_service", _verb("latest", "error_value", by_service=True),
     f"{WITH} SELECT service, arg_max(value, id) AS latest FROM metrics WHERE name = 'error_value' AND {LAST_DAY}"
     " GROUP BY service")
_add("ts_max_by_service", _verb("max", "error_value", by_service=True),
     f"{WITH} SELECT service, MAX(value) AS max_value FROM metrics WHERE name = 'error_value' AND {LAST_DAY}"
     " GROUP BY service")

# pivots: the columns are the metric's services, looked up from the data
_SVC = ["svc-0", "svc-1", "svc-2", "svc-3"]


def _pivot_sql(cell: str) -> str:
    return ", ".join(cell.format(s=s) + f' AS "{s}"' for s in _SVC)


_add("ts_avg_pivot", _verb("avg", "error_value", per="1h", by_service=True),
     f"{WITH} SELECT {_bucket_sql('1h')} AS bucket, "
     + _pivot_sql("ROUND(AVG(CASE WHEN service = '{s}' THEN value END), 8)")
     + f" FROM metrics WHERE name = 'error_value' AND {LAST_DAY} GROUP BY 1")
_add("ts_count_pivot", _verb("count", "click_value", per="3h", last="7d", by_service=True),
     f"{WITH} SELECT {_bucket_sql('3h')} AS bucket, " + _pivot_sql("COUNT(CASE WHEN service = '{s}' THEN 1 END)")
     + f" FROM metrics WHERE name = 'click_value' AND timestamp > {AS_OF} - {7 * DAY_MS} GROUP BY 1")
_add("ts_increase_pivot", _verb("increase", "error_total", per="6h", last="7d", by_service=True),
     _growth_sql("error_total", "6h", f"timestamp > {AS_OF} - {7 * DAY_MS}",
                 _pivot_sql("SUM(CASE WHEN service = '{s}' THEN inc END)")))
_add("ts_rate_pivot", _verb("rate", "error_total", per="6h", last="7d", by_service=True),
     _growth_sql("error_total", "6h", f"timestamp > {AS_OF} - {7 * DAY_MS}",
                 _pivot_sql("ROUND(SUM(CASE WHEN service = '{s}' THEN inc END) / 21600.0, 8)")))

_add("ts_avg_pivot_named",
     lambda s, d: _rounded(series.verb(td.metrics(s, d, only="view_value"), "avg", "view_value", per="6h", last="7d", by_service=True,
                                       services=[*_SVC, *(f"svc-{k}" for k in range(4, 9))], as_of=AS_OF)),
     f"{WITH} SELECT {_bucket_sql('6h')} AS bucket, "
     + _pivot_sql("ROUND(AVG(CASE WHEN service = '{s}' THEN value END), 8)") + ", "
     + ", ".join(f'CAST(NULL AS DOUBLE) AS "svc-{k}"' for k in range(4, 9))
     + f" FROM metrics WHERE name = 'view_value' AND timestamp > {AS_OF} - {7 * DAY_MS} GROUP BY 1")

# window override and filters
_add("ts_window_override", _verb("rate", "click_total", window=WINDOW, by_service=True),
     f"{WITH} SELECT service, ROUND(SUM(inc) / {2 * DAY_MS // 1000}.0, 8) AS rate_per_s FROM (SELECT service, host,"
     " labels, MAX(value) - MIN(value) AS inc FROM metrics WHERE name = 'click_total'"
     f" AND timestamp BETWEEN {WINDOW[0]} AND {WINDOW[1]} GROUP BY 1, 2, 3) GROUP BY service")
_add("ts_label_filter", _verb("count", "view_value", last="30d", by_service=True, filters={"k": "7", "host": "host-1"}),
     f"{WITH} SELECT service, COUNT(*) AS samples FROM metrics WHERE name = 'view_value'"
     " AND json_extract_string(labels, '$.k') = '7' AND host = 'host-1'"
     f" AND timestamp > {AS_OF} - {30 * DAY_MS} GROUP BY service")


# gap filling
def _filled(name, metric, per):
    def run(spark, sf_dir):
        width = duration_ms(per)
        start, end = shape.grid_bounds(AS_OF - DAY_MS, AS_OF, width)
        df = series.verb(td.metrics(spark, sf_dir, only=metric), name, metric, per=per, as_of=AS_OF)
        return _rounded(shape.gap_fill(df, start_ms=start, end_ms=end, bucket_ms=width,
                                       zero=series.fills_with_zero(name)))
    return run


def _grid_sql(per):
    ms = duration_ms(per)
    return (f"grid AS (SELECT CAST(g AS BIGINT) AS bucket FROM generate_series({(AS_OF - DAY_MS) // ms * ms},"
            f" {AS_OF // ms * ms}, {ms}) t(g))")


_add("ts_gapfill_counter", _filled("increase", "error_total", "10m"),
     f"{WITH}, {_grid_sql('10m')}, r AS (SELECT bucket, SUM(inc) AS increase FROM (SELECT {_bucket_sql('10m')} AS bucket,"
     " service, host, labels, MAX(value) - MIN(value) AS inc FROM metrics WHERE name = 'error_total'"
     f" AND {LAST_DAY} GROUP BY 1, 2, 3, 4) GROUP BY bucket)"
     " SELECT bucket, COALESCE(increase, 0.0) AS increase FROM grid LEFT JOIN r USING (bucket)")


def _long_grid(spark, sf_dir):
    """Two-minute buckets over thirty days: 21,601 of them."""
    width = duration_ms("2m")
    start, end = shape.grid_bounds(AS_OF - 30 * DAY_MS, AS_OF, width)
    df = series.verb(td.metrics(spark, sf_dir, only="view_value"), "count", "view_value", per="2m", last="30d", as_of=AS_OF)
    return shape.gap_fill(df, start_ms=start, end_ms=end, bucket_ms=width, zero=True)


_add("ts_gapfill_long", _long_grid,
     f"{WITH}, grid AS (SELECT CAST(g AS BIGINT) AS bucket FROM generate_series({(AS_OF - 30 * DAY_MS) // 120_000 * 120_000},"
     f" {AS_OF // 120_000 * 120_000}, 120000) t(g)), r AS (SELECT {_bucket_sql('2m')} AS bucket, COUNT(value) AS samples FROM metrics"
     f" WHERE name = 'view_value' AND timestamp > {AS_OF} - {30 * DAY_MS} GROUP BY 1)"
     " SELECT bucket, COALESCE(samples, 0) AS samples FROM grid LEFT JOIN r USING (bucket)")
_add("ts_gapfill_gauge", _filled("avg", "error_value", "10m"),
     f"{WITH}, {_grid_sql('10m')}, r AS (SELECT {_bucket_sql('10m')} AS bucket, ROUND(AVG(value), 8) AS avg_value"
     f" FROM metrics WHERE name = 'error_value' AND {LAST_DAY} GROUP BY 1)"
     " SELECT bucket, avg_value FROM grid LEFT JOIN r USING (bucket)")


# average from a downcast pair: every event gives a <type>_sum / <type>_count sample
def _sum_count(spark, sf_dir):
    m = td.events(spark, sf_dir)
    pair = m.select(
        "timestamp", "service", "host", F.lit(None).cast("string").alias("labels"),
        F.explode(F.array(
            F.struct((F.col("event_id") * 2).alias("id"), F.concat("event_type", F.lit("_sum")).alias("name"),
                     F.col("value").alias("value")),
            F.struct((F.col("event_id") * 2 + 1).alias("id"), F.concat("event_type", F.lit("_count")).alias("name"),
                     (F.col("user_id") % 5).cast("double").alias("value")))).alias("s"))
    samples = pair.select("s.id", "timestamp", "s.name", "s.value", "service", "host", "labels")
    return _rounded(series.average_from_sum_count(samples, "view").select("timestamp", "service", "host", "avg_value"))


_add("ts_avg_from_sum_count", _sum_count,
     f"WITH {td._SQL_EVENTS} SELECT timestamp, service, host, ROUND(CASE WHEN c = 0 THEN NULL ELSE s / c END, 8)"
     " AS avg_value FROM (SELECT timestamp, service, host, arg_max(value, event_id) AS s,"
     " arg_max(CAST(user_id % 5 AS DOUBLE), event_id) AS c FROM ev WHERE event_type = 'view' GROUP BY 1, 2, 3)")


# catalogs
def _m(fn):
    return lambda spark, sf_dir: fn(td.metrics(spark, sf_dir))


_add("metrics_catalog", _m(lambda m: catalog.metrics_catalog(m)),
     f"{WITH} SELECT name, CASE WHEN type = 1 THEN 'gauge' ELSE 'counter' END AS type, service, points, last_seen,"
     " CASE WHEN type = 0 THEN concat('increase(', name, ') per 1h last 24h')"
     " ELSE concat('avg(', name, ') per 10m last 24h') END AS suggested FROM (SELECT name, MIN(type) AS type, service,"
     " COUNT(*) AS points, MAX(timestamp) AS last_seen FROM metrics GROUP BY name, service)"
     " ORDER BY last_seen DESC, name, service")
_add("service_metrics", _m(lambda m: catalog.service_metrics(m, "svc-1")),
     f"{WITH} SELECT name, COUNT(*) AS points, MAX(timestamp) AS last_seen FROM metrics WHERE service = 'svc-1'"
     " GROUP BY name ORDER BY last_seen DESC, name")
_add("top_metrics", _m(catalog.top_metrics),
     f"{WITH} SELECT name, COUNT(*) AS datapoints FROM metrics GROUP BY name ORDER BY datapoints DESC, name LIMIT 20")
_add("metric_names", _m(catalog.metric_names), f"{WITH} SELECT DISTINCT name FROM metrics ORDER BY name")
_add("metric_services_list", _m(lambda m: series.metric_services(m, "error_total", 7)),
     f"{WITH} SELECT DISTINCT service FROM metrics WHERE name = 'error_total' ORDER BY service LIMIT 7")
_add("label_keys", _m(lambda m: catalog.filter_keys(m, "error_value")),
     f"{WITH} SELECT key, pos FROM (VALUES ('service', 0), ('host', 1)) t(key, pos)"
     " UNION ALL SELECT key, 2 AS pos FROM (SELECT DISTINCT unnest(json_keys(labels)) AS key FROM metrics"
     " WHERE name = 'error_value' AND labels IS NOT NULL)")
_add("label_values", _m(lambda m: catalog.filter_values(m, "error_value", "k")),
     f"{WITH} SELECT DISTINCT json_extract_string(labels, '$.k') AS v FROM metrics WHERE name = 'error_value'"
     " AND json_extract_string(labels, '$.k') IS NOT NULL ORDER BY v")
_add("label_values_host", _m(lambda m: catalog.filter_values(m, "error_value", "host")),
     f"{WITH} SELECT DISTINCT host AS v FROM metrics WHERE name = 'error_value' ORDER BY v")
_add("metric_services_seen", _m(lambda m: catalog.services_seen(m, as_of=AS_OF)),
     f"{WITH} SELECT service, MAX(timestamp) AS last_seen, COUNT(*) AS points FROM metrics"
     f" WHERE timestamp > {AS_OF} - {7 * DAY_MS} GROUP BY service ORDER BY last_seen DESC, service")


def _targets(spark, sf_dir):
    """Scrape targets as the latest state of every (service, host): an error event is a failed scrape."""
    e = td.events(spark, sf_dir)
    failed = F.col("event_type") == "error"
    return (e.groupBy("service", "host")
            .agg(F.max("timestamp").alias("last_scraped_at"),
                 F.max(F.when(failed, F.col("timestamp"))).alias("last_error_at"),
                 F.max_by(F.concat(F.lit("HTTP "), F.col("user_id").cast("string")),
                          F.when(failed, F.col("event_id"))).alias("last_error"))
            .withColumn("enabled", F.col("host") != "host-2"))


_add("ingest_health", _m(lambda m: catalog.ingest_health(m, as_of=AS_OF)),
     f"{WITH} SELECT MAX(timestamp) AS last_seen, COUNT(*) FILTER (WHERE {LAST_DAY}) AS points_24h FROM metrics")
_add("failing_sources", lambda s, d: catalog.failing_sources(_targets(s, d)),
     f"WITH {td._SQL_EVENTS}, targets AS (SELECT service, host, MAX(timestamp) FILTER (WHERE event_type = 'error')"
     " AS last_error_at, arg_max(concat('HTTP ', CAST(user_id AS VARCHAR)), event_id) FILTER"
     " (WHERE event_type = 'error') AS last_error FROM ev GROUP BY service, host)"
     " SELECT service, host, last_error FROM targets WHERE host <> 'host-2' AND last_error IS NOT NULL"
     " ORDER BY last_error_at DESC, service, host LIMIT 5")

HEADLINE = ["ts_increase_hourly", "ts_avg_pivot", "ts_gapfill_counter", "metrics_catalog", "label_values"]
