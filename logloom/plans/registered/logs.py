"""Registered queries over the logs table and across both signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import values as V
from logloom.functions.timeexpr import bucket, newer_than
from logloom.operators import filters, paging, shape, signals, windows
from logloom.operators.filters import LogFilter
from logloom.plans import home, incident
from logloom.schemas import DAY_MS, ERROR, HOUR_MS, LOG_COLUMNS
from logloom.session import scratch_path, stored_days
from logloom.sources import testdata as td

AS_OF = td.AS_OF
LOGS = f"WITH {td.SQL_LOGS}"
BOTH = f"WITH {td.SQL_BOTH}"
NINE = "id, timestamp, ingested_at, level, service, host, message, parsed, raw"
SHOWN = "id, timestamp, level, service, host, COALESCE(message, raw) AS message, raw"
CURSOR = (AS_OF - 3 * DAY_MS, 12345)
INCIDENT = (AS_OF - 2 * DAY_MS, AS_OF - DAY_MS)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name, fn, sql):
    QUERIES[name] = fn
    ORACLE[name] = sql


def _logs(fn):
    return lambda spark, sf_dir: fn(td.logs(spark, sf_dir).drop("dt"))


def _first_time(spark, sf_dir, log_id):
    return td.logs(spark, sf_dir).filter(F.col("id") == log_id).first()["timestamp"]


def _dated(fn):
    """For functions that prune by date: the view keeps ``dt``."""
    return lambda spark, sf_dir: fn(td.logs(spark, sf_dir))


# viewer
_add("logs_page_first", _logs(lambda t: paging.viewer_rows(paging.keyset_page(t))),
     f"{LOGS} SELECT {SHOWN} FROM logs ORDER BY timestamp DESC, id DESC LIMIT 50")
_add("logs_page_next", _dated(lambda t: paging.viewer_rows(paging.keyset_page(t, CURSOR))),
     f"{LOGS} SELECT {SHOWN} FROM logs WHERE timestamp < {CURSOR[0]} OR (timestamp = {CURSOR[0]} AND id < {CURSOR[1]})"
     " ORDER BY timestamp DESC, id DESC LIMIT 50")
_add("logs_quick_filter",
     _logs(lambda t: filters.newest(LogFilter().with_(service="svc-1").with_(level="4").with_(service="svc-2").apply(t))),
     f"{LOGS} SELECT {NINE} FROM logs WHERE service = 'svc-2' AND level = 4 ORDER BY timestamp DESC, id DESC LIMIT 100")
_add("logs_drill_in",
     _dated(lambda t: filters.drill_in(t, LogFilter().newer(AS_OF - 7 * DAY_MS), "service", "svc-3").drop("dt")),
     f"{LOGS} SELECT {NINE} FROM logs WHERE service = 'svc-3' AND timestamp > {AS_OF - 7 * DAY_MS}"
     " ORDER BY timestamp, id LIMIT 50")
_add("logs_point_lookup", _logs(lambda t: filters.point_lookup(t, 77)), f"{LOGS} SELECT {NINE} FROM logs WHERE id = 77")


def _by_day(spark, sf_dir):
    """The log view as a stored table, and its days: newest-first reads prune."""
    path = scratch_path(spark, "logs")
    td.logs(spark, sf_dir).write.partitionBy("dt").parquet(path)
    return spark.read.parquet(path), stored_days(spark, path)


def _stored_newest(flt, n):
    def run(spark, sf_dir):
        table, days = _by_day(spark, sf_dir)
        return filters.newest(flt.apply(table), n, days).select(*LOG_COLUMNS)
    return run


_add("logs_page_stored", _stored_newest(LogFilter(), 50),
     f"{LOGS} SELECT {NINE} FROM logs ORDER BY timestamp DESC, id DESC LIMIT 50")
_add("logs_newest_stored", _stored_newest(LogFilter().with_(service="svc-2").with_(level=4), 400),
     f"{LOGS} SELECT {NINE} FROM logs WHERE service = 'svc-2' AND level = 4 ORDER BY timestamp DESC, id DESC LIMIT 400")
_add("logs_lookup_stored",
     lambda s, d: filters.point_lookup(_by_day(s, d)[0], 77, _first_time(s, d, 77)).select(*LOG_COLUMNS),
     f"{LOGS} SELECT {NINE} FROM logs WHERE id = 77")
_add("logs_window_lock",
     _dated(lambda t: LogFilter().within(*INCIDENT).apply(t).groupBy("service", "level").agg(F.count("*").alias("lines"))),
     f"{LOGS} SELECT service, level, COUNT(*) AS lines FROM logs WHERE timestamp BETWEEN {INCIDENT[0]} AND {INCIDENT[1]}"
     " GROUP BY service, level")


def _presets(t):
    picks = {"triage": filters.triage(AS_OF), "warnings": filters.warnings_and_up(),
             "service": filters.service_logs("svc-0"), "service_errors": filters.service_errors("svc-0", AS_OF)}
    out = None
    for name, flt in picks.items():
        part = filters.newest(flt.apply(t)).select(F.lit(name).alias("preset"), "id", "timestamp", "level", "service")
        out = part if out is None else out.unionAll(part)
    return out


def _preset_sql(name, cond):
    return (f"(SELECT '{name}' AS preset, id, timestamp, level, service FROM logs WHERE {cond}"
            " ORDER BY timestamp DESC, id DESC LIMIT 100)")


_add("logs_presets", _dated(_presets),
     f"{LOGS} " + " UNION ALL ".join([
         _preset_sql("triage", f"level >= 4 AND timestamp > {AS_OF - HOUR_MS}"), _preset_sql("warnings", "level >= 3"),
         _preset_sql("service", "service = 'svc-0'"),
         _preset_sql("service_errors", f"service = 'svc-0' AND level >= 4 AND timestamp > {AS_OF - DAY_MS}")]))
_add("logs_recent", _logs(lambda t: paging.recent(t, 1000)),
     f"{LOGS} SELECT {NINE} FROM logs ORDER BY id DESC LIMIT 1000")
_add("logs_predicates",
     _logs(lambda t: t.filter(F.col("message").ilike("%USER 1_%") & F.col("level").isin(3, 4)
                              & F.col("timestamp").between(AS_OF - 25 * DAY_MS, AS_OF - DAY_MS) & ~(F.col("host") == "host-2")
                              & F.col("parsed").isNotNull())
           .select(F.col("id").alias("log_id"), F.when(F.col("level") >= 4, "bad").otherwise("ok").alias("grade"))),
     f"{LOGS} SELECT id AS log_id, CASE WHEN level >= 4 THEN 'bad' ELSE 'ok' END AS grade FROM logs"
     " WHERE message ILIKE '%USER 1_%' AND level IN (3, 4) AND NOT host = 'host-2'"
     f" AND parsed IS NOT NULL AND timestamp BETWEEN {AS_OF - 25 * DAY_MS} AND {AS_OF - DAY_MS}")
_add("logs_at_level", _logs(lambda t: filters.newest(LogFilter().with_(level=4).apply(t))),
     f"{LOGS} SELECT {NINE} FROM logs WHERE level = 4 ORDER BY timestamp DESC, id DESC LIMIT 100")
_add("logs_lenient_cast",
     _logs(lambda t: t.groupBy(V.lenient_int(F.substring("raw", F.lit(15), F.lit(12))).alias("n")).agg(F.count("*").alias("lines"))),
     f"{LOGS} SELECT COALESCE(TRY_CAST(NULLIF(regexp_extract(substr(raw, 15, 12), '^\\s*([+-]?\\d+)', 1), '') AS BIGINT), 0)"
     " AS n, COUNT(*) AS lines FROM logs GROUP BY 1")
_add("logs_offset_page", _logs(lambda t: t.orderBy(F.desc("timestamp"), F.desc("id")).offset(20).limit(10)),
     f"{LOGS} SELECT {NINE} FROM logs ORDER BY timestamp DESC, id DESC LIMIT 10 OFFSET 20")
_add("like_scan", _logs(lambda t: t.filter(F.col("raw").ilike("%ERROR BY user 1%")).agg(F.count("*").alias("hits"))),
     f"{LOGS} SELECT COUNT(*) AS hits FROM logs WHERE raw ILIKE '%ERROR BY user 1%'")

# overview
_add("logs_volume_5m", _dated(lambda t: home.volume_bars(home.volume(t, AS_OF - 20 * HOUR_MS, 6 * HOUR_MS))),
     f"{LOGS}, c AS (SELECT timestamp // 300000 * 300000 AS bucket, COUNT(*) AS n FROM logs"
     f" WHERE timestamp > {AS_OF - 26 * HOUR_MS} GROUP BY 1),"
     f" p AS (SELECT CAST(g AS BIGINT) AS bucket, COALESCE(n, 0) AS lines FROM generate_series({AS_OF - 26 * HOUR_MS},"
     f" {AS_OF - 20 * HOUR_MS}, 300000) t(g) LEFT JOIN c ON c.bucket = g)"
     " SELECT bucket, lines, CAST(SUM(lines) OVER () AS BIGINT) AS total, MAX(lines) OVER () AS max_lines,"
     " CASE WHEN lines = 0 THEN 0.0 ELSE ROUND(GREATEST(lines * 100.0 / MAX(lines) OVER (), 4.0), 0) END::DOUBLE"
     " AS height_pct FROM p")
_add("logs_errors_by_service", _dated(lambda t: home.errors_by_service(t, AS_OF)),
     f"{LOGS} SELECT service, COUNT(*) AS cnt FROM logs WHERE level >= 4 AND timestamp > {AS_OF - DAY_MS}"
     " GROUP BY service ORDER BY cnt DESC, service LIMIT 10")
_add("logs_services_seen", _dated(lambda t: home.log_services_seen(t, AS_OF)),
     f"{LOGS} SELECT service, MAX(timestamp) AS last_seen, COUNT(*) AS lines FROM logs"
     f" WHERE timestamp > {AS_OF - 7 * DAY_MS} GROUP BY service ORDER BY last_seen DESC, service")
_add("logs_errors_per_10m", _dated(lambda t: home.errors_per_bucket(t, AS_OF)),
     f"{LOGS} SELECT timestamp // 600000 * 600000 AS bucket, COUNT(*) AS errors FROM logs WHERE level >= 4"
     f" AND timestamp > {AS_OF - DAY_MS} GROUP BY 1")
_add("logs_errors_vs_total", _dated(lambda t: home.errors_vs_total(t, AS_OF)),
     f"{LOGS} SELECT service, CAST(SUM(CASE WHEN level >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS errors,"
     f" COUNT(*) AS total FROM logs WHERE timestamp > {AS_OF - DAY_MS} GROUP BY service")
_add("logs_json_field", _logs(lambda t: home.json_field(t, "k")),
     f"{LOGS} SELECT id, timestamp, json_extract_string(parsed, '$.k') AS field, message FROM logs"
     " WHERE parsed IS NOT NULL ORDER BY timestamp DESC, id DESC LIMIT 100")
_add("logs_host_service",
     _logs(lambda t: filters.newest(LogFilter().with_(host="host-1", service="svc-2").apply(t))),
     f"{LOGS} SELECT {NINE} FROM logs WHERE host = 'host-1' AND service = 'svc-2'"
     " ORDER BY timestamp DESC, id DESC LIMIT 100")

# incident view
_add("incident_mini_chart", _dated(lambda t: incident.mini_chart(t, INCIDENT)),
     f"{LOGS}, c AS (SELECT timestamp // 1800000 * 1800000 AS bucket, COUNT(*) AS n,"
     f" COUNT(*) FILTER (WHERE level >= 4) AS e FROM logs WHERE timestamp BETWEEN {INCIDENT[0]} AND {INCIDENT[1]}"
     f" GROUP BY 1) SELECT CAST(g AS BIGINT) AS bucket, COALESCE(n, 0) AS lines, COALESCE(e, 0) AS errors"
     f" FROM generate_series({INCIDENT[0]}, {INCIDENT[1]}, 1800000) t(g) LEFT JOIN c ON c.bucket = g")
_add("incident_totals", _dated(lambda t: incident.mini_totals(t, INCIDENT)),
     f"{LOGS} SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE level >= 4) AS errors FROM logs"
     f" WHERE timestamp BETWEEN {INCIDENT[0]} AND {INCIDENT[1]}")
_add("incident_metric_row",
     lambda s, d: incident.metric_row(td.metrics(s, d, only="error_total"),
                                      incident.MetricRow("increase", "error_total", per="1h"), INCIDENT),
     f"WITH {td.SQL_METRICS}, r AS (SELECT bucket, SUM(inc) AS inc FROM (SELECT timestamp // 3600000 * 3600000 AS bucket,"
     " service, host, labels, MAX(value) - MIN(value) AS inc FROM metrics WHERE name = 'error_total'"
     f" AND timestamp BETWEEN {INCIDENT[0]} AND {INCIDENT[1]} GROUP BY 1, 2, 3, 4) GROUP BY bucket)"
     " SELECT CAST(g AS BIGINT) AS bucket, COALESCE(inc, 0.0) AS increase"
     f" FROM generate_series({INCIDENT[0]}, {INCIDENT[1]}, 3600000) t(g) LEFT JOIN r ON r.bucket = g")
_add("incident_logs_pane",
     _dated(lambda t: incident.logs_pane(t, filters.warnings_and_up(), INCIDENT)),
     f"{LOGS} SELECT {SHOWN} FROM logs WHERE level >= 3 AND timestamp BETWEEN {INCIDENT[0]} AND {INCIDENT[1]}"
     " ORDER BY timestamp DESC, id DESC LIMIT 100")

# both signals
_add("join_logs_metrics",
     lambda s, d: signals.lines_with_sample(td.logs(s, d), td.metrics(s, d, only="error_value"), "error_value")
     .select("id", "service", "timestamp", F.round("value", 8).alias("value")),
     f"{BOTH} SELECT l.id, l.service, l.timestamp, ROUND(m.value, 8) AS value FROM logs l JOIN (SELECT service, host,"
     " timestamp, AVG(value) AS value FROM metrics WHERE name = 'error_value' GROUP BY 1, 2, 3) m"
     " ON l.service = m.service AND l.host = m.host AND l.timestamp = m.timestamp")


def _cells(df):
    return df.select("service", "bucket", "lines", "errors", F.round("avg_value", 8).alias("avg_value"), "samples")


def _buckets_sql(how, width=6 * HOUR_MS):
    return (f"{BOTH}, l AS (SELECT service, timestamp // {width} * {width} AS bucket, COUNT(*) AS lines,"
            " COUNT(*) FILTER (WHERE level >= 4) AS errors FROM logs GROUP BY 1, 2),"
            f" m AS (SELECT service, timestamp // {width} * {width} AS bucket, ROUND(AVG(value), 8) AS avg_value,"
            " COUNT(*) AS samples FROM metrics WHERE name = 'purchase_value' GROUP BY 1, 2)"
            f" SELECT service, bucket, lines, errors, avg_value, samples FROM l {how} JOIN m USING (service, bucket)")


_add("join_signal_buckets",
     lambda s, d: _cells(signals.correlate(td.logs(s, d), td.metrics(s, d, only="purchase_value"),
                                           "purchase_value", 6 * HOUR_MS)), _buckets_sql("INNER"))
_add("outer_join_signals",
     lambda s, d: _cells(signals.correlate(td.logs(s, d), td.metrics(s, d, only="purchase_value"),
                                           "purchase_value", 6 * HOUR_MS, "full_outer")), _buckets_sql("FULL"))
_add("range_join_bursts",
     lambda s, d: signals.around(
         signals.bursts(td.logs(s, d), HOUR_MS, 1),
         signals.metric_buckets(td.metrics(s, d, only="purchase_value"), "purchase_value", HOUR_MS), HOUR_MS, 1, 2)
     .select("service", "burst", "bucket", "errors", "samples", F.round("avg_value", 8).alias("avg_value")),
     f"{BOTH}, b AS (SELECT service, timestamp // {HOUR_MS} * {HOUR_MS} AS burst, COUNT(*) FILTER (WHERE level >= 4) AS errors"
     f" FROM logs GROUP BY 1, 2 HAVING COUNT(*) FILTER (WHERE level >= 4) > 1), m AS (SELECT service, timestamp // {HOUR_MS}"
     f" * {HOUR_MS} AS bucket, COUNT(*) AS samples, ROUND(AVG(value), 8) AS avg_value FROM metrics"
     " WHERE name = 'purchase_value' GROUP BY 1, 2) SELECT b.service, burst, bucket, errors, samples, avg_value FROM b JOIN m"
     f" ON m.service = b.service AND m.bucket BETWEEN burst - {HOUR_MS} AND burst + {2 * HOUR_MS}")
_add("exists_cross_signal",
     lambda s, d: signals.services_where_both(
         newer_than(td.logs(s, d), AS_OF - DAY_MS).filter(F.col("level") >= ERROR),
         newer_than(td.metrics(s, d, only="error_value"), AS_OF - DAY_MS).filter(F.col("value") > 100)),
     f"{BOTH} SELECT DISTINCT service FROM logs WHERE level >= 4 AND timestamp > {AS_OF - DAY_MS} AND EXISTS"
     " (SELECT 1 FROM metrics m WHERE m.service = logs.service AND m.name = 'error_value' AND m.value > 100"
     f" AND m.timestamp > {AS_OF - DAY_MS})")
_add("silent_service",
     lambda s, d: signals.silent(td.logs(s, d).select(F.concat_ws("/", "service", "host").alias("service")),
                                 newer_than(td.logs(s, d), AS_OF - 2 * HOUR_MS)
                                 .select(F.concat_ws("/", "service", "host").alias("service"))),
     f"{LOGS} SELECT DISTINCT concat(service, '/', host) AS service FROM logs l WHERE NOT EXISTS (SELECT 1 FROM logs r"
     f" WHERE r.service = l.service AND r.host = l.host AND r.timestamp > {AS_OF - 2 * HOUR_MS})")
_add("latest_correlated",
     lambda s, d: signals.latest_rows(td.metrics(s, d, only="view_value").select("service", "id", "timestamp", "value")),
     f"WITH {td.SQL_METRICS} SELECT service, id, timestamp, value FROM metrics m WHERE name = 'view_value'"
     " AND id = (SELECT MAX(id) FROM metrics WHERE name = m.name AND service = m.service)")


def _cte_errors(spark, sf_dir):
    logs = td.logs(spark, sf_dir)
    errors = logs.filter(F.col("level") >= ERROR).groupBy("service").agg(F.count("*").alias("errors"))
    total = logs.groupBy("service").agg(F.count("*").alias("total"))
    return (errors.join(total, "service")
            .select("service", F.round(F.try_divide(F.col("errors") * 100.0, "total"), 3).alias("pct")))


_add("cte_errors", _cte_errors,
     f"{LOGS}, e AS (SELECT service, COUNT(*) AS errors FROM logs WHERE level >= 4 GROUP BY service),"
     " t AS (SELECT service, COUNT(*) AS total FROM logs GROUP BY service)"
     " SELECT service, ROUND(CAST(errors AS DOUBLE) * 100.0 / total, 3) AS pct FROM e JOIN t USING (service)")

# set operations over senders
_NOISY = "SELECT service, host FROM logs WHERE level >= 4 AND timestamp > " + str(AS_OF - 2 * HOUR_MS)
_BUYERS = "SELECT service, host FROM logs WHERE level = 3 AND timestamp > " + str(AS_OF - 6 * HOUR_MS)


def _sets(op):
    def run(spark, sf_dir):
        t = td.logs(spark, sf_dir)
        a = newer_than(t, AS_OF - 2 * HOUR_MS).filter(F.col("level") >= ERROR).select("service", "host")
        b = newer_than(t, AS_OF - 6 * HOUR_MS).filter(F.col("level") == 3).select("service", "host")
        return op(a, b)
    return run


_add("set_union", _sets(lambda a, b: a.union(b).distinct()), f"{LOGS} {_NOISY} UNION {_BUYERS}")
_add("set_union_all", _sets(lambda a, b: a.unionAll(b)), f"{LOGS} {_NOISY} UNION ALL {_BUYERS}")
_add("set_intersect", _sets(lambda a, b: a.intersect(b)), f"{LOGS} {_NOISY} INTERSECT {_BUYERS}")
_add("set_except", _sets(lambda a, b: b.subtract(a)), f"{LOGS} {_BUYERS} EXCEPT {_NOISY}")

# aggregates
_add("distinct_services", _logs(lambda t: t.select("service").distinct().orderBy("service")),
     f"{LOGS} SELECT DISTINCT service FROM logs")
_add("having_busy",
     _logs(lambda t: t.groupBy("service", "host").agg(F.count("*").alias("cnt")).filter(F.col("cnt") > 10)),
     f"{LOGS} SELECT service, host, COUNT(*) AS cnt FROM logs GROUP BY service, host HAVING cnt > 10")
_add("basic_aggregates",
     lambda s, d: td.metrics(s, d).groupBy("name").agg(
         F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 8).alias("mean"),
         F.min("value").alias("low"), F.max("value").alias("high")),
     f"WITH {td.SQL_METRICS} SELECT name, COUNT(*) AS n, ROUND(SUM(value), 2) AS total, ROUND(AVG(value), 8) AS mean,"
     " MIN(value) AS low, MAX(value) AS high FROM metrics GROUP BY name")
_add("total_aggregate",
     lambda s, d: td.metrics(s, d, only="view_value").withColumn("high", F.when(F.col("value") > 1e9, F.col("value")))
     .groupBy("service").agg(F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"),
                             F.coalesce(F.sum("high"), F.lit(0.0)).alias("total_high"), F.sum("high").alias("plain_sum")),
     f"WITH {td.SQL_METRICS} SELECT service, ROUND(COALESCE(SUM(value), 0.0), 4) AS total, COALESCE(SUM(CASE WHEN value > 1e9 THEN"
     " value END), 0.0) AS total_high, SUM(CASE WHEN value > 1e9 THEN value END) AS plain_sum FROM metrics"
     " WHERE name = 'view_value' GROUP BY service")
_add("string_agg_services",
     _logs(lambda t: t.select("level", "service").distinct().groupBy("level")
           .agg(F.array_join(F.array_sort(F.collect_list("service")), ",").alias("services"))),
     f"{LOGS} SELECT level, string_agg(service, ',' ORDER BY service) AS services FROM"
     " (SELECT DISTINCT level, service FROM logs) GROUP BY level")
_add("filter_agg",
     _logs(lambda t: t.groupBy("service").agg(
         F.count_if(F.col("level") >= ERROR).alias("errors"),
         F.count_distinct("host").alias("hosts"),
         F.max(F.when(F.col("level") >= ERROR, F.col("timestamp"))).alias("last_error"))),
     f"{LOGS} SELECT service, COUNT(*) FILTER (WHERE level >= 4) AS errors, COUNT(DISTINCT host) AS hosts,"
     " MAX(timestamp) FILTER (WHERE level >= 4) AS last_error FROM logs GROUP BY service")
_add("logs_by_level", _logs(lambda t: t.groupBy("level").agg(F.count("*").alias("lines"))),
     f"{LOGS} SELECT level, COUNT(*) AS lines FROM logs GROUP BY level")

# windows
_add("window_rank",
     _logs(lambda t: windows.rank_groups(
         t.groupBy(bucket("timestamp", DAY_MS).alias("day"), "service").agg(F.count_if(F.col("level") >= ERROR).alias("errors")),
         ["day"], [F.desc("errors")])),
     f"{LOGS} SELECT day, service, errors, CAST(RANK() OVER w AS INTEGER) AS rank, CAST(DENSE_RANK() OVER w AS INTEGER)"
     f" AS dense_rank FROM (SELECT timestamp // {DAY_MS} * {DAY_MS} AS day, service,"
     " COUNT(*) FILTER (WHERE level >= 4) AS errors FROM logs GROUP BY 1, 2)"
     " WINDOW w AS (PARTITION BY day ORDER BY errors DESC)")
_add("window_running",
     _logs(lambda t: windows.running(
         t.select("service", "timestamp", "id", F.when(F.col("level") >= ERROR, 1).otherwise(0).cast("long").alias("bad")),
         ["service"], ["timestamp", "id"], "bad").select(
             "service", "id", F.col("row_number").cast("long").alias("row_number"), "running_sum")),
     f"{LOGS} SELECT service, id, ROW_NUMBER() OVER w AS row_number, CAST(SUM(CASE WHEN level >= 4 THEN 1 ELSE 0 END)"
     " OVER (PARTITION BY service ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_sum FROM logs"
     " WINDOW w AS (PARTITION BY service ORDER BY timestamp, id)")
_add("window_lag",
     _logs(lambda t: windows.lag_delta(t.select("service", "timestamp", "id"), ["service"], ["timestamp", "id"],
                                       "timestamp").select("service", "id", "previous", "delta")),
     f"{LOGS} SELECT service, id, LAG(timestamp) OVER w AS previous, timestamp - LAG(timestamp) OVER w AS delta"
     " FROM logs WINDOW w AS (PARTITION BY service ORDER BY timestamp, id)")
_FRAME = "(PARTITION BY service ORDER BY timestamp RANGE BETWEEN 21600000 PRECEDING AND CURRENT ROW)"
_add("window_sliding",
     _logs(lambda t: windows.sliding(t.select("service", "timestamp", "id", "level"), ["service"], "timestamp", 6 * HOUR_MS, "level")
           .select("service", "id", F.col("frame_rows").alias("lines"), F.col("frame_sum").alias("levels"),
                   F.col("frame_min").alias("lowest"), F.col("frame_max").alias("highest"))),
     f"{LOGS} SELECT service, id, COUNT(*) OVER w AS lines, CAST(SUM(level) OVER w AS BIGINT) AS levels, MIN(level) OVER w AS lowest,"
     f" MAX(level) OVER w AS highest FROM logs WINDOW w AS {_FRAME}")
_add("window_last_rows",
     _logs(lambda t: windows.sliding_rows(t.select("service", "timestamp", "id", "level"), ["service"], ["timestamp", "id"], 50, "level")
           .select("service", "id", F.col("frame_rows").alias("lines"), F.col("frame_sum").alias("levels"),
                   F.col("frame_max").alias("highest"))),
     f"{LOGS} SELECT service, id, COUNT(*) OVER w AS lines, CAST(SUM(level) OVER w AS BIGINT) AS levels, MAX(level) OVER w AS highest"
     " FROM logs WINDOW w AS (PARTITION BY service ORDER BY timestamp, id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
_add("window_top_per_service",
     _logs(lambda t: windows.top_per_key(t.filter(F.col("level") >= ERROR).select("service", "id", "timestamp"),
                                         ["service"], [F.desc("timestamp"), F.desc("id")], 5)),
     f"{LOGS} SELECT service, id, timestamp, CAST(rn AS INTEGER) AS rn FROM (SELECT service, id, timestamp,"
     " ROW_NUMBER() OVER (PARTITION BY service ORDER BY timestamp DESC, id DESC) AS rn FROM logs WHERE level >= 4)"
     " WHERE rn <= 5")

# shaping
_add("adaptive_bucket",
     lambda s, d: td.events(s, d).groupBy("service", "host", "event_type")
     .agg((F.max("timestamp") - F.min("timestamp")).alias("span"))
     .withColumn("bucket_ms", shape.adaptive_bucket_column(F.col("span"))),
     f"WITH {td._SQL_EVENTS} SELECT service, host, event_type, span, CAST(CASE "
     + " ".join(f"WHEN span // {w} <= 120 THEN {w}" for w in shape.ADAPTIVE_STEPS_MS)
     + f" ELSE (span // 120 // {DAY_MS} + 1) * {DAY_MS} END AS BIGINT) AS bucket_ms FROM (SELECT service, host,"
       " event_type, MAX(timestamp) - MIN(timestamp) AS span FROM ev GROUP BY 1, 2, 3)")


def _bounded(spark, sf_dir):
    t = td.logs(spark, sf_dir).select("id", "timestamp")
    columns, rows, truncated = shape.api_result(t.orderBy("timestamp", "id"), 5000)
    return spark.createDataFrame([(*r, truncated) for r in rows], "id long, timestamp long, truncated boolean")


_add("bounded_result", _bounded,
     f"{LOGS} SELECT id, timestamp, (SELECT COUNT(*) > 1000 FROM logs) AS truncated FROM logs ORDER BY timestamp, id LIMIT 1000")
_add("cell_truncate",
     lambda s, d: shape.clamp_cells(td.search_corpus(s, d)),
     f"WITH {td.SQL_CORPUS} SELECT id, service, host, CASE WHEN strlen(raw) <= 4096 THEN raw ELSE concat(left(raw,"
     " list_max(list_filter(range(1024, 4097), lambda n: strlen(left(raw, n)) <= 4096))), '…(truncated)') END AS raw"
     " FROM corpus")

HEADLINE = ["logs_page_first", "logs_volume_5m", "incident_mini_chart", "join_signal_buckets", "window_running",
            "cell_truncate"]
