"""Registered queries written as SQL over the two views, with the function names users know."""

from __future__ import annotations

from logloom.functions import sql_names
from logloom.schemas import DAY_MS, HOUR_MS
from logloom.sources import testdata as td

AS_OF = td.AS_OF
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name, text, oracle):
    def run(spark, sf_dir):
        sql_names.define(spark)
        return spark.sql(text, logs=td.logs(spark, sf_dir), metrics=td.metrics(spark, sf_dir))
    QUERIES[name] = run
    ORACLE[name] = oracle


_add("sql_scalar_functions",
     "SELECT id, json_extract(parsed, '$.k') AS k, strftime('%Y-%m-%d %H', timestamp / 1000, 'unixepoch') AS hour,"
     " datetime(timestamp / 1000) AS at, length(raw) AS chars, coalesce(nullif(level, 0), -1) AS lv,"
     " round(timestamp / 1000.0, 1) AS secs, timestamp div 60000 % 60 AS minute, service || '@' || host AS sender,"
     " iif(level >= 4, 'bad', 'ok') AS grade, ifnull(try_cast(substr(service, 5) AS INT), 0) AS n,"
     " instr(raw, 'by') AS pos, upper(replace(host, 'host', 'h')) AS h, glob('err*', message) AS is_err,"
     " abs(level - 2) AS dist, try_divide(id, level) AS per_level FROM {logs}",
     f"WITH {td.SQL_LOGS} SELECT id, json_extract_string(parsed, '$.k') AS k,"
     " strftime(make_timestamp(timestamp // 1000 * 1000000), '%Y-%m-%d %H') AS hour,"
     " strftime(make_timestamp(timestamp // 1000 * 1000000), '%Y-%m-%d %H:%M:%S') AS at, CAST(length(raw) AS INTEGER)"
     " AS chars, coalesce(nullif(level, 0), -1) AS lv, CAST(round(CAST(timestamp AS DECIMAL(20,3)) / 1000, 1) AS DOUBLE)"
     " AS secs, timestamp // 60000 % 60 AS minute, service || '@' || host AS sender,"
     " CASE WHEN level >= 4 THEN 'bad' ELSE 'ok' END AS grade, ifnull(TRY_CAST(substr(service, 5) AS INT), 0) AS n,"
     " CAST(instr(raw, 'by') AS INTEGER) AS pos, upper(replace(host, 'host', 'h')) AS h, message LIKE 'err%' AS is_err,"
     " abs(level - 2) AS dist, CASE WHEN level = 0 THEN NULL ELSE id / level END AS per_level FROM logs")
_add("sql_increase_snippet",
     "SELECT hour, SUM(inc) AS increase FROM (SELECT timestamp div 3600000 * 3600000 AS hour, labels,"
     f" MAX(value) - MIN(value) AS inc FROM {{metrics}} WHERE name = 'error_total' AND timestamp > {AS_OF} - 86400000"
     " GROUP BY hour, labels) GROUP BY hour ORDER BY hour",
     f"WITH {td.SQL_METRICS} SELECT hour, SUM(inc) AS increase FROM (SELECT timestamp // 3600000 * 3600000 AS hour, labels,"
     f" MAX(value) - MIN(value) AS inc FROM metrics WHERE name = 'error_total' AND timestamp > {AS_OF} - 86400000"
     " GROUP BY hour, labels) GROUP BY hour")
_add("sql_pivot_snippet",
     "SELECT timestamp div 600000 * 600000 AS bucket, ROUND(AVG(CASE WHEN service = 'svc-0' THEN value END), 8) AS service_a,"
     " ROUND(AVG(CASE WHEN service = 'svc-1' THEN value END), 8) AS service_b FROM {metrics} WHERE name = 'view_value'"
     " GROUP BY bucket ORDER BY bucket",
     f"WITH {td.SQL_METRICS} SELECT timestamp // 600000 * 600000 AS bucket, ROUND(AVG(CASE WHEN service = 'svc-0' THEN value"
     " END), 8) AS service_a, ROUND(AVG(CASE WHEN service = 'svc-1' THEN value END), 8) AS service_b FROM metrics"
     " WHERE name = 'view_value' GROUP BY 1")
_add("sql_absence_rule",
     "SELECT 'silent' AS alert, COUNT(*) AS senders FROM (SELECT DISTINCT service, host FROM {logs}) s WHERE NOT EXISTS"
     f" (SELECT 1 FROM {{metrics}} m WHERE m.service = s.service AND m.host = s.host AND m.timestamp > {AS_OF - HOUR_MS})",
     f"WITH {td.SQL_BOTH} SELECT 'silent' AS alert, COUNT(*) AS senders FROM (SELECT DISTINCT service, host FROM logs) s"
     " WHERE NOT EXISTS (SELECT 1 FROM metrics m WHERE m.service = s.service AND m.host = s.host"
     f" AND m.timestamp > {AS_OF - HOUR_MS})")
_add("sql_in_subquery_or",
     "SELECT service, COUNT(*) AS lines FROM {logs} l WHERE id IN (SELECT id div 2 FROM {metrics} WHERE name = 'error_value'"
     " AND value > 50) OR level = 3 GROUP BY service",
     f"WITH {td.SQL_BOTH} SELECT service, COUNT(*) AS lines FROM logs l WHERE id IN (SELECT id // 2 FROM metrics"
     " WHERE name = 'error_value' AND value > 50) OR level = 3 GROUP BY service")
_add("sql_named_window",
     "SELECT service, day, lines, lines - LAG(lines) OVER w AS change, SUM(lines) OVER w AS so_far FROM"
     f" (SELECT service, timestamp div {DAY_MS} AS day, COUNT(*) AS lines FROM {{logs}} GROUP BY service, day)"
     " WINDOW w AS (PARTITION BY service ORDER BY day)",
     f"WITH {td.SQL_LOGS} SELECT service, day, lines, lines - LAG(lines) OVER w AS change, CAST(SUM(lines) OVER w AS BIGINT)"
     f" AS so_far FROM (SELECT service, timestamp // {DAY_MS} AS day, COUNT(*) AS lines FROM logs GROUP BY 1, 2)"
     " WINDOW w AS (PARTITION BY service ORDER BY day)")

_add("sql_window_functions",
     "SELECT service, day, lines, ROW_NUMBER() OVER w AS pos, LEAD(lines) OVER w AS following,"
     " FIRST_VALUE(lines) OVER w AS first_day, LAST_VALUE(lines) OVER (PARTITION BY service ORDER BY day ROWS BETWEEN"
     " UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_day, NTILE(3) OVER w AS third, SUM(lines) OVER (PARTITION BY"
     " service ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three_days FROM"
     f" (SELECT service, timestamp div {DAY_MS} AS day, COUNT(*) AS lines FROM {{logs}} GROUP BY service, day)"
     " WINDOW w AS (PARTITION BY service ORDER BY day)",
     f"WITH {td.SQL_LOGS} SELECT service, day, lines, CAST(ROW_NUMBER() OVER w AS INTEGER) AS pos, LEAD(lines) OVER w AS"
     " following, FIRST_VALUE(lines) OVER w AS first_day, LAST_VALUE(lines) OVER (PARTITION BY service ORDER BY day ROWS"
     " BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_day, CAST(NTILE(3) OVER w AS INTEGER) AS third,"
     " CAST(SUM(lines) OVER (PARTITION BY service ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT)"
     f" AS three_days FROM (SELECT service, timestamp // {DAY_MS} AS day, COUNT(*) AS lines FROM logs GROUP BY 1, 2)"
     " WINDOW w AS (PARTITION BY service ORDER BY day)")

HEADLINE = ["sql_scalar_functions"]
