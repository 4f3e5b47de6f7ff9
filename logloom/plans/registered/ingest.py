"""Registered queries for parsing and writing.

Payload texts are made from ``events`` row by row, then parsed; the SQL side states what each
must become.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import values as V
from logloom.operators import sinks
from logloom.schemas import DAY_MS
from logloom.session import scratch_path
from logloom.sources import testdata as td
from logloom.sources.files import read_logs, read_metrics, spread
from logloom.sources.lines import parse_payloads
from logloom.sources.otlp import otlp_json_to_metrics, rejected as otlp_rejected
from logloom.sources.prometheus import prom_text_to_metrics, rejected as prom_rejected

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
EV = f"WITH {td._SQL_EVENTS}"
OUT = ["timestamp", "ingested_at", "level", "service", "host", "message", "parsed", "raw"]


def _add(name, fn, sql):
    QUERIES[name] = fn
    ORACLE[name] = sql


# Texts that read the same in both engines.
WHO = "concat(event_type, ' by user ', cast(user_id as string))"
JSON_LINE = f"""concat('{{"severity":', CASE event_type WHEN 'error' THEN '"ERROR"' WHEN 'purchase' THEN '40'
  WHEN 'signup' THEN '"Information"' WHEN 'view' THEN '1' ELSE '"odd"' END,
  CASE event_type WHEN 'error' THEN concat(',"ts":', cast(timestamp as string))
  WHEN 'purchase' THEN concat(',"time":', cast(timestamp div 1000 as string))
  WHEN 'signup' THEN concat(',"date":', cast(timestamp as string), '000')
  WHEN 'view' THEN concat(',"@timestamp":"', STAMP_T, 'Z"') ELSE '' END,
  ',"msg":"', {WHO}, '","props":', props, '}}')"""
SECOND = "timestamp div 1000 * 1000"
JSON_TS = (f"CASE event_type WHEN 'error' THEN timestamp WHEN 'purchase' THEN {SECOND} WHEN 'signup' THEN timestamp"
           f" WHEN 'view' THEN {SECOND} ELSE timestamp + 5000 END")
JSON_LEVEL = ("CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'view' THEN 1"
              " ELSE 2 END")
STATUS = "CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 ELSE 200 END"
IP = "concat('10.0.', cast(user_id % 250 as string), '.7')"
BYTES = "cast(user_id * 3 as string)"
ACCESS_LINE = (f"concat({IP}, ' - ', CASE WHEN user_id % 2 = 0 THEN '-' ELSE concat('u', cast(user_id as string)) END,"
               f" ' [', STAMP_CLF, ' +0000] \"GET /', event_type, '/', cast(user_id as string), ' HTTP/1.1\" ',"
               f" cast({STATUS} as string), ' ', {BYTES}, ' \"-\" \"agent/1\"')")
ACCESS_LEVEL = "CASE event_type WHEN 'error' THEN 4 WHEN 'signup' THEN 3 ELSE 2 END"
ACCESS_MSG = f"concat('GET /', event_type, '/', cast(user_id as string), ' ', cast({STATUS} as string))"
ACCESS_PARSED = (f"""concat('{{"bytes":', {BYTES}, ',"ip":"', {IP}, '","method":"GET","path":"/', event_type, '/',
  cast(user_id as string), '","proto":"HTTP/1.1","status":', cast({STATUS} as string),
  CASE WHEN user_id % 2 = 0 THEN '' ELSE concat(',"user":"u', cast(user_id as string), '"') END,
  ',"user_agent":"agent/1"}}')""")
PLAIN_LINE = (f"concat(STAMP_S, ' ', CASE event_type WHEN 'error' THEN 'Error:' WHEN 'purchase' THEN 'WARNING'"
              f" WHEN 'signup' THEN '[debug]' WHEN 'view' THEN 'informal' ELSE 'PANIC!' END, ' ', {WHO})")
PLAIN_LEVEL = ("CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 1 WHEN 'view' THEN 4"
               " ELSE 5 END")
# "view by user" holds no level word, so it falls back to INFO
PLAIN_LEVEL = PLAIN_LEVEL.replace("WHEN 'view' THEN 4", "WHEN 'view' THEN 2")
ENVELOPE = f"""concat('[{{"date":', cast(timestamp div 1000 as string), '.5,"log":"', {WHO}, '\\\\n","container_name":"/',
  service, '-c"}}, {{"date":', cast(timestamp as string), ',"kernel":"', event_type, '"}}]')"""


def _spark(text: str) -> str:
    ts = "timestampadd(MICROSECOND, timestamp * 1000, timestamp_ntz'1970-01-01 00:00:00')"
    return (text.replace("STAMP_T", f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss\")")
            .replace("STAMP_S", f"date_format({ts}, 'yyyy-MM-dd HH:mm:ss')")
            .replace("STAMP_CLF", f"date_format({ts}, 'dd/MMM/yyyy:HH:mm:ss')"))


def _duck(text: str) -> str:
    ts = "make_timestamp(timestamp * 1000)"
    return (text.replace("STAMP_T", f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')")
            .replace("STAMP_S", f"strftime({ts}, '%Y-%m-%d %H:%M:%S')")
            .replace("STAMP_CLF", f"strftime({ts}, '%d/%b/%Y:%H:%M:%S')")
            .replace(" div ", " // ").replace("as string", "as varchar"))


def _payloads(spark, sf_dir, text: str):
    return spread(td.events(spark, sf_dir)).select("service", "host", F.expr(_spark(text)).alias("payload"),
                                           (F.col("timestamp") + 5000).alias("received_at"))


def _parsed(text: str):
    return lambda spark, sf_dir: parse_payloads(_payloads(spark, sf_dir, text)).select(*OUT)


def _expect(ts, level, message, parsed, raw, service="service"):
    return _duck(f"{EV} SELECT {ts} AS timestamp, timestamp + 5000 AS ingested_at, {level} AS level,"
                 f" {service} AS service, host, {message} AS message, {parsed} AS parsed, {raw} AS raw FROM ev")


_add("parse_lines_json", _parsed(JSON_LINE), _expect(JSON_TS, JSON_LEVEL, WHO, JSON_LINE, JSON_LINE))
_add("parse_lines_clf", _parsed(ACCESS_LINE), _expect(SECOND, ACCESS_LEVEL, ACCESS_MSG, ACCESS_PARSED, ACCESS_LINE))
_add("parse_lines_plain", _parsed(PLAIN_LINE), _expect(SECOND, PLAIN_LEVEL, PLAIN_LINE, "cast(null as string)", PLAIN_LINE))
_add("parse_fluentbit", _parsed(ENVELOPE),
     _expect("timestamp // 1000 * 1000 + 500", "CASE event_type WHEN 'error' THEN 4 ELSE 2 END", WHO,
             "cast(null as string)", WHO, "concat(service, '-c')")
     + " UNION ALL " + _expect("timestamp", "2", "cast(null as string)", "r", "r").removeprefix(EV).replace(
         "FROM ev", "FROM (SELECT *, concat('{\"date\":', cast(timestamp as varchar), ',\"kernel\":\"', event_type, '\"}')"
                    " AS r FROM ev)"))

MIXED = f"concat({JSON_LINE}, '\\r\\n\\n  \\n', {ACCESS_LINE}, '\\n  ', {PLAIN_LINE}, '  \\n')"


def _mixed(spark, sf_dir):
    return (parse_payloads(_payloads(spark, sf_dir, MIXED)).groupBy("service", "level")
            .agg(F.count("*").alias("lines"), F.count("parsed").alias("structured"),
                 F.sum(F.length("raw")).alias("chars"), F.max("timestamp").alias("newest")))


def _mixed_sql():
    parts = [_duck(f"SELECT service, {lv} AS level, {ts} AS timestamp, {raw} AS raw, {st} AS structured FROM ev")
             for lv, ts, raw, st in ((JSON_LEVEL, JSON_TS, JSON_LINE, 1), (ACCESS_LEVEL, SECOND, ACCESS_LINE, 1),
                                     (PLAIN_LEVEL, SECOND, PLAIN_LINE, 0))]
    return (f"{EV} SELECT service, level, COUNT(*) AS lines, CAST(SUM(structured) AS BIGINT) AS structured,"
            " CAST(SUM(length(raw)) AS BIGINT) AS chars, MAX(timestamp) AS newest FROM ("
            + " UNION ALL ".join(parts) + ") GROUP BY service, level")


_add("parse_mixed_payload", _mixed, _mixed_sql())

_SHIFT = f"CASE user_id % 3 WHEN 0 THEN {2 * DAY_MS} WHEN 1 THEN -{4000 * DAY_MS} ELSE {DAY_MS - 1} END"
_add("clamp_times",
     lambda s, d: td.events(s, d).select("event_id", F.expr(f"timestamp + ({_SHIFT})").alias("t"), "timestamp")
     .select("event_id", V.clamp_time(F.col("t"), F.col("timestamp")).alias("clamped")),
     f"{EV} SELECT event_id, CASE user_id % 3 WHEN 2 THEN timestamp + {DAY_MS - 1} ELSE timestamp END AS clamped FROM ev")

# metrics payloads
OTLP = """concat('{"resourceMetrics":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"', service,
  '"}},{"key":"host.name","value":{"stringValue":"', host, '"}}]},"scopeMetrics":[{"metrics":[',
  '{"name":"', event_type, '_value","gauge":{"dataPoints":[{"timeUnixNano":"', cast(timestamp as string),
  '000000","asDouble":', cast(value as string), ',"attributes":[{"key":"user","value":{"intValue":"',
  cast(user_id as string), '"}},{"key":"kind","value":{"stringValue":"', event_type, '"}}]}]}},',
  '{"name":"', event_type, '_total","sum":{"isMonotonic":', CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END,
  ',"dataPoints":[{"asInt":"', cast(event_id as string), '"},{"asInt":"1","flags":1}]}},',
  '{"name":"', event_type, '_time","histogram":{"dataPoints":[{"timeUnixNano":"', cast(timestamp as string),
  '999999","count":"', cast(user_id as string), '"', CASE WHEN user_id % 3 = 0 THEN '' ELSE
  concat(',"sum":', cast(value as string)) END, ',"bucketCounts":["1"]}]}}]}]}]}')"""
OTLP_LABELS = "concat('{\"kind\":\"', event_type, '\",\"user\":\"', cast(user_id as string), '\"}')"
SAMPLE = ["timestamp", "name", "type", "value", "service", "host", "labels"]
_NONE = "CAST(NULL AS VARCHAR)"


def _otlp(spark, sf_dir):
    return otlp_json_to_metrics(_payloads(spark, sf_dir, OTLP)).select(*SAMPLE)


def _otlp_rows(kinds):
    rows = {
        "gauge": f"SELECT timestamp, concat(event_type, '_value') AS name, 1 AS type, value, service, host,"
                 f" {OTLP_LABELS} AS labels FROM ev",
        "sum": "SELECT timestamp + 5000 AS timestamp, concat(event_type, '_total') AS name, CASE WHEN user_id % 2 = 0"
               f" THEN 0 ELSE 1 END AS type, CAST(event_id AS DOUBLE) AS value, service, host, {_NONE} AS labels FROM ev",
        "hsum": "SELECT timestamp, concat(event_type, '_time_sum') AS name, 0 AS type, value, service, host,"
                f" {_NONE} AS labels FROM ev WHERE user_id % 3 <> 0",
        "hcount": "SELECT timestamp, concat(event_type, '_time_count') AS name, 0 AS type, CAST(user_id AS DOUBLE)"
                  f" AS value, service, host, {_NONE} AS labels FROM ev"}
    return _duck(f"{EV} " + " UNION ALL ".join(rows[k] for k in kinds))


_add("otlp_to_metrics", _otlp, _otlp_rows(["gauge", "sum", "hsum", "hcount"]))


def _broken_otlp(spark, sf_dir):
    """Payloads with an empty scope before the real one, cut off, or followed by other text."""
    df = _payloads(spark, sf_dir, OTLP)
    late = F.replace("payload", F.lit('"scopeMetrics":['), F.lit('"scopeMetrics":[{"scope":{}},'))
    cut = F.substring("payload", F.lit(1), F.length("payload") - 2)
    broken = F.when(F.col("host") == "host-0", late).when(F.col("host") == "host-1", cut).otherwise(F.concat("payload", F.lit(" tail")))
    return df.withColumn("payload", broken)


_add("otlp_empty_scope", lambda s, d: otlp_json_to_metrics(_broken_otlp(s, d)).select(*SAMPLE),
     f"SELECT * FROM ({_otlp_rows(['gauge', 'sum', 'hsum', 'hcount'])}) WHERE host = 'host-0'")
_add("otlp_rejected",
     lambda s, d: otlp_rejected(_broken_otlp(s, d)).groupBy("service", "host").agg(F.count("*").alias("n")),
     f"WITH {td._SQL_EVENTS} SELECT service, host, COUNT(*) AS n FROM ev WHERE host <> 'host-0' GROUP BY service, host")
_add("histogram_downcast", lambda s, d: _otlp(s, d).filter(F.col("name").rlike("_time_(sum|count)$")),
     _otlp_rows(["hsum", "hcount"]))

PROM = """concat('# HELP ', event_type, '_total Events.\\n# TYPE ', event_type, '_total counter\\n', event_type,
  '_total{user="u', cast(user_id as string), '",kind="', event_type, '"} ', cast(event_id as string), '\\n# TYPE ',
  event_type, '_load gauge\\n', event_type, '_load ', cast(value as string), ' ', cast(timestamp as string),
  '\\n# TYPE ', event_type, '_time summary\\n', event_type, '_time{quantile="0.5"} 3\\n', event_type, '_time_sum ',
  cast(value as string), '\\n', event_type, '_time_count 7\\nuntyped_thing 1e3\\n')"""


def _prom(spark, sf_dir):
    df = _payloads(spark, sf_dir, PROM).withColumnsRenamed({"payload": "text", "received_at": "ts"})
    return prom_text_to_metrics(df).select(*SAMPLE)


_add("prom_to_metrics", _prom, _duck(
    f"{EV} SELECT timestamp + 5000 AS timestamp, concat(event_type, '_total') AS name, 0 AS type, CAST(event_id AS DOUBLE)"
    " AS value, service, host, concat('{\"kind\":\"', event_type, '\",\"user\":\"u', cast(user_id as string), '\"}')"
    f" AS labels FROM ev UNION ALL SELECT timestamp, concat(event_type, '_load'), 1, value, service, host, {_NONE} FROM ev"
    f" UNION ALL SELECT timestamp + 5000, concat(event_type, '_time_sum'), 0, value, service, host, {_NONE} FROM ev"
    f" UNION ALL SELECT timestamp + 5000, concat(event_type, '_time_count'), 0, 7.0, service, host, {_NONE} FROM ev"
    f" UNION ALL SELECT timestamp + 5000, 'untyped_thing', 1, 1000.0, service, host, {_NONE} FROM ev"))




def _bad_scrapes(spark, sf_dir):
    df = _payloads(spark, sf_dir, PROM).withColumnsRenamed({"payload": "text", "received_at": "ts"})
    line = F.when(F.col("host") == "host-0", F.lit("m{bad} 1\n")).when(F.col("host") == "host-1", F.lit('m{a="x",} 1\n')).otherwise(F.lit(""))
    return df.withColumn("text", F.concat("text", line))


_add("prom_bad_labels",
     lambda s, d: prom_rejected(_bad_scrapes(s, d)).groupBy("service", "host").agg(F.count("*").alias("n")),
     f"WITH {td._SQL_EVENTS} SELECT service, host, COUNT(*) AS n FROM ev WHERE host = 'host-0' GROUP BY service, host")


# sinks: written to the shared folder, then read back with the declared schema
EACH = 4 << 20


def _by_id(stored, *keys):
    """A stored table dealt out by its keys and ids, in parts of about ``EACH`` bytes of it.

    Ids are all different, so that counting them where they are read reduces nothing and holds a whole file's ids at once.
    """
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return stored.repartition(max(1, -(-size // EACH)), *keys, "id")


def _stored_logs(spark, sf_dir):
    path = scratch_path(spark, "logs")
    sinks.append_logs(parse_payloads(_payloads(spark, sf_dir, JSON_LINE)), path)
    return (_by_id(read_logs(spark, path), "dt", "service").groupBy("dt", "service")
            .agg(F.count("*").alias("lines"), F.count_distinct("id").alias("ids"), F.max("timestamp").alias("newest"))
            .select(F.col("dt").cast("string").alias("day"), "service", "lines", "ids", "newest"))


_add("sink_logs_append", _stored_logs,
     _duck(f"{EV}, l AS (SELECT service, {JSON_TS} AS t FROM ev) SELECT strftime(make_timestamp(t * 1000), '%Y-%m-%d')"
           " AS day, service, COUNT(*) AS lines, COUNT(*) AS ids, MAX(t) AS newest FROM l GROUP BY 1, 2"))


def _stored_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    sinks.append_metrics(_prom(spark, sf_dir), path)
    return (_by_id(read_metrics(spark, path), "name", "type").groupBy("name", "type")
            .agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count("labels").alias("labelled"),
                 F.round(F.sum("value"), 2).alias("total")))


_add("sink_metrics_append", _stored_metrics,
     f"SELECT name, type, COUNT(*) AS n, COUNT(*) AS ids, COUNT(labels) AS labelled, ROUND(SUM(value), 2) AS total"
     f" FROM ({ORACLE['prom_to_metrics']}) GROUP BY name, type")


def _csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    sinks.export_csv(td.metrics(spark, sf_dir, only="view_value")
                     .select("id", "value", F.when(F.col("host") != "host-1", F.col("host")).alias("host")), path)
    return spark.read.text(path).filter(F.col("value") != "id,value,host").withColumnRenamed("value", "line")


_add("export_csv", _csv,
     f"WITH {td.SQL_METRICS} SELECT concat(id, ',', regexp_replace(CAST(value AS VARCHAR), '\\.0$', ''), ',',"
     " CASE WHEN host <> 'host-1' THEN host ELSE '' END) AS line FROM metrics WHERE name = 'view_value'")


def _csv_odd(spark, sf_dir):
    """Values with quotes, commas, line ends and outer blanks, written and read by standard rules."""
    path = scratch_path(spark, "csv")
    odd = td.logs(spark, sf_dir).select("id", F.col("parsed"), F.concat(F.lit('  a "b", c\n'), "message", F.lit("  ")).alias("text"))
    sinks.export_csv(odd, path)
    read = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("id long, parsed string, text string"))
    return read.csv(path)


_add("export_csv_odd", _csv_odd,
     f"WITH {td.SQL_LOGS} SELECT id, parsed, concat('  a \"b\", c', chr(10), message, '  ') AS text FROM logs")


def _json(spark, sf_dir):
    path = scratch_path(spark, "json")
    sinks.export_json(td.logs(spark, sf_dir).groupBy("service").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("level") > 9, F.col("id"))).alias("none")), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


_add("export_json", _json,
     f"WITH {td.SQL_LOGS} SELECT concat('{{\"service\":\"', service, '\",\"n\":', COUNT(*), ',\"none\":null}}') AS line"
     " FROM logs GROUP BY service")

HEADLINE = ["parse_mixed_payload", "otlp_to_metrics", "prom_to_metrics", "sink_logs_append"]
