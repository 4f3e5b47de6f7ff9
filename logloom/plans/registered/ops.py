"""Registered queries for alert rules, retention and live views."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions.timeexpr import newer_than
from logloom.operators import index_segments, retention, rules as R, search as S, sinks
from logloom.operators.filters import LogFilter
from logloom.plans import summaries
from logloom.schemas import DAY_MS, ERROR, HOUR_MS, LOGS
from logloom.session import scratch_path
from logloom.sources import testdata as td
from logloom.sources.files import spread
from logloom.sources.lines import parse_payloads
from logloom.streaming import late_rows, live, rule_loop, rule_timers

AS_OF = td.AS_OF
LOGS_SQL = f"WITH {td.SQL_LOGS}"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


# --- rules: one per (service, host), with the state its history implies ------------------

def _senders(spark, sf_dir):
    """Rules and state as the senders' own history gives them."""
    e = td.events(spark, sf_dir)
    n = F.col("n")
    senders = (e.groupBy("service", "host").agg(F.count("*").alias("n"), F.min("user_id").alias("u"),
                                               F.max("timestamp").alias("newest")))
    senders = senders.withColumn("id", F.substring("service", 5, 1).cast("long") * 10 + F.substring("host", 6, 1).cast("long"))
    rules = senders.select(
        "id", "service", F.concat_ws("/", "service", "host").alias("name"),
        (F.lit(HOUR_MS) * (n % 3 + 1)).cast("long").alias("check_interval_ms"),
        (F.lit(6 * HOUR_MS) * (n % 4)).cast("long").alias("cooldown_ms"), (n % 7 != 0).alias("enabled"),
        F.lit(ERROR).alias("min_level"), F.lit(4 * HOUR_MS).cast("long").alias("window_ms"),
        (n % 5).alias("threshold"))
    state = senders.filter(F.col("host") != "host-2").select(
        "id", (F.lit(AS_OF) - n % 5 * HOUR_MS).alias("last_checked_at"),
        F.when(n % 2 == 0, F.lit(AS_OF) - n % 9 * HOUR_MS).alias("last_fired_at"),
        (n % 2 == 0).alias("currently_firing"),
        F.when(n % 3 == 0, "query failed: earlier").alias("last_error"),
        F.when(n % 3 == 0, F.lit(AS_OF) - 7 * HOUR_MS).alias("last_error_at"))
    return rules, state


SENDERS = (f"WITH {td.SQL_LOGS}, s AS (SELECT service, host, COUNT(*) AS n,"
           " CAST(substr(service, 5, 1) AS BIGINT) * 10 + CAST(substr(host, 6, 1) AS BIGINT) AS id"
           " FROM ev GROUP BY service, host),"
           f" rules AS (SELECT id, service, concat(service, '/', host) AS name, {HOUR_MS} * (n % 3 + 1) AS check_interval_ms,"
           f" {6 * HOUR_MS} * (n % 4) AS cooldown_ms, n % 7 <> 0 AS enabled, n % 5 AS threshold FROM s),"
           f" state AS (SELECT id, {AS_OF} - n % 5 * {HOUR_MS} AS last_checked_at, CASE WHEN n % 2 = 0 THEN {AS_OF}"
           f" - n % 9 * {HOUR_MS} END AS last_fired_at, n % 2 = 0 AS currently_firing, CASE WHEN n % 3 = 0 THEN"
           f" 'query failed: earlier' END AS last_error, CASE WHEN n % 3 = 0 THEN {AS_OF} - {7 * HOUR_MS} END"
           " AS last_error_at FROM s WHERE host <> 'host-2'),"
           " due AS (SELECT r.* FROM rules r LEFT JOIN state USING (id) WHERE enabled AND (last_checked_at IS NULL"
           f" OR {AS_OF} - last_checked_at >= check_interval_ms)),"
           " hits AS (SELECT d.id, d.service, COUNT(*) AS lines FROM due d JOIN logs l ON l.service = d.service"
           f" WHERE l.level >= 4 AND l.timestamp > {AS_OF} - {4 * HOUR_MS} AND l.timestamp <= {AS_OF}"
           " GROUP BY d.id, d.service, d.threshold HAVING COUNT(*) > d.threshold),"
           # deliveries to every third rule fail
           " judged AS (SELECT r.id, r.cooldown_ms, st.* EXCLUDE (id), d.id IS NOT NULL AS evaluated,"
           " h.id IS NOT NULL AS firing, h.service, h.lines, h.id IS NOT NULL AND (last_fired_at IS NULL OR"
           f" {AS_OF} - last_fired_at >= r.cooldown_ms) AS notify, r.id % 3 <> 0 AS delivered"
           " FROM rules r LEFT JOIN state st USING (id) LEFT JOIN due d ON d.id = r.id LEFT JOIN hits h ON h.id = r.id)")


def _tick(spark, sf_dir):
    rules, state = _senders(spark, sf_dir)
    logs = td.logs(spark, sf_dir)
    due = R.due(rules, state, AS_OF)
    matches = R.threshold_matches(due, logs, AS_OF)
    outcomes = R.grouped_outcomes(due, matches, [F.desc("lines"), F.col("service")])
    outcomes = outcomes.withColumn("notify_error", F.when(F.col("id") % 3 == 0, "HTTP 500"))
    return rules, state, outcomes


_add("alert_due", lambda s, d: R.due(*_senders(s, d), AS_OF).select("id", "name"), f"{SENDERS} SELECT id, name FROM due")
_add("alert_eval_step", lambda s, d: R.step(*_tick(s, d), AS_OF)[0],
     f"{SENDERS} SELECT id, CASE WHEN evaluated THEN {AS_OF} ELSE last_checked_at END AS last_checked_at,"
     f" CASE WHEN notify AND delivered THEN {AS_OF} ELSE last_fired_at END AS last_fired_at,"
     " CASE WHEN evaluated THEN firing ELSE COALESCE(currently_firing, false) END AS currently_firing,"
     " CASE WHEN NOT evaluated THEN last_error WHEN notify AND NOT delivered THEN 'notification failed: HTTP 500' END"
     f" AS last_error, CASE WHEN NOT evaluated THEN last_error_at WHEN notify AND NOT delivered THEN {AS_OF} END"
     " AS last_error_at FROM judged")
_add("alert_firings", lambda s, d: R.step(*_tick(s, d), AS_OF)[1],
     f"{SENDERS} SELECT id AS alert_id, {AS_OF} AS fired_at, concat('[{{\"lines\":', lines, ',\"service\":\"', service,"
     " '\"}]') AS matched_rows, delivered AS notification_sent FROM judged WHERE notify".replace("{{", "{"))
_add("alert_to_notify", lambda s, d: R.to_notify(*_tick(s, d), AS_OF),
     f"{SENDERS} SELECT id, CAST(1 AS BIGINT) AS n_rows, concat('1 matching row(s)', chr(10), 'service=', service,"
     " ' lines=', lines) AS message FROM judged WHERE notify")


def _error_matches(spark, sf_dir):
    rules, _ = _senders(spark, sf_dir)
    errors = newer_than(td.logs(spark, sf_dir), AS_OF - 10 * DAY_MS).filter(F.col("level") >= ERROR)
    matched = errors.select(
        (F.substring("service", 5, 1).cast("long") * 10 + F.substring("host", 6, 1).cast("long")).alias("id"),
        "timestamp", "message", F.repeat("raw", 10).alias("raw"),
        F.when(F.col("host") == "host-1", F.col("host")).alias("origin"))
    return R.grouped_outcomes(rules, matched, [F.desc("timestamp"), F.desc("message")])


MATCHED = (f"{LOGS_SQL}, m AS (SELECT CAST(substr(service, 5, 1) AS BIGINT) * 10 + CAST(substr(host, 6, 1) AS BIGINT)"
           " AS id, timestamp, message, concat(left(repeat(raw, 10), 200), CASE WHEN length(raw) > 20 THEN '…' ELSE ''"
           f" END) AS raw, repeat(raw, 10) AS whole, CASE WHEN host = 'host-1' THEN host END AS origin FROM logs WHERE level >= 4"
           f" AND timestamp > {AS_OF - 10 * DAY_MS}), n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY"
           " timestamp DESC, message DESC) AS rn, COUNT(*) OVER (PARTITION BY id) AS c FROM m)")
_add("alert_firing_payload", lambda s, d: _error_matches(s, d).select("id", "n_rows", "matched"),
     f"{MATCHED} SELECT id, CAST(MAX(c) AS BIGINT) AS n_rows, concat('[', string_agg(concat('{{\"message\":\"', message,"
     " '\",\"origin\":', CASE WHEN origin IS NULL THEN 'null' ELSE concat('\"', origin, '\"') END, ',\"raw\":\"',"
     " replace(raw, '\"', '\\\"'), '\",\"timestamp\":', timestamp, '}') , ',' ORDER BY rn) FILTER (WHERE rn <= 20), ']')"
     " AS matched FROM n GROUP BY id".replace("{{", "{"))
_add("alert_message", lambda s, d: _error_matches(s, d).select("id", "message"),
     f"{MATCHED} SELECT id, concat(MAX(c), ' matching row(s)', chr(10), string_agg(concat(left(concat('timestamp=',"
     " timestamp, ' message=', message, ' raw=', whole, CASE WHEN origin IS NULL THEN '' ELSE concat(' origin=', origin) END), 200),"
     " '…'), chr(10) ORDER BY rn) FILTER (WHERE rn <= 5),"
     " CASE WHEN MAX(c) > 5 THEN concat(chr(10), '… and ', MAX(c) - 5, ' more') ELSE '' END) AS message FROM n GROUP BY id")


def _single_outcome(spark, sf_dir):
    rows = newer_than(td.logs(spark, sf_dir), AS_OF - DAY_MS).filter(F.col("level") >= ERROR).select("id", "service")
    out = R.outcome(7, rows.withColumnRenamed("id", "line"), [F.desc("line")])
    return out.select("id", "n_rows", "matched")


_add("alert_rule_outcome", _single_outcome,
     f"{LOGS_SQL}, m AS (SELECT id AS line, service, ROW_NUMBER() OVER (ORDER BY id DESC) AS rn, COUNT(*) OVER () AS c"
     f" FROM logs WHERE level >= 4 AND timestamp > {AS_OF - DAY_MS}) SELECT CAST(7 AS BIGINT) AS id, CAST(MAX(c) AS BIGINT)"
     " AS n_rows, concat('[', string_agg(concat('{\"line\":', line, ',\"service\":\"', service, '\"}'), ',' ORDER BY rn)"
     " FILTER (WHERE rn <= 20), ']') AS matched FROM m")


_add("alert_rule_long",
     lambda s, d: R.outcome(8, td.logs(s, d).select(F.col("id").alias("line")), [F.desc("line")], audit_rows=3).select(
         "id", "n_rows", "matched", F.regexp_extract("message", "and ([0-9]+) more", 1).cast("long").alias("more")),
     f"{LOGS_SQL} SELECT CAST(8 AS BIGINT) AS id, COUNT(*) AS n_rows, concat('[', (SELECT string_agg(concat('{{\"line\":', id, '}}'),"
     " ',' ORDER BY id DESC) FROM (SELECT id FROM logs ORDER BY id DESC LIMIT 3)), ']') AS matched, COUNT(*) - 5 AS more FROM logs"
     .replace("{{", "{").replace("}}", "}"))


# --- retention --------------------------------------------------------------------------

NOW = AS_OF - 7 * HOUR_MS  # the boundary falls inside a day


def _expired(spark, sf_dir):
    path, index = scratch_path(spark, "logs"), scratch_path(spark, "index")
    logs = td.logs(spark, sf_dir)
    stored = logs.repartitionByRange("dt", "service", "timestamp")
    stored.write.partitionBy("dt").parquet(path)
    S.write_index(S.build_index(spread(logs)), index)
    gone = retention.expire(spark, path, retention.retention_days("10", 30), NOW, index_path=index)
    return spark.read.parquet(path), spark.read.parquet(index), gone


def _keep(spark, sf_dir):
    logs, _, gone = _expired(spark, sf_dir)
    return logs.groupBy(F.col("dt").cast("string").alias("day")).agg(
        F.count("*").alias("lines"), F.min("timestamp").alias("oldest"), F.lit(gone).cast("long").alias("deleted"))


_CUT = retention.threshold_ms(10, NOW)
_add("retention_keep", _keep,
     f"{LOGS_SQL} SELECT strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS day, COUNT(*) AS lines, MIN(timestamp)"
     f" AS oldest, (SELECT COUNT(*) FROM logs WHERE timestamp < {_CUT}) AS deleted FROM logs WHERE timestamp >= {_CUT}"
     " GROUP BY 1")


def _consistent(spark, sf_dir):
    logs, index, _ = _expired(spark, sf_dir)
    return retention.index_check(index, logs)


_add("retention_index_orphans", _consistent,
     f"{LOGS_SQL} SELECT COUNT(*) AS indexed, CAST(0 AS BIGINT) AS orphans FROM logs WHERE timestamp >= {_CUT}")


def _swept_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    td.metrics(spark, sf_dir).write.partitionBy("dt").parquet(path)
    gone = retention.expire(spark, path, 10, NOW)
    return (spark.read.parquet(path).groupBy("name")
            .agg(F.count("*").alias("n"), F.min("timestamp").alias("oldest"), F.lit(gone).cast("long").alias("deleted")))


_add("retention_metrics", _swept_metrics,
     f"WITH {td.SQL_METRICS} SELECT name, COUNT(*) AS n, MIN(timestamp) AS oldest, (SELECT COUNT(*) FROM metrics WHERE"
     f" timestamp < {_CUT}) AS deleted FROM metrics WHERE timestamp >= {_CUT} GROUP BY name")


def _summaries(spark, sf_dir):
    """Summaries that followed three appends and a sweep."""
    metrics, path, held = td.metrics(spark, sf_dir), scratch_path(spark, "metrics"), scratch_path(spark, "summaries")
    for k in range(3):
        metrics.filter(F.pmod(F.xxhash64("timestamp", "name"), F.lit(3)) == k).write.mode("append").partitionBy("dt").parquet(path)
        summaries.follow(spark, path, held)
    retention.expire(spark, path, 10, NOW)
    summaries.follow(spark, path, held)
    return held


_SWEPT_METRICS = f"WITH {td.SQL_METRICS}, kept AS (SELECT * FROM metrics WHERE timestamp >= {_CUT})"

_add("catalog_incremental", lambda spark, sf_dir: summaries.metrics_catalog(spark, _summaries(spark, sf_dir)),
     f"{_SWEPT_METRICS} SELECT name, CASE WHEN least = 1 THEN 'gauge' ELSE 'counter' END AS type, service, points, last_seen,"
     " CASE WHEN least = 0 THEN concat('increase(', name, ') per 1h last 24h') ELSE concat('avg(', name, ') per 10m last 24h')"
     " END AS suggested FROM (SELECT name, service, MIN(type) AS least, COUNT(*) AS points, MAX(timestamp) AS last_seen"
     " FROM kept GROUP BY name, service)")
_add("label_keys_incremental", lambda spark, sf_dir: summaries.filter_keys(spark, _summaries(spark, sf_dir), "error_value"),
     f"{_SWEPT_METRICS} SELECT 'service' AS key, 0 AS pos UNION ALL SELECT 'host', 1 UNION ALL SELECT key, 2 FROM"
     " (SELECT DISTINCT unnest(json_keys(labels)) AS key FROM kept WHERE name = 'error_value' AND labels IS NOT NULL)")
_add("label_values_incremental", lambda spark, sf_dir: summaries.filter_values(spark, _summaries(spark, sf_dir), "error_value", "k"),
     f"{_SWEPT_METRICS} SELECT DISTINCT json_extract_string(labels, '$.k') AS v FROM kept WHERE name = 'error_value'"
     " AND json_extract_string(labels, '$.k') <> ''")


def _interrupted(spark, sf_dir):
    """A sweep whose log half is done and whose index half is not, and then the next sweep."""
    path, index = scratch_path(spark, "logs"), scratch_path(spark, "index")
    logs = td.logs(spark, sf_dir)
    logs.write.partitionBy("dt").parquet(path)
    S.write_index(S.build_index(spread(logs)), index)
    first = retention.expire(spark, path, 10, NOW)
    second = retention.expire(spark, path, 10, NOW, index_path=index)
    return retention.index_check(spark.read.parquet(index), spark.read.parquet(path)).withColumns(
        {"first_deleted": F.lit(first).cast("long"), "then_deleted": F.lit(second).cast("long")})


_add("retention_interrupted", _interrupted,
     f"{LOGS_SQL} SELECT COUNT(*) FILTER (WHERE timestamp >= {_CUT}) AS indexed, CAST(0 AS BIGINT) AS orphans,"
     f" COUNT(*) FILTER (WHERE timestamp < {_CUT}) AS first_deleted, CAST(0 AS BIGINT) AS then_deleted FROM logs")


def _swept_firings(spark, sf_dir):
    """Every error line as a firing, appended as audit rows and swept."""
    path = scratch_path(spark, "firings")
    errors = td.logs(spark, sf_dir).filter(F.col("level") >= ERROR)
    sinks.append_firings(errors.select(F.col("id").alias("alert_id"), F.col("timestamp").alias("fired_at"),
                                       F.to_json(F.array("message")).alias("matched_rows"),
                                       (F.col("host") != "host-1").alias("notification_sent")), path)
    gone = retention.expire(spark, path, 10, NOW, ts="fired_at")
    return (spark.read.parquet(path).groupBy("notification_sent")
            .agg(F.count("*").alias("n"), F.min("fired_at").alias("oldest"), F.max("matched_rows").alias("last_rows"),
                 F.lit(gone).cast("long").alias("deleted")))


_add("retention_firings", _swept_firings,
     f"{LOGS_SQL}, e AS (SELECT * FROM logs WHERE level >= 4) SELECT host <> 'host-1' AS notification_sent, COUNT(*) AS n,"
     " MIN(timestamp) AS oldest, MAX(concat('[\"', message, '\"]')) AS last_rows, (SELECT COUNT(*) FROM e WHERE"
     f" timestamp < {_CUT}) AS deleted FROM e WHERE timestamp >= {_CUT} GROUP BY 1")


# --- live -------------------------------------------------------------------------------

def _event_stream(spark, sf_dir):
    """``events`` read as a file stream."""
    schema = td.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _log_stream(spark, sf_dir):
    raw = _event_stream(spark, sf_dir)
    return raw.select(
        F.col("event_id").alias("id"), F.expr(td._MS).alias("timestamp"), (F.expr(td._MS) + 37).alias("ingested_at"),
        F.expr("CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2"
               " WHEN 'view' THEN 1 ELSE 0 END").alias("level"),
        F.expr("concat('svc-', cast(user_id % 4 as string))").alias("service"),
        F.expr("concat('host-', cast(user_id % 3 as string))").alias("host"),
        F.expr("concat(event_type, ' by user ', cast(user_id as string))").alias("message"),
        F.col("props").alias("parsed"),
        F.expr("concat(event_type, ' by user ', cast(user_id as string), ' ', props)").alias("raw"))


def _run(spark, stream, sink, out, mode="append"):
    live.run(stream, scratch_path(spark, "checkpoint"), sink(out), mode).awaitTermination()
    return out


def _tail(spark, sf_dir):
    spec = S.all_of(S.phrase("errors"), S.match_spec("user"))
    stream = live.tail(_log_stream(spark, sf_dir), LogFilter().with_(service="svc-2"), spec)
    out = _run(spark, stream, live.append_batches, scratch_path(spark, "tail"))
    return spark.read.schema(LOGS).parquet(out).select("id", "timestamp", "level", "service", "raw")


_add("stream_tail_filtered", _tail,
     f"{LOGS_SQL} SELECT id, timestamp, level, service, raw FROM logs WHERE service = 'svc-2'"
     " AND regexp_matches(raw, '\\berror') AND regexp_matches(raw, '\\buser')")


def _tail_or(spark, sf_dir):
    stream = live.tail(_log_stream(spark, sf_dir), spec=S.phrase("purchase"), pred=F.col("host") == "host-0", op="or")
    out = _run(spark, stream, live.append_batches, scratch_path(spark, "tail"))
    return spark.read.schema(LOGS).parquet(out).groupBy("service", "host").agg(F.count("*").alias("lines"))


_add("stream_tail_or", _tail_or,
     f"{LOGS_SQL} SELECT service, host, COUNT(*) AS lines FROM logs WHERE level = 3 OR host = 'host-0'"
     " GROUP BY service, host")


def _tail_filter_or(spark, sf_dir):
    stream = live.tail(_log_stream(spark, sf_dir), LogFilter().with_(service="svc-1"), S.phrase("purchase"), op="or")
    out = _run(spark, stream, live.append_batches, scratch_path(spark, "tail"))
    return spark.read.schema(LOGS).parquet(out).groupBy("service", "level").agg(F.count("*").alias("lines"))


_add("stream_tail_filter_or", _tail_filter_or,
     f"{LOGS_SQL} SELECT service, level, COUNT(*) AS lines FROM logs WHERE level = 3 OR service = 'svc-1' GROUP BY service, level")
_add("stream_tail_all",
     lambda s, d: s.read.schema(LOGS).parquet(_run(s, live.tail(_log_stream(s, d)), live.append_batches, scratch_path(s, "tail")))
     .groupBy("level").agg(F.count("*").alias("lines"), F.max("id").alias("last")),
     f"{LOGS_SQL} SELECT level, COUNT(*) AS lines, MAX(id) AS last FROM logs GROUP BY level")


def _restarted(spark, sf_dir):
    """The stream stored twice, the second time from a new checkpoint: batch numbers repeat, rows and ids must not be lost."""
    stored = scratch_path(spark, "stored")
    for _ in range(2):
        _run(spark, _log_stream(spark, sf_dir).drop("id"), live.store_logs, stored)
    return spark.read.parquet(stored).groupBy("service").agg(F.count("*").alias("lines"), F.count_distinct("id").alias("ids"))


_add("stream_restart", _restarted,
     f"{LOGS_SQL} SELECT service, 2 * COUNT(*) AS lines, 2 * COUNT(*) AS ids FROM logs GROUP BY service")


def _live_agg(spark, sf_dir):
    stream = (_log_stream(spark, sf_dir).groupBy("service")
              .agg(F.count("*").alias("total"), F.count_if(F.col("level") >= ERROR).alias("errors")))
    out = _run(spark, stream, live.refresh, scratch_path(spark, "agg"), "complete")
    return live.latest(spark, out)


_add("stream_agg", _live_agg,
     f"{LOGS_SQL} SELECT service, COUNT(*) AS total, COUNT(*) FILTER (WHERE level >= 4) AS errors FROM logs GROUP BY service")


def _windowed(spark, sf_dir):
    stream = live.tumbling(_log_stream(spark, sf_dir), "6 hours", ["service"], [F.count("*").alias("lines")],
                           "2 hours", received="ingested_at")
    out = _run(spark, stream, live.append_batches, scratch_path(spark, "windows"))
    return spark.read.parquet(out).drop("batch")


_add("stream_window", _windowed,
     f"{LOGS_SQL}, b AS (SELECT timestamp // {6 * HOUR_MS} * {6 * HOUR_MS} AS bucket, service, COUNT(*) AS lines FROM logs"
     f" GROUP BY 1, 2) SELECT bucket, service, lines FROM b WHERE bucket + {6 * HOUR_MS} <="
     f" (SELECT MAX(timestamp) - {2 * HOUR_MS} FROM logs)")


# Four batches, each with rows of the whole month: but for the first, nearly all rows are late.
_LATE_KEYS = ["service", "level"]


def _late_aggs():
    return [F.count_distinct("host").alias("hosts"), F.max("id").alias("last")]


def _late_path(spark, sf_dir):
    src, path, checkpoint = (scratch_path(spark, x) for x in ("arrivals", "late_buckets", "checkpoint"))
    logs = td.logs(spark, sf_dir).select("id", "timestamp", "level", "service", "host")
    for i in range(4):
        logs.filter(F.pmod(F.xxhash64("id"), F.lit(4)) == i).write.mode("append").parquet(src)
        live.run(spark.readStream.schema(logs.schema).parquet(src), checkpoint,
                 late_rows.follow(path, 6 * HOUR_MS, _LATE_KEYS, _late_aggs(), 2 * HOUR_MS)).awaitTermination()
    return path


def _late_window(spark, sf_dir):
    path = _late_path(spark, sf_dir)
    return late_rows.cells(spark, path, _LATE_KEYS).unionByName(
        late_rows.open_cells(spark, path, 6 * HOUR_MS, _LATE_KEYS, _late_aggs(), 2 * HOUR_MS))


_add("stream_window_late", _late_window,
     f"{LOGS_SQL} SELECT timestamp // {6 * HOUR_MS} * {6 * HOUR_MS} AS bucket, service, level, COUNT(*) AS n_rows,"
     " COUNT(DISTINCT host) AS hosts, MAX(id) AS last FROM logs GROUP BY 1, 2, 3")


def _ring(spark, sf_dir):
    out = _run(spark, _log_stream(spark, sf_dir), live.ring, scratch_path(spark, "ring"))
    return live.latest(spark, out).orderBy("id")


_add("stream_recent", _ring,
     f"{LOGS_SQL} SELECT id, timestamp, ingested_at, level, service, host, message, parsed, raw FROM logs"
     " ORDER BY id DESC LIMIT 1000")


def _parsed_stream(spark, sf_dir):
    """Raw lines parsed on the stream, shown live and stored, from one read of each batch."""
    raw = _event_stream(spark, sf_dir).select(
        F.expr("concat('svc-', cast(user_id % 4 as string))").alias("service"),
        F.expr("concat('host-', cast(user_id % 3 as string))").alias("host"),
        F.expr("concat('{\"level\":\"', CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'info' END, '\",\"ts\":',"
               f" cast({td._MS} as string), ',\"msg\":\"', event_type, '\"}}')").alias("payload"),
        F.expr(td._MS).alias("received_at"))
    shown, stored = scratch_path(spark, "shown"), scratch_path(spark, "stored")
    both = live.fan_out(live.append_batches(shown), live.store_logs(stored))
    live.run(parse_payloads(raw), scratch_path(spark, "checkpoint"), both).awaitTermination()
    a = spark.read.parquet(shown).groupBy("level").agg(F.count("*").alias("shown"))
    b = spark.read.parquet(stored).groupBy("level").agg(F.count_distinct("id").alias("stored"),
                                                        F.max("timestamp").alias("newest"))
    return a.join(b, "level")


_add("stream_parse_store", _parsed_stream,
     f"{LOGS_SQL} SELECT CASE WHEN level = 4 THEN 4 ELSE 2 END AS level, COUNT(*) AS shown, COUNT(*) AS stored,"
     " MAX(timestamp) AS newest FROM logs GROUP BY 1")


# A stream of three ten-day batches, one tick each.
_SPAN = 10 * DAY_MS
_START = AS_OF - 30 * DAY_MS


def _rule_stream(spark, sf_dir):
    src, path, checkpoint = (scratch_path(spark, x) for x in ("batches", "rules", "checkpoint"))
    logs = td.logs(spark, sf_dir).select("id", "timestamp", "level", "service", "host")
    rules, _ = _senders(spark, sf_dir)
    rules = rules.select("id", "name", "check_interval_ms", F.lit(15 * DAY_MS).cast("long").alias("cooldown_ms"),
                         F.lit(True).alias("enabled"))

    def clock(df):
        newest = df.agg(F.max("timestamp")).first()[0]
        return _START + ((newest - _START) // _SPAN + 1) * _SPAN

    def matches(df, now):
        rid = F.substring("service", 5, 1).cast("long") * 10 + F.substring("host", 6, 1).cast("long")
        return (df.withColumn("id", rid).groupBy("id")
                .agg(F.count("*").alias("lines"), F.count_if(F.col("level") >= ERROR).alias("errors"))
                .filter(F.col("errors") * 5 > F.col("lines")))

    for i in range(3):  # each slice arrives, in as many files as it may be, and is one tick
        part = logs.filter(F.col("timestamp").between(_START + i * _SPAN, _START + (i + 1) * _SPAN - 1))
        part.write.mode("append").parquet(src)
        live.run(spark.readStream.schema(logs.schema).parquet(src), checkpoint,
                 rule_loop.ticks(rules, matches, path, clock)).awaitTermination()
    return rule_loop.firings(spark, path).select("alert_id", "fired_at", "matched_rows", "notification_sent")


_add("stream_rule_firings", _rule_stream,
     f"{LOGS_SQL}, c AS (SELECT CAST(substr(service, 5, 1) AS BIGINT) * 10 + CAST(substr(host, 6, 1) AS BIGINT) AS id,"
     f" (timestamp - {_START}) // {_SPAN} AS k, COUNT(*) AS lines, COUNT(*) FILTER (WHERE level >= 4) AS errors FROM logs"
     " GROUP BY 1, 2), h AS (SELECT * FROM c WHERE errors * 5 > lines), f0 AS (SELECT id FROM h WHERE k = 0),"
     " f1 AS (SELECT id FROM h WHERE k = 1 AND id NOT IN (SELECT id FROM f0)),"
     " f2 AS (SELECT id FROM h WHERE k = 2 AND id NOT IN (SELECT id FROM f1))"
     f" SELECT h.id AS alert_id, {_START} + (k + 1) * {_SPAN} AS fired_at, concat('[{{\"errors\":', errors, ',\"lines\":', lines,"
     " '}]') AS matched_rows, true AS notification_sent FROM h WHERE (k = 0 AND id IN (SELECT id FROM f0)) OR"
     " (k = 1 AND id IN (SELECT id FROM f1)) OR (k = 2 AND id IN (SELECT id FROM f2))".replace("{{", "{"))


# Rules as keyed state: two per service, judged every twelve hours, quiet for four days after a firing.
_CHECK, _QUIET, _LATE = 12 * HOUR_MS, 4 * DAY_MS, HOUR_MS


def _timed_rules(spark, sf_dir):
    rule_timers.use_rocksdb(spark)
    src, out, checkpoint = (scratch_path(spark, x) for x in ("timed", "fired", "checkpoint"))
    logs = td.logs(spark, sf_dir).select("id", "timestamp", "level", "service")
    rules = logs.select("service").distinct().select(
        "service", F.explode(F.array(F.lit(3), F.lit(4))).alias("min_level")).select(
        (F.substring("service", 5, 1).cast("long") * 10 + F.col("min_level")).alias("id"), "service", "min_level",
        F.lit(_CHECK).alias("check_interval_ms"), F.lit(_QUIET).alias("cooldown_ms"), (F.col("min_level") - 3).alias("threshold"),
        F.lit(True).alias("enabled"))
    for i in range(3):
        part = logs.filter(F.col("timestamp").between(_START + i * _SPAN, _START + (i + 1) * _SPAN - 1))
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(logs.schema).parquet(src)
        live.run(rule_timers.firings(stream, rules, f"{_LATE} milliseconds"), checkpoint, live.append_batches(out)).awaitTermination()
    return spark.read.parquet(out).select("alert_id", "fired_at", "lines")


_add("stream_rule_timers", _timed_rules,
     f"WITH RECURSIVE {td.SQL_LOGS}, r AS (SELECT DISTINCT service, min_level, CAST(substr(service, 5, 1) AS BIGINT) * 10 + min_level AS id"
     f" FROM logs, (VALUES (3), (4)) v(min_level)), s AS (SELECT r.id, min_level - 3 AS threshold, (timestamp // {_CHECK} + 1) * {_CHECK} AS due,"
     " COUNT(*) AS lines FROM logs JOIN r ON logs.service = r.service AND level >= min_level GROUP BY ALL),"
     f" h AS (SELECT id, due, lines FROM s WHERE lines > threshold AND due <= (SELECT MAX(timestamp) - {_LATE} FROM logs)),"
     " f AS (SELECT id, MIN(due) AS due FROM h GROUP BY id UNION ALL SELECT f.id, MIN(h.due) FROM f JOIN h ON h.id = f.id"
     f" AND h.due >= f.due + {_QUIET} GROUP BY f.id)"
     " SELECT CAST(id AS BIGINT) AS alert_id, due AS fired_at, lines FROM f JOIN h USING (id, due)")


def _followed_index(spark, sf_dir):
    """Lines stored in five batches, an index that follows them, and lines swept twice meanwhile."""
    src, path, checkpoint = (scratch_path(spark, x) for x in ("lines", "segments", "checkpoint"))
    lines = td.search_corpus(spark, sf_dir)
    n = lines.count()
    for i in range(5):
        lines.filter(F.expr(f"id * 5 div {n}") == i).write.mode("append").parquet(src)
        stream = spark.readStream.schema(lines.schema).parquet(src)
        live.run(stream, checkpoint, index_segments.follow(path, "lines")).awaitTermination()
        if i == 2:
            index_segments.remove(spark.read.parquet(src).filter("service = 'src4'"), path)
    index_segments.remove(spark.read.parquet(src).filter("host = 'fr'"), path)
    return S.search(index_segments.opened(spark, path), S.match_spec("of AND ther*"))


_add("fts_streamed_index", _followed_index,
     f"WITH {td.SQL_CORPUS}, w AS (SELECT id, service, host, regexp_extract_all(strip_accents(lower(raw)), '[\\p{{L}}\\p{{N}}]+') AS ws FROM corpus)"
     .replace("\\\\", "\\") +
     " SELECT id FROM w WHERE list_contains(ws, 'of') AND len(list_filter(ws, lambda x: x LIKE 'ther%')) > 0 AND coalesce(host, '') <> 'fr'"
     " AND NOT (coalesce(service, '') = 'src4' AND id * 5 // (SELECT COUNT(*) FROM corpus) <= 2)")

HEADLINE = ["alert_eval_step", "retention_keep", "stream_tail_filtered", "stream_window"]
