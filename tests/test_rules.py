"""Alert rules over time."""

import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import rules as R
from logloom.streaming import live, rule_timers

HOUR = 3_600_000
NOW = 1_755_000_000_000


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame([(1, "errors", 60_000, HOUR, True)],
                                 "id long, name string, check_interval_ms long, cooldown_ms long, enabled boolean")


def empty(spark):
    return spark.createDataFrame([], R.STATE)


def seen(spark, n, notify_error=None, error=None):
    return spark.createDataFrame([(1, n, "[]", "m", error, notify_error)],
                                 "id long, n_rows long, matched string, message string, error string, notify_error string")


def tick(spark, rules, state, outcome, now):
    state2, firings = R.step(rules, state, outcome, now)
    row = state2.first()
    return spark.createDataFrame([row], R.STATE), row, firings.collect()


def test_fire_cooldown_clear(spark, rules):
    state, row, fired = tick(spark, rules, empty(spark), seen(spark, 3), NOW)
    assert row.currently_firing and row.last_fired_at == NOW and [f.notification_sent for f in fired] == [True]
    state, row, fired = tick(spark, rules, state, seen(spark, 3), NOW + 60_000)
    assert row.currently_firing and row.last_fired_at == NOW and not fired
    state, row, fired = tick(spark, rules, state, seen(spark, 0), NOW + 120_000)
    assert not row.currently_firing and row.last_fired_at == NOW and not fired
    state, row, fired = tick(spark, rules, state, seen(spark, 1), NOW + HOUR)
    assert row.last_fired_at == NOW + HOUR and len(fired) == 1


def test_failed_delivery_is_retried(spark, rules):
    state, row, fired = tick(spark, rules, empty(spark), seen(spark, 1, "HTTP 500"), NOW)
    assert row.last_fired_at is None and row.last_error == "notification failed: HTTP 500" and row.last_error_at == NOW
    assert [f.notification_sent for f in fired] == [False]
    state, row, fired = tick(spark, rules, state, seen(spark, 1), NOW + 1000)
    assert row.last_fired_at == NOW + 1000 and row.last_error is None and row.last_error_at is None and len(fired) == 1


def test_query_error_keeps_state(spark, rules):
    state, _, _ = tick(spark, rules, empty(spark), seen(spark, 1), NOW)
    _, row, fired = tick(spark, rules, state, seen(spark, None, error="query failed: no such column"), NOW + HOUR)
    assert row.currently_firing and row.last_error == "query failed: no such column" and not fired
    assert row.last_checked_at == NOW + HOUR and row.last_fired_at == NOW


def test_not_evaluated_keeps_everything(spark, rules):
    state, before, _ = tick(spark, rules, empty(spark), seen(spark, 1, "down"), NOW)
    state2, _ = R.step(rules, state, seen(spark, 1).filter("false"), NOW + HOUR)
    assert state2.first() == before


def test_due(spark):
    rules = spark.createDataFrame([(1, 60_000, True), (2, 60_000, False), (3, 1000, True), (4, 60_000, True)],
                                  "id long, check_interval_ms long, enabled boolean")
    state = spark.createDataFrame([(1, NOW - 59_999), (3, NOW - 29_999)], "id long, last_checked_at long")
    assert [r.id for r in R.due(rules, state, NOW).collect()] == [4]
    assert sorted(r.id for r in R.due(rules, state, NOW + 1).collect()) == [1, 3, 4]


def test_payload_and_message(spark):
    rows = spark.range(30).select(
        F.col("id").alias("n"), F.when(F.col("id") == 1, F.lit(None)).otherwise(F.repeat(F.lit("é"), 150)).alias("text"),
        (F.col("id") * 500_000.0).alias("value"))
    out = R.outcome(9, rows, [F.col("n")]).first()
    assert out.n_rows == 30
    matched = json.loads(out.matched)
    assert len(matched) == 20 and list(matched[0]) == ["n", "text", "value"]
    assert matched[1]["text"] is None and matched[0]["text"] == "é" * 100 + "…"
    lines = out.message.split("\n")
    assert lines[0] == "30 matching row(s)" and lines[2] == "n=1 value=500000" and lines[-1] == "… and 25 more"
    assert lines[3].startswith("n=2 text=éé") and lines[3].endswith("…") and len(lines) == 7
    assert R.outcome(9, rows.filter("n < 0"), [F.col("n")]).first()[:2] == (9, 0)


def test_message_float_form(spark):
    rows = spark.createDataFrame([(1234567.0,)], "v double")
    assert R.outcome(1, rows, [F.col("v")]).first().message == "1 matching row(s)\nv=1.234567e+06"


def test_loop_retries_a_failed_delivery(spark, tmp_path, rules):
    """Ticks over batches: a failed message is sent again, and a repeated tick changes nothing."""
    from logloom.streaming import rule_loop

    path, sent = str(tmp_path), []

    def deliver(messages):
        got = [(r.id, r.message) for r in messages.collect()]
        sent.extend(got)
        error = "HTTP 503" if len(sent) == 1 else None
        return spark.createDataFrame([(i, error) for i, _ in got], "id long, notify_error string")

    def batch(ts):
        return spark.createDataFrame([(1, ts)], "id long, line long")

    each = rule_loop.ticks(rules, lambda df, now: df, path, lambda df: df.first().line, deliver)
    each(batch(NOW), 0)
    each(batch(NOW + 60_000), 1)
    each(batch(NOW + 60_000), 1)
    each(batch(NOW + 120_000), 2)
    state = rule_loop.state(spark, path).first()
    assert state.last_fired_at == NOW + 60_000 and state.currently_firing and state.last_error is None
    fired = sorted((r.fired_at, r.notification_sent) for r in rule_loop.firings(spark, path).collect())
    assert fired == [(NOW, False), (NOW + 60_000, True)]
    assert sent[0] == (1, f"1 matching row(s)\nline={NOW}")


def judged(lines, rules, end):
    """Firings of rules over all lines: spans in order, each against the one that fired last."""
    out = set()
    for r in rules:
        spans, last = {}, None
        for t, service, level in lines:
            if service == r["service"] and level >= r["min_level"]:
                due = (t // r["check_interval_ms"] + 1) * r["check_interval_ms"]
                spans[due] = spans.get(due, 0) + 1
        for due, n in sorted(spans.items()):
            if due <= end and n > r["threshold"] and (last is None or due - last >= r["cooldown_ms"]):
                out.add((r["id"], due, n))
                last = due
    return out


def test_rule_timers(spark, tmp_path):
    """Lines in any order within the lateness and in several batches; a removed rule's state goes when its cooldown is over."""
    rule_timers.use_rocksdb(spark)
    minute, rng = 60_000, random.Random(12)
    rules = [{"id": 1, "service": "a", "min_level": 3, "check_interval_ms": minute, "cooldown_ms": 5 * minute, "threshold": 1, "enabled": True},
             {"id": 2, "service": "a", "min_level": 0, "check_interval_ms": 2 * minute, "cooldown_ms": 0, "threshold": 4, "enabled": True},
             {"id": 3, "service": "b", "min_level": 0, "check_interval_ms": minute, "cooldown_ms": 9 * minute, "threshold": 0, "enabled": True},
             {"id": 4, "service": "b", "min_level": 0, "check_interval_ms": minute, "cooldown_ms": 0, "threshold": 0, "enabled": False}]
    lines = sorted((rng.randrange(40 * minute), rng.choice("aab"), rng.randrange(6)) for _ in range(300))
    lines = [x for x in lines if x[1] == "a" or x[0] < 10 * minute]  # nothing of the other service after a quarter
    src, out, checkpoint = (str(tmp_path / x) for x in ("src", "out", "checkpoint"))
    table = spark.createDataFrame(rules)
    for k in range(4):
        part = [x for x in lines if k * 10 * minute <= x[0] < (k + 1) * 10 * minute]
        rng.shuffle(part)
        rows = [(t, s, n) for t, s, n in part] + [(None, "a", 5), ((k + 1) * 10 * minute - 1, None, 5)]
        spark.createDataFrame(rows, "timestamp long, service string, level int").write.mode("append").parquet(src)
        stream = spark.readStream.schema("timestamp long, service string, level int").parquet(src)
        live.run(rule_timers.firings(stream, table, f"{minute} milliseconds"), checkpoint, live.append_batches(out)).awaitTermination()
    newest = max(t for t, s, n in lines)
    got = {(r.alert_id, r.fired_at, r.lines) for r in spark.read.parquet(out).collect()}
    assert got == judged(lines, [r for r in rules if r["enabled"]], newest - minute) and {1, 2, 3} == {g[0] for g in got}
    state = spark.read.format("statestore").option("stateVarName", "fired").load(checkpoint)
    assert {r.key.id for r in state.collect()} <= {1, 2}
