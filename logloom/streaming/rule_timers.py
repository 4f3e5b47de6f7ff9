"""Alert rules as keyed state with timers: nothing is rewritten per batch but the keys that change.

Matching lines come as a stream keyed by rule. A rule's lines are counted in the spans between its checks; when the
watermark passes the end of a span, the rule's timer judges it: more lines than the threshold make it fire, unless it
fired less than its cooldown ago. The result does not depend on how lines are dealt into batches or ordered within
the lateness. A rule that has nothing left to judge keeps its last firing until the cooldown is over and then no
state at all; that is also how removed rules leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logloom.operators.rules import MIN_INTERVAL_MS

FIRING = "alert_id long, fired_at long, lines long"

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RuleTimers(StatefulProcessor):
    """State of a rule: lines by the end of their span, the rule as last seen, and when it fired last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getMapState("spans", "due long", "lines long")
        self.rule = handle.getValueState("rule", "cooldown_ms long, threshold long")
        self.fired = handle.getValueState("fired", "fired_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        counts: dict[int, int] = {}
        last = None
        for r in rows:
            counts[r.due] = counts.get(r.due, 0) + r.lines
            last = r
        self.rule.update((last.cooldown_ms, last.threshold))
        for due, n in counts.items():
            if self.spans.containsKey((due,)):
                n += self.spans.getValue((due,))[0]
            else:
                self.handle.registerTimer(due)
            self.spans.updateValue((due,), (n,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        cooldown, threshold = self.rule.get()
        fired = self.fired.get()[0] if self.fired.exists() else None
        if self.spans.containsKey((now,)):
            lines = self.spans.getValue((now,))[0]
            self.spans.removeKey((now,))
            if lines > threshold and (fired is None or now - fired >= cooldown):
                fired = now
                self.fired.update((now,))
                yield Row(alert_id=key[0], fired_at=now, lines=lines)
        if not any(True for _ in self.spans.keys()):
            if fired is None or now - fired >= cooldown:
                self.rule.clear()
                self.fired.clear()
            else:
                self.handle.registerTimer(fired + cooldown)

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Timers need a state store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's lines by rule and span, with the newest time among them."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(["id", "due", "cooldown_ms", "threshold"]).aggregate([("timestamp", "count"), ("timestamp", "max")])
        yield from t.select(["id", "due", "cooldown_ms", "threshold", "timestamp_count", "timestamp_max"]).rename_columns(
            ["id", "due", "cooldown_ms", "threshold", "lines", "newest"]).to_batches()


def firings(lines: DataFrame, rules: DataFrame, lateness: str) -> DataFrame:
    """A stream of firings (alert_id, fired_at, lines) from a stream of lines and a table of rules.

    ``rules`` has id, service, min_level, check_interval_ms, cooldown_ms, threshold and enabled; a line counts for
    the enabled rules of its service from ``min_level`` on. A disabled or removed rule gets no lines any more: its
    open spans are still judged, then its state ends. Lines without a time, service or level match nothing; a line
    within ``lateness`` is counted, a later one need not be. Lines are added up by rule and span where they are
    read, so that a rule that matches most lines brings its task a few rows.
    """
    interval = F.greatest("check_interval_ms", F.lit(MIN_INTERVAL_MS)).cast("long")
    asked = rules.filter("enabled").select(
        F.col("id").cast("long").alias("_rule"), F.col("service").alias("_service"), F.col("min_level").alias("_least"),
        F.col("cooldown_ms").cast("long").alias("cooldown_ms"), F.col("threshold").cast("long").alias("threshold"), interval.alias("_interval"))
    met = lines.select("timestamp", F.col("service").alias("_of"), F.col("level").alias("_level")).filter("timestamp is not null").join(
        asked, (F.col("_of") == F.col("_service")) & (F.col("_level") >= F.col("_least")))
    due = (F.floor(F.col("timestamp") / F.col("_interval")) + 1) * F.col("_interval")
    rows = met.select(F.col("_rule").alias("id"), due.cast("long").alias("due"), "cooldown_ms", "threshold", "timestamp")
    rows = rows.mapInArrow(_added_up, "id long, due long, cooldown_ms long, threshold long, lines long, newest long")
    timed = rows.withColumn("_ts", F.timestamp_millis("newest")).withWatermark("_ts", lateness)
    return timed.groupBy("id").transformWithState(statefulProcessor=RuleTimers(), outputStructType=FIRING, outputMode="Append",
                                                  timeMode="eventTime")
