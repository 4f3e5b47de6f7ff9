"""Rules evaluated as a stream goes by: one tick per micro-batch, state kept in a written table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.timeexpr import event_date
from logloom.operators import rules as R
from logloom.streaming.live import _publish, batch_name, latest, replace_batch


def state(spark: SparkSession, path: str, other_than: str | None = None) -> DataFrame:
    found = latest(spark, f"{path}/state", other_than)
    return spark.createDataFrame([], R.STATE) if found is None else found


def firings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/firings").drop("batch", "dt")


def ticks(rules: DataFrame, matches: Callable[[DataFrame, int], DataFrame], path: str,
          clock: Callable[[DataFrame], int], deliver: Callable[[DataFrame], DataFrame] | None = None, run: str | None = None
          ) -> Callable[[DataFrame, int], None]:
    """Batch sink that runs one tick: due rules, their matches, the next state, the audit rows.

    ``matches(batch, now)`` gives matched rows with their rule ``id``; ``deliver`` sends the
    messages at once and returns ``id, notify_error`` as data, not as a plan that would send again. A tick writes its audit rows before its state
    and both under its batch id, so running it again replaces them.
    """
    def each(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        now = clock(df)
        name = batch_name(df, batch_id, run)
        before = state(spark, path, other_than=name)
        due = R.due(rules, before, now)
        found = matches(df, now).join(due.select("id"), "id", "left_semi")
        outcomes = R.grouped_outcomes(due, found, [F.col(c) for c in found.columns if c != "id"]).persist()
        judged = outcomes
        if deliver is not None:
            answers = deliver(R.to_notify(rules, before, outcomes, now))
            judged = outcomes.drop("notify_error").join(answers, "id", "left")
        after, fired = R.step(rules, before, judged, now)
        dated = fired.withColumn("dt", event_date("fired_at")).withColumn("batch", F.lit(name))
        replace_batch(dated, f"{path}/firings", ["dt", "batch"])
        _publish(after, f"{path}/state", name)
        outcomes.unpersist()
    return each
