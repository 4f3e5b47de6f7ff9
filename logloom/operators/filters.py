"""Log filters: an immutable description of what the viewer is looking at, compiled to predicates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.timeexpr import between, between_condition, newer_condition, newer_than
from logloom.operators.paging import keyset_page
from logloom.schemas import DAY_MS, ERROR, HOUR_MS, WARN

QUICK_COLUMNS = ("service", "host", "level")


@dataclass(frozen=True)
class LogFilter:
    """Equalities on service, host and level, an optional time window, and free predicates.

    Setting a column again replaces its value, so repeated clicks never stack or contradict.
    """

    equal: tuple[tuple[str, object], ...] = ()
    window: tuple[int, int] | None = None
    since: int | None = None
    preds: tuple[Column, ...] = field(default=(), compare=False)

    def with_(self, **equal) -> LogFilter:
        values = dict(self.equal)
        for column, value in equal.items():
            if column not in QUICK_COLUMNS:
                raise ValueError(f"unsupported filter column {column!r}")
            if column == "level":
                try:
                    value = int(value)
                except (TypeError, ValueError):
                    raise ValueError(f"level filter value {value!r} is not a number") from None
            values[column] = value
        return replace(self, equal=tuple(values.items()))

    def where(self, pred: Column) -> LogFilter:
        return replace(self, preds=(*self.preds, pred))

    def within(self, from_ms: int, to_ms: int) -> LogFilter:
        """Lock to an inclusive window; it applies before any grouping."""
        return replace(self, window=(from_ms, to_ms))

    def newer(self, cutoff_ms: int) -> LogFilter:
        return replace(self, since=cutoff_ms)

    @property
    def is_empty(self) -> bool:
        return not (self.equal or self.preds or self.window or self.since is not None)

    def condition(self, columns: Sequence[str]) -> Column:
        """The filter as one predicate over a frame with these columns, dates of a stored table included."""
        parts = [F.col(column) == F.lit(value) for column, value in self.equal] + list(self.preds)
        if self.since is not None:
            parts.append(newer_condition(columns, self.since))
        if self.window:
            parts.append(between_condition(columns, *self.window))
        return reduce(and_, parts, F.lit(True))

    def apply(self, logs: DataFrame) -> DataFrame:
        for column, value in self.equal:
            logs = logs.filter(F.col(column) == F.lit(value))
        for pred in self.preds:
            logs = logs.filter(pred)
        if self.since is not None:
            logs = newer_than(logs, self.since)
        if self.window:
            logs = between(logs, *self.window)
        return logs


def drill_in(logs: DataFrame, base: LogFilter, column: str, value, rows: int = 50) -> DataFrame:
    """The lines behind one aggregated row: same filter plus the clicked value, the oldest first."""
    return base.with_(**{column: value}).apply(logs).orderBy("timestamp", "id").limit(rows)


def point_lookup(logs: DataFrame, log_id: int, timestamp: int | None = None) -> DataFrame:
    """One line by id. With its time, which every listing shows beside the id, only its day is read."""
    if timestamp is not None:
        logs = between(logs, timestamp, timestamp)
    return logs.filter(F.col("id") == log_id)


# Presets: what the home page links to.
def triage(as_of: int) -> LogFilter:
    return LogFilter().where(F.col("level") >= ERROR).newer(as_of - HOUR_MS)


def warnings_and_up() -> LogFilter:
    return LogFilter().where(F.col("level") >= WARN)


def service_logs(service: str) -> LogFilter:
    return LogFilter().with_(service=service)


def service_errors(service: str, as_of: int) -> LogFilter:
    return service_logs(service).where(F.col("level") >= ERROR).newer(as_of - DAY_MS)


def newest(logs: DataFrame, n: int = 100, days: Sequence[dt.date] | None = None) -> DataFrame:
    return keyset_page(logs, size=n, days=days)
