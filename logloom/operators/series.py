"""Time-series verbs over the metrics table.

Every verb filters first (name, labels, window), then aggregates with partial aggregation,
so a hot series costs one small row per map task and bucket. Relative windows end open:
``last`` keeps everything after ``as_of - last``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.timeexpr import between, bucket, duration_ms, newer_than, now_ms
from logloom.schemas import COUNTER, SERIES_KEYS

#: The default look-back and the widest pivot.
DEFAULT_LAST = "24h"
PIVOT_SERVICES = 6

_PLAIN = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
_ZERO_VERBS = {"increase", "rate", "count"}


def fills_with_zero(verb: str) -> bool:
    """Whether a missing bucket of this verb means "nothing happened" rather than "unknown"."""
    return verb in _ZERO_VERBS


def label_equals(key: str, value: str, nested: bool = False) -> Column:
    """``key=value`` on a sample: service and host are columns, any other key is a label.

    A dotted key names one flat label; ``nested=True`` reads it as a path instead.
    """
    if key in ("service", "host"):
        return F.col(key) == value
    path = f"$.{key}" if nested else f"$['{key}']"
    return F.get_json_object("labels", path) == value


def select_samples(metrics: DataFrame, metric: str, filters: Mapping[str, str] | None = None,
                   last: str | None = None, window: tuple[int, int] | None = None,
                   as_of: int | None = None) -> DataFrame:
    df = metrics.filter(F.col("name") == metric)
    for key, value in (filters or {}).items():
        df = df.filter(label_equals(key, value))
    if window:
        return between(df, *window)
    end = now_ms() if as_of is None else as_of
    return newer_than(df, end - duration_ms(last or DEFAULT_LAST))


def metric_services(metrics: DataFrame, metric: str, limit: int) -> DataFrame:
    """The first services that ever reported a metric, alphabetically."""
    return (metrics.filter(F.col("name") == metric).select("service").distinct()
            .orderBy("service").limit(limit))


def _pivot_services(metrics: DataFrame, metric: str, services: Sequence[str] | None, most: int) -> list[str]:
    if services is None:
        # the names become column names, so this many at most reach the driver
        services = [r.service for r in metric_services(metrics, metric, most).collect()]
    if not services:
        raise ValueError(f"no data for metric {metric!r} yet, so there are no services to compare")
    return list(services)


def verb(metrics: DataFrame, name: str, metric: str, *, filters: Mapping[str, str] | None = None,
         per: str | None = None, last: str | None = None, by_service: bool = False,
         services: Sequence[str] | None = None, window: tuple[int, int] | None = None,
         as_of: int | None = None, pivot_services: int = PIVOT_SERVICES) -> DataFrame:
    """One of avg, min, max, sum, count, increase, rate, latest.

    ``per`` buckets the result, ``by_service`` gives one row per service, and both together give one column
    for each of ``services``, or, if none are named, for the first ``pivot_services`` by name.
    """
    samples = select_samples(metrics, metric, filters, last, window, as_of)
    if name == "latest":
        if per:
            raise ValueError("latest answers a point-in-time question; it doesn't take per")
        return _latest(samples, by_service)

    per_ms = duration_ms(per) if per else None
    frame_ms = per_ms or ((window[1] - window[0]) if window else duration_ms(last or DEFAULT_LAST))
    pivot = _pivot_services(metrics, metric, services, pivot_services) if per and by_service else None
    if per_ms:
        samples = samples.withColumn("bucket", bucket("timestamp", per_ms))

    if name in ("increase", "rate"):
        return _growth(samples, name, frame_ms // 1000, bool(per), by_service, pivot)
    if name not in _PLAIN:
        raise ValueError(f"unknown verb {name!r}")

    fn = _PLAIN[name]
    alias = "samples" if name == "count" else f"{name}_value"
    if pivot:
        cells = [fn(F.when(F.col("service") == s, F.col("value"))).alias(s) for s in pivot]
        return samples.groupBy("bucket").agg(*cells).orderBy("bucket")
    value = fn("value").alias(alias)
    if per:
        return samples.groupBy("bucket").agg(value).orderBy("bucket")
    if by_service:
        return samples.groupBy("service").agg(value).orderBy(F.desc(alias))
    return samples.agg(value)


def _latest(samples: DataFrame, by_service: bool) -> DataFrame:
    # newest by arrival (id), not by event time
    if by_service:
        return (samples.groupBy("service").agg(F.max_by("value", "id").alias("latest"))
                .orderBy(F.desc("latest")))
    return samples.orderBy(F.desc("id")).limit(1).select(F.col("value").alias("latest"))


def _growth(samples: DataFrame, name: str, frame_s: int, per: bool, by_service: bool,
            pivot: list[str] | None) -> DataFrame:
    """Counter growth: max - min of every series inside the frame, then summed."""
    keys = (["bucket"] if per else []) + SERIES_KEYS
    grown = samples.groupBy(*keys).agg((F.max("value") - F.min("value")).alias("inc"))

    def total(inc: Column, alias: str) -> Column:
        out = F.sum(inc)
        if name == "rate":
            out = F.try_divide(out, F.lit(float(frame_s)))
        return out.alias(alias)

    if pivot:
        cells = [total(F.when(F.col("service") == s, F.col("inc")), s) for s in pivot]
        return grown.groupBy("bucket").agg(*cells).orderBy("bucket")
    alias = "rate_per_s" if name == "rate" else "increase"
    value = total(F.col("inc"), alias)
    if per:
        return grown.groupBy("bucket").agg(value).orderBy("bucket")
    if by_service:
        return grown.groupBy("service").agg(value).orderBy(F.desc(alias))
    return grown.agg(value)


def avg(metrics: DataFrame, metric: str, **kw) -> DataFrame:
    return verb(metrics, "avg", metric, **kw)


def min_(metrics: DataFrame, metric: str, **kw) -> DataFrame:
    return verb(metrics, "min", metric, **kw)


def max_(metrics: DataFrame, metric: str, **kw) -> DataFrame:
    return verb(metrics, "max", metric, **kw)


def sum_(metrics: DataFrame, metric: str, **kw) -> DataFrame:
    return verb(metrics, "sum", metric, **kw)


def count(metrics: DataFrame, metric: str, **kw) -> DataFrame:
    return verb(metrics, "count", metric, **kw)


def increase(metrics: DataFrame, metric: str, **kw) -> DataFrame:
    return verb(metrics, "increase", metric, **kw)


def rate(metrics: DataFrame, metric: str, **kw) -> DataFrame:
    return verb(metrics, "rate", metric, **kw)


def latest(metrics: DataFrame, metric: str, **kw) -> DataFrame:
    return verb(metrics, "latest", metric, **kw)


def average_from_sum_count(metrics: DataFrame, base: str,
                           on: Sequence[str] = ("timestamp", "service", "host", "labels")) -> DataFrame:
    """Average of a downcast histogram or summary: its ``_sum`` over its ``_count`` sample.

    Both samples of one scrape meet in one group per series and instant, so no pairs are
    built; a resent sample gives way to the one that arrived last.
    """
    total, n = F.col("name") == f"{base}_sum", F.col("name") == f"{base}_count"
    both = (metrics.filter(F.col("name").isin(f"{base}_sum", f"{base}_count"))
            .groupBy(*on)
            .agg(F.max_by("value", F.when(total, F.col("id"))).alias("s"),
                 F.max_by("value", F.when(n, F.col("id"))).alias("c")))
    return (both.filter(F.col("s").isNotNull() & F.col("c").isNotNull())
            .select(*on, F.try_divide("s", "c").alias("avg_value")))


def suggested_query(name: Column, type_: Column) -> Column:
    """The verb a catalog row opens with, by its stored type; none when the name has a ``)``."""
    text = (F.when(type_ == COUNTER, F.concat(F.lit("increase("), name, F.lit(") per 1h last 24h")))
            .otherwise(F.concat(F.lit("avg("), name, F.lit(") per 10m last 24h"))))
    return F.when(~name.contains(")"), text)
