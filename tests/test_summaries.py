"""Daily summaries against the catalogs that read all rows."""

import datetime as dt
import os

import pytest

from logloom.operators import retention, sinks
from logloom.plans import catalog, summaries
from logloom.sources.files import read_metrics

DAY = 86_400_000
NOW = 1_755_000_000_000
COLUMNS = "timestamp long, name string, type int, value double, service string, host string, labels string"


def append(spark, path, rows):
    sinks.append_metrics(spark.createDataFrame(rows, COLUMNS), path)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def agree(spark, path, held):
    metrics = read_metrics(spark, path)
    assert rows_of(summaries.metrics_catalog(spark, held)) == rows_of(catalog.metrics_catalog(metrics))
    assert rows_of(summaries.metric_names(spark, held)) == rows_of(catalog.metric_names(metrics))
    for metric in ("queue_depth", "absent"):
        assert rows_of(summaries.filter_keys(spark, held, metric)) == rows_of(catalog.filter_keys(metrics, metric))
        for key in ("service", "host", "zone", "a.b", "absent"):
            assert rows_of(summaries.filter_values(spark, held, metric, key)) == rows_of(catalog.filter_values(metrics, metric, key))


def test_follow_appends_and_sweep(spark, tmp_path):
    path, held = str(tmp_path / "metrics"), str(tmp_path / "held")
    old, new = NOW - 12 * DAY, NOW - DAY
    append(spark, path, [(old, "queue_depth", 1, 1.0, "mill", "h1", '{"zone":"x","a.b":"dot","service":"label"}'),
                         (old, "only_old_total", 0, 1.0, "mill", "h1", None),
                         (new, "queue_depth", 1, 2.0, "kiln", "h2", "")])
    assert len(summaries.follow(spark, path, held)) == 2
    agree(spark, path, held)
    assert summaries.follow(spark, path, held) == []

    # a counter sample makes the name a counter; odd labels: empty value, null value, nested, no JSON, a quote in a key
    odd = ['{"zone":""}', '{"zone":null}', '{"zone":{"n":1}}', "no json", '{"it\'s":"v"}']
    append(spark, path, [(new + k, "queue_depth", 0, 0.0, "kiln", "", text) for k, text in enumerate(odd)])
    touched = summaries.follow(spark, path, held)
    assert [str(d) for d in touched] == ["2025-08-11"]
    agree(spark, path, held)

    retention.expire(spark, path, 10, NOW)
    assert [str(d) for d in summaries.follow(spark, path, held)] == ["2025-07-31"]
    agree(spark, path, held)
    assert "only_old_total" not in [n for n, in rows_of(summaries.metric_names(spark, held))]
    assert sorted(d for d in os.listdir(f"{held}/senders") if d[:3] == "dt=") == ["dt=2025-08-11"]


def test_follow_named_days_and_cut_short_runs(spark, tmp_path):
    path, held = str(tmp_path / "metrics"), str(tmp_path / "held")
    append(spark, path, [(NOW, "queue_depth", 1, 1.0, "mill", "h", '{"zone":"x"}')])
    day = dt.date(2025, 8, 12)
    assert summaries.follow(spark, path, held, [day]) == [day]
    # a day that is exchanged for as many rows is summed up when it is named
    sinks_rows = read_metrics(spark, path).drop("dt").collect()[0].asDict() | {"service": "kiln"}
    swapped = str(tmp_path / "swapped")
    append(spark, swapped, [tuple(sinks_rows[c.split()[0]] for c in COLUMNS.split(", "))])
    assert summaries.follow(spark, swapped, held) == []
    assert summaries.follow(spark, swapped, held, [day]) == [day]
    agree(spark, swapped, held)
    # filters written, senders not: the day still differs and is done again
    append(spark, swapped, [(NOW, "queue_depth", 1, 1.0, "mill", "h", '{"zone":"y"}')])
    rows = read_metrics(spark, swapped)
    summaries.filters_of(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(f"{held}/filters")
    assert summaries.follow(spark, swapped, held) == [day]
    agree(spark, swapped, held)


def test_hidden_keys_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        summaries.filter_values(spark, str(tmp_path), "m", "a' or")
