"""Buckets repaired by late rows: any order of arrival gives what a batch query gives."""

import itertools

import pytest
from pyspark.sql import functions as F

from logloom.streaming import late_rows

HOUR = 3_600_000
T0 = 1_755_000_000_000 // HOUR * HOUR
ROWS = "timestamp long, service string, note string"
KEYS = ["service"]


def aggs():
    return [F.count_distinct("note").alias("notes"), F.min("timestamp").alias("first")]


def at(hour, minute, service="a", note="x"):
    return T0 + hour * HOUR + minute * 60_000, service, note


EARLY = [at(0, 5), at(0, 10, "b"), at(1, 0, None)]
LATER = [at(4, 0), at(4, 30, "b", "y"), at(0, 59, "a", "z"), at(1, 0, None)]
LATEST = [at(9, 0), at(0, 0, "c"), at(4, 30, "b", "y"), at(-40, 0)]


def fed(spark, path, batches, **options):
    sink = late_rows.follow(path, HOUR, KEYS, aggs(), HOUR, run="r", **options)
    for i, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, ROWS), i)


def cells(spark, path):
    parts = [late_rows.cells(spark, path, KEYS), late_rows.open_cells(spark, path, HOUR, KEYS, aggs(), HOUR)]
    return sorted((tuple(r[c] for c in ("bucket", "service", "n_rows", "notes", "first"))
                   for p in parts if p is not None for r in p.collect()), key=repr)


def plain(rows):
    groups = {}
    for t, service, note in rows:
        if t is not None:
            groups.setdefault((t // HOUR * HOUR, service), []).append((t, note))
    return sorted(((b, s, len(g), len({n for _, n in g if n is not None}), min(t for t, _ in g))
                   for (b, s), g in groups.items()), key=repr)


@pytest.mark.parametrize("order", list(itertools.permutations([EARLY, LATER, LATEST])))
def test_any_order_of_arrival(spark, tmp_path, order):
    fed(spark, str(tmp_path), order)
    assert cells(spark, str(tmp_path)) == plain(EARLY + LATER + LATEST)


def test_late_rows_are_listed_and_only_their_cells_computed(spark, tmp_path):
    path = str(tmp_path)
    fed(spark, path, [EARLY + [at(5, 0)], [at(0, 59, "a", "z"), at(5, 10)]])
    assert [(r.timestamp, r.batch) for r in late_rows.late_rows(spark, path).collect()] == [(at(0, 59)[0], "r-1")]
    second = spark.read.parquet(f"{path}/cells").filter("batch = 'r-1'").collect()
    assert [(r.bucket, r.service, r.n_rows) for r in second] == [(T0, "a", 2)]


def test_a_batch_that_runs_again(spark, tmp_path):
    path = str(tmp_path)
    batches = [EARLY, LATER, LATEST]
    fed(spark, path, batches)
    sink = late_rows.follow(path, HOUR, KEYS, aggs(), HOUR, run="r")
    sink(spark.createDataFrame(LATEST, ROWS), 2)
    assert cells(spark, path) == plain(EARLY + LATER + LATEST)
    assert late_rows.late_rows(spark, path).filter("batch = 'r-2'").count() == 2


def test_odd_rows(spark, tmp_path):
    """No rows, rows without a time, times before 1970, and an absurd time that the time of receipt replaces."""
    path = str(tmp_path / "a")
    fed(spark, path, [[], [(None, "a", "x")], [], [at(3, 0), (-1, "a", None), (None, None, None)]])
    assert cells(spark, path) == plain([at(3, 0), (-1, "a", None)])
    path = str(tmp_path / "b")
    sink = late_rows.follow(path, HOUR, KEYS, aggs(), HOUR, received="got", run="r")
    schema = ROWS + ", got long"
    sink(spark.createDataFrame([(T0 * 50, "a", "x", T0), (None, "a", "x", T0)], schema), 0)
    sink(spark.createDataFrame([(T0 + 5, "b", "x", T0 + 9)], schema), 1)
    assert cells(spark, path) == plain([(T0, "a", "x"), (T0, "a", "x"), (T0 + 5, "b", "x")])
    assert late_rows.late_rows(spark, path) is None
