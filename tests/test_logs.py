"""Viewer, filters, paging, ordered functions and result limits."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.functions.timeexpr import event_date
from logloom.operators import filters, paging, shape, signals, windows
from logloom.operators.filters import LogFilter
from logloom.plans import home, incident
from logloom.session import stored_days

T0 = 1_754_006_399_500


def made(n=150, seed=5):
    """Lines of three senders at uneven steps, several at one instant, ids dealt out of order."""
    rng = random.Random(seed)
    ids = rng.sample(range(1, 10 * n), n)
    at, rows = T0, []
    for i in ids:
        at += rng.choice([0, 0, 170, 2400])
        rows.append((i, at, at + 9, rng.randrange(6), rng.choice(["api", "db", "ui"]), rng.choice(["x1", "x2"]), rng.choice([None, f"said {i}"]), None,
                     f"line of {i}"))
    return rows


ROWS = made()
NEWEST = [i for _, i in sorted(((r[1], r[0]) for r in ROWS), reverse=True)]


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(ROWS, "id long, timestamp long, ingested_at long, level int, service string, host string,"
                                       " message string, parsed string, raw string")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def those(keep):
    return sorted(r[0] for r in ROWS if keep(*r))


def test_filters_narrow_as_stated(logs):
    """A later value of a column replaces the earlier one; free predicates, windows and drill-ins are added."""
    f = LogFilter().with_(service="api").with_(host="x1").with_(service="db").with_(level="5")
    assert ids(f.apply(logs)) == those(lambda i, t, g, lv, s, h, *_: (lv, s, h) == (5, "db", "x1"))
    free = LogFilter().where((F.col("level") > 3) | F.col("message").isNull()).with_(host="x2")
    assert ids(free.apply(logs)) == those(lambda i, t, g, lv, s, h, m, *_: (lv > 3 or m is None) and h == "x2")
    middle = ROWS[70][1]
    inside = filters.drill_in(logs, LogFilter().within(T0 + 1, middle), "host", "x1")
    assert ids(inside) == those(lambda i, t, g, lv, s, h, *_: T0 < t <= middle and h == "x1")
    for wrong in ({"raw": "x"}, {"level": "loud"}):
        with pytest.raises(ValueError):
            LogFilter().with_(**wrong)


@pytest.mark.parametrize("size", [1, 7, 50, 149, 150, 151])
def test_pages_walk_history_once(logs, size):
    seen, before = [], None
    while len(seen) < 2 * size or size < 50:
        page = paging.keyset_page(logs, before, size).collect()
        seen += [r.id for r in page]
        if len(page) < size or len(seen) >= 3 * size and size < 50:
            break
        before = (page[-1].timestamp, page[-1].id)
    assert seen == NEWEST[:len(seen)] and len(seen) >= min(2 * size, 150)


def test_page_sizes(logs):
    for wrong in (0, -3):
        with pytest.raises(ValueError):
            paging.keyset_page(logs, size=wrong)


def test_newest_days_prune(spark, tmp_path):
    """A page is exact however few rows the newest days hold, and older days are not read."""
    day = 86_400_000
    rows = [(k, T0 + k * day // 4) for k in range(40)] + [(100, T0 + 30 * day)]
    path = str(tmp_path / "t")
    (spark.createDataFrame(rows, "id long, timestamp long").withColumn("dt", event_date("timestamp"))
     .write.partitionBy("dt").parquet(path))
    table, days = spark.read.parquet(path), stored_days(spark, path)
    assert len(days) == 11 or len(days) == 12
    for size in (1, 2, 5, 17, 41, 60):
        got = paging.keyset_page(table, size=size, days=days)
        assert [r.id for r in got.collect()] == sorted([i for i, _ in rows], reverse=True)[:size]
    plan = paging.keyset_page(table, size=5, days=days)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    older = paging.keyset_page(table, (T0 + 5 * day, 20), 3, days)
    assert [r.id for r in older.collect()] == [19, 18, 17]


def test_viewer_rows(logs):
    """The newest lines, oldest first; a line without a message shows itself."""
    got = paging.viewer_rows(paging.keyset_page(logs)).collect()
    said = {r[0]: r[6] or r[8] for r in ROWS}
    assert [r.id for r in got] == NEWEST[:50][::-1] and [r.message for r in got] == [said[i] for i in NEWEST[:50][::-1]]
    assert ids(paging.recent(logs, 7)) == sorted(r[0] for r in ROWS)[-7:]


def test_ties_break_by_id(spark):
    df = spark.createDataFrame([(i, 5) for i in range(10)], "id long, timestamp long")
    assert [r.id for r in paging.keyset_page(df, (5, 4), 3).collect()] == [3, 2, 1]


def test_bounded(logs):
    for limit, expected in ((1, True), (149, True), (150, False), (4000, False)):
        rows, cut = shape.bounded(logs.select("id"), limit)
        assert (len(rows), cut) == (min(limit, 150), expected)
    assert [shape.api_rows(n) for n in (None, 0, -7, 1, 999, 1000, 1001)] == [200, 200, 200, 1, 999, 1000, 1000]


def test_cut_at_rune(spark):
    texts = ["a" * 10, "a" * 11, "a" * 9 + "é", "a" * 8 + "é", "a" * 7 + "😀x", "é" * 6, "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string").coalesce(1)
    got = [r[0] for r in df.orderBy("n").select(shape.cut_at_rune(F.col("t"), 10, "…")).collect()]
    assert got == ["a" * 10, "a" * 10 + "…", "a" * 9 + "…", "a" * 8 + "é", "a" * 7 + "…", "é" * 5 + "…", "", None]


def hot_rows(spark, n=3000):
    """Two thirds of the rows in one key, half of those at one instant."""
    df = spark.range(n).select(
        "id", F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("key"),
        F.when(F.col("id") % 2 == 0, 500).otherwise((F.col("id") * 7919) % 1000).alias("t"), (F.col("id") % 11).alias("v"))
    return df.withColumn("v", F.when(F.col("v") != 3, F.col("v")))


def test_running_and_lag_under_skew(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = hot_rows(spark).withColumn("key", F.when(F.col("key") != "k3", F.col("key")))
        chunks = windows.ordered_chunks(df, ["key"], ["t", "id"])
        assert chunks.filter("key = 'hot'").select("_chunk").distinct().count() > 1
        run = windows.running(df, ["key"], ["t", "id"], "v").collect()
        lag = {r.id: (r.previous, r.delta) for r in windows.lag_delta(df, ["key"], ["t", "id"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(run) == 3000
    by_key = {}
    for r in sorted(run, key=lambda r: (r.t, r.id)):
        n, total, prev = by_key.get(r.key, (0, None, None))
        n, total = n + 1, total if r.v is None else (total or 0) + r.v
        assert (r.row_number, r.running_sum) == (n, total), r
        assert lag[r.id] == (prev, r.v - prev if r.v is not None and prev is not None else None), r
        by_key[r.key] = (n, total, r.v)


@pytest.mark.parametrize("span", [1, 90, 5000])
def test_sliding_under_skew(spark, span):
    """Frames shorter than the gaps, of some rows, and of a whole key; null keys, orders and values; one hot instant."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = (hot_rows(spark).withColumn("key", F.when(F.col("key") != "k3", F.col("key")))
              .withColumn("t", F.when(F.col("id") % 97 != 0, F.col("t") - 300)))
        got = windows.sliding(df, ["key"], "t", span, "v").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(r.id for r in got) == list(range(3000))
    by_key = {}
    for r in got:
        by_key.setdefault(r.key, []).append((r.t, r.v))
    for r in got[::7]:
        if r.t is None:
            assert (r.frame_rows, r.frame_sum, r.frame_min, r.frame_max) == (None, None, None, None)
            continue
        frame = [v for t, v in by_key[r.key] if t is not None and r.t - span <= t <= r.t]
        there = [v for v in frame if v is not None]
        want = (len(frame), sum(there), min(there), max(there)) if there else (len(frame), None, None, None)
        assert (r.frame_rows, r.frame_sum, r.frame_min, r.frame_max) == want, r


def test_sliding_cuts_a_hot_bin(spark):
    """One bin that holds nearly all rows lies in several chunks, and the last rows of each key are counted across them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = windows.sliding_rows(hot_rows(spark), ["key"], ["t", "id"], 1500, "v").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for key in {r.key for r in got}:
        rows = sorted((r for r in got if r.key == key), key=lambda r: r.row_number)
        for i, r in enumerate(rows):
            assert r.frame_rows == min(i + 1, 1500)
            if i % 50 == 49:
                there = [x.v for x in rows[max(0, i - 1499):i + 1] if x.v is not None]
                assert (r.frame_sum, r.frame_min, r.frame_max) == (sum(there), min(there), max(there))


def test_sliding_of_nothing(spark):
    none = spark.createDataFrame([], "key string, t long, v long, extra string")
    out = windows.sliding(none, ["key"], "t", 10, "v")
    assert out.columns == ["key", "t", "v", "extra", "frame_rows", "frame_sum", "frame_min", "frame_max"] and out.count() == 0
    with pytest.raises(ValueError):
        windows.sliding(none, ["key"], "t", 0, "v")


def test_top_per_key(spark):
    got = windows.top_per_key(hot_rows(spark), ["key"], [F.desc("t"), F.desc("id")], 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # each task keeps k per key before the shuffle
    assert got.groupBy("key").count().filter("count <> 3").count() == 0


def test_latest_and_silent(logs):
    got = {r.service: r.id for r in signals.latest_rows(logs.select("service", "id", "raw")).collect()}
    assert got == {s: max(r[0] for r in ROWS if r[4] == s) for s in ("api", "db", "ui")}
    quiet = logs.filter("service <> 'db' or level is null")
    assert [r.service for r in signals.silent(logs, quiet).collect()] == ["db"]


def test_volume_and_bars(logs):
    end = ROWS[-1][1] + 1
    got = home.volume_bars(home.volume(logs, end)).collect()
    inside = [r for r in ROWS if r[1] > end - 3_600_000]
    assert got[0].total == len(inside) == sum(r.lines for r in got)
    assert all((r.height_pct == 0.0) == (r.lines == 0) and 0 <= r.height_pct <= 100 for r in got)


def test_window_rules():
    now = 10**12
    assert incident.resolve_window(0, 0, now) == (now - 3_600_000, now)
    assert incident.resolve_window(now - 59_999, now, now) == (now - 3_600_000, now)
    assert incident.resolve_window(1000, 61_000, now) == (1000, 61_000)
    assert incident.resolve_window(1000, 61_000, now, follow=True) == (now - 60_000, now)


def test_incident_view(spark, logs):
    minute, start = 60_000, ROWS[0][1] // 60_000 * 60_000
    points = [(start + 61_000, 1.5), (start + 70_000, 4.5), (start + 119_999, 0.0)]
    metrics = spark.createDataFrame([(k, t, "depth", 1, v, "db", "x1", None) for k, (t, v) in enumerate(points)],
                                    "id long, timestamp long, name string, type int, value double, service string, host string, labels string")
    got = incident.view(logs, metrics, [incident.MetricRow("avg", "depth", per="1m")], LogFilter().with_(service="ui"), (start, start + 3 * minute))
    assert [r.avg_value for r in got["metric_0"].collect()] == [None, 2.0, None, None]
    inside = [r for r in ROWS if start <= r[1] <= start + 3 * minute]
    assert got["logs"].count() == sum(r[4] == "ui" for r in inside)
    assert sum(r.errors for r in got["mini_chart"].collect()) == sum(r[3] >= 4 for r in inside)
