"""Time-series verbs and gap filling."""

import pytest

from logloom.functions.timeexpr import duration_ms
from logloom.operators import series, shape
from logloom.plans import catalog

T0 = 1723600000000
AS_OF = T0 + 3_600_000
SCHEMA = "id long, timestamp long, name string, type int, value double, service string, host string, labels string"


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def shop(spark):
    return table(spark, [
        (T0, "queue_depth", 1, 7.0, "shop", "h1", None), (T0 + 30000, "queue_depth", 1, 9.0, "shop", "h1", None),
        (T0, "orders_total", 0, 100.0, "shop", "h1", '{"status":"ok"}'),
        (T0 + 60000, "orders_total", 0, 140.0, "shop", "h1", '{"status":"ok"}'),
        (T0 + 60000, "orders_total", 0, 5.0, "shop", "h1", '{"status":"bad"}'),
        (T0 + 60000, "orders_total", 0, 50.0, "web", "h2", None), (T0 + 90000, "orders_total", 0, 53.0, "web", "h2", None)])


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("text,ms", [("5m", 300_000), ("1h", 3_600_000), ("2d", 172_800_000)])
def test_durations(text, ms):
    assert duration_ms(text) == ms


@pytest.mark.parametrize("text", ["0m", "5s", "h", "1.5h", "", "-1h"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        duration_ms(text)


def test_increase_sums_series(shop):
    assert rows(series.increase(shop, "orders_total", as_of=AS_OF)) == [(43.0,)]
    assert rows(series.increase(shop, "orders_total", as_of=AS_OF, by_service=True)) == [("shop", 40.0), ("web", 3.0)]
    assert rows(series.increase(shop, "orders_total", as_of=AS_OF, filters={"status": "ok"})) == [(40.0,)]
    # growth between buckets does not count
    assert [r[1] for r in rows(series.increase(shop, "orders_total", as_of=AS_OF, per="1m"))] == [0.0, 0.0, 0.0]


def test_rate_frames(shop):
    assert rows(series.rate(shop, "orders_total", as_of=AS_OF, last="2h")) == [(43 / 7200,)]
    assert rows(series.rate(shop, "orders_total", window=(T0, T0 + 60000))) == [(40 / 60,)]
    assert rows(series.rate(shop, "orders_total", window=(T0, T0))) == [(None,)]


def test_plain_verbs(shop):
    for name, alias, want in [("avg", "avg_value", 8.0), ("min", "min_value", 7.0), ("max", "max_value", 9.0),
                              ("sum", "sum_value", 16.0), ("count", "samples", 2)]:
        df = series.verb(shop, name, "queue_depth", as_of=AS_OF)
        assert df.columns == [alias] and rows(df) == [(want,)]


def test_latest_follows_arrival(spark):
    m = table(spark, [(T0 + 50, "g", 1, 1.0, "a", "h", None), (T0, "g", 1, 2.0, "a", "h", None), (T0, "g", 1, 9.0, "b", "h", None)])
    assert rows(series.latest(m, "g", as_of=AS_OF)) == [(9.0,)]
    assert rows(series.latest(m, "g", as_of=AS_OF, by_service=True)) == [("b", 9.0), ("a", 2.0)]
    assert rows(series.latest(m, "none", as_of=AS_OF)) == []
    with pytest.raises(ValueError):
        series.latest(m, "g", per="1m")


def test_pivot_takes_six_services_of_all_time(spark):
    m = table(spark, [(T0 if s != "s0" else T0 - 10**10, "g", 1, float(i), s, "h", None)
                      for i, s in enumerate([f"s{k}" for k in (7, 3, 0, 1, 2, 6, 5, 4)])])
    avg = series.avg(m, "g", per="1h", by_service=True, as_of=AS_OF)
    assert avg.columns == ["bucket", "s0", "s1", "s2", "s3", "s4", "s5"]
    assert rows(avg)[0][1] is None
    count = series.count(m, "g", per="1h", by_service=True, as_of=AS_OF)
    assert rows(count)[0][1:3] == (0, 1)
    with pytest.raises(ValueError):
        series.avg(m, "none", per="1h", by_service=True)


def test_relative_window_is_open_above_and_strict_below(spark):
    m = table(spark, [(AS_OF - 60000, "g", 1, 1.0, "a", "h", None), (AS_OF - 59999, "g", 1, 2.0, "a", "h", None),
                      (AS_OF + 5, "g", 1, 4.0, "a", "h", None)])
    assert rows(series.sum_(m, "g", last="1m", as_of=AS_OF)) == [(6.0,)]


def test_dotted_label(spark):
    m = table(spark, [(T0, "g", 1, 1.0, "a", "h", '{"http.method":"GET"}'), (T0, "g", 1, 1.0, "a", "h", '{"http":{"method":"GET"}}')])
    assert rows(series.count(m, "g", filters={"http.method": "GET"}, as_of=AS_OF)) == [(1,)]
    assert m.filter(series.label_equals("http.method", "GET", nested=True)).count() == 1


@pytest.mark.parametrize("verb,zeros,nulls", [("avg", 0, 5), ("increase", 6, 0)])
def test_gap_fill(spark, verb, zeros, nulls):
    ten = 600_000
    end = T0 // ten * ten + 6 * ten
    m = table(spark, [(end - 6 * ten + 1, "x", 1, 3.0, "a", "h", None), (end - 1, "x", 1, 5.0, "a", "h", None)]
              + [(end - 2, "x", 1, 45.0, "a", "h", None)] * (verb == "increase"))
    df = series.verb(m, verb, "x", per="10m", last="1h", as_of=end)
    filled = rows(shape.gap_fill(df, start_ms=end - 6 * ten, end_ms=end, bucket_ms=ten, zero=series.fills_with_zero(verb)))
    values = [v for _, v in filled]
    assert len(filled) == 7 and values.count(None) == nulls
    if verb == "increase":
        assert values.count(0.0) == zeros and sum(values) == 40.0


def test_grid_limits(spark):
    df = spark.createDataFrame([(0, 1.0), (7, 2.0)], "bucket long, v double")
    assert shape.gap_fill(df, start_ms=0, end_ms=0, bucket_ms=10, zero=True) is df
    assert shape.gap_fill(df, start_ms=0, end_ms=200_000, bucket_ms=10, zero=True).count() == 20_001
    empty = df.filter("false")
    assert rows(shape.gap_fill(empty, start_ms=0, end_ms=20, bucket_ms=10, zero=True)) == [(0, 0.0), (10, 0.0), (20, 0.0)]
    assert rows(shape.gap_fill(df, start_ms=0, end_ms=10, bucket_ms=10, zero=False)) == [(0, 1.0), (10, None)]


def test_adaptive_bucket():
    assert [shape.adaptive_bucket_ms(s) for s in (0, 120_999, 121_000, 3_600_000, 86_400_000 * 120, 86_400_000 * 121)] == [
        1000, 1000, 5000, 30_000, 86_400_000, 2 * 86_400_000]


def test_sum_count_average(spark):
    m = table(spark, [(T0, "lat_sum", 0, 10.0, "a", "h", None), (T0, "lat_count", 0, 4.0, "a", "h", None),
                      (T0, "lat_sum", 0, 1.0, "b", "h", None), (T0, "lat_count", 0, 0.0, "b", "h", None),
                      (T0, "lat_sum", 0, 1.0, "c", "h", None)])
    got = {r.service: r.avg_value for r in series.average_from_sum_count(m, "lat").collect()}
    assert got == {"a": 2.5, "b": None}


def test_catalog(shop, spark):
    got = {(r.name, r.service): (r.type, r.points, r.suggested) for r in catalog.metrics_catalog(shop).collect()}
    assert got["orders_total", "shop"] == ("counter", 3, "increase(orders_total) per 1h last 24h")
    assert got["queue_depth", "shop"] == ("gauge", 2, "avg(queue_depth) per 10m last 24h")
    odd = table(spark, [(T0, "a)b", 1, 1.0, "s", "h", None)])
    assert catalog.metrics_catalog(odd).first().suggested is None
    assert [r.key for r in catalog.filter_keys(shop, "orders_total").collect()] == ["service", "host", "status"]
    assert [r.v for r in catalog.filter_values(shop, "orders_total", "status").collect()] == ["bad", "ok"]
    with pytest.raises(ValueError):
        catalog.filter_values(shop, "orders_total", "a b")
