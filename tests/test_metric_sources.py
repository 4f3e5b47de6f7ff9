"""OTLP JSON and Prometheus text: payloads put together from parts, against what the rules say of each part."""

import json
import random
from itertools import product

from logloom.sources.otlp import otlp_json_to_metrics
from logloom.sources.otlp import rejected as otlp_rejected
from logloom.sources.prometheus import prom_text_to_metrics, rejected

RECV = 1_754_000_000_000
GAUGE, COUNTER = 1, 0


def samples(df):
    return sorted(((r.name, r.type, r.value, r.service, r.host, r.timestamp, r.labels) for r in df.collect()), key=repr)


def otlp(spark, *payloads):
    return spark.createDataFrame([(p if isinstance(p, str) or p is None else json.dumps(p), RECV) for p in payloads], "payload string, received_at long")


def wrapped(metrics, attributes=None):
    one = {"scopeMetrics": [{"metrics": metrics}]}
    return {"resourceMetrics": [one if attributes is None else one | {"resource": {"attributes": attributes}}]}


def test_number_points(spark):
    """Every kind of number metric, value, flag and time; a point without a value or with the no-value flag is left out."""
    values = [({"asInt": "-4"}, -4.0), ({"asInt": 9}, 9.0), ({"asDouble": 0.125}, 0.125), ({"asDouble": 2, "asInt": "3"}, 2.0), ({}, None)]
    flags = [({}, True), ({"flags": 0}, True), ({"flags": 1}, False), ({"flags": 2}, True), ({"flags": 3}, False)]
    times = [({}, RECV), ({"timeUnixNano": "0"}, RECV), ({"timeUnixNano": str(RECV * 10**6 + 999_999)}, RECV),
             ({"timeUnixNano": str((RECV - 5) * 10**6)}, RECV - 5), ({"timeUnixNano": "1"}, RECV)]
    kinds = [("gauge", {}, GAUGE), ("sum", {}, GAUGE), ("sum", {"isMonotonic": False}, GAUGE), ("sum", {"isMonotonic": True}, COUNTER)]
    metrics, expected = [], []
    for (kind, extra, type_), (value, number), (flag, kept), (time, at) in product(kinds, values, flags, times):
        name = f"m{len(metrics)}"
        metrics.append({"name": name, kind: extra | {"dataPoints": [value | flag | time]}})
        if kept and number is not None:
            expected.append((name, type_, number, "unknown", "unknown", at, None))
    metrics.append({"name": "", "gauge": {"dataPoints": [{"asInt": 1}]}})
    assert samples(otlp_json_to_metrics(otlp(spark, wrapped(metrics)))) == sorted(expected, key=repr)


def test_distributions_keep_sum_and_count(spark):
    """Of each distribution a running sum and count stay, both counters; only a summary's missing sum is 0."""
    metrics, expected = [], set()
    for kind, total, n in product(["histogram", "exponentialHistogram", "summary"], [None, -1.5, 0], [None, "0", 12]):
        name = f"d{len(metrics)}"
        point = {k: v for k, v in (("sum", total), ("count", n)) if v is not None} | {"bucketCounts": ["1"], "quantileValues": []}
        metrics.append({"name": name, kind: {"dataPoints": [point]}})
        expected.add((name + "_count", COUNTER, float(n or 0)))
        if total is not None or kind == "summary":
            expected.add((name + "_sum", COUNTER, float(total or 0)))
    assert {s[:3] for s in samples(otlp_json_to_metrics(otlp(spark, wrapped(metrics))))} == expected


def test_otlp_identity_and_labels(spark):
    """The last text of a key counts; other kinds of values do not name a service."""
    def text(k, v):
        return {"key": k, "value": {"stringValue": v}}

    point = [{"name": "g", "gauge": {"dataPoints": [{"asInt": 1, "attributes": [
        {"key": "n", "value": {"intValue": "-3"}}, {"key": "b", "value": {"boolValue": False}}, text("", "no key"), text("s", "one"),
        {"key": "d", "value": {"doubleValue": 2.5e-7}}, text("s", "t&wo")]}]}}]
    labels = '{"b":"false","d":"2.5e-07","n":"-3","s":"t\\u0026wo"}'
    for attributes, service, host in [
            ([], "unknown", "unknown"), ([text("service.name", "a"), text("service.name", "b")], "b", "unknown"),
            ([{"key": "service.name", "value": {"intValue": "4"}}, text("host.name", "")], "unknown", "unknown"),
            ([text("host.name", "h.example"), text("other", "x")], "unknown", "h.example")]:
        assert samples(otlp_json_to_metrics(otlp(spark, wrapped(point, attributes)))) == [("g", GAUGE, 1.0, service, host, RECV, labels)]


def test_otlp_scopes_and_broken_payloads(spark):
    """Scopes without metrics change nothing; a payload counts as a whole or not at all."""
    scope = {"metrics": [{"name": "g", "gauge": {"dataPoints": [{"asDouble": 7}]}}]}
    good = [{"resourceMetrics": [{"scopeMetrics": list(scopes)}]} for scopes in product([scope, {}, {"metrics": None}, {"metrics": []}], repeat=2)]
    whole = json.dumps(good[0])
    broken = [whole + "]", whole + ",", whole + ",null", whole[1:], whole[:-2], whole + "}", whole + whole, f"[{whole}]", "7", "", None]
    df = otlp(spark, *good, *broken)
    assert otlp_json_to_metrics(df).count() == sum(2 if x == y == scope else 1 if scope in (x, y) else 0
                                                   for x, y in product([scope, {}, {"metrics": None}, {"metrics": []}], repeat=2))
    assert otlp_rejected(df).count() == len(broken)


def scrape(spark, *texts):
    return spark.createDataFrame([(t, "svc", "box", RECV) for t in texts], "text string, service string, host string, ts long")


def test_families(spark):
    """Families of every declared type, with every suffix: what is kept, and as what."""
    lines, expected, rng = [], set(), random.Random(4)
    for kind in ("counter", "gauge", "histogram", "summary", "untyped", None):
        name = f"f_{kind}"
        if kind:
            lines.append([f"# TYPE {name} {kind}", f"# HELP {name} any words"])
        for suffix in ("", "_sum", "_count", "_bucket"):
            value = rng.randrange(1, 1000) / 8
            lines.append([f"{name}{suffix} {value}"])
            spread = kind in ("histogram", "summary")
            if spread and suffix in ("", "_bucket"):
                continue  # quantiles and buckets
            expected.add((name + suffix, COUNTER if spread or kind == "counter" and not suffix else GAUGE, value))
    rng.shuffle(lines)
    got = samples(prom_text_to_metrics(scrape(spark, "\n".join(x for group in lines for x in group) + "\r\n\n")))
    assert {s[:3] for s in got} == expected and {s[3:] for s in got} == {("svc", "box", RECV, None)}


def test_sample_lines(spark):
    """A sample's labels, value and time in all their spellings."""
    labels = {"": None, "{}": None, '{a="1"}': '{"a":"1"}', '{ b = "x,}" , a="\\\\ \\" \\n" ,}': '{"a":"\\\\ \\" \\n","b":"x,}"}'}
    values = {"1": 1.0, "-2.5e3": -2500.0, "+Inf": float("inf")}
    times = {"": RECV, " 0": RECV, " 1700000000001": 1700000000001, " -5": -5}
    for (block, stored), (number, value), (time, at) in product(labels.items(), values.items(), times.items()):
        got = samples(prom_text_to_metrics(scrape(spark, f"m:x_1{block} {number}{time}")))
        assert got == [("m:x_1", GAUGE, value, "svc", "box", at, stored)], (block, number, time)


def test_one_bad_line_rejects_its_scrape(spark):
    bad = ["m{=1} 1", 'm{x="1"y="2"} 1', "m{x='1'} 1", "m 1 2 3", "m one", "1m 1", 'm{,x="1"} 1', "m{x} {} 1", "# TYPE a gauge\n# TYPE a counter"]
    df = scrape(spark, "fine 1\n# any comment\n", *["fine 1\n" + b for b in bad])
    assert prom_text_to_metrics(df).count() == 1 and rejected(df).count() == len(bad)
