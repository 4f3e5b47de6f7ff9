"""Log lines, envelopes, times and levels: lines put together from parts, and what the rules make of the parts."""

import json
import random
from itertools import product

from pyspark.sql import functions as F

from logloom.functions import values as V
from logloom.sources import lines as L
from logloom.sources.lines import parse_lines, parse_payloads

RECV = 1_754_000_000_000


def parsed(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string").withColumn("record", F.lit(None).cast("string"))
    return parse_lines(df).orderBy("n").collect()


#: What a candidate key may hold, and what it then says; None where the next key is asked.
LEVEL_VALUES = [(w, n) for w, n in V.LEVEL_WORDS.items()] + [(w.title(), n) for w, n in V.LEVEL_WORDS.items()] + [
    (0, 0), (5, 5), (2.9, 2), (10, 0), (60, 5), (6, None), (70, None), (15, None), (-1, None), ("", None), ("loud", None), ("3", None),
    (True, None), (None, None), ([1], None), ({"a": 1}, None)]
TIME_VALUES = [(1754, 1_754_000), (99_999_999_999, 99_999_999_999_000), (1754000000123, 1754000000123), (1754000000123456, 1754000000123),
               (1754000000123456789, 1754000000123), (12.5, 12_500), ("2025-08-01T00:00:00Z", 1754006400000),
               ("2025-08-01T02:00:00.25+02:00", 1754006400250), ("2025-08-01 0:00:01", 1754006401000), ("2025-08-01T00:00:00,5", 1754006400500),
               ("2025-08-01", None), ("1754000000", None), (0, None), (-7, None), ("soon", None), (False, None), (None, None)]
MESSAGE_VALUES = [("text", "text"), (" ", " "), ("\u00e9\n", "\u00e9\n"), ("", None), (5, None), (None, None), (["x"], None)]


def test_json_lines_ask_their_keys_in_order(spark):
    """Random objects: each candidate key is missing or holds some value; the first value that says something counts."""
    rng = random.Random(11)
    lines, expected = [], []
    for _ in range(400):
        fields, want = [], []
        for keys, options in ((L.LEVEL_KEYS, LEVEL_VALUES), (L.TIME_KEYS, TIME_VALUES), (L.MESSAGE_KEYS, MESSAGE_VALUES)):
            own = {k: rng.choice(options) for k in keys if rng.random() < 0.5}
            fields += [(k, v) for k, (v, _) in own.items()]
            want.append(next((own[k][1] for k in keys if k in own and own[k][1] is not None), None))
        rng.shuffle(fields)
        lines.append(json.dumps(dict([*fields, ("other", rng.random())])))
        expected.append(tuple(want))
    for row, line, want in zip(parsed(spark, lines), lines, expected):
        assert (row.format, row.level, row.event_ms, row.message, row.parsed, row.raw) == ("json", *want, line, line), line


def test_what_is_no_json_line(spark):
    body = '{"msg":"m"}'
    for row in parsed(spark, [body + "x", body + body, body[:-1], "[" + body + "]", '{"msg":NaN}', "{msg:1}", body + ",", body + "]", body + ",null", body + ",null]"]):
        assert row.format == "plain" and row.message == row.raw


def test_access_lines_from_their_parts(spark):
    """All combinations of a client, a user, a time, a request, a status, a size and a tail."""
    times = {"01/Aug/2025:00:00:00 +0000": 1754006400000, "31/Jul/2025:19:30:00 -0430": 1754006400000, "never": None}
    requests = {"GET / HTTP/3": ("GET", "/", "HTTP/3"), "PATCH /a/b?c=%20": ("PATCH", "/a/b?c=%20", None), "junk": ("junk", "", None), "": ("", "", None)}
    parts = list(product(["fe80::1", "host.example"], ["-", "u1"], times, requests, [100, 399, 400, 499, 500, 999], ["-", "0", "77"],
                         ["", ' "-" "agent x"', ' "http://r/" "-"']))
    random.Random(3).shuffle(parts)
    parts = parts[:500]
    lines = [f'{ip} ident {user} [{at}] "{req}" {status} {size}{tail}' for ip, user, at, req, status, size, tail in parts]
    for row, (ip, user, at, req, status, size, tail) in zip(parsed(spark, lines), parts):
        method, path, proto = requests[req]
        assert row.format == "access" and row.event_ms == times[at] and row.message == f"{method} {path} {status}"
        assert row.level == (4 if status >= 500 else 3 if status >= 400 else 2)
        want = {"ip": ip, "method": method, "path": path, "status": status, "proto": proto, "user": None if user == "-" else user,
                "bytes": None if size == "-" else int(size), "user_agent": "agent x" if "agent" in tail else None,
                "referer": "http://r/" if "http" in tail else None}
        assert json.loads(row.parsed) == {k: v for k, v in want.items() if v is not None}


def test_plain_lines(spark):
    """A leading time in any form, then words; a level is a word of its own, in any case."""
    times = {"": None, "2025-08-01T00:00:00Z ": 1754006400000, "2025-08-01 00:00:00.125 ": 1754006400125, "08/01/2025 ": None}
    bodies = {"terror in_error": None, "an Error!": 4, "(WARN)": 3, "all quiet": None}
    combos = list(product(times, bodies))
    for row, (at, body) in zip(parsed(spark, [a + b for a, b in combos]), combos):
        assert (row.format, row.event_ms, row.level, row.message, row.parsed) == ("plain", times[at], bodies[body], at + body, None), row.raw


def payloads(spark, *texts):
    return spark.createDataFrame([("svc", "hst", t, RECV) for t in texts], "service string, host string, payload string, received_at long")


def test_payloads_are_their_lines(spark):
    """Whatever ends and surrounds lines, each that is not blank is a row, with the fall-backs of the payload."""
    rng = random.Random(7)
    for _ in range(5):
        kept = [f"w{rng.randrange(99)}" for _ in range(rng.randrange(4))]
        blank = [rng.choice(["", "  ", "\t", "\u00a0", "\u2003 "]) for _ in range(4)]
        mixed = kept + blank
        rng.shuffle(mixed)
        text = "".join(rng.choice(["", " ", "\t"]) + x + rng.choice(["\n", "\r\n", " \n"]) for x in mixed)
        got = parse_payloads(payloads(spark, text)).collect()
        assert sorted((r.message, r.level, r.timestamp, r.service, r.host) for r in got) == sorted((k, 2, RECV, "svc", "hst") for k in kept)


def test_envelopes_from_their_parts(spark):
    """Records with and without a line, a time of their own, a time of the envelope and a container."""
    records, expected = [], []
    for line_time, envelope_time, container, has_line in product([None, 1753990000], [None, 1753980000.5], [None, "/box", "box"], [True, False]):
        if not has_line and not envelope_time:
            continue  # not a record of an envelope
        record, k = {}, len(records)
        if has_line:
            record["log"] = json.dumps({"msg": f"r{k}", **({"ts": line_time} if line_time else {})}) + "\n"
        else:
            record["k"] = f"<{k}>"
        if envelope_time:
            record["date"] = envelope_time
        if container:
            record["container_name"] = container
        at = line_time * 1000 if has_line and line_time else int(envelope_time * 1000) if envelope_time else RECV
        records.append(record)
        expected.append((f"r{k}" if has_line else None, at, "box" if container else "svc"))
    got = parse_payloads(payloads(spark, json.dumps(records))).collect()
    assert sorted(((r.message, r.timestamp, r.service) for r in got), key=repr) == sorted(expected, key=repr)
    for r in got:
        if r.message is None:
            assert r.raw == r.parsed and json.loads(r.raw) in records and "\\u003c" in r.raw


def test_what_is_no_envelope(spark):
    record = '{"log":"x"}'
    texts = ["[7]", "[null]", f"[{record},{{}}", f"[{record}]]", "[]", f"[{record},\"y\"]"]
    for text in texts:
        assert [r.raw for r in parse_payloads(payloads(spark, text)).collect()] == [text], text


def test_clamp(spark):
    day = 86_400_000
    df = spark.createDataFrame([(RECV + day,), (RECV + day + 1,), (RECV - 3650 * day,), (RECV - 3650 * day - 1,)], "ts long")
    got = [r[0] for r in df.select(V.clamp_time(F.col("ts"), F.lit(RECV))).collect()]
    assert got == [RECV + day, RECV, RECV - 3650 * day, RECV]


def test_epoch_units(spark):
    cases = [(-1.0, None), (0.0, None), (1754990000.0, 1754990000000), (1754990000123.0, 1754990000123),
             (1754990000123456.0, 1754990000123), (1.754990000123456e18, 1754990000123)]
    df = spark.createDataFrame(cases, "v double, want long")
    assert df.filter(~V.epoch_to_ms(F.col("v")).eqNullSafe(F.col("want"))).count() == 0


def test_shortest_float(spark):
    cases = [(0.5, "0.5"), (100.0, "100"), (123456.0, "123456"), (1234567.0, "1.234567e+06"), (1e6, "1e+06"),
             (-1.5e7, "-1.5e+07"), (1e21, "1e+21"), (0.0001, "0.0001"), (0.00012, "0.00012"), (0.00001, "1e-05"),
             (0.0, "0"), (float("inf"), "+Inf"), (-2.25, "-2.25"), (1e100, "1e+100"), (999999.5, "999999.5")]
    got = [r[0] for r in spark.createDataFrame(cases, "v double, want string").coalesce(1)
           .select(V.shortest_float(F.col("v"))).collect()]
    assert got == [w for _, w in cases]
