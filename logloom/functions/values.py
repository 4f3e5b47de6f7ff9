"""Turning loosely typed log and metric values into model values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.schemas import DEBUG, DAY_MS, ERROR, FATAL, INFO, TRACE, WARN

# Level words.
LEVEL_WORDS = {
    "trace": TRACE,
    "debug": DEBUG,
    "info": INFO, "information": INFO,
    "warn": WARN, "warning": WARN,
    "error": ERROR, "err": ERROR,
    "fatal": FATAL, "panic": FATAL, "critical": FATAL,
}
# Fixed value: the words looked for in plain text.
PLAIN_LEVEL_WORDS = "trace|debug|info|warn|warning|error|fatal|panic|critical"

# How far a client's event time may be from the time of receipt.
MAX_FUTURE_MS = DAY_MS
MAX_PAST_MS = 3650 * DAY_MS

# Date and time with seconds and an optional fraction; a zone only after the T form.
_TIME_T = r"^\d{4}-\d{2}-\d{2}T\d{1,2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})?$"
_TIME_BLANK = r"^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}:\d{2}([.,]\d+)?$"
_ZONE = r"(Z|[+-]\d{2}:\d{2})$"


def level_from_word(word: Column) -> Column:
    pairs = [F.lit(x) for item in LEVEL_WORDS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.lower(word))


def level_from_number(number: Column) -> Column:
    """0-5 as they are, 10..60 in tens as the Bunyan scale; the fraction is cut."""
    n = number.try_cast("bigint")
    tens = n.between(10, 60) & (n % 10 == 0)
    return (F.when(n.between(0, 5), n).when(tens, F.call_function("div", n, F.lit(10).cast("long")) - 1)
            .cast("int"))


def epoch_to_ms(number: Column) -> Column:
    """An epoch of unknown unit (s, ms, us, ns) in milliseconds; NULL when it is not positive."""
    v = number
    ms = (F.when(v < 1e11, v * 1000).when(v < 1e14, v).when(v < 1e17, v / 1e3).otherwise(v / 1e6))
    return F.nullif(F.when(v > 0, ms).try_cast("bigint"), F.lit(0).cast("long"))


def time_text_to_ms(text: Column) -> Column:
    """RFC 3339 or ``date time`` text in milliseconds (UTC when it has no zone), else NULL."""
    zoned = F.when(text.rlike(_TIME_T) & text.rlike(_ZONE), text).when(
        text.rlike(_TIME_T) | text.rlike(_TIME_BLANK), F.concat(text, F.lit("Z")))
    ms = F.unix_millis(F.try_to_timestamp(F.replace(zoned, F.lit(","), F.lit("."))))
    return F.nullif(ms, F.lit(0).cast("long"))


def leading_time_to_ms(first: Column, second: Column) -> Column:
    """The time a plain line starts with, from its first two tokens."""
    return time_text_to_ms(F.when(first.rlike(_TIME_T), first).otherwise(F.concat_ws(" ", first, second)))


def plain_level(line: Column) -> Column:
    """The first level word of a line that stands on its own."""
    word = F.regexp_extract(line, rf"(?i)(?<![0-9A-Za-z_])({PLAIN_LEVEL_WORDS})(?![0-9A-Za-z_])", 1)
    return level_from_word(F.nullif(word, F.lit("")))


def clamp_time(ts: Column, received: Column) -> Column:
    """Event times absurdly far from the time of receipt give way to it."""
    return F.when(ts.between(received - MAX_PAST_MS, received + MAX_FUTURE_MS), ts).otherwise(received)


def escape_json(text: Column) -> Column:
    """``<``, ``>``, ``&`` and the two line separators in JSON text as unicode escapes, the stored form."""
    for ch, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"),
                     ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        text = F.replace(text, F.lit(ch), F.lit(code))
    return text


def lenient_int(text: Column) -> Column:
    """Text to integer the forgiving way: the leading digits, or 0 when there are none."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("bigint"), F.lit(0))


def shortest_float(number: Column) -> Column:
    """A double in its shortest form: plain for exponents -4..5, else mantissa and two-digit exponent."""
    s = number.cast("string")
    has_exp = s.contains("E")
    mantissa = F.when(has_exp, F.substring_index(s, "E", 1)).otherwise(s)
    sign = F.when(s.startswith("-"), "-").otherwise("")
    unsigned = F.regexp_replace(mantissa, "^-", "")
    whole, frac = F.substring_index(unsigned, ".", 1), F.substring_index(unsigned, ".", -1)
    # exponent of the first digit: from the E form, or from the digits before the point (1e6..1e7)
    exponent = F.when(has_exp, F.substring_index(s, "E", -1).try_cast("int")).otherwise(F.length(whole) - 1)
    digits = F.regexp_replace(F.concat(whole, frac), "0+$", "")
    sci_mantissa = F.concat(F.substring(digits, 1, 1),
                            F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""))
    sci = F.concat(sign, sci_mantissa, F.when(exponent < 0, "e-").otherwise("e+"),
                   F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"))
    small = F.concat(sign, F.lit("0.000"), digits)  # 1e-4 <= |x| < 1e-3
    plain = F.regexp_replace(s, r"\.0$", "")
    size = F.abs(number)
    return (F.when(F.isnan(number), "NaN")
            .when(size == float("inf"), F.concat(F.when(number > 0, "+").otherwise("-"), F.lit("Inf")))
            .when(number == 0, "0")
            .when((size >= 1e6) | (size < 1e-4), sci)
            .when(size < 1e-3, small)
            .otherwise(plain))


def sorted_labels(entries: str) -> Column:
    """A column of label entries ``array<struct<key, value>>`` as canonical JSON: keys sorted, the last duplicate wins.

    No entries give NULL; entries without a key are left out.
    """
    keys = F.array_sort(F.array_distinct(F.filter(F.transform(entries, lambda e: e["key"]), lambda k: F.length(k) > 0)))

    def newest(k):
        return F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]

    text = escape_json(F.to_json(F.map_from_entries(F.transform(keys, lambda k: F.struct(k, newest(k))))))
    return F.when(F.size(entries) > 0, text)
