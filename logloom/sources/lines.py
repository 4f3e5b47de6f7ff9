"""Raw payloads to log rows: envelopes, JSON lines, access logs, plain text.

Everything is column work on one row at a time (no shuffle), so the same function serves
batch and streaming frames. Each ``withColumn`` below names a value several later columns
use, so that it is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import values as V
from logloom.functions.timeexpr import event_date
from logloom.schemas import ERROR, INFO, PARSED_LOG_COLUMNS, WARN

STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
# The white space trimmed from payloads and lines.
_SPACE = (" \t\n\u000b\f\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")

# Where a JSON line may carry its level, time and message, in order.
LEVEL_KEYS = ["level", "lvl", "severity"]
TIME_KEYS = ["ts", "time", "timestamp", "@timestamp", "date"]
MESSAGE_KEYS = ["msg", "message"]
# Only the candidate keys are kept of a JSON line; a repeated key's last value counts.
_LINE = "array<struct<" + ",".join(f"`{k}`:variant" for k in LEVEL_KEYS + TIME_KEYS + MESSAGE_KEYS) + ">>"
# Fixed value: common log format, the referer and agent tail optional.
ACCESS_LINE = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+)(?:\s+"([^"]*)"\s+"([^"]*)")?'
ACCESS_TIME = "dd/MMM/yyyy:HH:mm:ss Z"


def _json_objects(text: Column, schema: str) -> Column:
    """Strictly parsed JSON as the first of two in an array: only if nothing follows it is the array of size two."""
    return F.from_json(F.concat(F.lit("["), text, F.lit(",null]")), schema, STRICT_JSON)


def _last(record: Column, key: str) -> Column:
    """A key's value in a parsed object; the last one when the key repeats."""
    at = F.array_position(F.reverse(F.map_keys(record)), F.lit(key))
    return F.get(F.reverse(F.map_values(record)), at.cast("int") - 1)


def _typed(v: Column) -> Column:
    """A JSON value as its text or its number, whichever it was written as."""
    kind = F.schema_of_variant(v)
    return F.struct(F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).alias("text"),
                    F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, "$", "double")).alias("number"))


def _first(values: Column, convert) -> Column:
    """The first of the typed values that converts."""
    return F.get(F.filter(F.transform(values, convert), lambda x: x.isNotNull()), F.lit(0))


def _record_text(record: Column) -> Column:
    """A whole envelope record as JSON with its keys in order."""
    keys = F.array_sort(F.array_distinct(F.map_keys(record)))
    at = F.reverse(F.map_keys(record))
    vals = F.reverse(F.map_values(record))
    ordered = F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(vals, F.array_position(at, k).cast("int") - 1)))
    return V.escape_json(F.to_json(ordered))


def split_payloads(df: DataFrame, service: str = "service", host: str = "host", payload: str = "payload",
                   received: str = "received_at") -> DataFrame:
    """One row per log line: ``line, envelope_ms, service, host, ingested_at, record`` (and any other columns).

    An envelope is a JSON array whose every record has ``log`` or ``date``; a record without a
    log line travels as ``record``. Anything else is split at newlines.
    """
    others = [c for c in df.columns if c not in (service, host, payload, received)]
    df = df.withColumn("_text", F.btrim(F.col(payload), F.lit(_SPACE)))
    df = df.withColumn("_two", F.when(F.col("_text").startswith("["), _json_objects(F.col("_text"), "array<array<map<string,variant>>>")))
    df = df.withColumn("_env", F.when(F.size("_two") == 2, F.get("_two", F.lit(0))))
    keyed = F.forall("_env", lambda r: r.isNotNull() & (F.map_contains_key(r, "log") | F.map_contains_key(r, "date")))
    df = df.withColumn("_is_env", F.coalesce((F.size("_env") > 0) & keyed, F.lit(False)))

    def from_record(r: Column) -> Column:
        return F.struct(_typed(_last(r, "log")).alias("log"), _typed(_last(r, "date")).alias("date"),
                        _typed(_last(r, "container_name")).alias("container"), r.alias("r"))

    def from_typed(t: Column) -> Column:
        line = F.nullif(F.regexp_replace(t["log"]["text"], r"[\r\n]+\z", ""), F.lit(""))
        return F.struct(
            line.alias("line"), F.when(line.isNull(), _record_text(t["r"])).alias("record"),
            V.epoch_to_ms(t["date"]["number"]).alias("envelope_ms"),
            F.regexp_replace(F.nullif(t["container"]["text"], F.lit("")), "^/", "").alias("container"))

    def from_line(text: Column) -> Column:
        return F.struct(text.alias("line"), F.lit(None).cast("string").alias("record"),
                        F.lit(None).cast("long").alias("envelope_ms"), F.lit(None).cast("string").alias("container"))

    items = (F.when(F.col("_is_env"), F.transform(F.transform("_env", from_record), from_typed))
             .when(F.length("_text") > 0, F.transform(F.split("_text", "\n"), from_line)))
    df = df.withColumn("_item", F.explode(items))
    line = F.when(F.col("_is_env"), F.col("_item.line")).otherwise(F.btrim("_item.line", F.lit(_SPACE)))
    return (df.select(line.alias("line"), F.col("_item.record").alias("record"),
                      F.col("_item.envelope_ms").alias("envelope_ms"),
                      F.coalesce("_item.container", service).alias("service"), F.col(host).alias("host"),
                      F.col(received).cast("long").alias("ingested_at"), *others)
            .filter(F.col("line").isNull() | (F.col("line") != "")))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds ``level, event_ms, message, parsed, raw, format`` to rows with a ``line``; nothing is defaulted yet."""
    df = lines.withColumn("_obj", F.when(F.col("line").startswith("{") & F.col("line").endswith("}"), _json_objects(F.col("line"), _LINE)))
    df = df.withColumn("format", F.when(F.col("line").isNull(), "record").when(F.size("_obj") == 2, "json")
                       .when(F.col("line").rlike(ACCESS_LINE), "access").otherwise("plain"))
    is_json, is_access = F.col("format") == "json", F.col("format") == "access"

    # JSON: type the candidate values, then take the first that converts
    def typed(keys: list[str]) -> Column:
        return F.transform(F.array(*[F.col("_rec")[k] for k in keys]), _typed)

    df = df.withColumn("_rec", F.when(is_json, F.get("_obj", F.lit(0))))
    json_level = _first(typed(LEVEL_KEYS), lambda v: F.coalesce(
        V.level_from_word(v["text"]), V.level_from_number(v["number"])))
    json_ms = _first(typed(TIME_KEYS), lambda v: F.coalesce(
        V.epoch_to_ms(v["number"]), V.time_text_to_ms(v["text"])))
    json_msg = _first(typed(MESSAGE_KEYS), lambda v: F.nullif(v["text"], F.lit("")))

    # access log: the request splits into method, path and protocol only when it has a blank
    def group(i: int) -> Column:
        return F.regexp_extract("line", ACCESS_LINE, i)

    access = F.when(is_access, F.struct(
        group(1).alias("ip"), group(2).alias("user"), group(3).alias("at"), F.split(group(4), " ", 3).alias("req"),
        group(5).cast("int").alias("status"), group(6).alias("bytes"), group(7).alias("referer"),
        group(8).alias("agent")))
    is_plain = F.col("format") == "plain"
    df = df.withColumns({"_a": access, "_tok": F.when(is_plain, F.split("line", " ", 3))})
    status = F.col("_a.status")
    method, path = F.get("_a.req", F.lit(0)), F.coalesce(F.get("_a.req", F.lit(1)), F.lit(""))

    def present(c: str) -> Column:
        return F.when(~F.col(c).isin("", "-"), F.col(c))

    access_json = V.escape_json(F.to_json(F.struct(
        F.when(F.col("_a.bytes").rlike(r"^[+-]?\d+$"), F.col("_a.bytes").try_cast("bigint")).alias("bytes"),
        F.col("_a.ip").alias("ip"), method.alias("method"), path.alias("path"),
        F.nullif(F.get("_a.req", F.lit(2)), F.lit("")).alias("proto"), present("_a.referer").alias("referer"),
        status.alias("status"), present("_a.user").alias("user"), present("_a.agent").alias("user_agent"))))
    access_level = F.when(status >= 500, ERROR).when(status >= 400, WARN).otherwise(INFO)
    access_ms = F.unix_millis(F.try_to_timestamp("_a.at", F.lit(ACCESS_TIME)))
    access_msg = F.concat_ws(" ", method, path, status.cast("string"))

    plain_ms = V.leading_time_to_ms(F.get("_tok", F.lit(0)), F.get("_tok", F.lit(1)))
    out = {
        "level": F.when(is_json, json_level).when(is_access, access_level)
        .when(is_plain, V.plain_level(F.col("line"))).cast("int"),
        "event_ms": F.when(is_json, json_ms).when(is_access, access_ms).when(is_plain, plain_ms),
        "message": F.when(is_json, json_msg).when(is_access, access_msg).when(is_plain, F.col("line")),
        "parsed": F.when(is_json, F.col("line")).when(is_access, access_json).when(~is_plain, F.col("record")),
        "raw": F.coalesce("line", "record"),
    }
    return df.select(*lines.columns, "format", *[c.alias(n) for n, c in out.items()])


def parse_payloads(df: DataFrame, service: str = "service", host: str = "host", payload: str = "payload",
                   received: str = "received_at", clamp: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Payload rows to log rows (no ``id`` yet): split, parse, fall back, clamp.

    The line's own time wins over the envelope's, which wins over the time of receipt;
    a level that can't be read is INFO.
    """
    p = parse_lines(split_payloads(df.select(service, host, payload, received, *keep),
                                   service, host, payload, received))
    ts = F.coalesce("event_ms", "envelope_ms", "ingested_at")
    p = p.withColumns({"timestamp": V.clamp_time(ts, F.col("ingested_at")) if clamp else ts,
                       "level": F.coalesce("level", F.lit(INFO))})
    return p.select(*PARSED_LOG_COLUMNS, event_date("timestamp").alias("dt"), *keep)
