"""OTLP metrics in their JSON form to samples: one pass per payload, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import values as V
from logloom.functions.timeexpr import event_date
from logloom.schemas import COUNTER, GAUGE, SAMPLE_COLUMNS

# Numbers may be written as JSON numbers or strings, so they are read as text.
_VALUE = "struct<stringValue:string,boolValue:string,intValue:string,doubleValue:string,arrayValue:string,kvlistValue:string,bytesValue:string>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_NUMBER_POINT = f"struct<attributes:{_ATTRS},timeUnixNano:string,asDouble:string,asInt:string,flags:string>"
_TALLY_POINT = f"struct<attributes:{_ATTRS},timeUnixNano:string,sum:string,count:string,flags:string>"
_METRIC = (f"struct<name:string,gauge:struct<dataPoints:array<{_NUMBER_POINT}>>,"
           f"sum:struct<dataPoints:array<{_NUMBER_POINT}>,isMonotonic:string>,"
           f"histogram:struct<dataPoints:array<{_TALLY_POINT}>>,"
           f"exponentialHistogram:struct<dataPoints:array<{_TALLY_POINT}>>,"
           f"summary:struct<dataPoints:array<{_TALLY_POINT}>>>")
PAYLOAD = (f"struct<resourceMetrics:array<struct<resource:struct<attributes:{_ATTRS}>,"
           f"scopeMetrics:array<struct<metrics:array<{_METRIC}>>>>>>")

# The flag bit of a point that recorded nothing, and the name of an unnamed source.
NO_RECORDED_VALUE = 1
UNKNOWN = "unknown"


def _attr_text(v: Column) -> Column:
    return F.coalesce(v["stringValue"], F.lower(v["boolValue"]), v["intValue"],
                      V.shortest_float(v["doubleValue"].try_cast("double")),
                      v["arrayValue"], v["kvlistValue"], v["bytesValue"], F.lit("<nil>"))


def _identity(attrs: Column, key: str) -> Column:
    named = F.filter(attrs, lambda a: (a["key"] == key) & (F.length(a["value"]["stringValue"]) > 0))
    return F.coalesce(F.get(F.reverse(named), F.lit(0))["value"]["stringValue"], F.lit(UNKNOWN))


def _recorded(p: Column) -> Column:
    flags = F.coalesce(p["flags"].try_cast("bigint"), F.lit(0).cast("long"))
    return flags.bitwiseAND(F.lit(NO_RECORDED_VALUE).cast("long")) == 0


def _point(name: Column, type_: Column, value: Column, p: Column) -> Column:
    return F.struct(name.alias("name"), type_.cast("int").alias("type"), value.alias("value"),
                    p["attributes"].alias("attributes"), p["timeUnixNano"].alias("nanos"))


def _number_points(points: Column, name: Column, type_: Column) -> Column:
    def one(p):
        value = F.coalesce(p["asDouble"].try_cast("double"), p["asInt"].try_cast("bigint").cast("double"))
        return _point(name, type_, value, p)
    kept = F.filter(points, lambda p: _recorded(p) & F.coalesce(p["asDouble"], p["asInt"]).isNotNull())
    return F.transform(kept, one)


def _tally_points(points: Column, name: Column, always_sum: bool) -> Column:
    """A distribution keeps its running sum (when it has one) and count; buckets and quantiles go."""
    def two(p):
        total = F.coalesce(p["sum"].try_cast("double"), F.lit(0.0)) if always_sum else p["sum"].try_cast("double")
        n = F.coalesce(p["count"].try_cast("decimal(20,0)").cast("double"), F.lit(0.0))
        both = F.array(_point(F.concat(name, F.lit("_sum")), F.lit(COUNTER), total, p),
                       _point(F.concat(name, F.lit("_count")), F.lit(COUNTER), n, p))
        return F.filter(both, lambda x: x["value"].isNotNull())
    return F.flatten(F.transform(F.filter(points, _recorded), two))


def _read(df: DataFrame, payload: str) -> DataFrame:
    """Adds ``_two``: the payload, and a null that only stands beside it if the payload is one JSON object and nothing more."""
    text = F.btrim(F.col(payload), F.lit(" \t\r\n"))
    alone = F.concat(F.lit("["), text, F.lit(",null]"))
    return df.withColumn("_two", F.when(text.startswith("{") & text.endswith("}"), F.from_json(alone, f"array<{PAYLOAD}>")))


def _whole() -> Column:
    return F.coalesce((F.size("_two") == 2) & F.get("_two", F.lit(0)).isNotNull(), F.lit(False))


def rejected(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The payload rows that can't be read; null ones too."""
    return _read(df, payload).filter(~_whole()).drop("_two")


def otlp_json_to_metrics(df: DataFrame, payload: str = "payload", received: str = "received_at",
                         keep: tuple[str, ...] = ()) -> DataFrame:
    """Payload rows to samples (no ``id`` yet). A payload that ``rejected`` lists yields none."""
    # a payload of another form has a null or no array, of which nothing is left
    got = _read(df, payload).withColumn("_p", F.when(F.size("_two") == 2, F.get("_two", F.lit(0))))
    res = got.select(F.col(received).cast("long").alias("_recv"), *keep,
                     F.explode("_p.resourceMetrics").alias("_r"))
    # a scope may state no metrics; flattening must not see it
    scopes = F.filter("_r.scopeMetrics", lambda s: s["metrics"].isNotNull())
    met = (res.select("_recv", *keep, _identity(F.col("_r.resource.attributes"), "service.name").alias("service"),
                      _identity(F.col("_r.resource.attributes"), "host.name").alias("host"),
                      F.explode(F.flatten(F.transform(scopes, lambda s: s["metrics"]))).alias("_m"))
           .filter(F.length("_m.name") > 0))
    name, none = F.col("_m.name"), F.array()
    sum_type = F.when(F.lower("_m.sum.isMonotonic") == "true", COUNTER).otherwise(GAUGE)
    kinds = [
        _number_points(F.col("_m.gauge.dataPoints"), name, F.lit(GAUGE)),
        _number_points(F.col("_m.sum.dataPoints"), name, sum_type),
        _tally_points(F.col("_m.histogram.dataPoints"), name, False),
        _tally_points(F.col("_m.exponentialHistogram.dataPoints"), name, False),
        _tally_points(F.col("_m.summary.dataPoints"), name, True),
    ]
    # a metric holds one kind, so the first present one is all there is
    pts = met.withColumn("_pt", F.explode(F.coalesce(*kinds)))
    nanos = F.coalesce(F.col("_pt.nanos").try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    ms = F.call_function("div", nanos, F.lit(1_000_000).cast("decimal(20,0)")).cast("long")
    pts = pts.withColumn("_labels", F.transform("_pt.attributes", lambda a: F.struct(
        a["key"].alias("key"), _attr_text(a["value"]).alias("value"))))
    out = pts.withColumns({
        "name": F.col("_pt.name"), "type": F.col("_pt.type"), "value": F.col("_pt.value"),
        "timestamp": F.when(nanos == 0, F.col("_recv")).otherwise(V.clamp_time(ms, F.col("_recv"))),
        "labels": V.sorted_labels("_labels")})
    return out.select(*SAMPLE_COLUMNS, event_date("timestamp").alias("dt"), *keep)
