"""Prometheus text exposition to samples.

One row is one scrape, whose size the scraper bounds, so types and samples meet inside the
row and nothing is shuffled. A scrape with a line that can't be read yields nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import values as V
from logloom.functions.timeexpr import event_date
from logloom.schemas import COUNTER, GAUGE, SAMPLE_COLUMNS

# The exposition format.
_NAME = r"[a-zA-Z_:][a-zA-Z0-9_:]*"
_NUMBER = r"[+-]?(?:[Ii][Nn][Ff](?:inity)?|[Nn][Aa][Nn]|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_PAIR = r'[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*"(?:[^"\\]|\\.)*"'
_LABELS = rf"\{{\s*(?:{_PAIR}\s*(?:,\s*{_PAIR}\s*)*,?\s*)?\}}"
SAMPLE = rf"^({_NAME})\s*({_LABELS})?\s*(?<=[\s}}])({_NUMBER})(?:\s+(-?\d+))?$"
TYPE = rf"^#\s+TYPE\s+({_NAME})\s+(\w+)$"
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'


def _unescape(text: Column) -> Column:
    # a doubled backslash is set aside first, so that it can't start another escape
    text = F.replace(text, F.lit("\\\\"), F.lit("\u0000"))
    text = F.replace(F.replace(text, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(text, F.lit("\u0000"), F.lit("\\"))


def _label_entries(block: Column) -> Column:
    keys = F.regexp_extract_all(block, F.lit(LABEL), F.lit(1))
    vals = F.regexp_extract_all(block, F.lit(LABEL), F.lit(2))
    return F.zip_with(keys, vals, lambda k, v: F.struct(k.alias("key"), _unescape(v).alias("value")))


def _family_of(name: Column) -> Column:
    return F.regexp_replace(name, "_(sum|count|bucket)$", "")


def _scrapes(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_lines`` (trimmed, not blank), the declared ``_names`` with their ``_kinds``, and ``_valid``."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    df = df.withColumn("_lines", F.filter(trimmed, lambda x: x != ""))
    df = df.withColumn("_typed", F.filter("_lines", lambda x: x.startswith("#") & x.rlike(TYPE)))
    df = df.withColumn("_names", F.transform("_typed", lambda x: F.regexp_extract(x, TYPE, 1)))
    df = df.withColumn("_kinds", F.transform("_typed", lambda x: F.lower(F.regexp_extract(x, TYPE, 2))))
    readable = F.forall("_lines", lambda x: x.startswith("#") | x.rlike(SAMPLE))
    return df.withColumn("_valid", readable & (F.size(F.array_distinct("_names")) == F.size("_names")))


def rejected(df: DataFrame, text: str = "text") -> DataFrame:
    """The scrapes whose text can't be read."""
    return _scrapes(df, text).filter(~F.col("_valid")).drop("_lines", "_typed", "_names", "_kinds", "_valid")


def _kind_of(name: Column) -> Column:
    return F.get("_kinds", F.array_position("_names", name).cast("int") - 1)


def _kept(s: Column) -> Column:
    """Quantiles and buckets of a distribution go; its running sum and count stay."""
    spread = ["histogram", "summary"]
    return ~(F.coalesce(s["own"].isin(*spread), F.lit(False))
             | (s["name"].endswith("_bucket") & F.coalesce(s["family"].isin(*spread), F.lit(False))))


def prom_text_to_metrics(df: DataFrame, text: str = "text", service: str = "service", host: str = "host",
                         scraped_at: str = "ts", keep: tuple[str, ...] = ()) -> DataFrame:
    """Scrape rows to samples (no ``id`` yet). A sample's own time counts unless it is 0; times are not clamped."""
    got = _scrapes(df.select(text, service, host, scraped_at, *keep), text)
    # the lines that aren't samples leave inside the array, so no filter repeats the parsing below it
    named = F.transform(
        F.filter("_lines", lambda x: F.col("_valid") & ~x.startswith("#")),
        lambda x: F.struct(x.alias("line"), F.regexp_extract(x, SAMPLE, 1).alias("name")))
    kinds = F.transform(named, lambda t: F.struct(
        t["line"].alias("line"), t["name"].alias("name"), _kind_of(t["name"]).alias("own"),
        F.when(t["name"].rlike("_(sum|count|bucket)$"), _kind_of(_family_of(t["name"]))).alias("family")))
    s = got.select("*", F.explode(F.filter(kinds, _kept)).alias("_s"))
    counter = (F.col("_s.own") == "counter") | (F.col("_s.own").isNull() & F.col("_s.family").isin("histogram", "summary"))
    own_ms = F.nullif(F.regexp_extract("_s.line", SAMPLE, 4), F.lit("")).try_cast("bigint")
    out = s.withColumns({
        "name": F.col("_s.name"), "type": F.when(counter, COUNTER).otherwise(GAUGE).cast("int"),
        "value": F.regexp_extract("_s.line", SAMPLE, 3).try_cast("double"),
        "timestamp": F.coalesce(F.nullif(own_ms, F.lit(0).cast("long")), F.col(scraped_at).cast("long")),
        "_entries": _label_entries(F.regexp_extract("_s.line", SAMPLE, 2)),
        "service": F.col(service), "host": F.col(host)})
    return out.select(*[c for c in SAMPLE_COLUMNS if c != "labels"], V.sorted_labels("_entries").alias("labels"),
                      event_date("timestamp").alias("dt"), *keep)
