"""Alert rules: which are due, what they matched, and the next state.

Rules, state and outcomes are plain DataFrames keyed by rule id; ``step`` is a pure function of
them and of ``now``, so a tick can be repeated after a failure with the same result.

rules:    id, name, check_interval_ms, cooldown_ms, enabled
state:    id, last_checked_at, last_fired_at, currently_firing, last_error, last_error_at
outcomes: id, n_rows, matched, message, error (of the query), notify_error (of the delivery)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.timeexpr import newer_than
from logloom.functions.values import escape_json, shortest_float
from logloom.operators.shape import cut_at_rune
from logloom.operators.windows import top_per_key
from logloom.schemas import MINUTE_MS

# Shortest interval, and the sizes of the audit payload and of the message unless stated otherwise.
MIN_INTERVAL_MS = 30_000
AUDIT_ROWS, MESSAGE_ROWS, MAX_TEXT_BYTES = 20, 5, 200
MORE = "…"

STATE = ("id long, last_checked_at long, last_fired_at long, currently_firing boolean, last_error string,"
         " last_error_at long")


def due(rules: DataFrame, state: DataFrame, now: int) -> DataFrame:
    """Enabled rules never checked, or last checked at least one interval ago."""
    seen = state.select("id", "last_checked_at")
    waited = F.lit(now) - F.col("last_checked_at")
    interval = F.greatest(F.col("check_interval_ms"), F.lit(MIN_INTERVAL_MS))
    return (rules.filter("enabled").join(seen, "id", "left")
            .filter(F.col("last_checked_at").isNull() | (waited >= interval)).drop("last_checked_at"))


def _json_row(columns: Sequence[tuple[str, str]], text_bytes: int) -> Column:
    """A row as a struct for JSON: keys in order, long texts cut."""
    cells = [cut_at_rune(F.col(f"`{c}`"), text_bytes, MORE).alias(c) if t == "string" else F.col(f"`{c}`").alias(c)
             for c, t in sorted(columns)]
    return F.struct(*cells)


def _text_row(columns: Sequence[tuple[str, str]], text_bytes: int) -> Column:
    """A row as ``col=value`` words, NULLs left out, cut."""
    cells = []
    for c, t in columns:
        v = shortest_float(F.col(f"`{c}`")) if t in ("double", "float") else F.col(f"`{c}`").cast("string")
        cells.append(F.concat(F.lit(f"{c}="), v))
    return cut_at_rune(F.concat_ws(" ", *cells), text_bytes, MORE)


def _payload(top: DataFrame, keys: Sequence[str], columns: Sequence[tuple[str, str]], shown: int, text_bytes: int) -> DataFrame:
    """Per key, its few numbered rows as one JSON text and the first ``shown`` as lines."""
    rows = top.select(*keys, F.struct("rn", _json_row(columns, text_bytes).alias("j"), _text_row(columns, text_bytes).alias("t")).alias("r"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("r")).alias("r"))  # as many as the audit keeps
    json = F.to_json(F.transform("r", lambda x: x["j"]), {"ignoreNullFields": "false"})
    lines = F.transform(F.filter("r", lambda x: x["rn"] <= shown), lambda x: x["t"])
    return listed.select(*keys, escape_json(json).alias("matched"), lines.alias("lines"))


def _message(n: Column, lines: Column, shown: int) -> Column:
    more = F.when(n > shown, F.concat(F.lit(f"\n{MORE} and "), (n - shown).cast("string"), F.lit(" more")))
    return F.concat(n.cast("string"), F.lit(" matching row(s)\n"), F.array_join(lines, "\n"), F.coalesce(more, F.lit("")))


def _outcome_columns(df: DataFrame, shown: int) -> DataFrame:
    n = F.coalesce("n_rows", F.lit(0)).cast("long")
    return df.select("id", n.alias("n_rows"), F.col("matched"),
                     F.when(n > 0, _message(n, F.col("lines"), shown)).alias("message"),
                     F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("notify_error"))


def outcome(rule_id: int, rows: DataFrame, order: Sequence[Column], audit_rows: int = AUDIT_ROWS,
            message_rows: int = MESSAGE_ROWS, text_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    """What one rule's query matched: it fires when there is any row. ``order`` says which rows are shown.

    The rows shown are a top-k and the count is a sum of partial counts, so nothing large is gathered.
    """
    columns = rows.dtypes
    shown = rows.orderBy(*order).limit(audit_rows).select(F.lit(rule_id).cast("long").alias("id"), "*")
    top = top_per_key(shown, ["id"], order, audit_rows)
    shown_json = _payload(top, ["id"], columns, message_rows, text_bytes)
    n = rows.agg(F.count("*").alias("n_rows")).select(F.lit(rule_id).cast("long").alias("id"), "n_rows")
    both = n.unionByName(shown_json, allowMissingColumns=True)
    return _outcome_columns(both.groupBy("id").agg(
        F.max("n_rows").alias("n_rows"), F.max("matched").alias("matched"), F.first("lines", True).alias("lines")), message_rows)


def failed(spark, rule_id: int, error: str) -> DataFrame:
    """The outcome of a rule whose query could not be run."""
    return spark.range(1).select(
        F.lit(rule_id).cast("long").alias("id"), F.lit(None).cast("long").alias("n_rows"),
        F.lit(None).cast("string").alias("matched"), F.lit(None).cast("string").alias("message"),
        F.lit(error).alias("error"), F.lit(None).cast("string").alias("notify_error"))


def grouped_outcomes(rules: DataFrame, matches: DataFrame, order: Sequence[Column], audit_rows: int = AUDIT_ROWS,
                     message_rows: int = MESSAGE_ROWS, text_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    """Outcomes of many rules at once; ``matches`` has the rule ``id`` beside each matched row."""
    columns = [x for x in matches.dtypes if x[0] != "id"]
    top = top_per_key(matches, ["id"], order, audit_rows)
    counts = matches.groupBy("id").agg(F.count("*").alias("n_rows"))
    return _outcome_columns(rules.select("id").join(counts, "id", "left")
                            .join(_payload(top, ["id"], columns, message_rows, text_bytes), "id", "left"), message_rows)


def threshold_matches(rules: DataFrame, logs: DataFrame, now: int) -> DataFrame:
    """Threshold rules over one shared aggregate: ``id, service, lines`` of every rule that is exceeded.

    Rules add ``service, min_level, window_ms, threshold``; windows are whole minutes. Lines are counted per
    service, level and minute of age, as far back as the longest window. A count is then added to each distinct
    (lowest level, minutes) that rules ask for, which are listed once, and rules meet the sums on
    (service, level, minutes): no join is on a bare service.
    """
    minutes = F.ceil(F.col("window_ms") / MINUTE_MS).cast("long")
    asked = rules.select("id", "service", "min_level", minutes.alias("minutes"), "threshold")
    # as many as rules differ in level and window, not as there are rules
    frames = [(r.min_level, r.minutes) for r in asked.select("min_level", "minutes").distinct().collect()]
    if not frames:
        return asked.select("id", "service", F.lit(0).cast("long").alias("lines"))
    age = F.call_function("div", F.lit(now) - F.col("timestamp"), F.lit(MINUTE_MS).cast("long"))
    counted = (newer_than(logs, now - max(m for _, m in frames) * MINUTE_MS).filter(F.col("timestamp") <= now)
               .groupBy("service", "level", age.alias("age")).agg(F.count("*").alias("n")))
    every = F.array(*[F.struct(F.lit(lowest).alias("min_level"), F.lit(m).cast("long").alias("minutes")) for lowest, m in frames])
    inside = F.filter(every, lambda f: (F.col("level") >= f["min_level"]) & (F.col("age") < f["minutes"]))
    sums = (counted.select("service", "n", F.explode(inside).alias("f"))
            .groupBy("service", F.col("f.min_level").alias("min_level"), F.col("f.minutes").alias("minutes")).agg(F.sum("n").alias("lines")))
    return (sums.join(asked, ["service", "min_level", "minutes"])
            .filter(F.col("lines") > F.col("threshold")).select("id", "service", "lines"))


def _judged(rules: DataFrame, state: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    known = rules.select("id", "cooldown_ms").join(state, "id", "left")
    j = known.join(outcomes.withColumn("_evaluated", F.lit(True)), "id", "left")
    cooled = F.col("last_fired_at").isNull() | (F.lit(now) - F.col("last_fired_at") >= F.col("cooldown_ms"))
    evaluated = F.coalesce("_evaluated", F.lit(False))
    answered = evaluated & F.col("error").isNull()
    firing = answered & (F.coalesce("n_rows", F.lit(0)) > 0)
    return (j.withColumn("_evaluated", evaluated).withColumn("_answered", answered).withColumn("_firing", firing)
            .withColumn("_notify", firing & cooled))


def to_notify(rules: DataFrame, state: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """The rules to send a message for: firing, and not within their cooldown."""
    return _judged(rules, state, outcomes, now).filter("_notify").select("id", "n_rows", "message")


def step(rules: DataFrame, state: DataFrame, outcomes: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(next state, firings to append). A failed delivery leaves ``last_fired_at``, so it is tried again."""
    j = _judged(rules, state, outcomes, now)
    sent = F.col("_notify") & F.col("notify_error").isNull()
    undelivered = F.when(F.col("_notify") & F.col("notify_error").isNotNull(),
                         F.concat(F.lit("notification failed: "), F.col("notify_error")))
    t = F.lit(now).cast("long")
    error = F.when(~F.col("_evaluated"), F.col("last_error")).otherwise(F.coalesce("error", undelivered))
    state2 = j.select(
        "id",
        F.when(F.col("_evaluated"), t).otherwise(F.col("last_checked_at")).alias("last_checked_at"),
        F.when(sent, t).otherwise(F.col("last_fired_at")).alias("last_fired_at"),
        F.when(F.col("_answered"), F.col("_firing")).otherwise(F.coalesce("currently_firing", F.lit(False)))
        .alias("currently_firing"),
        error.alias("last_error"),
        F.when(~F.col("_evaluated"), F.col("last_error_at")).when(error.isNotNull(), t).alias("last_error_at"))
    firings = j.filter("_notify").select(
        F.col("id").alias("alert_id"), t.alias("fired_at"), F.col("matched").alias("matched_rows"),
        sent.alias("notification_sent"))
    return state2, firings
