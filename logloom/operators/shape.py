"""Result shaping: full bucket grids, adaptive bucket widths, bounded and truncated results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.schemas import DAY_MS, HOUR_MS, MINUTE_MS

# The budgets of a response unless its caller states others, and the widths a chart may pick from.
RESULT_ROWS = 10_000
DEFAULT_ROWS = 200
API_MAX_ROWS = 1000
MAX_CELL_BYTES = 4096
ADAPTIVE_STEPS_MS = [
    1000, 5000, 15_000, 30_000, MINUTE_MS, 5 * MINUTE_MS, 10 * MINUTE_MS, 30 * MINUTE_MS,
    HOUR_MS, 3 * HOUR_MS, 6 * HOUR_MS, 12 * HOUR_MS, DAY_MS,
]
MAX_BARS = 120


def grid_bounds(from_ms: int, to_ms: int, bucket_ms: int) -> tuple[int, int]:
    """First and last bucket start of a window."""
    return from_ms // bucket_ms * bucket_ms, to_ms // bucket_ms * bucket_ms


def gap_fill(df: DataFrame, *, start_ms: int, end_ms: int, bucket_ms: int, zero: bool,
             bucket_col: str = "bucket") -> DataFrame:
    """Re-index a bucketed result onto the whole grid.

    A bucket without a row becomes 0 when ``zero`` (nothing was counted) and NULL otherwise
    (unknown); NULLs inside present rows stay. Rows off the grid go. A window of no whole
    bucket leaves the result as it is.
    """
    steps = (end_ms - start_ms) // bucket_ms
    if steps <= 0:
        return df
    grid = df.sparkSession.range(steps + 1).select(
        (F.lit(start_ms) + F.col("id") * F.lit(bucket_ms)).cast("long").alias(bucket_col))
    values = [c for c in df.columns if c != bucket_col]
    present = df.withColumn("_present", F.lit(True))
    joined = grid.join(present, bucket_col, "left")
    if zero:
        types = dict(df.dtypes)
        cells = [F.when(F.col("_present").isNull(), F.lit(0).cast(types[c])).otherwise(F.col(f"`{c}`")).alias(c)
                 for c in values]
    else:
        cells = [F.col(f"`{c}`") for c in values]
    return joined.select(bucket_col, *cells).orderBy(bucket_col)


def adaptive_bucket_ms(span_ms: int) -> int:
    """Bucket width that draws a window as at most about 120 bars; whole days beyond the list."""
    for step in ADAPTIVE_STEPS_MS:
        if span_ms // step <= MAX_BARS:
            return step
    return (span_ms // MAX_BARS // DAY_MS + 1) * DAY_MS


def adaptive_bucket_column(span_ms: Column) -> Column:
    """The same choice for a column of spans."""
    out = (F.floor(span_ms / F.lit(MAX_BARS) / F.lit(DAY_MS)) + 1) * F.lit(DAY_MS)
    for step in reversed(ADAPTIVE_STEPS_MS):
        out = F.when(F.floor(span_ms / F.lit(step)) <= MAX_BARS, F.lit(step)).otherwise(out)
    return out.cast("long")


def bounded(df: DataFrame, n: int = RESULT_ROWS) -> tuple[list, bool]:
    """At most ``n`` rows, which go to the driver, and whether there were more."""
    rows = df.limit(n + 1).collect()
    return rows[:n], len(rows) > n


def api_rows(max_rows: int | None, most: int = API_MAX_ROWS, default: int = DEFAULT_ROWS) -> int:
    """Row budget of a programmatic caller: what was asked for, up to ``most``; ``default`` if nothing was."""
    return min(max_rows, most) if max_rows and max_rows > 0 else default


def cut_at_rune(text: Column, max_bytes: int, marker: str) -> Column:
    """Text longer than ``max_bytes`` of UTF-8, cut at a character boundary and marked."""
    data = F.encode(text, "utf-8")
    # a 4-byte character needs at most three bytes given back
    head = F.lit(None).cast("string")
    for back in (3, 2, 1, 0):
        piece = F.substring(data, 1, max_bytes - back).cast("string")
        head = F.when(F.is_valid_utf8(piece), piece).otherwise(head)
    return F.when(F.octet_length(text) > max_bytes, F.concat(head, F.lit(marker))).otherwise(text)


def clamp_cells(df: DataFrame, max_bytes: int = MAX_CELL_BYTES, marker: str = "…(truncated)") -> DataFrame:
    """Bound every string cell of a result."""
    return df.select(*[cut_at_rune(F.col(f"`{c}`"), max_bytes, marker).alias(c) if t == "string" else F.col(f"`{c}`")
                       for c, t in df.dtypes])


def api_result(df: DataFrame, max_rows: int | None = None, most: int = API_MAX_ROWS,
               max_bytes: int = MAX_CELL_BYTES) -> tuple[list[str], list, bool]:
    """Columns, bounded rows and the truncated flag of one programmatic query."""
    rows, truncated = bounded(clamp_cells(df, max_bytes), api_rows(max_rows, most))
    return df.columns, rows, truncated


def display_order(df: DataFrame, keys: Sequence[str] = ("timestamp", "id")) -> DataFrame:
    """Viewer rows oldest first, whatever order selected them."""
    return df.orderBy(*keys)
