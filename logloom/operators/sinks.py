"""Appending to the stored tables and exporting results."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.timeexpr import event_date
from logloom.functions.values import shortest_float
from logloom.schemas import LOG_COLUMNS, METRIC_COLUMNS
from logloom.session import read_note, staged, write_note

# Order inside a file, so that Parquet statistics prune by what queries ask for.
LOG_ORDER = ["dt", "service", "timestamp", "id"]
METRIC_ORDER = ["dt", "name", "service", "timestamp", "id"]

#: Below a table: which ids have been given. Not data, so its name starts with an underscore.
LEDGER = "_ids"


def allocate(spark: SparkSession, path: str, span: int, run: str | None = None, batch: int | None = None) -> int:
    """The first of ``span`` ids that no row of the table at ``path`` has; ids only grow.

    A batch of a run that asks again, as after a failure, gets the ids it had. One writer allocates at a time.
    """
    ledger = f"{path.rstrip('/')}/{LEDGER}"
    note = read_note(spark, ledger) or {"next": 0, "runs": {}}
    last = note["runs"].get(run)
    if run is not None and last and last["batch"] == batch and last["span"] >= span:
        return last["first"]
    first = note["next"]
    if first + span > (1 << 63) - 1:
        raise OverflowError("no ids are left")
    if run is not None:
        note["runs"][run] = {"batch": batch, "first": first, "span": span}
    write_note(spark, ledger, note | {"next": first + span})
    return first


@contextmanager
def with_ids(rows: DataFrame, path: str, run: str | None = None, batch: int | None = None) -> Iterator[DataFrame]:
    """Rows with their arrival ``id`` in the table at ``path``: later batches above earlier ones, then by partition and position.

    Rows are staged, so positions are settled; ids leave gaps only where partitions differ in size.
    """
    place = F.monotonically_increasing_id()
    with staged(rows.withColumn("_part", F.shiftright(place, 33))
                .withColumn("_row", place.bitwiseAND(F.lit((1 << 33) - 1).cast("long"))), "append") as held:
        parts, longest = held.agg(F.max("_part") + 1, F.max("_row") + 1).first()
        first = allocate(rows.sparkSession, path, (parts or 0) * (longest or 0), run, batch)
        number = F.lit(first).cast("long") + F.col("_part") * F.lit(longest or 0) + F.col("_row")
        yield held.withColumn("id", number).drop("_part", "_row")


def _append(rows: DataFrame, columns: list[str], order: list[str], path: str, cluster: bool) -> None:
    with with_ids(rows, path) as numbered:
        out = numbered.select(*columns, event_date("timestamp").alias("dt"))
        if cluster:
            # parts of about one size, a hot date or sender being split; no sampling
            out = out.hint("rebalance", *order[:2])
        out.sortWithinPartitions(*(order if cluster else ["dt"])).write.mode("append").partitionBy("dt").parquet(path)


def append_logs(rows: DataFrame, path: str, cluster: bool = True) -> None:
    """Appends parsed lines. ``cluster=False`` skips the shuffle, for small loads."""
    _append(rows, LOG_COLUMNS, LOG_ORDER, path, cluster)


def append_metrics(rows: DataFrame, path: str, cluster: bool = True) -> None:
    rows = rows.withColumn("labels", F.nullif("labels", F.lit("")))
    _append(rows, METRIC_COLUMNS, METRIC_ORDER, path, cluster)


def append_firings(firings: DataFrame, path: str) -> None:
    """Appends audit rows of alert firings, partitioned by the date they fired."""
    firings.withColumn("dt", event_date("fired_at")).write.mode("append").partitionBy("dt").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Header and one line per row; NULL is empty, numbers are in their shortest form."""
    cells = [shortest_float(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`")
             for c, t in df.dtypes]
    (df.select(*cells).write.option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def export_json(df: DataFrame, path: str) -> None:
    """One object per row, NULL fields included."""
    df.write.option("ignoreNullFields", False).json(path)
