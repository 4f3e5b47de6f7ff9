"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import delete_path, scratch_path

#: Where the paths of written tables are noted, innermost last.
_noted: list[list[str]] = [[]]


#: Bytes of the rows that go to a Python worker at a time, whatever the length of their texts.
BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    """Bounds what goes to Python at a time by bytes, unless the session does: rows alone say little of long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read back: a lost executor costs a read, not the work."""
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    keep(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(path: str) -> None:
    """Notes a path that is to be deleted once its readers are done."""
    _noted[-1].append(path)


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Within the block, paths of written tables are added to ``paths``."""
    _noted.append(paths)
    try:
        yield
    finally:
        _noted.pop()


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes noted tables; for when every result that reads them has been written."""
    paths = _noted[0] if paths is None else paths
    while paths:
        delete_path(spark, paths.pop())


def join_few(df: DataFrame, few: DataFrame, on: str, rows: int, at_most: int = 100_000, salts: int = 32) -> DataFrame:
    """Left join (null keys meet) with a table of one row per key, ``rows`` in all.

    Up to ``at_most`` rows it is broadcast. Beyond that both sides are shuffled by key and a salt, with each
    key of ``few`` repeated per salt, so that a hot key of ``df`` is spread over ``salts`` tasks.
    """
    few = few.withColumnRenamed(on, f"__{on}")
    same = F.col(on).eqNullSafe(F.col(f"__{on}"))
    if rows <= at_most:
        return df.join(F.broadcast(few), same, "left").drop(f"__{on}")
    few = few.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    df = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return df.join(few, same & (F.col("__salt") == F.col("__salt2")), "left").drop(f"__{on}", "__salt", "__salt2")
