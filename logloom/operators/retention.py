"""Retention on tables partitioned by event date: whole days are dropped, only the boundary day is rewritten."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.timeexpr import utc_date
from logloom.schemas import DAY_MS
from logloom.session import delete_path, folders, move, read_note, write_note

# Days kept unless a valid setting says otherwise.
DEFAULT_DAYS = {"logs": 30, "metrics": 90, "firings": 90}
MIN_DAYS, MAX_DAYS = 1, 3650


def retention_days(setting: str | None, default: int) -> int:
    """A day count from a setting; unset, not a number or out of range means the default, never a mass delete."""
    try:
        n = int(setting)
    except (TypeError, ValueError):
        return default
    return n if MIN_DAYS <= n <= MAX_DAYS else default


def threshold_ms(days: int, now: int) -> int:
    return now - days * DAY_MS


def expired_count(rows: DataFrame, threshold: int, ts: str = "timestamp") -> int:
    cond = F.col(ts) < threshold
    if "dt" in rows.columns:
        cond = (F.col("dt") <= F.lit(utc_date(threshold))) & cond
    return rows.filter(cond).count()


def kept(rows: DataFrame, threshold: int, ts: str = "timestamp") -> DataFrame:
    """The rows that stay, for tables without date partitions."""
    cond = F.col(ts) >= threshold
    if "dt" in rows.columns:
        cond = (F.col("dt") >= F.lit(utc_date(threshold))) & cond
    return rows.filter(cond)


def _drop_days(spark: SparkSession, path: str, before: dt.date) -> int:
    """Removes the partition folders of all days before a date and returns how many rows they held."""
    old = [folder for day, folder in folders(spark, path, "dt").items() if day < before.isoformat()]
    if not old:
        return 0
    held = spark.read.parquet(*old).count()
    for folder in old:
        delete_path(spark, folder)
    return held


def replace_day(spark: SparkSession, path: str, day: dt.date, change: Callable[[DataFrame], DataFrame],
                always: bool = False) -> int:
    """Replaces the rows of one day by ``change`` of them and returns how many fewer there are.

    What ``change`` leaves is written aside and noted; then it is moved in and exactly the files it was made from
    are deleted, so rows that arrive meanwhile stay, and a call that was cut short is finished by the next one.
    """
    _finish(spark, path)
    files = _files(spark, f"{path}/dt={day.isoformat()}")
    if not files:
        return 0
    rows = spark.read.option("basePath", path).parquet(*files)
    left = change(rows)
    aside = f"{path}/_aside-{uuid.uuid4().hex}"
    by = [c for c in ("dt", "batch") if c in left.columns]
    # made once; what was written says how many are left
    left.withColumn("dt", F.lit(day)).write.partitionBy(*by).parquet(aside)
    before, after = rows.count(), spark.read.schema(left.schema).parquet(aside).count()
    if before == after and not always:
        delete_path(spark, aside)
        return 0
    write_note(spark, f"{path}/{SWAP}", {"old": files, "aside": aside})
    _finish(spark, path)
    return before - after


#: Below a table: the exchange of files that is under way.
SWAP = "_swap"


def _files(spark: SparkSession, path: str) -> list[str]:
    """The data files below a folder."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found, walk = [], fs.listFiles(root, True)
    while walk.hasNext():
        p = walk.next().getPath()
        if p.getName()[0] not in "_.":
            found.append(p.toString())
    return found


def _finish(spark: SparkSession, path: str) -> None:
    """Carries out the noted exchange of files, if there is one; doing it again changes nothing.

    New files come before old ones go: who reads the table meanwhile may see rows of the day twice, never too few.
    Nothing is deleted unless every new file has been seen in its place.
    """
    note = read_note(spark, f"{path}/{SWAP}")
    if not note:
        return
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for file in _files(spark, note["aside"]):
        target = jvm_path(f"{path}/{file.rpartition(note['aside'].rpartition('/')[2] + '/')[2]}")
        fs.mkdirs(target.getParent())
        move(fs, jvm_path(file), target)
    for file in note["old"]:
        fs.delete(jvm_path(file), False)
    delete_path(spark, note["aside"])
    delete_path(spark, f"{path}/{SWAP}")
    # folders that the exchange has emptied would still count as days
    for day in {f.rpartition("/")[0] for f in note["old"]}:
        folder = jvm_path(day)
        while folder.getName().partition("=")[0] in ("dt", "batch") and not _files(spark, folder.toString()):
            fs.delete(folder, True)
            folder = folder.getParent()


def expire(spark: SparkSession, path: str, days: int, now: int, ts: str = "timestamp", index_path: str | None = None) -> int:
    """Deletes rows older than ``days`` from a table stored by ``dt`` and returns how many.

    A search index beside a log table is swept first, and at every call: it loses the same days and, on the
    boundary day, every line that does not stay. So a sweep that was cut short leaves no entry without its line.
    """
    if "dt" not in spark.read.parquet(path).columns:
        raise ValueError(f"{path} is not stored by dt")
    _finish(spark, path)
    threshold = threshold_ms(days, now)
    day = utc_date(threshold)
    stays = F.col(ts) >= threshold
    if index_path:
        _drop_days(spark, index_path, day)
        lines = spark.read.parquet(path).filter((F.col("dt") == F.lit(day)) & stays).select("id")
        replace_day(spark, index_path, day, lambda rows: rows.join(lines, "id", "left_semi"))
    gone = _drop_days(spark, path, day)
    if threshold % DAY_MS:
        gone += replace_day(spark, path, day, lambda rows: rows.filter(stays))
    return gone


def index_check(index: DataFrame, logs: DataFrame) -> DataFrame:
    """One row: lines the index knows, and how many of them are orphans."""
    found = index.select("id").distinct().join(logs.select("id", F.lit(True).alias("_line")), "id", "left")
    return found.agg(F.count("*").alias("indexed"), F.count_if(F.col("_line").isNull()).alias("orphans"))


def orphans(index: DataFrame, logs: DataFrame) -> DataFrame:
    """Index entries without their line; none in a consistent store."""
    return index.select("id").distinct().join(logs.select("id"), "id", "left_anti")
