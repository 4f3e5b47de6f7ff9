"""Reading stored tables and raw payload files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.schemas import LOGS, METRICS

def read_table(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """A stored logs or metrics table (partitioned by ``dt``), optionally as a temp view for SQL."""
    df = spark.read.parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_dated(LOGS)).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_dated(METRICS)).parquet(path)


def _dated(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("dt", T.DateType())])


def spread(df: DataFrame, each: int = 1 << 20, below: int = 1 << 30) -> DataFrame:
    """Deals the rows of a small table, which lies in few files, out over partitions of about ``each`` bytes.

    For rows that are heavy to parse. The number follows from the table's size and not from the cluster, so that ids,
    which follow partitions, are the same anywhere. A table of ``below`` bytes or more has files enough.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= below else df.repartition(max(1, -(-size // each)))


def read_payload_files(spark: SparkSession, path: str, received_at: int | None = None, column: str = "payload") -> DataFrame:
    """Payload files laid out as ``.../<service>/<host>/<file>``, one payload per file.

    Service and host come from the path; the time of receipt is the file's own unless given.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return attribute(raw.withColumnRenamed("value", column), received_at)


def stream_payload_files(spark: SparkSession, path: str, max_files: int = 1000, column: str = "payload") -> DataFrame:
    """The same layout as an unbounded stream; ``max_files`` bounds one micro-batch."""
    raw = (spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true")
           .option("wholetext", "true").text(path))
    return attribute(raw.withColumnRenamed("value", column), None)


def attribute(df: DataFrame, received_at: int | None) -> DataFrame:
    parts = F.split(F.col("_metadata.file_path"), "/")
    received = F.unix_millis("_metadata.file_modification_time") if received_at is None else F.lit(received_at)
    return (df.withColumn("service", F.url_decode(F.element_at(parts, -3)))
            .withColumn("host", F.url_decode(F.element_at(parts, -2)))
            .withColumn("received_at", received.cast("long")))
