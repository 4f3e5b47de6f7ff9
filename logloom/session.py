"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import datetime as dt
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Fixed value: the name of the folder in which Spark keeps the rows without a partition value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def build_session(app: str = "logloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs rely on; cluster sizing stays with the submitter."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # generated methods beyond this size are not compiled by the JVM; smaller stages run faster
         .config("spark.sql.codegen.hugeMethodLimit", "8000")
         # checkpoint files go when nothing refers to them any more
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.ui.enabled", "false"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it in ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may fall back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="logloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/logloom/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a folder this library wrote, on whatever file system it is."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def _folder(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str, column: str) -> dict[str, str]:
    """Partition values below a folder and their paths; no data is read."""
    root, fs = _folder(spark, path)
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()] if fs.exists(root) else []
    return {p.getName()[len(column) + 1:]: p.toString() for p in found if p.getName().startswith(f"{column}=")}


def stored_days(spark: SparkSession, path: str) -> list[dt.date]:
    """The days of a table stored by ``dt``, newest first; rows without a date belong to none."""
    return sorted((dt.date.fromisoformat(d) for d in folders(spark, path, "dt") if d != NO_VALUE), reverse=True)


def read_note(spark: SparkSession, path: str) -> dict | None:
    """The last complete note kept in a folder, a small JSON object."""
    root, fs = _folder(spark, path)
    kept = sorted(int(s.getPath().getName()[5:]) for s in fs.listStatus(root)
                  if s.getPath().getName().startswith("note-")) if fs.exists(root) else []
    if not kept:
        return None
    stream = fs.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"note-{kept[-1]}"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode()) | {"_at": kept[-1]}
    finally:
        stream.close()


def move(fs, source, target) -> None:
    """Renames a file to a name that is free. Some file systems say no by their answer only, so that is checked."""
    if fs.exists(target):
        raise FileExistsError(f"{target.toString()} is there already")
    if not fs.rename(source, target) or not fs.exists(target) or fs.exists(source):
        raise OSError(f"{source.toString()} was not renamed to {target.toString()}")


def write_note(spark: SparkSession, path: str, note: dict) -> None:
    """Replaces the note of a folder: written aside, renamed, and only then is the old one deleted.

    A note that was read names its number; if another writer has added one since, this raises and changes nothing.
    """
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root, fs = _folder(spark, path)
    before = read_note(spark, path)
    if "_at" in note and note["_at"] != (before["_at"] if before else None):
        raise FileExistsError(f"another writer has changed the note in {path}")
    number = before["_at"] + 1 if before else 0
    aside = jvm_path(root, f".{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    stream.write(bytearray(json.dumps({k: v for k, v in note.items() if k != "_at"}).encode()))
    stream.close()
    try:
        move(fs, aside, jvm_path(root, f"note-{number}"))
    except OSError:
        fs.delete(aside, False)
        raise
    if before:
        fs.delete(jvm_path(root, f"note-{number - 1}"), False)


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` as a written table for the length of the block.

    For results that are costly to make and read more than once, such as rows about to be
    range-partitioned, which Spark first samples. A lost executor costs a read, not the work.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        delete_path(df.sparkSession, path)
