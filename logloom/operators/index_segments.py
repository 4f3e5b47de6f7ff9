"""A full-text index that follows its lines: a segment per batch, removals beside them, merged by size.

Segments are index tables that never change. Removing lines adds a table of their ids, which hides them in the
segments before it. Once ``FAN`` segments are of about one size they are written as one, without what was removed,
so there are never more than about ``FAN`` times the logarithm of the lines. A note names what counts; a folder that
no note names, as after a failure, is never read. One writer changes an index at a time, a second one gets an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import search as S
from logloom.session import delete_path, read_note, write_note

#: Segments of one size before they are merged, and entries up to which all segments count as of one size.
FAN, SMALL = 4, 1 << 16

NOTE = "_segments"


def _state(spark: SparkSession, path: str) -> dict:
    return read_note(spark, f"{path}/{NOTE}") or {"segments": [], "removed": [], "runs": {}, "next": 0, "old": []}


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    """What the change before this one replaced may still have been read; now it goes."""
    gone = [x for x in state["old"] if x["until"] < state["next"] - 1]
    state["old"] = [x for x in state["old"] if x not in gone]
    write_note(spark, f"{path}/{NOTE}", state)
    for x in gone:
        delete_path(spark, f"{path}/{x['name']}")


def _tier(rows: int) -> int:
    tier = 0
    while rows > SMALL * FAN ** tier:
        tier += 1
    return tier


def _written(spark: SparkSession, path: str, state: dict, kind: str, index: DataFrame, stored: bool = False) -> None:
    """Writes a table, and adds it to the state if it has rows."""
    name = f"{kind}-{state['next']}-{uuid.uuid4().hex}"
    if kind == "removed":
        index.write.parquet(f"{path}/{name}")
    else:
        S.write_index(index, f"{path}/{name}", stored)
    rows = spark.read.schema(index.schema).parquet(f"{path}/{name}").count()
    if rows:
        state["segments" if kind == "segment" else "removed"].append({"name": name, "at": state["next"], "rows": rows})
    else:
        delete_path(spark, f"{path}/{name}")
    state["next"] += 1


def add(lines: DataFrame, path: str, run: str | None = None, batch: int | None = None, text: str = "raw") -> None:
    """Indexes lines (``id``, ``dt`` if there is one, and the text). A batch of a run that comes again is left out."""
    spark = lines.sparkSession
    state = _state(spark, path)
    if run is not None and state["runs"].get(run, -1) >= batch:
        return
    # a batch often lies in a few files, each of which would be one task
    dealt = lines.select(*S._keys(lines), text).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    _written(spark, path, state, "segment", S.build_index(dealt, text))
    if run is not None:
        state["runs"][run] = batch
    _commit(spark, path, state)
    merge(spark, path)


def remove(ids: DataFrame, path: str) -> None:
    """Hides the lines with these ids, as a sweep of the lines does; lines indexed later are not concerned."""
    spark = ids.sparkSession
    state = _state(spark, path)
    _written(spark, path, state, "removed", ids.select("id").distinct())
    _commit(spark, path, state)


def follow(path: str, run: str) -> Callable[[DataFrame, int], None]:
    """Batch sink that keeps the index in step with a stream of stored lines."""
    return lambda df, batch_id: add(df, path, run, batch_id)


def _read(spark: SparkSession, path: str, segments: list[dict], removed: list[dict]) -> DataFrame | None:
    """The entries of some segments, without those that were removed since."""
    if not segments:
        return None
    rows = reduce(DataFrame.unionByName, [
        spark.read.parquet(f"{path}/{s['name']}").withColumn("_at", F.lit(s["at"])) for s in segments])
    later = [r for r in removed if r["at"] > min(s["at"] for s in segments)]
    if later:
        hidden = reduce(DataFrame.unionByName, [
            spark.read.parquet(f"{path}/{r['name']}").select(F.col("id").alias("_id"), F.lit(r["at"]).alias("_since")) for r in later])
        # the last removal of an id is the one that counts
        hidden = hidden.groupBy("_id").agg(F.max("_since").alias("_since"))
        rows = rows.join(hidden, (F.col("id") == F.col("_id")) & (F.col("_since") > F.col("_at")), "left_anti")
    return rows.drop("_at")


def merge(spark: SparkSession, path: str) -> None:
    """Writes segments of one size as one, while there are ``FAN`` of them."""
    while True:
        state = _state(spark, path)
        tiers: dict[int, list[dict]] = {}
        for s in state["segments"]:
            tiers.setdefault(_tier(s["rows"]), []).append(s)
        full = next((t for _, t in sorted(tiers.items()) if len(t) >= FAN), None)
        if full is None:
            return
        state["segments"] = [s for s in state["segments"] if s not in full]
        kept = _read(spark, path, full, state["removed"])
        _written(spark, path, state, "segment", kept, stored=True)
        # removals that no segment is older than have done their work
        oldest = min((s["at"] for s in state["segments"]), default=state["next"])
        done = [r for r in state["removed"] if r["at"] < oldest]
        state["removed"] = [r for r in state["removed"] if r not in done]
        state["old"] += [{"name": x["name"], "until": state["next"]} for x in full + done]
        _commit(spark, path, state)


def segments(spark: SparkSession, path: str) -> int:
    """How many segments a search reads."""
    return len(_state(spark, path)["segments"])


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The index as it is now, for every function of ``search``; its filters reach the segments' files."""
    state = _state(spark, path)
    rows = _read(spark, path, state["segments"], state["removed"])
    return S.build_index(spark.createDataFrame([], "id long, raw string")) if rows is None else rows
