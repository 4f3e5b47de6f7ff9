"""Stored tables: appends, exports, retention, and live sinks."""

import csv
import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from logloom import session
from logloom.functions.timeexpr import event_date
from logloom.operators import retention, search as S, sinks
from logloom.operators.filters import LogFilter
from logloom.sources.files import read_logs, read_metrics, read_payload_files, stream_payload_files
from logloom.sources.lines import parse_payloads
from logloom.streaming import live

DAY = 86_400_000
NOW = 1_755_000_000_000


def lines(spark, stamps):
    return spark.createDataFrame(
        [(t, t, 2, "svc", "h", f"m{i}", None, f"line {i}") for i, t in enumerate(stamps)],
        "timestamp long, ingested_at long, level int, service string, host string, message string, parsed string, raw string")


def test_append_and_read(spark, tmp_path):
    path = str(tmp_path / "logs")
    sinks.append_logs(lines(spark, [NOW, NOW + DAY]), path)
    first = {r.id: str(r.dt) for r in read_logs(spark, path).collect()}
    sinks.append_logs(lines(spark, [NOW] * 5), path)
    df = read_logs(spark, path)
    assert df.count() == 7 and df.select("id").distinct().count() == 7
    assert sorted(first.values()) == ["2025-08-12", "2025-08-13"]
    assert min(r.id for r in df.collect() if r.id not in first) > max(first)


def test_ids_never_repeat(spark, tmp_path):
    path = str(tmp_path / "t")
    assert [sinks.allocate(spark, path, n) for n in (10, 0, 1 << 40, 3)] == [0, 10, 10, 10 + (1 << 40)]
    again = [sinks.allocate(spark, path, 5, "run", b) for b in (7, 7, 1 << 40, 7)]
    assert again[0] == again[1] < again[2] < again[3]
    with pytest.raises(OverflowError):
        sinks.allocate(spark, path, 1 << 63)
    rows = spark.range(0, 40, 1, 40).select(F.lit(NOW).alias("timestamp"))
    with sinks.with_ids(rows, path) as out:
        ids = [r.id for r in out.collect()]
    assert len(set(ids)) == 40 and min(ids) >= again[3] + 5


def test_empty_labels_are_null(spark, tmp_path):
    rows = spark.createDataFrame([(NOW, "g", 1, 1.0, "s", "h", ""), (NOW, "g", 1, 1.0, "s", "h", '{"a":"b"}')],
                                 "timestamp long, name string, type int, value double, service string, host string, labels string")
    sinks.append_metrics(rows, str(tmp_path / "m"))
    assert read_metrics(spark, str(tmp_path / "m")).filter("labels is null").count() == 1


def test_date_pruning(spark, tmp_path):
    path = str(tmp_path / "logs")
    sinks.append_logs(lines(spark, [NOW - i * DAY for i in range(10)]), path)
    df = LogFilter().within(NOW - DAY, NOW).apply(read_logs(spark, path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters: [IsNotNull(timestamp)" in plan
    assert df.count() == 2


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, None), (2, 1234567.5, ' a"b,\n ')], "id long, v double, s string").coalesce(1)
    sinks.export_csv(df, str(tmp_path / "csv"))
    files = [f for f in os.listdir(tmp_path / "csv") if f.endswith(".csv")]
    with open(tmp_path / "csv" / files[0], newline="") as f:
        assert list(csv.reader(f)) == [["id", "v", "s"], ["1", "2", ""], ["2", "1.2345675e+06", ' a"b,\n ']]
    sinks.export_json(df, str(tmp_path / "json"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()][0] == {"id": 1, "v": 2.0, "s": None}


@pytest.mark.parametrize("setting,days", [("1", 1), ("3650", 3650), ("0", 30), ("3651", 30), ("x", 30), ("", 30), (None, 30), ("-5", 30)])
def test_retention_setting(setting, days):
    assert retention.retention_days(setting, 30) == days


def stored(spark, path, ages, ids=True):
    rows = lines(spark, [NOW - int(a * DAY) for a in ages]).withColumn("id", F.monotonically_increasing_id())
    df = rows.withColumn("dt", event_date("timestamp"))
    df.write.partitionBy("dt").parquet(path)
    return df


def test_expire_with_index(spark, tmp_path):
    path, index = str(tmp_path / "logs"), str(tmp_path / "index")
    df = stored(spark, path, [40] * 5 + [30.0001, 29.9999, 29.99] + [1, 0, 0])
    S.write_index(S.build_index(df), index)
    assert retention.expire(spark, path, 30, NOW, index_path=index) == 6
    left, idx = spark.read.parquet(path), spark.read.parquet(index)
    assert left.count() == 5
    assert idx.select("id").distinct().count() == 5 and retention.orphans(idx, left).count() == 0
    assert retention.expire(spark, path, 30, NOW, index_path=index) == 0
    assert retention.expire(spark, path, 1, NOW, index_path=index) == 2


def test_expire_firings(spark, tmp_path):
    path = str(tmp_path / "firings")
    rows = spark.createDataFrame([(1, NOW - 100 * DAY, "[]", True), (1, NOW - 91 * DAY, "[]", True), (2, NOW, "[]", False)],
                                 "alert_id long, fired_at long, matched_rows string, notification_sent boolean")
    sinks.append_firings(rows, path)
    assert retention.expire(spark, path, retention.DEFAULT_DAYS["firings"], NOW, ts="fired_at") == 2
    assert [r.alert_id for r in spark.read.parquet(path).collect()] == [2]


def test_expire_whole_boundary_day(spark, tmp_path):
    path = str(tmp_path / "logs")
    stored(spark, path, [30.01, 30.02, 2])
    assert retention.expire(spark, path, 30, NOW) == 2
    assert spark.read.parquet(path).count() == 1


def test_expire_in_a_streamed_table(spark, tmp_path):
    """Streamed tables are split by date and batch; a batch left empty goes."""
    path = str(tmp_path / "logs")
    for batch, ages in enumerate([[30.3, 30.2], [30.1, 29.99], [40], [1]]):
        live.store_logs(path)(lines(spark, [NOW - int(a * DAY) for a in ages]), batch)
    assert retention.expire(spark, path, 30, NOW) == 4
    left = spark.read.parquet(path)
    assert sorted(r.batch for r in left.collect()) == ["direct-1", "direct-3"]
    assert left.filter("timestamp < " + str(NOW - 30 * DAY)).count() == 0


def test_expire_finishes_what_was_cut_short(spark, tmp_path, monkeypatch):
    path, index = str(tmp_path / "logs"), str(tmp_path / "index")
    df = stored(spark, path, [30.1, 30.05, 29.9, 1])
    S.write_index(S.build_index(df), index)
    moved = retention.write_note

    def noted_only(spark, at, note):
        moved(spark, at, note)
        raise RuntimeError("lost")

    for _ in range(2):  # once when the index has been written aside, once when the lines have
        monkeypatch.setattr(retention, "write_note", noted_only)
        with pytest.raises(RuntimeError):
            retention.expire(spark, path, 30, NOW, index_path=index)
        monkeypatch.undo()
        retention._finish(spark, index)
    retention.expire(spark, path, 30, NOW, index_path=index)
    logs, entries = spark.read.parquet(path), spark.read.parquet(index)
    assert logs.count() == 2 and entries.select("id").distinct().count() == 2 and retention.orphans(entries, logs).count() == 0
    assert not [f for f in os.listdir(path) + os.listdir(index) if f.startswith(("_aside", "_swap"))]


def test_expire_leaves_what_arrives_meanwhile(spark, tmp_path):
    path = str(tmp_path / "logs")
    stored(spark, path, [30.01, 29.99])
    day = (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=NOW - 30 * DAY)).date()

    def change(rows):
        lines(spark, [NOW - 30 * DAY + 5]).withColumn("id", F.lit(99).cast("long")).withColumn("dt", event_date("timestamp")).write.mode(
            "append").partitionBy("dt").parquet(path)
        return rows.filter(F.col("timestamp") >= NOW - 30 * DAY)

    assert retention.replace_day(spark, path, day, change) == 1
    assert spark.read.parquet(path).filter("id = 99").count() == 1 and spark.read.parquet(path).count() == 2


def test_expire_needs_dates(spark, tmp_path):
    path = str(tmp_path / "t")
    lines(spark, [NOW]).write.parquet(path)
    with pytest.raises(ValueError):
        retention.expire(spark, path, 30, NOW)


def test_compact(spark, tmp_path):
    path = str(tmp_path / "logs")
    for batch in range(4):
        live.store_logs(path)(lines(spark, [NOW, NOW + DAY]), batch)
    day = (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=NOW)).date()
    before = sorted(spark.read.parquet(path).drop("batch").collect())
    live.compact(spark, path, day)
    assert sorted(spark.read.parquet(path).drop("batch").collect()) == before
    assert os.listdir(f"{path}/dt={day.isoformat()}") == ["batch=compacted"]


def test_versions_stay_few(spark, tmp_path):
    path = str(tmp_path / "agg")
    for batch in range(12):
        live.refresh(path)(spark.range(batch + 1), batch)
        live.refresh(path)(spark.range(batch + 1), batch)  # the batch again
    assert live.latest(spark, path).count() == 12 and live.latest(spark, path, "direct-11").count() == 11
    assert sorted(f for f in os.listdir(path) if f.startswith("v=")) == ["v=direct-10", "v=direct-11"]
    assert len([f for f in os.listdir(f"{path}/_versions") if f.startswith("note")]) == 1


def test_new_checkpoint_does_not_replace(spark, tmp_path):
    path = str(tmp_path / "logs")
    live.store_logs(path, "one")(lines(spark, [NOW] * 2), 0)
    live.store_logs(path, "two")(lines(spark, [NOW] * 3), 0)
    live.store_logs(path, "two")(lines(spark, [NOW] * 3), 0)
    got = spark.read.parquet(path)
    assert got.count() == 5 and got.select("id").distinct().count() == 5


def payload_tree(root, name, text):
    d = root / "in" / "pay svc" / "h1"
    d.mkdir(parents=True, exist_ok=True)
    tmp = root / f"{name}.tmp"
    tmp.write_text(text)
    os.rename(tmp, d / name)


def test_payload_files(spark, tmp_path):
    payload_tree(tmp_path, "a.log", '{"level":"error","msg":"x"}\nplain\n')
    got = parse_payloads(read_payload_files(spark, str(tmp_path / "in"), NOW)).collect()
    assert [(r.service, r.host, r.level, r.timestamp) for r in got] == [("pay svc", "h1", 4, NOW), ("pay svc", "h1", 2, NOW)]


def test_stream_store_and_tail(spark, tmp_path):
    """Payload files to live views and storage, batch by batch, and again after a lost batch."""
    inp, out = str(tmp_path / "in"), {k: str(tmp_path / k) for k in ("tail", "store", "ring", "cp", "agg", "cp2")}
    payload_tree(tmp_path, "a.log", "ERROR one\nINFO two\n")

    def go():
        parsed = parse_payloads(stream_payload_files(spark, inp))
        hits = live.tail(parsed, LogFilter().with_(level=4), S.match_spec("o"))
        sink = live.fan_out(lambda df, b: live.append_batches(out["tail"])(live.tail(df, LogFilter().with_(level=4)), b),
                            live.store_logs(out["store"]), live.ring(out["ring"], 3, by="raw"))
        live.run(parsed, out["cp"], sink).awaitTermination()
        agg = parsed.groupBy("level").agg(F.count("*").alias("n"))
        live.run(agg, out["cp2"], live.refresh(out["agg"]), "complete").awaitTermination()
        return hits

    go()
    payload_tree(tmp_path, "b.log", "ERROR three\nplain four\n")
    assert go().isStreaming
    assert sorted(r.raw for r in spark.read.parquet(out["tail"]).collect()) == ["ERROR one", "ERROR three"]
    store = spark.read.parquet(out["store"])
    assert store.count() == 4 and store.select("id").distinct().count() == 4
    assert sorted(r.raw for r in live.latest(spark, out["ring"]).collect()) == ["ERROR three", "INFO two", "plain four"]
    assert {r.level: r.n for r in live.latest(spark, out["agg"]).collect()} == {4: 2, 2: 2}
    # the same batch again replaces itself
    run = store.first().batch.rpartition("-")[0]
    assert run != "direct"
    again = store.filter(F.col("batch") == f"{run}-1").drop("dt", "batch", "id")
    ids = {r.id for r in store.collect()}
    live.store_logs(out["store"], run)(again, 1)
    assert {r.id for r in spark.read.parquet(out["store"]).collect()} == ids


def test_strategy():
    assert live.strategy(None) == "all" and live.strategy(LogFilter()) == "all"
    assert live.strategy(LogFilter().with_(level=4)) == "filtered" and live.strategy(None, S.phrase("x")) == "filtered"
    assert live.strategy(None, aggregated=True) == "refresh"
    with pytest.raises(ValueError):
        live.strategy(None, set_operation=True)
    with pytest.raises(ValueError):
        live.strategy(None, S.phrase("x"), aggregated=True)


def test_event_date(spark):
    df = spark.createDataFrame([(0,), (-1,), (DAY - 1,), (DAY,)], "t long")
    assert [r[0] for r in df.coalesce(1).select(event_date("t")).collect()] == [
        dt.date(1970, 1, 1), dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(1970, 1, 2)]


def test_a_refused_rename_deletes_nothing(spark, tmp_path, monkeypatch):
    """A file system that says no, or a name that is taken: the day's old rows stay, and the next call ends the exchange."""
    path = str(tmp_path / "t")
    rows = spark.range(20).select("id", F.lit("2025-08-01").cast("date").alias("dt"))
    rows.write.partitionBy("dt").parquet(path)
    day = dt.date(2025, 8, 1)

    def half(df):
        return df.filter("id >= 10")

    def refuse(fs, source, target):
        raise OSError("no")

    with monkeypatch.context() as m:
        m.setattr(retention, "move", refuse)
        with pytest.raises(OSError):
            retention.replace_day(spark, path, day, half)
    assert spark.read.parquet(path).count() == 20
    retention._finish(spark, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(10, 20))
    # a name that is taken is not overwritten
    source, target = tmp_path / "a", tmp_path / "b"
    source.write_text("new")
    target.write_text("old")
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(str(source)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with pytest.raises(FileExistsError):
        session.move(fs, jvm_path(str(source)), jvm_path(str(target)))
    assert source.read_text() == "new" and target.read_text() == "old"

    class SaysNo:
        """As object stores do: the answer is all that tells."""
        exists = staticmethod(lambda path: path is source)
        rename = staticmethod(lambda a, b: False)

    class Name:
        toString = staticmethod(str)

    source, target = Name(), Name()
    with pytest.raises(OSError, match="was not renamed"):
        session.move(SaysNo, source, target)


def test_two_writers_of_a_note(spark, tmp_path):
    """Who read the note before another wrote it gets an error, so no two get the same ids."""
    path = str(tmp_path / "table")
    assert sinks.allocate(spark, path, 10) == 0
    seen = session.read_note(spark, f"{path}/{sinks.LEDGER}")
    assert sinks.allocate(spark, path, 5) == 10
    with pytest.raises(FileExistsError):
        session.write_note(spark, f"{path}/{sinks.LEDGER}", seen | {"next": 99})
    assert sinks.allocate(spark, path, 1) == 15


def test_ids_are_counted_in_parts(spark, tmp_path, monkeypatch):
    """Parts follow the table's size, equal ids of a key meet in one, and every row is there."""
    from logloom.plans.registered import ingest
    rows = spark.range(5000).selectExpr("id div 2 as id", "concat('m', id % 3) as name", "1 as type").coalesce(1)
    rows.write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(ingest, "EACH", 2000)
    dealt = ingest._by_id(spark.read.parquet(str(tmp_path / "t")), "name", "type")
    assert dealt.rdd.getNumPartitions() > 4
    parts = dealt.withColumn("part", F.spark_partition_id()).groupBy("name", "type", "id").agg(F.count_distinct("part").alias("p"), F.count("*").alias("n"))
    assert parts.filter("p > 1").count() == 0 and parts.agg(F.sum("n")).first()[0] == 5000
