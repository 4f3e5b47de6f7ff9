"""WARC archives: pages written as records, read back, and indexed in global order of URL key and time.

Archives are written by Spark's text writer, gzipped, so they lie wherever the shared folder is; records are cut
by their Content-Length when read, and offsets count uncompressed bytes. The index is an external merge: captures are sorted into runs, each a part of
a written table, ranges of the whole order are taken from the runs, and the runs meet in each range in a loser
tree.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote_plus, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import storage
from logloom.session import scratch_path

#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

#: Records in one archive file, which is read as a whole.
RECORDS = 1000

#: Tasks over which the copies of one payload are dealt when they learn what they revisit.
SALTS = 32

#: A captured page's time if it has none: this moment, plus its number in seconds where it has a number.
EPOCH = 1704067200


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, lower case, no default port or leading ``www``; then path and query."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        port = parts.port
    except ValueError:
        return url.strip().lower()
    host = (parts.hostname or "").removeprefix("www.")
    if not host:
        return url.strip().lower()
    key = ",".join(reversed(host.split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return key + ")" + (parts.path or "/").lower() + (f"?{'&'.join(sorted(parts.query.lower().split('&')))}" if parts.query else "")


def _http(length: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit(END))


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """One WARC record per page (id, url, payload, time): column ``value``, as the text writer takes it.

    Of records with equal payloads of ``least`` bytes or more the one with the smallest id (null last) carries the
    payload, and the others refer to it. Of rows with one id, the hash of URL and time decides; rows equal in all
    of these are the same capture and are written alike.
    """
    body = F.coalesce("payload", F.lit(""))
    rows = pages.select("id", "url", "time", body.alias("payload"), F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("size"))
    # narrow rows settle who carries a payload; ``n`` tells rows of one id apart by what else they hold
    narrow = rows.filter(F.col("size") >= least).select("id", "sha1", F.xxhash64("url", "time").alias("n"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "n")
    groups = (narrow.groupBy("sha1").agg(F.min(order).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
              .select(F.col("sha1").alias("shared"), F.col("first.id").alias("first_id"), F.col("first.n").alias("first_n"),
                      F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    rows = rows.withColumn("n", F.xxhash64("url", "time")).withColumn("own_salt", F.pmod(F.xxhash64("id", "n"), F.lit(SALTS)).cast("int"))
    rows = rows.join(groups, (F.col("sha1") == F.col("shared")) & (F.col("own_salt") == F.col("salt")) & (F.col("size") >= least), "left")
    carries = F.col("shared").isNull() | (F.col("id").eqNullSafe(F.col("first_id")) & (F.col("n") == F.col("first_n")))
    return rows.select("id", "url", "time", "payload", "sha1", "size", "first_id", carries.alias("carries"))


def _render(rows: DataFrame) -> DataFrame:
    """Records as text: header lines, an empty line, the block. The writer adds the end."""
    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    http = _http(F.col("size").cast("string"))
    block = F.when(F.col("carries"), F.concat(http, F.col("payload"))).otherwise(http)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">"))
    stamp = F.date_format(F.timestamp_seconds("time"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    # a URL cannot hold line ends; their bytes are written as escapes
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(F.col("carries"), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", F.coalesce(urn(F.col("id")), F.concat(F.lit("<urn:payload:"), F.col("sha1"), F.lit(">")))),
        line("WARC-Target-URI", url), line("WARC-Date", stamp), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(~F.col("carries"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("first_id"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    return rows.select(F.concat(head, block).alias("value"))


def base32(sha1: Column) -> Column:
    """Upper-case base32 of 20 bytes given as hex: each group of five hex digits is four base32 digits."""
    bits = F.transform(F.sequence(F.lit(1), F.lit(36), F.lit(5)), lambda i: F.lpad(F.conv(F.substr(sha1, i, F.lit(5)), 16, 32), 4, "0"))
    return F.translate(F.upper(F.array_join(bits, "")), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, least: int = 0, per_file: int = RECORDS) -> None:
    """Writes (id, url, payload, time) rows as gzipped WARC files of at most ``per_file`` records."""
    rows = records(pages, least).withColumn("sha1", base32(F.col("sha1")))
    _render(rows).write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields in lower case, block) of every record of an archive."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:head_end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v.lstrip() for k, _, v in (x.partition(":") for x in lines)}
        end = head_end + 4 + int(head["content-length"])
        if data[end:end + 4] != END.encode():
            raise ValueError(f"the record at byte {at} has no end")
        yield at, end + 4 - at, head, data[head_end + 4:end]
        at = end + 4


_CAPTURES = ("key string, time bigint, id string, type string, refers_to string, digest string, payload_bytes bigint,"
             " intact boolean, file string, offset bigint, length bigint")


def _page(urn: str | None) -> str | None:
    return unquote_plus(urn[10:-1]) if urn and urn.startswith("<urn:page:") else None


def _capture(file: str, offset: int, length: int, head: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(END.encode())
    size = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    intact = head["warc-type"] != "response" or (
        len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
    return {"key": url_key(head.get("warc-target-uri")), "time": int(np.datetime64(head["warc-date"].rstrip("Z"), "s").astype(np.int64)),
            "id": _page(head["warc-record-id"]), "type": head["warc-type"], "refers_to": _page(head.get("warc-refers-to")),
            "digest": digest, "payload_bytes": size, "intact": intact, "file": file, "offset": offset, "length": length}


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The captures in the archives below ``path``. ``payload_bytes`` is of the full payload, which a revisit only states."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [_capture(name, *record) for record in parse(gzip.decompress(data.as_py()))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(run, _CAPTURES)


_SCHEMA = pa.schema([("key", pa.string()), ("time", pa.int64()), ("id", pa.string()), ("type", pa.string()), ("refers_to", pa.string()),
                     ("digest", pa.string()), ("payload_bytes", pa.int64()), ("intact", pa.bool_()), ("file", pa.string()),
                     ("offset", pa.int64()), ("length", pa.int64())])


class LoserTree:
    """Merges sorted iterators: inner nodes hold the losers of their matches, so each step replays one path only."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key, self.k = runs, key, max(len(runs), 1)
        self.head = [next(r, None) for r in runs] + [None] * (self.k - len(runs))
        self.losers = [0] * self.k
        self.top = self._build(1)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and (self.key(x), a) < (self.key(y), b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if not self._beats(a, b):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator:
        while self.head[self.top] is not None:
            yield self.head[self.top]
            way = self.top
            self.head[way] = next(self.runs[way], None)
            node = (way + self.k) // 2
            while node:
                if self._beats(self.losers[node], way):
                    way, self.losers[node] = self.losers[node], way
                node //= 2
            self.top = way


def _sort_key(row: dict) -> tuple:
    """URL key and time, then place, which no two captures share."""
    return row["key"].encode(), row["time"], row["file"], row["offset"]


def merged_index(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """The captures in one order of URL key, time, file and offset: ``range`` and ``place`` (in the range) are added.

    Runs are sorted where they are read and written out. Spark cuts the order into ranges, by key and time, so
    that one URL with very many captures is many ranges; a task merges what the runs have in its range. Every
    capture comes out, equal keys and times included.
    """
    spark = captures.sparkSession
    order = ["key", "time", "file", "offset"]
    runs = storage.table(captures.sortWithinPartitions(*order).withColumn("run", F.spark_partition_id())
                         .withColumn("at", F.monotonically_increasing_id()), "runs")
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [*captures.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                parts.setdefault(row["run"], []).append(row)
        # rows of a run may arrive in blocks of another order; their place in the run puts them right
        lists = [iter(sorted(parts[r], key=lambda x: x["at"])) for r in sorted(parts)]
        out: list[dict] = []
        place = 0
        here = TaskContext.get().partitionId()
        schema = pa.schema([*(_SCHEMA.field(c) for c in names), ("range", pa.int32()), ("place", pa.int64())])
        for row in LoserTree(lists, _sort_key):
            out.append({c: row[c] for c in names} | {"range": here, "place": place})
            place += 1
            if len(out) == 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    ranged = runs.repartitionByRange(n, *order)
    return ranged.mapInArrow(run, _CAPTURES + ", range int, place bigint")


def archive_index(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  time_col: str | None = None) -> DataFrame:
    """Pages written as archives in the shared folder, read back, and indexed: the captures in global order.

    A null payload is empty. A null URL has the key ``-``. Without ``time_col`` a capture's time is ``EPOCH`` plus
    its numeric id in seconds. Repeated rows are captures of their own (see ``records``).
    An empty table gives an empty index. Other columns are not read.
    """
    id_ = F.col(id_col)
    time = F.col(time_col).cast("long") if time_col else F.lit(EPOCH)
    if not time_col and dict(pages.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        time = time + F.coalesce(F.pmod(id_.cast("long"), F.lit(1 << 31)), F.lit(0))
    path = scratch_path(pages.sparkSession, "warc")
    storage.keep(path)
    write_archives(pages.select(id_.alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"),
                                F.coalesce(time, F.lit(EPOCH)).cast("long").alias("time")), path, least)
    return merged_index(read_captures(pages.sparkSession, path))
