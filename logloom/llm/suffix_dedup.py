"""Removal of passages that occur elsewhere, by suffix arrays over shards that keep equal passages together.

Every window of ``LENGTH`` bytes has a least gram hash. Neighbouring windows with one least gram are a segment,
and equal windows of any two documents lie in segments of equal gram hash. So:

1. Segments are listed with gram hash and a digest of their bytes. Segments of equal bytes are counted before
   they are shuffled; where there are two or more, every window in them is repeated.
2. Where one gram hash has segments of different bytes, one of each goes to a shard, chosen by the gram hash.
   The shard's suffix array is made by induced sorting, and permuted common prefixes tell which windows share
   ``LENGTH`` bytes with a neighbour.
3. A gram hash with very many different segments is cut again by longer grams, up to grams of the whole window,
   where equal hash means equal bytes and counting decides.
4. Windows found are laid over their documents and the bytes they cover removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import storage
from logloom.llm import text as X
from logloom.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 400

#: Gram sizes as shares of the window: the first cut, that of hot grams, and whole windows.
GRAMS = (0.25, 0.96, 1.0)

#: Different segments from which a gram hash is cut again.
MANY = 2000

#: Bytes of segments in one shard.
SHARD_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = X.seeds(256, 31)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    back = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, back):
        factors = np.full(n + 1, base, np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors))
    return out[0], out[1]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` bytes from each place on; it depends on these bytes alone."""
    n = len(data)
    up, down = _powers(1 << max(n, 1).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=sums[1:])
    return X.mix((sums[size:] - sums[:n + 1 - size]) * down[:n + 1 - size])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive entries."""
    out, done = x, 1
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def segments(block: X.Block, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, gram hash) of each segment of a block's documents.

    A new segment also begins where the least gram leaves at the left, so that no segment holds a window twice.
    """
    n = len(block.data)
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    grams = gram_hashes(block.data, gram)
    least = _least(grams, length - gram + 1)
    doc = np.repeat(np.arange(len(block.offsets) - 1), np.diff(block.offsets))[:len(least)]
    inside = np.arange(len(least)) + length <= block.offsets[doc + 1]
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | (grams[:len(least) - 1] == least[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    ends = np.flatnonzero(inside & ~np.append(inside[1:] & ~new[1:], False)) + 1
    return start, ends - start, least[start]


#: Windows of a document worked on at a time.
_PIECE = 1 << 18


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[X.Block, int]]:
    """Blocks of a column; a document larger than a block comes as overlapping pieces, each with its first byte."""
    for block in X.blocks(column, _PIECE):
        if block.hi - block.lo > 1 or len(block.data) <= 2 * _PIECE:
            yield block, 0
            continue
        for a in range(0, len(block.data), _PIECE):
            data = block.data[a:a + _PIECE + length - 1]
            yield X.Block(block.lo, block.hi, data, np.array([0, len(data)])), a


def _listed(source: DataFrame, length: int, gram: int) -> DataFrame:
    """The segments of a source (own, copies, body): own, copies, start, n, value, digest."""
    own = source.schema["own"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, shift in _pieces(batch.column(2), length):
                start, n, value = segments(block, length, gram)
                if not len(start):
                    continue
                row = np.searchsorted(block.offsets, start, "right") - 1
                raw = block.data.tobytes()
                digest = [hashlib.blake2b(raw[a:a + k + length - 1], digest_size=16).digest() for a, k in zip(start.tolist(), n.tolist())]
                row_at = pa.array(row + block.lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row_at), batch.column(1).take(row_at), pa.array(start - block.offsets[row] + shift, pa.int64()), pa.array(n, pa.int32()),
                     pa.array(value.view(np.int64)), pa.array(digest, pa.binary())], ["own", "copies", "start", "n", "value", "digest"])

    return source.select("own", "copies", "body").mapInArrow(
        run, f"own {own}, copies bigint, start bigint, n int, value bigint, digest binary")


def _cut(source: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted segments (own, start, n, value, digest, ...): value, digest, copies, kinds, body."""
    lists = wanted.groupBy("own").agg(F.collect_list(F.struct("value", "digest", "copies", "kinds", "start", "n")).alias("wanted"))
    joined = source.select(F.col("own").alias("at"), "body").join(lists, F.col("at") == F.col("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, want in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = body.as_py()
                raw = raw.encode() if isinstance(raw, str) else raw
                for w in want:
                    w["body"] = raw[w["start"]:w["start"] + w["n"] + length - 1]
                    del w["start"], w["n"]
                yield pa.RecordBatch.from_pylist(want, schema)

    schema = pa.schema([("value", pa.int64()), ("digest", pa.binary()), ("copies", pa.int64()), ("kinds", pa.int64()), ("body", pa.binary())])
    return joined.select("body", "wanted").mapInArrow(run, "value bigint, digest binary, copies bigint, kinds bigint, body binary")


def repeated_windows(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each text of a shard which of its windows occur elsewhere in the shard: induced sorting, then common prefixes."""
    data = np.frombuffer(b"\xff".join(bodies), np.uint8)  # a byte that UTF-8 never has
    array = suffix_array(np.append(data.astype(np.int64) + 1, 0), 257)
    shared = common_prefixes(data, array)
    size = np.array([len(b) for b in bodies])
    first = np.concatenate([[0], np.cumsum(size + 1)])
    left = np.repeat(first[:-1] + size, size + 1)[:len(data)] - np.arange(len(data))  # bytes up to the end of its own text
    shared = np.minimum(shared, left)
    own = array[1:]
    pair = shared[own] >= length
    pair[1:] &= left[own[:-1]] >= length
    found = np.zeros(len(data) + 1, bool)
    found[own[pair]] = True
    found[array[:-1][pair]] = True
    return [np.flatnonzero(found[a:a + max(k - length + 1, 0)]) for a, k in zip(first.tolist(), size.tolist())]


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of each run of consecutive places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    first = np.concatenate([[0], cut])
    return list(zip(places[first].tolist(), np.diff(np.append(first, len(places))).tolist()))


def _sharded(cut: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(value, digest, start, n) of the repeated windows of cut segments."""
    total = cut.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))

    def run(rows: pa.Table) -> pa.Table:
        value, digest = rows.column("value").to_pylist(), rows.column("digest").to_pylist()
        out = [(v, d, a, n) for v, d, places in zip(value, digest, repeated_windows(rows.column("body").to_pylist(), length))
               for a, n in _runs(places)]
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int32()))],
                        ["value", "digest", "start", "n"])

    return (cut.select("value", "digest", "body").groupBy(F.pmod(F.xxhash64("value"), F.lit(shards)).alias("shard"))
            .applyInArrow(run, "value bigint, digest binary, start bigint, n int"))


def repeats(source: DataFrame, length: int = LENGTH, many: int = MANY, shard_bytes: int = SHARD_BYTES, level: int = 0) -> DataFrame:
    """(own, start, n): runs of windows that occur more than once in ``source`` (own, copies, body), each body ``copies`` times."""
    gram = max(1, int(GRAMS[level] * length))
    last = gram >= length
    listed = storage.table(_listed(source, length, gram), "segments")
    kinds = listed.groupBy("value", "digest").agg(F.sum("copies").alias("copies"), F.min(F.struct("own", "start", "n")).alias("first"))
    kinds = storage.table(kinds, "kinds")
    values = kinds.groupBy("value").agg(F.count("*").alias("kinds"), F.sum("copies").alias("total")).filter("total > 1")
    known = storage.table(kinds.join(values.drop("total"), "value").select("value", "digest", "copies", "kinds", "first.*"), "known")
    found = known.filter("copies > 1").select("value", "digest", F.lit(0).cast("long").alias("at"), F.col("n").alias("windows"))
    if not last:
        cut = storage.table(_cut(source, known.filter("kinds > 1"), length), "cut")
        shards = [_sharded(cut.filter(F.col("kinds") <= many), length, shard_bytes)]
        hot = cut.filter(F.col("kinds") > many)
        if not hot.isEmpty():
            again = hot.select(F.struct("value", "digest").alias("own"), "copies", "body")
            shards.append(repeats(again, length, many, shard_bytes, level + 1).select("own.value", "own.digest", "start", "n"))
        for s in shards:
            found = found.union(s.select("value", "digest", F.col("start").alias("at"), F.col("n").alias("windows")))
    found = storage.table(found, "found")
    return listed.select("own", "start", "value", "digest").join(found, ["value", "digest"]).select(
        "own", (F.col("start") + F.col("at")).alias("start"), F.col("windows").alias("n"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   many: int = MANY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``spans`` (start and end of removed runs, in bytes), ``kept`` (the rest).

    Removed is every byte covered by ``length`` bytes of the input that also start anywhere else, the same text
    included; matches never cross texts, and are judged on the input. A null text counts as empty, a text
    shorter than ``length`` is kept whole, repeated rows count as occurrences of each other. An empty table gives
    no rows. Other columns are not read. ``kept`` is binary, as a removed run may end inside a character.
    """
    # the key of a text; it is never null, though an id may be
    key = F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(id_col).isNull().alias("none"),
                   F.xxhash64(text_col).alias("hash"))
    named = docs.select(key.alias("own"), F.lit(1).cast("long").alias("copies"), F.col(text_col).alias("body"))
    found = repeats(named, length, many, shard_bytes)
    lists = found.groupBy("own").agg(F.collect_set(F.struct("start", "n")).alias("windows"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, windows in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = (text.as_py() or "").encode()
                runs = []
                for a, b in sorted((w["start"], w["start"] + w["n"] + length - 1) for w in windows or []):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                sizes.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(raw)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "spans", "kept"])

    whole = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("at"))
    return (whole.join(lists, F.col("at") == F.col("own"), "left").select("id", "text", "windows")
            .mapInArrow(run, f"id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
            .withColumnRenamed("id", id_col))
