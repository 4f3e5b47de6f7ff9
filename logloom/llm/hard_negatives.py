"""Hard negatives of anchors, found through an inverted multi-index.

Vectors are cut in halves, and each half has a small codebook; the two codes of a row name its cell. What an anchor
can score in a cell is at most the sum, over the halves, of its product with the centre and its length times the
radius of the code. A heap visits the cells by falling sums of these bounds, until no cell left can change the
answer: the answers are exact, whatever the codebooks are.

Cells are stored as blocks of some thousand rows. Anchors ask for cells in waves, each reading more rows than the
one before; requests meet blocks in a join on (cell, part), where a cell with many rows has many parts, and a
matrix product scores them. Only the best few of each anchor leave a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm import storage

#: Rows that the codebooks are learned from, at most. Any codebook gives the same results.
SAMPLE = 8192

#: Rows of a block, anchors scored together, and codes a half at most (which bounds the cells by their square).
BLOCK, CHUNK, CODES = 2048, 256, 64

#: Rows that an anchor's first wave reads, and how much more each further wave does.
FIRST, MORE = 8192, 8

#: Components are held to this size, so that scores fit a long and most products are exact as doubles.
LIMIT = 1 << 24


# --- rows --------------------------------------------------------------------------------

def quantized(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(id, label, v): rows that take part, with whole-number components."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & ~bad)
            .select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(size) and (size == dim).all():
        return flat.reshape(len(size), dim).astype(np.int64)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = flat
    return out


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, :x.shape[1] // 2], x[:, x.shape[1] // 2:]


# --- codebooks and cells -------------------------------------------------------------------

@dataclass(frozen=True)
class Index:
    """Two codebooks with the radius of every code, and the rows of every cell that has any."""

    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    rows: dict[tuple[int, int], int]
    dim: int
    block: int = BLOCK
    first: int = FIRST

    def parts(self, cell: tuple[int, int]) -> int:
        return -(-self.rows[cell] // self.block)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(1) - 2 * x @ centres.T).argmin(1)


def codebook(x: np.ndarray, codes: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Plain k-means."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centres = x[np.random.default_rng(seed).choice(len(x), min(codes, len(x)), replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        size = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def _with_cells(rows: DataFrame, centres, dim: int) -> DataFrame:
    """Rows with their codes, the distance to both centres, and a running number within the task."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # twice ``CODES`` centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            x = matrix(batch.column(2), dim).astype(float)
            codes, far = [], []
            for half, c in zip(_halves(x), shared.value):
                codes.append(_nearest(half, c))
                far.append(np.sqrt(((half - c[codes[-1]]) ** 2).sum(1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c.astype(np.int32)) for c in codes], *[pa.array(d) for d in far],
                 pa.array(np.arange(number, number + len(x)))], ["id", "label", "v", "c0", "c1", "r0", "r1", "number"])
            number += len(x)

    return rows.mapInArrow(run, "id long, label long, v array<int>, c0 int, c1 int, r0 double, r1 double, number long")


def build(rows: DataFrame, block: int = BLOCK, first: int = FIRST) -> tuple[Index, DataFrame, DataFrame]:
    """The index, the rows of ``quantized`` as a table, and their blocks (c0, c1, part, ids, labels, vectors).

    The driver gets the sample, and one row a code and a cell.
    """
    rows = storage.table(rows, "vectors")
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = max(dim or 0, 2)
    few = rows if n <= SAMPLE else rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < (SAMPLE << 20) // n)
    sample = matrix(few.select("v").limit(2 * SAMPLE).toArrow().column("v").combine_chunks(), dim).astype(float)
    codes = int(min(CODES, max(2, (n / 200) ** 0.5)))
    centres = tuple(codebook(half, codes) for half in _halves(sample))
    placed = storage.table(_with_cells(rows, centres, dim), "cells")
    cells = placed.groupBy("c0", "c1").agg(F.count("*").alias("n"), F.max("r0").alias("r0"), F.max("r1").alias("r1")).collect()
    radii = tuple(np.zeros(len(c)) for c in centres)
    for c in cells:
        for k in (0, 1):
            radii[k][c[k]] = max(radii[k][c[k]], c[3 + k])
    index = Index(centres, radii, {(c.c0, c.c1): c.n for c in cells}, dim, block, first)
    return index, rows, storage.table(_blocks(placed, index), "blocks")


def _blocks(placed: DataFrame, index: Index) -> DataFrame:
    spark = placed.sparkSession
    parts = F.broadcast(spark.createDataFrame([(*c, index.parts(c)) for c in index.rows] or [(0, 0, 1)], "c0 int, c1 int, parts long"))
    dealt = (placed.join(parts, ["c0", "c1"]).withColumn("part", (F.col("number") % F.col("parts")).cast("int"))
             .select("c0", "c1", "part", "id", "label", "v").repartition("c0", "c1", "part").sortWithinPartitions("c0", "c1", "part"))
    dim, most = index.dim, index.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            vectors = matrix(t.column("v").chunk(0), dim).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [*[t.column(k).chunk(0).slice(0, 1) for k in range(3)],
                 *[pa.array([x.tobytes()], pa.binary()) for x in (t.column("id").to_numpy(), t.column("label").to_numpy(), vectors)]],
                ["c0", "c1", "part", "ids", "labels", "vectors"])

        # rows come by (cell, part); a block ends with its part, or when it is full
        at, size = None, 0
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                while lo < hi:
                    if held and (tuple(key[lo]) != at or size >= most):
                        yield out()
                        held, size = [], 0
                    at, take = tuple(key[lo]), min(hi - lo, most - size)
                    held.append(batch.slice(lo, take))
                    lo, size = lo + take, size + take
        if held:
            yield out()

    return dealt.mapInArrow(run, "c0 int, c1 int, part int, ids binary, labels binary, vectors binary")


# --- visiting cells ------------------------------------------------------------------------

def visit(q: np.ndarray, index: Index) -> Iterator[tuple[float, float, tuple[int, int]]]:
    """Cells with rows by falling bound: (most, least that a row there can score, cell); the multi-sequence walk."""
    both = []
    for half, c, r in zip(_halves(q[None].astype(float)), index.centres, index.radii):
        middle, reach = (half @ c.T)[0], np.linalg.norm(half) * r
        slack = 1e-9 * (np.linalg.norm(half) * (np.linalg.norm(c, axis=1) + r)) + 1e-6  # what rounding may take away
        order = np.argsort(-(middle + reach), kind="stable")
        both.append((order, (middle + reach + slack)[order], (middle - reach - slack)[order]))
    (o0, u0, l0), (o1, u1, l1) = both
    heap, seen = [(-(u0[0] + u1[0]), 0, 0)], {(0, 0)}
    while heap:
        most, i, j = heapq.heappop(heap)
        cell = (int(o0[i]), int(o1[j]))
        if cell in index.rows:
            yield -most, l0[i] + l1[j], cell
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o0) and b < len(o1) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (-(u0[a] + u1[b]), a, b))


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; as doubles where no sum can pass 2^53."""
    top = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * max(q.shape[1], 1)
    if top < 1 << 53:
        return (q.astype(float) @ v.astype(float).T).astype(np.int64)
    return q.astype(np.int64) @ v.astype(np.int64).T


def _requests(asking: DataFrame, index, wave: int) -> DataFrame:
    """(c0, c1, part, anchors): the cells that anchors want in this wave, each with the anchors that want it.

    ``asking`` has a, id, label, v, ``floor`` (no row below is wanted) and ``highs``, ``lows``: the windows still open.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        skip, upto = (0 if not wave else ix.first * MORE ** (wave - 1)), ix.first * MORE ** wave
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                b = batch.slice(lo, CHUNK)
                a, ids, labels = (b.column(k).to_numpy() for k in range(3))
                v = matrix(b.column(3), ix.dim)
                highs, lows = b.column(4).to_pylist(), b.column(5).to_pylist()
                wanted: dict[tuple[int, int], list[int]] = {}
                for k in range(len(a)):
                    # a window is open where it can still change: from its low to its high end
                    floor, read = min(lows[k]), 0
                    for most, least, cell in visit(v[k], ix):
                        if most < floor or read >= upto:
                            break
                        if read >= skip and any(most >= x and least <= y for x, y in zip(lows[k], highs[k])):
                            wanted.setdefault(cell, []).append(k)
                        read += ix.rows[cell]
                out: list[tuple] = []
                for cell, who in wanted.items():
                    packed = [x[who].tobytes() for x in (a, ids, labels, v.astype(np.int32))]
                    width = len(highs[0])
                    windows = [np.array([x[k] for k in who], np.int64).tobytes() for x in (lows, highs)]
                    for p in range(ix.parts(cell)):
                        out.append((*cell, p, width, *packed, *windows))
                        if len(out) == _ROWS_OUT:
                            yield _packed(out)
                            out = []
                if out:
                    yield _packed(out)

    return asking.select("a", "id", "label", "v", "highs", "lows").mapInArrow(
        run, "c0 int, c1 int, part int, width int, a binary, own binary, classes binary, q binary, low binary, high binary")


_ASKED = ["c0", "c1", "part", "width", "a", "own", "classes", "q", "low", "high"]

#: Requests handed to Spark at a time.
_ROWS_OUT = 64


def _packed(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 4 + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], _ASKED)


def _scored(requests: DataFrame, blocks: DataFrame, same: bool, keep: int) -> DataFrame:
    """(a, w, score, id): of every block and request, each anchor's first ``keep`` rows in each of its windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = [c[r] for c in batch.columns]
                width = row[3].as_py()
                a, own, classes, low, high = (np.frombuffer(row[k].as_buffer(), np.int64) for k in (4, 5, 6, 8, 9))
                ids, labels = (np.frombuffer(row[k].as_buffer(), np.int64) for k in (10, 11))
                q, v = (np.frombuffer(row[k].as_buffer(), np.int32).reshape(n, -1) for k, n in ((7, len(a)), (12, len(ids))))
                order = np.argsort(ids, kind="stable")
                ids, labels, score = ids[order], labels[order], _exact(q, v[order])
                fit = ((labels == classes[:, None]) == same) & (ids != own[:, None])
                low, high = low.reshape(len(a), width), high.reshape(len(a), width)
                found = []
                for w in range(width):
                    inside = fit & (score >= low[:, w:w + 1]) & (score <= high[:, w:w + 1])
                    at, row_of = np.nonzero(inside)
                    s = score[at, row_of]
                    sort = np.lexsort((row_of, -s, at))
                    at, row_of, s = at[sort], row_of[sort], s[sort]
                    # equal rows of one id count once
                    new = np.ones(len(at), bool)
                    new[1:] = (at[1:] != at[:-1]) | (s[1:] != s[:-1]) | (ids[row_of[1:]] != ids[row_of[:-1]])
                    at, row_of, s = at[new], row_of[new], s[new]
                    rank = np.arange(len(at)) - np.searchsorted(at, at)
                    top = rank < keep
                    found.append((a[at[top]], np.full(top.sum(), w, np.int32), s[top], ids[row_of[top]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "w", "score", "id"])

    return requests.join(blocks, ["c0", "c1", "part"]).select(*_ASKED, "ids", "labels", "vectors").mapInArrow(
        run, "a long, w int, score long, id long")


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` of each window, with rank; Spark keeps that many a task before it shuffles."""
    order = Window.partitionBy("a", "w").orderBy(F.col("score").desc(), "id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def _search(anchors: DataFrame, index, blocks: DataFrame, same: bool, keep: int) -> DataFrame:
    """(a, w, score, id, rank) for the windows of ``anchors`` (a, id, label, v, highs, lows); waves until none is open."""
    best, asking, wave = None, anchors, 0
    rows = sum(index.value.rows.values())
    while True:
        requests = storage.table(_requests(asking, index, wave), "requests")
        if not requests.isEmpty():
            found = _scored(requests, blocks, same, keep).distinct()
            best = storage.table(_best(found if best is None else found.union(best.drop("rank")), keep), "best")
        elif best is None:
            best = storage.table(_best(anchors.sparkSession.createDataFrame([], "a long, w int, score long, id long"), keep), "best")
        if index.value.first * MORE ** wave >= rows:
            return best
        # a full window takes no row under its last one: rows that tie with it may still come before it
        full = best.filter(F.col("rank") == keep).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("last"))
        asking = (anchors.join(full, "a", "left").withColumn("lows", F.when(F.col("last").isNull(), F.col("lows")).otherwise(
            F.transform("lows", lambda x, k: F.greatest(x, F.coalesce(F.try_element_at("last", k.cast("int")), x))))).drop("last"))
        wave += 1


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         anchor: Column | None = None, label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 5,
         percent: int = 80, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor.

    An anchor's positives are its first other rows of the same label by score; ties go to the smaller id. The
    negatives of a positive are the first rows of another label that score from ``percent`` per cent of its score up
    to its score; a positive below zero has none. Scores are inner products of ``floor(scale * x)``.

    ``anchor`` says by ``id`` and ``label`` which rows are anchors (all by default), ``label`` replaces the label column. Rows with a null id,
    label or vector, or a component that is null or not finite, take no part; a shorter vector counts as filled up
    with zeros, components are held to 2^24 in size. Rows of the anchor's own id are not its positives or negatives;
    rows that repeat an id with the same score count once, and so does a repeated anchor. Nothing is sampled but what
    the codebooks are learned from, on which the results do not depend; empty tables give no rows.
    """
    label = F.col(label_col) if label is None else label
    index, rows, blocks = build(quantized(vectors, id_col, vector_col, label, scale), block, first)
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    chosen = rows if anchor is None else rows.filter(anchor)
    far = (1 << 62)
    anchors = storage.table(chosen.distinct().withColumn("a", F.monotonically_increasing_id()), "anchors")
    open_ = anchors.withColumns({"highs": F.array(F.lit(far)), "lows": F.array(F.lit(-far))})
    near = _search(open_, shared, blocks, True, positives)
    listed = near.filter("score >= 0").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    # every anchor has as many windows; those it lacks are empty
    empty = F.array(*[F.lit(-1).cast("long")] * positives)
    highs = F.slice(F.concat(F.transform("p", lambda x: x["score"]), empty), 1, positives)
    lows = F.transform(highs, lambda x: F.when(x < 0, F.lit(far)).otherwise(F.call_function("div", x * percent + 99, F.lit(100))))
    windows = anchors.join(listed, "a").withColumn("highs", highs).withColumn("lows", lows).drop("p")
    against = _search(windows, shared, blocks, False, negatives)
    p = near.select("a", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    n = against.select("a", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (anchors.select("a", F.col("id").alias("anchor_id")).join(p, "a").join(n, ["a", "w"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
